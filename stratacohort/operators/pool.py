"""Stage 3c: cells pooled by disease, and a run's summary."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disease_auc(cells: DataFrame) -> DataFrame:
    """Unweighted mean of the cells' areas, with cells and rows counted."""
    return cells.groupBy("disease").agg(
        F.avg("auc").alias("auc"), F.count("*").alias("n_samples"), F.sum("n_diseased").cast("long").alias("n_diseased"), F.sum("n_healthy").cast("long").alias("n_healthy")
    )


def pooled_variance(cells: DataFrame) -> DataFrame:
    """The variance of the mean area: sum of the cells' variances over their squared number; NULL if a cell has none."""
    var = F.when(F.count("var") == F.count("*"), F.sum("var") / F.pow(F.count("*"), F.lit(2)))
    return cells.groupBy("disease").agg(F.avg("auc").alias("auc"), var.alias("var"), F.count("*").alias("n_samples"))


def summary(pooled: DataFrame) -> DataFrame:
    """Diseases, their mean area, and how many are below one half; areas are rounded first, so that ties at one half stay ties."""
    auc = F.round(F.round("auc", 12), 6)
    return pooled.agg(F.count("*").alias("n_diseases"), F.round(F.avg(auc), 6).alias("mean_auc"), F.count_if(auc < 0.5).cast("long").alias("n_below_half"))
