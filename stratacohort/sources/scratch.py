"""Tables and small files between steps, in the folder that driver and executors share (spark.checkpoint.dir)."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is set and the master is local, as in tests, a temporary one."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stratacohort-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new place below the shared folder."""
    return f"{shared(spark)}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str, used: list[str] | None = None, by: list[str] | None = None, below: str | None = None) -> DataFrame:
    """rows, computed once and kept as a table, in folders by the columns `by`: later steps read it, also after an executor is lost.  Its path is added to `used`.

    With the path of another table in `below` it is kept in a hidden folder there, and goes with that table.
    """
    path = folder(rows.sparkSession, name) if below is None else f"{below}/_tables/{name}-{uuid.uuid4().hex}"
    (rows.write.partitionBy(*by) if by else rows.write).parquet(path)
    if used is not None and below is None:
        used.append(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def tasks_for(spark: SparkSession, rows: int | None, most: int) -> int:
    """Partitions for a repartition of so many rows, at most about `most` in each.

    A number given by hand, which Spark doesn't lower: sorted, a partition takes many times its bytes in the shuffle, by which Spark would merge it with others.
    """
    return max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // most))


def delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths.pop())
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def fingerprint(rows: DataFrame, columns: list[str]) -> str:
    """Stands for the rows, in any order, with these columns: their number and two sums of hashes, in one small aggregation."""
    def total(*more: Column) -> Column:
        return F.coalesce(F.sum(F.xxhash64(*columns, *more).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")

    found = rows.agg(F.count("*").cast("string"), total(), total(F.lit(1))).head()
    return "-".join(found)
