"""Stage 1 over arriving shards: a patient's walk needs that patient's row alone, so it runs batch by batch."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import Config
from ..operators import sequence


def arriving(spark: SparkSession, path: str, schema) -> DataFrame:
    """Trajectory shards below path, as a stream; row_idx must be a column of the shards."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def append_points(traj: DataFrame, config: Config, path: str, checkpoint: str):
    """A started query that appends stage 1's points of every micro-batch; run it again and it goes on after the last one.

    A batch is written under its own number and replaced if it is repeated after a failure, so its points are there once.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        _, points = sequence.stage1(batch, config)
        points.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return traj.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
