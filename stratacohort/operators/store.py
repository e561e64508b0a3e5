"""A store of scores: kept in buckets that are committed one by one, so that a stopped run goes on where it stopped."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import scratch
from .scoring import missing_pairs

SCHEMA = "row_idx bigint, seq_point bigint, logits array<double>"


class ScoreStore:
    """Scores below `path`, which stands for one scorer with its settings, one set of trajectories and one disease list.

    Missing pairs are dealt to `buckets` by a hash of the pair.  A bucket is scored by one job over its own prompts and is there once Spark has
    committed it (_SUCCESS); what a job that was stopped has left is never read.  The next run scores the pairs that no committed bucket has, of this or
    any other cohort.  One run at a time writes to a store.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _committed(self) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/*/*/_SUCCESS")
        found = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
        return sorted(x.getPath().getParent().toString() for x in found or [])

    def read(self) -> DataFrame:
        """All committed scores."""
        paths = self._committed()
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def clear(self) -> None:
        scratch.delete(self.spark, [self.path])

    def complete(self, pairs: DataFrame, prompts: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame], DataFrame], progress: Callable[[int, int], None] | None = None) -> DataFrame:
        """The store's scores once all pairs that have a prompt are among them; progress(scored, missing) is called after each bucket.

        prompts(pairs) makes prompts of pairs, score(prompts) scores them; neither is called if nothing is missing.
        """
        missing = missing_pairs(pairs, self.read())
        if missing.isEmpty():
            return self.read()
        made: list[str] = []
        try:
            bucket = F.pmod(F.xxhash64("row_idx", "seq_point"), F.lit(self.buckets)).cast("int")
            rows = scratch.written(prompts(missing).withColumn("bucket", bucket).repartition("bucket", F.xxhash64("seq_point", "row_idx") % 64), "prompts", made, by=["bucket"])
            total = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
            done, run = 0, f"{self.path}/{uuid.uuid4().hex}"
            for b in sorted(total):
                seen = Observation()
                scores = score(rows.where(F.col("bucket") == b).drop("bucket")).select(F.col("row_idx").cast("long"), F.col("seq_point").cast("long"), F.col("logits").cast("array<double>"))
                scores.observe(seen, F.count("*").alias("n")).write.parquet(f"{run}/{b:05d}")
                done += seen.get["n"]
                if progress:
                    progress(done, sum(total.values()))
        finally:
            scratch.delete(self.spark, made)
        return self.read()
