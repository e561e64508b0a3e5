"""Points of arriving shards are those of all shards at once."""
from pyspark.sql import functions as F

from stratacohort import streaming
from stratacohort.config import profile
from stratacohort.operators import sequence
from stratacohort.sources import fixtures


def test_batches_add_up(spark, sf_dir, tmp_path):
    traj, config = fixtures.trajectories(spark, sf_dir), profile("days")
    run = lambda: streaming.append_points(streaming.arriving(spark, f"{tmp_path}/in", traj.schema), config, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    for part in range(2):
        traj.where(F.col("row_idx") % 2 == part).write.parquet(f"{tmp_path}/in/{part}")
        run()
    run()  # nothing new
    got = spark.read.parquet(f"{tmp_path}/out")
    want = sequence.stage1(traj, config)[1]
    assert got.select("batch_id").distinct().count() == 2
    assert got.drop("batch_id").exceptAll(want.select(got.drop("batch_id").columns)).isEmpty() and got.count() == want.count()
