"""Sinks, the file formats between stages and back, and stages that are computed once for each configuration."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions import tokens as tk
from . import scratch


def write_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def materialise(spark: SparkSession, path: str, name: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table path/name-key, made if it isn't there in full: the key stands for all settings and inputs."""
    table = f"{path.rstrip('/')}/{name}-{key}"
    if not exists(spark, f"{table}/_SUCCESS"):
        write_parquet(make(), table)
    return spark.read.parquet(table)


def require(rows: DataFrame, columns: list[str], what: str) -> DataFrame:
    """rows, once they are known to have the columns of such a file."""
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
    return rows


STAGE1 = ["row_idx", "seq", "eval_seq", "disease_points", "disease_points_ages", "disease_points_visit_location"]
STAGE2 = ["disease", "sex", "age", "label", "row_idx", "seq_point"]
STAGE2_LISTS = ["disease", "sex", "age", "case_ids", "control_ids", "case_seq_points", "control_seq_points"]


def stage1_file(traj: DataFrame, points: DataFrame) -> DataFrame:
    """Trajectories with list columns of their points: the file format between stages."""
    point = F.array_sort(F.collect_list(F.struct("k", "pos", "q", "loc")))
    lists = points.groupBy("row_idx").agg(point.alias("p")).select(
        "row_idx", F.transform("p", lambda x: x["pos"].cast("int")).alias("disease_points"),
        F.transform("p", lambda x: x["q"] / F.lit(4.0)).alias("disease_points_ages"), F.transform("p", lambda x: x["loc"].cast("int")).alias("disease_points_visit_location"),
    )
    return traj.join(lists, "row_idx")


def points_of(stage1: DataFrame, config: Config) -> DataFrame:
    """Points again from a file of stage 1: tokens are those of the whole sequence at the points' places."""
    require(stage1, [c for c in STAGE1 if c != "eval_seq"], "a file of stage 1")
    tokens = tk.split_tokens(F.col("seq"))
    zipped = F.arrays_zip(F.col("disease_points").alias("pos"), F.col("disease_points_ages").alias("age"), F.col("disease_points_visit_location").alias("loc"))
    rows = stage1.select("row_idx", tk.sex(tokens, config.sex_index).alias("sex"), tokens.alias("tokens"), F.posexplode(zipped).alias("k", "p"))
    return rows.select(
        "row_idx", "sex", F.col("k").cast("long").alias("k"), F.get("tokens", F.col("p.pos")).alias("token"),
        F.col("p.pos").cast("long").alias("pos"), F.round(F.col("p.age") * 4).cast("long").alias("q"), F.col("p.loc").cast("long").alias("loc"),
    )


def with_ids(rows: DataFrame, vocab: DataFrame | None) -> DataFrame:
    """rows with the id of their disease's token beside it, null if the vocabulary lacks it; as they are without a vocabulary."""
    if vocab is None:
        return rows
    ids = vocab.select(F.col("token").alias("disease"), F.col("token_id").cast("int").alias("disease_token"))
    return rows.join(ids, "disease", "left")


def stage2_rows(cohort: DataFrame, age_step: int, vocab: DataFrame | None = None) -> DataFrame:
    """The file format between stages 2 and 3: a row for each case and control of the two-class cells."""
    return with_ids(cohort.select(*STAGE2).withColumn("age_step", F.lit(age_step)), vocab)


def cohort_of(stage2: DataFrame) -> DataFrame:
    """Cohort rows again from a file of stage 2, of rows or of lists."""
    more = [c for c in ("disease_token",) if c in stage2.columns]
    if "case_ids" not in stage2.columns:
        return require(stage2, STAGE2, "a file of stage 2").select(*STAGE2, *more)
    require(stage2, STAGE2_LISTS, "a file of stage 2")

    def side(name: str, label: int) -> DataFrame:
        zipped = F.arrays_zip(F.col(f"{name}_ids").alias("row_idx"), F.col(f"{name}_seq_points").alias("seq_point"))
        rows = stage2.select("disease", "sex", "age", *more, F.explode(zipped).alias("p"))
        return rows.select("disease", "sex", "age", F.lit(label).alias("label"), "p.row_idx", "p.seq_point", *more)

    return side("case", 1).unionByName(side("control", 0))


#: Cohort rows, on the average, that a task makes lists of.
TASK_ROWS = 1 << 20
CELL, LISTS = ["sex", "disease", "age"], ["case_ids", "control_ids", "case_seq_points", "control_seq_points"]


def _lists_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a cell, in any order, to one row with its lists, to none if it lacks a class; of several cells if their hashes are the same."""
    cells, types = {}, []
    for batch in batches:
        types = [batch.schema.field(c).type for c in CELL]
        while batch.num_rows:
            key = tuple(batch.column(c)[0].as_py() for c in CELL)
            here = [pc.is_null(batch.column(c)) if k is None else pc.fill_null(pc.equal(batch.column(c), k), False) for c, k in zip(CELL, key)]
            here = pc.and_(pc.and_(here[0], here[1]), here[2])
            own = batch if pc.all(here).as_py() else batch.filter(here)
            # Copies: a view would keep the batch with the cell's name in every row.
            cells.setdefault(key, []).append([np.array(pc.fill_null(own.column("label"), -1)), np.array(own.column("row_idx")), np.array(own.column("seq_point"))])
            batch = batch.slice(0, 0) if own is batch else batch.filter(pc.invert(here))
    for key, parts in cells.items():
        label, row, point = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        places = [np.flatnonzero(label == side) for side in (1, 0)]
        if all(len(x) for x in places):
            places = [x[np.lexsort((point[x], row[x]))] for x in places]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(values[x], pa.int64())) for values in (row, point) for x in places]
            yield pa.RecordBatch.from_arrays([*(pa.array([k], t) for k, t in zip(key, types)), *lists], names=[*CELL, *LISTS])


def stage2_lists(cohort: DataFrame, age_step: int, vocab: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """One row for each two-class cell, with its ids and scoring points as lists, for programs that read such files: a cell must fit in a row.

    Cells are dealt out by the number of rows, n, which are counted unless given.  A hash may give a task several large cells: Spark sorts its rows by
    a cell's hash (one number, which it sorts by digits), on disk if need be, and one cell at a time becomes arrays of numbers, so no task holds more lists than those of a cell.
    """
    rows = cohort.select(F.xxhash64(*CELL).alias("cell"), *CELL, "label", "row_idx", "seq_point")
    rows = rows.repartition(scratch.tasks_for(cohort.sparkSession, cohort.count() if n is None else n, TASK_ROWS), "cell")
    schema = T.StructType([*(cohort.schema[c] for c in CELL), *(T.StructField(c, T.ArrayType(T.LongType())) for c in LISTS)])
    return with_ids(rows.groupBy("cell").applyInArrow(_lists_of_cells, schema).withColumn("age_step", F.lit(age_step)), vocab)


#: Bytes of lists that a writer, and a reader's batch, holds, or those of one cell if they are more.
LISTS_BYTES = 16 << 20


def write_lists(rows: DataFrame, path: str) -> None:
    """A file of stage2_lists().  Parquet's writer would look at its size after a hundred rows only, and a reader takes all rows of a row group at once."""
    rows.write.mode("overwrite").option("parquet.block.size", LISTS_BYTES).option("parquet.page.size.row.check.min", 1).option("parquet.page.size.row.check.max", 1).parquet(path)
