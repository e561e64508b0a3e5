"""Helpers shared by the corpus operators: the cluster's shared folder, written tables, ASCII rules."""
from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the contracts: 0x20 and 0x09-0x0D.  The same set as Java's \s.
WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and the master is local, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="stratacohort-"))
        found = context.getCheckpointDir()
    return found.rstrip("/")


_COLLECTORS: list[list[str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _COLLECTORS:
        made.append(path)
    return path


@contextmanager
def collected() -> Iterator[list[str]]:
    """Collects the paths that operators make in the shared folder within the block, for whoever writes their results to delete."""
    made: list[str] = []
    _COLLECTORS.append(made)
    try:
        yield made
    finally:
        _COLLECTORS.remove(made)


def written(df: DataFrame, name: str, used: list[str] | None = None) -> DataFrame:
    """df, computed once and kept as a table in the shared folder: cuts lineage and survives lost executors.

    Its path is added to `used`, for drop_paths() once nothing reads it any more; tables that a result reads stay.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if used is not None:
        used.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_paths(spark: SparkSession, used: list[str]) -> None:
    """Delete tables that written() made, all but those that are still wanted having been taken from the list."""
    while used:
        drop_path(spark, used.pop())


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote into the shared folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there as a whole or not at all."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(hadoop(path + ".tmp"), True)
    out.write(bytearray(text.encode()))
    out.close()
    system.rename(hadoop(path + ".tmp"), hadoop(path))


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [x.getPath().getName() for x in system.listStatus(hadoop)] if system.exists(hadoop) else []


#: Bytes of the Arrow batches that go to Python: rows may be long, and a batch is held whole.
BATCH_BYTES = 8 << 20


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow with batches bounded in bytes; a worker gives its memory back after each task, as idle ones wait beside the JVM."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return df.mapInArrow(run, schema)


def aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with its columns under names that no operator uses, and those names: extra columns then clash with nothing."""
    names = {c: f"__c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def restored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """The columns that were set aside, under their own names."""
    return df.select(*[F.col(hidden).alias(c) for c, hidden in names.items()])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else; the fast lower() does it where no other capital is in the text."""
    others = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"
    plain = (F.octet_length(c) == F.length(c)) | ~F.regexp_like(c, F.lit(others))
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def strip_white(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once per row, even where body uses it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
