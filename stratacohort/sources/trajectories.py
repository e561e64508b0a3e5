"""Sources: trajectory shards, id lists, code lists, vocabularies; row identity."""
from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUIRED = {"seq": "string", "token_count_thru_2022": "int", "total_token_count": "int"}


def scan_trajectories(spark: SparkSession, path: str) -> DataFrame:
    """All *.parquet files below path, columns united by name and types widened, with row_idx in file and row order."""
    return with_patient_id(with_row_idx(united(spark, path)))


def united(spark: SparkSession, path: str) -> DataFrame:
    """Files below path whose columns may differ, in one scan: a column that a file lacks is null there, numbers have the widest type of any file.

    Spark unites schemas in one job; where types conflict, files are told apart by folder and then by halves until each group agrees, a job for
    each, so runs of files of one kind cost a few jobs.  The scan itself widens what the Parquet reader can widen;
    columns with other types besides (numbers in one file, text in another) are read kind by kind, as text.
    """
    read = lambda **more: spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.parquet", **more)
    try:
        return read(mergeSchema=True).parquet(path)
    except AnalysisException as e:
        if "UNABLE_TO_INFER_SCHEMA" in str(e) or "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no Parquet file below {path}") from e
        raise
    except Exception as e:
        if not _conflict(e):
            raise
    kinds: dict[str, tuple[T.StructType, list[str]]] = {}
    files = sorted(r["path"] for r in read().format("binaryFile").load(path).select("path").collect())  # the scan's listing is on the driver as well
    for schema, some in _kinds(spark, files):
        kinds.setdefault(schema.json(), (schema, []))[1].extend(some)
    wide = _widest([schema for schema, _ in kinds.values()])
    if all(_reads(schema[f.name].dataType, f.dataType) for schema, _ in kinds.values() for f in wide if f.name in schema.names):
        return read().schema(wide).parquet(path)
    parts = []
    for schema, some in kinds.values():
        rows = spark.read.schema(schema).parquet(*some).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        parts.append(rows.select(*[(F.col(f.name) if f.name in schema.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wide], "__file", "__row"))
    return reduce(DataFrame.unionByName, parts)


def _conflict(e: Exception) -> bool:
    return "CANNOT_MERGE_SCHEMA" in str(e) or "CANNOT_MERGE_INCOMPATIBLE_DATA_TYPE" in str(e)


def _kinds(spark: SparkSession, files: list[str]) -> list[tuple[T.StructType, list[str]]]:
    """Groups of files whose schemas agree, with what they unite to."""
    try:
        return [(spark.read.option("mergeSchema", True).parquet(*files).schema, files)]
    except Exception as e:
        if len(files) == 1 or not _conflict(e):
            raise
    folders: dict[str, list[str]] = {}
    for f in files:
        folders.setdefault(f.rpartition("/")[0], []).append(f)
    groups = list(folders.values()) if len(folders) > 1 else [files[: len(files) // 2], files[len(files) // 2 :]]
    return [kind for group in groups for kind in _kinds(spark, group)]


#: Numbers from the narrowest to the widest.
WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
FRACTIONS = [T.FloatType(), T.DoubleType()]


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds both; text where there is no such number."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    for order in (WHOLE, FRACTIONS):
        if a in order and b in order:
            return max(a, b, key=order.index)
    if {a, b} <= {*WHOLE[:3], *FRACTIONS}:
        return T.DoubleType()
    atomic = lambda x: not isinstance(x, (T.StructType, T.ArrayType, T.MapType, T.BinaryType))
    if atomic(a) and atomic(b):
        return T.StringType()
    raise TypeError(f"columns of type {a.simpleString()} and {b.simpleString()} can't be united")


def _widest(schemas: list[T.StructType]) -> T.StructType:
    found: dict[str, T.DataType] = {}
    for f in (f for schema in schemas for f in schema):
        try:
            found[f.name] = _wider(found[f.name], f.dataType) if f.name in found else f.dataType
        except TypeError as e:
            raise ValueError(f"column {f.name}: {e}") from e
    return T.StructType([T.StructField(name, kind) for name, kind in found.items()])


def _reads(stored: T.DataType, wanted: T.DataType) -> bool:
    """Whether the Parquet reader gives the stored type as the wanted one."""
    return stored == wanted or {stored, wanted} <= set(WHOLE) or {stored, wanted} <= set(FRACTIONS) or stored in WHOLE[:3] and wanted == T.DoubleType()


#: Files whose offsets are broadcast: a hash and an offset each, 64 MB in all.
BROADCAST_FILES = 2_000_000


def with_row_idx(rows: DataFrame, broadcast_files: int = BROADCAST_FILES) -> DataFrame:
    """Consecutive numbers in the order of (file path, row in file).

    Rows are counted by file with one small aggregation, from footers alone; a row's number is its file's offset plus its place in the file, so
    nothing is sorted or gathered, and a recomputed task gives the same numbers.  Offsets go to the scan by broadcast, keyed by a 64-bit hash of the
    path (two paths of one hash are an error), up to broadcast_files files: no trajectory is shuffled.  Beyond that they are joined.
    """
    if "__file" in rows.columns:
        placed = rows
    else:
        placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    files = placed.groupBy("__file").agg(F.count("*").alias("n"))
    # As many rows as there are files: a running sum over them is small.
    before = F.expr("coalesce(sum(n) OVER (ORDER BY __file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    offsets = files.select(F.xxhash64("__file").alias("__key"), before.alias("__before"))
    same = F.count("*").over(Window.partitionBy("__key"))
    offsets = offsets.withColumn("__same", same).select("__key", F.when(F.col("__same") == 1, F.col("__before")).otherwise(F.raise_error(F.lit("two files of one hash")).cast("long")).alias("__before"))
    few = len(rows.inputFiles()) <= broadcast_files  # the driver has the listing
    joined = placed.withColumn("__key", F.xxhash64("__file")).join(F.broadcast(offsets) if few else offsets, "__key")
    return joined.withColumn("row_idx", F.col("__before") + F.col("__row")).drop("__file", "__row", "__before", "__key")


def with_patient_id(rows: DataFrame) -> DataFrame:
    for name in ("enrollee_id", "person_id"):
        if name in rows.columns:
            return rows.withColumn("patient_id", F.col(name).cast("string"))
    raise ValueError("trajectories need a column enrollee_id or person_id")


def validate(rows: DataFrame, longitudinal: bool = True) -> DataFrame:
    """rows, once the columns that stage 1 needs are known to be there."""
    needed = [c for c in REQUIRED if longitudinal or c != "total_token_count"]
    if missing := [c for c in needed if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return rows


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, as strings, from a .parquet, .csv or .txt file; nulls and blank lines are dropped."""
    kind = path.lower().rstrip("/").rsplit(".", 1)[-1]
    if kind == "txt":
        ids = spark.read.text(path).select(F.btrim("value", F.lit(" \t\n\x0b\f\r")).alias("id")).where("id <> ''")
    elif kind in ("parquet", "csv"):
        rows = spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)
        if not rows.columns:
            return spark.createDataFrame([], "id string")
        ids = rows.select(F.col("enrollee_id" if "enrollee_id" in rows.columns else rows.columns[0]).cast("string").alias("id"))
    else:
        raise ValueError(f"an id list is .parquet, .csv or .txt, not {path}")
    return ids.where("id IS NOT NULL").distinct()


def code_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct codes from the column "ICD code" of a CSV file."""
    return spark.read.option("header", True).csv(path).select(F.col("`ICD code`").alias("code")).where("code IS NOT NULL").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) from Parquet, or from the JSON of a word-level tokenizer: an object of tokens and ids."""
    if not path.lower().endswith(".json"):
        return spark.read.parquet(path).select("token", F.col("token_id").cast("int").alias("token_id"))
    text = spark.read.text(path, wholetext=True)
    pairs = F.from_json("value", T.MapType(T.StringType(), T.IntegerType()))
    return text.select(F.explode(pairs).alias("token", "token_id"))


def disease_vocabulary(vocab: DataFrame) -> DataFrame:
    """Disease tokens of a vocabulary, by id."""
    return vocab.where(F.col("token").startswith("<DX-MAJOR_")).orderBy("token_id")


def known_diseases(vocab: DataFrame, codes: DataFrame) -> DataFrame:
    """Diseases of a code list that the vocabulary knows (id 0 is the unknown token), each once."""
    from ..functions.tokens import disease_token

    wanted = codes.select(disease_token(F.col("code")).alias("token")).distinct()
    return vocab.where("token_id <> 0").join(wanted, "token", "left_semi")
