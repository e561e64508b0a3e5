"""Sequences as token ids: a vocabulary looked up in bulk, unknown tokens as one id, and prompts that never become text."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config

UNKNOWN = 0
#: Bytes of a vocabulary that every worker holds; a larger one is joined.
VOCAB_BYTES = 64 << 20


def encode(rows: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "row_idx", max_bytes: int = VOCAB_BYTES) -> DataFrame:
    """key and ids array<int>: the ids of the array column `tokens` in vocab(token, token_id), UNKNOWN where it has none.

    A token that the vocabulary has twice is an error; key is distinct.  Up to max_bytes of vocabulary no row moves: workers look up whole batches.
    Beyond that tokens meet the vocabulary in a join and their sequences again by key.
    """
    words = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).where("token IS NOT NULL AND token_id IS NOT NULL").distinct()
    n, distinct, size = words.agg(F.count("*"), F.count_distinct("token"), F.coalesce(F.sum(F.octet_length("token") + 12), F.lit(0))).head()
    if n != distinct:
        raise ValueError("a token has more than one id")
    if size > max_bytes:
        long = rows.select(key, F.posexplode_outer(tokens).alias("pos", "token")).join(words, "token", "left")
        found = long.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("id"))))).alias("p"))
        return found.select(key, F.transform("p", lambda x: x["id"]).alias("ids"))
    table = words.toArrow().combine_chunks()
    shared = rows.sparkSession.sparkContext.broadcast((table["token"].to_pylist(), table["token_id"].to_pylist()))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = pa.array(shared.value[0], pa.string()), pa.array([*shared.value[1], UNKNOWN], pa.int32())
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = pc.fill_null(pc.index_in(lists.flatten().cast(pa.string()), known), len(ids) - 1)
            offsets = pa.array(lists.offsets.to_numpy() - lists.offsets[0].as_py(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, ids.take(at))], names=[key, "ids"])

    schema = T.StructType([rows.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.select(key, tokens).mapInArrow(look_up, schema)


def suffix_ids(vocab: DataFrame, config: Config) -> list[int]:
    """Ids of the tokens that end every prompt."""
    tokens = config.prompt_suffix.strip().split()
    known = {r["token"]: r["token_id"] for r in vocab.where(F.col("token").isin(tokens)).select("token", "token_id").collect()}
    return [int(known.get(t, UNKNOWN)) for t in tokens]


def prompt_ids(pairs: DataFrame, traj: DataFrame, vocab: DataFrame, config: Config) -> DataFrame:
    """row_idx, seq_point, ids: prompts() in ids.  A sequence is encoded once, whatever the number of its prompts."""
    coded = encode(traj.join(pairs.select("row_idx").distinct(), "row_idx", "left_semi"), vocab)
    end = F.array(*[F.lit(i) for i in suffix_ids(vocab, config)]).cast("array<int>")
    ids = F.slice(F.concat(F.slice("ids", F.lit(1), F.col("seq_point").cast("int")), end), 1, config.max_length)
    return pairs.join(coded, "row_idx").select("row_idx", "seq_point", ids.alias("ids"))


def disease_ids(diseases: DataFrame, vocab: DataFrame) -> DataFrame:
    """disease and token_id of each listed disease; one that is no token of the vocabulary is an error that names it."""
    found = diseases.select("disease").distinct().join(vocab.select(F.col("token").alias("disease"), F.col("token_id").cast("int").alias("token_id")), "disease", "left")
    unknown = F.col("token_id").isNull() | (F.col("token_id") == UNKNOWN)
    bad = F.raise_error(F.concat(F.lit("not a token of the vocabulary: "), F.col("disease")))
    return found.withColumn("token_id", F.when(unknown, bad.cast("int")).otherwise(F.col("token_id")))
