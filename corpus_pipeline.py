"""A corpus pipeline of five stages over `documents`: quality rules, line dedup, near-dedup, benchmark decontamination, tokens.

Each stage is (name, function) with function(spark, docs, sf_dir); its result is written as Parquet and reread as the
next one's docs.  All but the last return the columns of `documents`; a stage decides on all that its predecessor kept.

Edge cases, for all stages: an empty table gives an empty one; columns besides doc_id, text and n_chars pass through, whatever their
names; equal rows are documents of their own until near-dedup keeps one of them; a null doc_id is an id like others, and the last
of its class to stay.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratacohort.llm import decontaminate, line_dedup, near_dedup, quality_rules, sentencepiece_codec
from stratacohort.llm.common import collected, drop_paths, written
from stratacohort.llm.queries import PIECE_MODEL, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are among them."""
    return quality_rules.reject(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more hold go; n_chars follows the text.  A text may become empty; a null one becomes empty, with no characters."""
    return line_dedup.remove_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the smallest id; texts without words all stay."""
    return near_dedup.dedup(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; texts without words are never among them."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, in place of the text; null for a null text, none for an empty one."""
    return sentencepiece_codec.encode(docs, PIECE_MODEL).drop("text")


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near), ("decontaminate", benchmark), ("sentencepiece", tokens)]
#: Consistent weighted sampling and the tokenizer can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`.  What a stage made in the shared folder is deleted once its result is written; only the last result stays."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with collected() as made:
            result: list[str] = []
            docs = written(stage(spark, docs, sf_dir), f"stage-{name}", result)
        drop_paths(spark, [*before, *(x for x in made if x not in result)])
        before = result
    return docs
