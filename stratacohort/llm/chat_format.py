"""Chat formatting with perspective rotation (native DataFrame code throughout).

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all others
as named users; system rows stay system messages.  Only the assistant's own words, with their end mark, are
trained on: `masks` has their character spans.

A message is "<|im_start|>" + header + newline + text + "<|im_end|>" + newline, with the header "assistant",
"user name=" + speaker, or "system".  "<|" inside a text is broken up by a zero-width space, so that a text cannot
forge a mark; white space and marks in a name become "_".

A rendering is one row, however long.  Whoever has conversations that no row should hold can ask for parts: part i has
the messages that start in characters [i * part_chars, (i + 1) * part_chars), so a row is bounded by part_chars and the
longest message, and the parts of a rendering, one after the other, are the rendering.

A conversation may hold a third of all rows, so none is gathered or sorted as a whole.  Equal rows are counted before the shuffle.
Messages are dealt out by ranges of conversation, turn, speaker and text; the place of a message is summed in two levels, first within
its range and then over the ranges, of which a conversation has one row each.  The join with the participants is one that
adaptive execution splits at a hot conversation.

Edge cases: messages are ordered by turn, speaker and text, nulls first; repeated rows are messages of their own; a null
text is empty; a null speaker is a user without a name and no participant; a null conversation is one
conversation; a conversation without participants gives no rows; extra columns are not rendered.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Characters of a text that tell the ranges apart; texts with the same beginning, turn and speaker share a range.
BEGINNING = 64
START, END = "<|im_start|>", "<|im_end|>\n"


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",), part_chars: int | None = None) -> DataFrame:
    """One row for each conversation, perspective and part: n_messages, n_trained, text, masks array<struct<start, end>>."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).alias("speaker"), F.col(text).alias("said"))
    rows = rows.groupBy("conv_id", "turn", "speaker", "said").agg(F.count("*").alias("copies"))
    rows = rows.withColumn("beginning", F.substring("said", 1, BEGINNING)).repartitionByRange("conv_id", "turn", "speaker", "beginning").drop("beginning")
    rows = written(rows.withColumn("block", F.spark_partition_id()), "turns")
    is_system = F.coalesce(F.col("speaker").isin(*system), F.lit(False))
    people = rows.where(F.col("speaker").isNotNull() & ~is_system).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    seen = rows.join(people, F.col("conv_id").eqNullSafe(F.col("__conv"))).drop("__conv")

    name = F.regexp_replace("speaker", r"[\s<|>]+", "_")
    own = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    user = F.when(F.col("speaker").isNull(), F.lit("user")).otherwise(F.concat(F.lit("user name="), name))
    header = F.when(own, "assistant").when(is_system, "system").otherwise(user)
    head = F.concat(F.lit(START), header, F.lit("\n"))
    body = F.concat(F.replace(F.coalesce("said", F.lit("")), F.lit("<|"), F.lit("<\u200b|")), F.lit(END))
    seen = seen.select("conv_id", "perspective", "block", "turn", "speaker", "said", "copies", own.alias("own"), head.alias("head"), body.alias("body"))
    seen = seen.withColumns({"n_head": F.length("head"), "n": F.length("head") + F.length("body")}).withColumn("all_n", F.col("copies") * F.col("n"))

    # Two levels: places within a block, and the characters of the blocks before.
    key = ["conv_id", "perspective"]
    order = [F.col(c).asc_nulls_first() for c in ("turn", "speaker", "said")]
    inner = Window.partitionBy(*key, "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    blocks = seen.groupBy(*key, "block").agg(F.sum("all_n").alias("block_n"))
    outer = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*[F.col(c).alias(f"__{c}") for c in (*key, "block")], F.coalesce(F.sum("block_n").over(outer), F.lit(0)).alias("before"))
    placed = seen.withColumn("start", F.sum("all_n").over(inner) - F.col("all_n"))
    same = F.lit(True)
    for c in (*key, "block"):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    placed = placed.join(before, same).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    placed = placed.withColumn("start", F.col("start") + F.col("before") + F.col("copy") * F.col("n"))

    part = (F.floor(F.col("start") / part_chars) if part_chars else F.lit(0)).cast("long").alias("part")
    message = F.struct("start", F.concat("head", "body").alias("text"), "own", "n_head", "n")
    parts = placed.select(*key, part, message.alias("m")).groupBy(*key, "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    first = F.col("m")[0]["start"]
    span = lambda x: F.struct((x["start"] - first + x["n_head"]).alias("start"), (x["start"] - first + x["n"] - 1).alias("end"))  # noqa: E731  without the last newline
    own_messages = F.filter("m", lambda x: x["own"])
    return parts.select(
        *key, "part", F.size("m").cast("long").alias("n_messages"), F.size(own_messages).cast("long").alias("n_trained"),
        F.array_join(F.transform("m", lambda x: x["text"]), "").alias("text"), F.transform(own_messages, span).alias("masks"),
    )
