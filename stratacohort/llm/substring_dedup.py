"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after ., ! or ? and white space, and after line ends.  Every run of SPAN consecutive sentences, of whatever length, is
hashed (96 bits, over lower-cased words and the ends of sentences, by prefix sums over the words' hashes).  The hashes meet globally, and a
sentence covered by any occurrence of a repeated run but the first goes; nothing else is touched.

A passage that is repeated without SPAN whole sentences in it stays.  `window` is for texts without sentence ends: sentences of more than `window`
words are cut on by winnowing, after the word with the least hash of every `window` words in a row, the last of equal ones.  Such a cut depends on the
words around it only, so a passage is cut alike wherever it stands, and one of (SPAN + 2) * window words has a whole run; but then pieces of
sentences go.  It is off by default.

`passage` is for passages that begin and end within sentences, and leaves the sentences as they are: besides the runs of whole sentences, stretches of
k = passage // 2 words are hashed, of every passage - k + 1 in a row the one with the least hash (winnowing), so that whatever `passage` words
two places share, a stretch within it is hashed in both.  Of a repeated one the words go, and no more of their sentences; n_removed counts sentences that lose words.  It is off by default too.

The first occurrence is the one with the smallest (document id, text hash, place).  Hashes are counted with map-side
aggregation, so a span that a third of the documents hold is a single row by then; the join back moves (hash, document,
place) only, and adaptive execution splits a hot hash; what is left of it, the occurrences of repeated runs, is written, and the first
occurrence of each is found among these alone.  Texts move once, with the places of what goes and the number of sentences, and only
those from which something goes are cut again.  Splitting is done by one function for both passes, one text at a time.  Used tables are
deleted, but those that the result reads.

Edge cases: null and empty texts stay as they are, with no sentences; a text with fewer sentences than a span never
changes; rows with equal id and text are the same document, and are treated alike; different texts of one id are told apart by 128
bits; a null id sorts first; existing columns with the names of outputs are replaced, others pass through, whatever their names.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, drop_paths, map_arrow, written
from .decontaminate import Powers

SPAN = 3
_WORD = re.compile(r"\S+\s*")
_LOW = (1 << 31) - 1


def word_hash(word: str) -> int:
    """64 bits; the last says whether the word ends a sentence."""
    h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return h | 1 if word[-1] in ".!?" else h & ~1


class _Hashes(dict):
    """Hashes of words; some are kept."""

    def __missing__(self, word: str) -> int:
        h = word_hash(word)
        if len(self) < 1 << 16:
            self[word] = h
        return h


_hash = _Hashes().__getitem__


class Layout(NamedTuple):
    """The hashes of a text's lower-cased words, and for each sentence (or piece of one) the words up to its end."""

    hashes: np.ndarray
    ends: np.ndarray


def layout(text: str, window: int | None = None) -> Layout:
    lines = [x.split() for x in text.lower().split("\n")]
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    n = int(sizes.sum())
    hashes = np.fromiter(map(_hash, chain.from_iterable(lines)), np.uint64, n)
    ending = np.zeros(n + 1, bool)
    ending[1:] = hashes & np.uint64(1)
    ending[np.cumsum(sizes)] = True
    ending[0] = False
    if window and n > window:
        # The least rank first, and of equal ones the last; windows of the one size are the least of smaller windows.
        least, width, sentence = (hashes >> np.uint64(32)).astype(np.int64) << 31 | (_LOW - np.arange(n)), 1, np.cumsum(ending)
        while width < window:
            more = min(width, window - width)
            least, width = np.minimum(least[:-more], least[more:]), width + more
        within = sentence[: n - window] == sentence[window:n]  # a sentence's end cuts the windows that hold it
        ending[_LOW - (least[: n - window][within] & _LOW) + 1] = True
    return Layout(hashes, np.flatnonzero(ending[1:]) + 1)


def cut(text: str, ends: np.ndarray) -> list[str]:
    """The pieces, which joined give the text."""
    words = _WORD.findall(text)
    out = ["".join(words[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist())]
    if out and (lead := len(text) - len(text.lstrip())):
        out[0] = text[:lead] + out[0]
    return out


def sentences(text: str) -> list[str]:
    """Sentences that joined give the text."""
    return cut(text, layout(text).ends)


@cache
def _powers() -> Powers:
    return Powers()


def spans(found: Layout, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places where runs start, and two hashes of each run, of 64 and 32 bits."""
    at = np.arange(max(0, len(found.ends) - span + 1))
    a, b = np.append(0, found.ends)[at], found.ends[at + span - 1]
    words = found.hashes.copy()
    powers = _powers()
    powers.reach(len(words) + 1)
    out = []
    with np.errstate(over="ignore"):
        words[found.ends - 1] += np.uint64(0xD6E8FEB86659FD93)  # where a sentence ends
        for _ in range(2):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up[: len(words)])])
            h = (sums[b] - sums[a]) * powers.down[a]
            out.append(h ^ (h >> np.uint64(31)))
            words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            words ^= words >> np.uint64(27)
    return at, out[0].view(np.int64), (out[1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


#: What is added to the place of a stretch, which is that of a word: below all places of runs, in the same order.
STRETCH = -(1 << 31)


def stretches(hashes: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words where chosen stretches of passage // 2 words start, and two hashes of each, as spans() has them."""
    size = passage // 2
    n, wide = len(hashes) - size + 1, passage - size + 1
    if n < wide:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    at, words, powers, out = np.arange(n), hashes ^ np.uint64(0x94D049BB133111EB), _powers(), []
    powers.reach(len(words) + 1)
    with np.errstate(over="ignore"):
        for _ in range(2):
            words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            words ^= words >> np.uint64(27)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers.up[: len(words)])])
            h = (sums[size:] - sums[:-size]) * powers.down[:n]
            out.append(h ^ (h >> np.uint64(31)))
        rank = out[0] * np.uint64(0x9E3779B97F4A7C15)
    # As in layout(): the least rank first, and of equal ones the last.
    least, width = (rank >> np.uint64(33)).astype(np.int64) << 31 | (_LOW - at), 1
    while width < wide:
        more = min(width, wide - width)
        least, width = np.minimum(least[:-more], least[more:]), width + more
    at = np.unique(_LOW - (least & _LOW))
    return at, out[0][at].view(np.int64), (out[1][at] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _emit(batches: Iterable[pa.RecordBatch], span: int, window: int | None, passage: int | None, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (high, low, id, sum, at) of all runs and stretches, and one for each text with the number of its sentences in at and no hash."""
    for batch in batches:
        ids, sums, texts = batch.columns
        rows, found = [], []

        def out() -> pa.RecordBatch:
            take = pa.array(np.concatenate(rows))  # noqa: B023
            at, high, low = (np.concatenate([x[k] for x in found]) for k in range(3))  # noqa: B023
            none = np.concatenate([np.append(np.zeros(len(x[0]) - 1, bool), True) for x in found])  # noqa: B023
            return pa.RecordBatch.from_arrays([pa.array(high, mask=none), pa.array(low, mask=none), ids.take(take), sums.take(take), pa.array(at.astype(np.int32))], names=names)  # noqa: B023

        n = 0
        for row, text in enumerate(texts):
            laid = layout(text.as_py() or "", window)
            at, high, low = spans(laid, span)
            if passage:
                more = stretches(laid.hashes, passage)
                at, high, low = np.append(at, more[0] + STRETCH), np.append(high, more[1]), np.append(low, more[2])
            rows.append(np.full(len(at) + 1, row, np.int32))
            found.append((np.append(at, len(laid.ends)), np.append(high, 0), np.append(low, np.int32(0))))
            n += len(at) + 1
            if n > 100_000:
                yield out()
                rows, found, n = [], [], 0
        if rows:
            yield out()


def _kept(text: str, places: list[int], span: int, window: int | None, passage: int | None) -> tuple[int, str]:
    """The number of sentences of which words go, and what is left."""
    ends = layout(text, window).ends
    starts = np.append(0, ends)
    gone = np.zeros(starts[-1], bool)
    for p in places:
        if p < 0:
            gone[p - STRETCH : p - STRETCH + passage // 2] = True
        else:
            gone[starts[p] : starts[p + span]] = True
    left = "".join(x for x, y in zip(cut(text, np.arange(1, len(gone) + 1)), gone) if not y)
    return int(np.logical_or.reduceat(gone, starts[:-1]).sum()), left


def dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text: str = "text", window: int | None = None, passage: int | None = None) -> DataFrame:
    """docs with n_sentences, n_removed and kept_text."""
    spark, outputs, used = docs.sparkSession, ("n_sentences", "n_removed", "kept_text"), []
    docs, names = aside(docs)
    id_col, text = names[id_col], names[text]
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")))).alias("__sum")  # tells texts of one id apart
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("__id"), key, F.col(text).alias("__text"))
    schema = T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.IntegerType()), T.StructField("__id", id_type), T.StructField("__sum", T.BinaryType()), T.StructField("at", T.IntegerType())])
    found = written(map_arrow(rows, lambda b: _emit(b, span, window, passage, schema.names), schema), "sentence-runs", used)  # read several times
    sizes, found = found.where("high IS NULL"), found.where("high IS NOT NULL")
    repeated = found.groupBy("high", "low").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = written(repeated, "repeated-runs", used)  # tables of their own, so that joins can be split at hot runs
    occurrences = written(found.join(repeated, ["high", "low"]), "occurrences", used)
    occurrence = F.struct("__id", "__sum", "at")
    firsts = written(occurrences.groupBy("high", "low").agg(F.min(occurrence).alias("first")), "first-runs", used)
    later = occurrences.join(firsts, ["high", "low"]).where(~occurrence.eqNullSafe(F.col("first")))
    none = F.lit(None).cast("int")
    marks = later.select("__id", "__sum", "at", none.alias("n")).unionByName(sizes.select("__id", "__sum", none.alias("at"), F.col("at").alias("n")))
    places = marks.groupBy(F.col("__id").alias("__hid"), F.col("__sum").alias("__hsum")).agg(F.max("n").alias("__n"), F.array_sort(F.collect_set("at")).alias("__at"))
    places = written(places, "places")
    drop_paths(spark, used)

    @F.pandas_udf("n int, kept string")
    def left(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if t is None else _kept(t, list(p), span, window, passage) for t, p in zip(texts, places)], columns=["n", "kept"])

    out = docs.withColumn("__sum", key)
    out = out.join(places, F.col(id_col).eqNullSafe(F.col("__hid")) & (F.col("__sum") == F.col("__hsum")), "left")
    some = F.size("__at") > 0
    out = out.withColumn("__left", left(F.when(some, F.col(text)), F.when(some, F.col("__at"))))
    kept = F.when(some, F.col("__left.kept")).otherwise(F.col(text))
    results = [F.col("__n").cast("long").alias("n_sentences"), F.coalesce("__left.n", F.lit(0)).cast("long").alias("n_removed"), kept.alias("kept_text")]
    return out.select(*[F.col(hidden).alias(c) for c, hidden in names.items() if c not in outputs], *results)
