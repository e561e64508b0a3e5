"""Phrase collocation mining: the phrases of each language that hold together, from merged count-min sketches and one exact pass.

First pass: each task counts the n-grams of its texts in a count-min sketch of two rows of 2**25 cells, cells stopping at the threshold.  Sketches
leave the task as compressed slices; slices of one place are added up as they stream in, and a merged cell becomes one
bit: at the threshold or below.  A cell is never below what any n-gram in it counts, so nothing frequent is lost.  Second pass: only n-grams whose bits
are set in both rows, and whose n-grams of one word less are too, are counted exactly, by their words.  Then cuts are scored and subsumed phrases dropped by joins.

Memory: a task holds its sketch (128 MB) and the words of one segment of SEGMENT bytes, cut at piece ends (a longer piece without
any punctuation is held whole).  What is broadcast are 8 MB of bits at any size of input; more input per bit lets more rare n-grams
through to the exact pass, which then shuffles more of them, with the same result.  Counts are reduced in each segment and each task before they are
shuffled; the joins are on (lang, phrase), which Spark splits where a hot first word makes them uneven.  The first rows of a language are found in 64
parts and then among 64 times `top`.

Edge cases: a null text is empty, a null lang is "und"; repeated rows count as often as they are there; a language without candidates has no
rows, and so has an empty table; ties in score and count go by the phrase's UTF-8 bytes; extra columns are not read, whatever their names.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, map_arrow, written

#: Bits of a cell's number, rows of the sketch, slices of a row.
BITS, ROWS, SLICES = 25, 2, 64
SEGMENT = 4 << 20
#: Occurrences that are added before cells are stopped at the threshold again: 16 bits hold both.
CHUNK = 65_000
#: A-Z to lower case, tabs to spaces, what ends a piece (.,;:!? and 0x0A to 0x0D) to a full stop; none of these bytes is part of another character.
_PLAIN = bytes.maketrans(UPPER.encode() + b"\t,;:!?\n\x0b\x0c\r", LOWER.encode() + b" " + b"." * 9)
_MIX, _ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _segments(texts: list[str]) -> Iterator[bytes]:
    """The texts as plain bytes with a full stop at each piece's end, in segments that end at one."""
    held, size = [], 0
    for text in texts:
        data = text.encode().translate(_PLAIN)
        while data:
            end = len(data)
            if end > SEGMENT:
                end = data.rfind(b".", 0, SEGMENT) + 1 or data.find(b".", SEGMENT) + 1 or len(data)
            held.append(data[:end])
            size, data = size + end, data[end:]
            if size >= SEGMENT:
                yield b".".join(held)
                held, size = [], 0
    if held:
        yield b".".join(held)


def _grams(data: bytes, lang: str, most: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Distinct words, the words' numbers in order, and for 1 to `most` words the hashes of n-grams by first place and which are within a piece."""
    coded = pa.array(data.replace(b".", b" . ").split(), pa.binary()).dictionary_encode()
    words, ids = coded.dictionary, coded.indices.to_numpy()
    seed = xxhash.xxh3_64_intdigest(lang)
    of = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.to_pylist()), np.uint64, len(words))
    one = of[ids]
    stop = words.index(pa.scalar(b".", pa.binary())).as_py()
    inside = [ids != stop]
    hashes = [one]
    for n in range(1, most):
        h = (hashes[-1][:-1] * _MIX) + one[n:]
        h ^= h >> np.uint64(31)
        hashes.append(h * _ODD)
        inside.append(inside[-1][:-1] & inside[0][n:])
    return words, ids, hashes, inside


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return ((h * (_MIX if row else np.uint64(1))) >> np.uint64(64 - BITS)).astype(np.int64)


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[str]]]:
    texts: dict[str, list[str]] = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        texts.setdefault(lang, []).append(text)
    yield from texts.items()


def sketch(rows: DataFrame, most: int, least: int) -> np.ndarray:
    """Bits of ROWS merged sketches over lang and text: set where a cell has `least` or more."""
    width, codec = (1 << BITS) // SLICES, "zstd"
    kind = np.uint16 if least <= 255 else np.uint32
    small = np.uint8 if least <= 255 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = None
        for batch in batches:
            for lang, texts in _by_lang(batch):
                for data in _segments(texts):
                    if cells is None:
                        cells = [np.zeros(1 << BITS, kind) for _ in range(ROWS)]
                    _, _, hashes, inside = _grams(data, lang, most)
                    for h, ok in zip(hashes, inside):
                        h = h[ok]
                        for at in range(0, len(h), CHUNK):
                            for row, held in enumerate(cells):
                                c = _cells(h[at : at + CHUNK], row)
                                np.add.at(held, c, kind(1))
                                held[c] = np.minimum(held[c], kind(least))
        for row, held in enumerate(cells or []):
            for s in range(SLICES):
                part = held[s * width : (s + 1) * width]
                if part.any():
                    packed = pa.compress(part.astype(small).tobytes(), codec=codec, asbytes=True)
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([row * SLICES + s], pa.int32()), "cells": pa.array([packed], pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(pa.decompress(packed.as_buffer(), decompressed_size=width * small().itemsize, codec=codec), small)
                sums[s] = np.minimum(sums.get(s, 0) + part.astype(np.uint32), least)
        for s, total in sums.items():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s], pa.int32()), "bits": pa.array([np.packbits(total >= least).tobytes()], pa.binary())})

    parts = map_arrow(rows, count, "slice int, cells binary").repartition(ROWS * SLICES, "slice")
    bits = np.zeros((ROWS * SLICES, width // 8), np.uint8)
    for row in map_arrow(parts, merge, "slice int, bits binary").collect():  # 8 MB at any size
        bits[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return bits.reshape(ROWS, -1)


def frequent(docs: DataFrame, most: int = 4, least: int = 30) -> DataFrame:
    """lang, n, phrase, f: exact counts of all phrases of 1 to `most` words with `least` or more; n = 0 has the words of each language."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") > 0)
    bits = docs.sparkSession.sparkContext.broadcast(sketch(rows, most, least).tobytes())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(bits.value, np.uint8).reshape(ROWS, -1)

        def passes(h: np.ndarray) -> np.ndarray:
            ok = np.ones(len(h), bool)
            for row in range(ROWS):
                c = _cells(h, row)
                ok &= (seen[row][c >> 3] >> (7 - (c & 7)).astype(np.uint8)) & 1 > 0
            return ok

        def out(lang: str, n: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            size = len(counts)
            return pa.RecordBatch.from_arrays([pa.array([lang] * size, pa.string()), pa.array([n] * size, pa.int32()), phrases, pa.array(counts, pa.int64())], names=["lang", "n", "phrase", "f"])

        for batch in batches:
            for lang, texts in _by_lang(batch):
                for data in _segments(texts):
                    words, ids, hashes, inside = _grams(data, lang, most)
                    if total := int(inside[0].sum()):
                        yield out(lang, 0, pa.array([""]), np.array([total]))
                    at = np.flatnonzero(inside[0])  # places whose n-gram may be frequent
                    ok, key = np.zeros(len(ids) + 1, bool), np.zeros(len(ids), np.int64)
                    for n in range(1, most + 1):
                        if n > 1:
                            at = at[ok[at + 1]]
                            at = at[at < len(ids) - n + 1]
                            at = at[inside[n - 1][at]]
                        at = at[passes(hashes[n - 1][at])]
                        ok = np.zeros(len(ids) + 1, bool)
                        ok[at] = True
                        if not len(at):
                            break
                        # exact: the number of the first n-1 words within this segment, and that of the last one
                        whole = (key[at] << 32) | ids[at + n - 1]
                        _, first, number, counts = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
                        key[at] = number
                        parts = [words.take(pa.array(ids[at[first] + i])).cast(pa.string()) for i in range(n)]
                        for lo in range(0, len(first), 100_000):
                            some = [p.slice(lo, 100_000) for p in parts]
                            yield out(lang, n, some[0] if n == 1 else pc.binary_join_element_wise(*some, " "), counts[lo : lo + 100_000])

    found = map_arrow(rows, count, "lang string, n int, phrase string, f bigint")
    return found.groupBy("lang", "n", "phrase").agg(F.sum("f").alias("f")).where((F.col("n") == 0) | (F.col("f") >= least))


def collocations(docs: DataFrame, most: int = 4, least: int = 30, top: int = 2000, share: int = 80) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the `top` phrases of 2 to `most` words, those inside a longer one that is at least `share` percent as frequent left out."""
    made: list[str] = []
    counts = written(frequent(docs, most, least), "phrase-counts", made)
    wide = lambda c: F.col(c).cast("decimal(20,0)")  # noqa: E731  products may pass 64 bits
    found = counts.where("n > 1").select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"))
    cuts = found.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(first) + 2)"))
    side = lambda part, name: counts.where("n > 0").select("lang", F.col("phrase").alias(part), F.col("f").alias(name))
    cuts = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    cuts = cuts.withColumns({"a_": wide("a") * 2_000_000, "lr": wide("l") + wide("r")})
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(F.expr("a_ div lr").alias("score"), "k", "l", "r")).alias("best"))

    words = F.split("phrase", " ", -1)
    within = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("words") - m + 1), lambda s: F.array_join(F.slice(words, s, m), " "))))
    longer = found.where("words > 2").select("lang", F.explode(within).alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    stays = F.col("f").isNull() | (wide("f") * 100 < wide("a") * share)
    kept = best.join(longer, ["lang", "phrase"], "left").where(stays).select("lang", "phrase", "a", "best.score", "best.l", "best.r")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = kept.withColumn("p", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "p").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
