"""Best-fit packing: token pieces of documents into as few sequences of a fixed capacity as a swap-based local search finds.

`pieces` cuts each document's token ids (and a closing id) into pieces of at most `capacity`; `pack` gives each row of any table with
lengths its sequence and its place there.

Rows of one length are interchangeable, so what is packed are counts by length, which Spark aggregates: at most `capacity` numbers,
however many documents there are.  Bins with the same lengths are one pattern with a count, and the search exchanges between whole patterns.  It begins
with best-fit decreasing and then takes the emptiest bins and moves a document to a fuller bin, or exchanges one for one, two for one or one for two, so that the
fuller bin gets fuller and the sum of squared fills rises, until the bin is empty or nothing can be exchanged; it ends when the number
of bins meets a lower bound (documents over half a bin, and volume) or after TRIES bins in a row that can't be emptied.  Then every row finds its place from its rank among the
rows of its length: its rank within its task's rows and its length, and sums of the tasks' counts before it.

Memory and skew: the driver holds counts by length and the patterns, both bounded by the capacity; rows of one length, however many, stay where they
are and are ranked task by task.  What is broadcast is the list of patterns.  A worker holds the token ids of one document and a bounded cache of words.

Edge cases: a null or empty text is the closing id alone; equal rows and null ids are rows of their own; an empty table gives an empty one;
extra columns pass through `pack` whatever their names, but those it adds; a length of none or more than the capacity is an error.
"""
from __future__ import annotations

import json
import os
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, written

#: Words after which a worker's cache begins anew, and the longest word that is kept there.
WORDS, LONG = 500_000, 60
#: A letter or digit and a mark after it, which is no part of the same token.
BEFORE_MARK = r"([a-z0-9])([.,;:!?])"
#: Bytes of texts whose words are looked up at once, words that are encoded at once, and those that are encoded as one text.
TEXTS, AT_ONCE, JOINED = 16 << 20, 4096, 512


@lru_cache(maxsize=1)
def _encoder_of(model: str, apart: bool) -> Callable[[pa.Array], list[bytes]]:
    """The encoder that a worker keeps, with its words."""
    return _encoder(model, apart)


def _encoder(text: str, apart: bool) -> Callable[[pa.Array], list[bytes]]:
    """A function from texts to their ids as little-endian bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(text)

    def whole(texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), AT_ONCE):  # the library's results are many times as large as their ids
            out += [array("I", x.ids).tobytes() for x in model.encode_batch_fast(texts[at : at + AT_ONCE], add_special_tokens=False)]
        return out

    suffix = json.loads(text)["model"].get("end_of_word_suffix")
    closes = np.zeros(max(model.get_vocab().values()) + 1, bool)  # tokens that end a word
    if suffix:
        closes[[i for token, i in model.get_vocab().items() if token.endswith(suffix)]] = True

    def letters(words: list[str]) -> list[bytes]:
        """whole() of words of ASCII letters, many as one text: each ends with the token that ends a word."""
        out = []
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.array(model.encode(" ".join(some), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(closes[ids]) + 1
            if len(ends) != len(some):
                out += whole(some)
                continue
            data, ends = ids.tobytes(), (4 * ends).tolist()
            out += [data[a:b] for a, b in zip([0, *ends], ends)]
        return out

    known: dict[str, bytes] = {}

    def coded(words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        out = [known.get(w) for w in words]
        new = [i for i, ids in enumerate(out) if ids is None]
        for some, f in (([i for i in new if words[i].isascii() and words[i].isalpha()], letters), ([i for i in new if not (words[i].isascii() and words[i].isalpha())], whole)):
            for i, ids in zip(some, f([words[i] for i in some])):
                out[i] = ids
        if len(known) + len(new) > WORDS:
            known.clear()  # what these texts have goes in again
        known.update((w, ids) for w, ids in zip(words, out) if len(w) <= LONG)
        return out

    def by_word(texts: pa.Array) -> list[bytes]:
        special = pc.match_substring(texts, "<|")
        if pc.any(special).as_py():  # the names of special tokens, which have their case
            rest = iter(by_word(pc.if_else(special, "", texts)))
            return [whole([t])[0] if x else y for t, x, y in zip(texts.to_pylist(), special.to_pylist(), rest)]
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(texts, "\n", " ")), BEFORE_MARK, r"\1 \2")
        split = pc.split_pattern(plain, " ")
        words = split.flatten().dictionary_encode()
        ids = coded(words.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) // 4
        lists = pa.ListArray.from_arrays(np.append(np.int32(0), np.cumsum(sizes, dtype=np.int32)), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        ends, out = split.offsets.to_numpy() - split.offsets[0].as_py(), []
        for row in range(0, len(texts), 256):
            cut = ends[row : row + 257]
            taken = lists.take(words.indices.slice(cut[0], cut[-1] - cut[0]))
            upto = taken.offsets.to_numpy()
            data, cuts = taken.values.to_numpy().tobytes(), (4 * (upto - upto[0])[cut - cut[0]]).tolist()
            out += [data[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    return by_word if apart else lambda texts: whole(texts.to_pylist())


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches together, up to TEXTS bytes or one batch."""
    held, size = [], 0
    for batch in batches:
        if held and size + batch.nbytes > TEXTS:
            yield held
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
    if held:
        yield held


def pieces(docs: DataFrame, carry: list[str], model: str, capacity: int = 2048, last: int = 0, apart: bool = False) -> DataFrame:
    """The carried columns, piece, start, length and ids (little-endian unsigned 32 bits) of `text` under a tokenizers file, `last` being appended.

    `apart` says that the model drops white space, lower-cases character by character and has no token of a letter or digit with a mark (BEFORE_MARK)
    after it, so that words and marks are encoded on their own and a worker encodes a frequent one once.
    """
    with open(model, encoding="utf-8") as file:
        text = file.read()
    shipped = docs.sparkSession.sparkContext.broadcast(text)
    columns = docs.select(*[F.col(c) for c in carry], F.coalesce(F.col("text"), F.lit("")))
    schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    width, end = 4 * capacity, np.array([last], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder_of(shipped.value, apart)
        for group in _groups(batches):
            texts = pa.chunked_array([batch.column(len(carry)) for batch in group]).combine_chunks()
            coded, at = encode(texts), 0
            for batch in group:
                some, at = coded[at : at + batch.num_rows], at + batch.num_rows
                rows, number, ids = [], [], []
                for row, data in enumerate(some):
                    data += end
                    for k in range(0, len(data), width):
                        rows.append(row)
                        number.append(k // width)
                        ids.append(data[k : k + width])
                taken = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(taken) for i in range(len(carry))]
                    + [pa.array(number, pa.int32()), pa.array([capacity * k for k in number], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[*carry, "piece", "start", "length", "ids"],
                )

    return map_arrow(columns, cut, schema)


# ---- patterns: tuples of lengths in falling order, with the number of bins that hold them


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound of the number of bins: documents over half a bin each need their own, and the others the room beside them."""
    best = 0
    for small in range(capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - small)
        half = {n: c for n, c in counts.items() if capacity - small >= n > capacity / 2}
        rest = sum(n * c for n, c in counts.items() if capacity / 2 >= n >= small)
        room = sum((capacity - n) * c for n, c in half.items())
        best = max(best, alone + sum(half.values()) + max(0, -(-(rest - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Patterns of best-fit decreasing: each document, the longest first, goes to the fullest bin that has room."""
    by_room: dict[int, Counter] = {capacity: Counter()}
    rooms: list[int] = []

    def put(room: int, pattern: tuple, n: int) -> None:
        if room not in by_room or not by_room[room]:
            insort(rooms, room)
        by_room.setdefault(room, Counter())[pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            room = rooms[at] if at < len(rooms) else capacity
            each = room // length
            if at < len(rooms):
                pattern, bins = by_room[room].popitem()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                pattern, bins = (), -(-left // each)
            full = min(bins, left // each)
            if full:
                put(room - each * length, pattern + (length,) * each, full)
                left -= full * each
            if full < bins:
                if left:  # fewer than would fit
                    put(room - left * length, pattern + (length,) * left, 1)
                    full, left = full + 1, 0
                if full < bins and pattern:
                    put(room, pattern, bins - full)
    return Counter({p: n for held in by_room.values() for p, n in held.items()})


#: Bins in a row that the search can't empty before it ends, and exchanges for each document of a bin.
TRIES, EXCHANGES = 16, 4


def _exchange(giver: tuple, taker: tuple, room: int) -> tuple[int, tuple, tuple] | None:
    """What the giver hands over and gets back so that the taker's fill rises most, within its room: (rise, over, back)."""
    ones = sorted(set(giver))
    twos = {x + y: (x, y) for i, x in enumerate(ones) for y in ones[i:] if x != y or giver.count(x) > 1}
    offers = {**{s: p for s, p in twos.items()}, **{x: (x,) for x in ones}}
    sums = sorted(offers)
    best: tuple[int, tuple, tuple] | None = None

    def try_back(back: tuple, options: list[int]) -> None:
        nonlocal best
        given = sum(back)
        at = bisect_right(options, given + room) - 1
        if at >= 0 and options[at] - given > (best[0] if best else 0):
            over = offers[options[at]] if options is sums else (options[at],)
            best = (options[at] - given, over, back)

    try_back((), ones)  # a move
    kinds = sorted(set(taker))
    for y in kinds:  # one or two for one
        if best and best[0] == room:
            return best
        try_back((y,), sums)
    for i, y in enumerate(kinds):  # one for two
        for z in kinds[i:]:
            if best and best[0] == room:
                return best
            if (y != z or taker.count(y) > 1) and y + z < ones[-1]:
                try_back((y, z), ones)
    return best


def _swapped(pattern: tuple, out: tuple, into: tuple) -> tuple:
    held = Counter(pattern)
    held.subtract(out)
    held.update(into)
    return tuple(sorted(held.elements(), reverse=True))


def search(bins: Counter, capacity: int, bound: int, tries: int = TRIES) -> Counter:
    """Exchange between underfull bins until the bound is met or `tries` bins in a row could not be emptied; each exchange raises the sum of squared fills."""
    bins = Counter(bins)
    total, failed, stuck = sum(bins.values()), 0, set()
    while total > bound and failed < tries:
        under = sorted(((sum(p), p) for p in bins if sum(p) < capacity), reverse=True)
        giver = next((p for _, p in reversed(under) if p not in stuck), None)
        if giver is None:
            break
        left = EXCHANGES * (len(giver) + 1)
        while giver and left:
            left -= 1
            fill = sum(giver)
            found = ((other, swap) for f, other in under if f >= fill and other in bins and (other != giver or bins[giver] > 1) and (swap := _exchange(giver, other, capacity - f)))
            other, swap = next(found, (None, None))
            if not swap:
                break
            _, over, back = swap
            many = bins[giver] // 2 if other == giver else min(bins[giver], bins[other])
            less, more = _swapped(giver, over, back), _swapped(other, back, over)
            bins.subtract({giver: many, other: many} if other != giver else {giver: 2 * many})
            bins.update({less: many, more: many} if less else {more: many})
            bins, giver = +bins, less
            if sum(more) < capacity:
                insort(under, (sum(more), more), key=lambda x: (-x[0], tuple(-n for n in x[1])))
        if giver:
            stuck.add(giver)
            failed += 1
        else:
            total = sum(bins.values())
            stuck.clear()
            failed = 0
    return bins


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Patterns and their numbers of bins for a count of documents by length."""
    return sorted(search(best_fit(counts, capacity), capacity, least_bins(counts, capacity)).items(), reverse=True)


def _ranked(batches: Iterator[pa.RecordBatch], at: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's rank among the task's rows of its length."""
    seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
    for batch in batches:
        lengths = batch.column(at).to_numpy(zero_copy_only=False)
        if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
            raise ValueError("a length is none or more than the capacity")
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.array([], np.int64)
        sizes = np.diff(np.r_[starts, len(ordered)])
        rank = np.empty(len(ordered), np.int64)
        rank[order] = np.arange(len(ordered)) - np.repeat(starts, sizes) + seen[ordered]
        seen[ordered[starts]] += sizes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(rank), pa.int32()), pa.array(rank)], names=[*batch.schema.names, "__part", "__rank"])


def pack(rows: DataFrame, length: str = "length", capacity: int = 2048) -> DataFrame:
    """rows with sequence_id and offset: no sequence holds more than `capacity`, and its rows lie there without gaps."""
    spark, names = rows.sparkSession, rows.columns
    hidden = rows.toDF(*[f"__c{i}" for i in range(len(names))])
    at = names.index(length)
    schema = T.StructType(hidden.schema.fields + [T.StructField("__part", T.IntegerType()), T.StructField("__rank", T.LongType())])
    ranked = written(map_arrow(hidden, lambda batches: _ranked(batches, at, capacity), schema), "packing-rows")
    ranked = ranked.withColumn("__n", F.col(f"__c{at}").cast("long"))
    by_task = written(ranked.groupBy("__part", "__n").agg(F.count("*").alias("c")), "packing-counts")
    counts = {r["__n"]: r["c"] for r in by_task.groupBy("__n").agg(F.sum("c").alias("c")).collect()}  # `capacity` rows at most

    places, first, used = [], 0, Counter()
    for pattern, n in patterns(counts, capacity):
        start = 0
        for size, each in sorted(Counter(pattern).items(), reverse=True):
            places.append((size, used[size], used[size] + n * each, first, each, start))
            used[size] += n * each
            start += size * each
        first += n
    plan = spark.createDataFrame(places, "size long, lo long, hi long, first long, each long, start long")

    before = F.sum("c").over(Window.partitionBy("__n").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = by_task.select("__part", "__n", F.coalesce(before, F.lit(0)).alias("before"))
    found = ranked.join(offsets, ["__part", "__n"]).withColumn("__g", F.col("before") + F.col("__rank"))
    found = found.join(F.broadcast(plan), (F.col("__n") == F.col("size")) & (F.col("__g") >= F.col("lo")) & (F.col("__g") < F.col("hi")))
    found = found.withColumn("__slot", F.col("__g") - F.col("lo"))
    return found.select(
        *[F.col(f"__c{i}").alias(c) for i, c in enumerate(names)],
        (F.col("first") + F.expr("__slot div each")).alias("sequence_id"), (F.col("start") + F.pmod("__slot", F.col("each")) * F.col("__n")).alias("offset"),
    )
