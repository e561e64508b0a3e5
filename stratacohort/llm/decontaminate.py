"""Benchmark decontamination: windows of benchmark words, hashed and broadcast, looked up in every document.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.  A window is `size` consecutive
words of an item; an item with fewer words, but not none, is one window.  A document word inside any occurrence of a
window is hit.  A document is contaminated if it has hits and they are at least `min_share_pct` percent of its words.

The benchmark's distinct windows are written once, with the items that hold them.  If they have at most `max_bytes`, they are broadcast as a
sorted array of 64-bit hashes with their words: documents are scanned as bytes, a polynomial prefix hash gives the hash of
every window of words at once, hashes are looked up in a bit table and then in the sorted array, and each find is
verified byte by byte.  A larger benchmark is broadcast as a bit table of FILTER_BITS only, whatever its size: one scan of the documents
finds the windows whose bit is set, with their words, and these meet the windows' table in one join, by their words; what is found comes back
to the documents by row.  Either way the documents are scanned once.  Memory is bounded by max_bytes and CHUNK_BYTES or the longest text.

Edge cases: a null or empty text has no words and is never contaminated; items without words make no windows; items of
equal text all count; a null item_id counts as "null"; repeated document rows are judged alike; an empty benchmark
contaminates nothing; other columns of the documents pass through.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import aside, drop_paths, let, map_arrow, restored, written

#: Bytes of windows that are broadcast: their words, their items, and WINDOW_BYTES besides for each.
MAX_BYTES, WINDOW_BYTES = 64 << 20, 150
CHUNK_BYTES = 4 << 20
BITS, FILTER_BITS = 22, 27
_P = 0x9E3779B97F4A7C15
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


class Powers:
    """P**j and P**-j modulo 2**64, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up, self.down = (np.full(n, base, np.uint64).cumprod() * np.uint64(pow(base, -1, 1 << 64)) for base in (_P, pow(_P, -1, 1 << 64)))


class Words:
    """Words of a few texts as one byte string, words parted by single spaces, and their places."""

    def __init__(self, texts: list[bytes], powers: Powers, table: bytes = _TABLE):
        raw = b" \x20 ".join(texts) + b" " if texts else b" "
        data = np.frombuffer(raw.translate(table), np.uint8)
        blank = data == 32
        keep = ~blank
        keep[1:] |= ~blank[:-1]  # the first blank after each word stays
        keep[0] = not blank[0]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.data = data[keep]
        gap = np.flatnonzero(blank[keep])
        self.end = gap  # the place of the blank after each word
        self.start = np.concatenate([[0], gap[:-1] + 1]) if len(gap) else gap
        place = np.flatnonzero(keep)[self.end] if len(gap) else gap
        self.doc = np.searchsorted(np.cumsum(lengths + 3), place, "right") if len(texts) else gap
        self.n = np.bincount(self.doc, minlength=len(texts))[: len(texts)] if len(gap) else np.zeros(len(texts), np.int64)
        powers.reach(len(self.data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(self.data)], out=self.sums[1:])
        self.powers = powers

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of so many words within one text."""
        if len(self.doc) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: len(self.doc) - size + 1] == self.doc[size - 1 :])
        s, e = self.start[first], self.end[first + size - 1]
        with np.errstate(over="ignore"):
            h = (self.sums[e] - self.sums[s]) * self.powers.down[s]
            return first, h ^ (h >> np.uint64(29))

    def bytes_of(self, first: int, size: int) -> bytes:
        return self.data[self.start[first] : self.end[first + size - 1]].tobytes()


class Windows:
    """The windows of benchmark items, ready to be looked up; found: by size, the hashes in order and what has each."""

    def __init__(self, found: dict[int, tuple[np.ndarray, list[dict[bytes, list[str]]]]]):
        self.by_size = {}
        for size, (hashes, texts) in found.items():
            bits = np.zeros(1 << BITS, bool)
            bits[hashes >> np.uint64(64 - BITS)] = True
            self.by_size[size] = (hashes, bits, texts)

    def scan(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """First word, words and items of every occurrence."""
        for size, (hashes, bits, texts) in self.by_size.items():
            first, h = words.windows(size)
            maybe = np.flatnonzero(bits[h >> np.uint64(64 - BITS)])
            if len(maybe):
                at = np.searchsorted(hashes, h[maybe])
                same = (at < len(hashes)) & (hashes[np.minimum(at, len(hashes) - 1)] == h[maybe])
                for i, k in zip(first[maybe[same]], at[same]):
                    if items := texts[k].get(words.bytes_of(i, size)):
                        yield int(i), size, items


class Filter:
    """A bit for each window of a benchmark, by size and hash."""

    def __init__(self, words: np.ndarray, sizes: list[int], n_bits: int):
        self.bits, self.sizes, self.n_bits = words, sizes, n_bits

    def scan(self, words: Words) -> Iterator[tuple[int, int, int, bytes]]:
        """First word, number of words, hash and words of every window whose bit is set."""
        for size in self.sizes:
            first, h = words.windows(size)
            at = slot(h, size, self.n_bits)
            found = np.flatnonzero((self.bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
            for i, x in zip(first[found].tolist(), h[found].view(np.int64).tolist()):
                yield i, size, x, words.bytes_of(i, size)


def slot(hashes: np.ndarray, size: int, n_bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (hashes + np.uint64(size) * np.uint64(_P)) >> np.uint64(64 - n_bits)


def _slots(batches: Iterable[pa.RecordBatch], n_bits: int) -> Iterator[pa.RecordBatch]:
    """(at, bits): the bits of a partition's windows, 64 to a row."""
    for batch in batches:
        sizes, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        at = np.unique(np.concatenate([slot(hashes[sizes == n], int(n), n_bits) for n in np.unique(sizes)] or [np.zeros(0, np.uint64)]))
        start = np.flatnonzero(np.concatenate([[True], np.diff(at >> np.uint64(6)) > 0])) if len(at) else np.zeros(0, np.int64)
        bits = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
        yield pa.RecordBatch.from_arrays([pa.array((at[start] >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], names=["at", "bits"])


def filter_of(windows: DataFrame, n_bits: int = FILTER_BITS) -> Filter:
    """The filter, made on the executors: at most 2 ** (n_bits - 6) rows reach the driver."""
    rows = map_arrow(windows.select("size", "hash"), lambda batches: _slots(batches, n_bits), "at bigint, bits bigint").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (n_bits - 6), np.uint64)
    words[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return Filter(words, sorted(r["size"] for r in windows.select("size").distinct().collect()), n_bits)  # as many sizes as a window has words


def block_of(rows: Iterable) -> dict[int, tuple[np.ndarray, list[dict[bytes, list[str]]]]]:
    """Rows of item_windows() as plain data to broadcast."""
    found: dict[int, dict[int, dict[bytes, list[str]]]] = {}
    for r in rows:
        found.setdefault(r["size"], {}).setdefault(r["hash"] % (1 << 64), {})[bytes(r["words"])] = r["items"]
    return {size: (np.array(sorted(x), np.uint64), [x[h] for h in sorted(x)]) for size, x in found.items()}


def _windows_of(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(size, hash, words, item) of every window of the items."""
    powers = Powers()
    for batch in batches:
        rows: list[tuple] = []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = Words([(text or "").encode()], powers)
            n = min(size, int(words.n[0]))
            for i, h in zip(*words.windows(n)) if n else ():
                rows.append((n, int(h) - (1 << 64) if h >> np.uint64(63) else int(h), words.bytes_of(int(i), n), item))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["size", "hash", "words", "item"])


def item_windows(items: DataFrame, size: int = 13, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: size, hash, words and the items that hold them."""
    rows = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("text"))
    found = map_arrow(rows, lambda batches: _windows_of(batches, size), "size int, hash bigint, words binary, item string")
    return found.groupBy("size", "hash", "words").agg(F.collect_set("item").alias("items"))


def _chunks(batch: pa.RecordBatch, text_at: int, powers: Powers) -> Iterator[tuple[int, Words]]:
    """A batch's texts as words, some at a time."""
    texts = [(x or "").encode() for x in batch.column(text_at).to_pylist()]
    at = 0
    while at < len(texts):
        to, total = at + 1, len(texts[at])
        while to < len(texts) and total + len(texts[to]) <= CHUNK_BYTES:
            total += len(texts[to])
            to += 1
        yield to - at, Words(texts[at:to], powers)
        at = to


def _scan(batches: Iterable[pa.RecordBatch], block: dict, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches with n_words, the hit spans (first word, word after the last; united and in order) and the items found."""
    powers, windows = Powers(), Windows(block)
    for batch in batches:
        n_words, spans, items = [], [], []
        for n, words in _chunks(batch, text_at, powers):
            hits: dict[int, list[tuple[int, int]]] = {}
            names: dict[int, set[str]] = {}
            for first, size, found in windows.scan(words):
                doc = int(words.doc[first])
                hits.setdefault(doc, []).append((first, first + size))
                names.setdefault(doc, set()).update(found)
            offset = np.concatenate([[0], np.cumsum(words.n)])
            for doc in range(n):
                n_words.append(int(words.n[doc]))
                spans.append([{"a": a - int(offset[doc]), "b": b - int(offset[doc])} for a, b in united(hits.get(doc, []))])
                items.append(sorted(names.get(doc, ())))
        span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.string()))], names=[*batch.schema.names, "n_words", "spans", "items"])


CANDIDATE = "array<struct<a:int,size:int,hash:bigint,words:binary>>"


def _candidates(batches: Iterable[pa.RecordBatch], windows: Filter, text_at: int) -> Iterator[pa.RecordBatch]:
    """The batches with n_words and the windows that may be the benchmark's."""
    powers = Powers()
    kind = pa.list_(pa.struct([("a", pa.int32()), ("size", pa.int32()), ("hash", pa.int64()), ("words", pa.binary())]))
    for batch in batches:
        n_words, found = [], []
        for n, words in _chunks(batch, text_at, powers):
            offset = np.concatenate([[0], np.cumsum(words.n)])
            mine: list[list[dict]] = [[] for _ in range(n)]
            for first, size, h, raw in windows.scan(words):
                doc = int(words.doc[first])
                mine[doc].append({"a": first - int(offset[doc]), "size": size, "hash": h, "words": raw})
            found += mine
            n_words += words.n.tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n_words, pa.int64()), pa.array(found, kind)], names=[*batch.schema.names, "n_words", "candidates"])


def united(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPANS = "array<struct<a:int,b:int>>"


def scan(docs: DataFrame, items: DataFrame, size: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with n_words, spans, items, n_hit; the text column must be there, columns of those names are replaced."""
    outputs = ("n_words", "spans", "items", "n_hit")
    plain = [c for c in docs.columns if c not in outputs]
    docs, names = aside(docs.select(*[F.col(f"`{c}`") for c in plain]))
    spark, at, used = docs.sparkSession, plain.index(text), []
    windows = written(item_windows(items, size, item_id, item_text), "windows", used)
    each = F.octet_length("words") + F.aggregate("items", F.lit(0), lambda n, x: n + F.octet_length(x)) + WINDOW_BYTES
    total = windows.agg(F.sum(each.cast("long"))).head()[0] or 0
    if total <= max_bytes:
        shared = spark.sparkContext.broadcast(block_of(windows.collect()))  # max_bytes at most
        drop_paths(spark, used)
        schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"n_words bigint, spans {SPANS}, items array<string>").fields])
        out = map_arrow(docs, lambda batches: _scan(batches, shared.value, at), schema)
    else:
        shared = spark.sparkContext.broadcast(filter_of(windows, filter_bits))
        schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(f"n_words bigint, candidates {CANDIDATE}").fields])
        seen = map_arrow(docs, lambda batches: _candidates(batches, shared.value, at), schema)
        seen = written(seen.withColumn("row", F.monotonically_increasing_id()), "scanned")
        maybe = seen.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
        hits = maybe.join(windows, ["size", "hash", "words"]).groupBy(F.col("row").alias("of")).agg(
            F.collect_set(F.struct("a", (F.col("a") + F.col("size")).alias("b"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")
        )
        hits = written(hits, "hits")
        drop_paths(spark, used)
        out = seen.drop("candidates").join(hits, F.col("row") == F.col("of"), "left")
        out = out.withColumns({"spans": _unite(F.coalesce("hit", F.array().cast(SPANS))), "items": F.coalesce("items", F.array().cast("array<string>"))})
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["b"] - x["a"])
    return out.withColumn("n_hit", n_hit).select(*[F.col(hidden).alias(c) for c, hidden in names.items()], *outputs)


def _unite(spans: Column) -> Column:
    """united() as an expression, over the places of all words in the spans."""
    places = F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["a"], x["b"] - 1)))))

    def edges(p: Column) -> Column:
        first = lambda q: F.filter(q, lambda x, i: F.coalesce(F.get(q, i - 1) != x - 1, F.lit(True)))
        last = lambda q: F.filter(q, lambda x, i: F.coalesce(F.get(q, i + 1) != x + 1, F.lit(True)))
        return F.zip_with(first(p), last(p), lambda a, b: F.struct(a.alias("a"), (b + 1).alias("b")))

    return let(places, edges)


def contaminated(n_hit, n_words, min_share_pct: int = 5):
    return (n_hit > 0) & (100 * n_hit >= min_share_pct * n_words)


def remove_documents(docs: DataFrame, items: DataFrame, text: str = "text", min_share_pct: int = 5, **options) -> DataFrame:
    """docs without the contaminated ones."""
    rows, names = aside(docs)
    kept = scan(rows, items, text=names[text], **options).where(~contaminated(F.col("n_hit"), F.col("n_words"), min_share_pct))
    return restored(kept, names)


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with hit words, and what stands between the words of a span, cut out of their texts; a null text stays null."""
    rows, names = aside(docs)
    found = scan(rows, items, text=names[text], **options)
    at = found.columns.index(names[text])
    cut_schema = T.StructType([*found.schema.fields, T.StructField("__cut", T.StringType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, spans in zip(batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()):
                out.append(cut_words(x, [(s["a"], s["b"]) for s in spans]) if x and spans else x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "__cut"])

    return restored(map_arrow(found, cut, cut_schema).withColumn(names[text], F.col("__cut")), names)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    blank = np.frombuffer((raw.translate(_TABLE) + b" "), np.uint8) == 32
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()
