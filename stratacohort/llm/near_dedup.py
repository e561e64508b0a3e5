"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

Shingles are runs of SHINGLE words (white space parts words, A-Z lower-cased); a text with fewer words is one shingle.
A shingle weighs its count in the text times the sum of its words' inverse document frequencies, as integers: for a word that the
share f of all documents with words holds,
    idf(word) = round(64 * (1 + ln(1 / f) / ln(RARE))), and 128 if it is rarer than one document in RARE,
so that rare words weigh up to twice what common ones do, and weights do not depend on the number of documents.  Document frequencies
are counted exactly, in one distributed aggregation.  Only words that one document in RARE holds need a table: RARE times the
mean number of distinct words in a document at most, however many documents there are; it is broadcast.  (A shingle's own document
frequency would drive large groups of near copies apart: what they share is frequent because of them, and their few differences are rare.)
Two texts are near copies if their weighted Jaccard similarity, sum of minima / sum of maxima, is MIN_SIMILARITY_PCT percent or more,
which is decided in integers.

1. Sketch: SAMPLES consistent weighted samples a text, in BANDS bands; equal texts are one node.
2. Star: every member of a band bucket is verified against the bucket's smallest node.  Linear in any bucket.
3. Components of the verified links, by alternating large-star and small-star steps on tables.
4. Rest: in buckets that still hold several components, every pair across components is verified exactly, in the first band that it
   shares, unless an exact upper bound (the minima of the weights' sums in BINS hash bins, added up) is too low; pairs whose sketches
   agree most come first.  Buckets are cut into blocks of about BLOCK members or BLOCK_BYTES of text that meet in pairs of blocks, and texts
   come along, so that no pair is ever a row; only links leave.  A component with BLOCK members or more has blocks of its own, which don't
   meet each other: a large group of copies meets the few others of its bucket, in linear time.  Steps 3 and 4 thus give the components of all pairs that share a
   band, without a cap on candidates; a pair at similarity 0.8 shares none with a probability of 4e-4.

Nothing of the size of the documents reaches the driver: the table of common words and one row of sums for each component step do.  Tables
between steps are written to the shared folder, and deleted once the classes are written.

Edge cases: a text without words (null, empty, white space) is a class of its own; equal texts are one class; class_id is the smallest
document id of the class, null only if all are null; repeated rows and equal ids are rows of their own with the class of
their text; texts are taken whole; an empty table gives an empty result; extra columns pass through `dedup` and `classes`.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, aside, drop_paths, map_arrow, restored, written
from .decontaminate import Powers, Words

SHINGLE = 5
MIN_SIMILARITY_PCT = 80
BANDS, ROWS = 20, 5
SAMPLES = BANDS * ROWS
#: A word held by fewer than one document in so many weighs most.
RARE = 4096
#: Rows of the tables of random numbers; a shingle takes one by its hash.
TABLE_BITS = 14
BLOCK, BLOCK_BYTES = 512, 8 << 20
BINS = 256
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if chr(c) in WHITE else c for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Idf:
    """Weights of words by hash: those of the common words, which are given, and 128 for all others."""

    def __init__(self, hashes: np.ndarray, idf: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.idf = hashes[order], idf[order].astype(np.int32)
        bits = max(8, len(hashes).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.hashes >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = np.full(len(words), 128, np.int64)
        slot = (words >> self.shift).astype(np.int64)
        at, left = self.first[slot], np.arange(len(words))
        end = self.first[slot + 1]
        while len(left := left[at[left] < end[left]]):  # a slot has few words
            same = self.hashes[at[left]] == words[left]
            out[left[same]] = self.idf[at[left[same]]]
            left = left[~same]
            at[left] += 1
        return out


class Weigher:
    """Weighted shingles of texts."""

    def __init__(self, idf: Idf | None = None, size: int = SHINGLE):
        self.idf, self.size, self.powers = idf, size, Powers()

    def words(self, text: str) -> Words:
        return Words([text.encode("utf-8", "surrogatepass")], self.powers, _WORD_BYTES)

    def word_hashes(self, words: Words) -> np.ndarray:
        return _mixed(words.windows(1)[1])

    def shingles(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and their weights."""
        words = self.words(text)
        k = min(self.size, int(words.n[0]))
        if not k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(self.idf(self.word_hashes(words)))])
        hashes, first, counts = np.unique(_mixed(words.windows(k)[1]), return_index=True, return_counts=True)
        return hashes, (sums[k:] - sums[:-k])[first] * counts


def shares(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[int, int]:
    """Sums of minima and of maxima of two texts' weights."""
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][x], b[1][y]).sum())
    return low, int(a[1].sum() + b[1].sum()) - low


def similar(a, b, pct: int = MIN_SIMILARITY_PCT) -> bool:
    ta, tb = int(a[1].sum()), int(b[1].sum())
    if 100 * min(ta, tb) < pct * max(ta, tb):  # the sums alone rule it out
        return False
    low, high = shares(a, b)
    return 100 * low >= pct * high


class Sampler:
    """Improved consistent weighted sampling: for element i and sample k, r and c are Gamma(2, 1) and b is uniform;
    t = floor(ln w / r + b), ln a = ln c - r * (t - b) - r, and the sample is (i, t) of the least a."""

    def __init__(self, samples: int = SAMPLES):
        n = 1 << TABLE_BITS

        def uniform(k: int) -> np.ndarray:
            numbers = np.arange(k * n * samples + 1, (k + 1) * n * samples + 1, dtype=np.uint64).reshape(n, samples)
            return ((_mixed(numbers * _MIX) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

        self.r = (-np.log(uniform(0) * uniform(1))).astype(np.float32)
        self.c = np.log(-np.log(uniform(2) * uniform(3))).astype(np.float32)
        self.b = uniform(4).astype(np.float32)
        self.samples = samples

    def __call__(self, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        log = np.log(weights.astype(np.float64)).astype(np.float32)[:, None]
        row = (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        every = np.arange(self.samples)
        best = np.full(self.samples, np.inf, np.float32)
        out = np.zeros(self.samples, np.uint64)
        for at in range(0, len(hashes), 256):
            i = row[at : at + 256]
            r, b = self.r[i], self.b[i]
            t = np.floor(log[at : at + 256] / r + b)
            a = self.c[i] - r * (t - b) - r
            k = a.argmin(0)
            least = a[k, every]
            better = least < best
            key = hashes[at + k] ^ _mixed(t[k, every].astype(np.int64).astype(np.uint64) + np.uint64(1))
            best, out = np.where(better, least, best), np.where(better, key, out)
        return _mixed(out + np.arange(self.samples, dtype=np.uint64) * _MIX)


@cache
def _sampler() -> Sampler:
    """One for each Python worker."""
    return Sampler()


def _bands(samples: np.ndarray) -> np.ndarray:
    out = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            out = _mixed(out * _MIX + samples[j::ROWS])
    return out.view(np.int64)


def _count_words(batches: Iterable[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(word, documents), each word of a partition once or a few times; the null word has the documents with words."""
    weigher, seen, n_seen, n = Weigher(), [], 0, 0

    def counted() -> pa.RecordBatch:
        words, counts = np.unique(np.concatenate([*seen, np.zeros(0, np.uint64)]), return_counts=True)
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0):
            found = np.unique(weigher.word_hashes(weigher.words(text.as_py())))
            seen.append(found)
            n += len(found) > 0
            n_seen += len(found)
            if n_seen >= most:
                yield counted()
                n_seen = 0
    yield counted()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n], pa.int64())], names=["word", "n"])


def idf_table(texts: DataFrame) -> Idf:
    """The weights of all words that one document in RARE holds, from exact counts over all texts."""
    used: list[str] = []
    counts = written(map_arrow(texts, _count_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")), "words", used)
    total = counts.where("word IS NULL").agg(F.max("n")).head()[0] or 0
    found = counts.where(F.col("word").isNotNull() & (F.col("n") * RARE >= total)).toArrow()  # RARE times the mean distinct words of a document at most
    drop_paths(texts.sparkSession, used)
    word, n = found["word"].to_numpy().view(np.uint64), found["n"].to_numpy()
    return Idf(word, np.rint(64 * (1 + np.log(max(total, 1) / np.maximum(n, 1)) / np.log(RARE))))


def _sketch(batches: Iterable[pa.RecordBatch], idf: Idf) -> Iterator[pa.RecordBatch]:
    weigher, sampler = Weigher(idf), _sampler()
    for batch in batches:
        nodes, bands, marks, sizes, seen = [], [], [], [], set()
        for node, text in zip(batch.column(0), batch.column(1)):
            if (node := node.as_py()) not in seen:
                seen.add(node)
                samples = sampler(*weigher.shingles(text := text.as_py()))
                nodes.append(node)
                sizes.append(len(text))
                bands.append(_bands(samples))
                marks.append((samples >> np.uint64(48)).astype(np.uint16).tobytes())
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        offsets = pa.array(np.arange(len(nodes) + 1, dtype=np.int32) * BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.ListArray.from_arrays(offsets, flat), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64())], names=["node", "bands", "marks", "size"])


def _verify(batches: Iterable[pa.RecordBatch], idf: Idf) -> Iterator[pa.RecordBatch]:
    """Links among pairs (a, b, text_a, text_b)."""
    weigher, last, shingles = Weigher(idf), None, None
    for batch in batches:
        kept = []
        for a, text_a, text_b in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if a != last:
                last, shingles = a, weigher.shingles(text_a.as_py())
            kept.append(similar(shingles, weigher.shingles(text_b.as_py())))
        yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))


def _binned(shingles: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of a text's weights in hash bins."""
    return np.bincount((shingles[0] & np.uint64(BINS - 1)).astype(np.int64), shingles[1], BINS)


def _close(batches: Iterable[pa.RecordBatch], idf: Idf) -> Iterator[pa.RecordBatch]:
    """Links across components in every block of a bucket; a block's rows come one after the other."""
    weigher = Weigher(idf)
    links: list[tuple[bytes, bytes]] = []

    def close(rows: list[dict]) -> None:
        band, i, j = rows[0]["band"], rows[0]["i"], rows[0]["j"]
        names = {c: k for k, c in enumerate(dict.fromkeys(r["comp"] for r in rows))}
        if len(names) < 2:
            return
        comp = np.array([names[r["comp"]] for r in rows])
        marks = np.stack([np.frombuffer(r["marks"], np.uint16) for r in rows])
        bands = np.array([r["bands"] for r in rows], np.int64)
        side = np.array([r["block"] for r in rows])
        shingles = [weigher.shingles(r["text"]) for r in rows]
        bins = np.stack([_binned(x) for x in shingles])
        total = bins.sum(1)
        for x in range(len(rows) - 1):
            low = np.minimum(bins[x + 1 :], bins[x]).sum(1)  # no less than the sum of the shingles' minima
            other = np.flatnonzero(100 * low >= MIN_SIMILARITY_PCT * (total[x + 1 :] + total[x] - low)) + x + 1
            other = other[(comp[other] != comp[x]) & ~(bands[other, :band] == bands[x, :band]).any(1)]
            if i != j:  # pairs within a block are another block pair's
                other = other[side[other] != side[x]]
            agree = (marks[other] == marks[x]).sum(1)
            for y in other[np.argsort(-agree, kind="stable")].tolist():
                if comp[y] != comp[x] and similar(shingles[x], shingles[y]):
                    links.append((rows[x]["node"], rows[y]["node"]))
                    comp[comp == comp[y]] = comp[x]

    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = (row["bucket"], row["band"], row["i"], row["j"])
            if k != key and rows:
                close(rows)
                rows = []
            key = k
            rows.append(row)
        yield _pairs(links)
        links.clear()
    if rows:
        close(rows)
    yield _pairs(links)


def _pairs(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(x) for x in links], pa.binary()), pa.array([max(x) for x in links], pa.binary())], names=["a", "b"])


def components(links: DataFrame, used: list[str] | None = None) -> DataFrame:
    """(node, comp) of every node in links(a, b): comp is the component's smallest node."""
    spark, steps = links.sparkSession, []
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", steps)
    state = None
    while True:
        # Large star: each node's larger neighbours go to the least of its neighbourhood.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: each node and its smaller neighbours go to the least of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges", steps)
        drop_paths(spark, steps[:-1])
        steps = steps[-1:]
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).head()
        if now == state:
            break
        state = now
    if used is not None:
        used += steps
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def _node(text: str):
    """16 bytes for a text with words, else null."""
    return F.when(F.btrim(F.col(text), F.lit(WHITE)) != "", F.unhex(F.md5(text)))


def near_classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, comp) for the texts that have near copies; node is the text's 128-bit hash."""
    spark, used = docs.sparkSession, []
    texts = docs.select(_node(text).alias("node"), F.col(text).alias("text")).where("node IS NOT NULL")
    idf = spark.sparkContext.broadcast(idf_table(texts.select("text")))
    sketches = map_arrow(texts, lambda b: _sketch(b, idf.value), "node binary, bands array<bigint>, marks binary, size bigint")
    sketches = written(sketches.groupBy("node").agg(*[F.first(c).alias(c) for c in ("bands", "marks", "size")]), "sketches", used)

    members = sketches.select("node", "size", F.posexplode("bands").alias("band", "bucket"))
    # Sums that are joined back are written first: such a join can be split at a hot bucket.
    live = members.groupBy("band", "bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1")
    live = written(live.select("band", "bucket", "first"), "buckets", used)
    members = written(members.join(live, ["band", "bucket"]), "members", used)
    # Copies become one row on the map side, before the join that they would overload.
    held = texts.groupBy("node").agg(F.first("text").alias("text")).join(members.select("node").distinct(), "node", "left_semi")
    held = written(held, "texts", used)

    pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    pairs = pairs.join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    pairs = pairs.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    links = written(map_arrow(pairs.sortWithinPartitions("a"), lambda b: _verify(b, idf.value), "a binary, b binary"), "links", used)
    comps = written(components(links, used), "components", used)

    labelled = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # Blocks of a bucket: those of each large component, then those of all others together (no key); `at` is the number of the first.
    sums = labelled.groupBy("band", "bucket", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    sums = sums.withColumn("key", F.when(F.col("n") >= BLOCK, F.col("comp"))).groupBy("band", "bucket", "key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("comps"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    mixed = sums.groupBy("band", "bucket").agg(F.sum("comps").alias("comps"), F.array_sort(F.collect_list(F.struct("key", blocks.alias("blocks")))).alias("parts")).where("comps > 1")
    at = F.transform("parts", lambda x, i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda n, y: n + y["blocks"]))
    parts = F.zip_with("parts", at, lambda x, i: F.struct(x["key"].alias("key"), x["blocks"].alias("blocks"), i.alias("at")))
    mixed = written(mixed.select("band", "bucket", parts.alias("parts")), "buckets", used)
    rest = labelled.join(mixed, ["band", "bucket"])
    own = F.coalesce(*[F.get(F.filter("parts", f), F.lit(0)) for f in (lambda x: x["key"] == F.col("comp"), lambda x: x["key"].isNull())])
    rest = rest.withColumn("own", own).withColumn("block", F.col("own.at") + F.pmod(F.xxhash64("node"), F.col("own.blocks")).cast("int"))
    others = F.filter("parts", lambda x: x["key"].isNull() | ~x["key"].eqNullSafe(F.col("own.key")))
    numbers = F.flatten(F.transform(others, lambda x: F.sequence(x["at"], x["at"] + x["blocks"] - 1)))
    meet = F.transform(numbers, lambda y: F.struct(F.least("block", y).alias("i"), F.greatest("block", y).alias("j")))
    rest = rest.select("band", "bucket", "node", "comp", "block", F.explode(meet).alias("m")).select("band", "bucket", "node", "comp", "block", "m.i", "m.j")
    rest = rest.join(sketches.drop("size"), "node").join(held, "node")
    rest = rest.repartition("bucket", "band", "i", "j").sortWithinPartitions("bucket", "band", "i", "j", "node")
    more = written(map_arrow(rest, lambda b: _close(b, idf.value), "a binary, b binary"), "links", used)

    # The new links join components; those that nothing joins stay.
    up = comps.select(F.col("node").alias("n"), F.col("comp").alias("c"))
    joined = more.join(up, F.col("a") == F.col("n"), "left").select(F.coalesce("c", "a").alias("a"), "b")
    joined = joined.join(up, F.col("b") == F.col("n"), "left").select("a", F.coalesce("c", "b").alias("b"))
    top = written(components(joined, used).select(F.col("node").alias("c"), F.col("comp").alias("top")), "components", used)
    merged = comps.join(top, comps["comp"] == top["c"], "left").select("node", F.coalesce("top", "comp").alias("comp"))
    alone = top.join(comps, top["c"] == comps["node"], "left_anti").select(F.col("c").alias("node"), F.col("top").alias("comp"))
    out = written(merged.unionByName(alone), "near-classes")
    drop_paths(spark, used)
    idf.destroy()
    return out


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, all columns but the text, with class_id, the smallest id of each document's class, and n_docs, its documents."""
    kept = [c for c in docs.columns if c not in (text, "class_id", "n_docs")]
    docs, names = aside(docs)
    id_col, text = names[id_col], names[text]
    comps = near_classes(docs, text).select(F.col("node").alias("__n"), F.col("comp").alias("__comp"))
    rows = docs.withColumn("__node", _node(text)).drop(text)
    rows = rows.withColumn("__key", F.coalesce("__node", F.unhex(F.md5(F.concat(F.lit("no words"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))))
    rows = rows.join(comps, F.col("__key") == F.col("__n"), "left").withColumn("__class", F.coalesce("__comp", "__key"))
    sums = written(rows.groupBy("__class").agg(F.min(id_col).alias("__low"), F.count("*").alias("__rows")), "classes")  # its join can then be split at a hot class
    return rows.join(sums, "__class").select(*[F.col(names[c]).alias(c) for c in kept], F.col("__low").alias("class_id"), F.col("__rows").alias("n_docs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: that with the smallest id, of equal rows any one; documents without words all stay."""
    docs, names = aside(docs)
    id_col, text = names[id_col], names[text]
    node = _node(text)
    comps = near_classes(docs, text).select(F.col("node").alias("__n"), F.col("comp").alias("__comp"))
    rows = docs.select(F.col(id_col).alias("__id"), node.alias("__node")).where("__node IS NOT NULL")
    rows = rows.join(comps, F.col("__node") == F.col("__n"), "left").withColumn("__class", F.coalesce("__comp", "__node"))
    best = rows.groupBy("__class").agg(F.min(F.struct(F.col("__id").isNull().alias("z"), F.col("__id").alias("id"), F.col("__node").alias("node"))).alias("best"))
    best = best.select(F.col("best.id").alias("__bid"), F.col("best.node").alias("__bnode"))
    stays = docs.withColumn("__node", node).join(best, F.col("__node").eqNullSafe(F.col("__bnode")) & F.col(id_col).eqNullSafe(F.col("__bid")), "left")
    stays = stays.where(F.col("__node").isNull() | F.col("__bnode").isNotNull())
    alone = stays.where("__node IS NULL").select(*docs.columns)
    return restored(stays.where("__node IS NOT NULL").dropDuplicates([id_col, "__node"]).select(*docs.columns).unionByName(alone), names)
