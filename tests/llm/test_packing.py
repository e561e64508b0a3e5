"""Packing: tokens against the library on whole texts, places without gaps, and the search against exhaustive packings."""
import collections
import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacohort.llm import packing, queries

SCHEMA = "doc_id long, text string, piece string, sequence_id int, lang string"


def ids_of(texts, special=0):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.WORD_MODEL)
    return [[*e.ids, special] for e in model.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_are_the_librarys(spark, sf_dir):
    """Words apart or whole texts: the ids of every text, odd ones among them."""
    odd = ["", " ", "\n\n", "a", "A,b.C;d", "it's. IT'S!", "x́. ́.", "é.", "İ. ΑΣ. ß.", "a<|endoftext|>b <|endoftext|>. c", "1,2.3", "a  b c\td\re", "日本。語.", "!?.,", "word" * 40 + ".", "\x00.a\x1c.b", "don't.... stop", "a)." * 3, "_.a_.", "５.", "à.b", "½.", "²."]
    texts = odd + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {i: x for i, x in enumerate(ids_of(texts))}
    for apart in (True, False):
        got = collections.defaultdict(list)
        for r in packing.pieces(rows, ["doc_id"], queries.WORD_MODEL, 2048, apart=apart).orderBy("doc_id", "piece").collect():
            assert r["start"] == len(got[r["doc_id"]]) == 2048 * r["piece"]
            got[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()
            assert r["length"] * 4 == len(r["ids"]) <= 8192
        assert got == want


def test_the_words_cache_forgets(monkeypatch):
    """Words are right whatever the cache holds, and long ones are not kept."""
    with open(queries.WORD_MODEL, encoding="utf-8") as f:
        model = f.read()
    import pyarrow as pa

    monkeypatch.setattr(packing, "WORDS", 3)
    encode, rnd = packing._encoder(model, True), random.Random(1)
    for _ in range(5):
        texts = [" ".join(rnd.choice("Ab, cd. efg hi! " + "q" * 70 + " xyz").strip() + rnd.choice(["", ".", "?"]) for _ in range(rnd.randint(0, 30))) for _ in range(20)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(pa.array(texts, pa.string()))] == [x[:-1] for x in ids_of(texts)]


def check(rows, got, capacity):
    """Every row once, in sequences that are full to their end without gaps and overlaps."""
    held = collections.defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert collections.Counter(r["key"] for r in got) == collections.Counter(k for k, _ in rows)
    return len(held)


@pytest.mark.parametrize("parts", [1, 7])
def test_packing(spark, parts):
    """One length holds a third of the rows; keys are null, repeated, or named like the output."""
    rnd = random.Random(parts)
    rows = [(rnd.choice([None, k, 5]), 37 if k % 3 == 0 else rnd.randint(1, 60)) for k in range(1200)]
    frame = spark.createDataFrame(rows, "key long, length int").repartition(parts)
    n, counts = check(rows, packing.pack(frame, capacity=100).collect(), 100), collections.Counter(x for _, x in rows)
    assert packing.least_bins(counts, 100) <= n <= sum(packing.best_fit(counts, 100).values()) and n <= 1.05 * sum(x for _, x in rows) / 100 + 1
    assert packing.pack(frame.limit(0), capacity=100).count() == 0
    for bad in (0, 101):
        with pytest.raises(Exception, match="more than the capacity"):
            packing.pack(spark.createDataFrame([(1, bad)], "key long, length int"), capacity=100).collect()
    extra = packing.pack(spark.createDataFrame([(1, 5, 2, 3)], "__n int, length int, __part int, hi int"), capacity=100)
    assert extra.columns == ["__n", "length", "__part", "hi", "sequence_id", "offset"] and extra.head()[:4] == (1, 5, 2, 3)


def fewest(lengths, capacity):
    """By trying every bin for every document."""
    best = [len(lengths)]

    def put(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= lengths[k]}.values():
            put(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]])
        put(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    put(0, [])
    return best[0]


def squares(bins):
    return sum(n * sum(p) ** 2 for p, n in bins.items())


def test_the_search_against_all_packings():
    rnd, gained = random.Random(2), 0
    for trial in range(300):
        capacity = rnd.choice([10, 20, 31])
        lengths = [rnd.randint(1 if trial % 2 else capacity // 4, capacity * 3 // 4) for _ in range(rnd.randint(0, 9))]
        counts = collections.Counter(lengths)
        begin, bound = packing.best_fit(counts, capacity), packing.least_bins(counts, capacity)
        found = packing.search(begin, capacity, bound)
        items = collections.Counter(itertools.chain.from_iterable(p * n for p, n in found.items()))
        assert items == counts and all(sum(p) <= capacity for p in found)
        n, best = sum(found.values()), fewest(lengths, capacity)
        assert bound <= best <= n <= sum(begin.values()) and n <= best + 1
        assert squares(found) >= squares(begin)
        gained += n < sum(begin.values())


@pytest.mark.parametrize("bins, capacity, want", [
    ([(6, 6), (4, 4, 4), (4, 4)], 16, 2),  # moves
    ([(7, 4), (6, 5), (3, 3, 3)], 16, 2),
    ([(9, 2), (8, 3), (5, 5)], 16, 2),  # one for one
    ([(10, 3), (10, 3), (2, 2, 2)], 16, 2),
    ([(8, 4), (7, 5), (3, 3, 2)], 16, 2),  # two for one
])
def test_exchanges_empty_bins(bins, capacity, want):
    begin = collections.Counter(tuple(sorted(p, reverse=True)) for p in bins)
    for times in (1, 1000):  # patterns, not bins, are exchanged
        many = collections.Counter({p: n * times for p, n in begin.items()})
        counts = collections.Counter()
        for p, n in many.items():
            for x in p:
                counts[x] += n
        found = packing.search(many, capacity, packing.least_bins(counts, capacity))
        assert sum(found.values()) == want * times


def test_query(spark, sf_dir, tmp_path):
    """The query's digests over the whole table, and its few sequences."""
    got = queries.op11_packing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = collections.Counter()
    for (doc_id, _), ids in zip(docs, ids_of([r["text"] for r in docs])):
        for k in range(0, len(ids), 2048):
            piece = np.array(ids[k : k + 2048], "<u4")
            want[doc_id, k // 2048, k, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    total = sum(k[3] * n for k, n in want.items())
    n = check([((k[0], k[1]), k[3]) for k, c in want.items() for _ in range(c)], [{**r.asDict(), "key": (r["doc_id"], r["piece"])} for r in got], 2048)
    assert n <= -(-total // 2048) + 1


def test_edge_cases(spark):
    rows = [(1, None, "x", 9, "y"), (None, "a b", "x", 9, "y"), (None, "a b", "x", 9, "y"), (2, "", None, None, None)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = packing.pieces(frame, ["doc_id", "lang"], queries.WORD_MODEL, 4, apart=True)
    assert sorted((str(r["doc_id"]), r["length"]) for r in got.collect()) == [("1", 1), ("2", 1), ("None", 3), ("None", 3)]
    assert packing.pieces(frame.limit(0), ["doc_id"], queries.WORD_MODEL, 4).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000)], "doc_id long, text string")
    out = packing.pack(packing.pieces(long, ["doc_id"], queries.WORD_MODEL, 2048, apart=True).drop("ids"))
    assert out.agg(F.sum("length")).head()[0] == 200_001 and out.count() == out.select("sequence_id").distinct().count() == 98
    assert os.path.exists(queries.WORD_MODEL)
