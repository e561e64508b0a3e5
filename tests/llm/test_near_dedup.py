"""Near-dedup against all pairs, and its parts."""
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratacohort.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, node string, comp int, class_id string, __node int, __key string"


def copies():
    """Originals, copies with a few words changed, chains of copies, odd rows."""
    rnd = random.Random(8)
    word = lambda: f"k{int(rnd.paretovariate(0.7)) % 4000}"
    rows, at = [], 0
    for group in range(25):
        text = [word() for _ in range(rnd.randint(6, 250))]
        for _ in range(rnd.randint(1, 7)):
            rows.append((at, " ".join(text)))
            at += 3
            if rnd.random() < 0.8 and len(text) > 20:
                for _ in range(rnd.randint(0, max(1, len(text) // 40))):
                    text[rnd.randrange(len(text))] = word()
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a  B"), (1005, "a c"), (None, rows[0][1]), (2, rows[5][1].upper()), (2, "other text of one id"), (1006, "z " * 40_000), (1007, "z " * 39_999), (1001, "")]
    return [(i, t, "clash", 1, "clash", 2, "clash") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(copies(), SCHEMA).repartition(3)


def brute(spark, rows):
    """Class of each row by all pairs of texts."""
    texts = sorted({t for _, t, *_ in rows if t and t.strip()})
    idf = nd.idf_table(spark.createDataFrame([(t,) for _, t, *_ in rows if t and t.strip()], "text string"))
    weigher = nd.Weigher(idf)
    shingles = [weigher.shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if nd.similar(shingles[a], shingles[b]):
                parent[find(a)] = find(b)
    group = {t: find(k) for k, t in enumerate(texts)}
    return [group.get(t, ("own", i)) for i, t, *_ in rows]


def test_classes_are_those_of_all_pairs(spark, docs):
    rows = copies()
    groups = brute(spark, rows)
    ids, sizes = {}, {}
    for (i, *_), g in zip(rows, groups):
        ids.setdefault(g, set()).add(i)
        sizes[g] = sizes.get(g, 0) + 1
    low = {g: min((i for i in x if i is not None), default=None) for g, x in ids.items()}
    want = sorted(repr((i, low[g], sizes[g])) for (i, *_), g in zip(rows, groups))
    out = nd.classes(docs)
    assert out.columns == ["doc_id", "node", "comp", "__node", "__key", "class_id", "n_docs"]
    assert sorted(repr((r["doc_id"], r["class_id"], r["n_docs"])) for r in out.collect()) == want
    assert len(low) < 45 < len(rows)


def test_one_document_of_each_class_stays(spark, docs):
    rows = copies()
    kept = nd.dedup(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert {r["class_id"] for r in got} == {"clash"}
    groups = brute(spark, rows)
    with_words = [g for (i, t, *_), g in zip(rows, groups) if t and t.strip()]
    assert len(got) == len(set(with_words)) + sum(1 for _, t, *_ in rows if not t or not t.strip())
    best = {}
    for (i, *_), g in zip(rows, groups):
        best[g] = min(best.get(g, (True, 0)), (i is None, i or 0))
    left = {(r["doc_id"], r["text"]) for r in got}
    assert {i for i, t in left if t and t.strip()} == {i for (null, i), g in ((b, g) for g, b in best.items()) if g in set(with_words)}


def test_blocks_of_large_buckets(spark, monkeypatch):
    """A chain of copies, each like the next only, in one bucket of many blocks."""
    rnd = random.Random(1)
    text = [f"c{rnd.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(90):
        rows.append((i, " ".join(text)))
        text[rnd.randrange(120)] = f"c{rnd.randint(0, 10**6)}"
    rows = [(i, t, "", 0, "", 0, "") for i, t in rows]
    monkeypatch.setattr(nd, "BLOCK", 8)
    got = nd.classes(spark.createDataFrame(rows, SCHEMA).repartition(4))
    groups = brute(spark, rows)
    assert got.select("class_id").distinct().count() == len(set(groups))


def test_large_components_meet_the_others(spark, monkeypatch):
    """Groups of copies larger than a block, chains between them, and strangers, in shared buckets: the classes are those of all pairs."""
    rnd = random.Random(6)
    word = lambda: f"g{rnd.randint(0, 10**6)}"
    core, rows = [word() for _ in range(150)], []
    for group in range(4):
        text = [*core[: 110 + 10 * group], *(word() for _ in range(40 - 10 * group))]
        for _ in range(12):
            rows.append((len(rows), " ".join([*text[:-2], word(), word()])))
    for _ in range(25):
        text = list(core)
        for _ in range(rnd.randint(3, 25)):
            text[rnd.randrange(150)] = word()
        rows.append((len(rows), " ".join(text)))
    rows = [(i, t, "", 0, "", 0, "") for i, t in rows]
    groups = brute(spark, rows)
    for block in (4, 9):
        monkeypatch.setattr(nd, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in nd.classes(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
        low = {}
        for (i, *_), g in zip(rows, groups):
            low[g] = min(low.get(g, i), i)
        assert got == {i: low[g] for (i, *_), g in zip(rows, groups)} and len(low) > 1


NO_IDF = nd.Idf(np.zeros(0, np.uint64), np.zeros(0))  # all words are rare: shingles weigh alike


def test_all_pairs_of_a_block_are_verified():
    """Near copies are linked however little their sketches agree; texts that are none are not."""
    rnd = random.Random(5)
    texts = [[f"w{rnd.randint(0, 30)}" for _ in range(rnd.choice((6, 60, 300)))] for _ in range(12)]
    texts += [[*x[:k], "other", *x[k + 1 :]] for x in texts for k in (0, 3)]
    texts = [" ".join(x) for x in texts]
    marks = lambda k: np.full(100, k, np.uint16).tobytes()  # noqa: E731  no sample agrees
    row = lambda k: {"bucket": 7, "band": 0, "i": 0, "j": 0, "node": bytes([k]) * 16, "comp": bytes([k]) * 16, "block": 0, "bands": [7], "marks": marks(k), "text": texts[k]}
    links = [(r["a"][0], r["b"][0]) for out in nd._close([pa.RecordBatch.from_pylist([row(k) for k in range(len(texts))])], NO_IDF) for r in out.to_pylist()]
    shingles = [nd.Weigher(NO_IDF).shingles(t) for t in texts]
    group = list(range(len(texts)))
    for want in ([(a, b) for a in group for b in range(a) if nd.similar(shingles[a], shingles[b])], links):
        join = list(range(len(texts)))
        for a, b in want:
            join = [join[a] if x == join[b] else x for x in join]
        group = [tuple(join[x] == join[y] for y in range(len(texts))) for x in range(len(texts))] if want is not links else group
    assert group == [tuple(join[x] == join[y] for y in range(len(texts))) for x in range(len(texts))] and len(links) >= 12


def test_long_texts_with_many_shingles():
    """Texts of 50,000 distinct shingles share rows of random numbers; their sketches estimate as those of short texts do."""
    rng = np.random.default_rng(9)
    sampler, off = nd.Sampler(), []
    for share in (0.5, 0.7, 0.8, 0.9, 0.97):
        hashes = np.sort(rng.integers(0, 1 << 63, 100_000, dtype=np.uint64) * np.uint64(2))
        weights = rng.integers(5 * 64, 5 * 128, 100_000)
        common = int(50_000 * 2 * share / (1 + share))
        order = rng.permutation(100_000)
        a, b = (np.sort(np.concatenate([order[:common], x])) for x in (order[common:50_000], order[50_000 : 100_000 - common]))
        x, y = (hashes[a], weights[a]), (hashes[b], weights[b])
        low, high = nd.shares(x, y)
        off.append((sampler(*x) == sampler(*y)).mean() - low / high)
    assert np.abs(off).max() < 0.15 and abs(np.mean(off)) < 0.05


def test_weights_of_words():
    """Common words by exact hash, all others 128; slots with several words are searched whole."""
    rng = np.random.default_rng(4)
    hashes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 3000, dtype=np.uint64), np.arange(50, dtype=np.uint64), np.full(1, 2**64 - 1, np.uint64)]))
    weights = rng.integers(64, 128, len(hashes))
    order = rng.permutation(len(hashes))
    asked = np.concatenate([hashes, hashes + np.uint64(1), rng.integers(0, 1 << 63, 100, dtype=np.uint64)])
    table = dict(zip(hashes.tolist(), weights.tolist()))
    assert nd.Idf(hashes[order], weights[order])(asked).tolist() == [table.get(x, 128) for x in asked.tolist()]


def test_components(spark):
    rnd = random.Random(6)
    n = 200
    links = [(a, a + 1) for a in range(0, 60)] + [(rnd.randint(70, n), rnd.randint(70, n)) for _ in range(90)] + [(65, x) for x in range(61, 70)] + [(3, 3)]
    raw = lambda x: x.to_bytes(16, "big")
    got = {int.from_bytes(r["node"], "big"): int.from_bytes(r["comp"], "big") for r in nd.components(spark.createDataFrame([(raw(a), raw(b)) for a, b in links], "a binary, b binary")).collect()}
    comp = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    assert got == comp


def test_sampling_estimates_weighted_similarity():
    rng = np.random.default_rng(3)
    sampler = nd.Sampler()
    agree, exact = [], []
    for _ in range(60):
        n = rng.integers(30, 400)
        hashes = np.sort(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        pick = lambda share: np.sort(rng.choice(2 * n, int(n * share), replace=False))
        common = pick(1.2)
        a, b = (np.union1d(common, pick(rng.random() * 0.4 + 0.01)) for _ in range(2))
        weights = rng.integers(64, 640, 2 * n)
        other = np.where(rng.random(2 * n) < 0.1, weights * 2, weights)
        x, y = (hashes[a], weights[a]), (hashes[b], other[b])
        low, high = nd.shares(x, y)
        agree.append((sampler(*x) == sampler(*y)).mean())
        exact.append(low / high)
    assert abs(np.mean(np.array(agree) - np.array(exact))) < 0.015
    assert np.abs(np.array(agree) - np.array(exact)).max() < 0.2


def test_weights(spark):
    rows = [("a b c d e f",), ("a b c d e",), ("a x",), (None,)]
    idf = nd.idf_table(spark.createDataFrame(rows, "text string").where("text IS NOT NULL"))
    weigher = nd.Weigher(idf)
    one = lambda w: int(idf(weigher.word_hashes(weigher.words(w)))[0])
    weight = lambda share: round(64 * (1 + np.log(1 / share) / np.log(nd.RARE)))
    assert one("a") == 64 and one("b") == weight(2 / 3) and one("x") == weight(1 / 3) and one("never") == 128
    hashes, weights = weigher.shingles("A b c d e f")
    assert len(hashes) == 2 and sorted(weights) == sorted([one("a") + 4 * one("b"), 4 * one("b") + one("f")])
    assert weigher.shingles("a b a b a b a b a b")[1].sum() == 3 * (3 * one("a") + 2 * one("b")) + 3 * (2 * one("a") + 3 * one("b"))
    assert len(weigher.shingles("a b")[0]) == 1 and len(weigher.shingles("  ")[0]) == 0


def test_rare_words_need_no_table(spark, monkeypatch):
    """Counts are exact over partitions and pieces; words below the bound are left out and weigh most."""
    monkeypatch.setattr(nd, "RARE", 4)
    rows = [(" ".join(f"w{k}" for k in range(20) if i % (k + 1) == 0) + f" only{i}",) for i in range(40)]
    idf = nd.idf_table(spark.createDataFrame(rows, "text string").repartition(5))
    weigher = nd.Weigher(idf)
    one = lambda w: int(idf(weigher.word_hashes(weigher.words(w)))[0])
    counts = [sum(i % (k + 1) == 0 for i in range(40)) for k in range(20)]
    assert [one(f"w{k}") for k in range(20)] == [round(64 * (1 + np.log(40 / n) / np.log(4))) if 4 * n >= 40 else 128 for n in counts]
    assert len(idf.hashes) == sum(4 * n >= 40 for n in counts) and one("only3") == 128
    small = [b for b in nd._count_words([pa.record_batch([pa.array(["a b", "b c", "b"])], names=["text"])], most=2)]
    assert sum(n for b in small for w, n in zip(*b.to_pydict().values()) if w is not None) == 5


def test_nothing_is_left_behind(monkeypatch, tmp_path, docs):
    """Only the tables that the result reads stay."""
    import os

    from stratacohort.llm import common

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = nd.classes(docs)
    assert {x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)} == {"near-classes", "classes"} and out.count() == len(copies())


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from stratacohort.llm.common import shared_dir

    context = SimpleNamespace(master="spark://host:7077", getConf=dict, getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf={})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nd.classes(none).count() == 0 and nd.dedup(none).count() == 0
    assert nd.classes(spark.createDataFrame([(1, None, "", 0, "", 0, "")], SCHEMA)).head()["class_id"] == 1


def test_planted_copies_are_found(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("length(text) > 1500").limit(20)
    changed = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), F.regexp_replace("text", r"^(\S+) (\S+)", "changed $2").alias("text"))
    got = {r["doc_id"]: r["class_id"] for r in nd.classes(docs.unionByName(changed).unionByName(docs.withColumn("doc_id", F.col("doc_id") + 20_000))).collect()}
    for i in [r["doc_id"] for r in docs.collect()]:
        assert got[i] == got[i + 10_000] == got[i + 20_000] <= i
