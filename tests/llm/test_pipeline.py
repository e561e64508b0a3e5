"""The pipeline against plain versions of its stages: words, counters and all pairs."""
import collections
import math
import os
import re

import numpy as np
import pytest
import sentencepiece
from test_text_operators import base_counts, decontamination, drop_lines

import corpus_pipeline
from stratacohort.llm import common, quality_rules, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def quality(rows):
    """Rows that the fitted rules keep."""
    share = lambda part, whole, good, bad: 0 if not whole else 1 if 100 * part <= good * whole else -1 if 100 * part >= bad * whole else 0
    votes, failed = [], []
    for _, text in rows:
        words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
        n, _, symbols, dup_lines, repeats = base_counts(text)
        plain = sum(bool(re.fullmatch(r"(?:[^\W_]|['\u2019-])+[.,;:!?]*", w)) for w in words)
        distinct = sum(len(set(words[i : i + 64])) for i in range(0, n, 64))
        capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", text or ""))
        marks = sum((text or "").count(c) for c in ".,;:!?")
        votes.append((-1 if n < 20 else 1 if n >= 40 else 0, share(symbols, n, 5, 25), -share(plain, n, 70, 90), share(repeats, n, 10, 30), -share(distinct, n, 45, 65), share(dup_lines, len(lines), 10, 50), share(capitals, n, 5, 25), share(marks, n, 40, 80)))
        failed.append(n < 20 or 100 * repeats > 30 * n)
    v = np.array(votes)
    good = np.where((v == -1).any(1), 1 - quality_rules.PRIOR, quality_rules.PRIOR)
    for _ in range(quality_rules.ROUNDS):
        prior = good.mean()
        rate = lambda w: np.clip(((v == -1) * w[:, None]).sum(0) / np.maximum(((v != 0) * w[:, None]).sum(0), 1e-300), quality_rules.LEAST, quality_rules.MOST)
        a, b = rate(good), rate(1 - good)
        good = 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + np.where(v == -1, np.log(a / b), np.where(v == 1, np.log((1 - a) / (1 - b)), 0)).sum(1))))
    return [r for r, bad, p in zip(rows, failed, good) if not bad and p >= 0.5]


def lines(rows):
    hot = collections.Counter(k for _, t in rows for k in {x.strip(common.WHITE).translate(str.maketrans(common.UPPER, common.LOWER)) for x in t.split("\n")} if k)
    out = [(i, "\n".join(x for x in t.split("\n") if hot[x.strip(common.WHITE).translate(str.maketrans(common.UPPER, common.LOWER))] < 10)) for i, t in rows]
    assert sorted(repr((i, t)) for i, t in out) == sorted(repr((i, t)) for i, _, _, t in map(eval, drop_lines(rows, 10)))
    return out


def near(rows):
    """The smallest id of each class of texts whose weighted shingles agree in four fifths, by all pairs."""
    texts = [WORDS.findall(t.translate(str.maketrans(common.UPPER, common.LOWER))) for _, t in rows]
    df, n = collections.Counter(w for x in texts for w in set(x)), sum(map(bool, texts))
    idf = {w: round(64 * (1 + math.log(n / k) / math.log(4096))) if 4096 * k >= n else 128 for w, k in df.items()}
    shingles = [collections.Counter(tuple(x[k : k + min(5, len(x))]) for k in range(len(x) - min(5, len(x)) + 1)) for x in texts]
    shingles = [{s: c * sum(idf[w] for w in s) for s, c in x.items()} for x in shingles]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and texts[a] and texts[b]:
                low = sum(min(w, shingles[b].get(s, 0)) for s, w in shingles[a].items())
                if 100 * low >= 80 * (sum(shingles[a].values()) + sum(shingles[b].values()) - low):
                    group = [group[b] if g == group[a] else g for g in group]
    best = {}
    for (i, _), g in zip(rows, group):
        best[g] = min(best.get(g, i), i)
    return [r for r, g in zip(rows, group) if best[g] == r[0]]


def clean(rows, items):
    bad = {i for i, n, hit, _ in map(eval, decontamination(rows, items)) if hit and 20 * hit >= n}
    return [r for r in rows if r[0] not in bad]


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [(r["item_id"], r["text"]) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    pieces = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_MODEL)
    plain = [quality, lines, near, lambda rows: clean(rows, items), lambda rows: [(i, pieces.encode(t)) for i, t in rows]]
    columns = docs.columns
    for (name, stage), by_hand in zip(corpus_pipeline.STAGES, plain):
        before, rows = len(rows), by_hand(rows)
        docs = stage(spark, docs, sf_dir)
        path = common.new_path(spark, f"test-{name}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == (columns if name != "sentencepiece" else [c for c in columns if c != "text"] + ["ids", "n_tokens", "round_trip"])
        assert sorted((r["doc_id"], r["ids" if name == "sentencepiece" else "text"]) for r in docs.collect()) == sorted(rows), name
        assert name == "sentencepiece" or docs.where("n_chars <> length(text)").isEmpty()
        assert len(rows) < before if name in ("quality_rules", "near_dedup", "decontaminate") else len(rows) == before
    assert docs.where("NOT round_trip").isEmpty()
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["ids"]) for r in whole.collect()) == sorted(rows)


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, no rows at all, columns with the operators' own names."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string, __id int, key string, spans string, ids string"
    text = " ".join(f"{a}{b}" for a in ("stone", "river", "mild", "candle", "orchard") for b in ("", "s", "ly", "ing", "ed", "er", "est", "ness", "ful", "less")) + "."
    rows = [(i, t, "en", "s", len(t or ""), "w", 1, "k", "sp", "i") for i, t in [(None, text + " one"), (None, None), (1, None), (2, ""), (3, text), (3, text), (4, text[:200] + " other"), (None, "x " * 50_000), (5, "short")]]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = common.written(stage(spark, docs, str(tmp_path)), "odd")
            assert docs.columns[:1] == ["doc_id"] and set(docs.columns) >= {"doc_id", "lang", "source", "n_chars", "n_words", "__id", "key", "spans"}
        assert {r["doc_id"] for r in docs.collect()} == ({3, 4} if given else set())
        for name, stage in corpus_pipeline.STAGES[1:]:  # also without the stage that rejects most of them
            assert stage(spark, spark.createDataFrame(given, schema), str(tmp_path)).count() == (len(given) - (2 if name == "near_dedup" and given else 0))


def test_only_the_result_stays(spark, sf_dir, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf_dir)
    assert [x.rsplit("-", 1)[0] for x in os.listdir(tmp_path)] == ["stage-sentencepiece"] and out.count() > 0


@pytest.mark.parametrize("name", ["doc_id", "n_chars"])
def test_documents_are_whole(spark, name):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    assert docs.where(f"{name} IS NULL").isEmpty()
