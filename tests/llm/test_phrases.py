"""Collocations against brute force, with sketches so small that rare phrases come through."""
import collections
import random
import re

import pytest

from stratacohort.llm import phrases

SCHEMA = "lang string, text string, n int, phrase string"


def counts_of(rows, most):
    out = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    out[lang if lang is not None else "und"][tuple(words[i : i + n])] += 1
    return out


def brute(rows, most, least, top, share):
    got = []
    for lang, f in counts_of(rows, most).items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        found = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        gone = set()
        for q, c in found.items():
            for i in range(len(q)):
                for j in range(i + 2, len(q) + 1):
                    if j - i < len(q) and 100 * c >= share * f[q[i:j]]:
                        gone.add(q[i:j])
        scored = []
        for p, a in found.items():
            if p not in gone:
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            got.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(got)


def rows_of(got):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect())


def corpus(seed, n=300):
    rnd = random.Random(seed)
    words = ["the", "Of", "é", "É", " x", "a\x00b", "new", "york", "city", "hall", "x-y", "\x1c", "İ"] + [f"w{i}" for i in range(40)]
    phrase = ["New York city hall", "of the", "é É", "w1 w1 w1 w1 w1", "new york"]
    text = lambda: "".join(rnd.choice([rnd.choice(words), rnd.choice(phrase)]) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]) for _ in range(rnd.randint(0, 60)))
    rows = [(rnd.choice(["en", "en", "en", "fr", None, "und", ""]), text()) for _ in range(n)]
    return rows + [("en", None), (None, None), ("de", ""), ("de", "  \n.,"), ("en", rows[0][1]), ("en", rows[0][1])]


@pytest.mark.parametrize("bits, segment", [(25, 4 << 20), (6, 100), (12, 1)])
def test_against_brute_force(spark, monkeypatch, bits, segment):
    """Whatever the sketch lets through and wherever segments end, the result is exact."""
    if bits < 25:
        monkeypatch.setattr(phrases, "BITS", bits)
        monkeypatch.setattr(phrases, "SLICES", 4)
        monkeypatch.setattr(phrases, "SEGMENT", segment)
    rows = corpus(bits)
    frame = spark.createDataFrame([(lang, text, 1, "clash") for lang, text in rows], SCHEMA).repartition(5)
    for most, least, top, share in ((4, 30, 2000, 80), (4, 5, 7, 80), (3, 2, 50, 100), (2, 300, 3, 80)):
        assert rows_of(phrases.collocations(frame, most, least, top, share)) == brute(rows, most, least, top, share)


def test_counts_are_exact_and_nothing_frequent_is_lost(spark):
    rows = corpus(9)
    frame = spark.createDataFrame([(lang, text, 1, "") for lang, text in rows], SCHEMA).repartition(3)
    got = {(r["lang"], r["phrase"]): r["f"] for r in phrases.frequent(frame, 4, 10).where("n > 0").collect()}
    assert got == {(lang, " ".join(p)): c for lang, f in counts_of(rows, 4).items() for p, c in f.items() if c >= 10}


def test_sketches_prune_and_stay_small(spark):
    """Phrases below the threshold don't reach the exact pass, and what goes to the driver is of one size."""
    import numpy as np

    rnd = random.Random(4)
    rows = [("en", " ".join(f"r{rnd.randint(0, 10**7)}" for _ in range(200)) + " so it goes") for _ in range(100)]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    bits = phrases.sketch(frame, 4, 30)
    assert bits.shape == (2, (1 << 25) // 8) and np.unpackbits(bits).sum() == 2 * 6  # so, it, goes and three of two and three words


def test_edge_cases(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    one = spark.createDataFrame([("en", "a b " * 40)], "lang string, text string")
    assert rows_of(phrases.collocations(one)) == brute([("en", "a b " * 40)], 4, 30, 2000, 80)
    long = [("en", "x " * 300_000 + "end"), ("fr", "word" * 500_000), ("es", " " * 1_000_000 + "." * 100_000)]
    got = phrases.collocations(spark.createDataFrame(long, "lang string, text string"))
    assert [(r["lang"], r["a"], r["l"], r["n"]) for r in got.collect()] == [("en", 299_997, 300_000, 300_001)]


def test_big_numbers(spark, monkeypatch):
    """Products pass 64 bits: scores and shares are still exact."""
    big = 3 * 10**13
    counts = [("en", 0, "", 9 * 10**17), ("en", 1, "a", big + 7), ("en", 1, "b", big + 9), ("en", 2, "a b", big), ("en", 1, "c", big), ("en", 2, "b c", big // 2), ("en", 3, "a b c", 8 * big // 10 - 1)]
    frame = spark.createDataFrame(counts, "lang string, n int, phrase string, f long")
    monkeypatch.setattr(phrases, "frequent", lambda *a: frame)
    got = {r["phrase"]: (r["score"], r["n"]) for r in phrases.collocations(frame).collect()}
    assert got["a b"] == (2_000_000 * big // (2 * big + 16), 9 * 10**17) and "b c" not in got
