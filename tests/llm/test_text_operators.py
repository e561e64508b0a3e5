"""Quality rules, line dedup, decontamination, substring dedup: against brute force, and on odd rows."""
import collections
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from stratacohort.llm import decontaminate, line_dedup, quality_rules, substring_dedup
from stratacohort.llm.common import LOWER, UPPER, WHITE, ascii_lower, new_path

SCHEMA = "doc_id long, text string, n_words string, key int"  # the last two clash with names that operators use
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box quietly near a frozen river bank"


def odd_rows():
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["Éa", "#x", "|", "FOO", "bar!!", "日本"]
    rows = [(i, "\n".join(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    rows += [(100, None), (None, "a b c"), (None, None), (101, ""), (102, " \t\n\n "), (103, "x " * 30_000), (7, rows[7][1]), (7, "another text under one id"), (104, "same\nsame\n\nSame "), (104, "same\nsame\n\nSame ")]
    rows += [(200 + i, f"{'Common Line' if i % 2 else ' common line '}\n{i} y") for i in range(12)]
    return [(i, t, "clash", 5) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def by_row(rows, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in rows)))


# Quality rules


def base_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = collections.defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {p for places in seen.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts(docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = quality_rules.judge(docs).collect()
    want = sorted(repr((i, *base_counts(t))) for i, t, *_ in odd_rows())
    assert by_row(got, "doc_id", *names) == want
    for r in got:
        failed = r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["p_good"] >= 0.5)


def test_rejection_keeps_all_columns(docs):
    kept = quality_rules.reject(docs)
    assert kept.columns == docs.columns
    verdicts = {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect() if r["doc_id"] not in (None, 7)}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] != 7} == {i for i, k in verdicts.items() if k}
    assert {r["n_words"] for r in kept.collect()} <= {"clash"}


def test_expectation_maximisation(spark):
    """Two rules that agree on planted bad rows get a low posterior there, and one that votes at random does not matter."""
    rnd = random.Random(2)
    counts = collections.Counter()
    for _ in range(4000):
        good = rnd.random() < 0.8
        flip = lambda p: -1 if rnd.random() < p else 1
        votes = (flip(0.03 if good else 0.9), flip(0.05 if good else 0.85), flip(0.3), 0 if rnd.random() < 0.5 else flip(0.02 if good else 0.7))
        counts[votes] += 1
    rows = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    found = quality_rules.fit(rows, 4).collect()
    m = found[0]["m"]
    assert m["prior"] == pytest.approx(0.8, abs=0.03)
    assert m["good"][0] == pytest.approx(0.03, abs=0.02) and m["bad"][0] == pytest.approx(0.9, abs=0.06)
    assert abs(m["good"][2] - m["bad"][2]) < 0.08
    p = {tuple(r["votes"]): r["p_good"] for r in found}
    assert p[(-1, -1, 1, 0)] < 0.1 < 0.9 < p[(1, 1, -1, 0)]


def test_labelled_quality(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = quality_rules.judge(docs, carry=["doc_id"]).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good, bad = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


def test_the_fit_ends_by_itself(spark):
    """More rounds change nothing; fewer are not enough."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    patterns = quality_rules.judge(docs).groupBy("votes").agg(F.count("*").alias("n"))
    n = len(quality_rules.RULES)
    found, more, few = (quality_rules.fit(patterns, n, rounds).collect() for rounds in (quality_rules.ROUNDS, 500, 1))
    assert 1 < found[0]["rounds"] < quality_rules.ROUNDS and few[0]["rounds"] == 1
    assert found[0]["converged"] and not few[0]["converged"]
    p = lambda rows: {tuple(r["votes"]): r["p_good"] for r in rows}
    assert p(found) == p(more) != p(few)


def test_rules_do_not_depend_on_length(spark):
    """Plain prose gets no bad vote, however long; a fault gets its votes at any length."""
    rnd = random.Random(7)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in ("n", "r", "st", "l")]
    prose = lambda n: " ".join(rnd.choice(words) + (rnd.random() < 0.1) * "." for _ in range(n))
    rows = [(n, prose(n)) for n in (50, 500, 30_000)] + [(-n, " ".join(w + "###" for w in prose(n).split())) for n in (50, 30_000)]
    for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        votes = dict(zip(quality_rules.RULES, r["votes"]))
        assert {x for x, v in votes.items() if v < 0} == ({"symbols", "plain"} if r["doc_id"] < 0 else set())


# Line dedup


def line_key(line):
    return line.strip(WHITE).translate(str.maketrans(UPPER, LOWER))


def drop_lines(rows, min_docs):
    texts = [(i, (t or "").split("\n")) for i, t, *_ in rows]
    counts = collections.Counter(k for _, lines in texts for k in {line_key(x) for x in lines} if k)
    out = []
    for i, lines in texts:
        kept = [x for x in lines if counts[line_key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


@pytest.mark.parametrize("min_docs", [2, 10])
def test_line_dedup(docs, min_docs):
    got = line_dedup.dedup(docs, min_docs).collect()
    assert by_row(got, "doc_id", "n_lines", "n_dropped", "kept_text") == drop_lines(odd_rows(), min_docs)
    assert {(r["n_words"], r["key"]) for r in got} == {("clash", 5)}


def batch_of(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_levels_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, new_path(spark, "runs"), min_docs=3, fanout=2)
    for i in range(5):
        runs.add(line_dedup.with_keys(batch_of(spark, f"all\nonly {i}\nAll")), str(i))
    assert [len(x) for x in runs.state["levels"]] == [1, 0, 1]  # 5 in binary
    assert runs.hot().count() == 1
    rows = [{bytes(r["key"]): r["total"] for r in runs.table(run).collect()} for run in runs.runs]
    key = lambda x: hashlib.md5(x.encode()).digest()
    assert rows[0] == {key("only 4"): 1}  # "all" is settled: the last batch's merge-anti-join drops it
    assert rows[1] == {key("all"): 3} | {key(f"only {i}"): 1 for i in range(4)}


def test_runs_are_merged_without_a_shuffle(spark):
    """The batch's counts are shuffled once; the runs are read in order, bucket by bucket."""
    runs = line_dedup.LineRuns(spark, new_path(spark, "runs"), min_docs=3)
    for i in range(3):
        runs.add(line_dedup.with_keys(batch_of(spark, *[f"line {k % 7} {i}" for k in range(50)])), str(i))
    counts = line_dedup.with_keys(batch_of(spark, "x")).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    plan = runs.added(counts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 3 and plan.count("Exchange") == 1 and plan.count("+- Sort ") + plan.count(":- Sort ") == 1 and plan.count("Bucketed: true") == 3
    merged = runs.compacted(0, "a_level")
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString() and merged.count() == merged.select("key").distinct().count()


def test_batches_see_earlier_ones(spark):
    runs = line_dedup.LineRuns(spark, new_path(spark, "runs"))
    kept = lambda batch, i: sorted(r["kept_text"] for r in line_dedup.dedup_batch(runs, batch, i).collect())
    assert kept(batch_of(spark, "a\nb", None, "", "b2\n \n"), "0") == ["", "", "a\nb", "b2\n \n"]
    assert kept(batch_of(spark, "A \nc"), "1") == ["c"]
    assert kept(batch_of(spark, "d\nd", "d ", "e"), "2") == ["", "", "e"]
    assert kept(batch_of(spark), "3") == []


def test_replay_and_restart(spark):
    """A batch given twice counts once, also by runs that are opened again; what is not in the manifest is not there."""
    path = new_path(spark, "runs")
    first = line_dedup.LineRuns(spark, path)
    kept = lambda runs, batch, i: [r["kept_text"] for r in line_dedup.dedup_batch(runs, batch, i).collect()]
    one = batch_of(spark, "a\nb")
    assert kept(first, one, "monday") == kept(first, one, "monday") == ["a\nb"]
    first._write(spark.createDataFrame([(b"x" * 16, 9)], "key binary, total long"), 0)  # as by a driver that was lost before the manifest
    first.close()
    again = line_dedup.LineRuns(spark, path)
    assert again.state == first.state and kept(again, one, "monday") == ["a\nb"] and again.hot().count() == 0
    assert kept(again, batch_of(spark, "b\nc"), "tuesday") == ["c"] and kept(again, one, "monday") == ["a"]
    with pytest.raises(ValueError, match="up to 2"):
        line_dedup.LineRuns(spark, path, min_docs=5)


def test_many_hot_lines_in_one_document(spark):
    """Places that go are cut out in linear time."""
    many = "\n".join(f"hot {i}" for i in range(30_000))
    rows = spark.createDataFrame([(1, many), (2, "first\n" + many + "\nmiddle\n" + many + "\nlast")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in line_dedup.dedup(rows, 2).collect()}
    assert got[1]["kept_text"] == "" and got[1]["n_dropped"] == 30_000
    assert got[2]["kept_text"] == "first\nmiddle\nlast" and got[2]["n_dropped"] == 60_000 and time.perf_counter() - began < 60


def test_only_ascii_capitals_are_lowered(spark):
    texts = ["ABC abc", "Été ÉTÉ", "ΑΣ As ς", "İI ı", "Ⅷ Ⓐ ǅ", "", "日本 ABC", "ẞß SS", "𐐀A"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ascii_lower(F.col("t")).alias("low")).collect()
    assert all(r["low"] == r["t"].translate(str.maketrans(UPPER, LOWER)) for r in rows)


# Decontamination


def decontamination(rows, items, size=13):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans(UPPER, LOWER)))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = []
    for i, text, *_ in rows:
        w = words(text)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), ",".join(sorted(found))))
    return sorted(map(repr, out))


def contaminated_rows():
    rows = odd_rows()
    rows += [(300, f"before, {PASSAGE.upper()}! after", "", 1), (301, "lorem " * 400 + PASSAGE, "", 1), (302, PASSAGE.replace("dog", "cat"), "", 1), (303, "x Short-Item y", "", 1), (304, (PASSAGE + " ") * 3, "", 1)]
    return rows


ITEMS = [(1, PASSAGE), (2, "short item"), (3, PASSAGE + " and more words follow here"), (10, ""), (11, None), (12, "Éa Éa"), (2, "x x")]


@pytest.mark.parametrize(("max_bytes", "bits"), [(decontaminate.MAX_BYTES, 27), (0, 27), (0, 7)])
def test_decontamination(spark, max_bytes, bits):
    """By broadcast windows, by a filter and a join, and with a filter so small that it lets nearly all pass."""
    rows = contaminated_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, items, max_bytes=max_bytes, filter_bits=bits)
    assert got.columns == ["doc_id", "text", "key", "n_words", "spans", "items", "n_hit"] and {r["key"] for r in got.collect()} == {5, 1}
    got = got.select("doc_id", "n_words", "n_hit", F.array_join(F.array_sort("items"), ",").alias("names")).collect()
    assert by_row(got, "doc_id", "n_words", "n_hit", "names") == decontamination(rows, ITEMS)


def test_removal_of_documents_and_spans(spark):
    docs = spark.createDataFrame(contaminated_rows(), SCHEMA)
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    left = decontaminate.remove_documents(docs, items)
    assert left.columns == docs.columns and {r["n_words"] for r in left.where("doc_id < 100").collect()} == {"clash"}
    ids = {r["doc_id"] for r in left.collect()}
    assert not {300, 304} & ids and {301, 302, 303} <= ids  # 301 has hits, but under five percent
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, items).collect()}
    assert cut[300] == "before, ! after" and cut[301] == "lorem " * 400 and cut[302] == PASSAGE.replace("dog", "cat") and cut[100] is None
    assert cut[304].split() == []


@pytest.mark.parametrize("max_bytes", [decontaminate.MAX_BYTES, 0])
def test_documents_are_scanned_once(spark, monkeypatch, max_bytes):
    """Whatever the benchmark's size: one pass of the scanning function over the documents' file, and spans united as by hand."""
    path = new_path(spark, "docs")
    spark.createDataFrame(contaminated_rows(), SCHEMA).write.parquet(path)
    scans = []
    plain = decontaminate.map_arrow
    monkeypatch.setattr(decontaminate, "map_arrow", lambda df, f, schema: (scans.append(path in str(df.inputFiles())), plain(df, f, schema))[1])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(spark.read.parquet(path), items, max_bytes=max_bytes)
    assert sum(scans) == 1
    spans = {r["doc_id"]: [(x["a"], x["b"]) for x in r["spans"]] for r in got.collect()}
    assert spans[300] == [(1, 20)] and spans[304] == [(0, 57)] and spans[302] != spans[303] == [(1, 3)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count(path) <= (max_bytes > 0)  # beyond one broadcast, the scan's result is read, not the documents


def test_short_texts_in_long_chunks():
    powers = decontaminate.Powers()
    words = decontaminate.Words([b"", b"A b", b"--", "é1-c".encode(), b"d"], powers)
    assert words.n.tolist() == [0, 2, 0, 2, 1]
    assert [words.bytes_of(i, 2).decode() for i in words.windows(2)[0]] == ["a b", "é1 c"]


# Substring dedup


def sentences_by_hand(text):
    """Sentences of a text by one regular expression: up to ., ! or ? before white space, or to the line's end, with the white space after it."""
    found = re.findall(r"\s*\S(?:[^\n]*?[.!?](?=\s)|[^\n]*(?=\n)|.*)(?:\s+|$)", text, re.S)
    out = []
    for x in found:  # white space before a sentence belongs to the one before, but for the text's beginning
        lead = re.match(r"\s*", x).group() if out else ""
        if lead:
            out[-1] += lead
        out.append(x[len(lead) :])
    return out


def substring_brute(rows, span=3):
    rows = [(i if i is not None else -1, t) for i, t, *_ in rows]
    cut = {t: sentences_by_hand(t or "") for _, t in rows}
    assert all("".join(x) == (t or "") or not (t or "").strip() for t, x in cut.items())
    places = collections.defaultdict(set)
    for i, t in rows:
        for at in range(len(cut[t]) - span + 1):
            places[tuple(tuple(x.lower().split()) for x in cut[t][at : at + span])].add((i, hashlib.md5((t or "").encode()).digest(), at, t))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, _, at, t in sorted(found)[1:]:
            gone[i, t] |= set(range(at, at + span))
    return sorted(repr((i, len(cut[t]), len(gone[i, t]), t if not gone[i, t] else "".join(x for k, x in enumerate(cut[t]) if k not in gone[i, t]))) for i, t in rows)


def test_substring_dedup(spark):
    rnd = random.Random(3)
    sentence = lambda: " ".join(f"t{rnd.randint(0, 5000)}" for _ in range(rnd.randint(1, 30))).capitalize() + rnd.choice([". ", "! ", ".\n", "? "])
    shared = ["".join(sentence() for _ in range(6)) for _ in range(3)]
    rows = [(i, "".join(sentence() for _ in range(4)) + (rnd.choice(shared) if i % 3 else "") + "".join(sentence() for _ in range(3))) for i in range(40)]
    rows += [(50, None), (None, "Null id. " + shared[0]), (51, ""), (52, "  \n "), (53, shared[1] + shared[1]), (54, "One. Two."), (55, "word " * 3000)]
    rows += [rows[4], rows[4], (7, "Other text of one id. " + shared[2]), (None, "Another null. " + shared[2] + sentence()), (56, "... ?! x.y z!\n\n" + shared[0].replace(". ", ".  "))]
    rows = [(i, t, "clash", 5) for i, t in rows]
    got = substring_dedup.dedup(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(repr((-1 if r["doc_id"] is None else r["doc_id"], r["n_sentences"], r["n_removed"], r["kept_text"])) for r in got) == substring_brute(rows)
    assert {(r["n_words"], r["key"]) for r in got} == {("clash", 5)}


def test_texts_of_one_id_are_told_apart(spark):
    """So are texts whose 32-bit hashes are equal; columns may have any name."""
    texts = spark.range(400_000).select(F.concat(F.lit("text number "), "id").alias("t"))
    twins = texts.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").head()["ts"][:2]
    rnd = random.Random(8)
    shared = " ".join(f"s{rnd.randint(0, 10**6)}" + "." * (k % 20 == 19) for k in range(200))
    rows = [(None, twins[0], 1, "a", 2)] + [(None, f"{t}. {shared}", 1, "a", 2) for t in twins] + [(5, twins[1], 1, "a", 2)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, __sum int, __id string, n_removed int"))
    assert got.columns == ["doc_id", "text", "__sum", "__id", "n_sentences", "n_removed", "kept_text"]
    left = {r["text"]: r["kept_text"] for r in got.collect()}
    assert left[twins[0]] == twins[0] and left[twins[1]] == twins[1] and sum(len(x) < 400 for x in left.values()) == 3


def test_long_white_space_is_cut_in_linear_time():
    began = time.perf_counter()
    for text in ("a" + " " * 1_000_000 + "b", "a" + "\n" * 1_000_000 + "b", "." * 1_000_000, "a" + " \n" * 500_000, " . " * 300_000):
        assert "".join(substring_dedup.sentences(text)) == text
    assert time.perf_counter() - began < 5


def test_whole_repeated_runs_go_and_nothing_else(spark):
    """Three or more shared sentences go whole, however short or long; one or two shared sentences stay."""
    rnd = random.Random(4)
    sentence = lambda n: " ".join(f"v{rnd.randint(0, 10**6)}" for _ in range(n)).capitalize() + ". "
    rows, want, k = [], {}, 0
    for lengths in ([18], [40], [90], [30, 40], [2, 3, 4], [1, 1, 1], [8] * 3, [8] * 5, [15] * 3, [15] * 5, [26, 26, 2], [1, 1, 50], [20, 1, 1, 1, 30]) * 4:
        passage = "".join(sentence(n) for n in lengths)
        for copy in range(2):
            before, after = "".join(sentence(rnd.randint(1, 20)) for _ in range(rnd.randint(0, 4))), "".join(sentence(rnd.randint(1, 20)) for _ in range(rnd.randint(0, 4)))
            rows.append((k, before + passage + after))
            want[k] = before + after if copy and len(lengths) >= 3 else before + passage + after
            k += 1
    got = {r["doc_id"]: r["kept_text"] for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == want


def test_passages_without_sentence_ends(spark):
    """With a window, a passage that has no sentence ends goes but for its ends; without one it stays."""
    rnd = random.Random(12)
    words = lambda n: [f"u{rnd.randint(0, 10**6)}" for _ in range(n)]
    passages = [words(60) for _ in range(20)]
    rows = [(10 * k + i, " ".join(words(rnd.randint(0, 60)) + p + words(rnd.randint(0, 60)))) for k, p in enumerate(passages) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r["n_removed"] == 0 for r in substring_dedup.dedup(docs).collect())
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs, window=12).collect()}
    for k, p in enumerate(passages):
        assert got[10 * k]["n_removed"] == 0
        for i in (1, 2):
            left = got[10 * k + i]["kept_text"].split()
            assert len(set(left) & set(p)) <= 40 and not set(rows[3 * k + i][1].split()) - set(p) - set(left)


def test_passages_that_begin_within_sentences(spark):
    """With passage=51 whatever 51 words two documents share loses words in the later one, and nothing else does; whole runs go whole, and of repeats in one text the first stays."""
    rnd = random.Random(13)
    words = lambda n: [f"p{rnd.randint(0, 10**9)}" for _ in range(n)]
    shared = [words(51) for _ in range(60)]
    for k, p in enumerate(shared):  # no end, one or two ends, so no three whole sentences
        for at in ((), (25,), (3, 44))[k % 3]:
            p[at] += "."
    rows = [(10 * k + i, " ".join(words(rnd.randint(0, 70)) + p + words(rnd.randint(0, 70)))) for k, p in enumerate(shared) for i in range(3)]
    run = " ".join(" ".join(words(8)) + "." for _ in range(3)) + " "
    twice = " ".join(words(70))
    rows += [(1000, run + " ".join(words(90))), (1001, "  " + run + "Own end."), (1002, twice + " between. " + twice), (1003, " ".join(shared[0][:24]) + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert {r["doc_id"] for r in substring_dedup.dedup(docs).where("n_removed > 0").collect()} == {1001}
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs, passage=51).collect()}
    for k, p in enumerate(shared):
        assert got[10 * k]["n_removed"] == 0 and got[10 * k]["kept_text"] == rows[3 * k][1]
        for i in (1, 2):
            left, all_words = got[10 * k + i]["kept_text"].split(), rows[3 * k + i][1].split()
            lost = set(all_words) - set(left)
            assert got[10 * k + i]["n_removed"] > 0 and 25 <= len(lost) <= 51 and lost <= set(p) and left == [w for w in all_words if w not in lost]
    assert got[1000]["n_removed"] == got[1003]["n_removed"] == 0 and (got[1001]["n_removed"], got[1001]["kept_text"]) == (3, "Own end.")
    assert got[1002]["kept_text"].startswith(twice + " between.") and 0 < len(got[1002]["kept_text"].split()) - 71 <= 45


def test_sentences_join_to_the_text():
    for text in ("A b. C d! E?\n\nF", "  lead. x", "no end", "w " * 50 + ". y", "Hm... ok. \t\nz.", ".", "a.b c.d e"):
        assert "".join(substring_dedup.sentences(text)) == text


# Empty tables


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (quality_rules.judge(none), quality_rules.reject(none), line_dedup.dedup(none), line_dedup.remove_lines(none), substring_dedup.dedup(none), decontaminate.scan(none, items), decontaminate.remove_spans(none, items)):
        assert out.count() == 0
    one = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    assert decontaminate.scan(one, items).head()["n_hit"] == 0


def test_query_digests(spark, sf_dir, duck):
    from same import assert_same

    from stratacohort.llm import queries

    for name, sql in queries.ORACLES.items():
        assert_same(queries.QUERIES[name](spark, sf_dir), duck, sql)
    kept = queries.op6_line_dedup(spark, sf_dir).where("doc_id = 0").head()
    text = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id = 0").head()["text"]
    if not kept["n_dropped"]:
        assert kept["kept_sha256"] == hashlib.sha256(text.encode()).hexdigest()
