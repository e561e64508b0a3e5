"""Sources, sinks, samples, configurations and kept stages."""
import hashlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacohort.config import PROFILES, Config, profile, sample_size
from stratacohort.operators import scoring, sequence
from stratacohort.plans.pipeline import evaluate, evaluate_kept, report, run_key
from stratacohort.plans.queries import QUERIES
from stratacohort.sources import fixtures, scratch, trajectories


@pytest.fixture(scope="module")
def traj(spark, sf_dir):
    return fixtures.trajectories(spark, sf_dir)


def test_scan_of_nested_shards(spark, traj, tmp_path):
    a, b = traj.where("row_idx < 70"), traj.where("row_idx >= 70").withColumn("extra", F.lit(1))
    a.drop("row_idx").write.parquet(f"{tmp_path}/x/a.parquet")
    b.drop("row_idx").write.parquet(f"{tmp_path}/y/z/b.parquet")
    got = trajectories.scan_trajectories(spark, str(tmp_path))
    n = traj.count()
    assert got.count() == n and "extra" in got.columns
    assert sorted(r["row_idx"] for r in got.select("row_idx").collect()) == list(range(n))
    assert {r["person_id"] for r in got.collect()} == {r["person_id"] for r in traj.collect()}
    again = {r["person_id"]: r["row_idx"] for r in trajectories.scan_trajectories(spark, str(tmp_path)).repartition(3).collect()}
    assert again == {r["person_id"]: r["row_idx"] for r in got.collect()}


def test_scan_of_unlike_shards(spark, traj, tmp_path):
    """Other files in the folder, columns that some shards lack, counts of two widths, and ids that are numbers here and text there."""
    rows = traj.drop("row_idx").where("person_id < 40")
    wide = rows.withColumns({"token_count_thru_2022": F.col("token_count_thru_2022").cast("long"), "x": F.lit(1.5)})
    rows.where("person_id < 10").withColumn("token_count_thru_2022", F.col("token_count_thru_2022").cast("int")).coalesce(1).write.parquet(f"{tmp_path}/a")
    wide.where("person_id >= 10 AND person_id < 20").coalesce(1).write.parquet(f"{tmp_path}/b/c")
    wide.where("person_id >= 20").withColumn("x", F.col("x").cast("float")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/b/c")  # beside the others
    (tmp_path / "b" / "notes.csv").write_text("not a shard")
    got = trajectories.validate(trajectories.scan_trajectories(spark, str(tmp_path)))
    types = dict(got.dtypes)
    assert types["token_count_thru_2022"] == "bigint" and types["x"] == "double"
    want = {r["person_id"]: (r["seq"], r["token_count_thru_2022"]) for r in rows.collect()}
    assert {r["person_id"]: (r["seq"], r["token_count_thru_2022"]) for r in got.collect()} == want
    assert sorted(r["row_idx"] for r in got.collect()) == list(range(len(want))) and got.where("x IS NULL").count() == rows.where("person_id < 10").count()
    plan = got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Exchange" not in plan  # no trajectory is shuffled
    joined = trajectories.with_row_idx(spark.read.parquet(f"{tmp_path}/a"), 0)  # beyond the bound of the broadcast
    assert sorted(r["row_idx"] for r in joined.collect()) == list(range(joined.count()))
    rows.where("person_id < 5").withColumn("person_id", F.concat(F.lit("p"), "person_id")).write.parquet(f"{tmp_path}/z")
    got = trajectories.scan_trajectories(spark, str(tmp_path)).collect()
    assert {"p1", "1"} <= {r["person_id"] for r in got} and sorted(r["row_idx"] for r in got) == list(range(len(got)))
    rows.limit(1).withColumn("seq", F.array("seq")).write.parquet(f"{tmp_path}/zz")
    with pytest.raises(ValueError, match="column seq"):
        trajectories.scan_trajectories(spark, str(tmp_path))


def test_rows_of_several_files_are_numbered_in_the_order_of_persons(spark, sf_dir):
    """Shards of several files each, which Spark reads by size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = QUERIES["scan_trajectories"](spark, sf_dir).select("person_id", "row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["row_idx"] for r in sorted(rows)] == list(range(len(rows)))


def test_scan_of_nothing(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        trajectories.scan_trajectories(spark, str(tmp_path)).count()


def test_id_lists(spark, tmp_path):
    (tmp_path / "ids.TXT").write_text("7\n\n  8 \n7\n")
    (tmp_path / "ids.csv").write_text("name,enrollee_id\nx,007\ny,8\n")
    (tmp_path / "first.csv").write_text("code\n1\n")
    spark.createDataFrame([(1,), (None,)], "enrollee_id int").write.parquet(f"{tmp_path}/ids.parquet")
    ids = lambda name: sorted(r["id"] for r in trajectories.id_list(spark, f"{tmp_path}/{name}").collect())
    assert ids("ids.TXT") == ["7", "8"] and ids("ids.csv") == ["007", "8"] and ids("first.csv") == ["1"] and ids("ids.parquet") == ["1"]
    with pytest.raises(ValueError, match="id list"):
        trajectories.id_list(spark, "ids.json")


def test_id_filter_needs_its_column(spark, traj):
    ids = spark.createDataFrame([("3",)], "id string")
    with pytest.raises(ValueError, match="enrollee_id"):
        sequence.filter_ids(traj, ids)
    assert [r["row_idx"] for r in sequence.filter_ids(traj.withColumn("enrollee_id", F.col("row_idx")), ids).collect()] == [3]


def test_code_lists_and_vocabularies(spark, tmp_path):
    (tmp_path / "codes.csv").write_text("ICD code,x\nB1,1\nB2,2\nB1,3\nZ9,4\n")
    (tmp_path / "vocab.json").write_text('{"<unk>": 0, "<DX-MAJOR_B2>": 5, "<DX-MAJOR_B1>": 6, "<DX-OTHER>": 7, "<DX-MAJOR_Z9>": 0}')
    vocab = trajectories.vocabulary(spark, f"{tmp_path}/vocab.json")
    assert [r["token"] for r in trajectories.disease_vocabulary(vocab).collect()] == ["<DX-MAJOR_Z9>", "<DX-MAJOR_B2>", "<DX-MAJOR_B1>"]
    known = trajectories.known_diseases(vocab, trajectories.code_list(spark, f"{tmp_path}/codes.csv"))
    assert sorted(r["token"] for r in known.collect()) == ["<DX-MAJOR_B1>", "<DX-MAJOR_B2>"]


def test_columns_are_checked(spark):
    rows = spark.createDataFrame([("a", 1)], "seq string, token_count_thru_2022 int")
    with pytest.raises(ValueError, match="total_token_count"):
        trajectories.validate(rows)
    assert trajectories.validate(rows, longitudinal=False) is rows
    with pytest.raises(ValueError, match="person_id"):
        trajectories.with_patient_id(rows)


def test_samples(spark, traj, monkeypatch):
    n = traj.count()
    assert sequence.sample_exact(traj, n + 5).count() == n
    ids = lambda rows: {r["row_idx"] for r in rows.collect()}
    order = sorted((hashlib.md5(f"{r['person_id']}:42".encode()).hexdigest(), r["row_idx"]) for r in traj.collect())
    for k in (0, 1, 20, n - 1, n):
        assert ids(sequence.sample_exact(traj, k)) == {i for _, i in order[:k]}
    monkeypatch.setattr(sequence, "SAMPLE_DIGITS", 1)
    monkeypatch.setattr(sequence, "SAMPLE_ROWS", 2)
    for k in (0, 1, 20, n - 1, n):
        assert ids(sequence.sample_exact(traj, k)) == {i for _, i in order[:k]}
    assert ids(sequence.sample_exact(traj, 20)) == ids(sequence.sample_exact(traj.repartition(7), 20))
    assert ids(sequence.sample_exact(traj, 20)) != ids(sequence.sample_exact(traj, 20, seed=1))
    assert ids(sequence.head_fraction(traj, 0.5)) == set(range(n // 2))
    assert sample_size(None, 5) == 5 and sample_size(3, None) == 3 and sample_size(None, None) is None
    for bad in ((1, 2), (0, None)):
        with pytest.raises(ValueError):
            sample_size(*bad)


def test_samples_of_one_id(spark, monkeypatch):
    """Null ids, or one id, in all rows: the first rows by number, without gathering them."""
    monkeypatch.setattr(sequence, "SAMPLE_ROWS", 5)
    rows = spark.range(0, 300, 3).select(F.col("id").alias("row_idx"), F.lit(None).cast("string").alias("person_id"))
    for n in (1, 40, 100, 200):
        assert sorted(r["row_idx"] for r in sequence.sample_exact(rows, n).collect()) == list(range(0, 300, 3))[:n]
    mixed = rows.withColumn("person_id", F.when(F.col("row_idx") >= 90, "x").otherwise(F.col("row_idx").cast("string")))
    whole = [r["row_idx"] for r in mixed.withColumn("h", F.md5(F.concat_ws(":", "person_id", F.lit("42")))).orderBy("h", "row_idx").collect()]
    for n in (3, 60, 99):
        assert {r["row_idx"] for r in sequence.sample_exact(mixed, n).collect()} == set(whole[:n])


def test_head_fraction_counts_rows_not_numbers(spark, monkeypatch):
    """Row numbers keep their gaps through filters; the first rows are still int(n * frac) of those that are left."""
    ids = [3, 1_000_000, 70_000, 70_001, 999_999, 12, 65_536, 500_000, 65_535]
    rows = spark.createDataFrame([(i,) for i in ids], "row_idx long").repartition(3)
    for block in (sequence.HEAD_BLOCK, 5):
        monkeypatch.setattr(sequence, "HEAD_BLOCK", block)
        for frac in (0, 0.05, 0.2, 0.5, 0.8, 1):
            assert sorted(r["row_idx"] for r in sequence.head_fraction(rows, frac).collect()) == sorted(ids)[: int(9 * frac)]
        assert sequence.head_fraction(rows, 0.5, 4).count() == 2 and sequence.head_fraction(rows, 1, 50).count() == 9
        assert sequence.head_fraction(rows.limit(0), 0.5).count() == 0


def test_configurations():
    assert PROFILES["cli"].brackets == [45, 50, 55, 60, 65, 70, 75] and Config().gap_days == 30
    assert profile("driver").lead_q == 1462 and profile("driver", offset_days=0).lead_q == 1 and profile("driver", offset_days=0.1).lead_q == 1
    assert profile("driver").key != profile("driver", offset_days=30).key and profile("driver").key == Config().key
    for bad in ({"att_type": "hour"}, {"offset_days": -1}, {"age_step": 0}, {"sample_frac": 0}):
        with pytest.raises(ValueError):
            profile("driver", **bad)


def test_kept_stages_are_reused(spark, traj, tmp_path):
    config = profile("days")
    calls = []

    class Counting(scoring.ArithmeticScorer):
        def score(self, prompts, diseases):
            calls.append(1)
            return super().score(prompts, diseases)

    some = traj.where("row_idx < 60")
    first = {r["disease"]: r["auc"] for r in evaluate_kept(spark, some, config, str(tmp_path), Counting(), "a", buckets=3).pooled.collect()}
    assert len(calls) == 3
    again = evaluate_kept(spark, some.repartition(5), config, str(tmp_path), Counting(), "a")
    assert {r["disease"]: r["auc"] for r in again.pooled.collect()} == first and len(calls) == 3
    run = evaluate(some, config)
    assert {r["disease"]: r["auc"] for r in run.pooled.collect()} == pytest.approx(first)
    run.release()
    report(again, f"{tmp_path}/out")
    assert spark.read.option("header", True).csv(f"{tmp_path}/out/auc_results.csv").count() == len(first)


def test_kept_stages_are_those_of_their_input(spark, traj, tmp_path):
    """Other patients, or another disease list, under the same path and settings have results of their own."""
    config, scorer = profile("days"), scoring.ArithmeticScorer()
    parts = [traj.where("row_idx < 60"), traj.where("row_idx >= 60")]
    runs = [evaluate_kept(spark, x, config, str(tmp_path), scorer, "a") for x in parts]
    rows = [{r["row_idx"] for r in run.cohort.select("row_idx").distinct().collect()} for run in runs]
    assert rows[0] and rows[1] and max(rows[0]) < 60 <= min(rows[1])
    one = runs[0].diseases.orderBy("disease").limit(3)
    listed = evaluate_kept(spark, parts[0], config, str(tmp_path), scorer, "a", one)
    assert {r["disease"] for r in listed.cells.collect()} <= {r["disease"] for r in one.collect()}
    twice = parts[0].unionByName(parts[0])
    assert len({run_key(x, config) for x in (*parts, twice, traj.limit(0))}) == 4


def test_a_run_leaves_nothing(spark, traj, tmp_path, monkeypatch):
    import os

    monkeypatch.setattr(scratch, "folder", lambda spark, name: f"{tmp_path}/{name}")
    run = evaluate(traj.where("row_idx < 40"), profile("days"))
    assert run.pooled.count() > 0 and sorted(os.listdir(tmp_path)) == ["cells", "diseases", "patients"]
    run.release()
    assert os.listdir(tmp_path) == [] and spark._jsparkSession.sharedState().cacheManager().isEmpty()


def test_missing_scores_are_counted(spark, traj):
    """Rows without a score drop out, and are counted; others keep theirs."""
    class Partial(scoring.ArithmeticScorer):
        def score(self, prompts, diseases):
            return super().score(prompts.where("row_idx % 5 <> 0"), diseases)

    run = evaluate(traj.where("row_idx < 50"), profile("days"), Partial())
    pairs = run.pairs.where("row_idx % 5 = 0").count()
    assert run.n_missing() == pairs > 0
    kept = run.cohort.where("row_idx % 5 <> 0")
    found = scoring.join_scores(run.cohort, run.scores, run.diseases)
    assert sorted(map(repr, found.drop("logit").collect())) == sorted(map(repr, kept.select(found.drop("logit").columns).collect()))
    bad = run.scores.withColumn("logits", F.transform("logits", lambda x: F.lit(float("nan"))))
    with pytest.raises(Exception, match="NULL or NaN"):
        scoring.join_scores(run.cohort, bad, run.diseases).collect()
    run.release()


def test_causal_models_are_read_at_the_last_token(spark):
    """Padded prompts: the logits are those of the last real token; batches, devices and errors."""
    vocabulary = {"<DX-A>": 3, "<DX-B>": 5}
    made = []

    def load(device):
        made.append(device)

        def encode(text):
            return [vocabulary[t] if t in vocabulary else 6 + len(t) for t in text.split(" ") if t]

        def forward(ids, mask):
            assert ids.shape == mask.shape and not ids[~mask].any()
            place = np.arange(ids.shape[1])[None, :, None]
            return ids[:, :, None] * 100 + place * 10 + np.arange(12)[None, None, :] + 0.5 * (~mask)[:, :, None]

        return encode, forward

    model = scoring.causal_lm(load, max_length=4)(["<DX-B>", "<DX-A>"])
    assert made == ["cpu"]
    got = model(["a", "aa bbb", "a b c d eeeee"])
    assert got.tolist() == [[705.0, 703.0], [915.0, 913.0], [735.0, 733.0]]
    assert scoring.device("cuda:3") == "cuda:3" and scoring.device("cuda") == "cuda:0" and scoring.device("cpu") == "cpu"
    with pytest.raises(ValueError, match="no tokens"):
        model(["a", ""])
    with pytest.raises(ValueError, match="one token"):
        scoring.causal_lm(load)(["<DX-A> <DX-B>"])
    prompts = spark.createDataFrame([(i, 1, " ".join(["x"] * (i % 5 + 1))) for i in range(30)], "row_idx long, seq_point long, prompt string")
    diseases = spark.createDataFrame([("<DX-B>",), ("<DX-A>",), ("<DX-B>",)], "disease string")
    want = {i: [700.0 + 10 * (i % 5) + c for c in (3, 5)] for i in range(30)}
    scores = scoring.ModelScorer(scoring.causal_lm(load), batch_size=4).score(prompts, diseases)
    assert {r["row_idx"]: r["logits"] for r in scores.collect()} == want
    through = scoring.batches_through(scoring.causal_lm(load), SimpleNamespace(value=["<DX-A>", "<DX-B>"]), 4)  # what a GPU task runs
    assert {i: x for frame in through([prompts.toPandas()]) for i, x in zip(frame["row_idx"], frame["logits"])} == want


def test_prompts_are_dealt_out_by_tokens(spark, monkeypatch):
    """As many tasks as the tokens of trajectories ask for, whatever bytes a shuffle has; prompts cut anywhere."""
    monkeypatch.setattr(sequence, "TASK_TOKENS", 100)
    rows = [(i, ["<BOS>", "", *"abcdefgh"], 9) for i in range(60)]
    pairs = spark.createDataFrame([(i, at) for i, _, _ in rows for at in (0, 1, 2, 1 + i % 12)], "row_idx long, seq_point long").distinct()
    config = profile("days", max_length=9)
    found = scoring.prompts(pairs, spark.createDataFrame(rows, "row_idx long, tokens array<string>, total_token_count int"), config)
    assert found.rdd.getNumPartitions() == 6
    want = {(i, at): " ".join((" ".join(rows[i][1][:at]) + config.prompt_suffix).split(" ")[:9]) for i, at in map(tuple, pairs.collect())}
    assert {(r["row_idx"], r["seq_point"]): r["prompt"] for r in found.collect()} == want


def test_logits_of_many_batches_go_back_at_once(monkeypatch):
    """The model sees `size` prompts at a time, is made once, and its logits are one message; wide ones are several."""
    import pyarrow as pa

    made, seen = [], []

    def make(diseases):
        made.append(diseases)

        def model(prompts):
            seen.append(len(prompts))
            return [[len(p) + 0.1, -len(p)] for p in prompts]

        return model

    run = scoring.arrow_through(make, SimpleNamespace(value=["A", "B"]), 4)
    batch = pa.RecordBatch.from_pydict({"row_idx": list(range(10)), "seq_point": [1] * 10, "prompt": ["x" * i for i in range(10)]})
    want = [[float(np.float32(i + 0.1)), float(-i)] for i in range(10)]
    (found,) = run([batch])
    assert found.column("logits").to_pylist() == want and found.column("row_idx").to_pylist() == list(range(10)) and seen == [4, 4, 2]
    monkeypatch.setattr(scoring, "BATCH_LOGITS", 8)
    parts = list(run([batch, batch.slice(0, 0)]))
    assert [p.num_rows for p in parts] == [4, 4, 2] and [x for p in parts for x in p.column("logits").to_pylist()] == want and len(made) == 1
    with pytest.raises(ValueError, match="not prompts x diseases"):
        list(scoring.arrow_through(lambda diseases: lambda prompts: [[1.0]] * len(prompts), SimpleNamespace(value=["A", "B"]), 4)([batch]))


def test_linear_scores(spark):
    prompts = spark.createDataFrame([(0, 2, "a a b"), (1, 1, "c")], "row_idx long, seq_point long, prompt string")
    weights = spark.createDataFrame([("a", "D2", 1.5), ("b", "D2", 1.0), ("b", "D4", -1.0), ("c", "D9", 7.0)], "token string, disease string, weight double")
    diseases = spark.createDataFrame([(f"D{i}",) for i in (4, 2, 3, 1)], "disease string")
    got = {r["row_idx"]: r["logits"] for r in scoring.LinearScorer(weights).score(prompts, diseases).collect()}
    assert got == {0: [0.0, 4.0, 0.0, -1.0], 1: [0.0] * 4}


def test_empty_input_gives_empty_tables(spark, traj):
    run = evaluate(traj.limit(0), profile("days"))
    assert run.pooled.count() == 0 and run.pooled.columns == ["disease", "auc", "n_samples", "n_diseased", "n_healthy"]
    with pytest.raises(ValueError, match="no rows left"):
        sequence.not_empty(traj.limit(0), "the id filter")


def test_prompts(spark):
    pairs = spark.createDataFrame([(0, 2), (0, 3), (9, 1)], "row_idx long, seq_point long")
    rows = spark.createDataFrame([(0, ["a", "b", "c", "d"])], "row_idx long, tokens array<string>")
    got = {r["seq_point"]: r["prompt"] for r in scoring.prompts(pairs, rows, profile("days")).collect()}
    assert got == {2: "a b <NY> <INSTRUCT-DX>", 3: "a b c <NY> <INSTRUCT-DX>"}
    cut = {r["seq_point"]: r["prompt"] for r in scoring.prompts(pairs, rows, profile("days", max_length=4)).collect()}
    assert cut[3] == "a b c <NY>"  # the suffix is cut as well
