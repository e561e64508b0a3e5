"""Token ids: looked up in bulk or joined, unknown tokens, and vocabularies that are wrong."""
import pytest
from pyspark.sql import functions as F

from stratacohort.config import profile
from stratacohort.operators import encode, scoring


def test_ids(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "", "x"]), (2, []), (3, None), (4, ["b", None])], "row_idx long, tokens array<string>").repartition(3)
    vocab = spark.createDataFrame([("a", 7), ("b", 9), ("", 2), ("b", 9), (None, 3)], "token string, token_id int")
    want = {1: [7, 9, 7, 2, 0], 2: [], 3: [], 4: [9, 0]}
    for most in (encode.VOCAB_BYTES, 0):
        assert {r["row_idx"]: r["ids"] for r in encode.encode(rows, vocab, max_bytes=most).collect()} == want
        assert encode.encode(rows.limit(0), vocab, max_bytes=most).count() == 0
    assert "Exchange" not in encode.encode(spark.range(9).select(F.col("id").alias("row_idx"), F.array(F.lit("a")).alias("tokens")), vocab)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="more than one id"):
        encode.encode(rows, vocab.unionByName(spark.createDataFrame([("a", 8)], "token string, token_id int")))


def test_prompts_as_ids(spark):
    """The ids of prompts() and of its suffix, cut alike."""
    config = profile("days", max_length=5)
    traj = spark.createDataFrame([(1, "s a b a c d".split(" ")), (2, ["s"])], "row_idx long, tokens array<string>")
    pairs = spark.createDataFrame([(1, 2), (1, 6), (2, 1), (9, 1)], "row_idx long, seq_point long")
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(["s", "a", "b", "c", "<NY>"], 1)], "token string, token_id int")
    ids = {t: i for i, t in enumerate(["s", "a", "b", "c", "<NY>"], 1)}
    text = {(r["row_idx"], r["seq_point"]): [ids.get(t, 0) for t in r["prompt"].split(" ")] for r in scoring.prompts(pairs, traj, config).collect()}
    assert {(r["row_idx"], r["seq_point"]): r["ids"] for r in encode.prompt_ids(pairs, traj, vocab, config).collect()} == text and len(text) == 3
    listed = spark.createDataFrame([("a",), ("b",)], "disease string")
    assert {r["disease"]: r["token_id"] for r in encode.disease_ids(listed, vocab).collect()} == {"a": 2, "b": 3}
    with pytest.raises(Exception, match="not a token of the vocabulary: zz"):
        encode.disease_ids(listed.unionByName(spark.createDataFrame([("zz",)], "disease string")), vocab).collect()
