"""Stage 3a: distinct prompts and their scores through a pluggable scorer."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .cohort import cases, disease_list, first_predictions
from .sequence import by_tokens


def unique_pairs(cohort: DataFrame) -> DataFrame:
    """Each (row_idx, seq_point) once: a prompt is scored once for all diseases."""
    return cohort.select("row_idx", "seq_point").distinct()


def unique_diseases(cohort: DataFrame) -> DataFrame:
    return cohort.select("disease").distinct().orderBy("disease")


def prompts(pairs: DataFrame, traj: DataFrame, config: Config) -> DataFrame:
    """row_idx, seq_point, prompt: the first seq_point tokens and the suffix, cut at max_length tokens.  Pairs without a trajectory drop out.

    Both sides of the join are dealt out by the tokens of trajectories: pairs and texts take few bytes, by which Spark would put many into a task.
    A sequence goes as text, of which a prompt is the part up to a blank: tokens hold none.
    """
    n = by_tokens(traj, config)
    dealt = lambda rows: rows.repartition(n, "row_idx") if n else rows
    rows = dealt(pairs).join(dealt(traj.select("row_idx", F.array_join("tokens", " ").alias("text"))), "row_idx")
    text = F.concat(F.call_function("substring_index", F.col("text"), F.lit(" "), F.col("seq_point").cast("int")), F.lit(config.prompt_suffix))
    return rows.select("row_idx", "seq_point", F.substring_index(text, " ", config.max_length).alias("prompt"))


class Scorer(Protocol):
    """Scores prompts(row_idx, seq_point, prompt) for a disease list: row_idx, seq_point, logits array<double>, in the order of the sorted list."""

    def score(self, prompts: DataFrame, diseases: DataFrame) -> DataFrame: ...


def arithmetic_logit(row_idx, seq_point, disease):
    """Ties on purpose; exact in SQL too."""
    return ((row_idx * 7919 + seq_point * 31 + F.length(disease) * 17) % 50) / F.lit(10.0) + row_idx % 3


class ArithmeticScorer:
    """Column arithmetic for tests: a score from the numbers of a row."""

    def score(self, prompts: DataFrame, diseases: DataFrame) -> DataFrame:
        # A row is a few bytes until it is scored, by which Spark would put all into a few tasks.  Not by the pair itself: joins would take that for their
        # own exchange, and each would score the rows again.
        n = int(prompts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = prompts.select("row_idx", "seq_point").repartition(n, F.xxhash64("row_idx", "seq_point")).withColumn("listed", disease_list(diseases))
        # What is the same for all diseases is made once: a lambda's body is interpreted for each.
        own = F.struct((F.col("row_idx") * 7919 + F.col("seq_point") * 31).alias("of"), (F.col("row_idx") % 3).cast("double").alias("rest"))
        logits = F.transform(F.array(own), lambda x: F.transform("listed", lambda d: (x["of"] + F.length(d) * 17) % 50 / F.lit(10.0) + x["rest"]))
        return rows.select("row_idx", "seq_point", F.element_at(logits, 1).alias("logits"))


class LinearScorer:
    """A bag of tokens: a prompt's logit for a disease is the sum of weights(token, disease, weight) over its tokens."""

    def __init__(self, weights: DataFrame):
        self.weights = weights

    def score(self, prompts: DataFrame, diseases: DataFrame) -> DataFrame:
        rows = prompts.select("row_idx", "seq_point", F.explode(F.split("prompt", " ", -1)).alias("token"))
        counts = rows.groupBy("row_idx", "seq_point", "token").agg(F.count("*").alias("n"))
        wanted = self.weights.join(slots(diseases), "disease")
        sums = counts.join(wanted, "token").groupBy("row_idx", "seq_point", "slot").agg(F.sum(F.col("n") * F.col("weight")).alias("logit"))
        found = sums.groupBy("row_idx", "seq_point").agg(F.sort_array(F.collect_list(F.struct("slot", "logit"))).alias("found"))
        every = prompts.select("row_idx", "seq_point").join(found, ["row_idx", "seq_point"], "left").withColumn("listed", disease_list(diseases))
        # Zeros up to the next slot that has a weight, that slot's sum, and so on.
        ends = F.concat(F.coalesce("found", F.array().cast("array<struct<slot:int,logit:double>>")), F.array(F.struct(F.size("listed").alias("slot"), F.lit(None).cast("double").alias("logit"))))
        pieces = F.transform(ends, lambda x, i: F.concat(F.array_repeat(F.lit(0.0), x["slot"] - F.coalesce(F.get(ends, i - 1)["slot"] + 1, F.lit(0))), F.array_compact(F.array(x["logit"]))))
        return every.select("row_idx", "seq_point", F.flatten(pieces).alias("logits"))


def slots(diseases: DataFrame) -> DataFrame:
    """(disease, slot): the places, from 0, of the diseases in the sorted list; the vocabulary's size."""
    return diseases.agg(F.sort_array(F.collect_set("disease")).alias("d")).select(F.posexplode("d").alias("slot", "disease"))


def long_scores(scores: DataFrame, diseases: DataFrame) -> DataFrame:
    """scores, a row for each disease: row_idx, seq_point, disease, logit."""
    rows = scores.withColumn("listed", disease_list(diseases)).select("row_idx", "seq_point", F.explode(F.arrays_zip("listed", "logits")).alias("x"))
    return rows.select("row_idx", "seq_point", F.col("x.listed").alias("disease"), F.col("x.logits").alias("logit"))


class ModelScorer:
    """A causal language model, loaded once in each Python worker.

    make_model(diseases) returns a function from a list of prompts to an array (prompts x diseases) with the logits of the
    last token, for the diseases in the order given: only these leave the model.  With gpus, tasks ask for that many
    through a resource profile, and the model is loaded once for each task.
    """

    def __init__(self, make_model: Callable[[list[str]], Callable], batch_size: int = 8, partitions: int | None = None, gpus: float = 0):
        self.make_model, self.batch_size, self.partitions, self.gpus = make_model, batch_size, partitions, gpus

    def score(self, prompts: DataFrame, diseases: DataFrame) -> DataFrame:
        listed = [r["disease"] for r in diseases.select("disease").distinct().orderBy("disease").collect()]  # the vocabulary's size
        shared = prompts.sparkSession.sparkContext.broadcast(listed)
        rows = prompts.repartition(self.partitions) if self.partitions else prompts
        # Prompts of like length share a batch, which pads to its longest.
        rows = rows.sortWithinPartitions(F.length("prompt"), "row_idx", "seq_point").select("row_idx", "seq_point", "prompt")
        if self.gpus:
            return self._on_gpus(rows, shared).select("row_idx", "seq_point", F.col("logits").cast("array<double>").alias("logits"))
        return rows.mapInArrow(arrow_through(self.make_model, shared, self.batch_size), "row_idx long, seq_point long, logits array<double>")

    def _on_gpus(self, rows: DataFrame, shared) -> DataFrame:
        from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

        profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1).resource("gpu", self.gpus)).build
        return rows.mapInPandas(batches_through(self.make_model, shared, self.batch_size), "row_idx long, seq_point long, logits array<float>", profile=profile)


#: Logits that go back to Spark at once, or those of one batch of prompts if they are more.
BATCH_LOGITS = 1 << 20


def arrow_through(make: Callable[[list[str]], Callable], shared, size: int) -> Callable:
    """A function over Arrow batches of prompts: the model is made once for each worker and sees `size` prompts at a time; logits of many such batches
    go back as one, as a message to Spark costs more than a small model."""
    key = uuid.uuid4()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.ml.model_cache import ModelCache

        model, width = ModelCache.get(key), len(shared.value)
        if model is None:
            model = make(shared.value)
            ModelCache.add(key, model)
        step = max(1, BATCH_LOGITS // (max(1, width) * size)) * size
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                texts = [str(x) for x in part.column("prompt").to_pylist()]
                logits = np.empty((len(texts), width), np.float32)
                for i in range(0, len(texts), size):
                    found = np.asarray(model(texts[i : i + size]), dtype=np.float32)
                    if found.shape != logits[i : i + size].shape:
                        raise ValueError(f"logits of a batch are {found.shape}, not prompts x diseases {logits[i : i + size].shape}")
                    logits[i : i + size] = found
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(logits.ravel().astype(np.float64)))
                yield pa.RecordBatch.from_arrays([part.column("row_idx").cast(pa.int64()), part.column("seq_point").cast(pa.int64()), lists], names=["row_idx", "seq_point", "logits"])

    return run


def batches_through(make: Callable[[list[str]], Callable], shared, size: int) -> Callable:
    """A function over pandas frames of prompts: the model is made once, and sees `size` prompts at a time."""
    def run(frames):
        model = make(shared.value)
        for frame in frames:
            parts = [frame.iloc[i : i + size] for i in range(0, len(frame), size)]
            logits = [x for p in parts for x in np.asarray(model(list(p["prompt"])), dtype=np.float32).tolist()]
            yield frame[["row_idx", "seq_point"]].assign(logits=logits)

    return run


def device(wanted: str = "auto") -> str:
    """The device of this task's model: the GPU that Spark gave to the task, or the first, or the CPU; `wanted` is auto, cpu, cuda or cuda:N."""
    from pyspark import TaskContext

    if wanted not in ("auto", "cuda"):
        return wanted
    task = TaskContext.get()
    given = task.resources().get("gpu") if task else None
    if given:
        return f"cuda:{given.addresses[0]}"
    return "cuda:0" if wanted == "cuda" else "cpu"


def causal_lm(load: Callable[[str], tuple[Callable, Callable]], max_length: int = 4096, wanted: str = "auto") -> Callable[[list[str]], Callable]:
    """make_model for ModelScorer from a causal model.

    load(device) returns encode, from a token's or prompt's text to ids, and forward, from (ids, mask), both prompts x places and padded
    on the right, to logits, prompts x places x vocabulary.  A prompt's logits are those at its last real token, for the
    diseases' ids; prompts of no tokens are an error, and so is a disease that is not one token.
    """
    def make(diseases: list[str]) -> Callable[[list[str]], np.ndarray]:
        encode, forward = load(device(wanted))
        ids = [encode(d) for d in diseases]
        if any(len(x) != 1 for x in ids):
            raise ValueError("a disease is not one token of the vocabulary")
        columns = np.array([x[0] for x in ids], np.int64)

        def logits(prompts: list[str]) -> np.ndarray:
            rows = [list(encode(p))[:max_length] for p in prompts]
            lengths = np.array([len(x) for x in rows])
            if len(rows) and not lengths.all():
                raise ValueError("a prompt has no tokens")
            mask = np.arange(max(lengths, default=0)) < lengths[:, None]
            padded = np.zeros(mask.shape, np.int64)
            padded[mask] = np.concatenate([np.asarray(x, np.int64) for x in rows]) if rows else []
            out = np.asarray(forward(padded, mask))
            return out[np.arange(len(rows)), lengths - 1][:, columns]

        return logits

    return make


def missing_pairs(pairs: DataFrame, cached: DataFrame) -> DataFrame:
    """Pairs that a table of earlier scores doesn't have."""
    return pairs.join(cached.select("row_idx", "seq_point").distinct(), ["row_idx", "seq_point"], "left_anti")


def checked(logit):
    """A score as a double; NULL or NaN is an error."""
    bad = logit.isNull() | F.isnan(logit.cast("double"))
    return F.when(bad, F.raise_error(F.lit("a score is NULL or NaN")).cast("double")).otherwise(logit.cast("double"))


SCORED = ["disease", "sex", "age", "label", "row_idx", "seq_point", "logit"]


def join_scores(cohort: DataFrame, scores: DataFrame, diseases: DataFrame) -> DataFrame:
    """Cohort rows with their logits; rows without a score drop out (missing_pairs() has them), a NULL or NaN score is an error."""
    rows = cohort.join(F.broadcast(slots(diseases)), "disease").join(scores, ["row_idx", "seq_point"])
    return rows.withColumn("logit", checked(F.get("logits", F.col("slot")))).select(SCORED)


def scored_rows(people: DataFrame, scores: DataFrame, diseases: DataFrame, config: Config) -> DataFrame:
    """join_scores() of the cohort of patients(), one-class cells included, without the cohort: a pair meets its scores before it
    becomes a row for each disease."""
    ill = cases(people).withColumn("label", F.lit(1))
    pair = ["row_idx", "seq_point"]
    firsts = first_predictions(people, config).join(scores, pair).withColumn("absent", F.array_except(disease_list(diseases), "had"))
    rows = firsts.select("sex", "age", *pair, "logits", F.explode_outer("absent").alias("disease")).where("disease IS NOT NULL").join(F.broadcast(slots(diseases)), "disease")
    healthy = rows.select("disease", "sex", "age", F.lit(0).alias("label"), *pair, checked(F.get("logits", "slot")).alias("logit"))
    return join_scores(ill, scores, diseases).unionByName(healthy)
