"""The three stages as one plan, or as stages kept under a path for each configuration and input."""
from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import auc, cohort, pool, scoring, sequence
from ..operators.store import ScoreStore
from ..sources import scratch, sinks


@dataclass
class Evaluation:
    """All relations of a run.  Patients, cell sizes and counts of scores are tables; nothing else is computed until it is used."""

    config: Config
    traj: DataFrame
    points: DataFrame
    diseases: DataFrame
    people: DataFrame
    cohort: DataFrame
    pairs: DataFrame
    scores: DataFrame
    cells: DataFrame
    pooled: DataFrame
    used: list[str] = field(default_factory=list)

    def n_missing(self) -> int:
        """Pairs that should have scores and have none: their rows have dropped out."""
        return scoring.missing_pairs(self.pairs, self.scores).count()

    def release(self) -> None:
        """Delete the tables that the run made for itself; its relations can't be used any more."""
        scratch.delete(self.pooled.sparkSession, self.used)


def first_rows(traj: DataFrame, config: Config) -> DataFrame:
    return sequence.head_fraction(traj, config.sample_frac) if config.sample_frac < 1 else traj


def evaluate(traj: DataFrame, config: Config, scorer: scoring.Scorer | None = None, diseases: DataFrame | None = None) -> Evaluation:
    """From trajectories to pooled areas; diseases(disease) defaults to all that occur.  Stages 1 and 2 run at once, into tables, and so do counts of scores."""
    scorer, used = scorer or scoring.ArithmeticScorer(), []
    kept, points = sequence.stage1(first_rows(traj, config), config)
    people = scratch.written(cohort.patients(points, config), "patients", used)
    listed = (people.select(F.explode("seen").alias("disease")) if diseases is None else diseases.select("disease")).distinct()
    listed = scratch.written(listed, "diseases", used)
    sizes = scratch.written(cohort.cells(people, listed, config), "cells", used)
    pairs = cohort.scoring_pairs(people, sizes, config)
    scores = scorer.score(scoring.prompts(pairs, kept, config), listed)
    cells = auc.cell_auc(scoring.scored_rows(people, scores, listed, config), below=used[-1])
    return Evaluation(config, kept, points, listed, people, cohort.two_class(people, sizes, config), pairs, scores, cells, pool.disease_auc(cells), used)


#: Columns of trajectories that a run's result depends on.
INPUT = ["row_idx", "seq", "token_count_thru_2022", "total_token_count"]


def run_key(traj: DataFrame, config: Config, diseases: DataFrame | None = None) -> str:
    """Keys what is kept of a run: all settings, the trajectories, and the disease list."""
    given = scratch.fingerprint(traj, [c for c in INPUT if c in traj.columns])
    listed = "all" if diseases is None else scratch.fingerprint(diseases.select("disease").distinct(), ["disease"])
    return hashlib.sha256(f"{config.key} {given} {listed}".encode()).hexdigest()[:24]


def evaluate_kept(spark: SparkSession, traj: DataFrame, config: Config, path: str, scorer: scoring.Scorer, scorer_key: str, diseases: DataFrame | None = None, buckets: int = 8, progress: Callable[[int, int], None] | None = None) -> Evaluation:
    """evaluate() with each stage written below path and reused where the configuration, the trajectories and the disease list are the same.

    Scores are kept in a ScoreStore by scorer_key besides; only pairs that it lacks are scored, bucket by bucket.
    """
    key = run_key(traj, config, diseases)
    kept, found = sequence.stage1(first_rows(traj, config), config)
    points = sinks.materialise(spark, path, "points", key, lambda: found)
    people = sinks.materialise(spark, path, "people", key, lambda: cohort.patients(points, config))
    listed = sinks.materialise(spark, path, "diseases", key, lambda: (people.select(F.explode("seen").alias("disease")) if diseases is None else diseases.select("disease")).distinct())
    sizes = sinks.materialise(spark, path, "cells", key, lambda: cohort.cells(people, listed, config))
    pairs = cohort.scoring_pairs(people, sizes, config)
    store = ScoreStore(spark, f"{path.rstrip('/')}/scores-{scorer_key}-{key}", buckets)
    scores = store.complete(pairs, lambda missing: scoring.prompts(missing, kept, config), lambda rows: scorer.score(rows, listed), progress)
    cells = auc.cell_auc(scoring.scored_rows(people, scores, listed, config), used=(used := []))
    return Evaluation(config, kept, points, listed, people, cohort.two_class(people, sizes, config), pairs, scores, cells, pool.disease_auc(cells), used)


def report(run: Evaluation, path: str) -> None:
    """Both result tables as CSV."""
    sinks.write_csv(run.pooled.orderBy("disease"), f"{path}/auc_results.csv")
    sinks.write_csv(run.cells.drop("var").orderBy("disease", "sex", "age"), f"{path}/auc_results_unpooled.csv")
