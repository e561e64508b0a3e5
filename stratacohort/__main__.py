"""python -m stratacohort points | cohorts | evaluate: the three stages as programs, each reading what the one before wrote."""
from __future__ import annotations

import argparse
import hashlib
import importlib
import importlib.util
import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, profile, sample_size
from .operators import auc, cohort, pool, scoring, sequence
from .operators.store import ScoreStore
from .plans.pipeline import first_rows
from .sources import checkpoint, scratch, sinks, trajectories


def stage1(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Trajectory shards to trajectories with points."""
    config = profile(
        "cli", demo_end_index=options.demo_end_index, age_index=options.age_index, max_length=options.seq_len, first_occurrence=options.first_occurrence,
        att_type=options.att_type, absolute=options.absolute, longitudinal=options.longitudinal,
    )
    n = sample_size(options.sample_size, options.data_size)
    traj = trajectories.validate(trajectories.scan_trajectories(spark, options.data_dir), config.longitudinal)
    if options.enrollee_ids_file:
        traj = sequence.not_empty(sequence.filter_ids(traj, trajectories.id_list(spark, options.enrollee_ids_file)), "the id filter")
    if n is not None:
        traj = sequence.sample_exact(traj, n, options.sample_random_state, "patient_id")
    kept, points = sequence.stage1(traj, config)
    sinks.write_parquet(sinks.stage1_file(kept.drop("tokens", "n_tok"), points), out := f"{options.output_dir}/{options.output_file}")
    return sequence.not_empty(spark.read.parquet(out), "the extraction of points")


def stage2(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Trajectories with points to cases and controls; cells as lists besides with --lists."""
    start, end, step = (int(x) for x in options.age_group_range.split(","))
    config = profile("cli", offset_days=options.offset, age_start=start, age_end=end, age_step=step, sex_index=options.sex_index)
    points = sinks.points_of(spark.read.parquet(options.data_dir), config)
    used: list[str] = []
    people = scratch.written(cohort.patients(points, config), "patients", used)
    listed = people.select(F.explode("seen").alias("disease")).distinct()
    vocab = trajectories.vocabulary(spark, options.vocab_file) if options.vocab_file else None
    if vocab is not None:
        codes = options.icd_code_map_file and trajectories.code_list(spark, options.icd_code_map_file)
        listed = (trajectories.known_diseases(vocab, codes) if codes else trajectories.disease_vocabulary(vocab)).select(F.col("token").alias("disease"))
    elif options.icd_code_map_file:
        codes = trajectories.code_list(spark, options.icd_code_map_file).select(F.concat(F.lit("<DX-MAJOR_"), "code", F.lit(">")).alias("disease"))
        listed = listed.join(codes, "disease", "left_semi")
    cells = scratch.written(cohort.cells(people, listed, config), "cells", used)
    rows = cohort.two_class(people, cells, config)
    sinks.write_parquet(sinks.stage2_rows(rows, config.bracket_width, vocab), out := f"{options.output_dir}/{options.output_file}")
    if options.lists:
        sinks.write_lists(sinks.stage2_lists(rows, config.bracket_width, vocab), f"{options.output_dir}/lists_{options.output_file}")
    scratch.delete(spark, used)
    return spark.read.parquet(out)


def load_scorer(name: str, options: argparse.Namespace) -> scoring.Scorer:
    """A Scorer, or a make_model function for ModelScorer, by module:attribute; causal:module:attribute for the load function of
    causal_lm(), which takes the folder of the checkpoint first if there is one; "arithmetic" is the scorer of the tests."""
    if name == "arithmetic":
        return scoring.ArithmeticScorer()
    causal = name.startswith("causal:")
    module, _, attribute = name.removeprefix("causal:").partition(":")
    found = getattr(importlib.import_module(module), attribute)
    if hasattr(found, "score"):
        return found
    if options.checkpoint:
        found = checkpoint.with_folder(found, options.checkpoint)
    make = scoring.causal_lm(found, options.max_length, options.device) if causal else found
    return scoring.ModelScorer(make, options.batch_size, gpus=options.gpus)


def scorer_key(options: argparse.Namespace) -> str:
    """Stands for a scorer: its name, the settings that its logits depend on, and the source of its module and the files of its checkpoint as far as they can be found."""
    given = [options.scorer, options.max_length, options.last_str]
    module = options.scorer.removeprefix("causal:").partition(":")[0]
    found = importlib.util.find_spec(module) if ":" in options.scorer else None
    if found and found.origin and os.path.isfile(found.origin):
        given.append(checkpoint.content_hash(found.origin))
    if options.checkpoint:
        given.append(checkpoint.content_hash(options.checkpoint))
    return hashlib.sha256(repr(given).encode()).hexdigest()


def stage3(spark: SparkSession, options: argparse.Namespace) -> DataFrame:
    """Cases and controls to areas; scores are kept in the output folder, by scorer, trajectories and diseases, and reused with --skip_logits."""
    config = replace(Config(), max_length=options.max_length, prompt_suffix=options.last_str, sample_frac=options.sample_frac, batch_size=options.batch_size)
    traj = sinks.require(spark.read.parquet(options.data_file), ["row_idx", "eval_seq"], "a file of stage 1")
    rows = sinks.cohort_of(spark.read.parquet(options.case_control_ids_file))
    listed, pairs = scoring.unique_diseases(rows), scoring.unique_pairs(rows)
    given = [scorer_key(options), scratch.fingerprint(traj, ["row_idx", "eval_seq"]), scratch.fingerprint(listed, ["disease"])]
    store = ScoreStore(spark, f"{options.output_dir}/scores-{hashlib.sha256(repr(given).encode()).hexdigest()[:24]}", options.score_buckets)
    if not options.skip_logits:
        store.clear()
    chosen = first_rows(traj, config).withColumn("tokens", F.split("eval_seq", " ", -1))
    say = lambda done, missing: print(f"scored {done} of {missing} prompts", flush=True)
    scores = store.complete(pairs, lambda missing: scoring.prompts(missing, chosen, config), lambda prompts: load_scorer(options.scorer, options).score(prompts, listed), say)
    if config.sample_frac < 1:  # the store may have more
        scores = scores.join(chosen.select("row_idx"), "row_idx", "left_semi")
    if missing := scoring.missing_pairs(pairs, scores).count():
        print(f"{missing} prompts have no score; their rows drop out")
    cells = auc.cell_auc(scoring.join_scores(rows, scores, listed))
    if "disease_token" in rows.columns:
        cells = cells.join(rows.select("disease", "disease_token").distinct(), "disease", "left")
    sinks.write_csv(cells.drop("var").orderBy("disease", "sex", "age"), f"{options.output_dir}/auc_results_unpooled.csv")
    sinks.write_csv(pool.disease_auc(cells).orderBy("disease"), f"{options.output_dir}/auc_results.csv")
    pool.summary(pool.disease_auc(cells)).show()
    return cells


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="stratacohort", description=__doc__)
    stages = top.add_subparsers(dest="stage", required=True)
    add = lambda p, name, kind=str, default=None, **more: p.add_argument(f"--{name}", type=kind, default=default, **more)
    flag = lambda p, name, default=False: p.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=default)

    p = stages.add_parser("points")
    for name in ("data_dir", "output_dir"):
        add(p, name, required=True)
    add(p, "output_file", default="traj_test_pd.parquet"), add(p, "demo_end_index", int, 9), add(p, "age_index", int, 3), add(p, "seq_len", int, 4096)
    add(p, "att_type", default="day", choices=["day", "week", "month"]), add(p, "sample_size", int), add(p, "data_size", int), add(p, "sample_random_state", int, 42), add(p, "enrollee_ids_file")
    flag(p, "first-occurrence", True), flag(p, "absolute"), flag(p, "longitudinal")

    p = stages.add_parser("cohorts")
    add(p, "data_dir", required=True), add(p, "output_dir", default="."), add(p, "output_file", default="case_controls.parquet")
    add(p, "offset", float, 365.25), add(p, "age_group_range", default="45,80,5"), add(p, "sex_index", int, 1), add(p, "icd_code_map_file"), add(p, "vocab_file")
    flag(p, "lists")

    p = stages.add_parser("evaluate")
    for name in ("data_file", "case_control_ids_file", "output_dir"):
        add(p, name, required=True)
    add(p, "scorer", required=True), add(p, "sample_frac", float, 1.0), add(p, "batch_size", int, 8), add(p, "max_length", int, 4096), add(p, "last_str", default=" <NY> <INSTRUCT-DX>"), add(p, "gpus", float, 0.0), add(p, "device", default="auto")
    add(p, "checkpoint"), add(p, "score_buckets", int, 8)
    flag(p, "skip_logits")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    options = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("stratacohort").getOrCreate()
    return {"points": stage1, "cohorts": stage2, "evaluate": stage3}[options.stage](spark, options)


if __name__ == "__main__":
    main()
