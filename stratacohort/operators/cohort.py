"""Stage 2: from points to case and control cohorts for every disease, sex and age bracket.

A patient's points, at most max_points, become one row with arrays; prediction points, cases and controls are looked up inside it.  So
everything after stage 1's one exchange on row_idx stays where it is, until cohort rows are counted by cell.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import YEAR_Q, Config

#: Age of the target after the last point, as if at 1000 years: what a patient without the disease is scored for.
SENTINEL_Q = 1000 * YEAR_Q


def with_sentinel(points: DataFrame, config: Config) -> DataFrame:
    """Points of patients within the cap, and one sentinel target after the last, if there is room for it.

    Columns row_idx, sex, k, token (null for the sentinel), q, loc, is_sentinel.
    """
    whole = Window.partitionBy("row_idx")
    rows = points.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") <= config.max_points)
    here = F.struct("k", "token", "q", "loc", F.lit(False).alias("is_sentinel"))
    after = F.struct(F.col("__n").alias("k"), F.lit(None).cast("string").alias("token"), F.lit(SENTINEL_Q).cast("long").alias("q"), F.lit(0).cast("long").alias("loc"), F.lit(True).alias("is_sentinel"))
    last = (F.col("k") == F.col("__n") - 1) & (F.col("__n") < config.max_points)
    return rows.select("row_idx", "sex", F.explode(F.when(last, F.array(here, after)).otherwise(F.array(here))).alias("p")).select("row_idx", "sex", "p.*")


def _bracket(q: Column, config: Config) -> Column:
    """The start of the bracket of an age; null outside all."""
    start, width = config.age_start, config.bracket_width
    i = F.floor((q - start * YEAR_Q) / F.lit(width * YEAR_Q)).cast("int")
    return F.when((q >= start * YEAR_Q) & (i < len(config.brackets)), i * width + start)


def patients(points: DataFrame, config: Config) -> DataFrame:
    """row_idx, sex, targets, had, seen, ill and firsts of each patient.

    Targets, in order of k, are the points from the second on and the sentinel.  pred_idx counts the points more than the
    offset before a target, less one, by a RANGE frame over age; -1 is none.  pred_q and seq_point are the age and the place of that
    point, age the start of its bracket.  had lists the diseases that keep a patient from being their control: those at the
    second point or later, or all if strict; seen lists those of all points.  ill are the patient's cases, and firsts has for each bracket its first
    prediction, or a null place: looked up once here, as all later steps read them.
    """
    rows = with_sentinel(points, config)
    before = Window.partitionBy("row_idx").orderBy("q").rangeBetween(Window.unboundedPreceding, -config.lead_q)
    # The last place under the cap is a target, never history.
    counted = F.sum(F.when(F.col("k") < config.max_points - 1, 1).otherwise(0)).over(before)
    rows = rows.withColumn("pred_idx", F.coalesce(counted, F.lit(0)).cast("int") - 1).withColumn("bracket", _bracket(F.col("q"), config))
    whole = rows.groupBy("row_idx", "sex").agg(F.sort_array(F.collect_list(F.struct("k", "token", "q", "loc", "pred_idx", "is_sentinel", "bracket"))).alias("p"))

    def found(p: Column) -> Column:
        at = lambda x, field: F.when(x["pred_idx"] >= 0, F.get(p, x["pred_idx"])[field])
        targets = F.slice(p, F.lit(2), F.size(p))
        return F.transform(targets, lambda x: F.struct(x["k"].alias("k"), x["token"].alias("token"), x["q"].alias("q"), x["pred_idx"].alias("pred_idx"), at(x, "q").alias("pred_q"), at(x, "loc").alias("seq_point"), x["is_sentinel"].alias("is_sentinel"), at(x, "bracket").alias("age")))

    ill = F.col("p") if config.strict_controls else F.slice("p", F.lit(2), F.size("p"))
    tokens = lambda p: F.array_compact(p["token"])
    rows = whole.select("row_idx", "sex", F.element_at(F.transform(F.array("p"), found), 1).alias("targets"), tokens(ill).alias("had"), tokens(F.col("p")).alias("seen"))
    return rows.withColumns({"ill": _cases(), "firsts": _first_predictions(config)})


def targets(rows: DataFrame) -> DataFrame:
    """patients(), a row for each target."""
    return rows.select("row_idx", "sex", F.explode("targets").alias("t")).select("row_idx", "sex", "t.*")


def _cases() -> Column:
    """A patient's first target of each disease, if its prediction point is in a bracket: the age of the case, not of the diagnosis.

    Targets in the order of (token, k), each beside the one before: n log n in a patient's points.
    """
    known = F.filter("targets", lambda x: x["token"].isNotNull())
    ordered = F.sort_array(F.transform(known, lambda x: F.struct(x["token"].alias("disease"), x["k"].alias("k"), x["age"].alias("age"), x["seq_point"].alias("seq_point"))))
    first = lambda xs: F.filter(xs, lambda x, i: ((i == 0) | (F.get(xs, i - 1)["disease"] != x["disease"])) & x["age"].isNotNull())
    chosen = F.element_at(F.transform(F.array(ordered), first), 1)  # within a lambda the list is made once
    return F.transform(chosen, lambda x: F.struct(x["disease"].alias("disease"), x["age"].alias("age"), x["seq_point"].alias("seq_point"), F.lit(1).alias("label")))


def _first_predictions(config: Config) -> Column:
    """The earliest target of each bracket, its place null if there is none: no disease matters yet."""
    place = lambda b: F.array_position("targets.age", b).cast("int")
    first = lambda b: F.when(place(b) > 0, F.get("targets.seq_point", place(b) - 1))
    return F.array(*[F.struct(F.lit(b).alias("age"), first(b).alias("seq_point")) for b in config.brackets])


def _controls() -> Column:
    """First predictions, for every listed disease that the patient doesn't have."""
    absent, firsts = F.array_except("listed", "had"), F.filter("firsts", lambda x: x["seq_point"].isNotNull())
    of = lambda x, ds: F.transform(ds, lambda d: F.struct(d.alias("disease"), x["age"].alias("age"), x["seq_point"].alias("seq_point"), F.lit(0).alias("label")))
    each = F.transform(F.array(absent), lambda ds: F.flatten(F.transform(firsts, lambda x: of(x, ds))))
    return F.element_at(each, 1)


def with_list(rows: DataFrame, diseases: DataFrame) -> DataFrame:
    """rows with the disease list, one value of the vocabulary's size, as a column `listed`: a scalar subquery, not a join."""
    return rows.withColumn("listed", disease_list(diseases))


def disease_list(diseases: DataFrame) -> Column:
    return diseases.agg(F.sort_array(F.collect_set("disease")).alias("listed")).scalar()


def cases(rows: DataFrame) -> DataFrame:
    """disease, sex, age, row_idx, seq_point of the cases among patients()."""
    return rows.select("sex", "row_idx", F.explode("ill").alias("c")).select("c.disease", "sex", "c.age", "row_idx", "c.seq_point")


def controls(rows: DataFrame, diseases: DataFrame, config: Config) -> DataFrame:
    """disease, sex, age, row_idx, seq_point of the controls among patients()."""
    return with_list(rows, diseases).select("sex", "row_idx", F.explode(_controls()).alias("c")).select("c.disease", "sex", "c.age", "row_idx", "c.seq_point")


def absent_diseases(rows: DataFrame, diseases: DataFrame) -> DataFrame:
    """disease, row_idx for the listed diseases that a patient can be a control of."""
    return with_list(rows, diseases).select(F.explode(F.array_except("listed", "had")).alias("disease"), "row_idx")


def cohort(points: DataFrame, diseases: DataFrame, config: Config) -> DataFrame:
    """Cases (label 1) and controls (label 0) of the listed diseases in all cells, two-class or not."""
    rows = with_list(patients(points, config), diseases)
    ill = F.filter("ill", lambda x: F.array_contains("listed", x["disease"]))
    rows = rows.select("sex", "row_idx", F.explode(F.concat(ill, _controls())).alias("c"))
    return rows.select("c.disease", "sex", "c.age", "row_idx", "c.seq_point", "c.label")


def cell_sizes(rows: DataFrame) -> DataFrame:
    """Sizes of the cells that have both classes, from cohort rows."""
    sums = rows.groupBy("disease", "sex", "age").agg(F.sum("label").cast("long").alias("n_diseased"), F.sum(1 - F.col("label")).cast("long").alias("n_healthy"))
    return sums.where("n_diseased > 0 AND n_healthy > 0")


def first_predictions(rows: DataFrame, config: Config) -> DataFrame:
    """row_idx, sex, had, age, seq_point: the point of each bracket at which a patient of patients() can be a control."""
    return rows.select("row_idx", "sex", "had", F.explode("firsts").alias("c")).select("row_idx", "sex", "had", "c.age", "c.seq_point").where("seq_point IS NOT NULL")


def cells(rows: DataFrame, diseases: DataFrame, config: Config) -> DataFrame:
    """cell_sizes() of the cohort of patients(), without a control row: all who have a first prediction, less those who had the disease.

    So the work grows with the diseases that patients have, not with those that they lack.
    """
    key = ["disease", "sex", "age"]
    diseased = cases(rows).join(diseases.select("disease").distinct(), "disease", "left_semi").groupBy(key).agg(F.count("*").alias("n_diseased"))
    firsts = first_predictions(rows, config)
    everyone = firsts.groupBy("sex", "age").agg(F.count("*").alias("n"))
    ill = firsts.select("sex", "age", F.explode(F.array_distinct("had")).alias("disease")).groupBy(key).agg(F.count("*").alias("n_ill"))
    found = diseased.join(everyone, ["sex", "age"]).join(ill, key, "left")
    healthy = F.col("n") - F.coalesce("n_ill", F.lit(0))
    return found.select(*key, "n_diseased", healthy.alias("n_healthy")).where("n_healthy > 0")


def with_absent(firsts: DataFrame, found: DataFrame) -> DataFrame:
    """first_predictions() with the diseases of the two-class cells that the patient lacks; as many cells as sexes and brackets meet them."""
    listed = found.groupBy("sex", "age").agg(F.collect_set("disease").alias("listed"))
    return firsts.join(listed, ["sex", "age"]).withColumn("absent", F.array_except("listed", "had")).drop("listed", "had")


def two_class(rows: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """Cohort rows of the two-class cells, from patients() and their cells()."""
    key = ["disease", "sex", "age"]
    columns = [*key, "row_idx", "seq_point", "label"]
    ill = cases(rows).join(found.select(key), key, "left_semi").withColumn("label", F.lit(1))
    # Not explode(): Spark would ask for the size of its list first, and make the list again for that.
    healthy = with_absent(first_predictions(rows, config), found).withColumn("disease", F.explode_outer("absent")).where("disease IS NOT NULL").withColumn("label", F.lit(0))
    return ill.select(columns).unionByName(healthy.select(columns))


def scoring_pairs(rows: DataFrame, found: DataFrame, config: Config) -> DataFrame:
    """Each (row_idx, seq_point) of two_class() once, without its rows."""
    key, pair = ["disease", "sex", "age"], ["row_idx", "seq_point"]
    ill = cases(rows).join(found.select(key), key, "left_semi").select(pair)
    return ill.unionByName(with_absent(first_predictions(rows, config), found).where(F.size("absent") > 0).select(pair)).distinct()


def bracket_counts(rows: DataFrame) -> DataFrame:
    """Targets by bracket, among targets()."""
    return rows.where("age IS NOT NULL").groupBy("age").agg(F.count("*").alias("n_targets"))
