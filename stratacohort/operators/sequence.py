"""Stage 1: from token sequences to aged and located diagnosis points."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import YEAR_Q, Config
from ..functions import tokens as tk
from ..sources import scratch


def history_filter(traj: DataFrame, config: Config) -> DataFrame:
    return traj.where(F.col("token_count_thru_2022") + 1 >= config.min_history)


def _last(config: Config) -> str:
    """The column with the place of the last token."""
    return "total_token_count" if config.longitudinal else "token_count_thru_2022"


def truncate(traj: DataFrame, config: Config) -> DataFrame:
    """traj with tokens (the history, or all if longitudinal), n_tok and eval_seq."""
    tokens = F.slice(tk.split_tokens(F.col("seq")), F.lit(1), F.greatest(F.col(_last(config)) + 1, F.lit(0)))
    return traj.withColumn("tokens", tokens).withColumns({"n_tok": F.size("tokens"), "eval_seq": F.array_join("tokens", " ")})


#: Tokens, before they are filtered, of the patients that a task walks: their number is known from a count column.
TASK_TOKENS = 1 << 19


def by_tokens(traj: DataFrame, config: Config) -> int | None:
    """Partitions for truncated trajectories by TASK_TOKENS; None if they lack the count."""
    if _last(config) not in traj.columns:
        return None
    n = traj.agg(F.sum(F.greatest(F.col(_last(config)) + 1, F.lit(0)).cast("long"))).head()[0]
    return scratch.tasks_for(traj.sparkSession, n, TASK_TOKENS)


def walked(traj: DataFrame, config: Config) -> DataFrame:
    """The tokens that move a walk (new years, gaps, ages, diagnoses) of truncated sequences: row_idx, sex, pos, token, n_tok, start_age, walks.

    Classes are filtered before anything is shuffled, to partitions of TASK_TOKENS tokens.  walks is false before the demographic prefix ends and from
    the length cap on; gaps there only count as places of visits.
    """
    start_age = tk.number(F.get("tokens", config.age_index))
    sex = tk.sex(F.col("tokens"), config.sex_index)
    rows = traj.select("row_idx", sex.alias("sex"), "n_tok", start_age.alias("start_age"), F.posexplode("tokens").alias("pos", "token"))
    token = F.col("token")
    rows = rows.where(token.startswith(tk.NEW_YEAR) | token.startswith(tk.GAP) | token.startswith(tk.AGE) | token.startswith(tk.DISEASE))
    rows = rows.repartition(by_tokens(traj, config), "row_idx")
    return rows.withColumn("walks", (F.col("pos") >= config.demo_end_index) & (F.col("pos") < F.least("n_tok", F.lit(config.max_length))))


def with_visits(rows: DataFrame) -> DataFrame:
    """Adds v, the gaps walked so far, and loc, the place of the next visit: gap number v + 1 of the whole sequence, or its last token.

    A gap's own number counts all gaps, walked or not.  In the order of these numbers each other row comes right after the gap that it asks
    for, so the last gap passed is the one, if it has that number: a running window, and no row carries the gaps of its patient.
    loc means nothing on the gaps themselves.
    """
    gap = F.col("token").startswith(tk.GAP)
    so_far = Window.partitionBy("row_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"v": F.sum(F.when(gap & F.col("walks"), 1).otherwise(0)).over(so_far), "__gap": F.sum(F.when(gap, 1).otherwise(0)).over(so_far)})
    rows = rows.withColumn("__asks", F.when(gap, F.col("__gap")).otherwise(F.col("v") + 1))
    by_number = Window.partitionBy("row_idx").orderBy("__asks", F.when(gap, 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__last", F.last(F.when(gap, F.struct("__gap", "pos")), ignorenulls=True).over(by_number))
    found = F.when(F.col("__last.__gap") == F.col("__asks"), F.col("__last.pos"))
    return rows.withColumn("loc", F.coalesce(found, F.col("n_tok") - 1)).drop("__gap", "__asks", "__last")


def running_age(rows: DataFrame, config: Config) -> DataFrame:
    """Adds yrs and day, which a new year resets; what is not walked moves neither."""
    so_far = Window.partitionBy("row_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    token = F.col("token")
    new_year = F.col("walks") & token.startswith(tk.NEW_YEAR)
    gap = F.when(F.col("walks") & token.startswith(tk.GAP), tk.number(token) * config.gap_days).otherwise(0)
    rows = rows.withColumns({"yrs": F.sum(F.when(new_year, 1).otherwise(0)).over(so_far), "__days": F.sum(gap).over(so_far)})
    before = F.last(F.when(new_year, F.col("__days")), ignorenulls=True).over(so_far)  # all days up to the last new year
    return rows.withColumn("day", F.col("__days") - F.coalesce(before, F.lit(0))).drop("__days")


def aged(rows: DataFrame, config: Config) -> DataFrame:
    """Adds q, the age in quarter-days: relative to the last new year, or set by age and gap tokens if absolute."""
    if not config.absolute:
        return running_age(rows, config).withColumn("q", ((F.col("start_age") + F.col("yrs")) * YEAR_Q + 4 * F.col("day")).cast("long"))
    token = F.col("token")
    so_far = Window.partitionBy("row_idx").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda kind, value: F.last(F.when(F.col("walks") & token.startswith(kind), value), ignorenulls=True).over(so_far)
    years = F.coalesce(last(tk.AGE, tk.number(token)), F.col("start_age"))
    days = F.coalesce(last(tk.GAP, tk.number(token) * config.gap_days), F.lit(0))
    return rows.withColumn("q", (years * YEAR_Q + 4 * days).cast("long"))


def points(traj: DataFrame, config: Config) -> DataFrame:
    """Diagnoses of truncated sequences: row_idx, sex, token, pos, q, loc; the first of each token, or all."""
    rows = with_visits(aged(walked(traj, config), config)).where(F.col("walks") & F.col("token").startswith(tk.DISEASE))
    rows = rows.select("row_idx", "sex", "token", F.col("pos").cast("long").alias("pos"), "q", F.col("loc").cast("long").alias("loc"))
    if not config.first_occurrence:
        return rows
    # Numbers, not a struct of them, which would be aggregated by another sort.
    return rows.groupBy("row_idx", "sex", "token").agg(F.min("pos").alias("pos"), F.min_by("q", "pos").alias("q"), F.min_by("loc", "pos").alias("loc"))


def enough_points(rows: DataFrame, config: Config) -> DataFrame:
    """Points of patients with at least min_points, numbered k from 0."""
    whole = Window.partitionBy("row_idx")
    rows = rows.withColumn("k", F.row_number().over(whole.orderBy("pos")).cast("long") - 1)  # first, so that its order serves the count too
    return rows.withColumn("__n", F.count("*").over(whole)).where(F.col("__n") >= config.min_points).drop("__n")


def stage1(traj: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(truncated trajectories, their points)."""
    kept = truncate(history_filter(traj, config), config)
    return kept, enough_points(points(kept, config), config)


def filter_ids(traj: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose enrollee_id, as a string, is listed."""
    if "enrollee_id" not in traj.columns:
        raise ValueError("an id filter needs the column enrollee_id")
    listed = ids.select(F.col("id").alias("__id"))
    return traj.join(listed, F.col("enrollee_id").cast("string") == F.col("__id"), "left_semi")


#: Row numbers in a block that head_fraction counts at once.
HEAD_BLOCK = 1 << 16


def head_fraction(traj: DataFrame, frac: float, n: int | None = None) -> DataFrame:
    """The first int(n * frac) rows by row_idx, which is distinct but may have gaps; n is counted unless given.

    Rows are counted by blocks of row numbers; only these counts and the numbers in the block of the last row reach the driver.
    """
    block = F.floor(F.col("row_idx") / HEAD_BLOCK)
    counts = sorted(tuple(r) for r in traj.groupBy(block).count().collect())
    left = int((sum(c for _, c in counts) if n is None else n) * frac)
    if left <= 0:
        return traj.where(F.lit(False))
    for b, c in counts:
        if left <= c:
            last = sorted(r["row_idx"] for r in traj.where(block == b).select("row_idx").collect())[left - 1]
            return traj.where(F.col("row_idx") <= last)
        left -= c
    return traj


#: Hexadecimal digits by which sample_exact narrows its bound down, and rows that it looks at one by one.
SAMPLE_DIGITS, SAMPLE_ROWS = 4, 4096


def sample_exact(traj: DataFrame, n: int, seed: int = 42, id_col: str = "person_id") -> DataFrame:
    """n rows, or all if there are fewer: those with the smallest md5 of "id:seed", then row_idx, whatever the partitions.

    The bound is found by counting rows by more and more digits of the hash: counts of 16 ** SAMPLE_DIGITS groups and the last few rows reach the
    driver, and no row is shuffled.  row_idx is distinct; ids may be null or repeated, however often.
    """
    hashed = traj.withColumn("__h", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))
    inside, digits, left = hashed, "", n
    while True:
        groups = sorted(tuple(r) for r in inside.groupBy(F.substring("__h", len(digits) + 1, SAMPLE_DIGITS)).count().collect())
        if sum(c for _, c in groups) <= left:
            return traj
        for group, count in groups:
            if left < count:
                break
            left -= count
        digits += group
        inside = hashed.where(F.substring("__h", 1, len(digits)) == digits)
        if count > SAMPLE_ROWS and len(digits) == 32:  # one id, or none, has all these rows: their first by row_idx
            last = head_fraction(inside, 1.0, left).agg(F.max("row_idx")).head()[0] if left else None
            within = (F.col("__h") == digits) & (F.col("row_idx") <= last) if left else F.lit(False)
            return hashed.where((F.col("__h") < digits) | within).drop("__h")
        if count <= SAMPLE_ROWS:
            last = sorted((r["__h"], r["row_idx"]) for r in inside.select("__h", "row_idx").collect())[left]
            return hashed.where((F.col("__h") < last[0]) | (F.col("__h") == last[0]) & (F.col("row_idx") < last[1])).drop("__h")


def not_empty(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"no rows left after {what}")
    return rows
