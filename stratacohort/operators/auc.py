"""Stage 3b: tie-aware areas under the curve, with variances, by cell."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import scratch

CELL = ["disease", "sex", "age"]

#: Parts of an octave in the first level of ranges, and parts of such a range in the second: 9 and 21 of a double's 52 bits.
OCTAVE, FINE = 1 << 9, 1 << 21
#: The smallest normal double is 2 ** LEAST.
LEAST = -1022


def score_ranges(logit: Column) -> tuple[Column, Column]:
    """The range that a score is in, and the range within that: both in the order of scores, at any magnitude.

    They are the leading bits of the double: its power of two with the first 9 bits after it, and the next 21.  A first range has FINE
    second ones, and a second one 2 ** 22 doubles, so no level has more than that many to sort, whatever the scores are.
    """
    x = F.abs(logit.cast("double"))
    near = F.floor(F.log2(F.greatest(F.least(x, F.lit(1.7e308)), F.lit(2.0 ** LEAST))))  # may be one off, next to a power of two
    over = F.least(x, F.lit(1.7976931348623157e308)) / F.pow(F.lit(2.0), near)
    power = near + F.when(over >= 2, 1).when(over < 1, -1).otherwise(0)
    tiny = x < 2.0**LEAST
    rest = F.when(tiny, x * F.lit(2.0**-LEAST)).otherwise(over / F.pow(F.lit(2.0), power - near) - 1)  # exact, and in [0, 1)
    first = F.floor(rest * OCTAVE)
    second = F.floor((rest * OCTAVE - first) * FINE).cast("int")
    first = (F.when(tiny, LEAST - 1).otherwise(power) - (LEAST - 1)) * OCTAVE + first
    first = F.when(x == float("inf"), F.lit((2048) * OCTAVE)).otherwise(first).cast("int")
    low = logit < 0
    return F.when(low, -1 - first).otherwise(first), F.when(low, FINE - 1 - second).otherwise(second)


def placements(scored: DataFrame, cell: list[str] = CELL, used: list[str] | None = None, count: str | None = None, below: str | None = None) -> DataFrame:
    """One row for each cell and distinct score: its cases and controls, those with lower scores, and the cell's sizes m and n.

    A row stands for as many as its column `count` says, or one.  Counts are aggregated before the shuffle and written, as all levels read them: rows are
    made and scored once.  `used` and `below` say where, as for scratch.written().  What is sorted are distinct scores, not rows.  A cell is not sorted as a whole: running sums
    over its ranges of scores are added to running sums over the ranges within each, and these to running sums within those.
    """
    k = F.lit(1) if count is None else F.col(count)
    ties = scored.groupBy(*cell, "logit").agg(F.sum(F.col("label") * k).cast("long").alias("cases"), F.sum((1 - F.col("label")) * k).cast("long").alias("controls"))
    ties = scratch.written(ties, "ties", used, below=below)
    for c in [*cell, "logit"]:
        ties = ties.where(F.col(c).isNotNull())
    first, second = score_ranges(F.col("logit"))
    # Never null, so that no join below asks for it: Spark would push that question, all of the arithmetic, down to each row.
    ties = ties.withColumns({"range": F.coalesce(first, F.lit(0)), "part": F.coalesce(second, F.lit(0))})
    zero = F.lit(0).cast("long")
    sums = lambda rows, *by, c="c", h="h": rows.groupBy(*cell, *by).agg(F.sum(c).alias("c"), F.sum(h).alias("h"))
    before = lambda by, order: Window.partitionBy(*cell, *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)

    def below(c: str, h: str, window) -> dict[str, Column]:
        """Running sums of what is below, on top of what is below the range that the rows are in."""
        return {"c_below": F.coalesce(F.sum(c).over(window), zero) + F.col("c_below"), "h_below": F.coalesce(F.sum(h).over(window), zero) + F.col("h_below")}

    parts = sums(ties, "range", "part", c="cases", h="controls")
    whole = Window.partitionBy(*cell)
    ranges = sums(parts, "range").withColumns({"c_below": zero, "h_below": zero, "m": F.sum("c").over(whole), "n": F.sum("h").over(whole)})
    ranges = ranges.where("m > 0 AND n > 0").withColumns(below("c", "h", before([], "range"))).drop("c", "h")
    parts = parts.join(ranges, [*cell, "range"]).withColumns(below("c", "h", before(["range"], "part"))).drop("c", "h")
    rows = ties.join(parts, [*cell, "range", "part"]).withColumns(below("cases", "controls", before(["range", "part"], "logit")))
    return rows.drop("range", "part").withColumnsRenamed({"c_below": "cases_below", "h_below": "controls_below"})


#: Distinct scores of all cells, about 64 MB, that are broadcast to the rows; more are joined.
BROADCAST_SCORES = 1 << 19


def by_score(places: DataFrame, used: list[str] | None = None, most: int = BROADCAST_SCORES) -> DataFrame:
    """places as a table, to be joined with rows that have their scores: while there are few, no row moves.  Its path is added to `used`."""
    places = scratch.written(places, "places", used)
    return F.broadcast(places) if places.limit(most + 1).count() <= most else places


def midrank(scored: DataFrame, cell: list[str] = CELL, used: list[str] | None = None) -> DataFrame:
    """Rows of two-class cells with the average rank, from 1, of their logit in their cell."""
    rank = F.col("cases_below") + F.col("controls_below") + (F.col("cases") + F.col("controls") + 1) / F.lit(2.0)
    places = by_score(placements(scored, cell, used).select(*cell, "logit", rank.alias("midrank")), used)
    return scored.join(places, [*cell, "logit"])


def cell_auc(scored: DataFrame, cell: list[str] = CELL, used: list[str] | None = None, below: str | None = None) -> DataFrame:
    """Cells with both classes: auc, its DeLong variance var (NULL where a class has one row), n_diseased, n_healthy.

    A case's placement is the share of controls below it, ties half; the AUC is the cases' mean placement, and the
    variance sums both classes' sample variances of placements over their sizes.  Both are sums over distinct scores, of
    placements less one half, so that a cell's rows meet in partial sums alone.
    """
    half = F.lit(0.5)
    rows = placements(scored, cell, used, below=below)
    a = (F.col("controls_below") + half * F.col("controls")) / F.col("n") - half
    b = half - (F.col("cases_below") + half * F.col("cases")) / F.col("m")
    sums = rows.groupBy(*cell, "m", "n").agg(F.sum(F.col("cases") * a).alias("a"), F.sum(F.col("cases") * a * a).alias("aa"), F.sum(F.col("controls") * b).alias("b"), F.sum(F.col("controls") * b * b).alias("bb"))

    def spread(size, s, ss):
        """A class's sample variance of placements over its size."""
        return F.greatest(F.col(ss) - F.col(s) * F.col(s) / F.col(size), F.lit(0.0)) / F.nullif(F.col(size) - 1, F.lit(0)) / F.col(size)

    return sums.select(*cell, (half + F.col("a") / F.col("m")).alias("auc"), (spread("m", "a", "aa") + spread("n", "b", "bb")).alias("var"), F.col("m").alias("n_diseased"), F.col("n").alias("n_healthy"))


def delong_covariance(scored: DataFrame, cell: list[str] = CELL, subject: tuple[str, ...] = ("row_idx", "seq_point"), used: list[str] | None = None) -> DataFrame:
    """Covariances of the areas of several predictors on the same subjects, a row for each cell and pair of predictors a <= b.

    scored has a row for each predictor, cell, subject and label, with its logit.  Scores of a subject meet in one row, of as many places as there
    are predictors; covariances() does the rest.
    """
    logits = F.sort_array(F.collect_list(F.struct("predictor", "logit"))).alias("logits")
    return covariances(scored.groupBy(*cell, *subject, "label").agg(logits), cell, used)


def covariances(subjects: DataFrame, cell: list[str] = CELL, used: list[str] | None = None) -> DataFrame:
    """delong_covariance() of subjects with all their scores in one row: cell, label, logits array<struct<predictor, logit>>, by predictor.

    A subject's placement by a predictor is the share of the other class that it beats, less one half.  Subjects of like scores are counted before
    any shuffle and written; placements are of these counts, and covariances are sums of products of placements over these.  A subject that lacks a predictor is an error of the input: the
    pair's sums then cover different subjects, so such a pair is dropped.  Columns: auc_a, auc_b, cov (NULL where a class has one subject), n_diseased, n_healthy.
    """
    alike = scratch.written(subjects.groupBy(*cell, "label", "logits").agg(F.count("*").alias("k")), "alike", used)
    long = alike.select(*cell, "label", "k", F.explode("logits").alias("x")).select("x.predictor", *cell, "label", "x.logit", "k")
    beats = (F.col("controls_below") + F.col("controls") / F.lit(2.0)) / F.col("n") - 0.5, 0.5 - (F.col("cases_below") + F.col("cases") / F.lit(2.0)) / F.col("m")
    places = by_score(placements(long, ["predictor", *cell], used, "k").select("predictor", *cell, "logit", "m", "n", beats[0].alias("v1"), beats[1].alias("v0")), used)
    pairs = F.flatten(F.transform("logits", lambda a, i: F.transform(F.slice("logits", i + 1, F.size("logits")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    pairs = alike.select(*cell, "label", "k", F.explode(pairs).alias("x"))
    pairs = pairs.select(*cell, "label", "k", *[F.col(f"x.{p}.{c}").alias(f"{c}_{p}") for p in "ab" for c in ("predictor", "logit")])
    for p in "ab":
        of = places.withColumnsRenamed({c: f"{c}_{p}" for c in ("predictor", "logit", "m", "n", "v1", "v0")})
        pairs = pairs.join(of, [*cell, f"predictor_{p}", f"logit_{p}"])
    pairs = pairs.where("m_a = m_b AND n_a = n_b").withColumnsRenamed({"m_a": "m", "n_a": "n"})
    v = {p: F.when(F.col("label") == 1, F.col(f"v1_{p}")).otherwise(F.col(f"v0_{p}")) for p in "ab"}
    key = [*cell, "predictor_a", "predictor_b", "m", "n"]
    side = lambda of, what: F.sum(F.when(F.col("label") == of, F.col("k") * what))
    sums = pairs.groupBy(key).agg(*[side(of, what).alias(f"{name}{of}") for of in (0, 1) for name, what in (("a", v["a"]), ("b", v["b"]), ("ab", v["a"] * v["b"]), ("k", F.lit(1)))])
    sums = sums.where("k1 = m AND k0 = n")

    def spread(of: int, size: str) -> Column:
        return (F.col(f"ab{of}") - F.col(f"a{of}") * F.col(f"b{of}") / F.col(size)) / F.nullif(F.col(size) - 1, F.lit(0)) / F.col(size)

    area = lambda p: (F.lit(0.5) + F.col(f"{p}1") / F.col("m")).alias(f"auc_{p}")
    return sums.select(*cell, "predictor_a", "predictor_b", area("a"), area("b"), (spread(1, "m") + spread(0, "n")).alias("cov"), F.col("m").alias("n_diseased"), F.col("n").alias("n_healthy"))


def compare(covariances: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """Differences of two predictors' areas on the same cells: difference, its variance var, and z, which is NULL where the variance is none."""
    own = covariances.where("predictor_a = predictor_b").select(*cell, F.col("predictor_a").alias("p"), F.col("cov").alias("own"))
    rows = covariances.where("predictor_a < predictor_b")
    for side in ("a", "b"):
        rows = rows.join(own.withColumnsRenamed({"p": f"predictor_{side}", "own": f"own_{side}"}), [*cell, f"predictor_{side}"])
    var = F.when(F.col("cov").isNotNull(), F.greatest(F.col("own_a") + F.col("own_b") - 2 * F.col("cov"), F.lit(0.0)))
    rows = rows.withColumns({"difference": F.col("auc_a") - F.col("auc_b"), "var": var})
    z = F.when(F.col("var") > 1e-15, F.col("difference") / F.sqrt("var"))
    return rows.select(*cell, "predictor_a", "predictor_b", "difference", "var", z.alias("z"), "n_diseased", "n_healthy")


def auc_by_ranks(scored: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """The same AUC from midranks: (sum of the cases' ranks - m (m + 1) / 2) / (m n)."""
    rows = midrank(scored, cell)
    m, n = F.sum("label"), F.sum(1 - F.col("label"))
    ranks = F.sum(F.when(F.col("label") == 1, F.col("midrank")).otherwise(0.0))
    sums = rows.groupBy(*cell).agg(m.cast("double").alias("m"), n.cast("double").alias("n"), ranks.alias("r")).where("m > 0 AND n > 0")
    return sums.select(*cell, ((F.col("r") - F.col("m") * (F.col("m") + 1) / 2) / (F.col("m") * F.col("n"))).alias("auc"))
