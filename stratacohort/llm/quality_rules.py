"""Quality rules as weak supervision (native DataFrame code throughout).

Every rule votes good (1), bad (-1) or abstains (0) on a document; a vote needs a clear case, and what lies between
its two thresholds is an abstention.  A two-class latent model with, for each rule, its rate of bad votes among good and
among bad documents (abstentions carry no weight) is fitted by expectation maximisation, without labels, and the
posterior probability of "good" takes the place of all-must-pass filtering.  The fit ends when no rate moves by TOLERANCE
any more, after ROUNDS rounds at the latest; `converged` says whether it did.

No two rules count the same thing, but each fault is seen from two sides, since the model can't tell what a single rule
sees from that rule's own errors: marks (symbols counted; words that are made of letters and digits alone), repeats (repeated windows of
words; distinct words in blocks of 64; repeated lines), shouting (runs of capitals; marks that end sentences).  All are shares, so that a
text's length moves none.

Documents matter to the fit only through their vote pattern, of which there are at most 3 ** (number of rules).  So the
corpus is reduced by one hash aggregation to a table of patterns with counts, the whole fit is one expression over
that table, and the posteriors, one for each pattern, are joined back by broadcast: its size is bounded by the
rules, not by the data.  Votes are written once to the shared folder, so that texts are read and split a single time.

Edge cases: a null or empty text has no words, fails the base and is not kept; texts of any length are taken whole;
repeated rows are judged alike; an empty table gives an empty result; input columns with the names of outputs are
replaced, all others pass through.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, aside, let, restored, written

SYMBOLS = "[#*$%&|<>]"
#: A word of letters and digits, with the marks that may end it.
PLAIN = r"(?<!\S)[\p{L}\p{M}\p{Nd}'\u2019-]++[.,;:!?]*+(?!\S)"
WINDOW = 8
#: Words in a block whose distinct words are counted.
BLOCK = 64
ROUNDS = 400
TOLERANCE = 1e-10
#: Bounds of a rule's rates, so that no rule alone is ever certain.
LEAST, MOST = 0.005, 0.995
#: Share of good documents at the start.
PRIOR = 0.8
MIN_POSTERIOR = 0.5


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def repeat_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words, given by their hashes, that lie in a window of so many words that the text holds twice or more."""
    def windows(h: Column) -> Column:
        last = F.size(h) - window
        each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)]))
        return F.when(last < 0, F.array().cast("array<bigint>")).otherwise(each)

    def covered(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda r: F.filter(r, lambda x, k: (x["h"] == F.get(r, k - 1)["h"]) | (x["h"] == F.get(r, k + 1)["h"]))
        places = F.array_sort(F.transform(let(ranked, twice), lambda x: x["i"]))
        step = lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(window)), F.lit(window))), F.lit(0).cast("long"), lambda n, x: n + x
        )
        return let(places, step)

    return let(windows(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))


def block_distinct(hashes: Column, block: int = BLOCK) -> Column:
    """Distinct words of every block of so many words, added up."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(hashes) - 1, F.lit(0)), F.lit(block))
    return F.aggregate(starts, F.lit(0).cast("long"), lambda n, i: n + F.size(F.array_distinct(F.slice(hashes, i + 1, block))))


def _counts(text: Column) -> Column:
    """All counts of one text as a struct; its words are split once."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "")

    def of(w: Column) -> Column:
        hashed = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.struct(repeat_words(h).alias("n_repeat_words"), block_distinct(h).alias("n_block_distinct")))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda v: F.struct((F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"), F.size(v).cast("long").alias("n_lines"))).alias("l"),
            hashed.alias("h"),
            F.regexp_count(whole, F.lit(r"\p{Lu}\p{Lu}+")).cast("long").alias("n_capitals"),
            F.regexp_count(whole, F.lit(PLAIN)).cast("long").alias("n_plain"),
            F.regexp_count(whole, F.lit("[.,;:!?]")).cast("long").alias("n_marks"),
        )

    counts = let(words_of(text), of)
    return let(counts, lambda c: F.struct(*[c[x].alias(x) for x in ("n_words", "word_chars", "n_symbols")], c["l"]["n_dup_lines"].alias("n_dup_lines"), c["h"]["n_repeat_words"].alias("n_repeat_words"), *[c[x].alias(x) for x in ("n_capitals", "n_plain", "n_marks")], c["h"]["n_block_distinct"].alias("n_block_distinct"), c["l"]["n_lines"].alias("n_lines")))


def _ratio_vote(part: Column, whole: Column, good_pct: int, bad_pct: int) -> Column:
    """Good up to good_pct percent, bad from bad_pct percent on."""
    return F.when(whole == 0, 0).when(100 * part <= good_pct * whole, 1).when(100 * part >= bad_pct * whole, -1).otherwise(0)


def _share_vote(part: Column, whole: Column, bad_pct: int, good_pct: int) -> Column:
    """Bad up to bad_pct percent, good from good_pct percent on."""
    return -_ratio_vote(part, whole, bad_pct, good_pct)


#: Rules by name: votes from the counts.  The percentages are of words, n_dup_lines' of lines.
RULES = {
    "length": lambda c: F.when(c["n_words"] < 20, -1).when(c["n_words"] >= 40, 1).otherwise(0),
    "symbols": lambda c: _ratio_vote(c["n_symbols"], c["n_words"], 5, 25),
    "plain": lambda c: _share_vote(c["n_plain"], c["n_words"], 70, 90),
    "repeats": lambda c: _ratio_vote(c["n_repeat_words"], c["n_words"], 10, 30),
    "variety": lambda c: _share_vote(c["n_block_distinct"], c["n_words"], 45, 65),
    "lines": lambda c: _ratio_vote(c["n_dup_lines"], c["n_lines"], 10, 50),
    "capitals": lambda c: _ratio_vote(c["n_capitals"], c["n_words"], 5, 25),
    "marks": lambda c: _ratio_vote(c["n_marks"], c["n_words"], 40, 80),
}


def fit(patterns: DataFrame, n_rules: int, rounds: int = ROUNDS) -> DataFrame:
    """patterns(votes array<int>, n bigint) with the posterior of each, the model, its rounds and whether it converged within them: one row collects all patterns, at most 3 ** n_rules."""
    rules = range(n_rules)
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p"))

    def posterior(v: Column, m: Column) -> Column:
        log = F.log(m["prior"] / (1 - m["prior"]))
        for j in rules:
            good, bad = m["good"][j], m["bad"][j]
            log = log + F.when(v[j] == -1, F.log(good / bad)).when(v[j] == 1, F.log((1 - good) / (1 - bad))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-log))

    def total(p: Column, f) -> Column:
        return F.aggregate(p, F.lit(0.0), lambda s, x: s + f(x))

    def bounded(a: Column, b: Column) -> Column:
        return F.when(b > 0, F.greatest(F.lit(LEAST), F.least(F.lit(MOST), a / F.when(b > 0, b)))).otherwise(F.lit(0.5))

    def model(q: Column) -> Column:
        """From patterns with weights g (good) and b (bad)."""
        rate = lambda w: F.array(*[bounded(total(q, lambda x: F.when(x["votes"][j] == -1, x[w]).otherwise(0.0)), total(q, lambda x: F.when(x["votes"][j] != 0, x[w]).otherwise(0.0))) for j in rules])  # noqa: B023, E731
        return F.struct(bounded(total(q, lambda x: x["g"]), total(q, lambda x: x["n"].cast("double"))).alias("prior"), rate("g").alias("good"), rate("b").alias("bad"))

    def weighed(p: Column, share) -> Column:
        return F.transform(p, lambda x: let(share(x), lambda g: F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * g).alias("g"), (x["n"] * (1 - g)).alias("b"))))

    # At the start a document with a bad vote counts as mostly bad.
    start = lambda x: F.when(F.array_contains(x["votes"], -1), F.lit(1 - PRIOR)).otherwise(F.lit(PRIOR))
    def moved(a: Column, b: Column) -> Column:
        """Whether a rate of b is not that of a."""
        far = lambda x, y: F.abs(x - y) > TOLERANCE
        out = far(a["prior"], b["prior"])
        for j in rules:
            out = out | far(a["good"][j], b["good"][j]) | far(a["bad"][j], b["bad"][j])
        return out

    state = lambda m, rounds, going: F.struct(m.alias("m"), rounds.alias("rounds"), going.alias("going"))
    fitted = one.select("p", state(let(weighed(F.col("p"), start), model), F.lit(0), F.lit(True)).alias("s"))
    better = lambda m: let(weighed(F.col("p"), lambda x: posterior(x["votes"], m)), model)
    step = lambda s, _: F.when(s["going"], let(better(s["m"]), lambda m: state(m, s["rounds"] + 1, moved(s["m"], m)))).otherwise(s)
    fitted = fitted.select("p", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.col("s"), step).alias("s")).select("p", "s.m", "s.rounds", (~F.col("s.going")).alias("converged"))
    return fitted.select(F.explode("p").alias("x"), "m", "rounds", "converged").select("x.votes", "x.n", posterior(F.col("x.votes"), F.col("m")).alias("p_good"), "m", "rounds", "converged")


def judge(docs: DataFrame, text: str = "text", carry: list[str] | None = None, rules: dict | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The columns in carry (all, if None) with the counts, base_failed, votes, p_good, kept and converged: false in all rows if `rounds` were not enough."""
    rules = RULES if rules is None else rules
    carry = docs.columns if carry is None else carry
    counts = docs.select(*carry, F.col(text).alias("__text")).select(*carry, _counts(F.col("__text")).alias("__c"))
    names = counts.schema["__c"].dataType.names
    carry = [c for c in carry if c not in {*names, "votes", "base_failed", "p_good", "kept", "converged"}]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    votes = F.array(*[rule(F.col("__c")).cast("int") for rule in rules.values()])
    seen = written(counts.select(*carry, "__c.*", votes.alias("votes")).withColumn("base_failed", failed), "quality-votes")
    patterns = seen.groupBy("votes").agg(F.count("*").alias("n"))
    fitted = fit(patterns, len(rules), rounds).select("votes", "p_good", "converged")
    out = seen.join(F.broadcast(fitted), "votes")  # at most 3 ** rules rows
    kept = ~F.col("base_failed") & (F.col("p_good") >= MIN_POSTERIOR)
    return out.withColumn("kept", kept).select(*carry, *names, "votes", "base_failed", "p_good", "kept", "converged")


def reject(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without those that are not kept."""
    rows, names = aside(docs)
    return restored(judge(rows, names[text]).where("kept"), names)
