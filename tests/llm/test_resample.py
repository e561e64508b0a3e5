"""Resampling against a plain version over all points of a key, with fractions."""
import collections
import datetime
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from stratacohort.llm import resample

SCHEMA = "client_id long, ts timestamp_ntz, value double, click_id long, bucket_start string, key int"
START = datetime.datetime(2024, 3, 1)


def brute(rows, signal, zone_offset=19800, gap=3600):
    """client, bucket: (points, covered, twice the area, average), second by second sums replaced by exact pieces."""
    best = {}
    for client, ts, value, click, *_ in rows:
        if client is None or ts is None or value is None or math.isnan(value) or abs(value) > 9e16:
            continue
        t = math.floor(Fraction((ts - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1), 10**6))
        v = math.floor(100 * value + 0.5)
        rank = (-math.inf if click is None else click, v)
        if (client, t) not in best or best[client, t] < rank:
            best[client, t] = rank
    series = collections.defaultdict(list)
    for (client, t), (_, v) in sorted(best.items()):
        series[client].append((t, v))
    out = collections.defaultdict(lambda: [0, 0, 0])
    bucket = lambda t: t - (t + zone_offset) % 3600
    for client, points in series.items():
        for i, (t, v) in enumerate(points):
            out[client, bucket(t)][0] += 1
            follows = points[i + 1] if i + 1 < len(points) else None
            if signal == "step":
                d, w = min(gap, follows[0] - t) if follows else gap, v
            elif follows and follows[0] - t <= gap:
                d, w = follows[0] - t, follows[1]
            else:
                continue
            upto = lambda u: 2 * v * u + math.floor(Fraction((w - v) * u * u, d))  # noqa: B023, E731
            at = 0
            while at < d:
                b = bucket(t + at)
                to = min(d, b + 3600 - t)
                out[client, b][1] += to - at
                out[client, b][2] += upto(to) - upto(at)
                at = to
    return {k: (n, c, a if -(2**63) <= a < 2**63 else None, math.floor(Fraction(a, 2 * c)) if c else None) for k, (n, c, a) in out.items()}


def got_of(frame, signal="linear", **options):
    rows = resample.resample(frame, "client_id", "ts", "value", "click_id", "Asia/Kolkata", signal, **options).collect()
    out = {(r["client_id"], r["bucket_start"]): (r["n_points"], r["covered_seconds"], r["area2"], r["avg"]) for r in rows}
    assert len(out) == len(rows)
    return out


def series(seed):
    rnd, rows = random.Random(seed), []
    for client in (1, 2, 3, -4, 5):
        t = START + datetime.timedelta(seconds=rnd.randint(0, 90_000))
        for k in range(rnd.choice([1, 30, 400])):
            t += datetime.timedelta(seconds=rnd.choice([0, 0.4, 1, 60, 1800, 3599, 3600, 3601, 40_000, 90_000]) if client != 5 else 60)
            rows.append((client, t, rnd.choice([-1, 1]) * rnd.choice([0.0, 0.005, 1.234, 77.7, 1e9, 4e14]), rnd.randint(0, 10**6), "x", 1))
    rows += rnd.sample(rows, len(rows) // 5)  # repeated rows
    rows += [(None, START, 1.0, 1, "x", 1), (1, None, 1.0, 1, "x", 1), (1, START, None, 1, "x", 1), (1, START, float("nan"), 1, "x", 1), (1, START, float("inf"), 1, "x", 1), (1, START, -1e300, 1, "x", 1)]
    # Ties: the largest click, a null one never, of equal clicks the largest value; times before 1970; the last seconds of a block.
    rows += [(7, START, 1.0, 3, "x", 1), (7, START, 2.0, 4, "x", 1), (7, START + datetime.timedelta(microseconds=999_999), 5.0, None, "x", 1), (8, START, 1.0, 3, "x", 1), (8, START, 9.0, 3, "x", 1)]
    rows += [(9, datetime.datetime(1969, 12, 31, 23, 59, 58, 500_000), 1.0, 1, "x", 1), (9, datetime.datetime(1970, 1, 1, 0, 0, 1), 3.0, 1, "x", 1), (9, datetime.datetime(1951, 7, 1), 3.0, 1, "x", 1)]
    rows += [(10, START + datetime.timedelta(seconds=86_399), 1.0, 1, "x", 1), (10, START + datetime.timedelta(seconds=86_399 + 3600), -7.77, 1, "x", 1), (10, START + datetime.timedelta(days=9, seconds=-1), 7.0, 2, "x", 1)]
    return rows


@pytest.mark.parametrize("signal", ["linear", "step"])
@pytest.mark.parametrize("block", [86_400, 3600, 7 * 86_400])
def test_against_a_plain_version(spark, signal, block):
    rows = series(block)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got_of(frame, signal, block=block) == brute(rows, signal)


def test_big_values(spark):
    """Products pass 64 bits; areas that do are null, their averages are not."""
    day = datetime.timedelta(seconds=3000)
    rows = [(1, START, 9.0e16 / 1000, 1, "x", 1), (1, START + day, -8.9e16 / 1000, 1, "x", 1), (2, START, 9.0e16, 1, "x", 1), (2, START + day, 9.0e16, 1, "x", 1)]
    got = got_of(spark.createDataFrame(rows, SCHEMA))
    assert got == brute(rows, "linear") and any(x[2] is None and x[3] for x in got.values())


def test_zones_and_sessions(spark):
    """Times with and without a zone, whatever the session's zone is; clock hours of a zone with half hours and of one with summer time."""
    rows = series(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.session.timeZone")
    zoned = frame.withColumn("ts", F.col("ts").cast("timestamp"))  # the session is in UTC
    want = got_of(frame)
    assert got_of(zoned) == want
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert got_of(spark.createDataFrame(rows, SCHEMA)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for zone in ("UTC", "Europe/Berlin"):
        out = resample.resample(frame, "client_id", "ts", "value", "click_id", zone)
        assert {(r["client_id"], r["bucket_start"]): (r["n_points"], r["covered_seconds"], r["area2"], r["avg"]) for r in out.where("bucket_start > 0").collect()} == {k: v for k, v in brute(rows, "linear", 0).items() if k[1] > 0}


def test_hot_keys_are_many_groups(spark):
    """A hot key is dealt out by blocks, and nothing is gathered or broadcast."""
    frame = spark.range(0, 200_000, 20).select(F.lit(1).cast("long").alias("client_id"), F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), (F.col("id") % 7).cast("double").alias("value"), F.col("id").alias("click_id"))
    out = resample.resample(frame, "client_id", "ts", "value", "click_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SinglePartition" not in plan
    got = {r["bucket_start"]: (r["n_points"], r["covered_seconds"]) for r in out.collect()}
    assert got == {b: (180, 3600) if b < 198_000 else (100, 1980) for b in range(0, 200_000, 3600)}


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert resample.resample(none, "client_id", "ts", "value", "click_id").count() == 0
    text = spark.createDataFrame([("a", START, 1.5, 1)], "k string, ts timestamp_ntz, v float, c int")
    r = resample.resample(text, "k", "ts", "v", "c", signal="step", scale=10).collect()
    assert [tuple(x) for x in r] == [("a", int(START.replace(tzinfo=datetime.timezone.utc).timestamp()), 1, 3600, 2 * 15 * 3600, 15)]
    for bad in ({"signal": "cubic"}, {"max_gap": 0}, {"block": 1800}, {"max_gap": 7200, "block": 3600}):
        with pytest.raises(ValueError):
            resample.resample(none, "client_id", "ts", "value", "click_id", **bad)
