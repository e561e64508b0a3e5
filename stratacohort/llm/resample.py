"""Irregular series resampling: the points of each key to clock-hour buckets with counts, covered time and exact integrals.

A Python UDTF reads the points partitioned by (key, block of time) in the order of their seconds; a row holds those of an hour, as
a call costs more than a point.  It holds one pending point and one open bucket.  A block also gets the first points of the hours that
begin within max_gap seconds after it (halo rows): the first of them ends the pending segment, no other is used.  What a segment covers beyond its block, and buckets that two blocks share, meet in a last
aggregation of partial buckets.

Memory and skew: points of one second are reduced to one before anything is ordered, so a block of one day holds at most 86,400
points, however hot the key; a hot key is as many groups as it has blocks.  The UDTF itself holds an hour, 3,600 points at most.  Nothing is
collected or broadcast.

Signals: "step" holds a value until the next point, max_gap seconds at most, and so does the last one; "linear" runs straight to the next
point if it is at most max_gap seconds away and covers nothing otherwise.  Integrals are integers: in a segment of d seconds from v to w,
twice the integral of the first u seconds is 2*v*u + floor((w-v)*u*u/d), and a bucket takes the difference between its ends.
Python's integers hold any size.

Edge cases: rows with a null key, time or value are dropped, and so are values that no 64-bit integer of `scale` units can hold (NaN,
infinities, 2**63 and more); in one second of one key the row with the largest tie-breaker stays (null is smallest), of equal ones that with the
largest value; repeated rows are one; times before 1970 floor downwards; an empty table gives an empty result; extra columns are
not read, whatever their names.  An area beyond 64 bits is null; its average is not.  Times without a zone are UTC.  Zone offsets are looked up
once for each quarter of an hour.
"""
from __future__ import annotations

from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR, QUARTER, DAY = 3600, 900, 86_400
#: Seconds of the years that Python's datetime has, less a day at both ends.
FIRST, LAST = -62_135_510_400, 253_402_214_400


def whole_seconds(df: DataFrame, ts: str) -> Column:
    """Seconds since 1970 UTC, floored, of a timestamp with or without a zone, whatever the session's zone is."""
    c = F.col(ts)
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        since = c - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        part = lambda unit: F.extract(F.lit(unit), since)
        micros = ((part("DAY") * 24 + part("HOUR")).cast("long") * 60 + part("MINUTE")) * 60_000_000 + (part("SECOND") * 1_000_000).cast("long")
    else:
        micros = F.unix_micros(c.cast("timestamp"))
    return ((micros - F.pmod(micros, F.lit(1_000_000))) / 1_000_000).cast("long")


def points(df: DataFrame, key: str, ts: str, value: str, tie: str, scale: int = 100) -> DataFrame:
    """__key, __t (whole seconds), __v (value in units of 1/scale, rounded half up): one row for each key and second."""
    units = F.floor(F.col(value) * scale + 0.5) if isinstance(df.schema[value].dataType, T.DecimalType) else F.floor(F.col(value).cast("double") * scale + F.lit(0.5))
    inside = F.col(value).cast("double").between(-9.2e18 / scale, 9.2e18 / scale)  # false for NaN, null for null
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & inside)
    rows = rows.select(F.col(key).alias("__key"), whole_seconds(df, ts).alias("__t"), F.struct(F.col(tie).alias("tie"), units.cast("long").alias("v")).alias("__p"))
    return rows.groupBy("__key", "__t").agg(F.max("__p")["v"].alias("__v"))


def _udtf(key_type: str, linear: bool, gap: int, zone: str, block: int):
    """The table function; its settings travel with it."""

    offsets: dict[int, int] = {}  # by quarter of an hour, of one worker

    class Buckets:
        def __init__(self):
            self.key = self.t = self.v = self.start = None
            self.n = self.covered = self.area = 0

        def move(self, t: int, out: list) -> None:
            """Open the bucket that holds second t, and give out the one before."""
            if self.start is not None and t < self.start + HOUR:
                return
            self.flush(out)
            quarter = t // QUARTER
            offset = offsets.get(quarter)
            if offset is None:
                if len(offsets) > 100_000:
                    offsets.clear()
                at = datetime.fromtimestamp(max(FIRST, min(LAST, quarter * QUARTER)), timezone.utc)
                offset = offsets[quarter] = int(at.astimezone(ZoneInfo(zone)).utcoffset().total_seconds())
            self.start = t - (t + offset) % HOUR

        def flush(self, out: list) -> None:
            if self.n or self.covered:
                out.append((self.key, self.start, self.n, self.covered, self.area >> 32, self.area & 0xFFFFFFFF))
            self.n = self.covered = self.area = 0

        def cover(self, d: int, w: int, out: list) -> None:
            """Deal the d seconds from the pending point to value w out to buckets."""
            t, v, u, done = self.t, self.v, 0, 0
            while u < d:
                self.move(t + u, out)
                upto = min(d, self.start + HOUR - t)
                so_far = 2 * v * upto + (w - v) * upto * upto // d
                self.covered += upto - u
                self.area += so_far - done
                u, done = upto, so_far

        def point(self, t: int, v: int, own: bool, out: list) -> None:
            if self.t is not None:
                d = t - self.t
                if d <= gap:
                    self.cover(d, v if linear else self.v, out)
                elif not linear:
                    self.cover(gap, self.v, out)
                self.t = None
            if own:
                self.move(t, out)
                self.n += 1
                self.t, self.v = t, v

        def eval(self, row):
            self.key, start, times, values = row[:4]
            end, out = start + block, []
            for t, v in zip(times, values):
                self.point(t, v, t < end, out)
            return out

        def terminate(self):
            out = []
            if self.t is not None and not linear:
                self.cover(gap, self.v, out)
            self.flush(out)
            return out

    return F.udtf(Buckets, returnType=f"key {key_type}, bucket_start bigint, n bigint, covered bigint, high bigint, low bigint")


def resample(df: DataFrame, key: str, ts: str, value: str, tie: str, zone: str = "UTC", signal: str = "linear", max_gap: int = HOUR, scale: int = 100, block: int = DAY) -> DataFrame:
    """key, bucket_start (epoch seconds), n_points, covered_seconds, area2 and avg of each clock hour of `zone` that holds points or covered time."""
    if signal not in ("linear", "step") or not 0 < max_gap <= block or block % HOUR:
        raise ValueError("signal is linear or step, and max_gap is positive and at most a block, which is whole hours")
    found = points(df, key, ts, value, tie, scale)
    of = lambda t, width: t - F.pmod(t, F.lit(width))
    rows = found.groupBy("__key", of(F.col("__t"), HOUR)).agg(F.array_sort(F.collect_list(F.struct("__t", "__v"))).alias("p"))
    first = F.col("p")[0]["__t"]
    own = F.struct(of(first, block).alias("b"), F.col("p"))
    halo = F.struct((of(first, block) - block).alias("b"), F.slice("p", 1, 1).alias("p"))
    dealt = rows.select("__key", F.explode(F.when(F.pmod(first, F.lit(block)) < max_gap, F.array(own, halo)).otherwise(F.array(own))).alias("x"))
    dealt = dealt.select(F.col("__key").alias("key"), F.col("x.b").alias("block"), F.col("x.p.__t").alias("t"), F.col("x.p.__v").alias("v"))
    series = dealt.asTable().partitionBy("key", "block").orderBy(F.col("t")[0])
    partial = _udtf(df.schema[key].dataType.simpleString(), signal == "linear", max_gap, zone, block)(series)
    buckets = partial.groupBy("key", "bucket_start").agg(F.sum("n").alias("n"), F.sum("covered").alias("covered"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    area = F.col("high").cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("low")
    buckets = buckets.withColumn("area", area.cast("decimal(38,0)")).withColumn("of", (2 * F.col("covered")).cast("decimal(20,0)"))
    average = F.when(F.col("covered") > 0, F.expr("(area - pmod(area, of)) div of"))
    return buckets.select(
        F.col("key").alias(key), "bucket_start", F.col("n").alias("n_points"), F.col("covered").alias("covered_seconds"),
        F.col("area").try_cast("long").alias("area2"), average.alias("avg"),
    )
