"""Trajectories derived from the star-schema tables: customers are patients, orders visits, parts diagnoses."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import scratch

BASE_YEAR = 1995
HISTORY_END = "2000-01-01"
#: Rows of lineitem, and of orders with their tokens, that a task sorts: their numbers are in the footers of the files.
TASK_ITEMS, TASK_VISITS = 1 << 20, 1 << 17


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_idx, person_id, seq, token_count_thru_2022, total_token_count."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    brand, kind = F.regexp_replace("p_brand", "[^0-9]", ""), F.substring("p_type", 1, 1)
    parts = read("part").select("p_partkey", F.concat(F.lit("<DX-MAJOR_B"), brand, kind, F.lit(">")).alias("dx"))
    items = read("lineitem").select("l_orderkey", "l_partkey")
    by_order = scratch.tasks_for(spark, items.count(), TASK_ITEMS)
    items = items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "dx").repartition(by_order, "l_orderkey")
    dx = items.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("dx")).alias("dx"))
    orders = read("orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).alias("visit"))
    by_patient = scratch.tasks_for(spark, orders.count(), TASK_VISITS)
    orders = orders.repartition(by_order, "o_orderkey").join(dx, "o_orderkey", "left").repartition(by_patient, "o_custkey")

    in_order = Window.partitionBy("o_custkey").orderBy("day", "o_orderkey")
    last = F.lag("day").over(in_order)
    years = F.year("day") - F.coalesce(F.year(last), F.lit(BASE_YEAR))
    gap = F.when(F.year(last) == F.year("day"), F.datediff("day", last)).otherwise(F.dayofyear("day") - 1)
    orders = orders.withColumns({"years": years, "gap": gap})
    gap_token, visit_token = F.concat(F.lit("<ATT-"), F.col("gap").cast("string"), F.lit(">")), F.concat(F.lit("<VT-"), "visit", F.lit(">"))
    tokens = F.concat(F.array_repeat(F.lit("<NY>"), F.col("years")), F.array(gap_token, visit_token), F.coalesce("dx", F.array().cast("array<string>")))
    before = F.sum(F.when(F.col("v.day") < F.lit(HISTORY_END).cast("date"), F.size("v.tokens")))
    visits = orders.select("o_custkey", F.struct("day", "o_orderkey", tokens.alias("tokens")).alias("v")).groupBy("o_custkey").agg(F.sort_array(F.collect_list("v")).alias("v"), before.alias("n_before"))

    patients = read("customer").select("c_custkey", "c_nationkey").repartition(by_patient, "c_custkey").join(visits, F.col("c_custkey") == F.col("o_custkey"), "left")
    v = F.coalesce("v", F.array().cast("array<struct<day:date,o_orderkey:bigint,tokens:array<string>>>"))
    sex = F.when(F.col("c_custkey") % 2 == 0, "<SEX-1>").otherwise("<SEX-2>")
    age = F.concat(F.lit("<AGE_"), (20 + (F.col("c_custkey") * 7) % 60).cast("string"), F.lit(">"))
    start = F.array(F.lit("<BOS>"), sex, F.concat(F.lit("<NAT-"), F.col("c_nationkey").cast("string"), F.lit(">")), age)
    all_tokens = F.concat(start, F.flatten(v["tokens"]))
    thru = (F.coalesce("n_before", F.lit(0)) + 3).cast("int")
    return patients.select(
        F.col("c_custkey").cast("long").alias("row_idx"), F.col("c_custkey").cast("long").alias("person_id"),
        F.array_join(all_tokens, " ").alias("seq"), thru.alias("token_count_thru_2022"), (F.size(all_tokens) - 1).alias("total_token_count"),
    )


def vocabulary(traj: DataFrame) -> DataFrame:
    """Ids from 1 for the sorted disease tokens of the sequences."""
    tokens = traj.select(F.explode(F.array_distinct(F.split("seq", " ", -1))).alias("token")).where(F.col("token").startswith("<DX-MAJOR_")).distinct()
    # The tokens of a vocabulary, a few thousand at most: one window over them is small.
    return tokens.select("token", F.expr("row_number() OVER (ORDER BY token)").cast("int").alias("token_id"))
