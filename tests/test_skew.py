"""A hot key holding a third of the rows, built from the real tables."""

import datetime as dt

from pyspark.sql import functions as F

from pacegrid.operators import changes as I
from pacegrid.operators import rollups as R
from pacegrid.operators import sequences as W
from pacegrid.plans.context import Ctx

SF = "/root/testdata/sf0.01"
HOT_DAY = dt.date(2024, 1, 1)


def hot_problems(spark):
    """Every third order becomes a Pending problem of user 1 on one day."""
    p = Ctx(spark, SF).problems
    hot = F.col("id") % 3 == 0
    return (p.withColumn("user_id", F.when(hot, F.lit(1)).otherwise(F.col("user_id")))
            .withColumn("scheduled_date", F.when(hot, F.lit(HOT_DAY)).otherwise(F.col("scheduled_date")))
            .withColumn("status", F.when(hot, F.lit("Pending")).otherwise(F.col("status"))))


def _max_rows_per_partition(df):
    """Largest number of rows one task holds in the final stage of ``df``
    (partition coalescing is off while measuring: on tiny data AQE would merge
    every partition into one and hide the split)."""
    spark = df.sparkSession
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return max(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p"))
                   .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*df.columns)).alias("all_columns")).collect())
    finally:
        spark.conf.set(key, old)


def test_plan_generation_splits_a_hot_group(spark):
    p = hot_problems(spark)
    hot_rows = p.filter((F.col("user_id") == 1) & (F.col("scheduled_date") == HOT_DAY)).count()
    assert hot_rows > 4000
    plans = I.generate_plans(p, slice_rows=500)
    # exact: same positions as a plain window
    plain = W.positions(p.filter((F.col("status") == "Pending") & F.col("scheduled_date").isNotNull())
                        .select("user_id", F.col("scheduled_date").alias("plan_date"), F.col("id").alias("problem_id"),
                                W.difficulty_rank().alias("r")),
                        ["user_id", "plan_date"], [F.col("r"), F.col("problem_id")], name="order_index")
    key = lambda d: sorted((r.user_id, r.problem_id, r.order_index)
                           for r in d.select("user_id", "problem_id", "order_index").collect())
    assert key(plans) == key(plain)
    # the hot group is spread: no output partition holds half of it, while
    # the plain window puts all of it in one partition
    assert _max_rows_per_partition(plans.filter(F.col("user_id") == 1)) < hot_rows / 2
    assert _max_rows_per_partition(plain.filter(F.col("user_id") == 1)) >= hot_rows


def test_positions_of_any_number_of_slices(spark):
    """More slices than are passed over at a time, sparse and negative ids, a null group."""
    df = (spark.range(6000).select(F.when(F.col("id") % 50 == 0, F.lit(None)).otherwise(F.lit(1)).alias("g"),
                                   (F.col("id") * F.col("id") * F.when(F.col("id") % 2 == 0, 1).otherwise(-3)).alias("k"),
                                   (F.col("id") % 2).alias("r")))
    got = W.skew_safe_positions(df, ["g"], ["r"], "k", slice_rows=70)
    plain = W.positions(df, ["g"], ["r", "k"])
    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    assert _max_rows_per_partition(got.filter("g = 1")) < 3000


def test_rollups_with_a_hot_user(spark):
    p = hot_problems(spark)
    users = Ctx(spark, SF).users
    got = {r.user_id: r for r in R.status_rollup(users, p).collect()}
    rows = p.select("user_id", "status").collect()
    want_total = sum(1 for r in rows if r.user_id == 1)
    assert got[1].total == want_total
    assert got[1].pending == sum(1 for r in rows if r.user_id == 1 and r.status == "Pending")
    top = R.top_skipped_topics(p, 3).filter(F.col("user_id") == 1).count()
    assert top <= 3


def test_hashed_ids_do_not_make_one_slice_per_row(spark):
    p = hot_problems(spark).withColumn("id", F.xxhash64("id"))
    wanted = p.filter((F.col("status") == "Pending") & F.col("scheduled_date").isNotNull()).select(
        "user_id", F.col("scheduled_date").alias("plan_date"), F.col("id").alias("problem_id"), W.difficulty_rank().alias("r"))
    got = W.skew_safe_positions(wanted, ["user_id", "plan_date"], ["r"], "problem_id", name="order_index", slice_rows=500)
    plain = W.positions(wanted, ["user_id", "plan_date"], ["r", "problem_id"], name="order_index")
    key = lambda d: sorted((r.user_id, r.problem_id, r.order_index)
                           for r in d.select("user_id", "problem_id", "order_index").collect())
    assert key(got) == key(plain)
    hot = got.filter((F.col("user_id") == 1) & (F.col("plan_date") == HOT_DAY))
    assert _max_rows_per_partition(hot) < hot.count() / 2
