"""The tracker's joins, semi/anti joins and point lookups.

All joins are equi-joins on keys; Catalyst/AQE choose sort-merge or, when
one side's runtime size is under the broadcast threshold, a broadcast hash
join.  Anti joins use null-free keys so they plan as plain (not null-aware)
left-anti joins that can run as sort-merge at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date

PLAN_COLUMNS = ["user_id", "plan_date", "order_index", "plan_status", "problem_id",
                "name", "category", "topic", "difficulty", "platform"]


def plan_with_problems(plan: DataFrame, problems: DataFrame) -> DataFrame:
    """Plan rows with their problem's fields."""
    p = problems.select(F.col("id").alias("problem_id"), "name", "category", "topic", "difficulty", "platform")
    return (plan.withColumnRenamed("status", "plan_status").join(p, "problem_id", "inner")
            .select(*PLAN_COLUMNS))


def rows_with_key_in(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Left-semi join (``key IN (subquery)``)."""
    return df.join(keys.select(*on), on, "left_semi")


def unprotected_problems(problems: DataFrame, imports: DataFrame) -> DataFrame:
    """Problems whose batch is not one of the user's protected imports.

    Matched on the stored ``batch_id`` and scoped to the user (Q2, Q3 fixed).
    A NULL batch (hand-added row) is kept as unprotected.
    """
    prot = (imports.filter(F.col("protected"))
            .select("user_id", F.col("batch_id").alias("import_batch")))
    return problems.join(prot, ["user_id", "import_batch"], "left_anti")


def new_tasks(tasks: DataFrame, problems: DataFrame) -> DataFrame:
    """Incoming tasks whose (user, trimmed name, topic) is not stored."""
    t = tasks.withColumn("_name", F.trim("name")).withColumn("_topic", F.coalesce("topic", F.lit("")))
    have = problems.select("user_id", F.col("name").alias("_name"), F.col("topic").alias("_topic"))
    return t.join(have, ["user_id", "_name", "_topic"], "left_anti").drop("_name", "_topic")


def insert_if_absent(catalog: DataFrame, seed: DataFrame, key: str = "name") -> DataFrame:
    """Catalog plus the seed rows whose key is absent (first seed row per
    key), tagged with their origin."""
    cols = seed.columns
    rest = [c for c in cols if c != key]
    fresh = (seed.join(catalog.select(key), key, "left_anti")
             .groupBy(key).agg(F.min(F.struct(*rest)).alias("_r")).select(key, "_r.*"))
    return (catalog.select(*cols).withColumn("origin", F.lit("catalog"))
            .unionByName(fresh.select(*cols).withColumn("origin", F.lit("seed"))))


def day_value(users: DataFrame, log: DataFrame, day, value: str = "problems_solved",
              name: str = "value") -> DataFrame:
    """Each user's log value on one day, 0 when there is no row."""
    d = as_date(day)
    one = log.filter(F.col("log_date") == d).select("user_id", F.col(value).alias(name))
    return (users.select(F.col("id").alias("user_id")).join(one, "user_id", "left")
            .fillna(0, subset=[name]))
