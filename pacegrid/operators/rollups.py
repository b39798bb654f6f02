"""Per-user rollups, all users in one job.

Operators that take ``user_settings`` (S7: one row per user, defaults filled)
drive their left joins from it; ``users`` is kept in their signature so all
rollups are called alike.

Scale notes.  Every rollup is a hash aggregate with a map-side partial step,
so a user holding a third of all rows is pre-aggregated on each mapper before
the shuffle and costs one row per mapper afterwards.  Users without rows come
back through a left join from ``users`` (sort-merge on ``user_id``; AQE turns
it into a broadcast only when its runtime size is under the threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_date, days_in_month, month_start, week_start
from ..functions.numeric import py_round, ratio_pct
from .sequences import streak

STATUSES = ["Solved", "Attempted", "Pending", "Skipped"]


def _users(users: DataFrame, user_key: str = "id") -> DataFrame:
    return users.select(F.col(user_key).alias("user_id"))


def _zero(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.fillna(0, subset=cols)


def status_rollup(users: DataFrame, problems: DataFrame) -> DataFrame:
    """A1: total and per-status counts in one conditional aggregate."""
    agg = problems.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    cols = ["total"] + [s.lower() for s in STATUSES]
    return _zero(_users(users).join(agg, "user_id", "left"), cols)


def category_breakdown(problems: DataFrame, drop_empty: bool = False) -> DataFrame:
    """A2: ``(user_id, category, total, solved)``; ``drop_empty`` drops ''
    categories as the categories listing does."""
    p = problems.filter(F.col("category") != "") if drop_empty else problems
    return p.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Solved").alias("solved"))


def top_skipped_topics(problems: DataFrame, k: int = 3) -> DataFrame:
    """A3: the k most-skipped non-empty topics per user (ties by topic, D10).

    Counts are pre-aggregated per (user, topic); the ``row_number() <= k``
    filter is planned as a WindowGroupLimit, so each partition keeps only its
    k best rows per user before the window is finished.
    """
    from pyspark.sql.window import Window
    c = (problems.filter((F.col("status") == "Skipped") & (F.col("topic") != ""))
         .groupBy("user_id", "topic").agg(F.count(F.lit(1)).alias("skipped")))
    w = Window.partitionBy("user_id").orderBy(F.desc("skipped"), F.asc("topic"))
    return (c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .withColumn("rank", F.col("rank").cast("bigint")))


def category_coverage(users: DataFrame, problems: DataFrame) -> DataFrame:
    """A5 (+A1 solved/total from the same aggregate).

    One partial aggregate per (user, category) feeds both the status counts
    and the coverage, so ``problems`` is scanned and shuffled once.
    """
    per_cat = problems.groupBy("user_id", "category").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "Solved").alias("solved"))
    per_user = per_cat.groupBy("user_id").agg(
        F.sum("total").alias("total"), F.sum("solved").alias("solved"),
        F.count(F.lit(1)).alias("cats_total"),
        F.count_if(F.col("solved") > 0).alias("cats_with_solved"))
    out = _zero(_users(users).join(per_user, "user_id", "left"),
                ["total", "solved", "cats_total", "cats_with_solved"])
    denom = F.when(F.col("cats_total") > 0, F.col("cats_total")).otherwise(F.lit(1))
    return out.withColumn("coverage_pct", ratio_pct("cats_with_solved", denom))


def readiness(users: DataFrame, problems: DataFrame, log: DataFrame, as_of) -> DataFrame:
    """``min(100, round(solved_pct*0.6 + coverage_pct*0.2 + min(streak, 20)))``."""
    cov = category_coverage(users, problems)
    st = streak(log, as_of)
    j = cov.join(st, "user_id", "left").fillna(0, subset=["streak"])
    solved_pct = ratio_pct("solved", "total")
    score = solved_pct * 0.60 + F.col("coverage_pct") * 0.20 + F.least(F.col("streak"), F.lit(20))
    return j.select(
        "user_id", F.col("total").cast("bigint").alias("total"), F.col("solved").cast("bigint").alias("solved"),
        solved_pct.alias("solved_pct"), F.col("coverage_pct"), F.col("streak").cast("bigint").alias("streak"),
        F.least(F.lit(100).cast("bigint"), py_round(score)).alias("readiness"))


def plan_progress(users: DataFrame, plan: DataFrame, user_settings: DataFrame, as_of) -> DataFrame:
    """A4: solved plan rows today / this Monday-Sunday week / this month
    against goal, goal*7 and goal*days-in-month."""
    d = as_date(as_of)
    ws, we = week_start(d), F.date_add(week_start(d), 6)
    ms, me = month_start(d), F.last_day(d)
    lo, hi = F.least(ws, ms), F.greatest(we, me)
    solved = plan.filter((F.col("status") == "Solved") & F.col("plan_date").between(lo, hi))
    agg = solved.groupBy("user_id").agg(
        F.count_if(F.col("plan_date") == d).alias("today_solved"),
        F.count_if(F.col("plan_date").between(ws, we)).alias("week_solved"),
        F.count_if(F.col("plan_date").between(ms, me)).alias("month_solved"))
    # user_settings already holds one row per user (S7), so it drives the join
    out = _zero(user_settings.select("user_id", "daily_goal").join(agg, "user_id", "left"),
                ["today_solved", "week_solved", "month_solved"])
    goal = F.col("daily_goal")
    return out.select(
        "user_id", "daily_goal", "today_solved",
        F.when(goal != 0, F.least(F.lit(100).cast("bigint"), ratio_pct("today_solved", goal)))
         .otherwise(F.lit(0).cast("bigint")).alias("today_pct"),
        "week_solved", (goal * 7).alias("week_target"),
        "month_solved", (goal * days_in_month(d)).cast("bigint").alias("month_target"))


def pace(users: DataFrame, problems: DataFrame, user_settings: DataFrame, as_of,
         clamp: bool = True) -> DataFrame:
    """``needed = round(remaining / days_left, 1)``, or ``remaining`` when no
    days are left.  ``clamp=False`` keeps negative day counts (reports, Q7)."""
    d = as_date(as_of)
    rem = problems.groupBy("user_id").agg(
        F.count_if(F.col("status").isin("Pending", "Attempted")).alias("remaining"))
    j = (user_settings.select("user_id", "placement_deadline")
         .join(rem, "user_id", "left").fillna(0, subset=["remaining"]))
    days = F.datediff("placement_deadline", d).cast("bigint")
    days = F.greatest(F.lit(0).cast("bigint"), days) if clamp else days
    j = j.withColumn("days_left", days)
    needed = F.when(F.col("days_left") > 0,
                    py_round(F.col("remaining").cast("double") / F.col("days_left"), 1)
                    ).otherwise(F.col("remaining").cast("double"))
    return j.select("user_id", "placement_deadline", "days_left",
                    F.col("remaining").cast("bigint").alias("remaining"), needed.alias("needed_per_day"))


def project_completion(projects: DataFrame, milestones: DataFrame) -> DataFrame:
    """``round(done / total * 100)`` per project, 0 without milestones."""
    m = milestones.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_ms"), F.count_if(F.col("status") == "Done").alias("done_ms"))
    p = projects.select(F.col("id").alias("project_id"), "user_id")
    out = _zero(p.join(m, "project_id", "left"), ["total_ms", "done_ms"])
    return out.withColumn("completion_pct", ratio_pct("done_ms", "total_ms"))


def plan_day_log(plan: DataFrame, user_settings: DataFrame) -> DataFrame:
    """Solved plan rows per (user, day) as a log row with the user's goal."""
    c = plan.groupBy("user_id", F.col("plan_date").alias("log_date")).agg(
        F.count_if(F.col("status") == "Solved").alias("problems_solved"))
    s = user_settings.select("user_id", F.col("daily_goal").alias("problems_target"))
    return (c.join(s, "user_id", "left")
            .fillna(10, subset=["problems_target"]))


def weekly_summary(users: DataFrame, log: DataFrame, user_settings: DataFrame, as_of) -> DataFrame:
    """A10: solved and studied days from Monday up to ``as_of`` against goal*7."""
    d = as_date(as_of)
    wk = log.filter(F.col("log_date").between(week_start(d), d)).groupBy("user_id").agg(
        F.sum("problems_solved").cast("bigint").alias("week_solved"),
        F.count_if(F.col("problems_solved") > 0).alias("days_studied"))
    j = _zero(user_settings.select("user_id", "daily_goal").join(wk, "user_id", "left"),
              ["week_solved", "days_studied"])
    goal7 = F.col("daily_goal") * 7
    band = (F.when(F.col("week_solved") < goal7 * 0.5, "behind")
            .when(F.col("week_solved") >= goal7, "smashed").otherwise("decent"))
    return j.select("user_id", "week_solved", "days_studied", goal7.alias("week_goal"),
                    band.alias("band"), (F.col("days_studied") < 5).alias("low_days"))


def plan_existence(problems: DataFrame, plan: DataFrame) -> DataFrame:
    """For every (user, day) with pending scheduled problems, the number
    of plan rows already present and whether the plan must be generated."""
    wanted = (problems.filter((F.col("status") == "Pending") & F.col("scheduled_date").isNotNull())
              .select("user_id", F.col("scheduled_date").alias("plan_date")).distinct())
    have = plan.groupBy("user_id", "plan_date").agg(F.count(F.lit(1)).alias("plan_rows"))
    out = _zero(wanted.join(have, ["user_id", "plan_date"], "left"), ["plan_rows"])
    return out.withColumn("needs_generation", F.col("plan_rows") == 0)
