"""The daily cache as one operator, files of two schemas, orders with ties, answers, and status events by reduction."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import changes as I
from pacegrid.operators import filters as Fl
from pacegrid.plans import reports as RP
from pacegrid.sources import sinks as SK

D = dt.date


def _cached(df):
    return sorted((r.n, r.cache_date) for r in df.collect())


def test_daily_cache_reuses_rebuilds_and_clears(spark, tmp_dir):
    path, calls = f"{tmp_dir}/cache", []

    def build(*values):
        def run():
            calls.append(values)
            return spark.createDataFrame([(v,) for v in values], "n long")
        return run

    assert _cached(SK.daily_cache(spark, path, "2024-01-01", build(1, 2))) == [(1, D(2024, 1, 1)), (2, D(2024, 1, 1))]
    assert _cached(SK.daily_cache(spark, path, "2024-01-01", build(9))) == [(1, D(2024, 1, 1)), (2, D(2024, 1, 1))]
    assert calls == [(1, 2)]                                            # the cache was used, nothing built
    assert _cached(SK.daily_cache(spark, path, D(2024, 1, 1), build(3), force=True)) == [(3, D(2024, 1, 1))]
    assert _cached(SK.daily_cache(spark, path, "2024-01-02", build(4))) == [(4, D(2024, 1, 2))]
    assert _cached(spark.read.parquet(path)) == [(4, D(2024, 1, 2))]    # the other day has expired


def test_a_failed_rebuild_keeps_the_cache(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    SK.daily_cache(spark, path, "2024-01-01", lambda: spark.createDataFrame([(1,)], "n long"))
    bad = lambda: spark.range(1).select(F.raise_error(F.lit("no feed")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no feed"):
        SK.daily_cache(spark, path, "2024-01-02", bad)
    assert _cached(SK.read_daily_cache(spark, path, "2024-01-01")) == [(1, D(2024, 1, 1))]


def test_an_empty_rebuild_is_no_cache(spark, tmp_dir):
    path = f"{tmp_dir}/cache"
    none = lambda: spark.createDataFrame([], "n long")
    assert SK.daily_cache(spark, path, "2024-01-01", none).count() == 0
    SK.daily_cache(spark, path, "2024-01-01", lambda: spark.createDataFrame([(1,)], "n long"))
    got = SK.daily_cache(spark, path, "2024-01-01", none, force=True)
    assert got.columns == ["n", "cache_date"] and got.count() == 0
    assert SK.read_daily_cache(spark, path, "2024-01-01") is None


@pytest.mark.parametrize("schema", [None, "id long, status string, revision long"])
def test_files_of_two_schemas(spark, tmp_dir, schema):
    path = f"{tmp_dir}/t"
    spark.createDataFrame([(1,), (2,)], "id long").write.parquet(path)
    spark.createDataFrame([(3, "Solved"), (4, None)], "id long, status string").write.mode("append").parquet(path)
    got = Fl.read_migrated(spark, path, {"status": ("string", "Pending"), "revision": ("bigint", 1)}, schema)
    assert sorted(map(tuple, got.select("id", "status", "revision").collect())) == [
        (1, "Pending", 1), (2, "Pending", 1), (3, "Solved", 1), (4, "Pending", 1)]


def test_orphans_of_every_table(spark):
    tables = {"a": spark.createDataFrame([(None, 1), (2, 2)], "user_id long, x int"),
              "b": spark.createDataFrame([(None,)], "user_id int")}
    got = Fl.claim_all(tables, 7)
    assert sorted(map(tuple, got["a"].collect())) == [(2, 2), (7, 1)]
    assert got["b"].first().user_id == 7 and got["b"].schema["user_id"].dataType.simpleString() == "int"


def test_milestones_with_equal_indexes_and_newest_projects(spark):
    m = spark.createDataFrame([(1, 0, 9), (1, 0, 3), (1, 2, 1), (2, 5, 4)], "project_id long, order_index int, id long")
    assert sorted((r.project_id, r.position, r.id) for r in Fl.milestone_positions(m).collect()) == [
        (1, 0, 3), (1, 1, 9), (1, 2, 1), (2, 0, 4)]
    p = spark.createDataFrame([(5, 1), (7, 1), (6, 2)], "id long, user_id long")
    assert sorted((r.user_id, r.position, r.id) for r in Fl.newest_projects(p).collect()) == [(1, 0, 7), (1, 1, 5), (2, 0, 6)]


def test_answers_by_route(spark):
    say = spark.createDataFrame([(1, 0, "my WEEK"), (1, 1, "what should i do"), (9, 0, "today?"), (1, 2, "hm"), (1, 3, "news today")],
                                "conv_id long, turn int, message string")
    one = lambda text: spark.createDataFrame([(1, text)], "user_id long, report string")
    got = RP.rule_answers(say, one("D"), one("W"), one("S"), spark.createDataFrame([("N",)], "report string"))
    assert {(r.conv_id, r.turn): r.answer for r in got.collect()} == {
        (1, 0): "W", (1, 1): "S", (9, 0): RP.DEFAULT_ANSWER, (1, 2): RP.DEFAULT_ANSWER, (1, 3): "N"}


PROBLEMS = "id long, user_id long, status string"
PLAN = "user_id long, plan_date date, problem_id long, order_index int, status string"
LOG = ("user_id long, log_date date, problems_solved long, problems_attempted long, problems_skipped long, "
       "problems_target long, mood string")
EVENTS = "user_id long, problem_id long, plan_date date, status string, ts long"


def test_status_events_by_reduction(spark):
    a, b = D(2024, 1, 1), D(2024, 1, 2)
    problems = spark.createDataFrame([(1, 1, "Pending"), (2, 1, "Pending"), (3, 2, "Solved")], PROBLEMS)
    plan = spark.createDataFrame([(1, a, 1, 0, "Pending"), (1, a, 1, 1, "Pending"), (1, a, 2, 2, "Solved"),
                                  (1, b, 2, 0, "Solved"), (2, a, 3, 0, "Solved"), (1, None, 2, 0, "Solved")], PLAN)
    log = spark.createDataFrame([(1, a, 7, 4, 2, 5, "ok"), (2, b, 3, None, 0, 8, None)], LOG)
    prefs = spark.createDataFrame([(1, 6)], "user_id long, daily_goal long")
    events = spark.createDataFrame([
        (1, 1, a, "Attempted", 1), (1, 1, a, "Solved", 2),     # both plan rows of the day
        (1, 2, b, "Skipped", 1),                               # the day's only solved row
        (1, 3, a, "Pending", 9),                               # another user's problem
        (2, 3, None, "Attempted", 5)], EVENTS)                 # no day: the problem alone
    p, pl, lg = I.apply_status_events(problems, plan, log, prefs, events)
    assert sorted((r.id, r.status) for r in p.collect()) == [(1, "Solved"), (2, "Skipped"), (3, "Attempted")]
    assert pl.columns == plan.columns and p.columns == problems.columns
    assert sorted((str(r.plan_date), r.problem_id, r.order_index, r.user_id, r.status) for r in pl.collect()) == [
        ("2024-01-01", 1, 0, 1, "Solved"), ("2024-01-01", 1, 1, 1, "Solved"), ("2024-01-01", 2, 2, 1, "Solved"),
        ("2024-01-01", 3, 0, 2, "Solved"), ("2024-01-02", 2, 0, 1, "Skipped"), ("None", 2, 0, 1, "Solved")]
    assert sorted(map(tuple, lg.select("user_id", "log_date", "problems_solved", "problems_attempted", "problems_skipped",
                                       "problems_target", "mood").collect())) == [
        (1, a, 3, 4, 2, 6, "ok"), (1, b, 0, 0, 0, 6, ""), (2, b, 3, 0, 0, 8, "")]


def test_status_log_takes_six_exchanges(spark, tmp_dir):
    def table(name, schema):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_dir}/{name}")
        return spark.read.parquet(f"{tmp_dir}/{name}")

    log = I.apply_status_events(table("problems", PROBLEMS), table("plan", PLAN), table("log", LOG),
                                table("prefs", "user_id long, daily_goal long"), table("events", EVENTS))[2]
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:  # the plan of tables too large to broadcast
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        plan = log._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert 0 < len(re.findall(r"Exchange hashpartitioning", plan)) <= 6
