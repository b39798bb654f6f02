"""Literal-row edge cases from the survey's quirk list (section 2.14)."""

import datetime as dt

from pyspark.sql import functions as F

from pacegrid.operators import filters as Fl
from pacegrid.operators import rollups as R
from pacegrid.operators import sequences as W
from pacegrid.sources.settings import user_settings

D = dt.date


def users(spark, ids):
    return spark.createDataFrame([(i, f"u{i}") for i in ids], "id long, username string")


def problems(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id long, name string, category string, topic string, "
                                       "difficulty string, status string")


def log(spark, rows):
    return spark.createDataFrame(rows, "user_id long, log_date date, problems_solved long")


def test_readiness_user_without_rows_and_streak_only(spark):
    u = users(spark, [1, 2])
    p = problems(spark, [(10, 2, "a", "DSA", "t", "Easy", "Solved")])
    lg = log(spark, [(1, D(2024, 1, 19), 3), (1, D(2024, 1, 18), 1)])
    r = {x.user_id: x for x in R.readiness(u, p, lg, "2024-01-20").collect()}
    assert (r[1].total, r[1].solved_pct, r[1].coverage_pct, r[1].streak, r[1].readiness) == (0, 0, 0, 2, 2)
    # one category, all solved: 100*0.6 + 100*0.2 + 0 = 80
    assert (r[2].solved_pct, r[2].coverage_pct, r[2].readiness) == (100, 100, 80)


def test_streak_rules(spark):
    rows = [(1, D(2024, 1, 20), 5),                     # today does not count
            (1, D(2024, 1, 19), 0),                     # broken yesterday
            (1, D(2024, 1, 18), 4)]
    rows += [(2, D(2024, 1, 19) - dt.timedelta(days=i), 1) for i in range(400)]   # capped at 365
    rows += [(3, D(2024, 1, 19), 1), (3, D(2024, 1, 19), 2), (3, D(2024, 1, 18), 1)]  # duplicate day
    st = {r.user_id: r.streak for r in W.streak(log(spark, rows), "2024-01-20").collect()}
    assert st.get(1, 0) == 0
    assert st[2] == 365
    assert st[3] == 2


def test_goal_zero_and_passed_deadline(spark):
    u = users(spark, [1])
    s = spark.createDataFrame([(1, "daily_goal", "0"), (1, "placement_deadline", "2024-01-05")],
                              "user_id long, key string, value string")
    us = user_settings(u, s)
    plan = spark.createDataFrame([(1, D(2024, 1, 20), 7, 0, "Solved")],
                                 "user_id long, plan_date date, problem_id long, order_index int, status string")
    pp = R.plan_progress(u, plan, us, "2024-01-20").first()
    assert (pp.daily_goal, pp.today_solved, pp.today_pct, pp.week_target) == (0, 1, 0, 0)
    p = problems(spark, [(i, 1, f"p{i}", "DSA", "t", "Easy", "Pending") for i in range(7)])
    pace = R.pace(u, p, us, "2024-01-20").first()
    assert (pace.days_left, pace.remaining, pace.needed_per_day) == (0, 7, 7.0)


def test_settings_defaults_and_bad_values(spark):
    u = users(spark, [1, 2])
    s = spark.createDataFrame([(1, "daily_goal", "ten"), (1, "placement_deadline", "soon")],
                              "user_id long, key string, value string")
    rows = {r.user_id: r for r in user_settings(u, s).collect()}
    for uid in (1, 2):
        assert (rows[uid].name, rows[uid].daily_goal, rows[uid].placement_deadline) == ("Student", 10, D(2026, 10, 1))


def test_one_decimal_tie_follows_half_even_on_decimal_text(spark):
    # 7/20 = 0.35: Python prints 0.3 (binary below .35); Spark bround and
    # DuckDB round_even give 0.4 -- the documented D5 difference.
    u = users(spark, [1])
    us = spark.createDataFrame([(1, D(2024, 2, 9))], "user_id long, placement_deadline date")
    p = problems(spark, [(i, 1, f"p{i}", "DSA", "t", "Easy", "Pending") for i in range(7)])
    assert R.pace(u, p, us, "2024-01-20").first().needed_per_day == 0.4


def test_search_terms_keep_wildcards_and_backslash(spark):
    p = problems(spark, [(1, 1, "50% off", "DSA", "t", "Easy", "Pending"),
                         (2, 1, "a_b", "DSA", "t", "Easy", "Pending"),
                         (3, 1, "axb", "DSA", "t", "Easy", "Pending"),
                         (4, 1, r"c\d", "DSA", "t", "Easy", "Pending")])
    ids = lambda term: sorted(r.id for r in Fl.problem_search(p, search=term, ordered=False).collect())  # noqa
    assert ids("a_b") == [2, 3]          # '_' stays a one-character wildcard
    assert ids("%") == [1, 2, 3, 4]      # '%' matches anything
    assert ids("c\\d") == [4]            # backslash is literal


def test_top_skipped_ties_by_topic(spark):
    p = problems(spark, [(i, 1, "n", "DSA", t, "Easy", "Skipped") for i, t in enumerate("bbaaccd")])
    got = [(r.topic, r.skipped, r.rank) for r in R.top_skipped_topics(p, 3).orderBy("rank").collect()]
    assert got == [("a", 2, 1), ("b", 2, 2), ("c", 2, 3)]


def test_first_wins_is_idempotent_and_keeps_smallest_seq(spark):
    df = spark.createDataFrame([(3, "x", "late"), (1, "x", "early"), (2, "y", "only")],
                               "seq long, k string, v string")
    once = W.first_wins(df, ["k"])
    twice = W.first_wins(once, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "x", "early"), (2, "y", "only")]
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_skew_safe_positions_equal_window_positions_on_a_hot_group(spark):
    # one (user, day) group holds most rows and spans many id buckets
    rows = [(1, D(2024, 1, 1), i, ["Easy", "Medium", "Hard"][i % 3]) for i in range(0, 3000, 7)]
    rows += [(2, D(2024, 1, 1), 100000 + i, "Hard") for i in range(5)]
    df = spark.createDataFrame(rows, "user_id long, d date, id long, difficulty string").withColumn(
        "r", W.difficulty_rank())
    a = W.skew_safe_positions(df, ["user_id", "d"], ["r"], "id", name="pos", slice_rows=100)
    b = W.positions(df, ["user_id", "d"], [F.col("r"), F.col("id")], name="pos")
    key = lambda d: sorted((r.user_id, r.id, r.pos) for r in d.collect())  # noqa
    assert key(a) == key(b)


def test_refresh_drops_the_plan_of_a_wanted_day_that_generates_nothing(spark):
    from pacegrid.operators.changes import generate_plans, refresh_plans

    plan = spark.createDataFrame([(1, "2024-01-01", 5, 0, "Pending"), (1, "2024-01-02", 6, 0, "Pending")],
                                 "user_id long, plan_date string, problem_id long, order_index long, status string")
    plan = plan.withColumn("plan_date", plan["plan_date"].cast("date"))
    problems = spark.createDataFrame([(5, 1, "2024-01-01", "Solved", "Easy")],
                                     "id long, user_id long, scheduled_date string, status string, difficulty string")
    problems = problems.withColumn("scheduled_date", problems["scheduled_date"].cast("date"))
    dates = plan.filter("problem_id = 5").select("user_id", "plan_date")
    out = refresh_plans(plan, generate_plans(problems, dates), dates)
    assert [r["problem_id"] for r in out.collect()] == [6]


def test_missing_workbook_reader_is_an_error(spark, tmp_dir):
    import pytest

    from pacegrid.sources import files

    if files.HAVE_OPENPYXL:
        pytest.skip("openpyxl is installed")
    with open(f"{tmp_dir}/a.xlsx", "wb") as f:
        f.write(b"PK")
    with pytest.raises(Exception, match="openpyxl"):
        files.read_sheets(spark, f"{tmp_dir}/*.xlsx", on_error="skip").collect()
