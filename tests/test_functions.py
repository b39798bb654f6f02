"""Operators that have no registered query of their own (F8, F9, refresh,
ordered upserts) and the rule compiler."""

import datetime as dt

from pyspark.sql import functions as F

from pacegrid.functions import rules as RU
from pacegrid.operators import changes as I
from pacegrid.operators import filters as Fl
from pacegrid.operators import sequences as W
from pacegrid.operators import text as T


def test_add_missing_columns_and_claim_orphans(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "user_id long, notes string")
    out = Fl.add_missing_columns(df, {"notes": ("string", ""), "attempts": ("int", 0)})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "", 0), (None, "x", 0)], key=str)
    claimed = Fl.claim_orphans(out, 7)
    assert sorted(r.user_id for r in claimed.collect()) == [1, 7]


def test_refresh_plans_replaces_only_generated_days(spark):
    old = spark.createDataFrame([(1, dt.date(2024, 1, 1), 5, 0, "Solved"), (1, dt.date(2024, 1, 2), 6, 0, "Pending")],
                                "user_id long, plan_date date, problem_id long, order_index int, status string")
    new = spark.createDataFrame([(1, dt.date(2024, 1, 2), 9, 0, "Pending")],
                                "user_id long, plan_date date, problem_id long, order_index int, status string")
    got = sorted((r.plan_date.day, r.problem_id) for r in I.refresh_plans(old, new).collect())
    assert got == [(1, 5), (2, 9)]


def test_settings_upsert_latest_change_wins(spark):
    s = spark.createDataFrame([(1, "daily_goal", "5"), (1, "name", "a")], "user_id long, key string, value string")
    ch = spark.createDataFrame([(1, "daily_goal", "8", 2), (1, "daily_goal", "9", 1), (2, "name", "b", 1)],
                               "user_id long, key string, value string, ts long")
    got = sorted(map(tuple, I.upsert_settings(s, ch).collect()))
    assert got == [(1, "daily_goal", "8"), (1, "name", "a"), (2, "name", "b")]


def test_last_wins_keeps_old_rows_without_change(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").withColumn("version", F.lit(None).cast("long"))
    new = spark.createDataFrame([(2, "B", 5), (2, "BB", 7), (3, "c", 1)], "k long, v string, version long")
    got = sorted(map(tuple, W.last_wins(old, new, ["k"]).collect()))
    assert got == [(1, "a"), (2, "BB"), (3, "c")]     # the version column is bookkeeping


def test_toggle_and_delete_one(spark):
    imp = spark.createDataFrame([(1, 1, True), (2, 1, False)], "id long, user_id long, protected boolean")
    got = sorted(map(tuple, I.toggle_protection(imp, imp.filter("id = 2")).collect()))
    assert got == [(1, 1, True), (2, 1, True)]
    p = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id long, user_id long")
    plan = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "problem_id long, user_id long")
    np_, nplan = I.delete_one(p, plan, spark.createDataFrame([(2, 1), (3, 9)], "id long, user_id long"))
    assert sorted(r.id for r in np_.collect()) == [1, 3]          # id 3 belongs to user 2, not 9
    assert sorted(r.problem_id for r in nplan.collect()) == [1, 3]


def test_rule_compiler_first_match_and_substring(spark):
    df = spark.createDataFrame([("Training a new model",), ("React and Python",), ("Nothing here",)], "t string")
    tags = [r[0] for r in df.select(T.topic_tag("t")).collect()]
    # substring matching: "ai" inside "training" makes it AI/ML (kept quirk Q16)
    assert tags == ["AI/ML", "Web Dev", "Tech"]
    frame = RU.rule_frame(spark, RU.ROUTER_RULES, "router")
    assert frame.filter("label = 'weekly'").count() == 2


def test_resource_links_and_whitelist(spark):
    df = spark.createDataFrame([("learn binary search trees",), ("pointer tricks",)], "topic string")
    links = [r[0].split("\n") for r in df.select(T.resource_links("topic")).collect()]
    assert links[0][0] == "https://takeuforward.org/binary-search/"
    assert links[1] == ["https://www.geeksforgeeks.org/search/?q=pointer+tricks",
                        "https://leetcode.com/search/?q=pointer+tricks",
                        "https://www.youtube.com/results?search_query=pointer+tricks+tutorial"]
    ok = [r[0] for r in spark.createDataFrame([("https://neetcode.io/x",), ("https://example.com",)], "u string")
          .select(T.allowed_link("u")).collect()]
    assert ok == [True, False]


def test_head_words_whole_text(spark):
    long = " ".join(f"w{i}" for i in range(20000))
    df = spark.createDataFrame([(long,), ("  short  text ",), ("a\nb\tc",)], "t string")
    got = [r[0] for r in df.select(Fl.head_words("t", 12)).collect()]
    assert got[0] == " ".join(f"w{i}" for i in range(12))
    assert got[1] == "  short  text "      # 12 words or fewer: unchanged
    assert got[2] == "a\nb\tc"


def test_delete_project_cascades_to_milestones(spark):
    pr = spark.createDataFrame([(1, 10), (2, 10)], "id long, user_id long")
    ms = spark.createDataFrame([(1, 0, "Done"), (1, 1, "Pending"), (2, 0, "Pending")],
                               "project_id long, order_index int, status string")
    p2, m2 = I.delete_projects(pr, ms, spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in p2.collect()] == [2]
    assert [r.project_id for r in m2.collect()] == [2]


def test_news_fallback_when_nothing_passes(spark):
    arts = spark.createDataFrame([(i, f"src{i % 5}", "", f"dull text {i}", 0, "en") for i in range(20)],
                                 "seq long, source string, url string, title string, score long, tag_hint string")
    out = T.merge_news(T.feed_items(arts), limit=9).orderBy("rank").collect()
    assert len(out) == 9 and out[0].score == 100 and out[0].tag == "Career"
    assert [r.rank for r in out] == list(range(1, 10))


def test_sql_users_see_the_same_tables(spark):
    from conftest import SF_SMALL
    from pacegrid.operators import rollups as R
    from pacegrid.plans.context import Ctx
    c = Ctx(spark, SF_SMALL)
    c.register_views()
    via_sql = spark.sql("select user_id, count(*) total from problems group by user_id")
    via_df = R.status_rollup(c.users, c.problems).filter("total > 0").select("user_id", "total")
    assert sorted(map(tuple, via_sql.collect())) == sorted(map(tuple, via_df.collect()))


def test_whole_word_option(spark):
    df = spark.createDataFrame([("Training plans for the week",), ("An AI model",), ("go-lang tips",)], "t string")
    sub = [r[0] for r in df.select(T.topic_tag("t")).collect()]
    word = [r[0] for r in df.select(T.topic_tag("t", whole_word=True)).collect()]
    assert sub == ["AI/ML", "AI/ML", "Languages"]       # substring: "ai" in "training"
    assert word == ["Tech", "AI/ML", "Languages"]      # whole words: "go" before "-" still counts
    rel = [r[0] for r in df.select(T.is_relevant("t", whole_word=True)).collect()]
    assert rel == [False, True, False]


def test_route_on_assembled_prompt(spark):
    from pacegrid.plans.reports import assemble_prompts
    msgs = spark.createDataFrame([(1, 0, "how am i doing")], "conv_id long, turn long, message string")
    ctx = spark.createDataFrame([(1, "[USER CURRENT STATUS]\\nToday's Plan:\\n")], "user_id long, context string")
    by_msg = assemble_prompts(msgs, ctx).first()
    by_prompt = assemble_prompts(msgs, ctx, route_on="prompt").first()
    assert by_msg.personal and by_msg.intent == "default"
    assert by_prompt.intent == "daily"


def test_category_column_option(spark):
    from pacegrid.operators import sheets as N
    cells = spark.createDataFrame(
        [("f.csv", "Sheet", 1, 1, "Problem", "A"), ("f.csv", "Sheet", 1, 2, "Category", "SQL"),
         ("f.csv", "Sheet", 2, 1, "Problem", "B"), ("f.csv", "Sheet", 2, 2, "Category", "nan")],
        "source_file string, sheet string, row_no long, col_no int, header string, value string")
    default = {r.name: r.category for r in N.normalise(cells).collect()}
    opted = {r.name: r.category for r in N.normalise(cells, use_category_column=True).collect()}
    assert default == {"A": "DSA", "B": "DSA"}          # Q12 kept: the sheet decides
    assert opted == {"A": "SQL", "B": "DSA"}


def test_whole_word_sheet_categories(spark):
    from pacegrid.operators import sheets as N
    cells = spark.createDataFrame(
        [("f.csv", "Photos", 1, 1, "c1", "x"), ("f.csv", "HR round", 1, 1, "c1", "y")],
        "source_file string, sheet string, row_no long, col_no int, header string, value string")
    sub = {r.sheet: r.category for r in N.normalise(cells).collect()}
    word = {r.sheet: r.category for r in N.normalise(cells, whole_word=True).collect()}
    assert sub == {"Photos": "Interview", "HR round": "HR"}      # "os" inside "photos"
    assert word == {"Photos": "DSA", "HR round": "HR"}
