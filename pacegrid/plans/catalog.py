"""Registered queries: one per operator of the inventory.

Each entry is ``fn(spark, sf_dir) -> DataFrame`` over the whole tables.  The
matching DuckDB statements live in ``pacegrid.plans.oracle`` under the same key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollups as R
from ..operators import sequences as W
from .context import AS_OF_LOG, AS_OF_PLAN, Ctx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(key: str):
    def deco(fn: Callable[[Ctx], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: fn(Ctx(spark, sf_dir))
        QUERIES[key].__doc__ = fn.__doc__
        return fn
    return deco


# --- S: sources -----------------------------------------------------------

@query("s7_user_settings")
def _s7(c: Ctx) -> DataFrame:
    return c.user_settings


# --- A: rollups -----------------------------------------------------------

@query("a1_status_rollup")
def _a1(c: Ctx) -> DataFrame:
    return R.status_rollup(c.users, c.problems)


@query("a2_category_breakdown")
def _a2(c: Ctx) -> DataFrame:
    return R.category_breakdown(c.problems)


@query("a3_top_skipped_topics")
def _a3(c: Ctx) -> DataFrame:
    return R.top_skipped_topics(c.problems, 3)


@query("a4_plan_progress")
def _a4(c: Ctx) -> DataFrame:
    return R.plan_progress(c.users, c.daily_plan, c.user_settings, AS_OF_PLAN)


@query("a5_category_coverage")
def _a5(c: Ctx) -> DataFrame:
    return R.category_coverage(c.users, c.problems)


@query("a6_readiness")
def _a6(c: Ctx) -> DataFrame:
    return R.readiness(c.users, c.problems, c.daily_log, AS_OF_LOG)


@query("a7_pace")
def _a7(c: Ctx) -> DataFrame:
    return R.pace(c.users, c.problems, c.user_settings, AS_OF_LOG)


@query("a8_project_completion")
def _a8(c: Ctx) -> DataFrame:
    return R.project_completion(c.projects, c.milestones)


@query("a9_plan_day_log")
def _a9(c: Ctx) -> DataFrame:
    return R.plan_day_log(c.daily_plan, c.user_settings)


@query("a10_weekly_summary")
def _a10(c: Ctx) -> DataFrame:
    return R.weekly_summary(c.users, c.daily_log, c.user_settings, AS_OF_LOG)


@query("a12_plan_existence")
def _a12(c: Ctx) -> DataFrame:
    return R.plan_existence(c.problems, c.daily_plan)


# --- W: sequences ---------------------------------------------------------

@query("w1_streak")
def _w1(c: Ctx) -> DataFrame:
    st = W.streak(c.daily_log, AS_OF_LOG)
    return (c.users.select(F.col("id").alias("user_id")).join(st, "user_id", "left")
            .fillna(0, subset=["streak"]))


@query("w2_plan_order")
def _w2(c: Ctx) -> DataFrame:
    p = (c.problems.filter(F.col("scheduled_date").isNotNull())
         .select("user_id", "scheduled_date", "id", "difficulty",
                 W.difficulty_rank().alias("difficulty_rank")))
    return W.skew_safe_positions(p, ["user_id", "scheduled_date"], ["difficulty_rank"], "id",
                                 name="order_index")


@query("w3_daily_series")
def _w3(c: Ctx) -> DataFrame:
    return W.daily_series(c.users, c.daily_log, c.user_settings, AS_OF_LOG)


@query("w4_first_wins_articles")
def _w4(c: Ctx) -> DataFrame:
    return W.first_wins(c.articles, [F.lower(F.substring("title", 1, 50))], seq="seq")


# --- F: filters -----------------------------------------------------------
from ..operators import filters as Fl  # noqa: E402
from ..operators import joins as J  # noqa: E402


@query("f1_problem_search")
def _f1(c: Ctx) -> DataFrame:
    return Fl.problem_search(c.problems, category="economy", search="ring")


@query("f2_topic_view")
def _f2(c: Ctx) -> DataFrame:
    return Fl.topic_view(c.users, c.problems, c.algorithms, "widget")


@query("f3_catalog_search")
def _f3(c: Ctx) -> DataFrame:
    return Fl.catalog_search(c.algorithms, "anvil")


@query("f4_distinct_topics")
def _f4(c: Ctx) -> DataFrame:
    return Fl.distinct_topics(c.problems)


@query("f5_problems_in_range")
def _f5(c: Ctx) -> DataFrame:
    return Fl.problems_in_range(c.problems, date_from="1996-01-01", date_to="1996-03-31")


@query("f6_owned_milestones")
def _f6(c: Ctx) -> DataFrame:
    return Fl.owned_milestones(c.projects, c.milestones)


@query("f7_fill_defaults")
def _f7(c: Ctx) -> DataFrame:
    return Fl.fill_defaults(c.tasks.select("seq", "user_id", "name", "topic"))


# --- J: joins -------------------------------------------------------------

@query("j1_plan_with_problems")
def _j1(c: Ctx) -> DataFrame:
    return J.plan_with_problems(c.daily_plan, c.problems)


@query("j2_plan_rows_in_category")
def _j2(c: Ctx) -> DataFrame:
    keys = c.problems.filter(F.col("category") == "SMALL").select(F.col("id").alias("problem_id"))
    return J.rows_with_key_in(c.daily_plan, keys, ["problem_id"])


@query("j3_unprotected_problems")
def _j3(c: Ctx) -> DataFrame:
    return J.unprotected_problems(c.problems, c.imports)


@query("j4_new_tasks")
def _j4(c: Ctx) -> DataFrame:
    return J.new_tasks(c.tasks, c.problems)


@query("j5_catalog_seed")
def _j5(c: Ctx) -> DataFrame:
    t = c.t
    seed = (t("nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("pattern"))
            .unionByName(t("part").select(F.col("p_type").alias("name"), F.lit("type").alias("pattern")))
            .unionByName(t("part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("pattern"))))
    return J.insert_if_absent(c.algorithms.select("name", "pattern"), seed)


@query("j6_yesterday_solved")
def _j6(c: Ctx) -> DataFrame:
    import datetime as dt
    y = dt.date.fromisoformat(AS_OF_LOG) - dt.timedelta(days=1)
    return J.day_value(c.users, c.daily_log, y, name="yesterday_solved")


# --- L: order and limits --------------------------------------------------

@query("l2_recent_logs")
def _l2(c: Ctx) -> DataFrame:
    return Fl.recent_logs(c.daily_log, 14)


@query("l2_recent_imports")
def _l2i(c: Ctx) -> DataFrame:
    return Fl.recent_imports(c.imports, 50)


@query("l3_milestone_order")
def _l3(c: Ctx) -> DataFrame:
    return Fl.milestone_order(c.milestones)


@query("l4_top_articles")
def _l4(c: Ctx) -> DataFrame:
    return Fl.top_n(c.articles, 9)


@query("l5_source_caps")
def _l5(c: Ctx) -> DataFrame:
    return Fl.top_per_group(c.articles, ["source"], [F.asc("seq")], 5)


@query("l6_heads")
def _l6(c: Ctx) -> DataFrame:
    d = c.t("documents")
    return d.select("doc_id", Fl.head_chars("text", 120).alias("head"),
                    Fl.head_words("text", 12).alias("topic"))


@query("l2_newest_projects")
def _l2p(c: Ctx) -> DataFrame:
    """L2 every project of a user, newest first"""
    return Fl.newest_projects(c.projects)


@query("l3_milestones_by_id")
def _l3i(c: Ctx) -> DataFrame:
    """L3 milestones by order_index, id; several share an index"""
    m = (c.milestones.groupBy("project_id", "order_index").agg(F.min("deadline").alias("deadline"), F.max("status").alias("status"))
         .withColumn("id", F.col("project_id") * 10 + F.col("order_index")))  # the table repeats line numbers
    return Fl.milestone_positions(m.withColumn("order_index", F.col("order_index") % 3))


@query("f8_migrate")
def _f8(c: Ctx) -> DataFrame:
    """F8 files of an old and a new schema in one folder, read with the defaults of the columns the old ones lack"""
    path = _scratch(c, "f8")
    p = c.problems
    p.filter(F.col("id") % 2 == 0).select("id", "user_id", "name").write.parquet(path)
    (p.filter(F.col("id") % 2 == 1).select("id", "user_id", "name", "status",
                                           F.when(F.col("id") % 3 != 0, F.col("import_batch")).alias("import_batch"))
     .write.mode("append").parquet(path))
    return Fl.read_migrated(c.spark, path, {"status": ("string", "Pending"), "import_batch": ("string", ""),
                                            "revision": ("bigint", 1)})


@query("f9_claim_orphans")
def _f9(c: Ctx) -> DataFrame:
    """F9 rows without an owner in every table with one go to the first user: rows per table and owner"""
    tables = {"problems": c.problems, "daily_plan": c.daily_plan, "daily_log": c.daily_log, "projects": c.projects,
              "settings": c.settings, "feedback": c.feedback, "imports": c.imports, "activity": c.activity}
    owner = F.when(F.col("user_id") % 3 != 0, F.col("user_id")).alias("user_id")
    counts = [df.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("tab"), "user_id", "rows")
              for name, df in Fl.claim_all({n: df.select(owner) for n, df in tables.items()}, 1).items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("w5_last_wins")
def _w5(c: Ctx) -> DataFrame:
    """W5 stored settings and a stream of versioned changes: the highest version per key, else the stored value"""
    ch = c.t("events").filter(F.col("event_type") != "view").select(
        "user_id", F.when(F.col("event_type") == "error", "name").otherwise("daily_goal").alias("key"),
        (F.col("event_id") % 20).cast("string").alias("value"), F.col("event_id").alias("version"))
    return W.last_wins(c.settings, ch, ["user_id", "key"])


# --- I: table changes -----------------------------------------------------
from ..operators import changes as I  # noqa: E402

CATEGORY = "economy"
BATCH_ID = "tasks.xlsx_20240120000000"


@query("i1_import_add")
def _i1(c: Ctx) -> DataFrame:
    return I.import_add(c.problems, c.tasks, BATCH_ID)


@query("a11_import_totals")
def _a11(c: Ctx) -> DataFrame:
    return I.import_totals(I.import_flags(c.problems, c.tasks))


@query("i2_import_replace")
def _i2(c: Ctx) -> DataFrame:
    return I.import_replace(c.problems, c.imports, c.tasks, BATCH_ID)


@query("i2_plan_left")
def _i2p(c: Ctx) -> DataFrame:
    return I.replaced_plan(c.problems, c.daily_plan, c.imports, c.tasks)


@query("i3_ledger_rows")
def _i3(c: Ctx) -> DataFrame:
    totals = I.import_totals(I.import_flags(c.problems, c.tasks))
    files = c.tasks.select("user_id", F.concat("category", F.lit(".xlsx")).alias("filename")).distinct()
    return I.ledger_rows(totals, files, BATCH_ID, AS_OF_LOG)


@query("i4_toggle_protection")
def _i4(c: Ctx) -> DataFrame:
    imp = c.imports
    return I.toggle_protection(imp, imp.filter(F.col("filename").contains("blue")))


def _count_by_user(users: DataFrame, **tables: DataFrame) -> DataFrame:
    """Rows per user in each table: the tables' user ids are tagged and
    unioned, so one partially aggregated shuffle counts them all."""
    tagged = None
    for name, df in tables.items():
        t = df.select("user_id", F.lit(name).alias("_t"))
        tagged = t if tagged is None else tagged.unionByName(t)
    counts = tagged.groupBy("user_id").agg(*[F.count_if(F.col("_t") == n).alias(n) for n in tables])
    return (users.select(F.col("id").alias("user_id")).join(counts, "user_id", "left")
            .fillna(0, subset=list(tables)))


@query("i5_delete_range")
def _i5(c: Ctx) -> DataFrame:
    p, pl, _ = I.delete_problems(c.problems, c.daily_plan, c.imports,
                                 date_from="1996-01-01", date_to="1996-12-31")
    return _count_by_user(c.users, problems_left=p, plan_left=pl)


def _delete_batch(c: Ctx, batch: str) -> DataFrame:
    p, pl, refused = I.delete_problems(c.problems, c.daily_plan, c.imports, batch=batch)
    out = _count_by_user(c.users, problems_left=p, plan_left=pl)
    return out.join(refused.select("user_id", F.lit(True).alias("refused")), "user_id", "left").fillna(
        False, subset=["refused"])


@query("i5_delete_batch")
def _i5b(c: Ctx) -> DataFrame:
    """Batch of an odd-sized part: unprotected, so its rows go."""
    return _delete_batch(c, "batch_7")


@query("i5_refuse_batch")
def _i5r(c: Ctx) -> DataFrame:
    """Batch of an even-sized part: protected, so the delete is refused."""
    return _delete_batch(c, "batch_8")


@query("i6_clear_imports")
def _i6(c: Ctx) -> DataFrame:
    clearing = c.t("customer").filter(F.col("c_mktsegment") == "AUTOMOBILE").select(
        F.col("c_custkey").alias("user_id"))
    p, pl, lg, imp = I.clear_imports(c.problems, c.daily_plan, c.daily_log, c.imports, clearing)
    return _count_by_user(c.users, problems_left=p, plan_left=pl, log_left=lg, imports_left=imp)


@query("i5_delete_category")
def _i5c(c: Ctx) -> DataFrame:
    """I5 rows left after deleting one category, whatever its case (with plan cascade)"""
    p, pl, _ = I.delete_problems(c.problems, c.daily_plan, c.imports, category=CATEGORY.upper())
    return _count_by_user(c.users, problems_left=p, plan_left=pl)


@query("i7_problems_left")
def _i7p(c: Ctx) -> DataFrame:
    """I7 problems left after deleting problems"""
    ids = c.problems.filter((F.col("status") == "Skipped") & (F.col("difficulty") == "Hard"))
    p, _ = I.delete_one(c.problems, c.daily_plan, ids)
    return p.select("id", "user_id", "name", "status")


@query("i8_refresh_plans")
def _i8r(c: Ctx) -> DataFrame:
    """I8 the plan after every generated (user, day) has replaced the stored one"""
    return I.refresh_plans(c.daily_plan, I.generate_plans(c.problems))


@query("a2_named_categories")
def _a2n(c: Ctx) -> DataFrame:
    """A2 total and solved per (user, category) without blank categories, as the listing shows them"""
    blanked = c.problems.withColumn("category", F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.col("category")))
    return R.category_breakdown(blanked, drop_empty=True)


@query("i7_delete_one")
def _i7(c: Ctx) -> DataFrame:
    ids = c.problems.filter((F.col("status") == "Skipped") & (F.col("difficulty") == "Hard"))
    _, plan = I.delete_one(c.problems, c.daily_plan, ids)
    return plan


@query("i8_generate_plans")
def _i8(c: Ctx) -> DataFrame:
    return I.generate_plans(c.problems)


@query("i9_status_log")
def _i9(c: Ctx) -> DataFrame:
    _, _, log = I.apply_status_events(c.problems, c.daily_plan, c.daily_log, c.user_settings, c.status_events)
    return log


@query("i9_problem_status")
def _i9p(c: Ctx) -> DataFrame:
    p, _, _ = I.apply_status_events(c.problems, c.daily_plan, c.daily_log, c.user_settings, c.status_events)
    return p.select("id", "user_id", "status")


@query("i10_activity_upsert")
def _i10(c: Ctx) -> DataFrame:
    n = F.col("problems_solved")
    entries = c.activity.select("*", (n * 0.5).cast("double").alias("study_hours"),
                                F.when(n > 1, "good").otherwise("tired").alias("mood"),
                                F.concat(F.lit("views "), n.cast("string")).alias("notes"))
    return I.upsert_activity(c.daily_log, entries, c.user_settings)


@query("i11_milestone_completion")
def _i11(c: Ctx) -> DataFrame:
    m = c.milestones
    done = m.filter(F.col("deadline") <= F.lit("1995-06-30").cast("date")).select(
        "project_id", "order_index", F.lit("Done").alias("status")).distinct()
    return R.project_completion(c.projects, I.update_milestones(m, done, ["project_id", "order_index"]))


@query("i11_projects")
def _i11p(c: Ctx) -> DataFrame:
    """Two changes of every project of 1995 (the later one wins) and a new project beside each of 1997."""
    p = c.projects
    ch = p.filter(F.year("target_date") == 1995)
    ch = (ch.select("id", "user_id", F.lit("draft").alias("name"), "target_date", F.lit(1).alias("ts"))
          .unionByName(ch.select("id", "user_id", F.concat(F.lit("renamed "), F.col("id").cast("string")).alias("name"),
                                 F.date_add("target_date", 30).alias("target_date"), F.lit(2).alias("ts"))))
    new = p.filter(F.year("target_date") == 1997).select(
        (F.col("id") + F.lit(10_000_000_000)).alias("id"), "user_id",
        F.concat(F.lit("new "), F.col("id").cast("string")).alias("name"), "target_date")
    return I.add_projects(I.update_projects(p, ch), new)


@query("i11_milestones")
def _i11m(c: Ctx) -> DataFrame:
    """Milestones added (another user's are refused), updated (the later change wins) and deleted."""
    p, m, key = c.projects, c.milestones, ["project_id", "order_index"]
    new = p.filter(F.year("target_date") == 1997).select(
        F.col("id").alias("project_id"), "user_id", F.lit(100).alias("order_index"),
        F.date_add("target_date", 60).alias("deadline"))
    new = new.unionByName(new.withColumn("user_id", F.col("user_id") + 1))
    ch = m.filter(F.year("deadline") == 1995).select(*key).distinct()
    ch = (ch.select(*key, F.lit("Pending").alias("status"), F.lit(1).alias("ts"))
          .unionByName(ch.select(*key, F.lit("Done").alias("status"), F.lit(2).alias("ts"))))
    gone = (m.filter(F.col("deadline") < F.lit("1993-01-01").cast("date")).select(*key).distinct()
            .join(p.select(F.col("id").alias("project_id"), "user_id"), "project_id"))
    return I.delete_milestones(I.update_milestones(I.add_milestones(m, p, new), ch, key), p, gone, key)


@query("i12_settings_upsert")
def _i12(c: Ctx) -> DataFrame:
    ch = c.t("customer").filter(F.col("c_acctbal") > 5000).select(
        F.col("c_custkey").alias("user_id"), F.lit("daily_goal").alias("key"), F.lit("12").alias("value"))
    return I.upsert_settings(c.settings, ch)


@query("i13_mastery_upsert")
def _i13(c: Ctx) -> DataFrame:
    p = c.problems.withColumn("algorithm_id", F.col("id") % 200)
    old = (p.filter(F.col("status") == "Attempted").groupBy("user_id", "algorithm_id")
           .agg(F.lit("Learning").alias("mastery"), F.lit(0).cast("bigint").alias("solved_problems")))
    ch = (p.filter(F.col("status") == "Solved").groupBy("user_id", "algorithm_id")
          .agg(F.lit("Practicing").alias("mastery"), F.count(F.lit(1)).alias("solved_problems"),
               F.max("scheduled_date").alias("ts")))
    return I.upsert_mastery(old, ch)


# --- N: spreadsheet normalisation -----------------------------------------
from ..operators import sheets as N  # noqa: E402


@query("n1_header_map")
def _n1(c: Ctx) -> DataFrame:
    return N.header_map(N.sheet_headers(c.sheet_rows))


@query("n2_sheet_layouts")
def _n2(c: Ctx) -> DataFrame:
    return N.sheet_layouts(N.sheet_headers(c.sheet_rows))


@query("n3_normalise_sheets")
def _n3(c: Ctx) -> DataFrame:
    return N.normalise(c.sheet_rows)


@query("n13_upload_summary")
def _n13(c: Ctx) -> DataFrame:
    rows = c.sheet_rows
    return N.upload_summary(rows, N.normalise(rows))


@query("n8_link_platforms")
def _n8(c: Ctx) -> DataFrame:
    pg = c.t("pages")
    raw = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    link = N.repair_link(N.clean(raw))
    return pg.select("page_id", link.alias("link"), N.platform_of(link).alias("platform"))


@query("n10_parse_dates")
def _n10(c: Ctx) -> DataFrame:
    o = c.t("orders")
    d = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "MM/dd/yyyy"))
            .when(k == 2, F.date_format(d, "dd/MM/yyyy")).when(k == 3, F.date_format(d, "MMMM d yyyy"))
            .otherwise(F.concat(F.lit("Day "), F.dayofmonth(d).cast("string"))))
    return o.select("o_orderkey", text.alias("text")).select("o_orderkey", "text",
                                                             N.parse_date(F.col("text")).alias("parsed"))


@query("n11_difficulty_words")
def _n11(c: Ctx) -> DataFrame:
    o = c.t("orders")
    word = F.lower(F.regexp_replace("o_orderpriority", "^[0-9]+-", ""))
    return o.select("o_orderkey", word.alias("word"), N.difficulty_named(word).alias("named_layout"),
                    N.difficulty_topic_list(word).alias("topic_list_layout"))


# --- T: text tagging, routing, news -----------------------------------------
from ..operators import text as T  # noqa: E402


@query("t1_relevance")
def _t1(c: Ctx) -> DataFrame:
    return c.articles.select("seq", T.is_relevant("title").alias("relevant"))


@query("t2_topic_tags")
def _t2(c: Ctx) -> DataFrame:
    return c.articles.select("seq", T.topic_tag("title").alias("tag"))


@query("t2_tag_counts")
def _t2c(c: Ctx) -> DataFrame:
    return (c.articles.select(T.topic_tag("title").alias("tag"), T.is_relevant("title").alias("relevant"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("items"), F.count_if("relevant").alias("relevant_items")))


@query("t3_news_digest")
def _t3(c: Ctx) -> DataFrame:
    return T.merge_news(T.feed_items(c.articles), limit=9)


@query("t5_personal_intent")
def _t5(c: Ctx) -> DataFrame:
    return c.prompts.select("conv_id", "turn", T.needs_personal_context("message").alias("personal"))


@query("t6_resource_topic")
def _t6(c: Ctx) -> DataFrame:
    return c.prompts.select("conv_id", "turn", T.wants_resources("message").alias("wants_resources"),
                            T.resource_topic("message").alias("topic"))


@query("t7_resource_links")
def _t7(c: Ctx) -> DataFrame:
    p = c.prompts.filter(T.wants_resources("message"))
    return p.select("conv_id", "turn", T.resource_links(T.resource_topic("message")).alias("links"))


@query("t8_route")
def _t8(c: Ctx) -> DataFrame:
    return c.prompts.select("conv_id", "turn", T.route("message").alias("intent"))


@query("t8_route_counts")
def _t8c(c: Ctx) -> DataFrame:
    return c.prompts.groupBy(T.route("message").alias("intent")).agg(F.count(F.lit(1)).alias("messages"))


@query("s10_latest_feedback")
def _s10(c: Ctx) -> DataFrame:
    from ..operators.changes import latest
    fb = c.feedback
    return latest(fb.select("user_id", "feedback_date", "feedback_type", "content", "model_used", F.col("id").alias("ts")),
                  ["user_id", "feedback_date", "feedback_type"]).withColumnRenamed("ts", "id")


# --- T9-T13: reports and prompts --------------------------------------------
from . import reports as RP  # noqa: E402


def _context(c: Ctx) -> DataFrame:
    return RP.status_context(c.users, c.problems, c.daily_log, c.daily_plan, c.user_settings, AS_OF_LOG,
                             plan_day=AS_OF_PLAN)


@query("t9_status_context")
def _t9(c: Ctx) -> DataFrame:
    return _context(c).drop("context")


@query("t9_status_text")
def _t9t(c: Ctx) -> DataFrame:
    return _context(c).select("user_id", "context")


@query("t10_daily_report")
def _t10(c: Ctx) -> DataFrame:
    return RP.daily_report(c.users, c.problems, c.daily_log, c.daily_plan, c.user_settings, AS_OF_PLAN)


@query("t11_suggestion_report")
def _t11(c: Ctx) -> DataFrame:
    return RP.suggestion_report(c.users, c.problems, c.user_settings, AS_OF_LOG)


@query("t12_weekly_report")
def _t12(c: Ctx) -> DataFrame:
    return RP.weekly_report(c.users, c.problems, c.daily_log, c.user_settings, AS_OF_LOG)


@query("t10_daily_text")
def _t10t(c: Ctx) -> DataFrame:
    return RP.daily_text(_t10(c))


@query("t11_text")
def _t11t(c: Ctx) -> DataFrame:
    return RP.suggestion_text(_t11(c))


@query("t12_weekly_text")
def _t12t(c: Ctx) -> DataFrame:
    return RP.weekly_text(_t12(c))


@query("t12_news_report")
def _t12n(c: Ctx) -> DataFrame:
    return RP.news_report(T.merge_news(T.feed_items(c.articles), limit=6), 6)


@query("t8_answers")
def _t8a(c: Ctx) -> DataFrame:
    """T8 the rule-based answer of each message: the report of its route, the default text where none fits"""
    return RP.rule_answers(c.prompts, _t10t(c), _t12t(c), _t11t(c), _t12n(c).filter(F.col("run") == "0.0"))


@query("t13_prompts")
def _t13(c: Ctx) -> DataFrame:
    return RP.assemble_prompts(c.prompts, _context(c))


# --- S5/S6/S8: JSON columns -------------------------------------------------
from ..sources import files as SF  # noqa: E402


@query("s5_news_cache_json")
def _s5(c: Ctx) -> DataFrame:
    """Digest per run encoded as the cached JSON text, decoded back."""
    digest = T.merge_news(T.feed_items(c.articles), limit=9)
    enc = SF.encode_articles(digest, ["run"], ["rank"])
    dec = enc.select("run", SF.decode_articles("articles_json").alias("a"))
    return dec.select("run", F.size("a").cast("bigint").alias("articles"),
                      F.col("a")[0]["title"].alias("first_title"), F.element_at("a", -1)["score"].alias("last_score"))


@query("s6_resource_json")
def _s6(c: Ctx) -> DataFrame:
    cv = c.t("conversations").filter(F.col("role") == "assistant")
    r = SF.first_json_block("text")
    return cv.select("conv_id", "turn", r["youtube"].alias("youtube"), r["article"].alias("article"),
                     r["practice"].alias("practice"))


@query("s8_rows_json")
def _s8(c: Ctx) -> DataFrame:
    return SF.rows_as_json(c.users, keep=["id"])


@query("s6_stored_blocks")
def _s6b(c: Ctx) -> DataFrame:
    """S6 on answers that hold a block: flat, nested (cut at its first closing brace, so unreadable), broken, over lines."""
    kind = F.col("conv_id") % 4
    block = (F.when(kind == 0, F.format_string(' {"youtube": "y%s", "article": "a", "practice": "p"} {"youtube": "z"}', "turn"))
             .when(kind == 1, ' {"youtube": {"id": 1}, "article": "a"}').when(kind == 2, ' {"youtube": "x", article}')
             .otherwise('\n{\n"youtube": "y",\n"practice": null}\n'))
    r = SF.first_json_block(F.concat("text", block))
    return (c.t("conversations").filter(F.col("role") == "assistant")
            .select("conv_id", "turn", *[r[f].alias(f) for f in ("youtube", "article", "practice")]))


# --- X: streaming operators ---------------------------------------------------
from ..streaming import jobs as X  # noqa: E402
from ..streaming import stores as XS  # noqa: E402


@query("x3_daily_solved")
def _x3d(c: Ctx) -> DataFrame:
    return X.solved_windows(c.status_events)[0]


@query("x3_weekly_solved")
def _x3w(c: Ctx) -> DataFrame:
    return X.solved_windows(c.status_events)[1]


@query("x4_stream_routing")
def _x4(c: Ctx) -> DataFrame:
    """Routing run as a real stream: the conversations (one file or a folder of
    files) are read with ``readStream``, routed, written by an availableNow trigger
    into a fresh folder under ``spark.checkpoint.dir`` and read back."""
    import uuid

    from ..session import checkpoint_dir
    spark = c.spark
    base = f"{checkpoint_dir(spark).rstrip('/')}/x4-{uuid.uuid4().hex}"
    conv = c.t("conversations")
    # a stream's plain path must be a folder; a pattern may name a single file too
    stream = spark.readStream.schema(conv.schema).parquet(f"{c.t.sf_dir}/conversations.parque[t]")
    msgs = (stream.filter(F.col("role") == "user")
            .select("conv_id", "turn", F.concat("text", F.when(F.col("conv_id") % 5 == 0, " my progress today")
                                                  .when(F.col("conv_id") % 5 == 1, " weekly news")
                                                  .when(F.col("conv_id") % 5 == 2, " give me a sliding window tutorial")
                                                  .when(F.col("conv_id") % 5 == 3, " what should i plan")
                                                  .otherwise("")).alias("message")))
    routed = X.route_messages(msgs)
    q = (routed.writeStream.format("parquet").option("path", f"{base}/out")
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(routed.schema).parquet(f"{base}/out")


@query("t13_briefing_prompts")
def _t13b(c: Ctx) -> DataFrame:
    return RP.briefing_prompts(c.users, c.problems, c.daily_log, c.user_settings, AS_OF_LOG)


# --- S3/S9: file round trips on data derived from the tables -----------------
from ..sources import sinks as SK  # noqa: E402


def _scratch(c: Ctx, name: str) -> str:
    import uuid

    from ..session import checkpoint_dir
    return f"{checkpoint_dir(c.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


TASKS_PER_REQUEST = 1000


@query("s3_task_list_files")
def _s3(c: Ctx) -> DataFrame:
    """Import requests written as JSON lines and read back by the S3 reader.
    A request holds one user's tasks of one block of ``TASKS_PER_REQUEST``
    sequence numbers (in ``seq`` order), so no request grows with the data."""
    back = SF.read_task_lists(c.spark, _landed_requests(c))
    return back.select("user_id", "mode", "filename", F.col("pos").cast("bigint").alias("pos"), "name", "topic",
                       "category", "scheduled_date")


def _landed_requests(c: Ctx) -> str:
    t = c.tasks.withColumn("block", F.floor(F.col("seq") / TASKS_PER_REQUEST))
    req = (t.groupBy("user_id", "block")
           .agg(F.array_sort(F.collect_list(F.struct("seq", "name", "topic", "category"))).alias("_t"))
           .select("user_id", "block", F.lit("add").alias("mode"), F.concat(F.lit("tasks_"), F.col("block").cast("string"),
                                                                            F.lit(".xlsx")).alias("filename"),
                   F.transform("_t", lambda x: F.struct(x["name"].alias("name"), x["topic"].alias("topic"),
                                                        x["category"].alias("category"))).alias("tasks")))
    path = _scratch(c, "s3")
    req.repartitionByRange("block", "user_id").sortWithinPartitions("block", "user_id").drop("block").write.json(path)
    return path


@query("s3_to_i1")
def _s3i1(c: Ctx) -> DataFrame:
    """The requests read back and imported: first wins in the order of files, lines and tasks."""
    tasks = SF.read_task_lists(c.spark, _landed_requests(c), order="path")
    new = I.import_add(c.problems, tasks.drop("mode", "filename", "pos"), BATCH_ID)
    return new.drop("seq")


@query("s9_daily_cache")
def _s9(c: Ctx) -> DataFrame:
    """The full ranked news list cached for two days in a row: only the
    second day's partition is left; the read lists just that partition and
    cuts to the caller's limit there (Q14 fixed: the cache is not cut)."""
    full = T.merge_news(T.feed_items(c.articles), limit=None)
    path = _scratch(c, "s9")
    SK.write_daily_cache(full.filter(F.col("run") == "0.0"), path, "2024-01-19")
    SK.write_daily_cache(full, path, "2024-01-20")
    return SK.read_daily_cache(c.spark, path, "2024-01-20").filter(F.col("rank") <= 9)


@query("s9_cache_reuse")
def _s9r(c: Ctx) -> DataFrame:
    """S9 as one operator: a second call of the day reuses the cache, the next day rebuilds it, a forced call replaces it."""
    base = _scratch(c, "s9r")
    T.merge_news(T.feed_items(c.articles), limit=None).select("run", "rank", "url").write.parquet(f"{base}/ranked")
    ranked = c.spark.read.parquet(f"{base}/ranked")

    def top(n: int):
        return lambda: ranked.filter(F.col("rank") <= n)

    def calls(name: str, *steps) -> DataFrame:
        for day, n, force in steps:
            got = SK.daily_cache(c.spark, f"{base}/{name}", day, top(n), force)
        return got.withColumn("step", F.lit(name))

    a, b = "2024-01-19", "2024-01-20"
    return (calls("reused", (a, 2, False), (a, 5, False)).unionByName(calls("next_day", (a, 2, False), (b, 3, False)))
            .unionByName(calls("forced", (a, 2, False), (a, 4, True)))
            .unionByName(calls("empty", (a, 2, False), (a, 0, True), (a, 1, False))))


@query("x2_import_stream")
def _x2(c: Ctx) -> DataFrame:
    """Import requests as a stream: tasks land as parquet files, a
    ``foreachBatch`` sink imports each micro-batch in ``add`` mode against the
    stored keys of its buckets (written under ``spark.checkpoint.dir``); returns the rows
    the stream inserted."""
    spark = c.spark
    base = _scratch(c, "x2")
    XS.write_import_store(c.problems, f"{base}/store", buckets=8)
    c.tasks.write.parquet(f"{base}/tasks")
    schema = spark.read.parquet(f"{base}/tasks").schema
    q = (spark.readStream.schema(schema).parquet(f"{base}/tasks").writeStream
         .foreachBatch(X.KeyedImportSink(spark, f"{base}/store", buckets=8))
         .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(f"{base}/store/problems").filter(F.col("batch_no") >= 0).drop("batch_no")


@query("x1_status_stream")
def _x1(c: Ctx) -> DataFrame:
    """Status events as a stream: problems, plan and log are stored
    partitioned by month under ``spark.checkpoint.dir``; the ``foreachBatch``
    sink rewrites only the touched partitions; returns the log after the
    stream (equal to the batch I9 result)."""
    spark = c.spark
    base = _scratch(c, "x1")
    root = f"{base}/tables"
    for df, name in ((c.problems, "problems"), (c.daily_plan, "daily_plan"), (c.daily_log, "daily_log")):
        part = X.partition_column(name, "month")
        # rebalanced, so that a large month is written by several tasks
        (X.with_partition_column(df, name, "month").hint("rebalance", part).write.partitionBy(part)
         .parquet(f"{root}/{name}"))
    c.status_events.write.parquet(f"{base}/events")
    schema = spark.read.parquet(f"{base}/events").schema
    stored = spark.read.parquet(f"{root}/problems")
    buckets = max(8, -(-stored.count() // 1_000_000))       # a bucket holds about a million rows
    X.StatusEventSink(spark, root, c.user_settings, "month", index_buckets=buckets).write_index(stored)
    q = X.start_status_stream(spark, f"{base}/events", schema, root, c.user_settings, f"{base}/state",
                              granularity="month", index_buckets=buckets)
    q.awaitTermination()
    return spark.read.parquet(f"{root}/daily_log").drop("log_month")


def _window_stream(c: Ctx, weekly: bool) -> DataFrame:
    base = _scratch(c, "x3")
    events = c.status_events.select("user_id", "status", F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(4).write.parquet(f"{base}/events")
    X.start_window_stream(c.spark, f"{base}/events", events.schema, f"{base}/windows", f"{base}/state", weekly,
                          files_per_batch=2).awaitTermination()
    return c.spark.read.parquet(f"{base}/windows").drop("month")


@query("x3_daily_stream")
def _x3ds(c: Ctx) -> DataFrame:
    """The daily counts kept by a stream of several micro-batches: stored windows, replaced as they change."""
    return _window_stream(c, False)


@query("x3_weekly_stream")
def _x3ws(c: Ctx) -> DataFrame:
    """The Monday-week counts kept by a stream of several micro-batches."""
    return _window_stream(c, True)


@query("i9_plan")
def _i9plan(c: Ctx) -> DataFrame:
    """I9 the plan after status events"""
    return I.apply_status_events(c.problems, c.daily_plan, c.daily_log, c.user_settings, c.status_events)[1]


@query("s2_sheet_files")
def _s2(c: Ctx) -> DataFrame:
    """Two sheets written as CSV files (several part files each, every one
    with its header row) and read back by the S2 reader, then normalised;
    file and row identities are dropped since they depend on the writer."""
    from ..sources.adapters import wide_sheets
    base = _scratch(c, "s2")
    for name, df in wide_sheets(c.t).items():
        df.write.option("header", "true").csv(f"{base}/{name.replace(' ', '_')}")
    tasks = N.normalise(SF.read_sheets(c.spark, f"{base}/*/*.csv"))
    return tasks.select("name", "category", "topic", "difficulty", "platform", "problem_link", "resource_link",
                        "scheduled_date", "status")


@query("s4_json_feed_files")
def _s4(c: Ctx) -> DataFrame:
    """Feed items landed as JSON lines and read back by the S4 reader."""
    base = _scratch(c, "s4")
    (c.articles.select(F.col("seq").alias("id"), "title", "url", "score",
                       F.array("tag_hint").alias("tag_list")).write.json(base))
    return SF.read_json_feed(c.spark, base, "feed", multi_line=False).drop("seq")


@query("s4_to_t3")
def _s4t3(c: Ctx) -> DataFrame:
    """Feed items of all runs landed as JSON lines in feed order, read back with their run, kind and order, and merged."""
    base = _scratch(c, "s4t3")
    (T.feed_runs(c.articles).repartitionByRange("seq").sortWithinPartitions("seq")
     .select("run", "kind", "source", "url", "title", "score", F.array("tag_hint").alias("tag_list")).write.json(base))
    return T.merge_news(T.feed_items(SF.read_feeds(c.spark, base).drop("tag_no")), limit=9)


@query("s4_rss")
def _s4rss(c: Ctx) -> DataFrame:
    """Items written as RSS elements and read back by the RSS reader."""
    base = _scratch(c, "rss")
    text = F.trim(F.regexp_replace(F.substring("title", 1, 120), r"\s+", " "))
    (c.articles.select(text.alias("title"), F.col("url").alias("link")).write.format("xml")
     .option("rootTag", "channel").option("rowTag", "item").save(base))
    return SF.read_rss(c.spark, base, "rss").drop("seq")


# One line per key for ``python -m pacegrid list`` (where the function has no docstring).
DESCRIPTIONS = {
    "a1_status_rollup": "A1 total/solved/attempted/pending/skipped per user",
    "a2_category_breakdown": "A2 total and solved per (user, category)",
    "a3_top_skipped_topics": "A3 three most-skipped topics per user",
    "a4_plan_progress": "A4 solved plan rows today/week/month against the goal",
    "a5_category_coverage": "A5 share of categories with a solved problem",
    "a6_readiness": "A6 readiness score per user (flagship)",
    "a7_pace": "A7 days left and problems needed per day",
    "a8_project_completion": "A8 milestone completion per project",
    "a9_plan_day_log": "A9 solved plan rows per (user, day) as log rows",
    "a10_weekly_summary": "A10 week's solved count, studied days and band",
    "a11_import_totals": "A11 imported and skipped-duplicate counts per user",
    "a12_plan_existence": "A12 plan rows present per wanted (user, day)",
    "f1_problem_search": "F1 problem search by category/status/difficulty/text",
    "f2_topic_view": "F2 per-user topic totals and the first catalog match",
    "f3_catalog_search": "F3 catalog search by name/pattern/description",
    "f4_distinct_topics": "F4 distinct non-empty topics per user",
    "f5_problems_in_range": "F5 problems scheduled in a date range",
    "f6_owned_milestones": "F6 milestones with the owner of their project",
    "f7_fill_defaults": "F7 new-row defaults for incoming tasks",
    "j1_plan_with_problems": "J1 plan rows joined to their problems",
    "j2_plan_rows_in_category": "J2 plan rows whose problem is in a category (semi join)",
    "j3_unprotected_problems": "J3 problems outside the user's protected batches (anti join)",
    "j4_new_tasks": "J4 incoming tasks not already stored (anti join)",
    "j5_catalog_seed": "J5 catalog plus absent seed entries",
    "j6_yesterday_solved": "J6 yesterday's solved count per user, 0 if no log row",
    "l2_recent_logs": "L2 14 most recent log days per user",
    "l2_recent_imports": "L2 50 newest import-ledger rows per user",
    "l3_milestone_order": "L3 milestone positions within their project",
    "l4_top_articles": "L4 top 9 articles by score",
    "l5_source_caps": "L5 first 5 items per feed source",
    "l6_heads": "L6 first 120 characters and first 12 words of each document",
    "n1_header_map": "N1 header-to-field mapping per sheet",
    "n2_sheet_layouts": "N2/N7 layout and category per sheet",
    "n3_normalise_sheets": "N3-N6, N9-N12 all sheets as one task table",
    "n8_link_platforms": "N8/N9 repaired links and their platform",
    "n10_parse_dates": "N10 dates parsed from several text formats",
    "n11_difficulty_words": "N11 difficulty words mapped for both layouts",
    "n13_upload_summary": "N13 sheets and task count per file",
    "i1_import_add": "I1 rows inserted by an add-mode import",
    "i2_import_replace": "I2 problems table after a replace-mode import",
    "i2_plan_left": "I2 plan rows left after a replace-mode import",
    "i3_ledger_rows": "I3 import-ledger rows of a batch",
    "i4_toggle_protection": "I4 ledger after toggling protection",
    "i5_delete_range": "I5 rows left after deleting a date range (with plan cascade)",
    "i5_delete_batch": "I5 rows left after deleting an unprotected batch",
    "i5_refuse_batch": "I5 a protected batch: the delete is refused",
    "i6_clear_imports": "I6 rows left after clearing imports",
    "i7_delete_one": "I7 plan rows left after deleting problems",
    "i8_generate_plans": "I8 generated plans for every (user, day)",
    "i9_status_log": "I9 activity log after status events",
    "i9_problem_status": "I9 problem statuses after status events",
    "i10_activity_upsert": "I10 activity log after activity entries",
    "i11_milestone_completion": "I11 project completion after milestone updates",
    "i12_settings_upsert": "I12 settings after an upsert",
    "i13_mastery_upsert": "I13 per-user mastery after an upsert",
    "s2_sheet_files": "S2 CSV sheet files read back and normalised",
    "s3_task_list_files": "S3 JSON import requests read back",
    "s4_json_feed_files": "S4 JSON feed items read back",
    "s5_news_cache_json": "S5 news digest encoded to and decoded from JSON",
    "s6_resource_json": "S6 first JSON block in a text",
    "s7_user_settings": "S7 per-user settings with defaults",
    "s8_rows_json": "S8 rows as JSON objects",
    "s9_daily_cache": "S9 daily news cache with expiry",
    "s10_latest_feedback": "S10 latest stored feedback per (user, day, type)",
    "t1_relevance": "T1 relevance flag of each item",
    "t2_topic_tags": "T2 topic tag of each item",
    "t2_tag_counts": "T2 items and relevant items per tag",
    "t3_news_digest": "T3/T4 news merge: gates, caps, dedup, ranking",
    "t5_personal_intent": "T5 personal-status intent of each message",
    "t6_resource_topic": "T6 resource intent and topic of each message",
    "t7_resource_links": "T7 resource links for resource questions",
    "t8_route": "T8 report route of each message",
    "t8_route_counts": "T8 messages per route",
    "t9_status_context": "T9 structured status context per user",
    "t9_status_text": "T9 status context text per user",
    "t10_daily_report": "T10 daily report per user",
    "t11_suggestion_report": "T11 suggestion report per user",
    "t12_weekly_report": "T12 weekly report per user",
    "t10_daily_text": "T10 daily report text per user",
    "t11_text": "T11 suggestion text per user",
    "t12_weekly_text": "T12 weekly report text per user",
    "t12_news_report": "T12 news report per feed run",
    "t13_prompts": "T13 assembled coach prompts",
    "t13_briefing_prompts": "T13 daily briefing prompt per user",
    "w1_streak": "W1 solve streak per user",
    "w2_plan_order": "W2 position of each problem in its (user, day)",
    "w3_daily_series": "W3 30-day solved/target series per user",
    "w4_first_wins_articles": "W4/T4 first-wins dedup on the title key",
    "x1_status_stream": "X1 status-event stream keeping plan/log/problems current",
    "x2_import_stream": "X2 import stream deduplicated across batches",
    "x3_daily_solved": "X3 solved events per user per day",
    "x3_weekly_solved": "X3 solved events per user per Monday week",
    "x4_stream_routing": "X4 message routing on a stream",
}
for _k, _d in DESCRIPTIONS.items():
    if _k in QUERIES and not QUERIES[_k].__doc__:
        QUERIES[_k].__doc__ = _d
