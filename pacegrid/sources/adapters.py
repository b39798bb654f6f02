"""Tracker tables as views over the driver's tables.

The tracker's own tables (users, problems, daily_log, ...) are not given, so
each is defined as a projection/join of the TPC-H-like tables.  Every view
grows with the scale factor; none holds literal rows.  The same definitions
exist as SQL text in ``pacegrid.plans.oracle_views`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import Tables


def _date(c: str) -> Column:
    return F.col(c).cast("date")


def users(t: Tables) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))


def _order_parts(t: Tables) -> DataFrame:
    """Orders with the part their key maps to: part keys are 0..n-1, and orders go round all of them,
    so the key space grows with the data.  A plain equi-join; the planner picks its strategy."""
    o, p = t("orders"), t("part")
    n = t("part").agg(F.count(F.lit(1)).alias("n")).scalar()
    o = o.withColumn("_part", F.col("o_orderkey") % n)
    return o.join(p, o["_part"] == p["p_partkey"], "inner").drop("_part")


def problems(t: Tables) -> DataFrame:
    """One problem per order; category/topic from the part its key maps to."""
    j = _order_parts(t)
    difficulty = (F.when(F.col("o_orderpriority") == "5-LOW", "Easy")
                  .when(F.col("o_orderpriority") == "3-MEDIUM", "Medium")
                  .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "High")
                  .otherwise("Hard"))
    status = (F.when(F.col("o_orderstatus") == "F", "Solved")
              .when(F.col("o_orderstatus") == "O", "Pending")
              .when(F.col("o_orderkey") % 2 == 0, "Attempted")
              .otherwise("Skipped"))
    return j.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("item "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("p_type").alias("category"),
        F.col("p_name").alias("topic"),
        difficulty.alias("difficulty"),
        status.alias("status"),
        _date("o_orderdate").alias("scheduled_date"),
        F.concat(F.lit("batch_"), F.col("p_partkey").cast("string")).alias("import_batch"),
        F.lit("Custom").alias("platform"),
        F.lit("").alias("problem_link"),
        F.lit("").alias("resource_link"),
    )


def daily_log(t: Tables) -> DataFrame:
    """One row per (user, day) of events: purchases = solved, clicks = attempted."""
    e = t("events")
    return (e.groupBy("user_id", _date("ts").alias("log_date"))
            .agg(F.count_if(F.col("event_type") == "purchase").alias("problems_solved"),
                 F.count_if(F.col("event_type") == "click").alias("problems_attempted"),
                 F.count_if(F.col("event_type") == "error").alias("problems_skipped"))
            .withColumn("problems_target", F.lit(10).cast("bigint")))


def daily_plan(t: Tables) -> DataFrame:
    l, o = t("lineitem"), t("orders")
    status = (F.when(F.col("l_returnflag") == "R", "Solved")
              .when(F.col("l_returnflag") == "A", "Pending").otherwise("Skipped"))
    return (l.join(o, l.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("o_custkey").alias("user_id"), _date("l_shipdate").alias("plan_date"),
                    F.col("l_orderkey").alias("problem_id"), F.col("l_linenumber").alias("order_index"),
                    status.alias("status")))


def projects(t: Tables) -> DataFrame:
    return t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("project "), F.col("o_orderkey").cast("string")).alias("name"),
        _date("o_orderdate").alias("target_date"))


def milestones(t: Tables) -> DataFrame:
    return t("lineitem").select(
        F.col("l_orderkey").alias("project_id"), F.col("l_linenumber").alias("order_index"),
        _date("l_shipdate").alias("deadline"),
        F.when(F.col("l_linestatus") == "F", "Done").otherwise("Pending").alias("status"))


def algorithms(t: Tables) -> DataFrame:
    return t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                            F.col("p_type").alias("pattern"), F.col("p_brand").alias("description"))


def settings(t: Tables) -> DataFrame:
    """Long (user_id, key, value).  Building-segment customers keep no goal and
    machinery-segment customers no deadline, so the defaults are exercised;
    goal 0 occurs too."""
    c = t("customer")
    name = c.select(F.col("c_custkey").alias("user_id"), F.lit("name").alias("key"),
                    F.col("c_name").alias("value"))
    goal = (c.filter(F.col("c_mktsegment") != "BUILDING")
            .select("c_custkey", F.lit("daily_goal"), (F.col("c_custkey") % 13).cast("string")))
    deadline = (c.filter(F.col("c_mktsegment") != "MACHINERY")
                .select("c_custkey", F.lit("placement_deadline"),
                        F.when(F.col("c_nationkey") % 2 == 0, "2024-03-01").otherwise("2024-01-05")))
    return name.unionByName(goal.toDF("user_id", "key", "value")).unionByName(
        deadline.toDF("user_id", "key", "value"))


def articles(t: Tables) -> DataFrame:
    """Feed items: one per document; the whole text is the item's title
    (relevance and tags read all of it, the news merge stores 120 characters)
    and the language is the item's own tag."""
    return t("documents").select(
        F.col("doc_id").alias("seq"), "source",
        F.concat(F.lit("doc://"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("title"), F.col("n_chars").alias("score"), F.col("lang").alias("tag_hint"))


def feedback(t: Tables) -> DataFrame:
    """Stored coach feedback: one row per assistant turn, several per
    (user, day, type) so that "latest wins" has work (Q5)."""
    c = t("conversations").filter(F.col("role") == "assistant")
    kind = F.when(F.col("turn") % 3 == 0, "daily").when(F.col("turn") % 3 == 1, "coach").otherwise("weekly")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("user_id"),
                    F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn") / 4).cast("int")).alias("feedback_date"),
                    kind.alias("feedback_type"), F.col("text").alias("content"), F.lit("rule-based").alias("model_used"))


def imports(t: Tables) -> DataFrame:
    """Import ledger: one row per (user, batch) present in ``problems``;
    even-sized parts mark a protected batch."""
    j = _order_parts(t)
    return (j.groupBy(F.col("o_custkey").alias("user_id"), "p_partkey", "p_name", "p_size")
            .agg(F.min("o_orderkey").alias("id"), F.count(F.lit(1)).alias("total_imported"),
                 F.min(_date("o_orderdate")).alias("import_date"))
            .select("id", "user_id",
                    F.concat(F.col("p_name"), F.lit(".csv")).alias("filename"),
                    F.concat(F.lit("batch_"), F.col("p_partkey").cast("string")).alias("batch_id"),
                    (F.col("p_size") % 2 == 0).alias("protected"),
                    "total_imported", "import_date"))


def prompts(t: Tables) -> DataFrame:
    """User turns with routing phrases appended (the invented prose holds none)."""
    c = t("conversations").filter(F.col("role") == "user")
    suffix = (F.when(F.col("conv_id") % 5 == 0, " my progress today")
              .when(F.col("conv_id") % 5 == 1, " weekly news")
              .when(F.col("conv_id") % 5 == 2, " give me a sliding window tutorial")
              .when(F.col("conv_id") % 5 == 3, " what should i plan").otherwise(""))
    return c.select("conv_id", "turn", F.concat("text", suffix).alias("message"))


def tasks(t: Tables) -> DataFrame:
    """Incoming import tasks: one per part (user = part key mod 15), plus
    re-imports of every skipped problem with a padded name, so both the
    in-batch and the against-store duplicate rules have work."""
    p = t("part").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 15).alias("user_id"),
                         F.col("p_name").alias("name"), F.col("p_type").alias("topic"),
                         F.col("p_brand").alias("category"))
    again = (problems(t).filter(F.col("status") == "Skipped")
             .select((F.col("id") + F.lit(10_000_000_000)).alias("seq"), "user_id",
                     F.concat(F.lit(" "), F.col("name"), F.lit(" ")).alias("name"), "topic", "category"))
    return p.unionByName(again)


def status_events(t: Tables) -> DataFrame:
    """Status changes: every open line item toggles its plan row; several
    events per (problem, day) so that last-wins matters."""
    l, o = t("lineitem"), t("orders")
    return (l.filter(F.col("l_linestatus") == "O")
            .join(o, l.l_orderkey == o.o_orderkey, "inner")
            .select(F.col("o_custkey").alias("user_id"), F.col("l_orderkey").alias("problem_id"),
                    _date("l_shipdate").alias("plan_date"),
                    F.when(F.col("l_discount") > 0.05, "Solved").otherwise("Attempted").alias("status"),
                    (F.col("l_shipdate") + F.make_interval(hours=F.col("l_linenumber"))
                     ).cast("timestamp_ntz").alias("ts")))


def activity(t: Tables) -> DataFrame:
    """Activity entries (I10): one per (user, day) of 'view' events."""
    e = t("events").filter(F.col("event_type") == "view")
    return (e.groupBy("user_id", _date("ts").alias("log_date"))
            .agg(F.count(F.lit(1)).alias("problems_solved"),
                 F.max("ts").alias("ts")))


def _sheet(df: DataFrame, source_file: str, sheet: str, row_no: str,
           columns: list[tuple[str, Column]]) -> DataFrame:
    """The rows of a sheet built from a table: its headers beside each row's texts."""
    return df.select(
        F.lit(source_file).alias("source_file"), F.lit(sheet).alias("sheet"), F.col(row_no).cast("bigint").alias("row_no"),
        F.array(*[F.lit(h) for h, _ in columns]).alias("headers"),
        F.array(*[v.cast("string") for _, v in columns]).alias("values"))


def _topics_columns() -> list[tuple[str, Column]]:
    """Topic-list sheet (layout B) over nation."""
    return [
        ("Topic", F.col("n_name")),
        ("Priority", F.when(F.col("n_nationkey") % 3 == 0, "Must").when(F.col("n_nationkey") % 3 == 1, "low")
         .otherwise("nan")),
        ("Ref", F.concat(F.lit("site.org/"), F.lower("n_name"))),
    ]


def _grid_columns() -> list[tuple[str, Column]]:
    """Day-grid sheet (layout C) over orders."""
    return [
        ("Day", F.when(F.col("o_orderstatus") == "P", "nan")
         .otherwise(F.concat(F.lit("Day "), (F.col("o_orderkey") % 30 + 1).cast("string")))),
        ("DSA", F.col("o_orderpriority")),
        ("Aptitude", F.when(F.col("o_orderstatus") == "O", "")
         .otherwise(F.concat(F.lit("apt "), F.col("o_custkey").cast("string")))),
        ("HR round", F.when(F.col("o_orderkey") % 7 == 0, "none").otherwise("intro")),
        ("System Design", F.concat(F.lit("sd "), (F.col("o_custkey") % 9).cast("string"))),
        ("Misc", F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string"))),
    ]


def wide_sheets(t: Tables) -> dict[str, DataFrame]:
    """The topic-list and day-grid sheets in their wide form (one column per
    header), as a workbook would hold them."""
    return {"Topics": t("nation").select(*[v.alias(h) for h, v in _topics_columns()]),
            "Week Plan": t("orders").select(*[v.alias(h) for h, v in _grid_columns()])}


def sheet_rows(t: Tables) -> DataFrame:
    """Four sheets, one per layout, built from part, nation and orders, with
    the traps of FIXTURES.md: blank/'nan'/'NONE' cells, padded and mixed-case
    headers, two headers equal after folding, links without a scheme, dates
    in several formats and an unparseable one, a sheet named 'hr round'."""
    p, n, o = t("part"), t("nation"), t("orders")
    due = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int"))
    named = _sheet(p, "bank.xlsx", "DSA Sheet", "p_partkey", [
        ("Problem", F.when(F.col("p_size") % 10 == 0, "nan").when(F.col("p_size") % 10 == 5, " NONE ")
         .otherwise(F.col("p_name"))),
        ("Topic", F.col("p_type")),
        (" LEVEL ", F.when(F.col("p_size") % 4 == 0, "easy").when(F.col("p_size") % 4 == 1, "HARD")
         .when(F.col("p_size") % 4 == 2, " must ").otherwise("Optional")),
        ("Link", F.when(F.col("p_partkey") % 3 == 0,
                        F.concat(F.lit("leetcode.com/problems/"), F.regexp_replace("p_name", " ", "-")))
         .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("//www.geeksforgeeks.org/"), F.lower("p_brand")))
         .otherwise("nan")),
        ("Due", F.when(F.col("p_partkey") % 4 == 0, F.date_format(due, "yyyy-MM-dd"))
         .when(F.col("p_partkey") % 4 == 1, F.date_format(due, "MM/dd/yyyy"))
         .when(F.col("p_partkey") % 4 == 2, F.date_format(due, "dd/MM/yyyy"))
         .otherwise(F.concat(F.lit("Day "), (F.col("p_partkey") % 30).cast("string")))),
        ("topic", F.col("p_brand")),
    ])
    topics = _sheet(n, "bank.xlsx", "Topics", "n_nationkey", _topics_columns())
    grid = _sheet(o, "plan.csv", "Week Plan", "o_orderkey", _grid_columns())
    unknown = _sheet(n, "misc.csv", "hr round", "n_nationkey", [
        ("c1", F.col("n_name")),
        ("c2", F.when(F.col("n_regionkey") == 0, "nan")
         .otherwise(F.concat(F.lit("Region "), F.col("n_regionkey").cast("string")))),
        ("c3", F.when(F.col("n_nationkey") % 2 == 0,
                      F.concat(F.lit("http://x.y/"), F.col("n_nationkey").cast("string"))).otherwise("")),
    ])
    return named.unionByName(topics).unionByName(grid).unionByName(unknown)


def sheet_cells(t: Tables) -> DataFrame:
    """The same sheets in the long form: one row per cell."""
    cell = F.posexplode(F.arrays_zip("headers", "values")).alias("_k", "_c")
    return sheet_rows(t).select("source_file", "sheet", "row_no", cell).select(
        "source_file", "sheet", "row_no", (F.col("_k") + 1).alias("col_no"),
        F.col("_c.headers").alias("header"), F.col("_c.values").alias("value"))
