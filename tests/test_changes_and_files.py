"""Cases of the change operators, sheet files and feeds that the fixtures do not contain."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pacegrid.operators import changes as I
from pacegrid.operators import sheets as N
from pacegrid.operators import text as T
from pacegrid.sources import files as SF

D = dt.date


@pytest.mark.parametrize("text", [
    "2026/01/02", "01-02-2026", "January 2, 2026", "Jan 2, 2026", "2 Jan 2026", "2026-1-2", "1/2/26", "20260102",
    "2026-01-02T00:00:00", "2026-01-02 00:00:00.000"])
def test_ordinary_date_texts(spark, text):
    got = spark.range(1).select(N.parse_date(F.lit(text)).alias("d")).first().d
    assert got == D(2026, 1, 2)


def test_equal_file_names_stay_apart(spark, tmp_dir):
    for folder, name in (("a", "Two Sum"), ("b", "BFS")):
        os.makedirs(f"{tmp_dir}/{folder}")
        with open(f"{tmp_dir}/{folder}/plan.csv", "w") as f:
            f.write(f"Name,Topic\n{name},t\n")
    cells = SF.read_sheets(spark, f"{tmp_dir}/*/plan.csv")
    tasks = N.normalise(cells)
    assert sorted(r.name for r in tasks.collect()) == ["BFS", "Two Sum"]
    assert [r.sheets for r in N.upload_summary(cells, tasks).collect()] == ["plan.csv::plan"] * 2


def test_import_seq_repeats_across_users(spark):
    problems = spark.createDataFrame([(1, "x", "t")], "user_id long, name string, topic string")
    tasks = spark.createDataFrame([(1, 0, "x", "t"), (2, 0, "x", "t"), (2, 1, " x ", "t"), (2, 2, " ", "t")],
                                  "user_id long, seq long, name string, topic string")
    got = sorted((r.user_id, r.seq, r.outcome) for r in I.import_flags(problems, tasks).collect())
    assert got == [(1, 0, "duplicate"), (2, 0, "imported"), (2, 1, "duplicate"), (2, 2, "blank")]


def test_project_changes_of_other_users_are_ignored(spark):
    p = spark.createDataFrame([(1, 10, "a", "Done"), (2, 20, "b", "Done")],
                              "id long, user_id long, name string, status string")
    ch = spark.createDataFrame([(1, 10, "a1", 1), (1, 10, "a2", 2), (2, 10, "stolen", 1)],
                               "id long, user_id long, name string, ts int")
    got = sorted(tuple(r) for r in I.update_projects(p, ch).collect())
    assert got == [(1, 10, "a2", "In Progress"), (2, 20, "b", "Done")]
    new = spark.createDataFrame([(3, 10)], "id long, user_id long")
    assert ("", "In Progress") in [(r.name, r.status) for r in I.add_projects(p, new).collect()]


def test_two_milestone_changes_give_one_row(spark):
    m = spark.createDataFrame([(1, 0, "Pending")], "project_id long, order_index int, status string")
    ch = spark.createDataFrame([(1, 0, "Done", 2), (1, 0, "Pending", 1)],
                               "project_id long, order_index int, status string, ts int")
    assert [tuple(r) for r in I.update_milestones(m, ch, ["project_id", "order_index"]).collect()] == [(1, 0, "Done")]


def test_feed_items_with_named_sources(spark):
    a = spark.createDataFrame([(1, "Feed", "scored", 0, "a", "u", 30, "x"), (2, "Feed", "scored", 0, None, None, None, None)],
                              "seq long, source string, kind string, run int, title string, url string, score long, tag_hint string")
    assert sorted((r.seq, r.pos) for r in T.feed_items(a).collect()) == [(1, 1), (2, 2)]
    assert T.feed_items(a.drop("kind", "run")).count() == 0


def test_every_block_of_items_has_its_runs(spark):
    a = spark.range(1300).selectExpr("id as seq", "concat('src', id % 20) as source", "'python trick ' || id as title",
                                     "'u' || id as url", "30L as score", "'x' as tag_hint")
    items = T.feed_items(a)
    runs = {f"{b}.{k}" for b in range(3) for k in range(4)}
    assert {r.run for r in items.select("run").distinct().collect()} == runs
    assert items.count() == 1300  # 30 or fewer of each source in a block of 600
    assert {r.run for r in T.merge_news(items).filter("rank = 1").collect()} == runs


def test_runs_of_any_number_of_sources_stay_apart(spark):
    a = spark.createDataFrame([(600, "src0", "t", "u", 30, "x"), (1, "src20", "t", "u", 30, "x"), (1, "src25", "t", "u", 30, "x"),
                               (601, "src5", "t", "u", 30, "x")],
                              "seq long, source string, title string, url string, score long, tag_hint string")
    assert {r.run for r in T.feed_items(a).collect()} == {"1.0", "0.4", "0.5", "1.1"}


def test_queried_tags_make_the_blocks(spark):
    """Tags that returned fewer than five items: the stop is checked after each tag, not after every fifth item."""
    rows = [(k, "dev", "tagged", "r", no, f"python item {k}", f"u{k}", 0, "t") for k, no in enumerate([0] * 3 + [1] * 5 + [2] * 5 + [3] * 2 + [4] * 5)]
    a = spark.createDataFrame(rows, "seq long, source string, kind string, run string, tag_no int, title string, url string, score long, tag_hint string")
    got = {r.title for r in T.merge_news(T.feed_items(a), limit=None).collect()}
    assert got == {f"python item {k}" for k in range(15)}        # 3 + 5 + 5 < 14, so the fourth tag runs; 15 stops the fifth


def test_equal_tasks_with_one_seq_are_imported_once(spark):
    problems = spark.createDataFrame([(9, "x", "t")], "user_id long, name string, topic string")
    tasks = spark.createDataFrame([(1, 1, "x", "t", "A"), (1, 1, "x", "t", "A"), (1, 1, "x", "t", "B"), (1, 0, "y", "t", "A"),
                                   (9, 1, "x", "t", "A"), (None, 1, "x", "t", "A"), (1, 5, " ", "t", "A")],
                                  "user_id long, seq long, name string, topic string, category string")
    flags = sorted((r.user_id or 0, r.name, r.category, r.outcome) for r in I.import_flags(problems, tasks).collect())
    assert flags == [(0, "x", "A", "duplicate"), (1, "", "A", "blank"), (1, "x", "A", "duplicate"), (1, "x", "A", "imported"),
                     (1, "x", "B", "duplicate"), (1, "y", "A", "imported"), (9, "x", "A", "duplicate")]
    assert sorted((r.name, r.category) for r in I.import_add(problems, tasks, "b").collect()) == [("x", "A"), ("y", "A")]


def test_requests_keep_their_order_over_files(spark, tmp_dir):
    """Two requests of a user with the same task: the first file, line and place wins; files of the ledger."""
    import json
    for name, lines in (("a.json", [("old", ["a1.csv", "a2.csv"]), ("mid", None)]), ("b.json", [("new", [])])):
        with open(f"{tmp_dir}/{name}", "w") as f:
            for cat, files in lines:
                f.write(json.dumps({"user_id": 7, "filename": f"{cat}.csv", "filenames": files,
                                    "tasks": [{"name": "T", "topic": "t", "category": cat}, {"name": cat, "topic": "t"}]}) + "\n")
    os.utime(f"{tmp_dir}/a.json", (2_000_000_000, 2_000_000_000))
    os.utime(f"{tmp_dir}/b.json", (1_000_000_000, 1_000_000_000))
    none = spark.createDataFrame([], "user_id long, name string, topic string")
    for order, first in (("time", "new"), ("path", "old")):
        tasks = SF.read_task_lists(spark, f"{tmp_dir}/*.json", order)
        got = {r.name: r.category for r in I.import_add(none, tasks, "b").collect()}
        assert got["T"] == first and set(got) == {"T", "old", "mid", "new"}
        assert [r.name for r in tasks.orderBy("seq").collect()][:2] == ["T", first]
    files = SF.request_files(SF.read_import_requests(spark, f"{tmp_dir}/*.json", "path"))
    assert [r.filename for r in files.orderBy("seq", "filename").collect()] == ["a1.csv", "a2.csv", "mid.csv", "new.csv"]


def test_fallback_only_for_runs_without_articles(spark):
    a = spark.createDataFrame([(1, "Feed", "ai_feed", 0, "a", "u", 0, None), (2, "Feed", "ai_feed", 1, "", "", 0, None)],
                              "seq long, source string, kind string, run int, title string, url string, score long, tag_hint string")
    got = T.merge_news(T.feed_items(a), limit=3).collect()
    assert [(r.run, r.rank, r.title) for r in got if r.run == 0] == [(0, 1, "a")]
    assert sorted(r["rank"] for r in got if r.run == 1) == [1, 2, 3]


def test_emptied_partitions_do_not_stay_behind(spark, tmp_dir):
    from pacegrid.sources import sinks

    path = f"{tmp_dir}/plan"
    t = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02"), (3, None)], "id long, d string").selectExpr(
        "id", "cast(d as date) as d")
    t.write.partitionBy("d").parquet(path)
    left = spark.read.parquet(path).filter("id = 1")
    sinks.overwrite_partitions(left, path, ["d"], touched=sinks.stored_partitions(spark, path, "d"))
    assert [r.id for r in spark.read.parquet(path).collect()] == [1]
