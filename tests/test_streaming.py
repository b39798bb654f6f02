"""A stream over some rows gives what the batch operators give."""

import datetime as dt
import glob
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pacegrid.operators import changes as I
from pacegrid.streaming import jobs as X

D = dt.date
TS = dt.datetime


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_x3_solved_windows_stream_equals_batch(spark, tmp_dir):
    ev = spark.createDataFrame(
        [(1, "Solved", TS(2024, 1, 15, 9)), (1, "Solved", TS(2024, 1, 21, 23)), (1, "Attempted", TS(2024, 1, 16)),
         (2, "Solved", TS(2024, 1, 22, 1)), (2, "Solved", TS(2024, 1, 22, 5))],
        "user_id long, status string, ts timestamp")
    ev.write.parquet(f"{tmp_dir}/events")
    stream = spark.readStream.schema(ev.schema).parquet(f"{tmp_dir}/events")
    daily_s, weekly_s = X.solved_windows(stream, watermark="2 days")
    for name, df in (("x3_daily", daily_s), ("x3_weekly", weekly_s)):
        q = (df.writeStream.outputMode("complete").format("memory").queryName(name)
             .option("checkpointLocation", f"{tmp_dir}/ckpt_{name}").trigger(availableNow=True).start())
        q.awaitTermination()
    daily_b, weekly_b = X.solved_windows(ev)
    assert _rows(spark.table("x3_daily")) == _rows(daily_b)
    assert _rows(spark.table("x3_weekly")) == _rows(weekly_b)
    # Monday-to-Sunday weeks: 2024-01-15 is a Monday
    starts = {r.window_start for r in weekly_b.collect()}
    assert starts == {D(2024, 1, 15), D(2024, 1, 22)}


def test_x4_routing_stream_equals_batch(spark, tmp_dir):
    msgs = spark.createDataFrame([(1, 0, "any news today?"), (2, 0, "my progress this week"),
                                  (3, 0, "explain heaps"), (4, 0, "hello")], "conv_id long, turn long, message string")
    msgs.write.parquet(f"{tmp_dir}/msgs")
    s = spark.readStream.schema(msgs.schema).parquet(f"{tmp_dir}/msgs")
    q = (X.route_messages(s).writeStream.format("memory").queryName("x4").outputMode("append")
         .option("checkpointLocation", f"{tmp_dir}/ckpt_x4").trigger(availableNow=True).start())
    q.awaitTermination()
    assert _rows(spark.table("x4")) == _rows(X.route_messages(msgs))
    assert {r.conv_id: r.intent for r in spark.table("x4").collect()} == {
        1: "news", 2: "weekly", 3: "default", 4: "default"}


def test_x4_query_reads_a_file_and_a_folder_of_files(spark, tmp_dir):
    from pacegrid.plans.catalog import QUERIES
    rows = spark.createDataFrame([(0, 0, "user", "hello"), (0, 1, "assistant", "yes"), (1, 0, "user", "hi"), (4, 0, "user", "any news?")],
                                 "conv_id long, turn int, role string, text string")
    rows.repartition(3).write.parquet(f"{tmp_dir}/folder/conversations.parquet")
    os.makedirs(f"{tmp_dir}/file")
    pq.write_table(pa.Table.from_pandas(rows.toPandas()), f"{tmp_dir}/file/conversations.parquet")
    rows.filter("false").write.parquet(f"{tmp_dir}/empty/conversations.parquet")
    for name in ("folder", "file"):
        got = {(r.conv_id, r.turn): r.intent for r in QUERIES["x4_stream_routing"](spark, f"{tmp_dir}/{name}").collect()}
        assert got == {(0, 0): "daily", (1, 0): "news", (4, 0): "news"}
    assert QUERIES["x4_stream_routing"](spark, f"{tmp_dir}/empty").collect() == []


def _tables(spark):
    problems = spark.createDataFrame(
        [(1, 10, "a", "DSA", "t", "Easy", "Pending", D(2024, 1, 20)),
         (2, 10, "b", "DSA", "t", "Hard", "Pending", D(2024, 1, 20)),
         (3, 11, "c", "DSA", "t", "Easy", "Pending", D(2024, 1, 21))],
        "id long, user_id long, name string, category string, topic string, difficulty string, status string, "
        "scheduled_date date")
    plan = spark.createDataFrame(
        [(10, D(2024, 1, 20), 1, 0, "Pending"), (10, D(2024, 1, 20), 2, 1, "Pending"),
         (11, D(2024, 1, 21), 3, 0, "Pending")],
        "user_id long, plan_date date, problem_id long, order_index int, status string")
    log = spark.createDataFrame(
        [(10, D(2024, 1, 20), 0, 3, 1, 5), (11, D(2024, 1, 19), 2, 0, 0, 5)],
        "user_id long, log_date date, problems_solved long, problems_attempted long, problems_skipped long, "
        "problems_target long")
    us = spark.createDataFrame([(10, 4), (11, 6)], "user_id long, daily_goal long")
    events = spark.createDataFrame(
        [(10, 1, D(2024, 1, 20), "Solved", TS(2024, 1, 20, 8)), (10, 1, D(2024, 1, 20), "Attempted", TS(2024, 1, 20, 7)),
         (10, 2, D(2024, 1, 20), "Solved", TS(2024, 1, 20, 9)), (11, 3, D(2024, 1, 21), "Skipped", TS(2024, 1, 21, 9)),
         (99, 3, D(2024, 1, 21), "Solved", TS(2024, 1, 21, 10))],            # not the owner: ignored
        "user_id long, problem_id long, plan_date date, status string, ts timestamp")
    return problems, plan, log, us, events


def test_x1_status_stream_equals_batch(spark, tmp_dir):
    problems, plan, log, us, events = _tables(spark)
    root = f"{tmp_dir}/tables"
    problems.write.partitionBy("scheduled_date").parquet(f"{root}/problems")
    plan.write.partitionBy("plan_date").parquet(f"{root}/daily_plan")
    log.write.partitionBy("log_date").parquet(f"{root}/daily_log")
    events.write.parquet(f"{tmp_dir}/events")
    q = X.start_status_stream(spark, f"{tmp_dir}/events", events.schema, root, us, f"{tmp_dir}/ckpt_x1")
    q.awaitTermination()
    bp, bplan, blog = I.apply_status_events(problems, plan, log, us, events)
    got_p = spark.read.parquet(f"{root}/problems").select("id", "status")
    got_log = spark.read.parquet(f"{root}/daily_log").select("user_id", "log_date", "problems_solved",
                                                             "problems_attempted", "problems_target")
    assert _rows(got_p) == _rows(bp.select("id", "status"))
    assert _rows(got_log) == _rows(blog.select("user_id", "log_date", "problems_solved", "problems_attempted",
                                               "problems_target"))
    # last event wins; attempted kept on the existing row (Q4 fixed)
    row = [r for r in blog.collect() if r.user_id == 10][0]
    assert (row.problems_solved, row.problems_attempted, row.problems_target) == (2, 3, 4)


def test_x2_import_stream_twice_equals_once(spark, tmp_dir):
    problems, *_ = _tables(spark)
    store = f"{tmp_dir}/problems"
    problems.drop("scheduled_date").withColumn("import_batch", F.lit("")).write.parquet(store)
    tasks = spark.createDataFrame([(1, 10, " a ", "t"), (2, 10, "new", "t"), (3, 10, "new", "t"), (4, 12, "", "t")],
                                  "seq long, user_id long, name string, topic string")
    sink = X.ImportSink(spark, store)
    sink(tasks, 0)
    once = spark.read.parquet(store).count()
    sink(tasks, 1)
    assert spark.read.parquet(store).count() == once == 4


def test_x3_late_events_beyond_watermark_are_dropped(spark, tmp_dir):
    schema = "user_id long, status string, ts timestamp"
    src, ckpt = f"{tmp_dir}/late", f"{tmp_dir}/ckpt_late"
    spark.createDataFrame([(1, "Solved", TS(2024, 1, 1, 9)), (1, "Solved", TS(2024, 1, 10, 9))], schema) \
        .write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        daily, _ = X.solved_windows(stream, watermark="1 day")
        q = (daily.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_dir}/out")
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()

    run()
    # a second file: a late solve for Jan 1 (behind the watermark) and a new one
    spark.createDataFrame([(1, "Solved", TS(2024, 1, 1, 10)), (1, "Solved", TS(2024, 1, 20, 9))], schema) \
        .write.mode("append").parquet(src)
    run()
    got = {(r.window_start, r.solved) for r in spark.read.parquet(f"{tmp_dir}/out").collect()}
    assert (D(2024, 1, 1), 1) in got           # the late event did not change the closed day
    assert (D(2024, 1, 1), 2) not in got
    assert (D(2024, 1, 10), 1) in got


def _scanned(df):
    """Rows that the file scans of ``df`` read (adaptive execution off, so that the plan keeps its metrics)."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        leaves = plan.collectLeaves()
        return sum(leaves.apply(k).metrics().apply("numOutputRows").value() for k in range(leaves.size())
                   if "FileScan" in leaves.apply(k).toString())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_x1_index_reads_follow_the_events(spark, tmp_dir):
    n = 20_000
    problems = spark.range(n).select("id", (F.col("id") % 7).alias("user_id"), F.lit("Pending").alias("status"),
                                     F.when(F.col("id") % 10 != 0, F.expr("date_add(date'2024-01-01', cast(id % 300 as int))")).alias("scheduled_date"))
    sink = X.StatusEventSink(spark, f"{tmp_dir}/t", None, "month", index_buckets=32)
    X.with_partition_column(problems, "problems", "month").write.partitionBy("scheduled_month").parquet(f"{tmp_dir}/t/problems")
    sink.write_index(problems)
    ids = spark.createDataFrame([(3,), (10,), (10,), (n + 5,)], "id long")
    got = sink._touched_problems(ids.distinct())
    months = {D(2024, 1, 1), None}
    assert {r.scheduled_month for r in got.select("scheduled_month").distinct().collect()} == months
    assert _scanned(got) == got.count() < n / 4
    index = X.stores.read_buckets(spark.read.schema("id long, part date, bucket int").parquet(f"{tmp_dir}/t/problems_index"), ids, ["id"], 32)
    assert sorted(r.id for r in index.collect()) == [3, 10]
    assert _scanned(index) < n / 32 * 3 * 1.5       # three buckets at most
    many = spark.range(0, 5000, 4).toDF("id")
    assert set(X.stores.partitions_of(spark, f"{tmp_dir}/t/problems_index", many, 32)) == {
        r[0] for r in X.with_partition_column(problems.join(many, "id"), "problems", "month").select("scheduled_month").distinct().collect()}


def test_x1_with_an_index_equals_batch(spark, tmp_dir):
    problems, plan, log, us, events = _tables(spark)
    problems = problems.unionByName(spark.createDataFrame([(4, 10, "d", "DSA", "t", "Easy", "Pending", None)], problems.schema))
    events = events.unionByName(spark.createDataFrame([(10, 4, D(2024, 1, 20), "Solved", TS(2024, 1, 20, 9))], events.schema))
    root = f"{tmp_dir}/tables"
    for name, df in (("problems", problems), ("daily_plan", plan), ("daily_log", log)):
        col = X.partition_column(name, "month")
        X.with_partition_column(df, name, "month").write.partitionBy(col).parquet(f"{root}/{name}")
    sink = X.StatusEventSink(spark, root, us, "month", index_buckets=4)
    sink.write_index(problems)
    for batch in (0, 0, 1):                     # tried again, and sent again
        sink(events, batch)
    bp, bplan, blog = I.apply_status_events(problems, plan, log, us, events)
    for name, want in (("problems", bp.select("id", "status")), ("daily_plan", bplan), ("daily_log", blog)):
        assert _rows(spark.read.parquet(f"{root}/{name}").select(want.columns)) == _rows(want)


def test_x2_keyed_store_equals_batch_and_survives_a_second_try(spark, tmp_dir):
    problems = spark.createDataFrame([(1, f"p{k}", "t", "") for k in range(3000)], "user_id long, name string, topic string, import_batch string")
    tasks = spark.createDataFrame([(k, 1, f" p{2990 + k} ", "t") for k in range(20)] + [(50, 1, "p3001", "t"), (51, 2, "p1", "t"), (52, 2, "", "t")],
                                  "seq long, user_id long, name string, topic string")
    X.stores.write_import_store(problems, f"{tmp_dir}/s", 16)
    sink = X.KeyedImportSink(spark, f"{tmp_dir}/s", 16)
    parts = [tasks.filter("seq < 12"), tasks.filter("seq >= 9")]
    for batch, part in ((0, parts[0]), (0, parts[0]), (1, parts[1])):
        sink(part, batch)
    # a try that broke off between the rows and the keys
    X.stores.add_import_keys(problems.limit(0), f"{tmp_dir}/s", 1, 16)
    sink(parts[1], 1)
    got = spark.read.parquet(f"{tmp_dir}/s/problems").filter("batch_no >= 0")
    assert _rows(got.select("user_id", "name")) == _rows(I.import_add(problems, tasks, "b").select("user_id", "name"))
    few = X.stores.import_keys(spark, f"{tmp_dir}/s", I.task_keys(tasks.filter("seq = 1")), 9, 16)
    assert _scanned(few) < 3000 / 16 * 1.5 + 5
    assert sorted(r.name for r in few.filter("name = 'p2991'").collect()) == ["p2991"]


def test_x3_stored_windows_equal_batch_after_a_restart(spark, tmp_dir):
    schema = "user_id long, status string, ts timestamp"
    rows = [(u, "Solved" if (u + k) % 3 else "Skipped", TS(2024, 1, 25) + dt.timedelta(hours=7 * k)) for u in (1, 2) for k in range(40)]
    late = [(1, "Solved", TS(2024, 1, 25, 1)), (3, "Solved", TS(2024, 3, 1)), (2, "Solved", TS(2024, 2, 1, 3))]
    for weekly in (False, True):
        base = f"{tmp_dir}/w{int(weekly)}"
        spark.createDataFrame(rows, schema).repartition(5).write.parquet(f"{base}/events")
        start = lambda: X.start_window_stream(spark, f"{base}/events", spark.createDataFrame([], schema).schema, f"{base}/out",
                                              f"{base}/state", weekly, files_per_batch=2).awaitTermination()
        start()
        spark.createDataFrame(late, schema).write.mode("append").parquet(f"{base}/events")   # after the query has ended
        start()
        want = X.solved_windows(spark.createDataFrame(rows + late, schema))[int(weekly)]
        assert _rows(spark.read.parquet(f"{base}/out").select(want.columns)) == _rows(want)


def test_x1_writes_no_second_copy_of_its_tables(spark, tmp_dir):
    """A batch that fails between two tables and is tried again leaves the batch result, and nothing but the tables and the
    index is left: no checkpoint of the touched partitions (its size grew with the tables) and no scratch table."""
    problems, plan, log, us, events = _tables(spark)
    # a day of the log that has two rows, one without an event, an event without a status, and an event without a day
    log = log.unionByName(log)
    events = events.unionByName(spark.createDataFrame(
        [(10, 2, D(2024, 1, 20), None, TS(2024, 1, 20, 23)), (10, 1, None, "Skipped", TS(2024, 1, 22, 9))], events.schema))
    root = f"{tmp_dir}/tables"
    for name, df in (("problems", problems), ("daily_plan", plan), ("daily_log", log)):
        col = X.partition_column(name, "month")
        X.with_partition_column(df, name, "month").write.partitionBy(col).parquet(f"{root}/{name}")
    shared = spark.conf.get("spark.checkpoint.dir")

    def scratch():
        return {p for p in glob.glob(f"{shared}/**/*", recursive=True) if os.path.isfile(p)}

    before = scratch()
    sink = X.StatusEventSink(spark, root, us, "month", index_buckets=4)
    sink.write_index(problems)
    sink._write, write = lambda df, table: write(df, table) if table == "daily_plan" else 1 / 0, sink._write
    with pytest.raises(ZeroDivisionError):      # the plan is written, the log is not
        sink(events, 0)
    sink._write = write
    sink(events, 0)
    assert not scratch() - before
    bp, bplan, blog = I.apply_status_events(problems, plan, log, us, events)
    for name, want in (("problems", bp.select("id", "status")), ("daily_plan", bplan), ("daily_log", blog)):
        assert _rows(spark.read.parquet(f"{root}/{name}").select(want.columns)) == _rows(want)
