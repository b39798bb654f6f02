"""Structured Streaming versions of the event-driven writes.

Every job reuses the batch operators, so a stream and a batch over the same
rows give the same tables (tested in ``tests/test_streaming.py``).

* X1 status events keep plan, log and problems current through
  ``foreachBatch``: only the partitions an event touches are
  recomputed and rewritten (dynamic partition overwrite); no watermark, so a
  late event for an old day is still applied, as the tracker does.  Replaying
  a micro-batch gives the same result (last-wins is deterministic).  A stored index by problem
  id names the partitions of the touched problems, so neither the table nor all of its ids are read.
* X2 import requests are deduplicated against the keys stored by every
  earlier batch, in the buckets of their own keys alone; a batch tried again writes the same rows to the same place.
* X3 daily and Monday-to-Sunday weekly solved counts; every event counts
  however late.  ``WindowSink`` keeps a stored table of them current from the windows each batch changes.
  A watermark is an option that bounds the state (append mode
  needs it) and drops events later than it.
* X4 message routing is a stateless projection.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import changes as I
from ..operators import sequences as W
from ..operators import text as TX
from ..session import checkpoint_dir
from ..sources.sinks import delete_folder, in_partitions, materialise, write_partitions
from . import stores

EPOCH_MONDAY_OFFSET = "4 days"  # 1970-01-01 was a Thursday; +4 days is a Monday


def solved_windows(events: DataFrame, watermark: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Solved events per user per day and per Monday week.

    ``events``: (user_id, status, ts).  Returns (daily, weekly) aggregates
    with ``window_start``/``window_end`` columns; usable on a batch or on a
    stream (complete or update mode; append mode, closed windows only, with a
    ``watermark``).
    """
    solved = events.filter(F.col("status") == "Solved")
    if watermark is not None:
        solved = solved.withWatermark("ts", watermark)
    daily = (solved.groupBy("user_id", F.window("ts", "1 day").alias("w"))
             .agg(F.count(F.lit(1)).alias("solved")))
    weekly = (solved.groupBy("user_id", F.window("ts", "7 days", "7 days", EPOCH_MONDAY_OFFSET).alias("w"))
              .agg(F.count(F.lit(1)).alias("solved")))

    def flat(df: DataFrame) -> DataFrame:
        return df.select("user_id", F.col("w.start").cast("date").alias("window_start"),
                         F.col("w.end").cast("date").alias("window_end"), "solved")
    return flat(daily), flat(weekly)


class WindowSink:
    """X3 ``foreachBatch`` handler of an update-mode stream of windows: a changed window replaces its stored row.
    The table at ``path`` is partitioned by the windows' month, and only months with a changed window are read and rewritten;
    a batch tried again writes the same rows."""

    KEY = ["user_id", "window_start", "window_end"]

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def __call__(self, changed: DataFrame, batch_id: int) -> None:
        if changed.isEmpty():
            return
        new = changed.withColumn("month", F.trunc("window_start", "month")).withColumn("version", F.lit(batch_id))
        stored = stores.read_or_none(self.spark, self.path)
        if stored is None:
            out = new.drop("version")
        else:
            months = [r[0] for r in new.select("month").distinct().collect()]  # bounded by the calendar
            old = in_partitions(stored, "month", months).withColumn("version", F.lit(None).cast("long"))
            out = W.last_wins(old, new, [*self.KEY, "month"])
        write_partitions(materialise(out), self.path, ["month"])


def start_window_stream(spark: SparkSession, events_path: str, schema, path: str, checkpoint: str, weekly: bool = False,
                        files_per_batch: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Read status events as they land and keep the stored counts per user and day (or Monday week) current.
    The open windows are the query's state in ``checkpoint``; a restart goes on from there."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    windows = solved_windows(reader.parquet(events_path))[int(weekly)]
    w = windows.writeStream.outputMode("update").foreachBatch(WindowSink(spark, path)).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def route_messages(messages: DataFrame) -> DataFrame:
    """T5/T6/T8 on each incoming message."""
    return messages.select("conv_id", "turn", TX.needs_personal_context("message").alias("personal"),
                           TX.wants_resources("message").alias("resources"), TX.route("message").alias("intent"))


# Table -> (date column, partition column for day and month granularity).
STATUS_TABLES = {
    "problems": ("scheduled_date", {"day": "scheduled_date", "month": "scheduled_month"}),
    "daily_plan": ("plan_date", {"day": "plan_date", "month": "plan_month"}),
    "daily_log": ("log_date", {"day": "log_date", "month": "log_month"}),
}


def partition_column(table: str, granularity: str) -> str:
    return STATUS_TABLES[table][1][granularity]


def with_partition_column(df: DataFrame, table: str, granularity: str) -> DataFrame:
    """Add the month partition column (day partitions use the date itself)."""
    date_col, parts = STATUS_TABLES[table]
    if granularity == "day":
        return df
    return df.withColumn(parts["month"], F.trunc(F.col(date_col), "month"))


class StatusEventSink:
    """X1 ``foreachBatch`` handler over tables stored as parquet folders:
    ``problems``, ``daily_plan`` and ``daily_log``, partitioned by their date
    (``granularity='day'``) or its month (``'month'``); settings are read as
    given.  Only partitions holding touched rows are recomputed and rewritten.  ``index_buckets``: the number of buckets of
    the index ``problems_index`` beside the tables (``write_index``); without it the ids of the whole table are read."""

    def __init__(self, spark: SparkSession, root: str, user_settings: DataFrame, granularity: str = "day",
                 index_buckets: int | None = None):
        self.index_buckets = index_buckets
        self.spark = spark
        self.root = root.rstrip("/")
        self.user_settings = user_settings
        self.granularity = granularity

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _touched(self, df: DataFrame, table: str) -> DataFrame:
        """The part of the stored ``table`` in the partitions that rows of ``df`` (its date or partition
        column) lie in.  Their names, one per day or month, go into the read's partition filter, so other
        partitions are not read; problems without a date live in the null partition."""
        col = partition_column(table, self.granularity)
        rows = df if col in df.columns else with_partition_column(df, table, self.granularity)
        return self._partitions(table, [r[0] for r in rows.select(col).distinct().collect()])

    def _partitions(self, table: str, values: list) -> DataFrame:
        return in_partitions(self.spark.read.parquet(self.path(table)), partition_column(table, self.granularity), values)

    def _write(self, df: DataFrame, table: str) -> None:
        """Replace the partitions of ``df``, which may read them: a dynamic overwrite puts its files in place when all are written."""
        write_partitions(df, self.path(table), [partition_column(table, self.granularity)])

    def _stored(self, df: DataFrame, folder: str) -> DataFrame:
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def write_index(self, problems: DataFrame) -> None:
        """Store where each of ``problems`` lies; call it when they are written."""
        col = partition_column("problems", self.granularity)
        rows = problems if col in problems.columns else with_partition_column(problems, "problems", self.granularity)
        stores.write_problem_index(rows, self.path("problems_index"), col, self.index_buckets)

    def _touched_problems(self, ids: DataFrame) -> DataFrame:
        """The stored problems in the partitions of the touched ones, which the index names."""
        stored = self.spark.read.parquet(self.path("problems"))
        if self.index_buckets is None:
            return self._touched(stored.join(ids, "id", "left_semi"), "problems")
        values = stores.partitions_of(self.spark, self.path("problems_index"), ids, self.index_buckets)
        return in_partitions(stored, partition_column("problems", self.granularity), values)

    def __call__(self, events: DataFrame, batch_id: int) -> None:
        if events.isEmpty():
            return
        folder = f"{checkpoint_dir(self.spark).rstrip('/')}/status-events-{uuid.uuid4().hex}"
        try:
            self._apply(events, folder)
        finally:
            delete_folder(self.spark, folder)

    def _apply(self, events: DataFrame, folder: str) -> None:
        ids = events.select(F.col("problem_id").alias("id")).distinct()
        problems = self._touched_problems(self._stored(ids, f"{folder}/ids"))
        part = partition_column("daily_plan", self.granularity)
        dates = with_partition_column(events.select("plan_date"), "daily_plan", self.granularity)
        days = [r[0] for r in dates.select(part).distinct().collect()]   # one per day or month
        plan, log = self._partitions("daily_plan", days), self._partitions("daily_log", days)
        # the last events are stored once for all three tables; ids and owners of problems do not change
        changes = self._stored(I.owned_changes(problems, events), f"{folder}/changes")
        dated = with_partition_column(changes.filter(F.col("plan_date").isNotNull()), "daily_plan", self.granularity)
        self._write(I.plan_after(plan, dated, part), "daily_plan")
        # the log counts the plan as stored after the events; a batch tried again finds the same counts
        news = I.log_after(self._partitions("daily_plan", days), log, self.user_settings, dated)
        self._write(with_partition_column(news, "daily_log", self.granularity), "daily_log")
        last = changes.groupBy(*I.OWN).agg(F.max(F.struct("ts", "status")).alias("e")).select(*I.OWN, F.col("e.status").alias("status"))
        self._write(I.problems_after(problems, last), "problems")


def start_status_stream(spark: SparkSession, events_path: str, schema, root: str, user_settings: DataFrame,
                        checkpoint: str, available_now: bool = True, granularity: str = "day",
                        index_buckets: int | None = None) -> StreamingQuery:
    """Read status events as they land and keep the tables current."""
    stream = spark.readStream.schema(schema).parquet(events_path)
    w = stream.writeStream.foreachBatch(StatusEventSink(spark, root, user_settings, granularity, index_buckets)).option(
        "checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


class ImportSink:
    """X2 ``foreachBatch`` handler: each batch of tasks is imported in ``add``
    mode against everything stored so far (earlier batches included)."""

    def __init__(self, spark: SparkSession, problems_path: str, batch_prefix: str = "stream"):
        self.spark = spark
        self.problems_path = problems_path
        self.batch_prefix = batch_prefix

    def __call__(self, tasks: DataFrame, batch_id: int) -> None:
        if tasks.isEmpty():
            return
        stored = self.spark.read.parquet(self.problems_path)
        new = I.import_add(stored, tasks, f"{self.batch_prefix}_{batch_id}")
        cols = stored.columns
        out = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c)
                           for c in cols])
        materialise(out).write.mode("append").parquet(self.problems_path)


class KeyedImportSink:
    """X2 ``foreachBatch`` handler over an import store (``stores.write_import_store``): each batch of tasks is imported in
    ``add`` mode against the stored keys of its own buckets.

    The rows and the keys of a batch go to partitions named by its number, and a batch never sees its own
    keys, so a batch that is tried again after a failure at any point replaces its rows by the same rows."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = stores.BUCKETS, batch_prefix: str = "stream"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets
        self.batch_prefix = batch_prefix

    def __call__(self, tasks: DataFrame, batch_id: int) -> None:
        if tasks.isEmpty():
            return
        stored = self.spark.read.parquet(f"{self.root}/problems").schema
        keys = stores.import_keys(self.spark, self.root, I.task_keys(tasks), batch_id, self.buckets)
        new = I.import_add(keys, tasks, f"{self.batch_prefix}_{batch_id}")
        out = materialise(new.select(*[F.col(f.name) if f.name in new.columns else F.lit(None).cast(f.dataType).alias(f.name)
                                       for f in stored.fields if f.name != "batch_no"]))
        write_partitions(out.withColumn("batch_no", F.lit(batch_id)), f"{self.root}/problems", ["batch_no"])
        stores.add_import_keys(out, self.root, batch_id, self.buckets)
