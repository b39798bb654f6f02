"""Sinks: table writes with dynamic partition overwrite (D3) and the daily
cache with expiry (S9).

A change operator reads a table and produces its new state; writing that
state back onto the path it was read from in the same job is unsafe, so the
new rows are first checkpointed into the shared ``spark.checkpoint.dir``
(lineage cut, survives lost executors) and then written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.errors import AnalysisException

from ..session import checkpoint_dir


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder; only after everything that reads it is written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def write_partitions(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet") -> None:
    """Replace only the partitions present in ``df`` (dynamic overwrite).
    ``df`` may read files of ``path`` that it replaces itself, since Spark moves its own in only when all are written;
    partitions that it reads but has no rows for stay (see ``overwrite_partitions``)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).format(fmt).save(path))


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str], fmt: str = "parquet",
                         touched: list | None = None) -> None:
    """Checkpoint ``df`` (which may read ``path``), then replace its partitions.

    ``touched``: values (or None) of the single partition column that the
    change covers, ``stored_partitions`` if ``df`` is the whole table; those
    ``df`` has no row for are emptied, so deleted rows do not stay behind.
    """
    df = materialise(df)
    write_partitions(df, path, partition_by, fmt)
    if not touched:
        return
    (column,) = partition_by
    left = {r[0] for r in df.select(column).distinct().collect()}  # one value per partition
    for value in touched:
        if value not in left:
            name = "__HIVE_DEFAULT_PARTITION__" if value is None else value
            df.drop(column).limit(0).write.mode("overwrite").format(fmt).save(f"{path}/{column}={name}")


def stored_partitions(spark: SparkSession, path: str, column: str, fmt: str = "parquet") -> list:
    """Values of a partition column of a stored table (one per partition)."""
    return [r[0] for r in spark.read.format(fmt).load(path).select(column).distinct().collect()]


def in_partitions(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of the given partitions; a filter that prunes the others' files from the scan."""
    cond = F.col(column).isin([v for v in values if v is not None])
    return df.filter(cond | F.col(column).isNull() if None in values else cond)


def write_daily_cache(df: DataFrame, path: str, day, date_col: str = "cache_date") -> None:
    """Store today's rows as the only cached day (other days expire).

    The day's folder is replaced when the write is committed, so a failed rebuild leaves the old cache in place;
    the folders of other days, and today's where ``df`` has no row, go only after that.
    """
    today = str(day)
    out = materialise(df.withColumn(date_col, F.lit(today).cast("date")))
    write_partitions(out, path, [date_col])
    left = set() if out.isEmpty() else {today}
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
    for entry in fs.listStatus(hadoop):
        name = entry.getPath().getName()
        if name.startswith(f"{date_col}=") and name.split("=", 1)[1] not in left:
            fs.delete(entry.getPath(), True)


def read_daily_cache(spark: SparkSession, path: str, day, date_col: str = "cache_date") -> DataFrame | None:
    """today's cached rows, or None when there is no cache for today (a
    partition filter: only that day's files are listed and read)."""
    try:
        df = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise  # an unreadable cache is not a missing one
        return None
    today = df.filter(F.col(date_col) == F.lit(str(day)).cast("date"))
    return today if today.limit(1).count() > 0 else None


def daily_cache(spark: SparkSession, path: str, day, build: Callable[[], DataFrame], force: bool = False,
                date_col: str = "cache_date") -> DataFrame:
    """S9 as one operator: today's cached rows if there are any, else ``build()`` stored as the only day.

    ``force`` skips the cache, as a forced refresh clears it first.  ``build`` is not called when the cache
    is used.  A rebuild without rows leaves an empty cache, so the next call builds again.
    """
    if not force:
        cached = read_daily_cache(spark, path, day, date_col)
        if cached is not None:
            return cached
    rows = build()
    write_daily_cache(rows, path, day, date_col)
    fresh = read_daily_cache(spark, path, day, date_col)
    return rows.limit(0).withColumn(date_col, F.lit(str(day)).cast("date")) if fresh is None else fresh
