"""Stored tables that a micro-batch reaches by key.

A bucketed table is a Parquet folder partitioned by ``bucket``, a hash of its key, and sorted by
the key in every bucket.  A micro-batch names the buckets of its own keys (as many as there are buckets
at most) and reads those alone, so what it reads follows its events and not the store.  Choose ``buckets``
so that one holds about a million rows.

* ``write_problem_index``: problem id -> partition of the problems table (X1).
* ``write_import_store``: the problems with the keys (user, name, topic) that imports are checked against (X2).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import in_partitions

BUCKETS = 64
PUSHED_KEYS = 1000      # up to so many keys go into the Parquet filter, so row groups of a bucket are passed over too


def bucket_of(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")


def write_bucketed(df: DataFrame, path: str, key: Sequence[str], buckets: int = BUCKETS, more: Sequence[str] = ()) -> None:
    """Replaces the partitions (``bucket`` and the columns ``more``) that ``df`` has rows for."""
    rows = df.withColumn("bucket", bucket_of(key, buckets)).repartition("bucket", *more)
    (rows.sortWithinPartitions("bucket", *more, *key).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("bucket", *more).parquet(path))


def read_buckets(table: DataFrame, wanted: DataFrame, key: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of the stored ``table`` in the buckets of the keys in ``wanted``; with few keys, of these alone."""
    keys = wanted.select(*key).distinct()
    names = [r[0] for r in keys.select(bucket_of(key, buckets)).distinct().collect()]
    rows = in_partitions(table, "bucket", names)
    if len(key) == 1:
        few = [r[0] for r in keys.limit(PUSHED_KEYS + 1).collect()]
        if len(few) <= PUSHED_KEYS:
            rows = rows.filter(F.col(key[0]).isin([k for k in few if k is not None]))
    return rows


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None where nothing has been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


# --- X1 ---------------------------------------------------------------------

def write_problem_index(problems: DataFrame, path: str, partition: str, buckets: int = BUCKETS) -> None:
    """Where each problem is stored: (id, part), ``part`` being its value of the table's partition column.
    Write it with the table, and again for the rows of later imports."""
    write_bucketed(problems.select("id", F.col(partition).alias("part")), path, ["id"], buckets)


def partitions_of(spark: SparkSession, path: str, ids: DataFrame, buckets: int = BUCKETS) -> list:
    """Partition values of the problems named in ``ids`` (column id)."""
    index = read_buckets(spark.read.schema("id long, part date, bucket int").parquet(path), ids, ["id"], buckets)
    return [r[0] for r in index.join(ids, "id", "left_semi").select("part").distinct().collect()]


# --- X2 ---------------------------------------------------------------------

KEY_SCHEMA = "user_id long, name string, topic string, bucket int, batch_no long"
IMPORT_KEY = ["user_id", "name", "topic"]


def write_import_store(problems: DataFrame, root: str, buckets: int = BUCKETS) -> None:
    """The problems as batch -1 and the keys of all of them."""
    problems.withColumn("batch_no", F.lit(-1)).write.partitionBy("batch_no").parquet(f"{root}/problems")
    add_import_keys(problems, root, -1, buckets)


def add_import_keys(rows: DataFrame, root: str, batch_no: int, buckets: int = BUCKETS) -> None:
    keys = rows.select(*IMPORT_KEY).distinct().withColumn("batch_no", F.lit(batch_no).cast("long"))
    write_bucketed(keys, f"{root}/keys", IMPORT_KEY, buckets, ["batch_no"])


def import_keys(spark: SparkSession, root: str, tasks: DataFrame, batch_no: int, buckets: int = BUCKETS) -> DataFrame:
    """Stored keys in the buckets of the tasks' keys, without those that the batch itself has left in an earlier try."""
    keys = spark.read.schema(KEY_SCHEMA).parquet(f"{root}/keys").filter(F.col("batch_no") != batch_no)
    return read_buckets(keys, tasks, IMPORT_KEY, buckets).select(*IMPORT_KEY)
