"""Streaks, positional order, date spines, first/last-wins by key.

Scale notes.
* W1 filters to the 365 days before ``as_of`` before the window, so a window
  partition holds at most 365 dates per user however large the log is.
* W4/W5 are aggregates (``min_by``/``max_by`` with a map-side partial step),
  not windows, so a hot key is reduced on every mapper before the shuffle.
* W2 needs the exact position of every row in its (user, day) group; for
  groups that may be huge, ``skew_safe_positions`` numbers rows inside
  slices cut at sampled ids and shifts them by counted offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import as_date, day_label

STREAK_CAP = 365


def difficulty_rank(c: str | Column = "difficulty") -> Column:
    """L1: Easy 1, Medium 2, anything else 3."""
    d = F.col(c) if isinstance(c, str) else c
    return F.when(d == "Easy", 1).when(d == "Medium", 2).otherwise(3)


def streak(log: DataFrame, as_of, cap: int = STREAK_CAP) -> DataFrame:
    """Consecutive days with ``problems_solved >= 1`` counted back from the
    day before ``as_of`` (``as_of`` itself does not count), at most ``cap``.

    A good day ``d`` continues the run exactly when it is the k-th most recent
    good day and ``as_of - d = k``; the streak is the number of such days.
    Only users with a streak > 0 are returned.
    """
    d = as_date(as_of)
    # distinct (user, day) first (a partial aggregate), so a window partition
    # holds at most ``cap`` rows even if the log repeats a day many times
    good = (log.filter((F.col("problems_solved") >= 1) & (F.col("log_date") < d)
                       & (F.col("log_date") >= F.date_sub(d, cap)))
            .select("user_id", "log_date").distinct())
    w = Window.partitionBy("user_id").orderBy(F.desc("log_date"))
    ranked = good.withColumn("k", F.row_number().over(w))
    return (ranked.filter(F.datediff(d, F.col("log_date")) == F.col("k"))
            .groupBy("user_id").agg(F.count(F.lit(1)).cast("bigint").alias("streak")))


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column | str],
              name: str = "pos") -> DataFrame:
    """W2 building block: 0-based position of each row within its group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, (F.row_number().over(w) - 1).cast("int"))


SLICE_ROWS = 1_000_000   # a group of more rows is numbered in slices of about so many
SAMPLES = 64             # sampled keys per slice
FAN = 32                 # bounds passed over at a time when a key's slice is looked up


def _slice_of(bounds: Column, key: Column) -> Column:
    """How many of the ascending ``bounds`` are at most ``key``, found in two steps."""
    strides = F.size(F.filter(F.filter(bounds, lambda _, i: (i + 1) % FAN == 0), lambda b: b <= key))
    return strides * FAN + F.size(F.filter(F.slice(bounds, strides * FAN + 1, F.lit(FAN - 1)), lambda b: b <= key))


def skew_safe_positions(df: DataFrame, group: Sequence[str], prefix: Sequence[str], key: str,
                        name: str = "pos", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Exact 0-based positions ordered by ``(*prefix, key)`` within ``group``
    without one task ever holding a huge group.

    ``key`` is a unique integer (the row id, dense or not).  Groups of up to ``slice_rows`` rows are numbered by a
    plain window.  A larger group is cut at keys of a sample of it (every key whose hash falls on one residue, so
    a lost executor recomputes the same cuts) into slices of about ``slice_rows`` rows, as many as its
    size asks for; the same window numbers rows inside one (group, prefix, slice), and each slice is shifted by the
    counted sizes of the slices before it.  Only large groups are in the broadcast tables: at most one row
    for every ``slice_rows`` rows, with ``SAMPLES`` keys a slice before they are thinned.  Nothing runs
    while the plan is built, and without a large group only the count per group is added to the window.
    """
    group, prefix = list(group), list(prefix)
    rate = max(1, slice_rows // SAMPLES)
    large = (df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > slice_rows)
             .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)]))

    def same(other: DataFrame) -> Column:
        cond = F.lit(True)
        for i, g in enumerate(group):
            cond = cond & df[g].eqNullSafe(other[f"_g{i}"])
        return cond

    ids = [f"_g{i}" for i in range(len(group))]
    sample = (df.filter(F.pmod(F.xxhash64(key), F.lit(rate)) == 0).join(F.broadcast(large), same(large))
              .groupBy(*ids).agg(F.array_sort(F.collect_list(key)).alias("_keys")))
    cuts = sample.select(*ids, F.filter("_keys", lambda _, i: (i + 1) % SAMPLES == 0).alias("_cuts"))
    d = df.join(F.broadcast(cuts), same(cuts), "left").drop(*ids)
    hot = F.col("_cuts").isNotNull()
    d = (d.withColumn("_b", F.when(hot, _slice_of(F.col("_cuts"), F.col(key))).otherwise(F.lit(0)))
         .withColumns({f"_p{i}": F.when(hot, F.col(p)) for i, p in enumerate(prefix)})
         .withColumn("_hot", hot).drop("_cuts"))
    own = [f"_p{i}" for i in range(len(prefix))]
    local = F.row_number().over(Window.partitionBy(*group, *own, "_b").orderBy(*prefix, key)) - 1
    before = Window.partitionBy(*group).orderBy(*own, "_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (d.filter("_hot").groupBy(*group, *own, "_b").agg(F.count(F.lit(1)).alias("_n"))
               .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    names = {c: f"_o{i}" for i, c in enumerate([*group, *own, "_b"])}
    offsets = offsets.select(*[F.col(c).alias(n) for c, n in names.items()], "_off")
    numbered = d.withColumn("_pos", local)
    cond = F.col("_hot")
    for c, n in names.items():
        cond = cond & F.col(c).eqNullSafe(F.col(n))
    return (numbered.join(F.broadcast(offsets), cond, "left")
            .withColumn(name, (F.col("_pos") + F.coalesce("_off", F.lit(0))).cast("int"))
            .select(*df.columns, name))


def daily_series(users: DataFrame, log: DataFrame, user_settings: DataFrame, as_of,
                 days: int = 30) -> DataFrame:
    """The ``days`` days ending at ``as_of`` for every user, oldest first:
    solved (0 if no log row), target (log target, else the daily goal), label."""
    d = as_date(as_of)
    spine = (user_settings.select("user_id", "daily_goal")   # one row per user (S7)
             .withColumn("log_date", F.explode(F.sequence(F.date_sub(d, days - 1), d))))
    recent = (log.filter(F.col("log_date").between(F.date_sub(d, days - 1), d))
              .select("user_id", "log_date", "problems_solved", "problems_target"))
    j = spine.join(recent, ["user_id", "log_date"], "left")
    return j.select("user_id", "log_date", day_label(F.col("log_date")).alias("label"),
                    F.coalesce("problems_solved", F.lit(0)).cast("bigint").alias("solved"),
                    F.coalesce("problems_target", "daily_goal").cast("bigint").alias("target"))


def first_wins(df: DataFrame, key: Sequence[str | Column], seq: str = "seq") -> DataFrame:
    """Per key keep the row with the smallest ``seq`` (source order).

    An aggregate (``min_by``) rather than a window: partial aggregation on
    each mapper keeps one row per key before the shuffle.
    """
    cols = df.columns
    keyed = df.withColumns({f"_k{i}": (F.col(k) if isinstance(k, str) else k) for i, k in enumerate(key)})
    kcols = [f"_k{i}" for i in range(len(key))]
    best = keyed.groupBy(*kcols).agg(F.min_by(F.struct(*cols), F.col(seq)).alias("_r"))
    return best.select("_r.*")


def last_wins(old: DataFrame, new: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """Upsert; per key the row with the highest version wins (old rows
    carry version NULL-safe minimum).  Columns are matched by name."""
    cols = [c for c in old.columns if c != version]
    o = old.select(*cols, F.lit(None).cast(new.schema[version].dataType).alias(version))
    n = new.select(*cols, version)
    u = o.unionByName(n).withColumn("_v", F.struct(F.col(version).isNotNull(), F.col(version)))
    best = u.groupBy(*key).agg(F.max_by(F.struct(*[c for c in cols if c not in key]), F.col("_v")).alias("_r"))
    return best.select(*key, "_r.*")


def numbered_lines(df: DataFrame, group: Sequence[str], order: Sequence[str], line: Column,
                   name: str = "text", empty: str | None = None) -> DataFrame:
    """``"1. ...\\n2. ..."`` per group in the given order."""
    parts = F.struct(*[F.col(o) for o in order], line.alias("_line"))
    agg = df.groupBy(*group).agg(F.array_sort(F.collect_list(parts)).alias("_a"))
    text = F.array_join(F.transform(
        "_a", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["_line"])), "\n")
    out = agg.select(*group, text.alias(name))
    return out
