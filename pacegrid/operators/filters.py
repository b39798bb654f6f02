"""F1-F9 filters/projections and L1-L6 sorts, limits and top-k.

Filters are plain ``filter`` calls on columns of the scanned tables, so
Catalyst pushes them into the parquet reader and prunes unread columns.
Per-group top-k uses ``row_number() <= k``, which Spark plans as a
WindowGroupLimit: each map partition keeps its own k best rows per group
before the shuffle, so a hot group never ships more than k rows per mapper.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .sequences import difficulty_rank, skew_safe_positions


def like_pattern(term: str) -> Column:
    """``lower('%term%')`` with the term unescaped (its ``%``/``_`` stay
    wildcards, D6); Spark's LIKE escape character ``\\`` is doubled first."""
    return F.lower(F.lit("%" + term.replace("\\", "\\\\") + "%"))


def text_match(cols: Sequence[str], term: str) -> Column:
    p = like_pattern(term)
    cond = None
    for c in cols:
        e = F.like(F.lower(F.col(c)), p)
        cond = e if cond is None else (cond | e)
    return cond


def problem_search(problems: DataFrame, category: str = "", status: str = "", difficulty: str = "",
                   search: str = "", ordered: bool = True) -> DataFrame:
    """F1 (+L1): optional filters, blank means no filter; ordered by user,
    category, topic, difficulty rank, id (D10)."""
    df = problems
    if category.strip():
        df = df.filter(F.lower("category") == F.lower(F.lit(category.strip())))
    if status.strip():
        df = df.filter(F.col("status") == status.strip())
    if difficulty.strip():
        df = df.filter(F.lower("difficulty") == F.lower(F.lit(difficulty.strip())))
    if search.strip():
        df = df.filter(text_match(["name", "topic", "category"], search.strip()))
    df = df.withColumn("difficulty_rank", difficulty_rank())
    if ordered:
        df = df.orderBy("user_id", "category", "topic", "difficulty_rank", "id")
    return df


def first_catalog_match(algorithms: DataFrame, term: str, cols: Sequence[str] = ("name", "pattern")) -> DataFrame:
    """The lowest-id catalog entry matching the term (at most one row)."""
    return (algorithms.filter(text_match(cols, term)).orderBy("id").limit(1)
            .select(F.col("id").alias("algorithm_id"), F.col("name").alias("algorithm_name"),
                    F.col("pattern").alias("algorithm_pattern")))


def topic_view(users: DataFrame, problems: DataFrame, algorithms: DataFrame, term: str) -> DataFrame:
    """per user, problems whose topic/category/name contains the term
    (total, solved) and the first matching catalog entry.  The catalog match
    is one row (``limit(1)``), attached as a scalar subquery."""
    hit = problems.filter(text_match(["topic", "category", "name"], term))
    agg = hit.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"),
                                     F.count_if(F.col("status") == "Solved").alias("solved"))
    u = (users.select(F.col("id").alias("user_id")).join(agg, "user_id", "left")
         .fillna(0, subset=["total", "solved"]))
    # the one-row catalog match is a scalar subquery: computed once, no join
    first = first_catalog_match(algorithms, term)
    m = first.select(F.struct(*first.columns)).scalar()
    return u.select("user_id", "total", "solved", *[m[c].alias(c) for c in first.columns])


def catalog_search(algorithms: DataFrame, term: str = "") -> DataFrame:
    """entries whose name/pattern/description contains the term, by name."""
    df = algorithms
    if term.strip():
        df = df.filter(text_match(["name", "pattern", "description"], term.strip()))
    return df.orderBy("name", "id")


def distinct_topics(problems: DataFrame) -> DataFrame:
    """distinct non-empty topics per user."""
    return problems.filter(F.col("topic") != "").select("user_id", "topic").distinct()


def problems_in_range(problems: DataFrame, batch: str | None = None, category: str | None = None,
                      date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """rows of one import batch, one category (case-insensitive) or a
    scheduled-date range (inclusive), the first given predicate wins."""
    if batch:
        return problems.filter(F.col("import_batch") == batch)
    if category:
        return problems.filter(F.lower("category") == F.lower(F.lit(category)))
    if date_from and date_to:
        return problems.filter(F.col("scheduled_date").between(F.lit(date_from).cast("date"),
                                                               F.lit(date_to).cast("date")))
    return problems.limit(0)


def owned_milestones(projects: DataFrame, milestones: DataFrame) -> DataFrame:
    """milestones with the owning user of their project (orphans dropped)."""
    p = projects.select(F.col("id").alias("project_id"), "user_id")
    return milestones.join(p, "project_id", "inner")


TASK_DEFAULTS: Mapping[str, object] = {
    "category": "DSA", "topic": "", "difficulty": "Medium", "platform": "Custom",
    "problem_link": "", "resource_link": "", "status": "Pending",
}


def fill_defaults(df: DataFrame, defaults: Mapping[str, object] = TASK_DEFAULTS) -> DataFrame:
    """missing or NULL fields take the defaults of a new row."""
    out = df
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v))
    return out


def add_missing_columns(df: DataFrame, columns: Mapping[str, tuple[str, object]]) -> DataFrame:
    """F8: additive migration: add absent columns ``{name: (type, default)}``
    and backfill NULLs of present ones with the default."""
    out = df
    for c, (typ, default) in columns.items():
        lit = F.lit(default).cast(typ)
        out = out.withColumn(c, F.coalesce(F.col(c).cast(typ), lit) if c in df.columns else lit)
    return out


def read_migrated(spark: SparkSession, path: str, columns: Mapping[str, tuple[str, object]],
                  schema: str | StructType | None = None) -> DataFrame:
    """F8 on stored files: Parquet files of old and new schemas under ``path`` as one table.

    Columns that only the newer files have are NULL in the older ones and take the defaults of ``columns``, as do
    columns that no file has yet.  ``schema`` (the newest) spares the merge of all files' footers.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
    return add_missing_columns(reader.parquet(path), columns)


def claim_orphans(df: DataFrame, user_id: int, col: str = "user_id") -> DataFrame:
    """rows without an owner get the given user."""
    return df.withColumn(col, F.coalesce(F.col(col), F.lit(user_id).cast(df.schema[col].dataType)))


def claim_all(tables: Mapping[str, DataFrame], user_id: int, col: str = "user_id") -> dict[str, DataFrame]:
    """F9 over every table of the first signup: their rows without an owner get the given user."""
    return {name: claim_orphans(df, user_id, col) for name, df in tables.items()}


# --- L: order, limits, top-k ----------------------------------------------

def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                  rank_col: str = "rank") -> DataFrame:
    """The first k rows per group in the given order, with their rank."""
    w = Window.partitionBy(*group).orderBy(*order)
    return (df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
            .withColumn(rank_col, F.col(rank_col).cast("bigint")))


def recent_logs(log: DataFrame, n: int = 14) -> DataFrame:
    """L2: each user's n most recent log days."""
    return top_per_group(log, ["user_id"], [F.desc("log_date")], n)


def recent_imports(imports: DataFrame, n: int = 50) -> DataFrame:
    """L2: each user's n newest import-ledger rows."""
    return top_per_group(imports, ["user_id"], [F.desc("id")], n)


def newest_projects(projects: DataFrame) -> DataFrame:
    """L2: each user's projects newest-first, all of them: position 0 is the largest id."""
    newest = projects.withColumn("_newest", -F.col("id"))
    return skew_safe_positions(newest, ["user_id"], [], "_newest", name="position").drop("_newest")


def milestone_positions(milestones: DataFrame) -> DataFrame:
    """L3: position of each milestone in its project by ``order_index, id``, so equal indexes keep the order they were added in."""
    return skew_safe_positions(milestones, ["project_id"], ["order_index"], "id", name="position")


def milestone_order(milestones: DataFrame) -> DataFrame:
    """L3: position of each milestone in its project by order_index (equal
    indexes share a position).

    Ranked over the distinct (project, order_index) pairs, so a project with
    very many milestones is reduced by a partial aggregate before the window
    and then joined back (AQE splits a skewed join key)."""
    keys = milestones.select("project_id", "order_index").distinct()
    w = Window.partitionBy("project_id").orderBy("order_index")
    ranked = keys.withColumn("position", F.dense_rank().over(w).cast("bigint"))
    return milestones.join(ranked, ["project_id", "order_index"], "inner")


def top_n(df: DataFrame, n: int, score: str = "score", seq: str = "seq") -> DataFrame:
    """L4: stable sort by score descending (source order on ties), first n.
    Planned as TakeOrderedAndProject: each task keeps n rows, the driver merges
    n x tasks rows."""
    return df.orderBy(F.desc(score), F.asc(seq)).limit(n)


_WS = r"[\s\x1c-\x1f\x85\xa0]"


def head_words(text: str | Column, k: int = 12) -> Column:
    """The first k whitespace-separated words joined by one space when
    the text has more than k words, else the text unchanged.

    Uses an anchored regex for the first k+1 words instead of splitting the
    whole text, so a 20,000-word document costs only its first words.
    """
    t = F.col(text) if isinstance(text, str) else text
    more = t.rlike(rf"^{_WS}*(?:[^\s\x1c-\x1f\x85\xa0]+{_WS}+){{{k}}}[^\s\x1c-\x1f\x85\xa0]")
    first = F.regexp_extract(t, rf"^{_WS}*((?:[^\s\x1c-\x1f\x85\xa0]+{_WS}+){{0,{k - 1}}}[^\s\x1c-\x1f\x85\xa0]+)", 1)
    return F.when(more, F.regexp_replace(first, rf"{_WS}+", " ")).otherwise(t)


def head_chars(text: str | Column, n: int = 120) -> Column:
    """The first n characters."""
    t = F.col(text) if isinstance(text, str) else text
    return F.substring(t, 1, n)
