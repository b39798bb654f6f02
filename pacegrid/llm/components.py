"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregation) and a join; the links of each round are written to
the shared checkpoint folder.  Nothing is collected but one row with the number of links and of nodes that keep
them from being stars.  The tasks of a round follow its number of links, not the number of shuffle partitions: the
driver keeps an account of every task, and links are far smaller than the texts the partitions are set for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, stored

LEAST_TASKS = 8
LINKS_PER_TASK = 100_000


def _smallest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    m = _smallest(both).withColumn("m", F.least("m", "u"))
    return (both.join(m, "u").filter(F.col("v") > F.col("u"))
            .select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").coalesce(tasks).distinct().coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    m = _smallest(down)
    linked = down.join(m, "u")
    return (linked.select(F.col("m").alias("a"), F.col("v").alias("b"))
            .unionByName(m.select(F.col("m").alias("a"), F.col("u").alias("b")))
            .filter("a < b").coalesce(tasks).distinct().coalesce(tasks))


def _all_stars(edges: DataFrame, tasks: int) -> bool:
    """True if every larger end ``b`` has one link and is no smaller end ``a``: then ``a`` is the smallest of its component."""
    nodes = edges.select(F.col("a").alias("u"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(1).alias("up")))
    each = nodes.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).coalesce(tasks)
    return each.filter("ups > 1 or (ups = 1 and least = 0)").agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0


def _tasks(edges: DataFrame) -> int:
    return max(LEAST_TASKS, -(-edges.count() // LINKS_PER_TASK))


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (id, component_id): the smallest id reachable, for every id in a link."""
    edges = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                   .filter("a < b").distinct(), "links")
    tasks = _tasks(edges)
    while not _all_stars(edges, tasks):
        edges = stored(_small_star(_large_star(edges, tasks), tasks), "links")
        tasks = _tasks(edges)
    collect_garbage(links.sparkSession)  # the shuffles of all rounds
    members = edges.select(F.col("b").alias("id"), F.col("a").alias("component_id"))
    heads = edges.select(F.col("a").alias("id")).distinct().coalesce(tasks).withColumn("component_id", F.col("id"))
    return members.unionByName(heads)
