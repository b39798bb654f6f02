"""Exact dedup with a heavy-hitter split (native DataFrame operations only).

Digests of texts are counted in three steps:

1. a Misra-Gries summary of bounded size (Spark's ``approx_top_k``, a mergeable frequent-items
   sketch with map-side partial states) names the digests that may be frequent;
2. their exact counts and largest ids are taken from the data, with a map-side partial aggregate
   keyed by the full digest; the verified winners (at most ``k`` rows) are broadcast, so rows of a
   hot group are answered where they are read and never shuffled;
3. the remaining digests, none of them frequent, go through one ordinary shuffle.

Null text is the empty text.  Rows with a null id belong to their group but never win unless all ids
are null; every row with the winning id counts as kept, so a row repeated with its id is kept twice.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

TRACKED = 32_768   # counters of the summary
WINNERS = 1_024    # most digests that are broadcast
HEAVY = 32         # smallest group worth a place among the winners


def digests(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"))


def heavy_texts(docs: DataFrame, k: int = WINNERS, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Verified frequent digests: (digest, keep_id, group_size, h), at most ``k`` rows; h is the texts' xxhash64."""
    short = texts(docs).select(F.xxhash64("text").alias("h"))
    top = (short.agg(F.expr(f"approx_top_k(h, {k}, {tracked})").alias("top"))
           .select(F.explode("top").alias("t")).select(F.col("t.item").alias("h"))).limit(k)
    named = texts(docs).withColumn("h", F.xxhash64("text")).join(F.broadcast(top), "h", "left_semi")
    return (named.select("doc_id", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "h").groupBy("digest")
            .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("h").alias("h"))
            .filter(F.col("group_size") >= heavy).orderBy(F.desc("group_size"), "digest").limit(k))


def heavy_hitters(docs: DataFrame, k: int = WINNERS, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """Verified frequent digests: (digest, keep_id, group_size), at most ``k`` rows."""
    return heavy_texts(docs, k, tracked, heavy).drop("h")


def exact_groups(docs: DataFrame, k: int = WINNERS, tracked: int = TRACKED, heavy: int = HEAVY) -> DataFrame:
    """One row per document: doc_id, digest, keep_id (largest id of the equal texts), group_size."""
    rows = digests(docs)
    winners = F.broadcast(heavy_hitters(docs, k, tracked, heavy))
    split = rows.join(winners, "digest", "left")
    hot = split.filter(F.col("group_size").isNotNull())
    w = Window.partitionBy("digest")
    rest = (rows.join(winners, "digest", "left_anti")
            .withColumn("keep_id", F.max("doc_id").over(w))
            .withColumn("group_size", F.count(F.lit(1)).over(w)))
    cols = ["doc_id", "digest", "keep_id", "group_size"]
    return hot.select(cols).unionByName(rest.select(cols))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    keep = exact_groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    keep = keep.select(F.col("doc_id").alias("_keep_doc")).distinct()
    return docs.join(keep, docs["doc_id"].cast("long").eqNullSafe(keep["_keep_doc"]), "left_semi")


def exact_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract of op4."""
    return exact_groups(docs).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
