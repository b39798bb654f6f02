"""Tagging and routing as column expressions over whole texts, and
T3/T4 the news merge.

Keyword rules compile to ``contains`` chains inside whole-stage codegen (no
Python per row).  The news merge works per feed run; every source
contributes at most its first 30 items (a WindowGroupLimit before any
shuffle), so the stop rules run over at most ~70 rows per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as RU
from .filters import head_words


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_relevant(title, whole_word: bool = False) -> Column:
    """The lower-cased text contains any relevance keyword
    (``whole_word``: the Q16 option, whole words only)."""
    return RU.contains_any(_c(title), RU.RELEVANCE_KEYWORDS, whole_word=whole_word)


def topic_tag(title, whole_word: bool = False) -> Column:
    """Label of the first tag rule whose keywords occur, else Tech."""
    return RU.first_label(_c(title), RU.TAG_RULES, RU.DEFAULT_TAG, whole_word=whole_word)


def needs_personal_context(message) -> Column:
    """T5: the message contains a personal-status phrase."""
    return RU.contains_any(_c(message), RU.PERSONAL_SIGNALS)


def wants_resources(message) -> Column:
    """The message asks for resources."""
    return RU.contains_any(_c(message), RU.RESOURCE_KEYWORDS)


def resource_topic(message) -> Column:
    """The first 12 words when the message is longer, else the message."""
    return head_words(_c(message), 12)


def route(message) -> Column:
    """News -> weekly -> daily -> suggest -> default, first match."""
    return RU.first_label(_c(message), RU.ROUTER_RULES, RU.DEFAULT_ROUTE)


def resource_links(topic, max_results: int = 4) -> Column:
    """T7 fallback part: links of the first catalog key contained in the
    lower-cased topic, else three generated search links; at most n.
    Returned as one newline-joined string."""
    t = F.lower(_c(topic))
    q = F.replace(_c(topic), F.lit(" "), F.lit("+"))
    generated = F.concat_ws("\n", *[F.concat(*[p if i % 2 else F.lit(p) for i, p in
                                               enumerate(_split_template(tpl, q))])
                                    for tpl in RU.SEARCH_LINK_TEMPLATES][:max_results])
    out = None
    for key, links in RU.FALLBACK_RESOURCES:
        cond = t.contains(F.lit(key))
        val = F.lit("\n".join(links[:max_results]))
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return out.otherwise(generated)


def _split_template(tpl: str, q: Column) -> list:
    """``'a{q}b'`` -> ``['a', q, 'b']`` (odd positions are the topic column)."""
    pre, _, post = tpl.partition("{q}")
    return [pre, q, post]


def allowed_link(url) -> Column:
    """T7 whitelist: a live-search link is kept when its host is one of ours."""
    return RU.contains_any(_c(url), RU.RESOURCE_HOSTS, lowered=True)


# --- T3/T4 news merge --------------------------------------------------------

# Feed kinds in merge order, with their per-source item caps.
FEED_KINDS = ["scored", "tagged", "ai_feed", "trending", "tutorials"]
SCAN_CAP = {"scored": 30, "tagged": 25, "ai_feed": 5, "trending": 4, "tutorials": 6}
SCORED_STOP = 12       # the scored source stops once this many items are kept
TAGGED_STOP = 14       # the tagged source stops after a tag block once the total reaches this
TAGGED_BLOCK = 5       # items per tag block
MIN_SCORE = 20         # scored items need a score above this
STORED_TITLE = 120     # characters kept of a title
DEDUP_KEY = 50         # characters of the stored title used as the duplicate key


def feed_runs(articles: DataFrame, block: int = 600) -> DataFrame:
    """``articles`` with ``run`` and ``kind`` (see ``feed_items``); given ones stay."""
    if {"run", "kind"} <= set(articles.columns):
        return articles
    n = len(FEED_KINDS)
    k = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    kinds = F.array(*[F.lit(x) for x in FEED_KINDS])
    return (articles.withColumn("_k", k).filter(F.col("_k").isNotNull())
            .withColumn("run", F.concat_ws(".", F.floor(F.col("seq") / block).cast("string"), F.floor(F.col("_k") / n).cast("string")))
            .withColumn("kind", F.element_at(kinds, F.col("_k") % n + 1)).drop("_k"))


def feed_items(articles: DataFrame, block: int = 600) -> DataFrame:
    """Items of feed runs with their place in them, ready for ``merge_news``.

    Source ``srcK`` is of kind ``K % 5``; the sources with equal ``K // 5``
    make one run for every ``block`` consecutive ``seq``, so each item enters a run and the runs grow with the
    feed; the run's key names both numbers (``"block.sources"``), so any number of sources stay apart.  Items that carry ``run`` and ``kind`` themselves keep them, whatever the name of their source;
    other names without a number are in no run.  ``pos`` is the 1-based item order within the source
    and run; the first 30 items of each are kept.  Relevance and topic come from the whole title before
    any shuffle; only its stored characters travel on.  ``tag_no``, the place of the queried tag, is kept if given."""
    articles = feed_runs(articles, block)
    items = articles.select("run", "kind", "source", "seq", "url", "score", "tag_hint", *[c for c in articles.columns if c == "tag_no"],
                            is_relevant("title").alias("relevant"), topic_tag("title").alias("topic"),
                            F.substring("title", 1, STORED_TITLE).alias("title"))
    own = Window.partitionBy("run", "kind", "source").orderBy("seq")
    return items.withColumn("pos", F.row_number().over(own)).filter(F.col("pos") <= max(SCAN_CAP.values()))


def merge_news(items: DataFrame, limit: int | None = 9) -> DataFrame:
    """Per run, the gated items of the five sources in merge order,
    first-wins dedup on the lower-cased first 50 characters of the stored
    title, stable sort by score, top ``limit`` (``None``: the full ranked
    list, as the daily cache stores it).  A run with no item left gets the
    fallback list.  Output: ``run, rank, title, url, source, tag, score``."""
    rel = F.col("relevant")
    title_ok = F.coalesce(F.col("title"), F.lit("")) != ""
    url_ok = F.coalesce(F.col("url"), F.lit("")) != ""
    kind = F.col("kind")
    gate = (F.when(kind == "scored", url_ok & (F.col("score") > MIN_SCORE) & rel)
            .when(kind == "tagged", title_ok & url_ok & rel)
            .when(kind.isin("ai_feed", "trending"), title_ok & url_ok)
            .when(kind == "tutorials", title_ok & url_ok & rel).otherwise(F.lit(False)))
    cap = F.element_at(F.create_map(*[x for k, v in SCAN_CAP.items() for x in (F.lit(k), F.lit(v))]), kind)
    tag = (F.when(kind == "tagged", F.when(F.coalesce(F.col("tag_hint"), F.lit("")) != "", F.upper("tag_hint"))
                  .otherwise(F.col("topic")))
           .when(kind == "ai_feed", "AI/ML").when(kind == "trending", "Open Source")
           .otherwise(F.col("topic")))
    score = F.when(kind.isin("scored", "tagged"), F.col("score")).otherwise(F.lit(0)).cast("bigint")
    block = F.floor((F.col("pos") - 1) / TAGGED_BLOCK).cast("int")
    if "tag_no" in items.columns:  # the reader knows which tag was queried; else blocks are full
        block = F.coalesce("tag_no", block)
    kept = (items.filter((F.col("pos") <= cap) & gate)
            .select("run", "source", "kind", "pos", "title", "url",
                    tag.alias("tag"), score.alias("score"),
                    F.array_position(F.array(*[F.lit(x) for x in FEED_KINDS]), kind).alias("kind_rank"),
                    block.alias("block")))
    # From here every step is a window partitioned by ``run`` (at most ~70
    # rows per run), so one shuffle on ``run`` serves them all.
    by_run = Window.partitionBy("run")
    # scored source: stop once SCORED_STOP items are kept
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("run", "kind").orderBy("pos")))
    kept = kept.filter((kind != "scored") | (F.col("_n") <= SCORED_STOP))
    # tagged source: a tag block runs when it is the first one or when the
    # total kept before it is under TAGGED_STOP (totals only grow, so once a
    # block is skipped every later block is too)
    hn = F.sum(F.when(kind == "scored", 1).otherwise(0)).over(by_run)
    tagged_before = F.sum(F.when(kind == "tagged", 1).otherwise(0)).over(
        Window.partitionBy("run").orderBy("kind_rank", "block").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    tagged_in_block = F.sum(F.when(kind == "tagged", 1).otherwise(0)).over(Window.partitionBy("run", "kind", "block"))
    kept = (kept.withColumn("_before", hn + tagged_before - tagged_in_block)
            .filter((kind != "tagged") | (F.col("block") == 0) | (F.col("_before") < TAGGED_STOP))
            .drop("_n", "_before"))
    # merge order, first-wins dedup, stable score sort, top n
    merged = kept.withColumn("merge_seq", F.struct("kind_rank", "pos"))
    key = F.lower(F.substring("title", 1, DEDUP_KEY))
    w_key = Window.partitionBy("run", key).orderBy("merge_seq")
    unique = merged.withColumn("_first", F.row_number().over(w_key)).filter(F.col("_first") == 1)
    w_rank = Window.partitionBy("run").orderBy(F.desc("score"), F.asc("merge_seq"))
    ranked = unique.withColumn("rank", F.row_number().over(w_rank))
    top = ((ranked if limit is None else ranked.filter(F.col("rank") <= limit))
           .select("run", F.col("rank").cast("bigint").alias("rank"), "title", "url",
                   F.col("source").alias("source"), "tag", "score"))
    return with_fallback(top, items.select("run").distinct(), limit)


def fallback_articles(limit: int | None) -> Column:
    """The fixed fallback list (first ``limit``) as an array of article structs."""
    names = ("title", "url", "source", "tag", "score")
    return F.array(*[F.struct(F.lit(i).cast("bigint").alias("rank"),
                              *[F.lit(v).cast("bigint" if n == "score" else "string").alias(n) for n, v in zip(names, row)])
                     for i, row in enumerate(RU.FALLBACK_ARTICLES[:limit], start=1)])


def with_fallback(top: DataFrame, runs: DataFrame, limit: int | None) -> DataFrame:
    """Runs without any article get the fixed fallback list (first ``limit``).

    Every run brings the list along and drops it where it has articles (a window over one run's few rows),
    so the merge itself is evaluated once."""
    spare = runs.select("run", F.explode(fallback_articles(limit)).alias("_a")).select("run", "_a.*")
    both = top.withColumn("_own", F.lit(True)).unionByName(spare.withColumn("_own", F.lit(False)))
    return (both.withColumn("_any", F.max("_own").over(Window.partitionBy("run")))
            .filter(F.col("_own") | ~F.col("_any")).drop("_own", "_any"))
