r"""Source divergence audit by in-mapper stripes.

Each partition folds whole documents into hash stripes, one per (lang, term): the term's document frequency and
its count in every source.  A partition's stripes live in sorted integer arrays of bounded size; when they pass
the bound after merging, they are spilled as rows and the fold starts anew.  Spilled stripes are summed by
(lang, term, source), put together again by (lang, term), and those of at least ``min_docs`` documents are the kept
terms.  The merged stripes, dealt into buckets by term together with the list of the language's groups, directly
give p of every group and so the divergences; sums of the buckets are added up.

Terms are the matches of ``[^\x00-\x40\x5B-\x60\x7B-\x7F]+`` (ASCII letters and everything beyond ASCII), A-Z
lower-cased.  p = 1 + floor(10**9 * (c + 5) / (N + 5 * V)) in integers by long division (exact below 9 * 10**17 tokens).

Null text, lang and source are ''.  A text that is empty or holds no letter counts as a document of its group and has no
terms; repeated rows count as often as they occur; a language with no kept term has pairs of value 0; a language with one source
has no pairs.  An empty table gives an empty result.  Other columns are ignored.  A single very long text is folded
whole, by the same arrays.  Ties of value are ranked by the UTF-8 bytes of the item.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, split_words, stored

MIN_DOCS = 30
TOP = 50
SCALE = 9               # p counts in units of 10**-9
PRIOR = 5               # added to every count
HELD = 2_000_000        # entries of the stripes that a partition holds before it merges, and spills if half remain
HELD_TERMS = 500_000    # terms of a partition before it spills
BUCKET = 25_000         # entries of merged stripes in one bucket, or the square of the number of sources if that is more
BLOCK = 512             # sources whose pairs one task works on
STRIPES = "lang string, term string, df long, sources array<string>, counts array<long>"

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def split_terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each term, offsets of the texts in it, distinct terms by code)."""
    text = pc.fill_null(text.take(pa.array(np.arange(len(text)))).cast(pa.large_string()), "")
    text = text if text.offset == 0 else pa.concat_arrays([text])
    offsets = np.frombuffer(text.buffers()[1], np.int64)[:len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    plain = pa.LargeStringArray.from_buffers(len(text), pa.py_buffer(offsets.tobytes()), pa.py_buffer(_LETTERS[data].tobytes()))
    return split_words(plain, lower=False)


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, with the sums of their numbers."""
    if not len(key):
        return key, n
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


class _Stripes:
    """The stripes of one partition: counts keyed by (term, group) and document frequencies keyed by (term, lang)."""

    def __init__(self):
        self.terms: dict[str, int] = {}
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.counts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.dfs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        self.held = 0

    def fold(self, text: pa.Array, langs: list[str], sources: list[str]) -> None:
        codes, offsets, dictionary = split_terms(text)
        if not len(codes):
            return
        term = np.array([self.terms.setdefault(t, len(self.terms)) for t in dictionary.to_pylist()], np.int64)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs], np.int64)
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources)], np.int64)
        doc = np.repeat(np.arange(len(langs)), np.diff(offsets))
        key, n = _summed(doc * len(dictionary) + codes, np.ones(len(codes), np.int64))
        doc, term = key // len(dictionary), term[key % len(dictionary)] << 24
        self.counts.append(_summed(term + group[doc], n))
        self.dfs.append(_summed(term + lang[doc], np.ones(len(n), np.int64)))
        self.held += len(self.counts[-1][0]) + len(self.dfs[-1][0])

    def merge(self) -> None:
        self.counts = [_summed(*map(np.concatenate, zip(*self.counts)))]
        self.dfs = [_summed(*map(np.concatenate, zip(*self.dfs)))]
        self.held = len(self.counts[0][0]) + len(self.dfs[0][0])

    def rows(self):
        """The stripes as record batches."""
        self.merge()
        if not self.terms:
            return
        terms, langs = pa.array(list(self.terms), pa.string()), pa.array(list(self.langs), pa.string())
        ids = self.langs
        lang_of = np.array([ids[g[0]] for g in self.groups], np.int64)
        sources = pa.array([g[1] for g in self.groups], pa.string())
        (key, n), (df_key, df) = self.counts[0], self.dfs[0]
        group = key & 0xFFFFFF
        stripe = (key >> 24 << 24) + lang_of[group]
        order = np.argsort(stripe, kind="stable")
        stripe, group, n = stripe[order], group[order], n[order]
        first = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1]))  # as many as df_key, in its order
        ends = np.append(first, len(stripe))
        for lo in range(0, len(first), 20_000):
            hi = min(lo + 20_000, len(first))
            at = pa.array((ends[lo:hi + 1] - ends[lo]).astype(np.int32))
            part = slice(ends[lo], ends[hi])
            yield pa.record_batch([langs.take(pa.array(df_key[lo:hi] & 0xFFFFFF)), terms.take(pa.array(df_key[lo:hi] >> 24)),
                                   pa.array(df[lo:hi]),
                                   pa.ListArray.from_arrays(at, sources.take(pa.array(group[part]))),
                                   pa.ListArray.from_arrays(at, pa.array(n[part]))],
                                  names=["lang", "term", "df", "sources", "counts"])


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))


def fold_stripes(docs: DataFrame, held: int = HELD, held_terms: int = HELD_TERMS) -> DataFrame:
    """Spilled stripes of all partitions; a (lang, term) may come in several rows."""

    def run(batches):
        stripes = _Stripes()
        for batch in batches:
            for b in slices(batch, most=1_000_000):
                stripes.fold(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist())
                if stripes.held > held:
                    stripes.merge()
                if stripes.held > held // 2 or len(stripes.terms) > held_terms or len(stripes.groups) > 1 << 22:
                    yield from stripes.rows()
                    stripes = _Stripes()
        yield from stripes.rows()

    return _documents(docs).mapInArrow(run, STRIPES)


def merged_stripes(stripes: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, df, stripe array<(source, n)>) of the kept terms."""
    entry = "array(named_struct('source', cast(null as string), 'n', df))"
    flat = stripes.select("lang", "term", F.explode(F.expr(
        f"concat({entry}, zip_with(sources, counts, (s, c) -> named_struct('source', s, 'n', c)))")).alias("e"))
    sums = flat.groupBy("lang", "term", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("n"))
    return (sums.groupBy("lang", "term")
            .agg(F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("df"),
                 F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("stripe"))
            .filter(F.col("df") >= min_docs))


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**SCALE * count / total), digit by digit so that nothing overflows."""
    whole, rest = np.divmod(count, total)
    for _ in range(SCALE):
        digit, rest = np.divmod(rest * 10, total)
        whole = whole * 10 + digit
    return whole + 1


PARTS = "lang string, source string, part string, item string, value long"


def _bucket_parts(top: int, block: int):
    """Divergences of one bucket of a language's kept terms, for one block of its sources."""

    def run(key, stripes: pa.Table, groups: pa.Table) -> pa.Table:
        groups = groups.sort_by("source")
        lang = key[0].as_py()
        names = groups.column("source").combine_chunks()
        own = range(min(key[2].as_py() * block, len(names)), min((key[2].as_py() + 1) * block, len(names)))
        size, terms, lang_total = (np.array(groups.column(c).to_numpy(), np.int64) for c in ("total", "terms", "lang_total"))
        total = size + PRIOR * terms
        gaps = np.zeros((len(own), len(names)), np.int64)
        best: list[list[tuple[int, str]]] = [[] for _ in own]
        step = max(1, 500_000 // max(1, len(names)))
        for lo in range(0, stripes.num_rows, step):
            part = stripes.slice(lo, step)
            term = part.column("term").to_pylist()
            order = np.array(sorted(range(len(term)), key=term.__getitem__))
            lists = part.column("stripe").combine_chunks()
            row = np.repeat(np.arange(len(term)), lists.value_lengths().to_numpy(zero_copy_only=False))
            entry = lists.flatten()
            count = np.zeros((len(term), len(names)), np.int64)
            count[row, pc.index_in(entry.field("source"), names).to_numpy()] = entry.field("n").to_numpy()
            p = shares(count + PRIOR, total)
            q = shares(count.sum(axis=1) + PRIOR, lang_total[0] + PRIOR * terms[0])
            for k, s in enumerate(own):
                gaps[k] += np.abs(p - p[:, s:s + 1]).sum(axis=0)
                over = np.where(count[:, s] > 0, p[:, s] - q, 0)[order]
                up = np.flatnonzero(over > 0)
                up = up[np.argsort(-over[up], kind="stable")[:top]]
                best[k] = sorted(best[k] + [(-int(over[i]), term[order[i]]) for i in up])[:top]
        rows = [(lang, names[s].as_py(), "term", t, -v) for k, s in enumerate(own) for v, t in best[k]]
        out = [pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.string()] * 4 + [pa.int64()])],
                                    names=["lang", "source", "part", "item", "value"])]
        for k, s in enumerate(own):
            others = np.flatnonzero(np.arange(len(names)) != s)
            out.append(pa.table({"lang": pa.array([lang] * len(others), pa.string()),
                                 "source": pa.array([names[s].as_py()] * len(others), pa.string()),
                                 "part": pa.array(["pair"] * len(others), pa.string()),
                                 "item": names.take(pa.array(others)), "value": pa.array(gaps[k][others])}))
        return pa.concat_tables(out)

    return run


def source_divergences(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bucket: int = BUCKET, block: int = BLOCK,
                       held: int = HELD, held_terms: int = HELD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): the contract of op13."""
    merged = stored(merged_stripes(fold_stripes(docs, held, held_terms), min_docs), "stripes")
    entries = merged.select("lang", "term", F.explode("stripe").alias("e"))
    totals = entries.groupBy("lang", F.col("e.source").alias("source")).agg(F.sum("e.n").alias("total"))
    kept = merged.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"),
                                      F.sum(F.expr("aggregate(stripe, 0L, (a, e) -> a + e.n)")).alias("lang_total"))
    groups = stored(_documents(docs).select("lang", "source").distinct()
                    .join(totals, ["lang", "source"], "left").join(kept, "lang", "left")
                    .fillna(0, ["total", "terms", "lang_total"]), "groups")
    n_entries = merged.agg(F.sum(F.size("stripe")).alias("n")).first()["n"] or 0
    widest = groups.groupBy("lang").count().agg(F.max("count").alias("n")).first()["n"] or 0
    buckets, blocks = max(1, math.ceil(n_entries / max(bucket, widest ** 2))), max(1, math.ceil(widest / block))
    dealt = (merged.select("lang", "term", "stripe", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (groups.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    keys = ["lang", "bucket", "block"]
    parts = (dealt.groupBy(keys).cogroup(asked.groupBy(keys)).applyInArrow(_bucket_parts(top, block), PARTS))
    parts = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = parts.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top)).select(
        "lang", "source", "part", "item", "value", "rank")
