r"""Benchmark decontamination by spaced-seed hashing.

Tokens: the words between white space, lower-cased, without what is neither letter nor digit; words that
leave nothing are skipped.  A mask such as ``11010010111`` names the positions of a window that
count; its hash ignores the others, so a hit survives substitutions there.

1. Every window of every benchmark item is hashed under every mask (a seed).  A bitmap of fixed
   size over the seeds' hashes is broadcast: a filter without false negatives, whose size does not grow.
2. Every window of every document is hashed; windows that pass the bitmap are kept with the tokens
   around them, as many as the longest item has on either side, so an item that lies across a hit is there
   whole (one row per cluster of such windows, not per window).
3. Training hashes join benchmark hashes; a hit gives (cluster, item, diagonal).
4. Around each hit the diagonal is compared token by token.  An overlap is the longest
   run of at least ``min_tokens`` tokens of which at least ``similarity`` are equal, or the whole item where it is shorter.

The masks have weight 6.  Every way to change a fifth of the tokens (rounded down) of 10 to 25 leaves one of
them untouched somewhere inside (a test enumerates them all), and a longer run within the share holds one of 13 to 25
tokens that is: of two halves, one has no larger share.

Items of fewer than 10 tokens (5 at least) are found by the dense hash of the whole item and must
be equal; shorter ones are no evidence and are never matched.  A document's text is used whole.  Null or
blank texts match nothing; rows with a null id are compared too and give rows with a null id; rows that share
an id give the best overlap of them; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, hash_strings, mix64, release, slices, split_words, stored, texts, tidy

MASKS = ("111111", "1111011", "1101111", "110010111", "101100111", "110101011")
WHOLE = 10          # items with fewer tokens are found whole
MIN_TOKENS = 13
SIMILARITY = 0.8
SHORTEST = 5
BITS = 1 << 25      # of the broadcast bitmap (4 MB)
SLICE_BYTES = 500_000  # of text hashed at a time
GAP = 32            # hits further apart than this begin a new cluster


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the tokens, offsets of the texts in them)."""
    codes, offsets, words = split_words(text)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}\p{N}]+", "")
    keep = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    h = hash_strings(plain, seed=2)
    if not len(codes):
        return np.zeros(0, U64), offsets
    live = keep[codes]
    return h[codes[live]], np.concatenate([[0], np.cumsum(live)])[offsets]


def seed_hashes(t: np.ndarray, offsets: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of every window of the mask that lies inside one text."""
    span = len(mask)
    n = len(t) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    h = np.full(n, int(mask, 2) * 64 + span, U64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = (h ^ t[k:k + n]) * U64(0x9E3779B97F4A7C15)
            h ^= h >> U64(29)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(doc[:n] == doc[span - 1:])
    return at, mix64(h[at])


def overlap(same: np.ndarray, min_tokens: int, similarity: float) -> tuple[int, int, int] | None:
    """(start, length, equal) of the longest run of at least ``min_tokens`` with enough equal tokens."""
    share = round(similarity * 1000)
    score = np.concatenate([[0], np.cumsum(np.where(same, 1000 - share, -share))])
    starts = np.flatnonzero(score <= np.minimum.accumulate(score))      # nothing longer starts elsewhere
    best = np.maximum.accumulate(score[::-1])[::-1]                     # best score at or after each end
    ends = np.searchsorted(-best, -score[starts], side="right") - 1     # the furthest end that is good enough
    k = int(np.argmax(ends - starts))
    start, length = int(starts[k]), int(ends[k] - starts[k])
    if length < min_tokens:
        return None
    return start, length, int(same[start:start + length].sum())


SEEDS = "hash long, item_id long, item_pos int"
CLUSTERS = "doc_id long, start long, tokens binary, hashes array<long>, at array<int>"
ITEMS = "item_id long, item_tokens binary"


def item_rows(benchmark: DataFrame, id_col: str = "item_id") -> DataFrame:
    def run(batches):
        for b in batches:
            t, o = tokens(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array([t[x:y].tobytes() for x, y in zip(o[:-1], o[1:])], pa.binary())],
                                  names=["item_id", "item_tokens"])

    return texts(benchmark, id_col).mapInArrow(tidy(run), ITEMS)


def _masks_of(n: int, masks: tuple[str, ...]) -> list[str]:
    """Masks that apply to an item of n tokens: the spaced ones, or its whole dense window."""
    if n >= WHOLE:
        return [m for m in masks if len(m) <= n]
    return ["1" * n] if n >= SHORTEST else []


def seed_rows(items: DataFrame, masks: tuple[str, ...] = MASKS) -> DataFrame:
    def run(batches):
        for b in batches:
            hashes, ids, at = [], [], []
            for i, raw in zip(b.column("item_id").to_pylist(), b.column("item_tokens").to_pylist()):
                t = np.frombuffer(raw, U64)
                for m in _masks_of(len(t), masks):
                    pos, h = seed_hashes(t, np.array([0, len(t)]), m)
                    hashes.append(h.view(np.int64))
                    at.append(pos)
                    ids += [i] * len(pos)
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            yield pa.record_batch([pa.array(cat(hashes)), pa.array(ids, pa.int64()), pa.array(cat(at).astype(np.int32))],
                                  names=["hash", "item_id", "item_pos"])

    return items.mapInArrow(tidy(run), SEEDS)


def _bitmap(seeds: DataFrame, bits: int) -> bytes:
    """Bitmap of the seeds' hashes: per task at most bits / 8 bytes, merged in words of the map."""
    word = F.pmod(F.shiftrightunsigned("hash", 6), F.lit(bits // 64)).cast("int")
    rows = (seeds.select(word.alias("w"), F.expr("shiftleft(1L, int(hash & 63))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")))
    out = np.zeros(bits // 64, np.int64)
    pdf = rows.toPandas()  # at most bits / 64 rows, whatever the benchmark
    out[pdf["w"].to_numpy()] = pdf["b"].to_numpy()
    return out.tobytes()


def find_clusters(batches, bitmap: np.ndarray, used: tuple[str, ...], longest: int):
    """Clusters of windows that pass the bitmap, from SLICE_BYTES of text at a time."""
    bits = 64 * len(bitmap)
    for batch in batches:
        for b in slices(batch, most=SLICE_BYTES):
            t, offsets = tokens(b.column("text"))
            at, hashes = [], []
            for m in used:
                pos, h = seed_hashes(t, offsets, m)
                hit = (bitmap[((h >> U64(6)) % U64(bits // 64)).astype(np.int64)] >> (h & U64(63))) & U64(1) == 1
                at.append(pos[hit])
                hashes.append(h[hit])
            at, hashes = np.concatenate(at), np.concatenate(hashes)
            order = np.argsort(at, kind="stable")
            at, hashes = at[order], hashes[order]
            doc = np.searchsorted(offsets, at, side="right") - 1
            ids = b.column("doc_id").to_pylist()
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] - at[:-1] > GAP)
            first = np.flatnonzero(new)
            rows = []
            for lo, hi in zip(first, np.append(first[1:], len(at))):
                d = doc[lo]
                x = max(offsets[d], at[lo] - longest)
                y = min(offsets[d + 1], at[hi - 1] + longest)
                rows.append((ids[d], int(x - offsets[d]), t[x:y].tobytes(), hashes[lo:hi].view(np.int64), (at[lo:hi] - x).astype(np.int32)))
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(cols, types)],
                                  names=["doc_id", "start", "tokens", "hashes", "at"])
        release()


def contamination(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, min_tokens: int = MIN_TOKENS,
                  similarity: float = SIMILARITY, bits: int = BITS) -> DataFrame:
    """One row per (document, item) with an overlap: doc_id, item_id, doc_start, item_start, n_tokens, n_equal, item_tokens.

    Positions count tokens.
    """
    spark = docs.sparkSession
    items = stored(item_rows(benchmark), "items")
    seeds = stored(seed_rows(items, masks), "seeds")
    short = sorted(r["n"] for r in items.select((F.length("item_tokens") / 8).cast("int").alias("n")).distinct()
                   .filter(F.col("n").between(SHORTEST, WHOLE - 1)).collect())  # a few lengths
    longest = items.select(F.max(F.length("item_tokens") / 8).cast("int")).first()[0] or 0  # an item lies within this of any hit
    used = tuple(dict.fromkeys((*masks, *("1" * n for n in short))))
    flags = spark.sparkContext.broadcast(_bitmap(seeds, bits))

    def find(batches):
        return find_clusters(batches, np.frombuffer(flags.value, U64), used, longest)

    clusters = stored(texts(docs).mapInArrow(tidy(find), CLUSTERS).withColumn("cluster", F.monotonically_increasing_id()), "clusters")
    hits = clusters.select("cluster", F.explode(F.arrays_zip("hashes", "at")).alias("z")).select(
        "cluster", F.col("z.hashes").alias("hash"), F.col("z.at").alias("at"))
    candidates = (hits.join(seeds, "hash").select("cluster", "item_id", (F.col("at") - F.col("item_pos")).alias("diagonal")).distinct())
    rows = candidates.join(clusters.select("cluster", "doc_id", "start", "tokens"), "cluster").join(items, "item_id")

    def verify(batches):
        for b in batches:
            out = []
            for r in b.select(["doc_id", "item_id", "start", "diagonal", "tokens", "item_tokens"]).to_pylist():
                d, t, g = np.frombuffer(r["tokens"], U64), np.frombuffer(r["item_tokens"], U64), r["diagonal"]
                lo, hi = max(0, -g), min(len(t), len(d) - g)
                if hi <= lo:
                    continue
                whole = len(t) < WHOLE
                got = overlap(d[lo + g:hi + g] == t[lo:hi], min(min_tokens, len(t)), 1.0 if whole else similarity)
                if got:
                    out.append((r["doc_id"], r["item_id"], r["start"] + lo + g + got[0], lo + got[0], got[1], got[2], len(t)))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=FOUND)

    found = rows.mapInArrow(verify, ", ".join(f"{c} long" for c in FOUND))
    best = F.max(F.struct("n_equal", "n_tokens", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"), "item_tokens"))
    return (found.groupBy("doc_id", "item_id").agg(best.alias("x"))
            .select("doc_id", "item_id", (-F.col("x.d")).alias("doc_start"), (-F.col("x.i")).alias("item_start"),
                    "x.n_tokens", "x.n_equal", "x.item_tokens"))


FOUND = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_equal", "item_tokens"]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an overlap, with their own columns."""
    bad = contamination(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_bad"]), "left_anti")
