"""Repeated substrings by prefix-free parsing.

Removes each byte that is covered by a ``length``-byte string which also starts anywhere else.

Parsing.  A rolling hash of the 8 bytes at each position marks a trigger wherever it is the smallest of some
``window`` consecutive positions (ties: the rightmost).  A trigger depends on the bytes around it alone, so
equal texts are cut into equal phrases whatever stands before them, no phrase is longer than
``window``, and every string of ``length`` bytes contains a trigger: the one that is smallest among
its first ``window`` positions.  The strings that share this trigger form one parse entry; their starts are
the entry's interval.

Corpus order.  Suffix arrays of dictionary and parse are needed here only as far as they tell which
suffixes agree on their first ``length`` bytes, so a suffix's rank is the hash of those bytes
(names instead of lexicographic ranks, as in prefix doubling); neighbours in corpus order that share
``length`` bytes are suffixes of equal rank.  Three facts keep the work small:

* all strings of an entry contain the ``core`` that follows its trigger (length - window + 1 bytes): an entry
  whose core occurs once has no repeated string;
* entries with equal phrase context (from the first start to the end of the last string) form one
  dictionary entry: if it occurs twice, all its strings are repeated;
* only where a core has several dictionary entries are their suffixes ranked one by one, one
  representative for each dictionary entry that occurs more than once.  These are the edges of repeats.

Ranks are equal when 64 bits of the core and 64 independent bits of the string agree.  Entries are shuffled by
core, suffixes by rank: a passage that is in a third of all documents is spread over its many
cores, and one document's entries are never needed together before its own spans are merged.

Null text is empty; matches never cross documents; a row that repeats another's id and text is one more
occurrence; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, mix64, slices, stored, texts

LENGTH = 400
WINDOW = 192
GRAM = 8
_BASE = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_INVERSE = tuple(U64(pow(int(b), -1, 2 ** 64)) for b in _BASE)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(k)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        with np.errstate(over="ignore"):
            up = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _BASE[k], U64)]))
            down = np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, _INVERSE[k], U64)]))
        have = _POWERS[k] = (up, down)
    return have


class Bytes:
    """Texts of a batch as one run of bytes, with hashes of any stretch of at least GRAM bytes."""

    def __init__(self, text: pa.Array):
        raw = [t.encode("utf-8", "surrogatepass") for t in text.to_pylist()]
        self.offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        data = np.frombuffer(b"".join(raw) + b"\0" * GRAM, np.uint8)
        g = np.zeros(len(data) - GRAM + 1, U64)
        for k in range(GRAM):
            g |= data[k:k + len(g)].astype(U64) << U64(8 * k)
        self.grams = mix64(g)
        self._sums: dict[int, np.ndarray] = {}

    def stretch(self, start: np.ndarray, end: np.ndarray, k: int = 0) -> np.ndarray:
        """64-bit hashes of [start, end); k picks one of two independent polynomials."""
        n = len(self.grams)
        up, down = _powers(k, n + 1)
        if k not in self._sums:
            v = self.grams if k == 0 else mix64(self.grams + U64(0x632BE59BD9B4E019))
            self._sums[k] = np.concatenate([[U64(0)], np.cumsum(v * up[:n])])
        s = self._sums[k]
        return mix64((s[end - GRAM + 1] - s[start]) * down[start] + (end - start).astype(U64))

    def entries(self, length: int, window: int):
        """(text, trigger, first start, last start) of every parse entry, as positions in the batch."""
        n = len(self.grams)
        size = np.diff(self.offsets)
        whole = np.flatnonzero(size >= length)
        if not len(whole):
            z = np.zeros(0, np.int64)
            return z, z, z, z
        # smallest hash of each run of `window` positions, the rightmost of equals
        key = (self.grams >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(n, dtype=U64))
        pad = (-n) % window + window
        key = np.concatenate([key, np.full(pad, U64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, window)
        ahead = np.minimum.accumulate(key, 1).ravel()
        back = np.minimum.accumulate(key[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[window - 1:window - 1 + n])
        starts = np.concatenate([np.arange(self.offsets[d], self.offsets[d + 1] - length + 1) for d in whole])
        owner = np.repeat(whole, size[whole] - length + 1)
        trigger = (U64(0xFFFFFFFF) - (least[starts] & U64(0xFFFFFFFF))).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1
        return owner[first], trigger[first], starts[first], starts[last]


ENTRIES = "core long, context long, row_key long, first int, n int, lead int"
RANKS = "rank long, row_key long, at int"
SPANS = "row_key long, lo int, hi int"


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, text and a key of both: rows that share an id stay apart, equal rows stay together."""
    return texts(docs).withColumn("row_key", F.xxhash64("doc_id", "text"))


def parse(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Parse entries of all texts."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, most=2_000_000):
                t = Bytes(b.column("text"))
                doc, trigger, first, last = t.entries(length, window)
                core = t.stretch(trigger, trigger + length - window + 1)
                context = mix64(t.stretch(first, last + length) ^ mix64((trigger - first).astype(U64)))
                keys = b.column("row_key").to_numpy()
                yield pa.record_batch(
                    [pa.array(core.view(np.int64)), pa.array(context.view(np.int64)), pa.array(keys[doc]),
                     pa.array((first - t.offsets[doc]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                     pa.array((trigger - first).astype(np.int32))], names=["core", "context", "row_key", "first", "n", "lead"])

    return _keyed(docs).mapInArrow(run, ENTRIES)


def _classified(entries: DataFrame) -> DataFrame:
    """Entries whose core occurs again, with ``whole`` (all strings repeated) and ``rank_it``."""
    own = Window.partitionBy("core", "context")
    rows = (entries.withColumn("_nth", F.row_number().over(own.orderBy("row_key", "first")))
            .withColumn("_same", F.count(F.lit(1)).over(own))
            .withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy("core")))
            .filter("_all > 1"))
    return rows.select("core", "row_key", "first", "n", "lead", (F.col("_same") > 1).alias("whole"),
                       ((F.col("_all") > F.col("_same")) & (F.col("_nth") == 1)).alias("rank_it"))


def _ranks(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """Rank of every suffix of the entries in ``asked``; a rank includes core and place of the trigger."""
    per_text = asked.groupBy("row_key").agg(F.collect_list(F.struct("core", "first", "n", "lead")).alias("e"))
    rows = _keyed(docs).join(per_text, "row_key").select("row_key", "text", "e")

    def run(batches):
        for batch in batches:
            for b in slices(batch, most=2_000_000):
                t = Bytes(b.column("text"))
                sizes, e = b.column("e").value_lengths().to_numpy(), b.column("e").flatten()
                core, first, n, lead = (e.field(c).to_numpy() for c in ("core", "first", "n", "lead"))
                text = np.repeat(np.arange(len(sizes)), sizes)
                of = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                at = first[of].astype(np.int64) + step
                start = t.offsets[text[of]] + at
                rank = t.stretch(start, start + length, 1) ^ mix64(core[of].view(U64) + (lead[of] - step).astype(U64))
                yield pa.record_batch([pa.array(rank.view(np.int64)), pa.array(b.column("row_key").to_numpy()[text[of]]),
                                       pa.array(at.astype(np.int32))], names=["rank", "row_key", "at"])

    return rows.mapInArrow(run, RANKS)


def repeated_spans(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """Byte intervals [lo, hi) of repeated strings: (row_key, lo, hi), overlapping and unmerged."""
    entries = stored(_classified(parse(docs, length, window)), "entries")
    whole = entries.filter("whole").select("row_key", F.col("first").alias("lo"), (F.col("first") + F.col("n") - 1 + length).alias("hi"))
    asked = entries.filter("rank_it").select("row_key", "core", "first", "n", "lead").distinct()
    ranks = _ranks(docs, asked, length)
    again = ranks.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("rank"))).filter("_n > 1")
    edges = stored(again.select("row_key", F.col("at").alias("lo"), (F.col("at") + length).alias("hi")), "edges")
    return whole.unionByName(edges)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def _pieces(docs: DataFrame, length: int, window: int) -> DataFrame:
    spans = repeated_spans(docs, length, window).groupBy("row_key").agg(F.collect_set(F.struct("lo", "hi")).alias("s"))
    return _keyed(docs).join(spans, "row_key", "left").select("doc_id", "text", "s")


def _cut(raw: bytes, spans) -> tuple[bytes, list[tuple[int, int]]]:
    if not spans:
        return raw, []
    lo, hi = merged(np.array([x["lo"] for x in spans]), np.array([x["hi"] for x in spans]))
    ends = [0, *hi.tolist()]
    starts = [*lo.tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends, starts)), list(zip(lo.tolist(), hi.tolist()))


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """doc_id, n_bytes, kept (binary), removed array<(lo, hi)>: maximal removed runs in bytes."""

    def run(batches):
        for b in batches:
            raw = [t.encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            done = [_cut(r, s) for r, s in zip(raw, b.column("s").to_pylist())]
            spans = [[{"lo": x, "hi": y} for x, y in s] for _, s in done]
            yield pa.record_batch(
                [b.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([k for k, _ in done], pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                names=["doc_id", "n_bytes", "kept", "removed"])

    return _pieces(docs, length, window).mapInArrow(
        run, "doc_id long, n_bytes long, kept binary, removed array<struct<lo: long, hi: long>>")


def substring_report(docs: DataFrame, length: int = LENGTH, window: int = WINDOW) -> DataFrame:
    """The contract of op3."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return remove_repeats(docs, length, window).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
