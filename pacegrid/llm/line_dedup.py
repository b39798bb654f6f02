r"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

State of a ``LineIndex`` (tables of DataFrames, all sharded by the key's hash):

* ``refs`` (key, doc_id): which documents hold which line key, each once;
* ``counts`` (key, n_docs, keep_id): exact reference counts, built by partial aggregation, so a line
  found in a third of all documents is reduced on every mapper first;
* ``filters`` (shard, n_buckets, n_items, slots): one cuckoo filter per shard with the fingerprints of
  the shard's keys (4 slots a bucket, 16 bits a slot).  The number of shards follows the number of
  references, so one filter stays small: an index that outgrows its shards is given more.

``insert`` asks the filters first: keys that a filter has certainly not seen become new count rows
without reading the old counts; only the others are joined with the exact counts.  ``delete`` takes
references back, and removes the fingerprints of keys whose count falls to 0, so inserting and
deleting documents in any order gives the state of the remaining documents.  A filter over 84 % load, or one that
cannot place a key, is rebuilt with more buckets from the exact counts.

A line's key is the line stripped of ``[\x20\x09-\x0D]`` at both ends with A-Z lower-cased; keys under
``min_chars`` code points are not indexed.  ``apply`` drops the lines of keys found in at least
``min_docs`` documents, except in the document with the largest id (all lines of the key stay there).

Null text is one empty line.  Rows that share an id are one document for counting; null ids count as
one document, which keeps a line only if no other document has it.  Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, free_names, mix64, stored, texts, tidy

SLOTS = 4
LOAD = 0.84
KEYS_PER_SHARD = 200_000
BLOCKS = 2          # insertions of ``indexed``
MAX_KICKS = 200

REFS = "key binary, doc_id long"
COUNTS = "key binary, n_docs long, keep_id long"
FILTERS = "shard int, n_buckets int, n_items long, slots binary"


def line_key(line: str, min_chars: int) -> bytes | None:
    """16-byte digest of the line's key; None for a short key."""
    if len(line) < min_chars:
        return None
    key = line.strip(SPACE)
    if len(key) < min_chars:
        return None
    return hashlib.blake2b(key.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest()


# ---- cuckoo filter of one shard (numpy arrays; key digests as an (n, 16) byte matrix) ----

def _prints(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash for the first bucket, non-zero 16-bit fingerprint) of each key."""
    m = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 2) if keys else np.zeros((0, 2), "<u8")
    return m[:, 0].astype(np.uint64), (m[:, 1] % np.uint64(65535) + np.uint64(1)).astype(np.uint16)


def _other(bucket, fp, n: int):
    return (bucket ^ (mix64(np.asarray(fp, np.uint64)) & np.uint64(n - 1)).astype(np.int64)) & (n - 1)


class Cuckoo:
    """Approximate set of fingerprints with deletion; never a false negative."""

    def __init__(self, n_buckets: int, slots: np.ndarray | None = None):
        self.n = n_buckets
        self.slots = np.zeros((n_buckets, SLOTS), np.uint16) if slots is None else slots

    @classmethod
    def sized(cls, items: int) -> "Cuckoo":
        n = 8
        while n * SLOTS * LOAD < items:
            n *= 2
        return cls(n)

    def _first(self, h):
        return (h & np.uint64(self.n - 1)).astype(np.int64)

    def contains(self, keys: list[bytes]) -> np.ndarray:
        h, fp = _prints(keys)
        a = self._first(h)
        b = _other(a, fp, self.n)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[b] == fp[:, None]).any(1)

    def _fill(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        """Place what fits into the given buckets; mask of what was placed."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        free = self.slots[b] == 0
        ok = rank < free.sum(1)
        which = np.argmax(np.cumsum(free, 1) == (rank + 1)[:, None], 1)
        self.slots[b[ok], which[ok]] = fp[order][ok]
        placed = np.zeros(len(b), bool)
        placed[order[ok]] = True
        return placed

    def insert(self, keys: list[bytes]) -> bool:
        """Add keys that are not in the set; False when one cannot be placed (then rebuild larger)."""
        h, fp = _prints(keys)
        a = self._first(h)
        left = ~self._fill(a, fp)
        if left.any():
            rows = np.flatnonzero(left)
            second = _other(a[rows], fp[rows], self.n)
            rows = rows[~self._fill(second, fp[rows])]
            for i in rows:
                if not self._kick(int(_other(a[i:i + 1], fp[i:i + 1], self.n)[0]), fp[i]):
                    return False
        return True

    def _kick(self, bucket: int, fp) -> bool:
        for step in range(MAX_KICKS):
            row = self.slots[bucket]
            free = np.flatnonzero(row == 0)
            if len(free):
                row[free[0]] = fp
                return True
            slot = step % SLOTS
            fp, row[slot] = row[slot], fp
            bucket = int(_other(np.array([bucket]), np.array([fp]), self.n)[0])
        return False

    def delete(self, keys: list[bytes]) -> None:
        """Remove one fingerprint of each key; the keys must have been inserted."""
        h, fp = _prints(keys)
        a = self._first(h)
        b = _other(a, fp, self.n)
        for x, y, f in zip(a.tolist(), b.tolist(), fp.tolist()):
            for bucket in (x, y):
                hit = np.flatnonzero(self.slots[bucket] == f)
                if len(hit):
                    self.slots[bucket, hit[0]] = 0
                    break

    @classmethod
    def build(cls, keys: list[bytes], items: int | None = None) -> "Cuckoo":
        f = cls.sized(max(items or 0, len(keys)))
        while not f.insert(keys):
            f = cls(f.n * 2)
        return f

    @classmethod
    def load(cls, n_buckets: int, slots: bytes) -> "Cuckoo":
        return cls(n_buckets, np.frombuffer(slots, np.uint16).reshape(n_buckets, SLOTS).copy())


def _row(shard: int, f: Cuckoo, items: int) -> pd.DataFrame:
    return pd.DataFrame({"shard": [shard], "n_buckets": [f.n], "n_items": [items], "slots": [f.slots.tobytes()]})


def _asked(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """Keys of one shard with what its filter says."""
    keys = new["key"].tolist()
    seen = (Cuckoo.load(int(old["n_buckets"][0]), old["slots"][0]).contains(keys)
            if len(old) and keys else np.zeros(len(keys), bool))
    return pd.DataFrame({"key": new["key"], "n_docs": new["n_docs"], "keep_id": new["keep_id"], "maybe_seen": seen})


def _grown(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    """The shard's filter with its new keys; without slots when it has to be rebuilt."""
    keys = new["key"].tolist()
    if not len(old):
        return _row(int(new["shard"][0]), Cuckoo.build(keys), len(keys))
    f, items, shard = Cuckoo.load(int(old["n_buckets"][0]), old["slots"][0]), int(old["n_items"][0]), int(old["shard"][0])
    if items + len(keys) <= f.n * SLOTS * LOAD and f.insert(keys):
        return _row(shard, f, items + len(keys))
    return pd.DataFrame({"shard": [shard], "n_buckets": [0], "n_items": [items + len(keys)], "slots": [b""]})


def _rebuilt(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = pdf["key"].tolist()
    return _row(int(pdf["shard"].iloc[0]), Cuckoo.build(keys), len(keys))


def _shrunk(old: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    if not len(old):
        return pd.DataFrame({"shard": [], "n_buckets": [], "n_items": [], "slots": []})
    f = Cuckoo.load(int(old["n_buckets"][0]), old["slots"][0])
    f.delete(gone["key"].tolist())
    return _row(int(old["shard"][0]), f, int(old["n_items"][0]) - len(gone))


def line_refs(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(key, doc_id), each key once per row of ``docs``."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = {k for k in (line_key(x, min_chars) for x in text.split("\n")) if k is not None}
                keys.extend(own)
                ids.extend([i] * len(own))
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return texts(docs).mapInArrow(tidy(run), REFS)


@dataclass
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_chars: int = 20

    @classmethod
    def empty(cls, spark: SparkSession, min_chars: int = 20, shards: int = 0) -> "LineIndex":
        """``shards`` 0: chosen at the first insertion from its number of references."""
        none = [spark.range(0).select(*[F.lit(None).cast(t.split()[1]).alias(t.split()[0]) for t in s.split(", ")])
                for s in (REFS, COUNTS, FILTERS)]
        return cls(*none, shards, min_chars)

    def _shard(self, shards: int):
        return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Index of the old documents and ``docs``; ids that are already indexed add nothing."""
        first = self.shards == 0
        refs = line_refs(docs, self.min_chars)
        if not first:
            known = self.refs.select(F.col("doc_id").alias("_known")).distinct()
            refs = refs.join(known, refs["doc_id"].eqNullSafe(known["_known"]), "left_anti")
        refs = stored(refs, "refs")
        held = refs.count() + (0 if first else self.refs.count())
        shards = max(8, -(-held // KEYS_PER_SHARD))
        if not first and shards > self.shards:
            return self._resharded(max(shards, 2 * self.shards))._add(refs)
        return self._add(refs, shards)

    def _resharded(self, shards: int) -> "LineIndex":
        """The same index with its filters rebuilt from the exact counts in more shards."""
        filters = self.counts.withColumn("shard", self._shard(shards)).groupBy("shard").applyInPandas(_rebuilt, FILTERS)
        return replace(self, filters=stored(filters, "filters"), shards=shards)

    def _add(self, refs: DataFrame, shards: int = 0) -> "LineIndex":
        first, shards = self.shards == 0, self.shards or shards
        delta = _counted(refs).withColumn("shard", self._shard(shards))
        if first:
            delta = stored(delta, "delta")
            filters = delta.groupBy("shard").applyInPandas(_rebuilt, FILTERS)
            return LineIndex(refs, delta.drop("shard"), stored(filters, "filters"), shards, self.min_chars)
        old = self.filters.groupBy("shard")
        asked = stored(old.cogroup(delta.groupBy("shard")).applyInPandas(_asked, COUNTS + ", maybe_seen boolean"), "asked")
        fresh = asked.filter(~F.col("maybe_seen")).drop("maybe_seen")
        maybe = asked.filter("maybe_seen").drop("maybe_seen")
        joined = maybe.join(self.counts.select("key", F.lit(True).alias("_old")), "key", "left")
        new_keys = stored(fresh.unionByName(joined.filter(F.col("_old").isNull()).drop("_old")).select("key"), "new_keys")
        # keys the filters have not seen are complete; only the others meet the old counts
        counts = _merged(self.counts.unionByName(maybe)).unionByName(fresh)
        counts = stored(counts, "counts")
        grown = old.cogroup(new_keys.withColumn("shard", self._shard(shards)).groupBy("shard"))
        grown = stored(grown.applyInPandas(_grown, FILTERS), "grown")
        full = grown.filter("n_buckets = 0").select("shard")
        again = (counts.withColumn("shard", self._shard(shards)).join(full, "shard", "left_semi")
                 .groupBy("shard").applyInPandas(_rebuilt, FILTERS))
        filters = stored(grown.filter("n_buckets > 0").unionByName(again), "filters")
        return LineIndex(stored(self.refs.unionByName(refs), "refs"), counts, filters, shards, self.min_chars)

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Index without the given documents (column doc_id)."""
        gone_ids = doc_ids.select(F.col("doc_id").cast("long").alias("_gone")).distinct()
        hit = self.refs["doc_id"].eqNullSafe(gone_ids["_gone"])
        left = stored(self.refs.join(gone_ids, hit, "left_anti"), "refs")
        touched = self.refs.join(gone_ids, hit, "left_semi").select("key").distinct()
        again = _counted(left.join(touched, "key", "left_semi"))
        counts = stored(self.counts.join(touched, "key", "left_anti").unionByName(again), "counts")
        gone = touched.join(again.select("key"), "key", "left_anti").withColumn("shard", self._shard(self.shards))
        filters = self.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInPandas(_shrunk, FILTERS)
        return LineIndex(left, counts, stored(filters, "filters"), self.shards, self.min_chars)

    def dropped_keys(self, min_docs: int = 3) -> DataFrame:
        """(doc_id, keys): the keys whose lines a document loses."""
        hot = self.counts.filter(F.col("n_docs") >= min_docs).select("key", "keep_id")
        lost = self.refs.join(hot, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def apply(self, docs: DataFrame, min_docs: int = 3) -> DataFrame:
        """doc_id, n_lines, n_dropped, text (what stays) for every row of ``docs``."""
        lost = self.dropped_keys(min_docs).select(F.col("doc_id").alias("_lost_id"), "keys")
        d = texts(docs)
        rows = d.join(lost, d["doc_id"].eqNullSafe(lost["_lost_id"]), "left").select("doc_id", "text", "keys")
        min_chars = self.min_chars

        def run(batches):
            for b in batches:
                n, k, kept = [], [], []
                for text, keys in zip(b.column("text").to_pylist(), b.column("keys").to_pylist()):
                    lines = text.split("\n")
                    drop = set(keys or ())
                    stay = [x for x in lines if line_key(x, min_chars) not in drop] if drop else lines
                    n.append(len(lines))
                    k.append(len(lines) - len(stay))
                    kept.append("\n".join(stay) if len(stay) < len(lines) else text)
                yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(k, pa.int64()),
                                       pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])

        return rows.mapInArrow(tidy(run), "doc_id long, n_lines long, n_dropped long, text string")


def _counted(refs: DataFrame) -> DataFrame:
    """Exact counts; a row repeated with its id counts once."""
    once = refs.groupBy("key", "doc_id").agg(F.lit(1).alias("_one"))
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keep_id"))


def _merged(counts: DataFrame) -> DataFrame:
    return counts.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keep_id").alias("keep_id"))


def indexed(docs: DataFrame, min_chars: int = 20, blocks: int = BLOCKS) -> LineIndex:
    """Index of all documents, inserted in ``blocks`` of them (split by id, so rows that share an id stay together).

    From the second block on the filters decide which keys meet the exact counts of the blocks before.
    """
    index = LineIndex.empty(docs.sparkSession, min_chars)
    d = texts(docs)
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks))
    for k in range(blocks):
        index = index.insert(d.filter(block == k))
    return index


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """Index all documents, then rewrite them: doc_id, n_lines, n_dropped, text."""
    return indexed(docs, min_chars).apply(docs, min_docs)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """The contract of op9."""
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def line_dedup_stage(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """The documents with their columns, text rewritten (n_chars follows where there is one).

    A document that loses every line is dropped; one that was empty before stays.
    """
    index = indexed(docs, min_chars)
    names = docs.columns
    lost_id, lost_keys = free_names(names, "lost_id", "lost_keys")
    lost = index.dropped_keys(min_docs).select(F.col("doc_id").alias(lost_id), F.col("keys").alias(lost_keys))
    rows = docs.join(lost, docs["doc_id"].cast("long").eqNullSafe(lost[lost_id]), "left").drop(lost_id)

    def run(batches):
        for b in batches:
            text = b.column("text").to_pylist()
            out, keep = [], []
            for t, keys in zip(text, b.column(lost_keys).to_pylist()):
                if keys and t:
                    drop, lines = set(keys), t.split("\n")
                    stay = [x for x in lines if line_key(x, min_chars) not in drop]
                    keep.append(len(stay) > 0)
                    out.append("\n".join(stay))
                else:
                    keep.append(True)
                    out.append(t)
            cols = [pa.array(out, pa.string()) if c == "text" else b.column(c) for c in names]
            if "n_chars" in names and "text" in names:
                at = names.index("n_chars")
                fresh = [n if o == t else len(o) for n, o, t in zip(cols[at].to_pylist(), out, text)]
                cols[at] = pa.array(fresh, cols[at].type)
            yield pa.record_batch(cols, names=names).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(tidy(run), docs.schema)
