r"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprint.  A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, shingles of three words joined by one space (repeats
included; fewer words: the whole sequence; none: fingerprint zero), XXH64 with seed 42 of each; a bit is set if
it is set in over half of the hashes.

Index.  Equal fingerprints are one entry.  The uppermost nodes each hold a shared masked bit pattern: the 64 bits fall
into four masks of 16, and an entry stands under four nodes (mask, bits under the mask).  Entries that differ in
at most three bits agree under one mask at least, so they meet below one node where nothing has to be
compared again under that mask.  A node with more than ``CROWDED`` entries is divided in the same way: its free bits
fall into four masks and its entries stand under the four finer nodes (three differences spoil three of them at
most); this ends, because a node with 14 free bits holds 2**14 entries at most.  Below a node the entries
are sorted by Gray rank, so neighbours share long patterns; every ``FAN`` neighbours are one group whose mask names the bits
that all of them share, and groups are grouped again up to the node.  The search joins a node with itself from the top:
a pair of groups is given up as a whole once the differences accumulated under their common masks pass three.

Each task turns the links it finds into a forest, so crowds give no more rows than entries; components are exact.

Null text and text without words have fingerprint zero and link like any other.  Null ids get their class too; the
component is the smallest id that is not null.  Repeated rows share an entry.  An empty table gives an empty
result.  Other columns are ignored.  Very long texts are hashed whole, in blocks of words.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, slices, stored, texts
from .components import connected_components

SHINGLE = 3
SEED = 42
DISTANCE = 3
CROWDED = 1 << 14       # most entries of a node that one task searches
FAN = 16                # neighbours in a group
ENTRIES = 1 << 16       # entries dealt to a task, about
PAIRS = 1 << 20         # pairs of groups looked at together

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


# ---- fingerprints ----

def simhash(text: pa.Array, size: int = SHINGLE, block: int = 1 << 16) -> np.ndarray:
    """Fingerprint of each text."""
    text = pc.fill_null(text.take(pa.array(np.arange(len(text)))).cast(pa.large_string()), "")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
    data = text.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    data = _LOWER[data]
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.append(True, blank[:-1])[:len(data)], np.append(blank[1:], True)[:len(data)]
    starts = np.flatnonzero(~blank & (before | edge[:-1]))
    ends = np.flatnonzero(~blank & (after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, side="right") - 1
    n_words = np.bincount(doc, minlength=len(text))
    place = np.arange(len(starts)) - (np.cumsum(n_words) - n_words)[doc]
    n = n_words[doc]
    first = np.flatnonzero(np.where(n >= size, place <= n - size, place == 0))
    last = first + np.minimum(n[first], size) - 1
    votes = np.zeros((len(text), 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, len(first), block):
        f, l = first[lo:lo + block], last[lo:lo + block]
        base = f[0]
        at, size_of = starts[base:l[-1] + 1], (ends - starts)[base:l[-1] + 1] + 1
        out = np.cumsum(size_of) - size_of
        take = np.repeat(at - out, size_of) + np.arange(out[-1] + size_of[-1])
        raw = data[np.minimum(take, len(data) - 1)]
        raw[out + size_of - 1] = 0x20
        raw = raw.tobytes()
        spans = zip(out[f - base].tolist(), (out[l - base] + size_of[l - base] - 1).tolist())
        h = np.fromiter((digest(raw[a:b], SEED) for a, b in spans), U64, len(f))
        cut = np.flatnonzero(np.append(True, doc[f[1:]] != doc[f[:-1]]))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
        votes[doc[f[cut]]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
    shingles = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    return np.packbits(2 * votes > shingles[:, None], axis=1).view("<u8").ravel().astype(U64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a long."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, most=1_000_000):
                yield pa.record_batch([b.column("doc_id"), pa.array(simhash(b.column("text")).view(np.int64))], names=["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


# ---- the index below the nodes of one task ----

def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Place of each bit string in the reflected Gray code."""
    rank = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U64(shift)
    return rank


def _levels(fp: np.ndarray, node: np.ndarray, fan: int):
    """Groups from the entries (level 0) up to the nodes: (first child, children, bits shared, their values) of each level."""
    ones, zeros = fp, fp        # or and and of what lies below
    start, n = np.arange(len(fp)), np.ones(len(fp), np.int64)
    levels = [(start, n, np.full(len(fp), ~U64(0)), fp)]
    n_nodes = len(np.unique(node))
    while len(node) > n_nodes or len(levels) == 1:
        head = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        place = np.arange(len(node)) - np.repeat(head, np.diff(np.append(head, len(node))))
        first = np.flatnonzero(place % fan == 0)
        ones, zeros = np.bitwise_or.reduceat(ones, first), np.bitwise_and.reduceat(zeros, first)
        node = node[first]
        levels.append((first, np.diff(np.append(first, len(place))), ~(ones ^ zeros), zeros))
    return levels


def _expanded(a, b, start, n):
    """All pairs of children of the pairs (a, b) of groups; of a group with itself each pair once. Returns (pair, child, child)."""
    each = n[a] * n[b]
    pair = np.repeat(np.arange(len(a)), each)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
    x, y = start[a][pair] + k // n[b][pair], start[b][pair] + k % n[b][pair]
    keep = (a[pair] != b[pair]) | (x <= y)
    return pair[keep], x[keep], y[keep]


def close_pairs(fp: np.ndarray, node: np.ndarray, distance: int = DISTANCE, fan: int = FAN, pairs: int = PAIRS):
    """Pairs (places) of entries of one node that differ in at most ``distance`` bits.  Entries are sorted by node and Gray rank."""
    levels = _levels(fp, node, fan)
    top = len(levels) - 1
    roots = np.arange(len(levels[top][0]))
    stack = [(top, roots, roots, np.zeros(len(roots), np.int64), levels[top][2])]
    while stack:
        level, a, b, gone, known = stack.pop()
        if level == 0:
            other = a != b
            yield a[other], b[other]
            continue
        start, n = levels[level][:2]
        done = np.cumsum(n[a] * n[b])
        if len(a) > 1 and done[-1] > pairs:
            cut = min(max(1, int(np.searchsorted(done, done[-1] // 2))), len(a) - 1)
            stack.append((level, a[cut:], b[cut:], gone[cut:], known[cut:]))
            stack.append((level, a[:cut], b[:cut], gone[:cut], known[:cut]))
            continue
        pair, x, y = _expanded(a, b, start, n)
        shared, bits = levels[level - 1][2:]
        both = shared[x] & shared[y]
        gone = gone[pair] + np.bitwise_count((bits[x] ^ bits[y]) & both & ~known[pair])
        keep = gone <= distance
        if keep.any():
            stack.append((level - 1, x[keep], y[keep], gone[keep], both[keep]))


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the places of every link the smallest label of their class."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def _forest(rows: pa.Table, distance: int, fan: int) -> pa.Table:
    """Links (a, b) of a spanning forest of the close entries below the nodes of one task."""
    fp, mask, bits = (np.array(rows.column(c).to_numpy()).view(U64) for c in ("fp", "mask", "bits"))
    order = np.lexsort((gray_rank(fp), bits, mask))
    fp, mask, bits = fp[order], mask[order], bits[order]
    node = np.cumsum(np.append(True, (mask[1:] != mask[:-1]) | (bits[1:] != bits[:-1])))
    entries, place = np.unique(fp, return_inverse=True)
    label = np.arange(len(entries))
    for a, b in close_pairs(fp, node, distance, fan):
        _united(label, place[a], place[b])
    low = np.flatnonzero(label != np.arange(len(entries)))
    return pa.table({"a": entries[label[low]].view(np.int64), "b": entries[low].view(np.int64)})


# ---- the upper nodes ----

def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def divided(mask: int, parts: int = DISTANCE + 1) -> list[int]:
    """The masks of the nodes below a node with this mask: each adds a part of the free bits."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << k for k in free[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def _under(entries: DataFrame, masks: list[int], parts: int) -> DataFrame:
    """Each entry under the finer nodes of its node's mask: (fp, mask, bits).  ``masks`` has 4**level members."""
    if len(masks) == 1:
        rows = entries.select("fp", F.explode(F.array(*(F.lit(_signed(x)) for x in divided(masks[0], parts)))).alias("mask"))
    else:
        finer = entries.sparkSession.createDataFrame([(_signed(m), _signed(x)) for m in masks for x in divided(m, parts)],
                                                     "mask long, finer long")
        rows = entries.join(F.broadcast(finer), "mask").select("fp", F.col("finer").alias("mask"))
    rows = rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    return rows.distinct() if len(masks) > 1 else rows  # finer masks can be reached from several nodes


def near_links(entries: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED, fan: int = FAN, per_task: int = ENTRIES) -> DataFrame:
    """entries (fp, distinct) -> links (a, b) that join exactly the classes of the pairs within ``distance`` bits."""
    out = None
    masks, rows = [0], entries.select("fp", F.lit(0).cast("long").alias("mask"))
    while masks:
        rows = stored(_under(rows, masks, distance + 1), "nodes")
        masks = sorted({x for m in masks for x in divided(m, distance + 1)})
        sizes = rows.groupBy("mask", "bits").count()
        many = stored(sizes.filter(F.col("count") > max(crowded, 1 << distance)), "crowded")
        found = [r["mask"] % (1 << 64) for r in many.select("mask").distinct().collect()]  # 4**level masks at most
        n = rows.count()
        small = rows.join(many, ["mask", "bits"], "left_anti") if found else rows
        tasks = max(1, math.ceil(n / per_task))
        links = (small.withColumn("task", F.pmod(F.xxhash64("mask", "bits"), F.lit(tasks)))
                 .groupBy("task").applyInArrow(lambda t: _forest(t, distance, fan), "a long, b long"))
        out = links if out is None else out.unionByName(links)
        rows = rows.join(many, ["mask", "bits"], "left_semi").select("fp", "mask")
        masks = found
    return out


def simhash_components(docs: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fingerprint, component_id): the contract of op12."""
    prints = stored(fingerprints(docs), "fingerprints")
    entries = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "entries")
    classes = connected_components(near_links(entries.select("fp"), distance, crowded))
    named = entries.join(classes.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("component_id", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("least_of"))
    known = named.select("fp", "root").join(least, "root").select("fp", F.col("least_of").alias("component_id"))
    return prints.join(known, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
