r"""Self-join of documents on the Jaccard similarity of their word 5-gram sets, by universe partition.

Sets.  A-Z lower-cased, words ``[^\x20\x09-\x0D]+``, distinct shingles of 5 words (fewer words: the whole
sequence as one shingle) as 64-bit hashes.  Two sets link when 100 * |a & b| >= 80 * |a | b|.

Pigeonhole.  Linked sets of sizes a <= b differ in at most K = floor(a / 4) shingles.  Sizes fall
into bands that double; a band of sizes up to ``hi`` cuts the universe of shingles into ``hi / 2`` segments
by hash (below 16 shingles every shingle is its own segment).  A set has a signature for each of its
segments that is not empty, in its own band and, if a linked set may be one band up, in that band too.
K differences spoil at most K segments, so ANY K + 1 signatures of a set find every linked set: expensive
buckets can be left out as long as K + 1 others remain.  That is the cost-based allocation:

1. Every bucket links its members to its smallest member (a star, linear in the bucket).  A parity sketch of
   2 to 4 bits a shingle rules out pairs that must differ too much (the sketches' difference never exceeds that of the
   sets).  Each set is verified exactly with the member it shares most buckets with, and with others only
   where the components so far differ.
2. A bucket whose members are all in one component is free: nothing can be found there any more.  A set with
   K + 1 free buckets is finished.
3. The sets that are left (made mostly of shared text) share a bucket only with each other.  Each buys its
   missing units where they are cheapest: a free segment of two shingles or more is raised to its one-deletion
   neighbourhood (linked sets then differ by at most one shingle there), and after those the smallest
   mixed buckets are taken.  Sets that meet in a busy bucket this way are compared sketch by sketch in
   blocks, so only pairs that may link become rows.  Pairs of different components are verified exactly.
4. A set whose segments cannot supply K + 1 units (possible when hashing crowds its shingles into few
   segments) is compared with all sets in blocks of bounded size.

So no bucket is capped and no pairs of a group are enumerated beyond what these units need.  Signatures
travel as sorted packed runs, one per task and part of the hash range; frequent exact copies (verified
Misra-Gries winners) are linked to one of them where they are read.

Null or blank text: empty set, linked with nothing.  Null ids take part in nothing and get a null
component.  Rows that share an id are one node with several sets.  Empty table: empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .common import Scratch, U64, collect_garbage, hash_strings, mix64, release, slices, split_words, stored, texts, tidy, tidy_group
from .components import connected_components
from .exact_dedup import heavy_texts

WORDS = 5
SMALL = 16                 # below this size every shingle is a segment
PER_SEGMENT = 2            # shingles per segment at the top of a band
PART_SIGNATURES = 450_000  # signatures of one part of the hash range
TOGETHER = 1_000_000       # signatures that are sorted and cut into parts at once
BLOCK = 256                # sets in one block of steps 3 and 4
STEP = 1.26                # sizes of linked sets are at most one step apart (a factor of 1.25)
FEW = 16                   # members up to which the pairs of a bucket of step 3 are formed one by one
MANY = 16_384              # ids above which texts are picked by a Bloom filter, not shuffled to meet the ids
BITS_PER_ID, HASHES = 16, 3
_P = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(text: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, offsets of the texts in them)."""
    codes, offsets, dictionary = split_words(text)
    w = hash_strings(dictionary)[codes] if len(codes) else np.zeros(0, U64)
    n_words = np.diff(offsets)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    if len(w) >= words:
        h = np.zeros(len(w) - words + 1, U64)
        for k in range(words):
            h += w[k:len(w) - words + 1 + k] * _P[k]
        ok = doc[:len(h)] == doc[words - 1:]
        h, owner = mix64(h[ok]), doc[:len(h)][ok]
    else:
        h, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    if len(short):
        extra = []
        for i in short:
            own = w[offsets[i]:offsets[i + 1]]
            extra.append(np.bitwise_xor.reduce(own * np.array(_P[:len(own)])) + U64(len(own)))
        h = np.concatenate([h, mix64(np.array(extra, U64) ^ U64(0xA5A5A5A5A5A5A5A5))])
        owner = np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        h, owner = h[order], owner[order]
    ends = np.cumsum(np.bincount(owner, minlength=len(n_words))).tolist()
    for lo, hi in zip([0, *ends], ends):  # text by text: far cheaper than one sort by (text, hash)
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(n_words)))]).astype(np.int64)


def band_of(size: np.ndarray) -> np.ndarray:
    """0 below SMALL, then one band per doubling."""
    size = np.maximum(size, 1)
    return np.where(size < SMALL, 0, np.floor(np.log2(np.maximum(size, SMALL) / SMALL)).astype(np.int64) + 1)


def segments_in(band: np.ndarray, per_segment: float) -> np.ndarray:
    return np.maximum(1, np.ceil((SMALL * 2.0 ** band - 1) / per_segment)).astype(np.int64)


def allowed(size):
    """K: most differences of a set of this size and a linked set that is not smaller."""
    return size // 4


def _segments(h: np.ndarray, offsets: np.ndarray, per_segment: float):
    """Every non-empty segment of every set, by family: (family, tokens, set, band and segment of each token, first token of each segment).

    family 0 is the set's own band, 1 the band above (only where a linked set may be there).
    """
    size = np.diff(offsets)
    band = band_of(size)
    for family in (0, 1):
        if family == 0:
            chosen = np.flatnonzero(size > 0)
            b = band
        else:
            # a linked set may have up to 1.25 times the shingles
            chosen = np.flatnonzero((size > 0) & (band_of(size * 5 // 4) > band))
            b = band + 1
        if not len(chosen):
            continue
        own = size[chosen]
        owner = np.repeat(chosen, own)
        at = np.arange(len(owner)) + np.repeat(offsets[chosen] - (np.cumsum(own) - own), own)
        tok = h[at]
        ob = b[owner]
        seg = ((tok >> U64(32)) * segments_in(ob, per_segment).astype(U64) >> U64(32)).astype(np.int64)
        single = ob == 0
        if single.any():
            seg[single] = at[single] - offsets[owner[single]]  # its own segment
        # a set's shingles are sorted, and its segments are ranges of them: equal segments lie together
        new = np.ones(len(tok), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
        yield family, tok, owner, ob, seg, np.flatnonzero(new)


def segment_counts(h: np.ndarray, offsets: np.ndarray, per_segment: float = PER_SEGMENT) -> list[np.ndarray]:
    """For each family the number of segments of every set that are not empty."""
    n = [np.zeros(len(offsets) - 1, np.int64) for _ in range(2)]
    for family, _, owner, _, _, first in _segments(h, offsets, per_segment):
        n[family] += np.bincount(owner[first], minlength=len(offsets) - 1)
    return n


def segment_table(h: np.ndarray, offsets: np.ndarray, per_segment: float = PER_SEGMENT):
    """Every non-empty segment of every set: (set, family, signature, size, tokens, first, place) arrays by family.

    tokens[first:first + size] are the segment's.
    """
    out = []
    for family, tok, owner, ob, seg, first in _segments(h, offsets, per_segment):
        content = np.add.reduceat(mix64(tok + U64(0x51ED27)), first) if len(first) else np.zeros(0, U64)
        place = np.where(ob[first] == 0, 0, seg[first]).astype(U64) * U64(64) + ob[first].astype(U64)
        out.append((owner[first], np.full(len(first), family), mix64(content + mix64(place)),
                    np.diff(np.append(first, len(tok))), tok, first, place))
    return out


# ---- passes over the documents ----

INFO = "doc_id long, n_shingles long, own_segments long, up_segments long, sketch binary, digest long"
RUNS = "part int, sigs binary, rows binary, docs binary"
SHARED = "class long, doc_id long, family int, sig long"


def sketches(h: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parity sketch of each set: bit ``shingle mod B`` flips with every shingle; B is a power of two from 2 to 4 times the size."""
    size = np.diff(offsets)
    bits = (2 ** np.ceil(np.log2(np.maximum(2 * size, 64)))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(size)), size)
    at = base[owner] + (h % bits[owner].astype(U64)).astype(np.int64)
    packed = np.packbits((np.bincount(at, minlength=base[-1]) & 1).astype(np.uint8)).tobytes() if len(size) else b""
    cut = (base // 8).tolist()
    return [packed[a:b] for a, b in zip(cut, cut[1:])]


def set_digests(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit digest of each set."""
    ends, data = (offsets * 8).tolist(), h.view(np.uint8).data
    return np.frombuffer(b"".join(hashlib.sha256(data[lo:hi]).digest()[:8] for lo, hi in zip(ends, ends[1:])), np.int64)


def may_link(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if the sets cannot link: sizes too far apart, or more differences than links allow."""
    if not n or not m or 5 * min(n, m) < 4 * max(n, m):
        return False
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[:len(a) // 2] ^ a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum()) * 9 <= n + m


def set_sizes(docs: DataFrame, per_segment: float = PER_SEGMENT) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in slices(batch, most=1_000_000):
                h, offsets = shingle_sets(b.column("text"))
                n = segment_counts(h, offsets, per_segment)
                yield pa.record_batch([b.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n[0]), pa.array(n[1]),
                                       pa.array(sketches(h, offsets), pa.binary()), pa.array(set_digests(h, offsets))],
                                      names=["doc_id", "n_shingles", "own_segments", "up_segments", "sketch", "digest"])
            release()

    return texts(docs).mapInArrow(tidy(run), INFO)


def _planes(x: np.ndarray) -> bytes:
    """Bytes of sorted numbers plane by plane: the leading planes are runs that compress away."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _cut(held: list[tuple], parts: int):
    """Record batches of RUNS: the signatures of several slices (signature, 2 * text + family, id of each text) in one sort."""
    ids = np.concatenate([i for _, _, i in held])
    start = np.cumsum([0, *(len(i) for _, _, i in held)])
    sig = np.concatenate([s for s, _, _ in held])
    row = np.concatenate([r + 2 * k for (_, r, _), k in zip(held, start.tolist())]).astype(np.uint32)
    held.clear()
    order = np.argsort(sig, kind="stable")
    sig, row = sig[order], row[order]
    del order
    part = ((sig >> U64(32)) * U64(parts) >> U64(32)).astype(np.int32)
    live, cuts = np.unique(part, return_index=True)
    cuts = np.append(cuts, len(part)).tolist()
    del part
    for some in range(0, len(live), 64):
        sigs, rows, own = [], [], []
        for lo, hi in zip(cuts[some:some + 64], cuts[some + 1:some + 65]):
            r = row[lo:hi]
            d, local = np.unique(r >> 1, return_inverse=True)
            sigs.append(_planes(sig[lo:hi]))
            rows.append((local * 2 + (r & 1)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
            own.append(ids[d].astype("<i8").tobytes())
        yield pa.record_batch([pa.array(live[some:some + 64], pa.int32()), pa.array(sigs, pa.binary()), pa.array(rows, pa.binary()),
                               pa.array(own, pa.binary())], names=["part", "sigs", "rows", "docs"])


def packed_signatures(docs: DataFrame, parts: int, per_segment: float = PER_SEGMENT) -> DataFrame:
    """Sorted runs of signatures: per TOGETHER signatures of a task and part, signatures and (document, family) of each."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for b in slices(batch, most=2_000_000):
                h, offsets = shingle_sets(b.column("text"))
                table = segment_table(h, offsets, per_segment)
                if not table:
                    continue
                held.append((np.concatenate([t[2] for t in table]), np.concatenate([t[0] * 2 + t[1] for t in table]).astype(np.uint32),
                             b.column("doc_id").to_numpy(zero_copy_only=False).copy()))
                n += len(held[-1][0])
                del h, offsets, table
                if n >= TOGETHER:
                    yield from _cut(held, parts)
                    n = 0
            release()
        if held:
            yield from _cut(held, parts)

    return texts(docs).filter("doc_id is not null").mapInArrow(tidy(run), RUNS)


def _shared(runs: pa.Table) -> pa.Table:
    """Buckets of one part that have two documents or more, by class: buckets with the same members are one class.

    One row per class and member; ``sig`` is null but for a row of the smallest member for each bucket.  The class is a
    hash of the members: should two ever share one, their members count as one bucket, which loses no link.
    """
    sig, doc, fam = [], [], []
    for s, r, d in zip(*(runs.column(c).to_pylist() for c in ("sigs", "rows", "docs"))):
        row = np.ascontiguousarray(np.frombuffer(r, np.uint8).reshape(4, -1).T).view("<u4").ravel()
        sig.append(_from_planes(s))
        doc.append(np.frombuffer(d, "<i8")[row >> 1])
        fam.append((row & 1).astype(np.int32))
    sig, doc, fam = np.concatenate(sig), np.concatenate(doc), np.concatenate(fam)
    order = np.argsort(sig, kind="stable")  # merges the sorted runs
    sig, doc, fam = sig[order], doc[order], fam[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    first = np.flatnonzero(new)
    many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
    keep = many[np.cumsum(new) - 1]
    sig, doc, fam, new = sig[keep], doc[keep], fam[keep], new[keep]
    order = np.lexsort((fam, doc, np.cumsum(new)))
    doc, fam = doc[order], fam[order]
    first = np.flatnonzero(new)
    members = mix64(doc.astype(U64) * U64(2) + fam.astype(U64) + U64(0x3C6EF372))
    of = mix64(np.add.reduceat(members, first)) if len(first) else np.zeros(0, U64)
    once = np.zeros(len(first), bool)  # the members of a class are named once in a part
    once[np.unique(of, return_index=True)[1]] = True
    bucket = np.cumsum(new) - 1
    rows = once[bucket] | new
    return pa.table({"class": pa.array(of[bucket][rows].view(np.int64)), "doc_id": pa.array(doc[rows]), "family": pa.array(fam[rows]),
                     "sig": pa.array(sig[rows].view(np.int64), mask=~new[rows])})


def _bloom(ids: DataFrame, words: int) -> DataFrame:
    """One row: a Bloom filter of the ids (column doc_id) as an array of 64-bit words."""
    at = ids.select(F.explode(F.array(*(F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(words * 64)) for k in range(HASHES)))).alias("at"))
    found = at.select(F.expr("shiftright(at, 6)").alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bits"))
    none = ids.sparkSession.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    rows = found.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("all")).select(F.col("all.bits").alias("_words"))


def _of(rows: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows (doc_id, text) of the ids (column doc_id, about ``n``), where there are many with a few others among them.

    No text is shuffled for it: few ids are broadcast, of many ids a Bloom filter is.
    """
    if n <= MANY:
        return rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    words = 1 << min(20, max(10, (n * BITS_PER_ID // 64).bit_length()))
    places = (f"pmod(xxhash64(doc_id, {k}), {words * 64})" for k in range(HASHES))
    held = [f"shiftright(get(_words, cast(shiftright({x}, 6) as int)), cast({x} & 63 as int)) & 1 = 1" for x in places]
    return rows.join(F.broadcast(stored(_bloom(ids, words), "bloom")), F.expr(" and ".join(held)), "left_semi")


def _sets(rows: DataFrame) -> DataFrame:
    """(doc_id, shingles binary) of the texts."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, most=1_000_000):
                h, offsets = shingle_sets(b.column("text"))
                rows = [h[lo:hi].tobytes() for lo, hi in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([b.column("doc_id"), pa.array(rows, pa.binary())], names=["doc_id", "shingles"])
            release()

    return rows.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, shingles binary")


def sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles binary) of the documents named in ``ids`` (column doc_id)."""
    return _sets(texts(docs).join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact test of 100 * |a & b| >= 80 * |a | b| on sorted distinct shingles."""
    if not len(a) or not len(b) or 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _chunks(batches, rows: int = 512):
    """Few rows of the batches at a time: each holds two sets or sketches, which become Python objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)
        release()


def plausible(info: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) that sizes and sketches do not rule out; ``same`` tells pairs of equal sets if ``info`` has digests."""
    digest = F.col("digest") if "digest" in info.columns else F.lit(None).cast("long")
    one = info.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("_na"), F.col("sketch").alias("_sa"), digest.alias("_da"))
    two = info.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("_nb"), F.col("sketch").alias("_sb"), digest.alias("_db"))
    names = pairs.columns

    def run(batches):
        for b in _chunks(batches):
            rows = zip(*(b.column(c).to_pylist() for c in ("_na", "_sa", "_nb", "_sb")))
            yield b.select([*names, "same"]).filter(pa.array([may_link(*r) for r in rows], pa.bool_()))

    rows = pairs.join(one, "a").join(two, "b").select(*names, "_na", "_sa", "_nb", "_sb", F.coalesce(F.expr("_na = _nb and _da = _db"), F.lit(False)).alias("same"))
    return rows.mapInArrow(tidy(run), StructType([*pairs.schema.fields, StructField("same", BooleanType())]))


def _different(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    c = comps.select(F.col("id").alias("a"), F.col("component_id").alias("_ca"))
    e = comps.select(F.col("id").alias("b"), F.col("component_id").alias("_cb"))
    return (pairs.join(c, "a", "left").join(e, "b", "left")
            .filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).drop("_ca", "_cb"))


def verified(docs: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose sets link; drop ``scratch`` once they are stored."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = scratch.stored(_sets(_of(texts(docs), ids, 2 * pairs.count())), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    rows = pairs.join(two, "b").join(one, "a")

    def run(batches):
        for b in _chunks(batches):
            ok = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64))
                  for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


# ---- step 3: sets without enough free buckets ----

PROBES = "key long, doc_id long, comp long, probe boolean"


def _place_key(sig: np.ndarray, owner: np.ndarray, family: np.ndarray) -> np.ndarray:
    return mix64(sig + mix64(owner.astype(U64) * U64(2) + family.astype(U64)))


def _first_of(owner: np.ndarray, rows: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of ``rows`` (sets together, the preferred first) the first ``most`` of each set."""
    own = owner[rows]
    rank = np.arange(len(rows)) - np.searchsorted(own, own)
    return rows[rank < most[own]]


def _neighbour_rows(unfinished: DataFrame, per_segment: float) -> DataFrame:
    """Index and probe rows of the unfinished sets.

    Input: doc_id, comp, text, mixed array<(family, n, sigs)>: the buckets with several components.
    A row without a key names a set whose segments cannot supply the units it needs.
    """

    def run(batches):
        for batch in batches:
            for b in slices(batch, most=500_000):
                h, offsets = shingle_sets(b.column("text"))
                n_sets = len(offsets) - 1
                ids, comp = b.column("doc_id").to_numpy(), b.column("comp").to_numpy()
                need = allowed(np.diff(offsets)) + 1
                per = b.column("mixed").value_lengths().to_numpy()
                m = b.column("mixed").flatten()
                m_of, m_family, m_n, m_sigs = np.repeat(np.arange(n_sets), per), *m.flatten()
                per = m_sigs.value_lengths().to_numpy()
                m_n = np.repeat(m_n.to_numpy(), per)
                m_key = _place_key(m_sigs.flatten().to_numpy().view(U64), np.repeat(m_of, per), np.repeat(m_family.to_numpy(), per))
                order = np.argsort(m_key)
                m_key, m_n = np.append(m_key[order], U64(0)), np.append(m_n[order], 0)
                keys, sets, probes = [], [], []
                for owner, family, sig, size, tok, first, place in segment_table(h, offsets, per_segment):
                    key = _place_key(sig, owner, family)
                    at = np.searchsorted(m_key[:-1], key)
                    n = np.where(m_key[at] == key, m_n[at], 0)  # 0: a free bucket
                    lack = need - np.bincount(owner[n == 0], minlength=n_sets)
                    raised = _first_of(owner, np.flatnonzero((n == 0) & (size >= 2)), lack)
                    lack = lack - np.bincount(owner[raised], minlength=n_sets)
                    mixed = np.flatnonzero(n > 0)
                    bought = _first_of(owner, mixed[np.lexsort((n[mixed], owner[mixed]))], lack)
                    lack = lack - np.bincount(owner[bought], minlength=n_sets)
                    probe = np.zeros(len(owner), bool)
                    probe[raised] = probe[bought] = True
                    # one-deletion neighbourhood of the segments with two shingles or more
                    up = np.zeros(len(owner), bool)
                    up[raised] = True
                    part = mix64(tok + U64(0x51ED27))
                    of = np.repeat(np.arange(len(owner)), size)
                    without = mix64(np.add.reduceat(part, first)[of] - part + mix64(place)[of])
                    large = size[of] >= 2
                    short = np.unique(owner[lack[owner] > 0])
                    keys += [pa.array(sig.view(np.int64)), pa.array(without[large].view(np.int64)), pa.nulls(len(short), pa.int64())]
                    sets += [owner, owner[of][large], short]
                    probes += [probe, up[of][large], np.ones(len(short), bool)]
                if keys:
                    of = np.concatenate(sets)
                    yield pa.record_batch([pa.concat_arrays(keys), pa.array(ids[of]), pa.array(comp[of]), pa.array(np.concatenate(probes))],
                                          names=["key", "doc_id", "comp", "probe"])
            release()

    return unfinished.mapInArrow(tidy(run), PROBES)


def _component(rows: DataFrame, comps: DataFrame, col: str = "doc_id") -> DataFrame:
    c = comps.select(F.col("id").alias(col), F.col("component_id").alias("comp"))
    return rows.join(c, col, "left").withColumn("comp", F.coalesce("comp", F.col(col)))


def _block_pairs(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Links of the named documents with all documents, in blocks of BLOCK sets."""
    spark = docs.sparkSession
    left = stored(sets_of(docs, ids), "crowded")
    n = left.count()
    out = spark.createDataFrame([], "a long, b long")
    blocks = max(1, -(-n // BLOCK))
    for k in range(blocks if n else 0):
        rows = left.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).collect()  # about BLOCK sets
        block = spark.sparkContext.broadcast([(r["doc_id"], bytes(r["shingles"])) for r in rows])

        def run(batches, block=block):
            own = [(i, np.frombuffer(s, U64)) for i, s in block.value]
            for b in batches:
                h, offsets = shingle_sets(b.column("text"))
                found = [(i, d) for d, lo, hi in zip(b.column("doc_id").to_pylist(), offsets[:-1], offsets[1:])
                         for i, s in own if i != d and linked(s, h[lo:hi])]
                yield pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())],
                                      names=["a", "b"])

        out = out.unionByName(texts(docs).filter("doc_id is not null").mapInArrow(tidy(run), "a long, b long"))
    return out


def _with_verified(docs: DataFrame, links: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """links and the verified pairs, stored; the sets they were compared by and their shuffles go."""
    scratch = Scratch(docs.sparkSession)
    out = stored(links.unionByName(verified(docs, pairs, scratch)), name)
    scratch.drop()
    collect_garbage(docs.sparkSession)
    return out


def _in_waves(docs: DataFrame, links: DataFrame, pairs: DataFrame) -> DataFrame:
    """links plus the verified ones of pairs (a, b, n, same) that join components: of each b first the pair with the largest n.

    Pairs of equal sets (``same``) link as they are.
    """
    order = Window.partitionBy("b").orderBy(F.desc("n"), "a")
    pairs = stored(pairs.withColumn("nth", F.row_number().over(order)).select("a", "b", "nth", "same"), "pairs")
    collect_garbage(docs.sparkSession)
    links, pairs = links.unionByName(pairs.filter("same").select("a", "b")), pairs.filter("not same")
    first = _with_verified(docs, links, pairs.filter("nth = 1").select("a", "b"), "links_first")
    rest = stored(_different(pairs.filter("nth > 1").select("a", "b"), connected_components(first)), "pairs_rest")
    return _with_verified(docs, first, rest, "links_rest")


def _by_width(sets: pa.StructArray) -> list[tuple]:
    """(ids, components, sizes, sketches as rows of 64-bit words) of the sets of a block, for each width of the sketches."""
    ids, comp, n = (sets.field(c).to_numpy() for c in ("doc_id", "comp", "n_shingles"))
    sketch = sets.field("sketch")
    width = pc.binary_length(sketch).to_numpy()
    out = []
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        rows = np.frombuffer(b"".join(sketch.take(pa.array(at)).to_pylist()), U64).reshape(len(at), w // 8)
        out.append((ids[at], comp[at], n[at], rows))
    return out


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    while s.shape[1] > words:
        s = s[:, :s.shape[1] // 2] ^ s[:, s.shape[1] // 2:]
    return s


def _close(one: pa.StructArray, two: pa.StructArray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks, or in one, of different components, that sizes and sketches do not rule out."""
    a = _by_width(one)
    b = a if two is None else _by_width(two)
    found = [(np.zeros(0, np.int64),) * 2]
    for x, (i, ci, n, s) in enumerate(a):
        for j, cj, m, t in b[x:] if two is None else b:
            if 5 * n.max() < 4 * m.min() or 5 * m.max() < 4 * n.min():
                continue
            words = min(s.shape[1], t.shape[1])
            s2, t2 = _folded(s, words), _folded(t, words)
            some = max(1, 100_000 // (len(t2) * words))
            for k in range(0, len(s2), some):
                own = n[k:k + some, None]
                ok = (5 * np.minimum(own, m) >= 4 * np.maximum(own, m)) & (ci[k:k + some, None] != cj)
                if not ok.any():
                    continue
                apart = np.bitwise_count(s2[k:k + some, None, :] ^ t2).sum(2, dtype=np.int32)
                u, v = np.nonzero(ok & (apart * 9 <= own + m))
                found.append((np.minimum(i[k + u], j[v]), np.maximum(i[k + u], j[v])))
    return tuple(np.concatenate(x) for x in zip(*found))


def _in_blocks(info: DataFrame, crowd: DataFrame, comps: DataFrame) -> DataFrame:
    """Plausible pairs among sets that share a busy bucket: the sketches of two blocks of sets are compared at once, so a pair
    becomes a row only if it may link.

    A group is all members of the busy buckets with one smallest member, the head (crowd: head, doc_id); every bucket lies
    in one group.  Groups are not joined where they overlap: with more documents that would make most of them one.  A group
    of more than BLOCK sets is cut by size, and each step of sizes by hash into blocks, which meet those of the same and the next step.
    """
    step = F.floor(F.log("n_shingles") / F.lit(math.log(STEP))).cast("long")
    light = crowd.join(info.filter("n_shingles > 0").select("doc_id", "n_shingles"), "doc_id").select("head", "doc_id", step.alias("step")).distinct()
    total = F.sum("n").over(Window.partitionBy("head"))
    cut = (light.groupBy("head", "step").agg(F.count(F.lit(1)).alias("n")).withColumn("total", total)
           .select("head", "step", F.when(F.col("total") > BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(0).cast("long").alias("blocks")))
    place = light.join(cut, ["head", "step"]).select("head", "doc_id", "step", F.when(F.col("blocks") > 0, F.col("step")).otherwise(-1).alias("at"),
                                                     F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).otherwise(0).alias("block"))
    sets = info.select("doc_id", "n_shingles", "sketch", step.alias("step"))
    placed = _component(place.join(sets, ["doc_id", "step"]), comps)
    block = stored(placed.groupBy("head", "at", "block").agg(F.collect_list(F.struct("doc_id", "comp", "n_shingles", "sketch")).alias("sets")), "blocks")
    names = block.select("head", "at", "block").filter("at >= 0")
    other = names.select("head", F.col("at").alias("at2"), F.col("block").alias("block2"))
    cells = names.join(other, "head").filter("(at = at2 and block < block2) or at + 1 = at2")
    one = block.withColumnRenamed("sets", "one")
    two = block.select("head", F.col("at").alias("at2"), F.col("block").alias("block2"), F.col("sets").alias("two"))
    rows = cells.join(one, ["head", "at", "block"]).join(two, ["head", "at2", "block2"]).select("one", "two")
    rows = rows.unionByName(one.select("one", F.lit(None).cast(one.schema["one"].dataType).alias("two")))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = batch.column("one")[k], batch.column("two")[k]
                a, b = _close(x.values, y.values if y.is_valid else None)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def links_and_sizes(docs: DataFrame, per_segment: float = PER_SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(components (id, component_id) of linked documents, info rows of all documents)."""
    all_docs = texts(docs)
    info = stored(set_sizes(docs, per_segment), "sizes")
    winners = stored(heavy_texts(docs), "winners")
    hot = F.broadcast(winners.select("h", F.lit(True).alias("hot")).distinct())  # only their texts are digested
    marked = all_docs.withColumn("h", F.xxhash64("text")).join(hot, "h", "left").withColumn("digest", F.when(F.col("hot"), F.unhex(F.sha2("text", 256))))
    marked = marked.join(F.broadcast(winners.select("digest", "keep_id")), "digest", "left")
    copy = F.col("keep_id").isNotNull() & (F.col("doc_id") != F.col("keep_id"))
    worded = F.when(F.col("hot"), F.length(F.regexp_replace("text", r"[ \t\n\x0B\f\r]", "")) > 0)  # not evaluated for other texts
    copies = marked.filter(copy & worded).select(F.col("doc_id").alias("a"), F.col("keep_id").alias("b"))
    base = marked.filter(F.coalesce(~copy, F.lit(True)) & F.col("doc_id").isNotNull()).select("doc_id", "text")

    named = all_docs.filter("doc_id is not null")
    size = info.agg(F.sum(F.col("own_segments") + F.col("up_segments"))).first()[0] or 0
    parts = max(32, -(-size // PART_SIGNATURES))
    shared = stored(packed_signatures(base, parts, per_segment).groupBy("part").applyInArrow(tidy_group(_shared), SHARED), "shared")
    collect_garbage(docs.sparkSession)
    # buckets with the same members are handled once, as a class: far fewer rows than buckets and members
    members = stored(shared.groupBy("class", "doc_id", "family").agg(F.count("sig").alias("sigs")), "members")
    pivots = members.groupBy("class").agg(F.min("doc_id").alias("a"), F.sum("sigs").alias("n"))
    pairs = (members.select("class", F.col("doc_id").alias("b")).join(pivots, "class").filter("a < b")
             .groupBy("a", "b").agg(F.sum("n").alias("n")))
    ids = info.filter("doc_id is not null")
    links = _in_waves(named, copies, plausible(ids, pairs))
    comps = stored(connected_components(links), "components1")

    # step 2: buckets with several components, and the sets they leave without K + 1 free ones
    rows = _component(members, comps)
    mixed = rows.groupBy("class").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"),
                                      F.sum("sigs").alias("buckets"))
    mixed = mixed.filter("lo < hi").select("class", "n", "buckets")
    mixed = stored(members.join(mixed, "class").select("class", "doc_id", "family", "n", "buckets"), "mixed")
    collect_garbage(docs.sparkSession)
    count = mixed.groupBy("doc_id", "family").agg(F.sum("buckets").alias("m"))
    free = F.when(F.col("family") == 0, F.col("own_segments")).otherwise(F.col("up_segments")) - F.col("m")
    unfinished = (count.join(info.filter("doc_id is not null"), "doc_id")
                  .filter(free < F.floor(F.col("n_shingles") / 4) + 1).select("doc_id").distinct())
    crowded = info.filter((F.col("doc_id").isNotNull()) & (F.col("n_shingles") > 0) & (
        (F.col("own_segments") < F.floor(F.col("n_shingles") / 4) + 1)
        | ((F.col("up_segments") > 0) & (F.col("up_segments") < F.floor(F.col("n_shingles") / 4) + 1)))).select("doc_id")
    unfinished = stored(unfinished.unionByName(crowded).distinct(), "unfinished")
    if unfinished.isEmpty():
        return comps, info

    # step 3
    sigs = shared.filter("sig is not null").groupBy("class").agg(F.collect_list("sig").alias("sigs"))
    own = mixed.join(unfinished, "doc_id", "left_semi").join(sigs, "class").groupBy("doc_id").agg(
        F.collect_list(F.struct("family", "n", "sigs")).alias("mixed"))
    left = (_of(named, unfinished, unfinished.count()).join(unfinished, "doc_id", "left_semi").join(own, "doc_id", "left")
            .select("doc_id", "text", F.coalesce("mixed", F.expr("array()").cast(own.schema["mixed"].dataType)).alias("mixed")))
    asked = stored(_neighbour_rows(_component(left, comps), per_segment), "asked")
    collect_garbage(docs.sparkSession)
    own = asked.filter("key is not null")
    keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("head"), F.min("comp").alias("lo"),
                                  F.max("comp").alias("hi"), F.max("probe").alias("asks"))
    met = stored(own.join(keys.filter("lo < hi and asks").select("key", "n", "head"), "key"), "met")
    collect_garbage(docs.sparkSession)
    few = met.filter(F.col("n") <= FEW)
    probe = few.filter("probe").select("key", F.col("doc_id").alias("x"), F.col("comp").alias("cx"))
    index = few.select("key", F.col("doc_id").alias("y"), F.col("comp").alias("cy"))
    more = probe.join(index, "key").filter("cx != cy").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    more = plausible(ids, more).select("a", "b")
    crowd = met.filter(F.col("n") > FEW).select("head", "doc_id").distinct()
    more = more.unionByName(_in_blocks(ids, stored(crowd, "crowd"), comps)).distinct()
    links = _in_waves(named, links, more.select("a", "b", F.lit(1).alias("n"), F.lit(False).alias("same")))
    # step 4
    lacking = stored(asked.filter("key is null").select("doc_id").distinct(), "lacking")
    if not lacking.isEmpty():  # stored, so its size is known and the texts are not shuffled for a few ids
        links = stored(links.unionByName(_block_pairs(base, lacking)), "links2")
    return stored(connected_components(links), "components2"), info


def ngram_components(docs: DataFrame, per_segment: float = PER_SEGMENT) -> DataFrame:
    """The contract of op6: doc_id, n_shingles, component_id."""
    comps, info = links_and_sizes(docs, per_segment)
    c = comps.select(F.col("id").alias("doc_id"), "component_id")
    return info.select("doc_id", "n_shingles").join(c, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_linked(docs: DataFrame) -> DataFrame:
    """Of each component the document with the smallest id stays, with its own columns."""
    comps, _ = links_and_sizes(docs)
    gone = comps.filter("id != component_id").select(F.col("id").alias("_gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
