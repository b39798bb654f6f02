r"""Near-duplicate paragraphs by MinHash banding, verified and clustered.

Units.  A *paragraph* is a line of at least ``MIN_WORDS`` words, or a block of consecutive shorter lines (without a
blank one between) that has as many; its set holds its distinct 5-word shingles.  Pieces and passages run over the words of the
whole document, for which a newline is white space like any other.  A document is cut into *pieces* at its ends and where a
word's hash is the smallest of ``CUT`` consecutive words: cuts depend on the words around them alone.  Pieces of
at least ``MIN_PIECE`` words are compared for equality (their one band is the digest of the whole piece).  A *passage* is a run of
words whose windows of ``PASSAGE`` words all stand elsewhere too: every word of every repeated window is
in one, wherever it stands and however it is wrapped.

Passages.  Every window has a seed, its ``SEED``-word gram of the smallest hash.  1. Neighbouring windows share a seed, so
seeds are few; those that stand in one place only drop out.  2. The windows of the others are compared by digest.
3. Each window gets the smallest (doc_id, start) of its class; neighbours with the same shift to it are joined
to the passage.

Paragraphs.  1. Equal paragraphs form classes by digest.  2. Representatives get ``bands`` signatures of
``rows`` minima; ``tune`` takes the fewest hashes whose recall at the similarity reaches the target, preferring more
rows per band while recall allows.  3. Each bucket links its members to its smallest (linear); pairs are
verified by exact Jaccard similarity of the shingles, whatever their number: one changed inner word unlinks
paragraphs of fewer than 49 words.  4. Components.  5. Buckets that still hold several components
compare their members across components, so no link inside a bucket is lost.

Of every class the unit with the smallest (doc_id, start) stays; the others are removed.

Null text has no units.  Rows with a null id take no part.  Rows that share an id are the same document.  Empty
tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Scratch, hash_strings, mix64, slices, split_words, stored, texts, tidy_group
from .components import connected_components
from .ngram_join import FEW, _from_planes, _in_blocks, _planes, linked, plausible, sketches

WORDS = 5
MIN_WORDS = 20
CUT = 20
MIN_PIECE = 8
PASSAGE = 50
SEED = 20
SIMILARITY = 0.8
RECALL = 0.999
_P = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def tune(similarity: float = SIMILARITY, recall: float = RECALL, false_at: float = 0.4, most_false: float = 0.5) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with the wanted recall at ``similarity`` and at most ``most_false``
    collisions at ``false_at``."""
    best = None
    for rows in range(1, 13):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity ** rows)))
        if 1 - (1 - false_at ** rows) ** bands <= most_false and (best is None or bands * rows < best[0] * best[1]):
            best = (bands, rows)
    return best


def _least(x: np.ndarray, k: int) -> np.ndarray:
    """Minimum of every k consecutive values."""
    size = 1
    while 2 * size <= k:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[:len(x) - (k - size)], x[k - size:]) if k > size else x


def _placed(h: np.ndarray) -> np.ndarray:
    """Keys that order by hash, the later place first; the place can be read off."""
    return (h >> U64(32) << U64(32)) | (U64(0xFFFFFFFF) - np.arange(len(h), dtype=U64))


def _place(key: np.ndarray) -> np.ndarray:
    return (U64(0xFFFFFFFF) - (key & U64(0xFFFFFFFF))).astype(np.int64)


class Units:
    """Words of a batch of texts, by line and by document."""

    def __init__(self, text: pa.Array):
        text = text.take(pa.array(np.arange(len(text))))  # own buffers, see split_words
        lists = pc.split_pattern(pc.fill_null(text.cast(pa.large_string()), ""), "\n")
        first = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        codes, self.offsets, words = split_words(lists.values)
        self.words = hash_strings(words, seed=6)[codes] if len(codes) else np.zeros(0, U64)
        self.doc = np.repeat(np.arange(len(text)), np.diff(first))
        self.docs = self.offsets[first]  # offsets of the documents

    def digests(self, lo: np.ndarray, hi: np.ndarray, which: tuple[int, ...] = (0, 1)) -> list[np.ndarray]:
        """64-bit digests (two of them) of word runs [lo, hi)."""
        out = []
        for k in which:
            base = _P[2 * k]
            inv = U64(pow(int(base), -1, 2 ** 64))
            n = len(self.words) + 1
            up = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, base, U64)]))
            down = np.cumprod(np.concatenate([[U64(1)], np.full(n - 1, inv, U64)]))
            s = np.concatenate([[U64(0)], np.cumsum(mix64(self.words + U64(k)) * up[:-1])])
            out.append(mix64((s[hi] - s[lo]) * down[lo] + (hi - lo).astype(U64)))
        return out

    def shingles(self, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
        """Sorted distinct shingle hashes of the word runs [lo, hi)."""
        if not len(lo):
            return []
        n = max(len(self.words) - WORDS + 1, 0)
        h = np.zeros(n, U64)
        for k in range(WORDS):
            h += self.words[k:k + n] * _P[k]
        h = mix64(h)        # of all places once
        size = np.maximum(hi - lo - WORDS + 1, 0)
        owner = np.repeat(np.arange(len(lo)), size)
        h = h[np.arange(len(owner)) + np.repeat(lo - (np.cumsum(size) - size), size)]
        ends = np.cumsum(size).tolist()
        for x, y in zip([0, *ends], ends):
            h[x:y].sort()
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        return np.split(h[new], np.cumsum(np.bincount(owner[new], minlength=len(lo)))[:-1])

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end word) of the long lines and of the blocks of short ones."""
        size = np.diff(self.offsets)
        at = np.flatnonzero(size)
        new = np.ones(len(at), bool)
        new[1:] = ((at[1:] != at[:-1] + 1) | (self.doc[at[1:]] != self.doc[at[:-1]])
                   | (size[at[1:]] >= MIN_WORDS) | (size[at[:-1]] >= MIN_WORDS))
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at))[:len(head)] - 1
        lo, hi = self.offsets[at[head]], self.offsets[at[tail] + 1]
        keep = hi - lo >= MIN_WORDS
        return self.doc[at[head]][keep], lo[keep], hi[keep]

    def _windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(document, first word) of every window of k words inside a document."""
        n = np.maximum(np.diff(self.docs) - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        return doc, np.arange(len(doc)) + (self.docs[:-1] - (np.cumsum(n) - n))[doc]

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, end word) of the pieces."""
        doc, at = self._windows(CUT)
        ends = np.arange(len(self.docs) - 1)
        cut = _place(_least(_placed(mix64(self.words + U64(77))), CUT)[at]) if len(at) else at
        new = np.ones(len(cut), bool)
        new[1:] = (cut[1:] != cut[:-1]) | (doc[1:] != doc[:-1])
        doc = np.concatenate([doc[new], ends, ends])
        cut = np.concatenate([cut[new], self.docs[:-1], self.docs[1:]])
        order = np.lexsort((cut, doc))
        doc, cut = doc[order], cut[order]
        same = doc[1:] == doc[:-1]
        return doc[:-1][same], cut[:-1][same], cut[1:][same]

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, first window, number of windows, hash) of every seed: consecutive windows share it."""
        doc, at = self._windows(PASSAGE)
        if not len(at):
            return doc, at, at, np.zeros(0, U64)
        gram = np.arange(len(self.words) - SEED + 1)
        hashes = self.digests(gram, gram + SEED, (0,))[0]
        place = _place(_least(_placed(hashes), PASSAGE - SEED + 1)[at])
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(new)
        return doc[head], at[head], np.diff(np.append(head, len(at))), hashes[place[head]]


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


UNITS = ("doc_id long, start long, n_words long, digest long, digest2 long, bands array<long>, "
         "n_shingles long, sketch binary")


def _minhash(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Signatures of the bands; the hash functions are x -> ax + b on the (mixed) shingle hashes."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    start = np.cumsum(size) - size
    out = np.zeros((len(sets), bands), U64)
    drawn = mix64(np.arange(1, 2 * bands * rows + 1, dtype=U64) * _P[1])
    moved = np.empty_like(flat)
    for b in range(bands):
        h = np.full(len(sets), b + 1, U64)
        for r in range(rows):
            a, c = drawn[2 * (b * rows + r)] | U64(1), drawn[2 * (b * rows + r) + 1]
            np.add(np.multiply(flat, a, out=moved), c, out=moved)
            h = mix64(h * _P[0] + np.minimum.reduceat(moved, start))
        out[:, b] = h
    return out


def paragraph_units(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in slices(batch):
                u = Units(b.column("text"))
                ids = b.column("doc_id").to_numpy()
                doc, lo, hi = u.paragraphs()
                if not len(lo):
                    continue
                one, two = u.digests(lo, hi)
                sets = u.shingles(lo, hi)
                sig = _minhash(sets, bands, rows)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(lo) + 1) * bands, pa.int32()), pa.array(sig.view(np.int64).ravel()))
                yield pa.record_batch([pa.array(ids[doc]), pa.array(lo - u.docs[doc]), pa.array(hi - lo),
                                       pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), flat,
                                       pa.array(np.diff(ends)), pa.array(sketches(np.concatenate(sets), ends), pa.binary())],
                                      names=_names(UNITS))

    return texts(docs).filter("doc_id is not null").mapInArrow(run, UNITS)


PIECES = "part int, digest binary, digest2 binary, doc_id binary, start binary, n_words binary"


def piece_units(docs: DataFrame, parts: int) -> DataFrame:
    """Sorted runs of pieces: per slice of a task and part of the digests, the columns of its pieces."""

    def run(batches):
        for batch in batches:
            for b in slices(batch):
                u = Units(b.column("text"))
                ids = b.column("doc_id").to_numpy()
                doc, lo, hi = u.pieces()
                keep = hi - lo >= MIN_PIECE
                doc, lo, hi = doc[keep], lo[keep], hi[keep]
                if not len(lo):
                    continue
                one, two = u.digests(lo, hi)
                order = np.argsort(one)
                cols = [x[order] for x in (one, two, ids[doc], lo - u.docs[doc], hi - lo)]
                live, cuts = np.unique((cols[0] >> U64(32)) * U64(parts) >> U64(32), return_index=True)
                ends = [*cuts[1:], len(order)]
                yield pa.record_batch([pa.array(live.astype(np.int32)), *(pa.array([_planes(c[x:y]) for x, y in zip(cuts, ends)], pa.binary())
                                                                          for c in cols)], names=_names(PIECES))

    return texts(docs).filter("doc_id is not null").mapInArrow(run, PIECES)


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of unit numbers that are near duplicates."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("unit")).distinct()
    asked = reps.join(ids, "unit").groupBy("doc_id").agg(F.collect_list(F.struct("unit", "start", "n_words")).alias("p"))

    def cut(batches):
        for batch in batches:
            for b in slices(batch):
                u = Units(b.column("text"))
                units, sets = [], []
                for d, p in enumerate(b.column("p").to_pylist()):
                    lo = u.docs[d] + np.array([x["start"] for x in p])
                    hi = lo + np.array([x["n_words"] for x in p])
                    ok = hi <= u.docs[d + 1]
                    units += [x["unit"] for x, k in zip(p, ok) if k]
                    sets += [s.tobytes() for s in u.shingles(lo[ok], hi[ok])]
                yield pa.record_batch([pa.array(units, pa.int64()), pa.array(sets, pa.binary())], names=["unit", "s"])

    cutouts = scratch.stored(texts(docs).join(asked, "doc_id").select("text", "p").mapInArrow(cut, "unit long, s binary")
                             .dropDuplicates(["unit"]), "cutouts")
    one = cutouts.select(F.col("unit").alias("a"), F.col("s").alias("sa"))
    two = cutouts.select(F.col("unit").alias("b"), F.col("s").alias("sb"))

    def run(batches):
        for b in batches:
            ok = [linked(np.frombuffer(x, U64), np.frombuffer(y, U64)) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return (pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"))


def paragraph_classes(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """Paragraphs in classes of two or more: doc_id, start, n_words, keep_doc_id, keep_start."""
    bands, rows = tune(similarity, recall)
    scratch = Scratch(docs.sparkSession)
    units = scratch.stored(paragraph_units(docs, bands, rows).withColumn("unit", F.monotonically_increasing_id()), "paragraphs")
    place = F.struct("doc_id", "start", "unit")
    classes = units.groupBy("digest", "digest2").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = scratch.stored(classes.select("digest", "digest2", "n", F.col("rep.unit").alias("unit")), "classes")
    rep_units = units.join(reps.select("unit"), "unit", "left_semi")
    buckets = rep_units.select("unit", F.explode("bands").alias("sig"))
    w = Window.partitionBy("sig")
    buckets = scratch.stored(buckets.withColumn("pivot", F.min("unit").over(w)).withColumn("top", F.max("unit").over(w))
                             .filter("pivot < top").select("sig", "unit", "pivot"), "buckets")
    info = rep_units.select(F.col("unit").alias("doc_id"), "n_shingles", "sketch")
    pairs = buckets.select(F.col("pivot").alias("a"), F.col("unit").alias("b")).filter("a < b").distinct()
    pairs = scratch.stored(plausible(info, pairs).select("a", "b"), "pairs")
    links = scratch.stored(_verified(docs, rep_units.select("unit", "doc_id", "start", "n_words"), pairs, scratch), "links1")
    comps = scratch.stored(connected_components(links), "components1")
    # buckets that still hold several components
    named = buckets.join(comps.select(F.col("id").alias("unit"), F.col("component_id").alias("c")), "unit", "left")
    named = named.withColumn("c", F.coalesce("c", "unit")).select("sig", "unit", "c")
    mixed = named.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count(F.lit(1)).alias("n"),
                                     F.min("unit").alias("head"))
    left = scratch.stored(named.join(mixed.filter("lo < hi").select("sig", "n", "head"), "sig"), "mixed")
    few = left.filter(F.col("n") <= FEW)
    other = few.select("sig", F.col("unit").alias("unit2"), F.col("c").alias("c2"))
    more = few.join(other, "sig").filter("c != c2 and unit < unit2").select(F.col("unit").alias("a"), F.col("unit2").alias("b")).distinct()
    crowd = scratch.stored(left.filter(F.col("n") > FEW).select("head", F.col("unit").alias("doc_id")).distinct(), "crowd")
    more = plausible(info, more).select("a", "b").unionByName(_in_blocks(info, crowd, comps)).distinct()
    more = scratch.stored(more.join(pairs, ["a", "b"], "left_anti"), "more_pairs")
    links = links.unionByName(_verified(docs, rep_units.select("unit", "doc_id", "start", "n_words"), more, scratch))
    comps = connected_components(scratch.stored(links, "links2"))
    # classes of all paragraphs
    group = (reps.join(comps.select(F.col("id").alias("unit"), F.col("component_id").alias("c")), "unit", "left")
             .filter("n > 1 or c is not null").select("digest", "digest2", F.coalesce("c", "unit").alias("class")))
    members = stored(units.drop("bands", "sketch").join(group, ["digest", "digest2"]), "members")
    scratch.drop()
    keep = members.groupBy("class").agg(F.min(F.struct("doc_id", "start", "unit")).alias("k"))
    return members.join(keep, "class").select(
        "doc_id", "start", "n_words", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.start").alias("keep_start"),
        (F.col("unit") != F.col("k.unit")).alias("removed"))


def _equal_pieces(runs: pa.Table) -> pa.Table:
    """Pieces of one part that stand in two places or more, with the smallest place."""
    one, two, doc, start, n = (np.concatenate([_from_planes(x) for x in runs.column(c).to_pylist()]) for c in _names(PIECES)[1:])
    doc, start, n = doc.view(np.int64), start.view(np.int64), n.view(np.int64)
    order = np.lexsort((start, doc, two, one))
    one, two, doc, start, n = (x[order] for x in (one, two, doc, start, n))
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(one)) - 1
    group = np.cumsum(new) - 1
    keep = ((doc[first] != doc[last]) | (start[first] != start[last]))[group]
    head = first[group][keep]
    doc, start, n, keep_doc, keep_start = doc[keep], start[keep], n[keep], doc[head], start[head]
    return pa.table([pa.array(x) for x in (doc, start, n, keep_doc, keep_start, (doc != keep_doc) | (start != keep_start))], names=_names(PASSAGES))


def piece_classes(docs: DataFrame) -> DataFrame:
    """Equal pieces in two places or more: doc_id, start, n_words, keep_doc_id, keep_start."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return piece_units(docs, parts).groupBy("part").applyInArrow(tidy_group(_equal_pieces), PASSAGES)


SEEDS = "doc_id long, start long, seed long"
RUNS = "doc_id long, start long, seed long, digests array<long>"
PASSAGES = "doc_id long, start long, n_words long, keep_doc_id long, keep_start long, removed boolean"


def seed_units(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for b in slices(batch):
                u = Units(b.column("text"))
                doc, first, _, h = u.seeds()
                yield pa.record_batch([pa.array(b.column("doc_id").to_numpy()[doc]), pa.array(first - u.docs[doc]), pa.array(h.view(np.int64))],
                                      names=_names(SEEDS))

    return texts(docs).filter("doc_id is not null").mapInArrow(run, SEEDS)


def passage_classes(docs: DataFrame) -> DataFrame:
    """Passages in two places or more: doc_id, start, n_words, keep_doc_id, keep_start."""
    seeds = stored(seed_units(docs), "seeds")
    place = F.struct("doc_id", "start")
    often = seeds.groupBy("seed").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).filter("lo != hi").select("seed")
    asked = seeds.join(often, "seed", "left_semi").groupBy("doc_id").agg(F.collect_set("seed").alias("asked"))

    def windows(batches):
        for batch in batches:
            for b in slices(batch):
                u = Units(b.column("text"))
                doc, first, n, h = u.seeds()
                wanted = b.column("asked")
                ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
                keep = np.concatenate([np.isin(h[x:y], np.array(wanted[d].as_py(), np.int64).view(U64))
                                       for d, (x, y) in enumerate(zip(ends[:-1], ends[1:]))])
                doc, first, n, h = doc[keep], first[keep], n[keep], h[keep]
                if not len(doc):
                    continue
                at = np.concatenate([[0], np.cumsum(n)])
                lo = np.arange(at[-1]) + np.repeat(first - at[:-1], n)
                digest = u.digests(lo, lo + PASSAGE, (1,))[0].view(np.int64)
                yield pa.record_batch([pa.array(b.column("doc_id").to_numpy()[doc]), pa.array(first - u.docs[doc]), pa.array(h.view(np.int64)),
                                       pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(digest))], names=_names(RUNS))

    runs = texts(docs).join(asked, "doc_id").mapInArrow(windows, RUNS)
    # a seed's windows are compared where the seed lies: its runs are moved whole
    rows = runs.repartition("seed").select("doc_id", "start", "seed", F.posexplode("digests").alias("k", "digest"))
    here = F.struct("doc_id", (F.col("start") + F.col("k")).alias("start"))
    w = Window.partitionBy("seed", "digest")
    rows = rows.withColumn("keep", F.min(here).over(w)).withColumn("last", F.max(here).over(w)).filter("keep != last")
    shifts = (rows.groupBy("seed", "doc_id", "start", F.col("keep.doc_id").alias("keep_doc_id"),
                           (F.col("keep.start") - F.col("start") - F.col("k")).alias("shift"))
              .agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")))  # a seed has at most PASSAGE - SEED + 1 windows in a run
    parts = shifts.groupBy("doc_id", "keep_doc_id", "shift").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))

    def join(batches):
        for b in batches:
            lists = b.column("starts")
            own = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
            masks = b.column("masks").flatten().to_numpy()
            row, k = np.nonzero((masks[:, None] >> np.arange(PASSAGE - SEED + 1)) & 1)
            own, start = own[row], lists.flatten().to_numpy()[row] + k
            order = np.lexsort((start, own))
            own, start = own[order], start[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(own))[:len(head)] - 1
            own, start, end = own[head], start[head], start[tail] + PASSAGE
            doc, keep, shift = (b.column(c).to_numpy()[own] for c in ("doc_id", "keep_doc_id", "shift"))
            cols = [doc, start, end - start, keep, start + shift, (doc != keep) | (shift != 0)]
            yield pa.record_batch([pa.array(c) for c in cols], names=_names(PASSAGES))

    return parts.mapInArrow(join, PASSAGES)


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """All repeated units.

    doc_id, unit ('paragraph', 'piece' or 'passage'), start and n_words (in words of the document), keep_doc_id and keep_start (the
    unit of the class that stays), removed.
    """
    cols = ["doc_id", "unit", "start", "n_words", "keep_doc_id", "keep_start", "removed"]
    one = paragraph_classes(docs).withColumn("unit", F.lit("paragraph"))
    two = piece_classes(docs).withColumn("unit", F.lit("piece"))
    three = passage_classes(docs).withColumn("unit", F.lit("passage"))
    return one.select(cols).unionByName(two.select(cols)).unionByName(three.select(cols))
