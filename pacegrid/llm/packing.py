"""Sequence packing by non-negative least squares over length combinations.

1. Tokenise (a public vocabulary file; its path is a parameter), append the end id, cut off whole
   windows; what is left of a document is its tail of 1 to window-1 ids.
2. The histogram of tail lengths (at most window-1 rows, whatever the corpus) goes to the driver.
   Shallow combinations (two or three lengths, drawn from the lengths present, the common ones first)
   that fill a window exactly are the columns of a non-negative least-squares problem; its solution says
   how often each combination is used.  Counts are rounded and never exceed the histogram.
3. The tails left over are packed greedily: laid end to end, longest first, and cut where a window ends,
   so only the very last sequence is padded.

Every tail is numbered within its length (counts per (length, bucket of ids) first, so a length shared
by a third of all documents is spread over the buckets); the number gives its sequence and
offset by the plan, which is a bounded table.  No sequence is gathered anywhere.

Null text is a document of the end id alone; rows that repeat an id are packed as often as they
occur; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, split_words, stored, texts, tidy

WINDOW = 2048
END_ID = 1
COLUMNS = 6_000       # most combinations in the least-squares problem
BUCKET_ROWS = 50_000  # tails numbered in one group

TOKENISED = "doc_id long, row_key long, doc_tokens long, tail_start long, tail long, tail_crc long, full_crc array<long>"


_MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())  # ASCII punctuation
_ALNUM = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


def _pieces(words: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of words, and for each word the codes of its stem and of the marks after it (-1: none).

    ASCII words are lower-cased.  Marks are cut off where an ASCII letter or digit stands before them.
    """
    words = pc.if_else(pc.string_is_ascii(words), pc.ascii_lower(words), words)
    words = words.take(pa.array(np.arange(len(words)))).cast(pa.large_string())
    stems = pc.ascii_rtrim(words, characters=_MARKS)
    kept = pc.binary_length(stems).to_numpy()
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int64)[:len(words) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and ends[-1] else np.zeros(1, np.uint8)
    more = np.diff(ends) - kept
    last = np.minimum(ends[:-1] + np.maximum(kept - 1, 0), len(data) - 1)  # the blank word may stand at the end
    cut = (kept > 0) & (more > 0) & _ALNUM[data[last]]
    more = more[cut]
    to = np.concatenate([[0], np.cumsum(more)])
    at = np.arange(to[-1]) + np.repeat((ends[:-1] + kept)[cut] - to[:-1], more)
    marks = pa.LargeStringArray.from_buffers(len(more), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(data[at].tobytes()))
    both = pa.concat_arrays([pc.if_else(pa.array(cut), stems, words), marks]).dictionary_encode()
    code = both.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    second = np.full(len(words), -1, np.int64)
    second[cut] = code[len(words):]
    return both.dictionary.to_numpy(zero_copy_only=False).tolist(), code[:len(words)], second


class Encoder:
    """Ids of whole texts, from the ids of their distinct words.

    Cutting at ASCII white space is safe: the vocabulary's own splitting never joins text across white
    space, and neither composition nor lower-casing reaches across it.  Cutting before the marks that end a
    word is safe too: a letter or digit and a mark after it are never in one piece of the vocabulary's
    splitting.  Special tokens' strings in a text are ordinary text.
    """

    LIMIT = 1_000_000  # words remembered by one worker

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = self.plain = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        probe = " ".join(chr(c) + "a" + chr(c) for c in range(33, 127) if not chr(c).isupper())
        if self.tok.normalizer is not None and self.tok.normalizer.normalize_str(probe) == probe:
            self.plain = Tokenizer.from_file(path)  # lower-case ASCII needs no normalising
            self.plain.encode_special_tokens = True
            self.plain.normalizer = None
        self.words: dict[str, bytes] = {}

    def _learn(self, words: list[str], tok) -> None:
        """Encode words joined by blanks, and deal the ids out by their place in the joined text."""
        for lo in range(0, len(words), 1000):
            part = words[lo:lo + 1000]
            e = tok.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            ids = np.array(e.ids, "<u2").tobytes()
            at = np.searchsorted(ends, np.array([x for x, _ in e.offsets], np.int64), side="right")
            cuts = (2 * np.searchsorted(at, np.arange(len(part) + 1))).tolist()
            self.words.update(zip(part, [ids[x:y] for x, y in zip(cuts, cuts[1:])]))

    def _ids(self, words: list[str]) -> list[bytes]:
        if len(self.words) > self.LIMIT:
            self.words.clear()
        known = self.words
        own = list(map(known.get, words))
        new = [w for w, x in zip(words, own) if x is None]
        if not new:
            return own
        other = [w for w in new if not w.isascii()]
        # a letter word with one comma or full stop is the word's ids and the mark's ids; composing and lower-casing turn
        # some letters into a letter and a sign, which would join the mark
        marked = [w for w in other if w[-1] in ",." and unicodedata.normalize("NFC", w[:-1]).lower().isalpha()]
        whole = set(other).difference(marked).union(w[:-1] for w in marked if w[:-1] not in known)
        plain = [w for w in new if w.isascii()] + [x for x in ",." if x not in known]
        self._learn(plain, self.plain)
        self._learn(list(whole), self.tok)
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1]]
        return [known[w] if x is None else x for w, x in zip(words, own)]

    def batch(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of the texts in them)."""
        codes, offsets, words = split_words(text, lower=False)
        pieces, stem, mark = _pieces(words)
        own = self._ids(pieces)
        size = np.array([len(x) // 2 for x in own], np.int64) if own else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.frombuffer(b"".join(own), "<u2")
        both = np.stack([stem[codes], mark[codes]], 1).ravel()
        there = both >= 0
        offsets = np.concatenate([[0], np.cumsum(there)])[2 * offsets]
        both = both[there]
        n = size[both]
        ends = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(ends[-1]) + np.repeat(first[both] - ends[:-1], n)
        return flat[take].astype(np.uint32), ends[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder; its words serve all tasks of the worker."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


TOKENISED_NAMES = [x.split()[0] for x in TOKENISED.split(", ")]


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, text and a key of the text, by which rows that repeat an id are told apart."""
    return texts(docs).withColumn("row_key", F.xxhash64("text"))


def tokenised(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per document: its number of ids, its whole windows and its tail."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            for part in slices(b, most=1_000_000):
                flat, at = enc.batch(part.column("text"))
                rows = []
                for i, key, lo, hi in zip(part.column("doc_id").to_pylist(), part.column("row_key").to_pylist(),
                                          at[:-1].tolist(), at[1:].tolist()):
                    e = np.append(flat[lo:hi], np.uint32(end_id))
                    cut = len(e) // window * window
                    tail = e[cut:]
                    rows.append((i, key, len(e), cut, len(tail), _crc(tail) if len(tail) else None,
                                 [_crc(e[s:s + window]) for s in range(0, cut, window)]))
                types = [pa.int64()] * 6 + [pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=TOKENISED_NAMES)

    return _keyed(docs).mapInArrow(tidy(run), TOKENISED)


# ---- the plan, from the histogram alone ----

def combinations(hist: dict[int, int], window: int = WINDOW, most: int = COLUMNS) -> list[tuple[int, ...]]:
    """Exact fills of the window by two or three of the lengths present, the best supplied first."""
    lengths = sorted(hist)
    pairs = [(a, window - a) for a in lengths if a <= window - a and (window - a) in hist]
    pairs = [p for p in pairs if p[0] != p[1] or hist[p[0]] >= 2]
    triples = []
    arr = np.array(lengths, np.int64)
    counts = np.array([hist[x] for x in lengths])
    index = np.full(window + 1, -1)
    index[arr] = np.arange(len(arr))
    for i, a in enumerate(lengths):
        if 3 * a > window:
            break
        b = arr[i:]
        c = window - a - b
        ok = (c >= b)
        b, c = b[ok], c[ok]
        ok = index[c] >= 0
        b, c = b[ok], c[ok]
        supply = np.minimum(np.minimum(counts[i], counts[index[b]]), counts[index[c]])
        triples.extend(zip(supply.tolist(), [a] * len(b), b.tolist(), c.tolist()))
    triples.sort(key=lambda t: (-t[0], t[1:]))
    need = lambda t: all(hist[x] >= t[1:].count(x) for x in t[1:])
    return pairs + [t[1:] for t in triples if need(t)][:max(0, most - len(pairs))]


def nnls(columns: list[tuple[int, ...]], hist: dict[int, int], sweeps: int = 60) -> np.ndarray:
    """Minimise |Ax - h| with x >= 0 by cyclic coordinate descent; A counts the lengths in a combination."""
    left = {k: float(v) for k, v in hist.items()}
    sparse = [[(a, c.count(a)) for a in dict.fromkeys(c)] for c in columns]
    norm = [sum(m * m for _, m in s) for s in sparse]
    x = [0.0] * len(columns)
    for _ in range(sweeps):
        moved = 0.0
        for j, s in enumerate(sparse):
            step = max(-x[j], sum(left[a] * m for a, m in s) / norm[j])
            if step:
                x[j] += step
                for a, m in s:
                    left[a] -= step * m
                moved = max(moved, abs(step))
        if moved < 0.01:
            break
    return np.array(x)


def make_plan(hist: dict[int, int], window: int = WINDOW, most: int = COLUMNS):
    """(slots, leftovers).

    slots: (length, first, n, sequence, stride, offset): the tails of that length numbered from
    ``first`` to ``first + n - 1`` go to ``sequence``, ``sequence + 1`` ... at ``offset``.
    leftovers: (length, first, stream): the rest of a length starts at ``stream`` of the greedy stream.
    """
    columns = combinations(hist, window, most)
    solved = nnls(columns, hist)
    left, used = dict(hist), dict.fromkeys(hist, 0)
    slots, sequence = [], 0
    for j in np.argsort(-solved, kind="stable"):
        combo = columns[j]
        n = min([int(round(solved[j]))] + [left[a] // combo.count(a) for a in combo])
        if n <= 0:
            continue
        offset = 0
        for a in sorted(combo, reverse=True):
            slots.append((a, used[a], n, sequence, offset))
            used[a] += n
            left[a] -= n
            offset += a
        sequence += n
    rest, stream = [], 0
    for a in sorted(hist, reverse=True):
        rest.append((a, used[a], stream))
        stream += a * left[a]
    return slots, rest, sequence, -(-stream // window)


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows plus ``rank`` from 0 within each tail length, whatever the size of a group."""
    buckets = max(1, -(-n_rows // BUCKET_ROWS)) * 4
    r = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(buckets)).cast("int"))
    sizes = r.groupBy("tail", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = (F.sum("_n").over(Window.partitionBy("tail").orderBy("_bucket")
                               .rowsBetween(Window.unboundedPreceding, -1)))
    starts = sizes.withColumn("_start", F.coalesce(before, F.lit(0))).select("tail", "_bucket", "_start")
    place = F.row_number().over(Window.partitionBy("tail", "_bucket").orderBy("doc_id", "row_key"))
    return (r.withColumn("_place", place).join(starts, ["tail", "_bucket"])
            .withColumn("rank", F.col("_start") + F.col("_place") - 1).drop("_bucket", "_place", "_start"))


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, most: int = COLUMNS) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tok = stored(tokenised(docs, vocabulary, window, end_id), "tokenised")
    hist = {int(r["tail"]): int(r["count"]) for r in tok.filter("tail > 0").groupBy("tail").count().collect()}
    slots, rest, n_planned, n_rest = make_plan(hist, window, most)
    base = n_planned + n_rest  # whole windows take the ids from here on
    by_length: dict[int, list] = {}
    for a, first, n, seq, off in slots:
        by_length.setdefault(a, []).append((first, n, seq, off))
    stream = {a: (first, at) for a, first, at in rest}
    arrays = {a: np.array(sorted(v), np.int64) for a, v in by_length.items()}
    plan = spark.sparkContext.broadcast((arrays, stream))  # bounded: at most 3 * COLUMNS slots, `window` lengths

    def place(batches):
        arrays, stream = plan.value
        for b in batches:
            tail = b.column("tail").to_numpy()
            rank = b.column("rank").to_numpy()
            seq = np.zeros(len(tail), np.int64)
            off = np.zeros(len(tail), np.int64)
            planned = np.zeros(len(tail), bool)
            for a in np.unique(tail).tolist():
                at = np.flatnonzero(tail == a)
                r = rank[at]
                first, pos = stream[a]
                inside = r < first
                if inside.any():
                    s = arrays[a]
                    k = np.searchsorted(s[:, 0], r[inside], side="right") - 1
                    seq[at[inside]] = s[k, 2] + r[inside] - s[k, 0]
                    off[at[inside]] = s[k, 3]
                    planned[at[inside]] = True
                p = pos + (r[~inside] - first) * a
                seq[at[~inside]] = n_planned + p // window
                off[at[~inside]] = p % window
            keep = [b.column(c) for c in ("doc_id", "row_key", "doc_tokens", "tail_start", "tail", "tail_crc")]
            yield pa.record_batch(keep + [pa.array(seq), pa.array(off)], names=PLACED_NAMES)

    tails = tok.filter("tail > 0").drop("full_crc")
    placed = numbered(tails, sum(hist.values())).mapInArrow(place, PLACED)
    placed = stored(placed, "placed")
    whole = placed.filter(F.col("offset") + F.col("tail") <= window).select(
        "doc_id", F.col("tail_start").alias("start"), F.col("tail").alias("length"),
        F.col("tail_crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
    cut = placed.filter(F.col("offset") + F.col("tail") > window)
    full = _full_windows(tok, base, window)
    return whole.unionByName(full).unionByName(_cut_pieces(docs, cut, vocabulary, window, end_id))


PLACED = "doc_id long, row_key long, doc_tokens long, tail_start long, tail long, tail_crc long, sequence_id long, offset long"
PLACED_NAMES = [x.split()[0] for x in PLACED.split(", ")]
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _full_windows(tok: DataFrame, base: int, window: int) -> DataFrame:
    """Each whole window is a sequence of its own; ids follow counts per bucket of documents."""
    rows = tok.filter(F.size("full_crc") > 0).withColumn("_n", F.size("full_crc").cast("long"))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "row_key"), F.lit(4096)).cast("int"))
    sizes = rows.groupBy("_bucket").agg(F.sum("_n").alias("_sum"))
    order = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows
    starts = sizes.select("_bucket", F.coalesce(F.sum("_sum").over(order), F.lit(0)).alias("_start"))
    inside = (Window.partitionBy("_bucket").orderBy("doc_id", "row_key")
              .rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(F.broadcast(starts), "_bucket")
    return (rows.select("doc_id", "doc_tokens", (F.col("_start") + F.col("_before") + base).alias("_seq"),
                        F.posexplode("full_crc").alias("_k", "ids_crc32"))
            .select("doc_id", (F.col("_k") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"),
                    "ids_crc32", "doc_tokens", (F.col("_seq") + F.col("_k")).alias("sequence_id"),
                    F.lit(0).cast("long").alias("offset")))


def _cut_pieces(docs: DataFrame, cut: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """The two pieces of each tail that crosses the end of a window; only those texts are read again."""
    d = _keyed(docs)
    once = d.join(cut.select("doc_id", "row_key").distinct(),
                  d["doc_id"].eqNullSafe(cut["doc_id"]) & (d["row_key"] == cut["row_key"]), "left_semi")
    once = once.dropDuplicates(["doc_id", "row_key"]).select(F.col("doc_id").alias("_id"), F.col("row_key").alias("_key"), "text")
    rows = cut.join(once, cut["doc_id"].eqNullSafe(once["_id"]) & (cut["row_key"] == once["_key"]))
    rows = rows.select("doc_id", "text", "doc_tokens", "tail_start", "tail", "sequence_id", "offset")

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out = []
            flat, at = enc.batch(b.column("text"))
            for k, r in enumerate(b.drop_columns(["text"]).to_pylist()):
                e = np.append(flat[at[k]:at[k + 1]], np.uint32(end_id))
                start, first = r["tail_start"], window - r["offset"]
                out.append((r["doc_id"], start, first, _crc(e[start:start + first]), r["doc_tokens"], r["sequence_id"], r["offset"]))
                out.append((r["doc_id"], start + first, r["tail"] - first, _crc(e[start + first:]), r["doc_tokens"], r["sequence_id"] + 1, 0))
            cols = list(zip(*out)) if out else [[]] * 7
            yield pa.record_batch([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in PIECES.split(", ")])

    return rows.mapInArrow(tidy(run), PIECES)
