r"""Language-model scores by deleted interpolation.

Tokens: A-Z lower-cased words ``[^\x20\x09-\x0D]+`` of the text, then one end.  The model mixes three
maximum-likelihood estimates, with weights that depend on how often the context was seen
(buckets of powers of two of the context's count; bucket 0: never):

    p(w | v) = l2(b) c(v, w) / c(v) + l1(b) c(w) / N + l0(b) (c(w) + 1) / (N + V + 1)

Counts cover all training documents.  The weights are learned by expectation-maximisation on a held-out
part of the training documents whose own counts are deleted first, so the events being explained were
not counted.  The last term is a proper distribution over the V known tokens and one unknown
class, so every text has a probability.

Work.  Documents are dealt into blocks of bounded size by a hash of their id and text.  A block counts its distinct
words and word pairs and sends the sorted hashes with their counts as packed runs, one per part of the
hash range; a part adds the blocks' counts and answers each block with the totals in the block's own
order.  A block then scores its documents with exactly the totals it needs.  No table of the corpus is
broadcast or collected; the answers are what scoring gathers and grow with the corpus.  A frequent
pair is one entry per block.  The driver sees N, V and a histogram of held-out events whose size
is bounded by its bins.

Null text is the end alone.  Rows that share an id are scored each.  Without training documents every
token has the base probability.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_fold, hash_strings, mix64, split_words, stored, texts, tidy_group

BLOCK_BYTES = 8_000_000    # text of one block
PART_TOKENS = 6_000_000    # text behind one part of the hash range, in bytes
HELD_OUT_FOLD = 3          # training documents with this remainder teach the weights
SLICE_TOKENS = 200_000     # tokens of a block that are looked up and scored at a time
OCTAVE = 4                 # bins per factor of two in the histogram
END, BEGIN = U64(0x5E2D58D8B3BCDF1A), U64(0x1F83D9ABFB41BD6B)

RUNS = "part int, block int, kind int, teaches boolean, keys binary, counts binary"
ANSWERS = "part int, block int, kind int, totals binary, deleted binary, types long, tokens long, types_left long, tokens_left long"
SCORES = ("doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _planes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _from_planes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


class Events:
    """Tokens of a block: word and pair keys of every token, and where documents begin."""

    def __init__(self, text: pa.ChunkedArray):
        text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
        codes, offsets, words = split_words(text)
        n = np.diff(offsets)
        at = offsets + np.arange(len(offsets))         # one end after every text
        w = np.full(at[-1], END, U64)
        inside = np.ones(at[-1], bool)
        inside[at[1:] - 1] = False
        w[inside] = hash_strings(words, seed=5)[codes] if len(codes) else np.zeros(0, U64)
        before = np.empty_like(w)
        before[1:] = w[:-1]
        before[at[:-1]] = BEGIN
        self.offsets, self.word, self.before = at, w, before
        self.pair = mix64(before * U64(0x9E3779B97F4A7C15) + w)

    def slices(self):
        """(first text, text after the last) of runs of texts with about SLICE_TOKENS tokens (one text at least)."""
        part = self.offsets[:-1] // SLICE_TOKENS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        return [x for x in zip(edges, edges[1:]) if x[1] > x[0]]


def _counted(keys: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is among the chosen."""
    distinct = np.unique(keys)
    count = np.zeros(len(distinct), np.int64)
    k, n = np.unique(keys[chosen], return_counts=True)
    count[np.searchsorted(distinct, k)] = n
    return distinct, count


def _count_block(parts: int):
    def run(table: pa.Table) -> pa.Table:
        e = Events(table.column("text"))
        train = np.repeat(table.column("train").to_numpy(), np.diff(e.offsets))
        block, teaches = table.column("block")[0].as_py(), table.column("teaches")[0].as_py()
        rows = []
        for kind, keys in ((1, e.word), (2, e.pair)):
            distinct, count = _counted(keys, train)
            if kind == 1:  # the context that begins a text is counted like a word
                distinct = np.append(distinct, BEGIN)
                count = np.append(count, int(table.column("train").to_numpy().sum()))
                order = np.argsort(distinct)
                distinct, count = distinct[order], count[order]
            part = ((distinct >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64)
            first = np.flatnonzero(np.diff(part, prepend=-1))  # the parts present, not all
            for lo, hi in zip(first, np.append(first[1:], len(part))):
                s = slice(lo, hi)
                rows.append((int(part[lo]), block, kind, teaches, _planes(distinct[s], "<u8"), _planes(count[s], "<u4")))
        types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                        names=["part", "block", "kind", "teaches", "keys", "counts"])

    return run


def _add_part(table: pa.Table) -> pa.Table:
    """Totals of one part, dealt back to its blocks; sizes ride on the first answer of the part."""
    rows = []
    for kind in (1, 2):
        own = table.filter(pa.compute.equal(table.column("kind"), kind))
        if not own.num_rows:
            continue
        keys = [_from_planes(b, "<u8") for b in own.column("keys").to_pylist()]
        counts = [_from_planes(b, "<u4").astype(np.int64) for b in own.column("counts").to_pylist()]
        teaches = np.array(own.column("teaches").to_pylist())
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        flat = np.concatenate(counts)
        total = np.bincount(where, flat, len(distinct)).astype(np.int64)
        teaching = np.repeat(teaches, [len(k) for k in keys])
        left = total - np.bincount(where, flat * teaching, len(distinct)).astype(np.int64)
        word = (distinct != BEGIN) & (kind == 1)
        sizes = (int(((total > 0) & word).sum()), int(total[word].sum()), int(((left > 0) & word).sum()), int(left[word].sum()))
        ends = np.cumsum([0] + [len(k) for k in keys])
        part = own.column("part")[0].as_py()
        for j, (block, teach) in enumerate(zip(own.column("block").to_pylist(), teaches)):
            at = where[ends[j]:ends[j + 1]]
            rows.append((part, block, kind, _planes(total[at], "<u8"), _planes(left[at], "<u8") if teach else None,
                         *(sizes if j == 0 else (0, 0, 0, 0))))
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()] + [pa.int64()] * 4
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)],
                    names=["part", "block", "kind", "totals", "deleted", "types", "tokens", "types_left", "tokens_left"])


class Known:
    """Totals a block was answered, by key."""

    def __init__(self, e: Events, answers: pa.Table, column: str):
        order = np.lexsort((answers.column("part").to_numpy(), answers.column("kind").to_numpy()))
        kinds = answers.column("kind").to_numpy()[order]
        raw = answers.column(column).to_pylist()
        got = {k: np.concatenate([_from_planes(raw[i], "<u8") for i in order[kinds == k]]).astype(np.int64) for k in (1, 2)}
        self.pair = got[2][np.searchsorted(np.unique(e.pair), e.pair)]
        words = np.unique(np.append(e.word, BEGIN))
        self.word = got[1][np.searchsorted(words, e.word)]
        self.context = got[1][np.searchsorted(words, e.before)]

    def totals(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Totals of pair, word and context of the tokens lo to hi."""
        return self.pair[lo:hi], self.word[lo:hi], self.context[lo:hi]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + the power of two of its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def _parts_of(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: int, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
    return p2, word / max(n, 1), (word + 1.0) / (n + v + 1.0)


def learn_weights(bucket: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (l2, l1, l0) per bucket by expectation-maximisation; p has the three estimates of each event."""
    size = 64
    lam = np.full((size, 3), 1 / 3)
    lam[0] = (0.0, 0.5, 0.5)
    for _ in range(rounds):
        share = lam[bucket] * p
        share *= (count / np.maximum(share.sum(1), 1e-300))[:, None]
        got = np.stack([np.bincount(bucket, share[:, j], size) for j in range(3)], 1)
        total = got.sum(1, keepdims=True)
        lam = np.where(total > 0, got / np.maximum(total, 1e-300), lam)
    return lam * (1 - 1e-6) + np.array([0, 0, 1e-6])  # the last weight never vanishes


def _bin(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * OCTAVE).astype(np.int64), -1)


BINS = 1 << 13  # more than a bin of any estimate: 1e-300 has less than a thousand octaves
HISTOGRAM = "bucket int, b2 int, b1 int, b0 int, n long"


def _histogram(n: int, v: int):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(("bucket", "b2", "b1", "b0", "n"), [pa.int32()] * 4 + [pa.int64()])})
        e = Events(docs.column("text"))
        k = Known(e, answers, "deleted")
        codes, counts = [], []
        for i, j in e.slices():
            pair, word, context = k.totals(e.offsets[i], e.offsets[j])
            code = _bucket(context)
            for p in _parts_of(pair, word, context, n, v):
                code = code * BINS + _bin(p) + 1
            own = np.unique(code, return_counts=True)
            codes.append(own[0])
            counts.append(own[1])
        rows, at = np.unique(np.concatenate(codes), return_inverse=True)
        count = np.bincount(at, np.concatenate(counts), len(rows)).astype(np.int64)
        columns = [rows // BINS ** 3, *(rows // BINS ** j % BINS - 1 for j in (2, 1, 0))]
        return pa.table([pa.array(c.astype(np.int32)) for c in columns] + [pa.array(count)], names=["bucket", "b2", "b1", "b0", "n"])

    return run


def _score(n: int, v: int, weights: np.ndarray):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        if not docs.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, [pa.int64(), pa.bool_()] + [pa.int64()] * 3 + [pa.float64()] * 2)})
        e = Events(docs.column("text"))
        k = Known(e, answers, "totals")
        sums = []
        for i, j in e.slices():
            lo, hi = e.offsets[i], e.offsets[j]
            pair, word, context = k.totals(lo, hi)
            p2, p1, p0 = _parts_of(pair, word, context, n, v)
            lam = weights[_bucket(context)]
            p = lam[:, 0] * p2 + lam[:, 1] * p1 + lam[:, 2] * p0
            add = lambda x, at=e.offsets[i:j] - lo: np.add.reduceat(x, at)  # noqa: E731  every text has its end
            sums.append((add((word > 0).astype(np.int64)), add(np.log10(p0)), add(np.log10(p))))
        known, base, score = (pa.array(np.concatenate(x)) for x in zip(*sums))
        return pa.table([docs.column("doc_id").combine_chunks(), docs.column("held_out").combine_chunks(), pa.array(np.diff(e.offsets)),
                         known, pa.array(np.full(len(e.offsets) - 1, n)), base, score], names=names)

    return run


def score_texts(docs: DataFrame, fold: int = 7, test_fold: int = 2, teach_fold: int = HELD_OUT_FOLD) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    d = texts(docs)
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(32, -(-size // BLOCK_BYTES))
    teach_blocks = max(8, -(-blocks // fold))
    parts = max(32, -(-size // PART_TOKENS))
    r = crc_fold(fold)
    spread = F.xxhash64("doc_id", "text")
    teaches = r == teach_fold
    d = (d.withColumn("held_out", r == test_fold).withColumn("train", r != test_fold).withColumn("teaches", teaches)
         .withColumn("block", F.when(teaches, F.pmod(spread, F.lit(teach_blocks)))
                     .otherwise(F.pmod(spread, F.lit(blocks)) + teach_blocks).cast("int")))
    runs = d.groupBy("block").applyInArrow(tidy_group(_count_block(parts)), RUNS)
    answers = stored(runs.groupBy("part").applyInArrow(tidy_group(_add_part), ANSWERS), "answers")
    s = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("types", "tokens", "types_left", "tokens_left")]).first()

    own = answers.select("block", "part", "kind", "totals", "deleted")
    taught = d.filter("teaches").groupBy("block").cogroup(own.filter(F.col("block") < teach_blocks).groupBy("block"))
    bins = (taught.applyInArrow(tidy_group(_histogram(s["tokens_left"], s["types_left"]), 2), HISTOGRAM)
            .groupBy("bucket", "b2", "b1", "b0").agg(F.sum("n").alias("n"))).toPandas()
    p = np.stack([np.where(bins[c] < 0, 0.0, 2.0 ** (-bins[c].to_numpy() / OCTAVE)) for c in ("b2", "b1", "b0")], 1)
    weights = learn_weights(bins["bucket"].to_numpy(), p, bins["n"].to_numpy().astype(float))
    return (d.groupBy("block").cogroup(own.groupBy("block"))
            .applyInArrow(tidy_group(_score(s["tokens"], s["types"], weights), 2), SCORES))
