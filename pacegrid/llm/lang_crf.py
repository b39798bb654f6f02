r"""Language identification with a linear-chain conditional random field over the words of a text.

Each word with a letter is labelled with a language.  Its scores come from hashed features of its lower-cased
letters (prefixes and suffixes of 1 to 3 bytes, byte n-grams of 2 to 4 with word marks, the whole
word) and from a lexicon (log-odds of the word per language); transitions between the labels of
neighbouring words are learned.  Forward-backward gives every word's distribution over the languages, so
a short or shared word takes the language around it and a text may switch language midway.  A text's language
is the one with the largest expected number of words; its score is that share.

Training.  The classifier is fitted on a bounded sample of labelled documents: ``per_lang`` documents per
language (smallest hashes first come by a threshold on a hash) and ``cuts`` stretches of ``stretch``
words from each.  One half of the stretches gives the lexicon, the other the sequences, which join
stretches of different languages so that transitions inside code-switched text are seen.  The
sample and the fit are on the driver; its size is bounded by these parameters times the number of
languages, whatever the corpus.

Decoding is exact on whole texts.  Words are cut into blocks; all blocks multiply their transition
matrices at once, the blocks of a text are chained, and all blocks run forward and backward at once.

Null text, or text without a letter: ``und`` with score 0.  Without any labelled document every text is
``und``.  Only the text is used to predict.  An empty table gives an empty result.
"""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_fold, hash_strings, mix64, release, slices, split_words, texts, tidy

UND = "und"
PER_LANG = 400
CUTS, STRETCH = 6, 24
DIMS = 1 << 16
BLOCK = 32
ROUNDS = 60
PART = 1_000_000  # bytes of text labelled at once


def letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Codes of the words with a letter, offsets of the texts in them, distinct words (letters, lower-case)."""
    codes, offsets, words = split_words(text)
    plain = pc.replace_substring_regex(pc.utf8_lower(words), r"[^\p{L}]+", "")
    keep = pc.not_equal(plain, "").to_numpy(zero_copy_only=False)
    if not len(codes):
        return codes, offsets, plain
    live = keep[codes]
    return codes[live], np.concatenate([[0], np.cumsum(live)])[offsets], plain


def feature_kinds(words: pa.Array):
    """(feature numbers, their words in ascending order) kind by kind: whole word, n-grams, prefixes, suffixes."""
    n = len(words)
    mask = U64(DIMS - 1)
    yield (mix64(hash_strings(words, seed=9)) & mask).astype(np.int64), np.arange(n)
    raw = pc.binary_join_element_wise(pa.scalar(b"\x02", pa.large_binary()), words.cast(pa.large_binary()),
                                      pa.scalar(b"\x03", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
    size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8, int(size.sum())).astype(U64) + U64(1)
    start = np.concatenate([[0], np.cumsum(size)])
    word = np.repeat(np.arange(n), size)
    place = np.arange(len(data)) - start[:-1][word]
    rest = size[word] - place
    gram = np.zeros(len(data), U64)
    for k in range(1, 5):
        gram[:len(data) - k + 1] += data[k - 1:] << U64(9 * (k - 1))
        inside = rest >= k
        if k >= 2:
            yield (mix64(gram[inside] + U64(k << 40)) & mask).astype(np.int64), word[inside]
        for tag, at in ((1, inside & (place == 1)), (2, inside & (rest == k + 1))):
            if k <= 3:
                yield (mix64(gram[at] + U64((k + 8 * tag) << 44)) & mask).astype(np.int64), word[at]


def word_features(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words, offsets of the words in them)."""
    found, owner = (np.concatenate(x) for x in zip(*feature_kinds(words)))
    counts = np.bincount(owner, minlength=len(words))
    return found[np.argsort(owner, kind="stable")], np.concatenate([[0], np.cumsum(counts)])


class Model:
    """Labels, feature weights (DIMS x L), lexicon (sorted hashes and their log-odds) and transitions."""

    def __init__(self, labels, weights, lex_keys, lex_odds, lex_scale, transitions, first):
        self.labels, self.weights, self.lex_keys, self.lex_odds = labels, weights, lex_keys, lex_odds
        self.lex_scale, self.transitions, self.first = lex_scale, transitions, first

    def lexicon(self, words: pa.Array) -> np.ndarray:
        out = np.zeros((len(words), len(self.labels)))
        if len(self.lex_keys) and len(words):
            h = hash_strings(words, seed=4)
            at = np.minimum(np.searchsorted(self.lex_keys, h), len(self.lex_keys) - 1)
            hit = self.lex_keys[at] == h
            out[hit] = self.lex_odds[at[hit]]
        return out

    def emissions(self, words: pa.Array) -> np.ndarray:
        """Scores of the distinct words, L each."""
        if not len(words):
            return np.zeros((0, len(self.labels)))
        out = self.lex_scale * self.lexicon(words)
        by_label = np.ascontiguousarray(self.weights.T)
        for feats, owner in feature_kinds(words):
            if len(feats):
                first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                for j, weights in enumerate(by_label):
                    out[owner[first], j] += np.add.reduceat(weights[feats], first)
        return out


def _blocks(offsets: np.ndarray):
    """Blocks of BLOCK words: (first word, words, text) of each, texts' blocks in order."""
    n = np.diff(offsets)
    per = -(-n // BLOCK)
    text = np.repeat(np.arange(len(n)), per)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    first = offsets[:-1][text] + nth * BLOCK
    return first, np.minimum(BLOCK, offsets[1:][text] - first), text, nth


def posteriors(scores: np.ndarray, offsets: np.ndarray, transitions: np.ndarray, first_scores: np.ndarray) -> np.ndarray:
    """Expected number of words per text and label, by exact forward-backward.  scores: one row per word.

    Arrays hold labels first and blocks last, the longest blocks first: the blocks that still have a word k are
    a prefix, and every step is one product of small matrices with a long one.
    """
    L = scores.shape[1]
    out = np.zeros((len(offsets) - 1, L))
    first, size, text, nth = _blocks(offsets)
    if not len(first):
        return out
    order = np.argsort(-size, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first, size, text, nth = first[order], size[order], text[order], nth[order]
    e = np.exp(np.ascontiguousarray(scores.T) - scores.max(1))
    t = np.exp(transitions - transitions.max())
    start = np.exp(first_scores - first_scores.max())[:, None]
    live = np.searchsorted(-size, -np.arange(BLOCK))
    words = [e.take(first[:live[k]] + k, axis=1) for k in range(BLOCK)]
    fore, back = _block_states(e, t, start, first, size, text, place, len(out))
    cur, a = fore, []
    for k in range(BLOCK):
        step = t.T @ cur[:, :live[k]]
        if k == 0:
            # the first word has no word before it: the start scores stand for its transition
            step = np.where(nth == 0, start, step)
        cur = step * words[k]
        if k % 4 == 3:
            cur /= cur.max(0)
        a.append(cur)
    total = np.zeros((L, len(first)))
    for k in range(BLOCK - 1, -1, -1):
        n = live[k]
        post = a[k] * back[:, :n]
        total[:, :n] += post / np.maximum(post.sum(0), 1e-300)
        x = t @ (back[:, :n] * words[k])
        back[:, :n] = x / x.max(0) if k % 4 == 0 else x
    for j in range(L):
        out[:, j] = np.bincount(text, total[j], len(out))
    return out


def _block_states(e, t, start, first, size, text, place, n_texts):
    """Forward state before each block and backward state after it (ones where a text begins and ends)."""
    L = len(t)
    fore, back = np.ones((L, len(first))), np.ones((L, len(first)))
    per = np.bincount(text, minlength=n_texts)
    chained = np.flatnonzero(per[text] > 1)
    if not len(chained):
        return fore, back
    # matrices of the blocks: entry i, j = weight of leaving the block in j when entered from i
    m = np.repeat(np.eye(L)[:, :, None], len(chained), axis=2)
    live = np.searchsorted(-size[chained], -np.arange(BLOCK))
    for k in range(BLOCK):
        x = np.matmul(t.T, m[:, :, :live[k]]) * e.take(first[chained[:live[k]]] + k, axis=1)
        m[:, :, :live[k]] = x / x.max((0, 1)) if k % 4 == 3 else x
    m = np.ascontiguousarray((m / m.max((0, 1))).transpose(2, 0, 1))
    row = np.zeros(len(first), np.int64)
    row[chained] = np.arange(len(chained))
    # texts side by side, those with the most blocks first
    head = np.cumsum(per) - per
    texts_in = np.flatnonzero(per > 1)
    texts_in = texts_in[np.argsort(-per[texts_in], kind="stable")]
    depth = per[texts_in]
    at = place[head[texts_in]]
    f = start * e.take(first[at], axis=1)
    for k in range(1, BLOCK):  # the first of several blocks is full
        f = (t.T @ f) * e.take(first[at] + k, axis=1)
        f /= f.max(0)
    f = np.ascontiguousarray(f.T)
    g = np.ones((len(texts_in), L))
    counts = np.searchsorted(-depth, -np.arange(depth[0]))
    for k in range(1, int(depth[0])):
        b = place[head[texts_in[:counts[k]]] + k]
        fore[:, b] = f[:counts[k]].T
        x = np.matmul(f[:counts[k], None, :], m[row[b]])[:, 0, :]
        f[:counts[k]] = x / x.max(1, keepdims=True)
    for k in range(int(depth[0]) - 1, -1, -1):
        b = place[head[texts_in[:counts[k]]] + k]
        back[:, b] = g[:counts[k]].T
        x = np.matmul(m[row[b]], g[:counts[k], :, None])[:, :, 0]
        g[:counts[k]] = x / x.max(1, keepdims=True)
    return fore, back


# ---- training on the bounded sample ----

def sample(docs: DataFrame, per_lang: int = PER_LANG, cuts: int = CUTS, stretch: int = STRETCH) -> list[tuple[str, str]]:
    """(language, stretch of words) of the sampled labelled documents; about per_lang * cuts rows per language."""
    d = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
         .filter(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    if not counts:
        return []
    dice = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "text"), F.lit(1 << 30))
    take = F.lit(0).cast("long")
    for lang, n in sorted(counts.items()):
        take = F.when(F.col("lang") == lang, F.lit(min(1 << 30, (per_lang << 30) // n + 1))).otherwise(take)

    def run(batches):
        for b in batches:
            langs, parts = [], []
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                codes, _, words = letters(pa.array([text], pa.string()))
                own = [words[i].as_py() for i in codes] if len(codes) <= cuts * stretch else None
                for c in range(cuts):
                    if own is not None:
                        part = own[c * stretch:(c + 1) * stretch]
                    else:  # evenly over the whole text
                        at = c * (len(codes) - stretch) // (cuts - 1)
                        part = words.take(pa.array(codes[at:at + stretch])).to_pylist()
                    if part:
                        langs.append(lang)
                        parts.append(" ".join(part))
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(parts, pa.string())], names=["lang", "part"])

    rows = d.filter(dice < take).select("text", "lang").mapInArrow(tidy(run), "lang string, part string").collect()
    return sorted((r["lang"], r["part"]) for r in rows)


def _lexicon(parts: list[tuple[str, list[str]]], labels: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = pa.array([w for _, p in parts for w in p], pa.large_string()).dictionary_encode()
    codes = words.indices.to_numpy().astype(np.int64)
    lab = np.repeat([labels.index(x) for x, _ in parts], [len(p) for _, p in parts]).astype(np.int64)
    n = np.zeros((len(words.dictionary), len(labels)))
    np.add.at(n, (codes, lab), 1)
    share = (n + 0.5) / (n.sum(0) + 0.5 * len(n))
    odds = np.log(share) - np.log(share).mean(1, keepdims=True)
    keys = hash_strings(words.dictionary, seed=4)
    order = np.argsort(keys)
    return keys[order], odds[order]


def _summed(weights: np.ndarray, feats: np.ndarray, offsets: np.ndarray, most: int = 4096) -> np.ndarray:
    """Sum of the weights of each word's features, ``most`` words at a time."""
    out = np.empty((len(offsets) - 1, weights.shape[1]))
    for lo in range(0, len(out), most):
        cut = offsets[lo:lo + most + 1]
        out[lo:lo + most] = np.add.reduceat(weights[feats[cut[0]:cut[-1]]], cut[:-1] - cut[0])
    return out


def fit(stretches: list[tuple[str, str]], rounds: int = ROUNDS, seed: int = 11) -> Model:
    """Maximum likelihood with a small penalty, by Adam on all sequences at once."""
    labels = sorted({x for x, _ in stretches})
    L = len(labels)
    rng = np.random.default_rng(seed)
    parts = [(x, p.split(" ")) for x, p in stretches]
    order = rng.permutation(len(parts))
    half = len(parts) // 2 if len(parts) > 1 else len(parts)
    lex_keys, lex_odds = _lexicon([parts[i] for i in order[:half]], labels)
    rest = [parts[i] for i in order[half:]] or parts
    # sequences: stretches cut at random places and joined, so that languages change inside
    pieces = []
    for x, p in rest:
        k = rng.integers(3, 13)
        pieces += [(x, p[i:i + k]) for i in range(0, len(p), k)]
    seqs, i = [], 0
    pieces = [pieces[j] for j in rng.permutation(len(pieces))]
    whole = [[y] for y in rest]
    while i < len(pieces):
        k = int(rng.integers(2, 5))
        seqs.append(pieces[i:i + k])
        i += k
    seqs += whole
    words = [w for s in seqs for _, p in s for w in p]
    gold = np.array([labels.index(x) for s in seqs for x, p in s for _ in p])
    size = np.array([sum(len(p) for _, p in s) for s in seqs])
    d = pa.array(words, pa.large_string()).dictionary_encode()
    codes = d.indices.to_numpy().astype(np.int64)
    feats, offsets = word_features(d.dictionary)
    per = np.diff(offsets)
    model = Model(labels, np.zeros((DIMS, L)), lex_keys, lex_odds, 0.5, np.zeros((L, L)), np.zeros(L))
    lex = model.lexicon(d.dictionary)
    T = int(size.max())
    start = np.cumsum(size) - size
    at = np.minimum(start[:, None] + np.arange(T), len(words) - 1)
    inside = np.arange(T) < size[:, None]
    n = len(words)
    params = [model.weights, np.array([model.lex_scale]), model.transitions, model.first]
    mom = [np.zeros_like(p) for p in params]
    var = [np.zeros_like(p) for p in params]
    gold_at = gold[at]
    for step in range(1, rounds + 1):
        w, scale, t, first = params
        E = (_summed(w, feats, offsets) + scale[0] * lex)[codes]
        e = np.exp(E - E.max(1, keepdims=True))
        tt, ff = np.exp(t), np.exp(first)
        fw = np.zeros((T, len(seqs), L))
        cur = ff * e[at[:, 0]]
        fw[0] = cur / cur.sum(1, keepdims=True)
        for k in range(1, T):
            x = (fw[k - 1] @ tt) * e[at[:, k]]
            fw[k] = np.where(inside[:, k:k + 1], x / x.sum(1, keepdims=True), fw[k - 1])
        grad_E = np.zeros((n, L))
        grad_t = np.zeros((L, L))
        bw = np.ones((len(seqs), L))
        for k in range(T - 1, -1, -1):
            live = inside[:, k]
            post = fw[k] * bw
            post /= post.sum(1, keepdims=True)
            g = post.copy()
            g[np.arange(len(seqs)), gold_at[:, k]] -= 1
            grad_E[at[live, k]] = g[live]
            if k == 0:
                grad_first = g.sum(0)
                break
            m = bw * e[at[:, k]]
            joint = fw[k - 1][live][:, :, None] * tt * m[live][:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            grad_t += joint.sum(0)
            np.add.at(grad_t, (gold_at[live, k - 1], gold_at[live, k]), -1)
            x = m @ tt.T
            bw = np.where(live[:, None], x / x.sum(1, keepdims=True), bw)
        grad_u = np.stack([np.bincount(codes, grad_E[:, j], len(d.dictionary)) for j in range(L)], 1)
        grad_w = np.stack([np.bincount(feats, np.repeat(grad_u[:, j], per), DIMS) for j in range(L)], 1)
        grads = [grad_w / n * 10 + 1e-5 * w, np.array([(grad_u * lex).sum()]) / n, grad_t / n + 1e-4 * t, grad_first / len(seqs) + 1e-3 * first]
        for p, g, a, b in zip(params, grads, mom, var):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= 0.08 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return Model(labels, params[0].astype(np.float32), lex_keys, lex_odds, float(params[1][0]), params[2], params[3])


def train(docs: DataFrame, per_lang: int = PER_LANG, cuts: int = CUTS, stretch: int = STRETCH) -> Model | None:
    """A model of the labelled rows of ``docs`` (columns doc_id, text, lang); None without any."""
    got = sample(docs, per_lang, cuts, stretch)
    model = fit(got) if got else None
    del got
    gc.collect()
    release()  # the driver's memory of the fit
    return model


# ---- prediction ----

def label_words(model: Model, text: str) -> list[tuple[str, str]]:
    """Most probable language of each word (for code-switched text)."""
    codes, offsets, words = letters(pa.array([text], pa.string()))
    if not len(codes):
        return []
    E = model.emissions(words)[codes]
    singles = posterior_words(E, model.transitions, model.first)
    return [(words[i].as_py(), model.labels[k]) for i, k in zip(codes.tolist(), singles.argmax(1).tolist())]


def posterior_words(scores: np.ndarray, transitions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Plain forward-backward of one sequence (one row per word)."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    t, f = np.exp(transitions), np.exp(first)
    n, L = e.shape
    fw, bw = np.zeros((n, L)), np.ones((n, L))
    fw[0] = f * e[0] / (f * e[0]).sum()
    for k in range(1, n):
        x = (fw[k - 1] @ t) * e[k]
        fw[k] = x / x.sum()
    for k in range(n - 2, -1, -1):
        x = t @ (e[k + 1] * bw[k + 1])
        bw[k] = x / x.sum()
    post = fw * bw
    return post / post.sum(1, keepdims=True)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words, shares map<language, share of the words> of every whole text."""
    schema = "doc_id long, lang_pred string, score double, n_words long, shares map<string, double>"
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: DIMS x languages and the sample's words

    def run(batches):
        model = shared.value
        for batch in batches:
            for b in slices(batch, most=PART):
                n = b.num_rows
                lang, score, words_in, shares = [UND] * n, [0.0] * n, [0] * n, [[] for _ in range(n)]
                if model is not None:
                    codes, offsets, words = letters(b.column("text"))
                    if len(codes):
                        E = model.emissions(words)[codes]
                        expected = posteriors(E, offsets, model.transitions, model.first)
                        size = np.diff(offsets)
                        for i in np.flatnonzero(size).tolist():
                            share = expected[i] / expected[i].sum()
                            k = int(share.argmax())
                            lang[i], score[i], words_in[i] = model.labels[k], float(min(share[k], 1.0)), int(size[i])
                            shares[i] = [(x, float(s)) for x, s in zip(model.labels, share) if s >= 0.01]
                yield pa.record_batch([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                       pa.array(words_in, pa.int64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                                      names=["doc_id", "lang_pred", "score", "n_words", "shares"])

    return texts(docs).mapInArrow(tidy(run), schema)


def language_report(docs: DataFrame) -> DataFrame:
    """The contract of op1: learn from documents outside the held-out fold, predict all."""
    labelled = docs.select("doc_id", "text", "lang").filter(crc_fold(4) != 2)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (identify(held, train(labelled)).withColumn("held_out", crc_fold(4) == 2)
            .select("doc_id", "held_out", "lang_pred", "score", "n_words", "shares"))


def drop_unidentified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents whose text has a language that holds at least ``min_score`` of its words.

    Without any labelled document nothing can be rejected and all stay.
    """
    model = train(docs)
    if model is None:
        return docs
    ok = identify(docs, model).filter((F.col("lang_pred") != UND) & (F.col("score") >= min_score))
    ids = ok.select(F.col("doc_id").alias("_ok")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["_ok"]), "left_semi")
