"""Operators without a SQL form, against brute force on small fixtures."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import components, decontam, deleted_interp, lang_crf, ngram_join, packing, paragraph_minhash, pfp
from pacegrid.llm.common import split_words
from pacegrid.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, comp string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "c") for i, t in rows], DOCS)


def table(spark, name="documents"):
    return {r[0]: r for r in spark.read.parquet(f"{SF}/{name}.parquet").collect()}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if c < "\x80" else c for c in text)) if w]


# ---- substring dedup ----

def brute_spans(texts, length):
    seen = collections.Counter(b[k:k + length] for b in texts for k in range(len(b) - length + 1))
    out = []
    for b in texts:
        m = np.zeros(len(b) + 2, int)
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                m[1 + k:1 + k + length] = 1
        step = np.diff(m)
        out.append(list(zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())))
    return out


def check_spans(spark, texts, length, window):
    got = {r["doc_id"]: r for r in pfp.remove_repeats(docs(spark, list(enumerate(texts))), length, window).collect()}
    raw = [(t or "").encode() for t in texts]
    for i, spans in enumerate(brute_spans(raw, length)):
        assert [(x["lo"], x["hi"]) for x in got[i]["removed"]] == spans
        cut = bytearray(raw[i])
        for lo, hi in reversed(spans):
            del cut[lo:hi]
        assert bytes(got[i]["kept"]) == bytes(cut) and got[i]["n_bytes"] == len(raw[i])


def test_substrings_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rnd.randint(6, 40)) for _ in range(12)]
    texts = [None, "", "x", "a" * 500, "a" * 90, "ab" * 200]
    for _ in range(120):
        texts.append(" ".join(rnd.choice([text(rnd.randint(1, 30)), rnd.choice(shared), rnd.choice(shared)[5:]]) for _ in range(rnd.randint(1, 6))))
    texts += texts[10:20]
    check_spans(spark, texts, 60, 24)


def test_substrings_with_edits(spark):
    rnd = random.Random(5)
    base = [rnd.choice("abcdefgh") for _ in range(900)]
    texts = []
    for _ in range(40):
        t = list(base)
        for _ in range(rnd.randint(0, 12)):
            t[rnd.randrange(len(t))] = rnd.choice("xyz")
        texts.append("".join(t[rnd.randint(0, 300):rnd.randint(500, 900)]))
    check_spans(spark, texts, 50, 24)


def test_substring_query(spark):
    rows = table(spark)
    raw = [(r["text"] or "").encode() for r in rows.values()]
    want = dict(zip(rows, brute_spans(raw, 400)))
    got = {r["doc_id"]: r for r in QUERIES["op3_substring_dedup"](spark, SF).collect()}
    assert {i: (r["n_removed"], r["n_spans"]) for i, r in got.items()} == {
        i: (sum(b - a for a, b in s), len(s)) for i, s in want.items()}


def test_substring_repeated_row_and_empty(spark):
    one = "".join(random.Random(1).choice("abcdefgh ") for _ in range(700))
    got = pfp.substring_report(docs(spark, [(1, one), (1, one), (None, "y" * 10)])).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in got) == [(0, 0), (1, 700), (1, 700)]
    assert pfp.substring_report(docs(spark, [])).count() == 0


# ---- n-gram join ----

def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t or "")
        sets[i] = {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def hard_rows(seed, n):
    """Near copies by edits, shared boilerplate in many documents, short texts, copies."""
    rnd = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    text = lambda k: [rnd.choice(vocabulary) for _ in range(k)]
    boiler = text(60)
    bases = [text(rnd.choice([3, 6, 9, 14, 25, 60, 130])) for _ in range(14)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two")]
    for i in range(6, n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.7 else text(rnd.randint(1, 40))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if rnd.random() < 0.5:
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            else:
                w.insert(rnd.randrange(len(w) + 1), rnd.choice(vocabulary))
        if rnd.random() < 0.5:
            w = w + boiler
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed,per_segment,few", [(1, 2, 16), (2, 2, 1), (3, 5, 1)])
def test_components_against_brute_force(spark, monkeypatch, seed, per_segment, few):
    monkeypatch.setattr(ngram_join, "FEW", few)  # 1: every bucket of step 3 is compared in blocks
    rows = hard_rows(seed, 260)
    comps, info = ngram_join.links_and_sizes(docs(spark, rows), per_segment)
    size = {r["doc_id"]: r["n_shingles"] for r in info.collect()}
    comp = {r["id"]: r["component_id"] for r in comps.collect()}
    assert {i: (size[i], comp.get(i, i)) for i in size} == brute_components(rows)


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(9)
    for n in (1, 4, 5, 40, 64, 65, 700):
        for change in (0, 1, n // 10, n // 9, n // 5, n):
            a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[change:], rng.integers(0, 2 ** 63, rng.integers(0, change + 1), dtype=np.uint64)]))
            x, y = (ngram_join.sketches(s, np.array([0, len(s)]))[0] for s in (a, b))
            if ngram_join.linked(a, b):
                assert ngram_join.may_link(len(a), x, len(b), y)


def test_components_query(spark):
    want = brute_components([(i, r["text"]) for i, r in table(spark).items()])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op6_ngram_join"](spark, SF).collect()}
    assert got == want


def test_components_edges(spark):
    one = " ".join(f"x{k}" for k in range(30))
    d = docs(spark, [(7, one), (7, one), (9, one + " end"), (None, one), (8, None)])
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in ngram_join.ngram_components(d).collect())
    assert got == [(0, 0), (7, 7), (7, 7), (8, 8), (9, 7)]
    kept = ngram_join.drop_linked(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 7, 7, 8]
    assert ngram_join.ngram_components(docs(spark, [])).count() == 0


def test_connected_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(5, 5), (900, 5)]
    got = {r["id"]: r["component_id"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_take_few_tasks_for_few_links(spark):
    """The driver keeps an account of every task: few links must not become a task a shuffle partition at every step."""
    names = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in names}
    edges = [(10 * i + j, 10 * i + j + 1) for i in range(20) for j in range(5)] + [(1000, 1000 + j) for j in range(1, 50)]
    group = "components-tasks"
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup(group, group)
        got = {r["id"]: r["component_id"] for r in components.connected_components(
            spark.createDataFrame(edges, "a long, b long").coalesce(1)).coalesce(1).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {x: 1000 if x >= 1000 else x // 10 * 10 for e in edges for x in e}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    infos = [x for x in map(tracker.getStageInfo, stages) if x is not None]
    tasks = sum(x.numCompletedTasks for x in infos)
    assert infos and tasks < 2000  # 4326 when every step had a task a partition


def test_words_are_summed_in_blocks_of_words():
    words = pa.array(["a", "beta", "gamma", "delta", "of", "the"], pa.large_string())
    feats, offsets = lang_crf.word_features(words)
    weights = np.random.default_rng(5).normal(size=(lang_crf.DIMS, 3))
    want = np.add.reduceat(weights[feats], offsets[:-1])
    for most in (1, 4, 6, 100):
        assert np.array_equal(lang_crf._summed(weights, feats, offsets, most), want)


# ---- decontamination ----

def test_decontamination_tolerates_substitutions(spark):
    rnd = random.Random(4)
    vocabulary = [f"v{k}" for k in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(rnd.randint(20, 60)) for _ in range(30)] + [text(7), text(3), []]
    rows, want = [], set()
    for i in range(200):
        w = text(rnd.randint(0, 200))
        if i % 2:
            k = i // 2 % 31
            own = list(items[k])
            for x in range(3, len(own), 9) if k < 30 else ():
                own[x] = "changed"
            at = rnd.randint(0, len(w))
            w = w[:at] + [x.upper() + "," for x in own] + w[at:]
            want.add((i, k))
        rows.append((i, " ".join(w)))
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)] + [(99, None)], "item_id long, text string")
    got = decontam.contamination(docs(spark, rows + [(None, None), (500, "")]), b).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert all(r["n_equal"] >= 0.8 * r["n_tokens"] and r["n_tokens"] >= min(13, r["item_tokens"]) for r in got)
    clean = decontam.drop_contaminated(docs(spark, rows), b)
    assert {r["doc_id"] for r in clean.collect()} == set(range(0, 200, 2))
    assert decontam.contamination(docs(spark, []), b).count() == 0
    assert decontam.contamination(docs(spark, rows), b.limit(0)).count() == 0


def test_long_items_are_verified_whole(spark):
    """520 of 600 tokens equal, the 80 changed ones in a row: the run is the whole item, beyond any fixed margin."""
    item = [f"i{k}" for k in range(600)]
    copy = item[:260] + [f"n{k}" for k in range(80)] + item[340:]
    b = spark.createDataFrame([(7, " ".join(item)), (8, "short item of five tokens")], "item_id long, text string")
    rows = [(1, " ".join(["x"] * 30 + copy + ["y"] * 30)), (2, " ".join(item[100:113])), (3, "short item of five tokens")]
    got = {(r["doc_id"], r["item_id"]): (r["doc_start"], r["item_start"], r["n_tokens"], r["n_equal"])
           for r in decontam.contamination(docs(spark, rows), b).collect()}
    assert got == {(1, 7): (30, 0, 600, 520), (2, 7): (0, 100, 13, 13), (3, 8): (0, 0, 5, 5)}


def test_masks_hit_every_allowed_pattern():
    for n in range(10, 26):
        changed = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(n), n // 5)])
        hit = np.zeros(len(changed), bool)
        for m in decontam.MASKS:
            bits = sum(1 << i for i, b in enumerate(m) if b == "1")
            for k in range(n - len(m) + 1):
                hit |= changed & (bits << k) == 0
        assert hit.all(), n


def test_decontamination_at_exactly_the_share(spark):
    """Every placement of the allowed substitutions on whole items, and a sample of them inside longer ones."""
    rnd = random.Random(14)
    sizes = [7, 10, 11, 12, 13, 15, 20, 40, 60]
    items = [[f"i{k}_{j}" for j in range(n)] for k, n in enumerate(sizes)]
    rows, want = [], set()
    for k, n in enumerate(sizes):
        run = min(n, rnd.choice([13, 15]) if n > 20 else n)
        for most in (run // 5, run // 5 + 1):
            every = list(itertools.combinations(range(run), most))
            for c in every if len(every) <= 500 else rnd.sample(every, 300):
                at = rnd.randint(0, n - run)
                own = items[k][at:at + run]
                for j in c:
                    own[j] = "changed"
                i = len(rows)
                rows.append((i, " ".join(["before"] * rnd.randint(0, 3) + own + ["after"] * rnd.randint(0, 3))))
                # by brute force: the whole item, or a run of 13 tokens or more, with 80 % equal (items under 10 equal)
                same = [x != "changed" for x in own]
                least, share = (n, 10) if n < 10 else (min(13, n), 8)
                if any(10 * sum(same[x:y]) >= share * (y - x) for x in range(run) for y in range(x + least, run + 1)):
                    want.add((i, k))
    b = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contamination(docs(spark, rows), b).collect()} == want


def test_decontamination_query_finds_copies(spark):
    items = table(spark, "benchmark")
    want = {(i, k) for i, r in table(spark).items() for k, b in items.items() if b["text"] in (r["text"] or "")}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op2_decontaminate"](spark, SF).collect()}
    assert want and want <= got


@pytest.mark.parametrize("same,want", [([1] * 13, (0, 13)), ([1] * 12, None), ([0, 0] + [1] * 10 + [0] + [1] * 10 + [0] * 9, (0, 25)), ([0] * 40, None)])
def test_overlap(same, want):
    got = decontam.overlap(np.array(same, bool), 13, 0.8)
    assert (got and got[:2]) == want


# ---- paragraphs ----

def test_paragraphs_and_pieces(spark):
    rnd = random.Random(6)
    vocabulary = [f"p{k}" for k in range(2000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows, line, passage = [], text(60), text(55)
    for i in range(40):
        parts = [" ".join(text(rnd.randint(5, 80))) for _ in range(3)]
        if i % 4 == 0:
            own = list(line)
            own[0], own[-1] = f"a{i}", f"b{i}"
            parts.insert(1, " ".join(own))
        if i % 4 == 1:
            w = text(40)
            parts.append(" ".join(w[:20] + passage + w[20:]))
        rows.append((i, "\n".join(parts)))
    got = paragraph_minhash.repeated_paragraphs(docs(spark, rows + [(100, None), (None, "x"), (101, "")])).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r["unit"]].add((r["doc_id"], r["keep_doc_id"], r["removed"]))
    assert by["paragraph"] == {(i, 0, i != 0) for i in range(0, 40, 4)}
    assert {x[0] for x in by["piece"]} >= set(range(1, 40, 4))
    assert {x[0] for u in by.values() for x in u} <= {i for i in range(40) if i % 4 < 2}
    assert paragraph_minhash.repeated_paragraphs(docs(spark, [])).count() == 0


def brute_passages(texts, size):
    """Maximal runs of windows with the same shift to the first place of their words."""
    first, last = {}, {}
    places = [(i, k, tuple(w[k:k + size])) for i, w in sorted(texts.items()) for k in range(len(w) - size + 1)]
    for i, k, g in places:
        first.setdefault(g, (i, k))
        last[g] = (i, k)
    seen = collections.defaultdict(set)
    for i, k, g in places:
        if first[g] != last[g]:
            seen[i, first[g][0], first[g][1] - k].add(k)
    out = set()
    for (i, j, shift), own in seen.items():
        for k in own:
            if k - 1 not in own:
                end = k
                while end in own:
                    end += 1
                out.add((i, k, end - k + size - 1, j, k + shift, (i, 0) != (j, shift)))
    return out


def test_passages_across_lines_against_brute_force(spark):
    rnd = random.Random(12)
    vocabulary = [f"q{k}" for k in range(3000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]

    def wrapped(w):
        out = []
        for x in w:
            out += [x, rnd.choice([" ", " ", " ", " ", "\n", "\n\n"])]
        return "".join(out)

    page, passages, rows, want = text(200), [text(n) for n in (49, 50, 51, 55, 60, 80, 140)], {}, {}
    for i in range(120):
        w = text(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 2)):
            k = rnd.randrange(len(passages))
            lo = rnd.choice([0, 0, 5])
            at = len(w)
            w += passages[k][lo:]
            if len(passages[k]) - lo >= 50:
                want.setdefault(k, []).append((i, at, len(passages[k]) - lo))
            w += text(rnd.randint(0, 30))
        rows[i] = w
    rows |= {200: page, 201: page, 202: ["one"] * 130 + ["two"] + ["one"] * 60, 203: ["x", "y"] * 45, 204: text(49), 300: text(9)}
    rows[205], rows[301] = rows[204], rows[300]
    d = docs(spark, [(i, wrapped(w)) for i, w in rows.items()] + [(400, None), (401, " \n")])
    got = paragraph_minhash.repeated_paragraphs(d).collect()
    found = {(r["doc_id"], r["start"], r["n_words"], r["keep_doc_id"], r["keep_start"], r["removed"]) for r in got if r["unit"] == "passage"}
    assert found == brute_passages(rows, 50)
    covered = collections.defaultdict(set)
    for i, start, n, *_ in found:
        covered[i].update(range(start, start + n))
    assert all(covered[i] >= set(range(at, at + n)) for own in want.values() if len(own) > 1 for i, at, n in own if n == max(x[2] for x in own) and
               sum(x[2] == n for x in own) > 1)
    assert {r["doc_id"] for r in got if r["unit"] == "piece"} >= {200, 201, 204, 205, 300, 301}
    for r in got:  # whatever the unit, equal words
        if r["unit"] != "paragraph":
            n = r["n_words"]
            assert rows[r["doc_id"]][r["start"]:r["start"] + n] == rows[r["keep_doc_id"]][r["keep_start"]:r["keep_start"] + n]


def test_paragraphs_of_short_lines(spark):
    rnd = random.Random(13)
    text = lambda n: [f"r{rnd.randrange(4000)}" for _ in range(n)]
    wrap = lambda w, n: "\n".join(" ".join(w[k:k + n]) for k in range(0, len(w), n))
    page = text(90)
    other = list(page)
    other[40] = "changed"
    long = text(30)
    rows = [(1, wrap(page, 9)), (2, " ".join(long) + "\n" + wrap(other, 13) + "\n\n" + wrap(text(40), 7)), (3, wrap(text(60), 11))]
    got = {(r["doc_id"], r["start"], r["n_words"], r["keep_doc_id"], r["keep_start"], r["removed"])
           for r in paragraph_minhash.repeated_paragraphs(docs(spark, rows)).collect() if r["unit"] == "paragraph"}
    assert got == {(1, 0, 90, 1, 0, False), (2, 30, 90, 1, 0, True)}


def test_tuned_bands():
    bands, rows = paragraph_minhash.tune()
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_words_of_slices():
    base = pa.array([f"É{i} À  b{i}\tX" for i in range(50)] + [None, ""])
    for lo, n in ((0, 52), (20, 5), (49, 3)):
        codes, offsets, distinct = split_words(base.slice(lo, n))
        got = [[distinct[c].as_py() for c in codes[a:b]] for a, b in zip(offsets, offsets[1:])]
        assert got == [words(t or "") for t in base.slice(lo, n).to_pylist()]


# ---- packing ----

def check_pieces(pieces, texts, window):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary())
    ids = {i: np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], np.uint32) for i, t in texts}
    got, by = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]][p["start"]:p["start"] + p["length"]]
        assert len(own) == p["length"] > 0 and zlib.crc32(own.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
        got[p["doc_id"]].append((p["start"], p["length"]))
        by[p["sequence_id"]].append((p["offset"], p["length"]))
    for s in by.values():
        end = 0
        for off, n in sorted(s):
            assert off == end
            end += n
        assert end <= window
    assert sorted(by) == list(range(len(by)))
    return got, ids, len(by)


@pytest.mark.parametrize("window", [16, 64])
def test_packing_is_whole_and_tight(spark, window):
    rnd = random.Random(8)
    texts = [(i, " ".join(rnd.choice(["the", "word", "foo,", "Bar.", "don't", "éa", "12"]) for _ in range(rnd.choice([1, 5, 9, 9, 30, 80])))) for i in range(300)]
    texts += [(900, None), (901, ""), (902, " \n ")]
    out = packing.pack(docs(spark, texts), vocabulary(), window).collect()
    got, ids, n = check_pieces(out, texts, window)
    for i, own in got.items():
        end = 0
        for start, length in sorted(own):
            assert start == end
            end += length
        assert end == len(ids[i])
    total = sum(map(len, ids.values()))
    assert set(got) == set(ids) and n == -(-total // window)  # only the last sequence is padded
    assert packing.pack(docs(spark, []), vocabulary(), window).count() == 0


def test_marked_words_equal_whole_texts():
    """Every letter before a comma or full stop; some letters are no letters alone once normalised."""
    enc = packing.Encoder(vocabulary())
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    texts = [f"{w}{m}" for w in ["HANG\u0130", "ab\u0958", *letters] for m in ",."]
    whole = [e.ids for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    flat, at = enc.batch(pa.array(texts))
    wrong = [t for t, ids, lo, hi in zip(texts, whole, at[:-1], at[1:]) if flat[lo:hi].tolist() != ids]
    assert not wrong


def test_packing_repeated_ids(spark):
    out = packing.pack(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "d e")]), vocabulary(), 8).collect()
    assert sum(r["length"] for r in out) == 4 + 4 + 3


def test_nnls_plan_respects_the_histogram():
    hist = {k: 1 + (k * 7919) % 50 for k in range(1, 128)}
    slots, rest, planned, left = packing.make_plan(hist, 128)
    used = collections.Counter()
    for length, first, n, *_ in slots:
        assert first == used[length]
        used[length] += n
    assert all(used[k] <= hist[k] for k in hist) and sum(k * v for k, v in used.items()) == planned * 128
    assert planned > 0.5 * sum(k * v for k, v in hist.items()) / 128


# ---- scores ----

def test_scores(spark):
    rows = table(spark)
    got = {r["doc_id"]: r for r in QUERIES["op8_lm_score"](spark, SF).collect()}
    fold = lambda i: zlib.crc32(str(i).encode()) % 7
    seen = collections.Counter()
    for i, r in rows.items():
        if fold(i) != 2:
            seen.update([*words(r["text"] or ""), None])
    n, v = sum(seen.values()), len(seen)
    for i, r in rows.items():
        t = [*words(r["text"] or ""), None]
        base = sum(np.log10((seen[x] + 1) / (n + v + 1)) for x in t)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["held_out"] == (fold(i) == 2)
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(t), sum(seen[x] > 0 for x in t), n)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_score_is_the_mixture(spark):
    """The weights recomputed from one block of statistics give the reported scores, and sum to one."""
    rng = np.random.default_rng(0)
    bucket = rng.integers(0, 5, 4000)
    p = rng.random((4000, 3))
    p[bucket == 0, 0] = 0
    w = deleted_interp.learn_weights(bucket, p, np.ones(4000))
    assert np.allclose(w.sum(1), 1) and (w >= 0).all() and w[0, 0] == 0
    like = lambda m: np.log((m[bucket] * p).sum(1)).sum()
    assert like(w) >= like(np.tile([0.2, 0.4, 0.4], (64, 1))) - 1e-6 or like(w) > like(np.full((64, 3), 1 / 3))


def test_totals_beyond_four_bytes():
    """Blocks' counts fit four bytes, their totals need not."""
    planes = deleted_interp._planes
    keys, counts = np.array([5, 9], np.uint64), np.array([3_000_000_000, 7])
    rows = [(0, b, 1, b == 0, planes(keys, "<u8"), planes(counts, "<u4")) for b in range(2)]
    got = deleted_interp._add_part(pa.table([pa.array(list(c)) for c in zip(*rows)], names=["part", "block", "kind", "teaches", "keys", "counts"]))
    event = type("E", (), {"word": keys, "before": keys, "pair": keys})
    words = np.sort(np.append(keys, deleted_interp.BEGIN))
    pad = pa.table({"part": [0, 0], "block": [0, 0], "kind": [1, 2], "totals": [planes(np.zeros(1), "<u8"), planes(np.zeros(2), "<u8")]})
    own = got.filter(pa.compute.equal(got.column("block"), 0)).select(["part", "block", "kind", "totals"])
    assert list(words[:2]) == [5, 9]  # the padding, of part 1, follows
    pad = pad.set_column(0, "part", pa.array([1, 0]))
    known = deleted_interp.Known(event, pa.concat_tables([own, pad.cast(own.schema)]), "totals")
    assert known.word.tolist() == [6_000_000_000, 14] and got.column("tokens_left").to_pylist()[0] == 3_000_000_007


def test_a_block_needs_little_more_memory_than_its_tokens():
    """Peak of counting, scoring and learning in bytes a token (scoring and learning: 121 and 124 when they held all of a block at once)."""
    import tracemalloc

    rng = np.random.default_rng(1)
    text = [" ".join(map(str, rng.integers(0, 30_000, 500))) for _ in range(2000)]
    n = len(text)
    yes = pa.array(np.ones(n, bool))
    rows = pa.table([pa.array(np.arange(n)), pa.array(text), yes, yes, yes, pa.array(np.zeros(n, np.int32))],
                    names=["doc_id", "text", "held_out", "train", "teaches", "block"])
    tokens = 501 * n

    def peak(run, *args):
        tracemalloc.start()
        try:
            return run(*args), tracemalloc.get_traced_memory()[1] / tokens
        finally:
            tracemalloc.stop()

    runs, count = peak(deleted_interp._count_block(4), rows)
    parts = [runs.filter(pa.compute.equal(runs.column("part"), k)) for k in range(4)]
    answers = pa.concat_tables([deleted_interp._add_part(p) for p in parts])
    scored, score = peak(deleted_interp._score(tokens, 30_001, np.full((64, 3), 1 / 3)), rows, answers)
    bins, learn = peak(deleted_interp._histogram(tokens, 30_001), rows, answers)
    assert sum(scored.column("n_tokens").to_pylist()) == tokens == sum(bins.column("n").to_pylist())
    assert scored.column("n_known").to_pylist() == scored.column("n_tokens").to_pylist()
    assert count < 100 and score < 100 and learn < 100


def test_score_edges(spark):
    d = docs(spark, [(i, None if i % 5 == 0 else "a b c a b") for i in range(40)] + [(None, "z z"), (3, "a b")])
    got = deleted_interp.score_texts(d).collect()
    assert len(got) == 42 and all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] == 5} == {1}
    assert deleted_interp.score_texts(docs(spark, [])).count() == 0


# ---- language ----

def test_block_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 5, 32, 33, 100, 0, 64, 500])
    offsets = np.concatenate([[0], np.cumsum(size)])
    scores, t, first = rng.normal(size=(offsets[-1], 3)) * 3, rng.normal(size=(3, 3)), rng.normal(size=3)
    got = lang_crf.posteriors(scores, offsets, t, first)
    for i, (lo, hi) in enumerate(zip(offsets, offsets[1:])):
        want = lang_crf.posterior_words(scores[lo:hi], t, first).sum(0) if hi > lo else np.zeros(3)
        assert np.allclose(got[i], want, atol=1e-8)


def test_language_held_out_and_code_switching(spark):
    rows = table(spark)
    got = {r["doc_id"]: r for r in QUERIES["op1_language_id"](spark, SF).collect()}
    held = [i for i in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i]["held_out"] == (i in held) for i in rows)
    assert np.mean([got[i]["lang_pred"] == rows[i]["lang"] for i in held]) > 0.95
    model = lang_crf.train(spark.read.parquet(f"{SF}/documents.parquet"))
    text = {}
    for r in rows.values():
        if len(r["text"].split()) > 60 and r["lang"] not in text and got[r["doc_id"]]["score"] > 0.95:
            text[r["lang"]] = " ".join(r["text"].split()[10:50])
    (la, a), (lb, b) = sorted(text.items())[:2]
    labels = [x for _, x in lang_crf.label_words(model, f"{a} {b}")]
    half = len(lang_crf.label_words(model, a))
    assert np.mean([x == la for x in labels[:half]]) > 0.8 and np.mean([x == lb for x in labels[half:]]) > 0.8


def test_language_edges(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "hello world"), (None, "hello"), (4, "hello world")])
    got = sorted((r["doc_id"] or 0, r["lang_pred"], 0 <= r["score"] <= 1) for r in lang_crf.language_report(d).collect())
    assert [x[:2] for x in got if x[0] in (1, 2, 3)] == [(1, "und"), (2, "und"), (3, "und")] and all(x[2] for x in got)
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in lang_crf.language_report(none).collect()} == {"und"}
    assert lang_crf.drop_unidentified(none).count() == 6
    kept = lang_crf.drop_unidentified(d)
    assert kept.columns == d.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 4]
    assert lang_crf.language_report(docs(spark, [])).count() == 0


# ---- pipeline ----

def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from pacegrid.llm.common import stored

    rows = {r["doc_id"]: r["text"] or "" for r in table(spark).values()}
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    keep = {}
    for name, stage in corpus_pipeline.STAGES:
        d = stored(stage(spark, d, SF), name)
        if name != "packing":
            assert d.columns == columns
            keep[name] = {r["doc_id"]: r["text"] for r in d.collect()}
    assert all(any(c.isalpha() for c in t) for t in keep["language_id"].values())
    # line dedup by hand on what language ID kept
    holders = collections.defaultdict(set)
    key = lambda x: "".join(c.lower() if c < "\x80" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t in keep["language_id"].items():
        for x in t.split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    want = {}
    for i, t in keep["language_id"].items():
        own = [x for x in t.split("\n") if not (len(holders.get(key(x), ())) >= 3 and i != max(holders[key(x)]))]
        if own:
            want[i] = "\n".join(own)
    assert keep["line_dedup"] == want
    comp = brute_components(list(want.items()))
    assert set(keep["ngram_join"]) == {i for i in want if comp[i][1] == i}
    clean = {r["doc_id"] for r in decontam.contamination(spark.createDataFrame(list(keep["ngram_join"].items()), "doc_id long, text string"),
                                                         spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(keep["decontamination"]) == set(keep["ngram_join"]) - clean
    got, ids, n = check_pieces(d.collect(), list(keep["decontamination"].items()), 2048)
    assert set(got) == set(ids) and sum(x[1] for v in got.values() for x in v) == sum(map(len, ids.values()))
    run = corpus_pipeline.run(spark, SF).collect()
    assert {(r["doc_id"], r["start"], r["length"]) for r in run} >= {(r["doc_id"], 0, 2048) for r in run if r["length"] == 2048 and r["start"] == 0}
    assert len({r["doc_id"] for r in run}) == len(keep["decontamination"])


def test_packing_ids_of_random_texts_equal_whole_encoding():
    """Words, marks, signs that compose and special strings in any order: ids of texts are those of encoding them whole."""
    draw = random.Random(17)
    parts = list("abXYz\u00e9\u0301\u0307\u0338\u00c9\u0130\u0131\u00df '',.!=<>&$|19\u00bd\u4e2d\ud55c\u3131\n\t\x0bsStTmMdD") + [
        "'s", "'LL", "<|startoftext|>", "<|endoftext|>", "H\u0331", "\u00e9,", "x.,", "\x00", "\x1c"]
    made = ["".join(draw.choice(parts) for _ in range(draw.randrange(50))) for _ in range(4000)]
    made += ["", ",", "...", "word,", "don't.", "a" * 5000]
    enc = packing.Encoder(vocabulary())
    for lo in range(0, len(made), 97):
        some = made[lo:lo + 97]
        flat, at = enc.batch(pa.array(some))
        for k, text in enumerate(some):
            assert flat[at[k]:at[k + 1]].tolist() == enc.tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_scratch_tables_are_deleted_and_others_stay(spark):
    """Dropping a scratch folder deletes its tables alone; a result stored before is still read."""
    from pathlib import Path
    from urllib.parse import urlparse

    from pacegrid.llm.common import Scratch, stored

    scratch, other = Scratch(spark), Scratch(spark)
    table = scratch.stored(spark.range(10), "numbers")
    assert other.stored(spark.range(3), "numbers").count() == 3
    result = stored(table.selectExpr("sum(id) as s"), "sum")
    scratch.drop()
    assert not Path(urlparse(scratch.folder).path).exists() and Path(urlparse(other.folder).path).exists()
    assert result.collect()[0]["s"] == 45
    scratch.drop()  # nothing left: no error


def test_ngram_join_leaves_no_sets_behind(spark):
    """The shingle sets that pairs are verified by are deleted once the links are stored."""
    from pathlib import Path

    from pacegrid.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    left = lambda: set(folder.glob("pacegrid-llm-*/*sets"))
    before = left()
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:59] + [f"x{i}"])) for i in range(6)] + [(9, "a b c d e f g")]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_components(docs(spark, rows)).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9} and left() == before


def test_buckets_with_the_same_members_are_one_class(spark):
    """Buckets are handled as classes, not as one row per bucket and member: these rows went through four shuffles."""
    from pathlib import Path

    from pacegrid.session import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    stored = lambda: set(folder.glob("pacegrid-llm-*/shared"))
    before = stored()
    text = " ".join(f"b{k}" for k in range(900))
    rows = [(i, text) for i in range(6)] + [(9, text[:2000])]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in ngram_join.ngram_components(docs(spark, rows)).collect()} == brute_components(rows)
    (folder,) = stored() - before
    shared = spark.read.parquet(str(folder))
    buckets, rows = shared.select("sig").filter("sig is not null").distinct().count(), shared.count()
    assert buckets > 400 and rows < 3 * buckets  # 6 rows a bucket before


@pytest.mark.parametrize("seed,block", [(4, 8), (5, 256)])
def test_components_with_small_blocks_and_filtered_texts(spark, monkeypatch, seed, block):
    for name, value in (("FEW", 1), ("BLOCK", block), ("MANY", 0)):
        monkeypatch.setattr(ngram_join, name, value)
    rows = hard_rows(seed, 240)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"])
            for r in ngram_join.ngram_components(docs(spark, rows)).collect()} == brute_components(rows)


@pytest.mark.parametrize("block", [8, 256])
def test_groups_that_overlap_are_not_one(spark, monkeypatch, block):
    """A chain of groups was one group, in which all sets were compared: with more documents most groups were in it."""
    from pathlib import Path

    from pacegrid.session import checkpoint_dir

    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(3)
    sets = []
    for k in range(40):  # groups of 31, the last of one is the first of the next; most sets have a near copy
        for i in range(30):
            base = rng.integers(0, 2 ** 63, rng.integers(5, 200), dtype=np.uint64) if i % 3 == 0 else base
            sets.append(np.unique(np.concatenate([base[i % 3:], rng.integers(0, 2 ** 63, i % 2, dtype=np.uint64)])))
    info = [(i, len(x), ngram_join.sketches(x, np.array([0, len(x)]))[0]) for i, x in enumerate(sets)]
    crowd = [(30 * k, i) for k in range(40) for i in range(30 * k, min(30 * k + 31, len(sets)))]
    folder = Path(checkpoint_dir(spark).removeprefix("file:"))
    stored = lambda: set(folder.glob("pacegrid-llm-*/blocks"))
    before = stored()
    got = ngram_join._in_blocks(spark.createDataFrame(info, "doc_id long, n_shingles long, sketch binary"),
                                spark.createDataFrame(crowd, "head long, doc_id long"), spark.createDataFrame([(1, 0)], "id long, component_id long"))
    want = {(a, b) for k in range(40) for a, b in itertools.combinations(range(30 * k, min(30 * k + 31, len(sets))), 2)
            if (a, b) != (0, 1) and ngram_join.may_link(*info[a][1:], *info[b][1:])}
    assert {(r["a"], r["b"]) for r in got.collect()} == want and len(want) > 500
    (folder,) = stored() - before
    held = [len(r["sets"]) for r in spark.read.parquet(str(folder)).select("sets").collect()]
    assert sum(held) == len(crowd) and sum(n * n for n in held) <= 40 * 31 * 31


def test_texts_of_many_ids_are_not_shuffled(spark):
    """Texts went through a shuffle as soon as the ids were too many to be broadcast."""
    rows = spark.range(60_000).selectExpr("id as doc_id", "'x' as text")
    ids = spark.range(0, 60_000, 3).selectExpr("id as doc_id")
    with_filter = ngram_join._of(rows, ids, 20_000)
    assert 20_000 > ngram_join.MANY
    plan = with_filter._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    got = {r["doc_id"] for r in with_filter.collect()}
    assert got >= set(range(0, 60_000, 3)) and len(got) < 21_000
    exact = ngram_join._of(rows, ids.filter("doc_id < 900"), 300)
    assert {r["doc_id"] for r in exact.collect()} == set(range(0, 900, 3))


def test_equal_sets_link_without_their_shingles(spark, monkeypatch):
    """Exact copies link by their digests; every copy's shingles were stored and joined twice."""
    seen, verified = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda d, pairs, scratch: seen.append(pairs.count()) or verified(d, pairs, scratch))
    one, two = (" ".join(f"{w}{k}" for k in range(80)) for w in "xy")
    rows = [(i, one) for i in range(12)] + [(i, two.upper() if i % 2 else two) for i in range(20, 30)] + [(40, one + " end"), (41, "z")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows) and sum(seen) == 1


def test_signatures_of_slices_are_cut_together():
    """The buckets are the same however many slices are cut into parts at once; rows no longer grow with slices times parts."""
    rng = np.random.default_rng(8)
    held = [(rng.integers(0, 60, 90).astype(np.uint64) << np.uint64(58), rng.integers(0, 40, 90).astype(np.uint32), np.arange(20 * k, 20 * k + 20))
            for k in range(5)]
    apart = pa.Table.from_batches([b for x in held for b in ngram_join._cut([x], 4)])
    together = pa.Table.from_batches(list(ngram_join._cut(list(held), 4)))
    assert apart.num_rows == 20 and together.num_rows == 4
    for part in range(4):
        one, other = (ngram_join._shared(t.filter(pa.compute.equal(t["part"], part))) for t in (apart, together))
        assert one.equals(other) and one.num_rows > 50


def test_segments_are_counted_without_their_contents():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64)) for n in (0, 1, 15, 16, 30, 31, 500, 0)]
    h, offsets = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    want = [[sum(int((owner == i).sum()) for owner, f, *_ in ngram_join.segment_table(h, offsets) if f[0] == family) for i in range(len(sets))]
            for family in (0, 1)]
    assert [n.tolist() for n in ngram_join.segment_counts(h, offsets)] == want
    assert len(set(ngram_join.set_digests(h, offsets).tolist())) == 7  # the empty sets are equal


def test_decontamination_hashes_a_slice_at_a_time():
    """Memory follows the slice and not the batch; the clusters are those of the whole batch."""
    import tracemalloc

    rng = np.random.default_rng(2)
    text = [" ".join(map(str, rng.integers(0, 10_000, 400))) for _ in range(2000)]
    batch = pa.record_batch([pa.array(np.arange(len(text))), pa.array(text)], names=["doc_id", "text"])
    bitmap = np.zeros(1 << 12, np.uint64)
    bitmap[::64] = 1
    tracemalloc.start()
    got = [b for b in decontam.find_clusters([batch], bitmap, decontam.MASKS, 20)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    size = sum(map(len, text))
    assert len(got) >= size // decontam.SLICE_BYTES > 4 and peak < 4 * size
    one = [b for k in range(len(text)) for b in decontam.find_clusters([batch.slice(k, 1)], bitmap, decontam.MASKS, 20)]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches(one)) and pa.Table.from_batches(got).num_rows > 100


def test_step_four_reads_the_texts_only_for_sets_that_need_it(spark, monkeypatch):
    """Without a set that lacks units no document is read again (all texts were shuffled to find none)."""
    reached, asked = [], []
    near, blocks = ngram_join._neighbour_rows, ngram_join._block_pairs
    monkeypatch.setattr(ngram_join, "_neighbour_rows", lambda *a: reached.append(1) or near(*a))
    monkeypatch.setattr(ngram_join, "_block_pairs", lambda d, ids: asked.append(ids.count()) or blocks(d, ids))
    rnd = random.Random(5)
    shared = [f"s{k}" for k in range(200)]
    rows = [(i, " ".join(shared[:120 + i] + [f"{rnd.random()}" for _ in range(40)])) for i in range(30)]
    comps, info = ngram_join.links_and_sizes(docs(spark, rows))
    comp = {r["id"]: r["component_id"] for r in comps.collect()}
    size = {r["doc_id"]: r["n_shingles"] for r in info.collect()}
    assert {i: (size[i], comp.get(i, i)) for i in size} == brute_components(rows)
    assert reached and asked == []


def test_shingles_of_all_paragraphs_are_hashed_at_once(monkeypatch):
    """One call per batch and not per paragraph, with the sets of one paragraph at a time."""
    calls = []
    mix = paragraph_minhash.mix64
    rnd = random.Random(3)
    lines = [" ".join(str(rnd.randint(0, 9)) for _ in range(rnd.randint(20, 60))) for _ in range(120)]
    u = paragraph_minhash.Units(pa.array(["\n".join(lines[:70]), None, "", "\n\n", "\n".join(lines[70:]) + "\n"]))
    doc, lo, hi = u.paragraphs()
    assert doc.tolist() == [0] * 70 + [4] * 50
    monkeypatch.setattr(paragraph_minhash, "mix64", lambda x: calls.append(len(x)) or mix(x))
    sets = u.shingles(lo, hi)
    assert len(calls) == 1
    for line, a, b, s in zip(lines, lo, hi, sets):
        w = line.split()
        assert b - a == len(w) and len(s) == len({tuple(w[k:k + 5]) for k in range(len(w) - 4)})
        assert (s[1:] > s[:-1]).all() and np.array_equal(u.shingles(np.array([a]), np.array([b]))[0], s)


def test_equal_pieces_against_a_count(spark):
    """Packed runs of pieces give the classes that a plain count of the pieces gives, also for rows that share an id."""
    rnd = random.Random(12)
    chunks = [" ".join(f"{rnd.random()}" for _ in range(60)) for _ in range(12)]
    rows = [(i % 25 - 3, " ".join(rnd.choice(chunks) + f" {i} " + rnd.choice(chunks) for _ in range(3))) for i in range(30)]
    places = {}
    for i, text in rows:
        u = paragraph_minhash.Units(pa.array([text]))
        words = text.split()
        for _, lo, hi in zip(*u.pieces()):
            if hi - lo >= paragraph_minhash.MIN_PIECE:
                places.setdefault(tuple(words[lo:hi]), []).append((i, int(lo), int(hi - lo)))
    want = sorted((i, s, n, *min(own)[:2], (i, s) != min(own)[:2]) for own in places.values() if len({x[:2] for x in own}) > 1 for i, s, n in own)
    d = docs(spark, rows + [(None, rows[0][1]), (50, None)])
    got = paragraph_minhash.piece_classes(d)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 50
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()  # nor a row of the JVM for each piece
    assert paragraph_minhash.piece_classes(docs(spark, [])).count() == 0
