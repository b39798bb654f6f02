"""Conversation repair, SimHash and source divergence against brute force on small fixtures."""

import collections
import hashlib
import heapq
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pacegrid.llm import repair, simhash, stripes
from pacegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"
TALK = "conv_id long, turn long, role string, text string, part int, pos long, audit string, fault string, harm int"
DOCS = "doc_id long, text string, lang string, source string, term string, fp long, mask long, total long, component_id long"


# ---- conversation repair ----

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def brute_audit(rows):
    """rows (role, text, fault) -> (cost, audit, repaired lines) by Dijkstra over (cost, audit)."""
    heap, seen = [(0, "", 0, "0", ())], set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in "0a":
            return cost, audit, lines
        if (i, state) in seen:
            continue
        seen.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in NEXT:
                heapq.heappush(heap, (cost + 2, audit + "I", i, NEXT[state, role[0]], (*lines, f"{role}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                x = int(fault == "truncated")
                if (state, role[:1]) in NEXT:
                    heapq.heappush(heap, (cost + x, audit + "K", i + 1, NEXT[state, role[:1]], (*lines, f"{role}:{text}")))
                for new in ("user", "assistant"):
                    if (state, new[0]) in NEXT:
                        heapq.heappush(heap, (cost + 2 + x, audit + "R", i + 1, NEXT[state, new[0]], (*lines, f"{new}:{text}")))
    raise AssertionError


def brute_repair(rows):
    """rows (conv_id, turn, role, text) -> {conv_id: the contract's columns}."""
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c]
        r, x = " " if r is None else r, " " if x is None else x
        harm = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if harm:
            new = (t, "user" if harm == 4 else r, "" if harm == 1 else re.sub("[.!?]", "", x) if harm == 2 else x)
            convs[c] += [new] * (2 if harm == 3 else 1)
    out = {}
    for c, own in convs.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, marked = set(), []
        for t, r, x in own:
            body = x.rstrip(BLANK)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            marked.append((r, x, fault))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit, lines = brute_audit(marked)
        n = collections.Counter(f for _, _, f in marked)
        out[c] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"],
                  sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                  cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check_repair(spark, rows, parts=8):
    frame = spark.createDataFrame([(*r, 1, 2, "x", "y", 3) for r in rows], TALK)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in repair.repair(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = brute_repair(rows)
    assert len(got) == len(want)
    assert {r[0]: r[1:] for r in got} == want


def test_auction_finds_the_least_audit():
    rng = random.Random(5)
    for n in [*range(7)] * 60 + [40, 100, 300]:
        kinds = [(rng.choice(["", "", "", "blank", "duplicate", "truncated"]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]))
                 for _ in range(n)]
        assert repair.cheapest_audit(kinds) == brute_audit([(r, "x", f) for f, r in kinds])[1]


def test_pieces_join_to_the_whole():
    """Distances of pieces folded backwards, traces folded forwards: the same audit as in one go."""
    rng = random.Random(7)
    for n, size in [(9, 2), (40, 7), (120, 30)] * 15:
        kinds = [(rng.choice(["", "", "blank", "duplicate", "truncated"]), rng.choice(["system", "user", "assistant", "assistant"])) for _ in range(n)]
        price, windows = [c for c, _ in repair.END], []
        for lo in reversed(range(0, n, size)):
            piece = kinds[lo:lo + size]
            windows.append(repair.converge(piece, price)[0])
            costs = np.array([repair.converge(piece, [0 if k == e else repair.BIG for k in range(4)])[1] for e in range(4)]).T
            price = np.minimum(costs + np.array(price), repair.BIG).min(axis=1).tolist()
        state, audit = 0, ""
        for w in reversed(windows):
            step, state = repair.trace(w, state)
            audit += step
        assert audit + repair.END[state][1] == repair.cheapest_audit(kinds)


def test_repair_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES["op11_conversation_repair"](spark, SF).collect()}
    assert got == brute_repair(rows)


def test_repair_of_nulls_ties_copies_and_a_crowded_conversation(spark):
    rng = random.Random(11)
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "u", "Äuser"]
    says = ["ok.", "Fine!", "no end", "", None, " \t\n", "ok.", "Ja?  \n", "ünïcode …", "a\nb."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(says)) for c in [None, *range(-3, 25)] for _ in range(rng.randint(1, 7))]
    rows += [(500, t, rng.choice(["user", "assistant"]), rng.choice([f"say {t}.", "same.", f"cut {t}"])) for t in range(400)]  # a third of all rows
    rows += [(501, None, "user", "again.")] * 90 + [(501, 2 ** 40, "assistant", "far.")]  # repeated rows
    rows += [(502, t, "user", "hi.") for t in range(2000) if zlib.crc32(f"502:{t}".encode()) % 20 == 0][:2]  # all dropped
    check_repair(spark, rows)
    check_repair(spark, rows, parts=31)


def test_repair_of_long_texts_and_no_rows(spark):
    check_repair(spark, [(1, 0, "user", "long " * 1_000_000 + "."), (1, 1, "assistant", "x" * 3_000_000), (2, 0, "user", "")])
    assert repair.repair(spark.createDataFrame([], TALK)).count() == 0


# ---- SimHash ----

def brute_fingerprint(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    shingles = [words[k:k + 3] for k in range(len(words) - 2)] if len(words) >= 3 else [words] if words else []
    h = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(rows):
    """rows (doc_id, fingerprint) -> component of each row."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_fingerprints_against_brute_force():
    texts = ["", None, " \n ", "One", "one TWO", "one two three", "a\tb\n\nc  d e f", "ÄÖ Über ß x y z", "x" * 100_000, "w " * 5_000,
             " ".join(f"t{k}" for k in range(200))]
    for block in (7, 1 << 16):
        assert simhash.simhash(pa.array(texts), block=block).tolist() == [brute_fingerprint(t) for t in texts]
    cut = pa.array(["zz"] + texts).slice(1)
    assert simhash.simhash(cut).tolist() == [brute_fingerprint(t) for t in texts]


def near_numbers(rng, n):
    """Random 64-bit numbers with chains of neighbours at one to five bits."""
    out = [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.choice(out) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        out.append(x)
    return out


def test_index_finds_every_close_pair():
    rng = random.Random(3)
    for fan, pairs in ((2, 16), (4, 100), (16, 1 << 20)):
        fp = np.unique(np.array(near_numbers(rng, 300), np.uint64))
        node = np.sort(np.array([rng.randrange(4) for _ in fp]))
        order = np.lexsort((simhash.gray_rank(fp), node))
        fp, node = fp[order], node[order]
        got = sorted((int(a), int(b)) for x, y in simhash.close_pairs(fp, node, 3, fan, pairs) for a, b in zip(x, y))
        want = [(i, j) for i, j in itertools.combinations(range(len(fp)), 2)
                if node[i] == node[j] and int(fp[i] ^ fp[j]).bit_count() <= 3]
        assert sorted((min(p), max(p)) for p in got) == want


def test_gray_rank_orders_the_gray_code():
    k = np.arange(256, dtype=np.uint64)
    assert simhash.gray_rank(k ^ (k >> np.uint64(1))).tolist() == k.tolist()


@pytest.mark.parametrize("crowded", [9, 40, 1 << 14])
def test_links_join_the_brute_force_classes(spark, crowded):
    rng = random.Random(crowded)
    numbers = near_numbers(rng, 500)
    signed = sorted({x - (1 << 64) if x >> 63 else x for x in numbers})
    entries = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.near_links(entries, crowded=crowded, per_task=100).collect()
    assert all(((r["a"] ^ r["b"]) % (1 << 64)).bit_count() for r in links)
    label = {x: x for x in signed}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in links:
        label[find(r["a"])] = find(r["b"])
    want = brute_classes([(i, x % (1 << 64)) for i, x in enumerate(signed)])
    got = collections.defaultdict(list)
    for i, x in enumerate(signed):
        got[find(x)].append(i)
    assert sorted(map(sorted, got.values())) == sorted(
        [i for i, c in enumerate(want) if c == k] for k in set(want))


def test_simhash_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in rows]
    want = {d: (f"{x:016x}", c) for (d, x), c in zip(prints, brute_classes(prints))}
    got = QUERIES["op12_simhash"](spark, SF).collect()
    assert len(got) == len(rows) and {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == want


def test_simhash_of_nulls_copies_long_texts_and_no_rows(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(5, None), (3, " \n"), (None, ""), (9, base), (9, base), (7, base + " more"), (None, base.upper()), (11, "lone text here and there"),
            (12, "lone text here and there"), (None, "no id at all"), (20, "y " * 1_500_000 + base)]
    frame = spark.createDataFrame([(i, t, "en", "s", "t", 1, 2, 3, 4) for i, t in rows], DOCS)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    want = collections.Counter((i, f"{x:016x}", c) for (i, x), c in zip(prints, brute_classes(prints)))
    assert collections.Counter(tuple(r) for r in simhash.simhash_components(frame).collect()) == want
    assert simhash.simhash_components(frame.limit(0)).count() == 0


# ---- source divergence ----

def brute_divergences(rows, min_docs, top):
    """rows (text, lang, source) -> the contract's rows."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in t)) for t, _, _ in rows]
    df, count, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for (_, lang, source), own in zip(rows, terms):
        groups[lang].add(source)
        df.update({(lang, w) for w in own})
        for w in own:
            count[lang, source, w] += 1
            count[lang, None, w] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted((w for (l, w), n in df.items() if l == lang and n >= min_docs), key=str.encode)
        total = {s: sum(count[lang, s, w] for w in kept) for s in [None, *sources]}
        p = {s: [1 + 10 ** 9 * (count[lang, s, w] + 5) // (total[s] + 5 * len(kept)) for w in kept] for s in total}
        for s in sources:
            pairs = [(o, sum(abs(a - b) for a, b in zip(p[s], p[o]))) for o in sources - {s}]
            tops = [(w, a - q) for w, a, q in zip(kept, p[s], p[None]) if count[lang, s, w] and a > q]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", tops, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, w, v, k + 1) for k, (w, v) in enumerate(items)]
    return sorted(out)


def test_divergences_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    got = sorted(tuple(r) for r in QUERIES["op13_source_divergence"](spark, SF).collect())
    assert got == brute_divergences(rows, 30, 50)


@pytest.mark.parametrize("limits", [{}, {"held": 20, "bucket": 1, "block": 2}, {"held_terms": 3, "bucket": 40, "block": 1}])
def test_divergences_with_spills_buckets_and_blocks(spark, limits):
    rng = random.Random(2)
    vocabulary = ["a", "B", "é", "Éa", "zz", "the", "THE", "ff", "x9y", "naïve", "w_w", "日本", "q'r"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 12))) if rng.random() < 0.9 else None,
             rng.choice(["en", "de", None, ""]), rng.choice(["s1", "s1", "s1", "s2", "s10", None, "É", "s3"])) for _ in range(150)]
    rows += [("rare words only", "xx", "s1"), ("", "xx", "s2"), ("the the", "yy", "s1")] + [("the end", "en", "s1")] * 40
    frame = spark.createDataFrame([(k, *r, "t", 1, 2, 3, 4) for k, r in enumerate(rows)], DOCS).repartition(5)
    got = sorted(tuple(r) for r in stripes.source_divergences(frame, min_docs=6, top=3, **limits).collect())
    assert got == brute_divergences(rows, 6, 3)


def test_divergences_of_a_long_text_and_no_rows(spark):
    rows = [("tick tock " * 400_000, "en", "a"), ("tock", "en", "b"), ("tick", "en", "b")]
    frame = spark.createDataFrame([(k, *r, "t", 1, 2, 3, 4) for k, r in enumerate(rows)], DOCS)
    got = sorted(tuple(r) for r in stripes.source_divergences(frame, min_docs=2).collect())
    assert got == brute_divergences(rows, 2, 50)
    assert stripes.source_divergences(frame.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts():
    rng = random.Random(1)
    for _ in range(200):
        total = rng.randint(1, 9 * 10 ** 17)
        count = np.array([rng.randint(0, total) for _ in range(5)] + [total])
        assert stripes.shares(count, np.int64(total)).tolist() == [1 + 10 ** 9 * int(c) // total for c in count]
