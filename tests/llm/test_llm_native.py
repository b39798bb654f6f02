"""Exact dedup, line dedup and chat formatting: SQL twins, edge rows, reversibility."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pacegrid.llm import chat, exact_dedup, line_dedup
from pacegrid.llm.queries import QUERIES, SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, digest string"


def docs(spark, rows):
    """Rows (doc_id, text) with further columns, two of which clash with names the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 5, "x") for i, t in rows], DOCS)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(map(tuple, d[cols].astype(str).values.tolist()))
    assert key(got) == key(want)


def test_exact_dedup_edges(spark):
    rows = [(1, None), (2, ""), (3, "a"), (4, "A"), (5, "a"), (None, "a"), (5, "a"), (6, "b" * 300_000), (None, "z")]
    got = collections.Counter(map(tuple, exact_dedup.exact_dedup_report(docs(spark, rows)).select(
        "doc_id", "keep_id", "group_size", "kept").collect()))
    assert got == collections.Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 5, 4, False), (4, 4, 1, True), (5, 5, 4, True),
                                       (5, 5, 4, True), (None, 5, 4, False), (6, 6, 1, True), (None, None, 1, True)])
    assert exact_dedup.exact_dedup_report(docs(spark, [])).count() == 0


def test_exact_dedup_heavy_groups_take_the_broadcast_path(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text {i % 400}") for i in range(3000)]
    d = docs(spark, rows)
    heavy = exact_dedup.heavy_hitters(d)
    assert [tuple(r)[1:] for r in heavy.collect()] == [(2997, 1000)]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_dedup_report(d).collect()}
    by = collections.defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    assert got == {i: (max(by[t]), len(by[t])) for i, t in rows}
    assert exact_dedup.drop_copies(d).columns == d.columns


LONG = "a line that is long enough to count"


def test_line_dedup_edges(spark):
    rows = [(1, f"{LONG}\nx"), (2, f"  {LONG.upper()}\t\nshort\nshort"), (3, f"{LONG}\n{LONG}"), (4, None), (5, ""), (6, "\n\n"),
            (None, LONG), (7, "short"), (8, "short")]
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == {1: (2, 1, "x"), 2: (3, 1, "short\nshort"), 3: (2, 0, f"{LONG}\n{LONG}"), 4: (1, 0, ""), 5: (1, 0, ""),
                   6: (3, 0, "\n\n"), None: (1, 1, ""), 7: (1, 0, "short"), 8: (1, 0, "short")}
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_line_dedup_stage_keeps_columns(spark):
    d = docs(spark, [(i, LONG) for i in range(4)] + [(9, None)])
    out = line_dedup.line_dedup_stage(d)
    assert out.columns == d.columns
    assert {(r["doc_id"], r["text"]) for r in out.collect()} == {(3, LONG), (9, None)}


def _state(index):
    return ({(bytes(r["key"]), r["n_docs"], r["keep_id"]) for r in index.counts.collect()},
            {(bytes(r["key"]), r["doc_id"]) for r in index.refs.collect()})


def test_line_index_is_reversible(spark):
    text = lambda i: "\n".join(f"line number {j:03d} of the shared pool" for j in range(i, i + 6))
    a, b = docs(spark, [(i, text(i)) for i in range(20)]), docs(spark, [(i, text(i)) for i in range(15, 40)])
    first = line_dedup.LineIndex.empty(spark, shards=0).insert(a)
    both = first.insert(b)
    whole = line_dedup.LineIndex.empty(spark).insert(docs(spark, [(i, text(i)) for i in range(40)]))
    assert _state(both) == _state(whole)
    back = both.delete(spark.range(20, 40).withColumnRenamed("id", "doc_id"))
    assert _state(back) == _state(first)
    for index in (both, back):  # the filters know every key, and their sizes are exact
        keys = index.counts.withColumn("shard", index._shard(index.shards)).toPandas()
        rows = {r["shard"]: r for r in index.filters.collect()}
        for shard, own in keys.groupby("shard"):
            f = line_dedup.Cuckoo.load(rows[shard]["n_buckets"], bytes(rows[shard]["slots"]))
            assert f.contains([bytes(k) for k in own["key"]]).all()
            assert rows[shard]["n_items"] == len(own) == int((f.slots > 0).sum())
    kept = {r["doc_id"]: r["n_dropped"] for r in back.apply(a).collect()}
    assert kept == {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_dedup(a).collect()}


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = [bytes(rng.bytes(16)) for _ in range(5000)]
    f = line_dedup.Cuckoo.build(keys)
    assert f.contains(keys).all()
    other = [bytes(rng.bytes(16)) for _ in range(20000)]
    assert f.contains(other).mean() < 0.01
    f.delete(keys[:2500])
    assert f.contains(keys[2500:]).all() and f.contains(keys[:2500]).mean() < 0.01
    f.delete(keys[2500:])
    assert not f.slots.any()


EVENTS = "conv_id long, seq long, msg long, role string, kind string, text string, extra string"


def test_events_fold(spark):
    log = [(1, 3, 1, "assistant", "delta", "lo"), (1, 1, 0, "user", "message", "hi"), (1, 2, 1, "assistant", "delta", "hel"),
           (1, 4, 2, "user", "message", "more"), (1, 5, 3, "assistant", "delta", "bad"), (1, 6, 3, "assistant", "regenerate", ""),
           (1, 7, 3, "assistant", "delta", "go"), (1, 8, 3, None, "delta", "od"), (1, 9, 0, "user", "edit", "hi there"),
           (2, 1, 0, "user", "message", None), (2, 2, 1, "assistant", "delta", "a"), (2, 3, 0, "user", "regenerate", "anew"),
           (None, 1, 0, None, "message", "x")]
    e = spark.createDataFrame([(*r, "y") for r in log], EVENTS)
    got = {(r["conv_id"], r["msg"]): (r["role"], r["text"]) for r in chat.fold_events(e).collect()}
    assert got == {(1, 0): ("user", "hi there"), (1, 1): ("assistant", "hello"), (1, 2): ("user", "more"),
                   (1, 3): ("assistant", "good"), (2, 0): ("user", "anew"), (None, 0): ("", "x")}
    assert chat.format_chats(e.limit(0)).count() == 0


def test_escape_round_trip(spark):
    hard = ["", "\\", "<s>", "</s>", "<\\s>", "\\<s>\\", "[INST]", "[/INST][\\/INST]", "<<s>>", "a\\\\</s>\\", "<\\\\s>", "[[INST]]", "$1\n"]
    d = spark.createDataFrame([(i, i, 0, "assistant", "message", t) for i, t in enumerate(hard)],
                              "conv_id long, seq long, msg long, role string, kind string, text string")
    out = chat.format_chats(d)
    back = out.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"), "formatted", "loss_mask").collect()
    assert {r["conv_id"]: r["t"][0]["text"] for r in back} == dict(enumerate(hard))
    for r in back:
        assert r["formatted"].count("</s>") == 1 and r["formatted"].count("[INST]") == 1
    report = {r["conv_id"]: r for r in chat.chat_report(out).collect()}
    assert {i: r["loss_sha256"] for i, r in report.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in enumerate(hard)}


@pytest.mark.parametrize("blocks", [1, 2, 5])
def test_line_dedup_in_blocks_against_brute_force(spark, blocks, monkeypatch):
    """The filters decide which keys meet the old counts; a small shard size makes the index grow shards on the way."""
    monkeypatch.setattr(line_dedup, "KEYS_PER_SHARD", 10)
    rnd = random.Random(blocks)
    pool = [f"a line that is long enough, number {k}" for k in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.7 else f"a line of document {i} alone, {k}"
                          for k in range(rnd.randint(0, 8)))) for i in range(80)]
    index = line_dedup.indexed(docs(spark, rows), blocks=blocks)
    holders = collections.defaultdict(set)
    for i, text in rows:
        for line in text.split("\n"):
            if len(line) >= 20:
                holders[line].add(i)
    assert {bytes(r["key"]): (r["n_docs"], r["keep_id"]) for r in index.counts.collect()} == {
        line_dedup.line_key(x, 20): (len(d), max(d)) for x, d in holders.items()}
    assert index.shards >= (len(holders) // 10 if blocks > 1 else 8)
    drop = {i: sum(len(holders[x]) >= 3 and max(holders[x]) != i for x in text.split("\n") if len(x) >= 20) for i, text in rows}
    assert {r["doc_id"]: r["n_dropped"] for r in index.apply(docs(spark, rows)).collect()} == drop
    shard = {bytes(r["key"]): r["s"] for r in index.counts.select("key", index._shard(index.shards).alias("s")).collect()}
    filters = {r["shard"]: r for r in index.filters.collect()}
    for key, s in shard.items():
        assert line_dedup.Cuckoo.load(filters[s]["n_buckets"], bytes(filters[s]["slots"])).contains([key])[0]


def test_line_dedup_stage_with_clashing_names(spark):
    d = docs(spark, [(i, "the same line in three documents\nown") for i in range(3)])
    for name in ("lost_id", "lost_keys", "_lost_id", "_Lost_Keys"):
        d = d.withColumn(name, F.lit(name))
    out = line_dedup.line_dedup_stage(d)
    assert out.columns == d.columns
    assert sorted((r["doc_id"], r["text"], r["_lost_id"], r["lost_keys"]) for r in out.collect()) == [
        (0, "own", "_lost_id", "lost_keys"), (1, "own", "_lost_id", "lost_keys"),
        (2, "the same line in three documents\nown", "_lost_id", "lost_keys")]
