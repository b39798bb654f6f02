r"""Repair of conversation structure by an auction shortest-path algorithm.

Lattice.  A node is (row, state): states are nothing yet, after a system row, after a user row, after an assistant row.
Arcs are the edits: Keep 0, Rerole to user/assistant 2, Delete 3 (the only arc of a blank or duplicate row), Insert an
empty user/assistant 2 (stays on the row); a truncated row that is not deleted adds 1.  From a state each edit leads
to one node, so an audit, the string of the edits' initials, names its path.

Auction.  Every node has a price; p(i) <= cost(i, j) + p(j) holds throughout.  A path starts at the origin.  At its end i, if p(i) is
below the least cost(i, j) + p(j), the price rises to it and the path is contracted by one node; else it is extended along a
tight arc, the ASCII-least one.  When it ends at the last row, the origin's price is its distance; the prices are an optimal
dual, so all arcs of every cheapest path are tight, and the path that always took the least tight arc is the ASCII-least audit.
Prices start at what the rows must cost in any case.  Rows are taken in windows of ``WINDOW`` from the last to the first: the prices
that have converged at a window's first row are the prices of the terminals of the window before it.

Spark.  Rows are range-partitioned by (conversation, turn, role, text), so a crowded conversation is spread over partitions.  A
conversation that lies within one partition is solved where it is read.  The first and the last conversation of a partition may go on in others;
of those the partitions first find the distances between their four entry and four exit states, a fold of these small matrices
gives each its exit prices, then each traces its audits, and a fold of the entry states picks the one that counts.
Only the digest reads such a conversation row by row in one task, as a stream: SHA-256 cannot be put together from parts.

Rows with equal turns are ordered by role and text (the contract leaves ties open; copies are adjacent); equal rows are kept as one row
with a count until they are edited, so they must fit neither a task nor an array.  Nulls are read as one space; a null turn
sorts first; null conversation ids form one conversation.  An empty role has no initial: such a row can be reroled or
deleted.  Empty texts are blank.  A conversation of which no row is left has zeros, an empty audit and the digest of the empty string.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 16             # rows between two converged sets of prices
BIG = 1 << 60
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: Cost and edits from each state to an accepted end after the last row.
END = ((0, ""), (4, "II"), (2, "I"), (0, ""))
_BY_INITIAL = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}

OUT = ("conv_id long, part int, pos long, turn long, role string, text string, copies long, fault string, "
       "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


# ---- the auction ----

def _arcs(fault: str, initial: str):
    """For each state the arcs (edit, cost, rows, state) in the order of their letters."""
    must = fault in ("blank", "duplicate")
    extra = int(fault == "truncated")
    out = []
    for state in range(4):
        arcs = [("D", 3, 1, state), ("I", 2, 0, _NEXT[state])]
        if not must:
            kept = _BY_INITIAL.get(initial, {}).get(state)
            if kept is not None:
                arcs.append(("K", extra, 1, kept))
            arcs.append(("R", 2 + extra, 1, _NEXT[state]))
        out.append(arcs)
    return out


_TABLE = {(f, i): _arcs(f, i) for f in ("blank", "duplicate", "truncated", "") for i in ("s", "u", "a", "")}
_LEAST = {"blank": 3, "duplicate": 3, "truncated": 1, "": 0}


def arcs_of(fault: str, role: str):
    return _TABLE[fault, role[:1] if role[:1] in ("s", "u", "a") else ""]


def auction(rows: list, price: list[int], origin: int) -> tuple[str, int] | None:
    """Cheapest ASCII-least path from state ``origin`` of the first of ``rows`` (arcs by state): (audit, state at the end).

    ``price`` holds four numbers a row and four at the end, whose values are fixed; it is raised in place.
    None: no path to an end with a finite price.
    """
    end = 4 * len(rows)
    limit = max((p for p in price[end:] if p < BIG), default=0) + 4 * len(rows) + 8  # no distance is longer
    path, letters = [origin], []
    while path[-1] < end:
        i = path[-1]
        row = i >> 2
        least, step = BIG, None
        for letter, cost, rows_on, state in rows[row][i & 3]:
            j = 4 * (row + rows_on) + state
            if cost + price[j] < least:
                least, step = cost + price[j], (letter, j)
        if least > limit:
            least = BIG
        if price[i] < least:            # contract
            price[i] = least
            if i != origin or len(path) > 1:
                path.pop()
                letters.pop()
        elif least >= BIG:
            return None
        else:                           # extend
            path.append(step[1])
            letters.append(step[0])
    return "".join(letters), path[-1] & 3


def converge(kinds: list[tuple[str, str]], exits: list[int], origins=range(4)):
    """Prices of all windows, from the last to the first: [(arcs of its rows, prices)], and the prices of ``origins`` at the first row."""
    windows = []
    after = list(exits)
    starts = list(range(0, len(kinds), WINDOW))
    for lo in reversed(starts):
        rows = [arcs_of(*k) for k in kinds[lo:lo + WINDOW]]
        need = [_LEAST[f] for f, _ in kinds[lo:lo + WINDOW]]
        low = min(after)
        price = []
        for k in range(len(rows)):
            price += [low + sum(need[k:])] * 4
        price += after
        for origin in origins if lo == 0 else range(4):
            if auction(rows, price, origin) is None:
                price[origin] = BIG
        windows.append((rows, price))
        after = price[:4]
    return windows[::-1], after


def trace(windows: list, origin: int) -> tuple[str, int]:
    """The ASCII-least audit over converged windows and the state at the end."""
    audit, state = [], origin
    for rows, price in windows:
        step = auction(rows, price, state)
        if step is None:
            return "", -1
        audit.append(step[0])
        state = step[1]
    return "".join(audit), state


def cheapest_audit(kinds: list[tuple[str, str]]) -> str:
    """Edits of a whole conversation; ``kinds``: (fault, role) of its rows."""
    windows, _ = converge(kinds, [c for c, _ in END], (NOTHING,))
    audit, state = trace(windows, NOTHING)
    return audit + END[state][1]


# ---- rows ----

class _Reader:
    """Faults, edits and digest of one conversation, row by row."""

    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.turns, self.last_turn, self.span = 0, None, [None, None]
        self.before = None
        self.state, self.audit = NOTHING, []
        self.digest, self.lines = hashlib.sha256(), 0

    def count(self, turn, role, fault, copies=1):
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.last_turn = turn
            self.span = [turn if self.span[0] is None else self.span[0], turn]
        for k in range(copies):
            if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
                self.n["illegal"] += 1
            self.before = role[:1]
            if name := _copy_fault(fault, k):
                self.n[name] += 1

    def _say(self, role, text):
        line = f"{role}:{text}"
        self.digest.update((line if not self.lines else "\n" + line).encode("utf-8", "surrogatepass"))
        self.lines += 1

    def edit(self, letter, row=None):
        """``row``: (role, text, fault) of the row that the edit takes, none for Insert."""
        self.audit.append(letter)
        if letter == "D":
            self.n["cost"] += 3
            return
        if letter == "I":
            self.n["cost"] += 2
            self.state = _NEXT[self.state]
            self._say(ROLE[self.state], "")
            return
        role, text, fault = row
        self.n["cost"] += (2 if letter == "R" else 0) + (fault == "truncated")
        self.state = _NEXT[self.state] if letter == "R" else _BY_INITIAL[role[:1]][self.state]
        self._say(ROLE[self.state] if letter == "R" else role, text)

    def rows(self, letters, rows):
        """Applies the edits ``letters`` (an iterator) to ``rows`` (role, text, copies, fault)."""
        for role, text, copies, fault in rows:
            for k in range(copies):
                letter = next(letters)
                while letter == "I":
                    self.edit("I")
                    letter = next(letters)
                self.edit(letter, (role, text, _copy_fault(fault, k)))

    def result(self):
        gaps = 0 if self.span[0] is None else self.span[1] - self.span[0] + 1 - self.turns
        return {"gaps": gaps, **{k: self.n[k] for k in ("blank", "duplicate", "truncated", "illegal", "cost")},
                "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


def _copy_fault(fault: str, k: int) -> str:
    return fault if k == 0 or fault == "blank" else "duplicate"


def _kinds(rows):
    return [(_copy_fault(fault, k), role) for role, _, copies, fault in rows for k in range(copies)]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, equal rows as one: (conv_id, turn, role, text, copies)."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat(*(x for c in ("conv_id", "turn") for x in (F.coalesce(F.col(c).cast("string"), F.lit(" ")), F.lit(":"))[:1 + (c == "conv_id")]))
    rows = rows.withColumn("harm", F.crc32(key.cast("binary")) % 20).filter("harm <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("harm") == 1, F.lit("")).when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("harm") == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("n"),
    ).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: that of the first of equal rows ('', blank, duplicate, truncated)."""
    said = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    rows = rows.withColumn("said", said).withColumn("at", turn)
    first = rows.groupBy(F.col("conv_id").alias("_conv"), F.col("said").alias("_said")).agg(F.min("at").alias("first"))
    joined = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["said"] == first["_said"]))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    fault = (F.when(blank, "blank").when(F.col("at") > F.col("first"), "duplicate").when(~ended, "truncated").otherwise(""))
    return joined.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


# ---- conversations within a partition ----

_ROW = ("turn", "role", "text", "copies", "fault")


def _solved(conv_id, rows) -> dict:
    reader = _Reader()
    for turn, role, _, copies, fault in rows:
        reader.count(turn, role, fault, copies)
    short = [r[1:] for r in rows]
    letters = iter(cheapest_audit(_kinds(short)))
    reader.rows(letters, short)
    for letter in letters:
        reader.edit(letter)
    return {"conv_id": conv_id, **reader.result()}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = [c.strip().split(" ") for c in OUT.split(",")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.record_batch([pa.array([r.get(n) for r in rows], types[t]) for n, t in kinds], names=[n for n, _ in kinds])


def _flushed(rows, most: int = 2_000):
    out = []
    size = 0
    for r in rows:
        out.append(r)
        size += len(r.get("text") or "") + len(r.get("audit") or "")
        if len(out) >= most or size > 4_000_000:
            yield _batch(out)
            out, size = [], 0
    if out:
        yield _batch(out)


def _solve_partition(batches):
    """Results of the conversations that lie within the partition; the rows of its first and last one as they are (part, pos)."""
    part = TaskContext.get().partitionId()

    def rows():
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("conv_id", *_ROW)]
            yield from zip(*cols)

    def opened(conv_id, pos, row):
        return {"conv_id": conv_id, "part": part, "pos": pos, **dict(zip(_ROW, row))}

    def results():
        first, conv, held, pos = True, None, [], 0
        begun = False
        for conv_id, *row in rows():
            if begun and conv_id != conv:
                if not first:
                    yield _solved(conv, held)
                first, held, pos = False, [], 0
            begun, conv = True, conv_id
            if first:
                yield opened(conv, pos, row)
                pos += 1
            else:
                held.append(row)
        for k, row in enumerate(held):
            yield opened(conv, k, row)

    return _flushed(results())


# ---- conversations that may lie in several partitions ----

def _piece_kinds(pdf: pd.DataFrame):
    pdf = pdf.sort_values("pos")
    return _kinds(list(zip(pdf["role"], pdf["text"], pdf["copies"], pdf["fault"])))


def _piece_matrix(pdf: pd.DataFrame) -> pd.DataFrame:
    """Distances from the four entry to the four exit states of a piece."""
    kinds = _piece_kinds(pdf)
    costs = np.full((4, 4), BIG, np.int64)
    for e in range(4):
        _, at = converge(kinds, [0 if k == e else BIG for k in range(4)])
        costs[:, e] = at
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "part": pdf["part"].iloc[:1], "costs": [costs.ravel().tolist()]})


def _exit_prices(pdf: pd.DataFrame) -> pd.DataFrame:
    """Prices at the end of every piece of a conversation, from the last to the first."""
    pdf = pdf.sort_values("part", ascending=False)
    price, out = [c for c, _ in END], []
    for costs in pdf["costs"]:
        out.append(price)
        m = np.minimum(np.array(costs, np.int64).reshape(4, 4) + np.array(price, np.int64), BIG)
        price = m.min(axis=1).tolist()
    return pd.DataFrame({"conv_id": pdf["conv_id"].array, "part": pdf["part"].array, "prices": out})


def _piece_audits(pdf: pd.DataFrame, prices: pd.DataFrame) -> pd.DataFrame:
    """The audit of a piece from each entry state, and the state at its end."""
    windows, _ = converge(_piece_kinds(pdf), [int(x) for x in prices["prices"].iloc[0]])
    found = [trace(windows, s) for s in range(4)]
    return pd.DataFrame({"conv_id": pdf["conv_id"].iloc[:1], "part": pdf["part"].iloc[:1],
                         "audits": [[a for a, _ in found]], "states": [[s for _, s in found]]})


def _chosen(pdf: pd.DataFrame) -> pd.DataFrame:
    """The audit of every piece on the path that starts at the conversation's beginning."""
    pdf = pdf.sort_values("part")
    state, out = NOTHING, []
    for audits, states in zip(pdf["audits"], pdf["states"]):
        out.append(audits[state])
        state = states[state]
    out[-1] += END[state][1]
    return pd.DataFrame({"conv_id": pdf["conv_id"].array, "part": pdf["part"].array, "audit": out})


def _read_open(batches):
    """Results of conversations whose pieces come in order, each behind a row with its audit (pos -1)."""

    def results():
        reader, conv, letters = None, None, iter("")
        for b in batches:
            for conv_id, part, pos, turn, role, text, copies, fault in zip(
                    *(b.column(c).to_pylist() for c in ("conv_id", "part", "pos", *_ROW))):
                if pos < 0:
                    for letter in letters:
                        reader.edit(letter)
                    if reader is None or conv_id != conv:
                        if reader is not None:
                            yield {"conv_id": conv, **reader.result()}
                        reader, conv = _Reader(), conv_id
                    letters = iter(text)
                    continue
                reader.count(turn, role, fault, copies)
                reader.rows(letters, [(role, text, copies, fault)])
        if reader is not None:
            for letter in letters:
                reader.edit(letter)
            yield {"conv_id": conv, **reader.result()}

    return _flushed(results())


def _open_results(rows: DataFrame) -> DataFrame:
    keys = ["conv_id", "part"]
    rows = rows.select("conv_id", "part", "pos", *_ROW)
    id_type = "conv_id long, part int"
    costs = rows.groupBy(keys).applyInPandas(_piece_matrix, f"{id_type}, costs array<long>")
    prices = costs.groupBy("conv_id").applyInPandas(_exit_prices, f"{id_type}, prices array<long>")
    audits = rows.groupBy(keys).cogroup(prices.groupBy(keys)).applyInPandas(
        _piece_audits, f"{id_type}, audits array<string>, states array<int>")
    chosen = audits.groupBy("conv_id").applyInPandas(_chosen, f"{id_type}, audit string")
    heads = chosen.select("conv_id", "part", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn"),
                          F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit("").alias("fault"))
    ordered = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.mapInArrow(_read_open, OUT).select("conv_id", *RESULT)


def repair(conversations: DataFrame) -> DataFrame:
    """The contract of op11: faults, cost, audit and digest of the repaired rows of every conversation."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    keys = ["conv_id", "turn", "role", "text"]
    rows = stored(with_faults(damaged(conversations)), "rows")
    solved = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_solve_partition, OUT), "solved")
    done = solved.filter("part is null").select("conv_id", *RESULT)
    results = done.unionByName(_open_results(solved.filter("part is not null")))
    results = results.withColumnRenamed("conv_id", "_conv")
    empty = hashlib.sha256().hexdigest()
    return (ids.join(results, ids["conv_id"].eqNullSafe(results["_conv"]), "left").drop("_conv")
            .fillna(0, RESULT[:6]).fillna({"audit": "", "repaired_sha256": empty}))
