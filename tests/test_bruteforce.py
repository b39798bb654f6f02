"""Spark operators against plain-Python loops written from the survey's text,
on random small inputs that include a hot user holding most rows."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pacegrid.operators import changes as I
from pacegrid.operators import rollups as R
from pacegrid.operators import sequences as W

AS_OF = dt.date(2024, 1, 20)
STATUSES = ["Solved", "Attempted", "Pending", "Skipped"]
CATS = ["DSA", "Aptitude", "Verbal", ""]
DIFFS = ["Easy", "Medium", "Hard", "High"]


def make_data(seed, n_users=12, hot_share=0.4):
    rnd = random.Random(seed)
    users = list(range(1, n_users + 1))
    probs = []
    for pid in range(300):
        u = 1 if rnd.random() < hot_share else rnd.choice(users)
        probs.append((pid, u, f"p{pid % 40}", rnd.choice(CATS), f"t{pid % 7}", rnd.choice(DIFFS),
                      rnd.choice(STATUSES), AS_OF + dt.timedelta(days=rnd.randint(-3, 3))))
    logs = {}
    for u in users:
        for back in range(1, rnd.choice([0, 3, 10, 40])):
            if rnd.random() < 0.9:
                logs[(u, AS_OF - dt.timedelta(days=back))] = rnd.randint(0, 3)
    return users, probs, [(u, d, s) for (u, d), s in logs.items()]


def py_streak(logs, u):
    by = {(x, d): s for x, d, s in logs}
    n, day = 0, AS_OF - dt.timedelta(days=1)
    for _ in range(365):
        if by.get((u, day), 0) >= 1:
            n += 1
            day -= dt.timedelta(days=1)
        else:
            break
    return n


def py_readiness(probs, logs, u):
    mine = [p for p in probs if p[1] == u]
    total = len(mine)
    solved = sum(1 for p in mine if p[6] == "Solved")
    cats = {}
    for p in mine:
        t, s = cats.get(p[3], (0, 0))
        cats[p[3]] = (t + 1, s + (p[6] == "Solved"))
    solved_pct = round(solved / total * 100) if total else 0
    with_solved = sum(1 for _, s in cats.values() if s > 0)
    cats_total = len(cats) if cats else 1
    cov = round(with_solved / cats_total * 100) if cats_total else 0
    return min(100, round(solved_pct * 0.60 + cov * 0.20 + min(py_streak(logs, u), 20)))


def frames(spark, users, probs, logs):
    u = spark.createDataFrame([(x, f"u{x}") for x in users], "id long, username string")
    p = spark.createDataFrame(probs, "id long, user_id long, name string, category string, topic string, "
                                     "difficulty string, status string, scheduled_date date")
    lg = spark.createDataFrame(logs, "user_id long, log_date date, problems_solved long")
    return u, p, lg


def test_readiness_and_streak_match_python(spark):
    for seed in (1, 2, 3):
        users, probs, logs = make_data(seed)
        u, p, lg = frames(spark, users, probs, logs)
        got = {r.user_id: (r.readiness, r.streak) for r in R.readiness(u, p, lg, AS_OF).collect()}
        want = {x: (py_readiness(probs, logs, x), py_streak(logs, x)) for x in users}
        assert got == want


def test_plan_generation_matches_python(spark):
    users, probs, logs = make_data(7, hot_share=0.7)
    _, p, _ = frames(spark, users, probs, logs)
    rank = {"Easy": 1, "Medium": 2}
    want = set()
    groups = {}
    for pr in probs:
        if pr[6] == "Pending":
            groups.setdefault((pr[1], pr[7]), []).append(pr)
    for (u, d), rows in groups.items():
        for i, pr in enumerate(sorted(rows, key=lambda r: (rank.get(r[5], 3), r[0]))):
            want.add((u, d, pr[0], i))
    got = {(r.user_id, r.plan_date, r.problem_id, r.order_index) for r in I.generate_plans(p).collect()}
    assert got == want


def test_import_add_matches_python(spark):
    users, probs, logs = make_data(11)
    _, p, _ = frames(spark, users, probs, logs)
    rnd = random.Random(5)
    tasks = [(i, rnd.choice(users), rnd.choice([" p1 ", "p2", "new", "", "p3"]), rnd.choice(["t1", "t2", "t9"]))
             for i in range(80)]
    stored = {(pr[1], pr[2], pr[4]) for pr in probs}
    want, seen = set(), set(stored)
    for seq, u, name, topic in tasks:
        name = name.strip()
        if not name:
            continue
        if (u, name, topic) in seen:
            continue
        seen.add((u, name, topic))
        want.add(seq)
    t = spark.createDataFrame(tasks, "seq long, user_id long, name string, topic string")
    got = {r.seq for r in I.import_add(p, t, "b").collect()}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["a", "b", "c"]), st.integers(0, 50)),
                min_size=1, max_size=25, unique_by=lambda x: x[2]))
def test_first_wins_properties(spark, rows):
    df = spark.createDataFrame([(s, k, u) for u, k, s in rows], "seq long, k string, u long")
    once = W.first_wins(df, ["u", "k"])
    got = sorted(map(tuple, once.collect()))
    want = {}
    for u, k, s in sorted(rows, key=lambda r: r[2]):
        want.setdefault((u, k), (s, k, u))
    assert got == sorted(want.values())
    assert sorted(map(tuple, W.first_wins(once, ["u", "k"]).collect())) == got


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 10_000))
def test_readiness_is_a_percentage(spark, seed):
    users, probs, logs = make_data(seed, n_users=5)
    u, p, lg = frames(spark, users, probs, logs)
    assert all(0 <= r.readiness <= 100 for r in R.readiness(u, p, lg, AS_OF).collect())


def test_import_twice_equals_import_once(spark):
    users, probs, logs = make_data(3)
    _, p, _ = frames(spark, users, probs, logs)
    t = spark.createDataFrame([(i, users[i % 3], f"x{i % 5}", "t") for i in range(20)],
                              "seq long, user_id long, name string, topic string")
    first = I.import_add(p, t, "b1")
    cols = ["user_id", "name", "topic"]
    after = p.select(*cols).unionByName(first.select(*cols))
    assert I.import_add(after, t, "b2").count() == 0
