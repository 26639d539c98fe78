"""Operators against plain Python on random rows with ties, nulls and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from yore.operators import components, groups, intervals, links, near, pages, runs

RNG = random.Random(11)


def test_points_within_a_distance(spark):
    rows = [(i, RNG.randint(0, 3), RNG.randint(0, 400)) for i in range(80)] + [(99, 1, None)]
    anchors = [(RNG.randint(0, 3), RNG.randint(0, 400)) for _ in range(40)] + [(1, None)]
    a = spark.createDataFrame(rows, "id int, k int, t long")
    b = spark.createDataFrame(anchors, "k int, p long")
    for width in (0, 1, 7, 50):
        for shift in (-width, 1, 0):
            got = {r.id: r.near for r in near.has_point_within(a, b, F.col("t") + shift, width, "p", ["k"]).collect()}
            want = {i: t is not None and any(k == j and p is not None and t + shift <= p <= t + shift + width for j, p in anchors) for i, k, t in rows}
            assert got == want
    assert near.has_point_within(a, b.limit(0), F.col("t"), 5, "p").filter("near").count() == 0


def test_overlap_counts(spark):
    rows = [(i, RNG.randint(0, 2), s := RNG.randint(0, 300), s + RNG.randint(0, 60)) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, k int, s long, e long")
    for width in (10, 1000):
        got = {r.id: r.overlaps for r in near.count_overlapping(df, df, "s", "e", width, ["k"]).collect()}
        assert got == {i: sum(k == j and s2 <= e and e2 >= s for _, j, s2, e2 in rows) for i, k, s, e in rows}


def test_as_of(spark):
    facts = [(RNG.randint(0, 2), RNG.randint(0, 100), RNG.randint(0, 9)) for _ in range(40)]
    rows = [(i, RNG.randint(0, 3), RNG.randint(0, 120)) for i in range(60)]
    for width in (5, 1000):
        found = near.as_of(spark.createDataFrame(rows, "id int, k int, t long"), spark.createDataFrame(facts, "k int, since long, v int"), ["k"], "t", "since", ["v"], width)
        want = {i: max(((s, v) for j, s, v in facts if j == k and s <= t), default=(None, None))[1] for i, k, t in rows}
        assert {r.id: r.v for r in found.collect()} == want


def test_links(spark):
    rows, edges = [(i,) for i in range(6)], [(0, 1), (0, None), (1, 5), (1, 0), (2, None), (4, 7)]
    a, b = spark.createDataFrame(rows, "id int"), spark.createDataFrame(edges, "id int, x int")
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(links.having(a, b, ["id"])) == [0, 1, 2, 4] and ids(links.having(a, b, ["id"], no=True)) == [3, 5]
    assert ids(links.counted(a, b, ["id"], "<=", 0)) == [3, 5] and ids(links.counted(a, b, ["id"], ">", 1)) == [0, 1]
    assert ids(links.every(a, b, ["id"], F.col("x") > 0)) == [0, 2, 4]  # null neither passes nor fails
    assert ids(links.either(a, [(b.filter("x = 7"), ["id"]), (b.filter("x = 5"), ["id"])])) == [1, 4]


def brute_episodes(rows, gap):
    out = {}
    for k in sorted({r[0] for r in rows}):
        group, far = [], None
        for s, e, label in sorted((s, e, label) for j, s, e, label in rows if j == k):
            if far is not None and s - far > gap:
                out.setdefault(k, []).append(group)
                group = []
            group.append((s, e, label))
            far = e if far is None else max(far, e)
        out.setdefault(k, []).append(group)
    best = lambda g: min({x[2] for x in g}, key=lambda v: (-sum(y[2] == v for y in g), v))
    return sorted((k, g[0][0], max(x[1] for x in g), len(g), best(g)) for k, gs in out.items() for g in gs)


def test_episodes(spark):
    rows = [(RNG.randint(0, 2), s := RNG.randint(0, 500), s + RNG.randint(0, 30), RNG.choice("abc")) for _ in range(90)]
    df = spark.createDataFrame(rows, "k int, s long, e long, l string")
    for width in (20, 10_000):
        got = groups.episodes(df, "s", "e", 5, "l", ["k"], width).collect()
        assert sorted((r.k, r.start, r.end, r["count"], r.label) for r in got) == brute_episodes(rows, 5)


def brute_runs(rows, many):
    """A sequential walk over each chain."""
    out = []
    for c in sorted({r[0] for r in rows}):
        chain = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2], r[3] is not None, r[4], r[3] or ""))
        for value in sorted({r[3] for r in chain if r[3] is not None}) if many else [None]:
            own = [r for r in chain if not many or r[3] in (None, value)]
            confirmed = {}
            for r in own:
                if r[3] is not None:
                    confirmed.setdefault(r[1], set()).add(r[3])
            current, last, made, marked = None, None, [], None
            for r in own:
                if r[3] is None:
                    if last is None and marked is None:
                        marked = r[1]
                    if last is not None and last in confirmed.get(r[1], ()):
                        continue
                    if current:
                        current["to"] = r[1]
                    current = None
                elif current and current["v"] == r[3]:
                    current["rows"].append(r)
                    last = r[3]
                else:
                    if current:
                        current["to"] = r[1]
                    current = {"v": r[3], "rows": [r], "to": None}
                    made.append(current)
                    last = r[3]
            for i, m in enumerate(made):
                first = m["rows"][0]
                known = i > 0 or first[5] == 1 or first[1] != first[2] or (marked is not None and marked < first[1])
                out.append((c, m["v"], first[1] if known else None, m["to"], first[1], len(m["rows"])))
    return sorted(out, key=str)


@pytest.mark.parametrize("many", [False, True])
def test_runs(spark, many):
    rng = random.Random(3)
    rows = []
    for c in range(400):
        for a in range(rng.randint(1, 7)):
            at = rng.randint(0, 4)
            rows.append((c, at, at + rng.choice([0, 0, 1]), rng.choice(["x", "y", "z", None, None]), a, rng.choice([0, 0, 1])))
    df = spark.createDataFrame(rows, "c int, valid_at long, observed_at long, value string, action int, grade int")
    got = runs.runs(df, ["c"], many).collect()
    assert sorted(((r.c, r.value, r.period_from, r.period_to, r.first_valid, r.n) for r in got), key=str) == brute_runs(rows, many)
    assert runs.runs(df.limit(0), ["c"], many).count() == 0


def test_scopes_agree_with_their_meaning(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate([(None, None), (None, 5), (3, None), (3, 5), (6, 8)])]
    df = spark.createDataFrame(rows, "id int, a long, b long")
    lo, hi = float("-inf"), float("inf")
    for scope, x, y in (("at", 4, None), ("at", 5, None), ("during", 5, 6), ("throughout", 3, 4), ("before", 5, None), ("after", 3, None), ("current", None, None), ("past", None, None), ("ever", None, None)):
        def holds(a, b):
            s, e = lo if a is None else a, hi if b is None else b
            return {"at": lambda: s <= x < e, "during": lambda: s <= y and e > x, "throughout": lambda: s <= x and e > y, "before": lambda: b is not None and b <= x, "after": lambda: a is not None and a >= x, "current": lambda: b is None, "past": lambda: b is not None, "ever": lambda: True}[scope]()

        got = {r.id for r in df.filter(intervals.valid(F.col("a"), F.col("b"), scope, x, y)).collect()}
        assert got == {i for i, a, b in rows if holds(a, b)}, scope
    with pytest.raises(ValueError):
        intervals.valid(F.col("a"), F.col("b"), "sometimes")


def test_entities_are_connected_components(spark):
    rng = random.Random(8)
    rows = [(i, [f"k{rng.randint(0, 90)}" for _ in range(rng.randint(1, 3))]) for i in range(80)] + [(200 + i, [f"c{i}", f"c{i + 1}"]) for i in range(60)] + [(300, []), (301, None)]
    got = {r.record: r.entity for r in components.resolve(spark.createDataFrame(rows, "record int, keys array<string>"), "record", "keys").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for _, keys in rows:
        for k in keys or []:
            a, b = sorted((find(keys[0]), find(k)))
            parent[b] = a
    assert got == {i: find(keys[0]) for i, keys in rows if keys}


def test_gate_and_registers(spark):
    rows = [("a", "1", 5), ("b", "1", 3), ("b", "1", 3), ("c", "2", 1), ("d", "1", 3)]
    got = {r.cid: r.kind for r in runs.gate(spark.createDataFrame(rows, "cid string, claim string, at int"), "cid", "claim", "at").collect()}
    assert got == {"a": "confirm", "b": "assert", "c": "assert", "d": "confirm"}
    seen = [("k", 2, "x", 1, 9, None), ("k", 1, "y", 4, None, 7), ("k", 3, "z", None, 3, 8), ("m", 1, "w", None, None, None)]
    found = {r.key: tuple(r) for r in runs.registers(spark.createDataFrame(seen, "key string, n int, who string, lo int, hi int, till int"), ["key"], ["n"], ["who"], "lo", "hi", "till").collect()}
    assert found == {"k": ("k", "y", 4, 3, 8, 3, True), "m": ("m", "w", None, None, None, 1, False)}


def test_pages(spark):
    rows = [(i, i % 3) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, t int")
    order, first = [F.desc("t"), F.desc("id")], []
    cursor = None
    while True:
        got = [tuple(r) for r in pages.page(df, order, 4, cursor).collect()]
        first += got[:4]
        if len(got) <= 4:
            break
        cursor = pages.after_key([("t", True), ("id", True)], [got[3][1], got[3][0]])
    assert first == sorted(rows, key=lambda r: (-r[1], -r[0]))
    assert len(pages.page(df, order, 0).collect()) == 10


def test_entities_of_records_that_come_once_are_the_same(spark):
    rng = random.Random(5)
    rows = [(f"r{i}", [f"k{rng.randint(0, 60)}" for _ in range(rng.randint(1, 3))]) for i in range(60)] + [(f"own{i}", [f"own{i}"]) for i in range(40)] + [("none", []), ("null", None)]
    records = spark.createDataFrame(rows, "record string, keys array<string>")
    told = lambda **how: sorted(map(tuple, components.resolve(records, "record", "keys", **how).collect()))
    assert told(once=True) == told() and len(told()) == 100
