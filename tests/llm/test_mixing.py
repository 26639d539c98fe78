"""Mixing against a plain walk over the sorted documents."""

import random
from fractions import Fraction
from math import floor

import pytest

from tests.llm import cases
from yore.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3), cap=3):
    """Water-filling in fractions. sizes: source -> words."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        level = Fraction(total - sum(cap * sizes[s] for s in held), sum(weight[s] for s in free)) if free else 0
        above = {s for s in free if cap * sizes[s] < weight[s] * level}
        if not above:
            return {s: cap * sizes[s] if s in held else weight[s] * level for s in order}
        held |= above


def plain_mix(rows, weights=(1, 2, 3), cap=3):
    """(doc_id, size, source_size, target, taken), sorted. rows: doc_id, text, source."""
    import re

    docs = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in rows]
    sizes = {}
    for _, n, s in docs:
        sizes[s] = sizes.get(s, 0) + n
    target, found = plain_targets(sizes, weights, cap), []
    for s, total in sizes.items():
        expected = min(floor(mixing.UNIT * float(target[s]) / total), cap * mixing.UNIT) if total else 0
        at = mixing.offset()
        for i, n, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (d[1], d[0] is not None, d[0] or 0)):
            found.append((i, n, total, float(target[s]), n * ((at + expected) // mixing.UNIT - at // mixing.UNIT)))
            at += expected
    return sorted(found, key=str)


def skewed(seed):
    rng = random.Random(seed)
    sources = ["a", "b", "Z", "é", "", None] + [f"s{i}" for i in range(8)]
    return [(i, cases.text(rng, rng.choice([1, 3, 10, 200]) if s != "b" else 300), s) for i in range(700) for s in [rng.choices(sources, [30, 1] + [2] * 12)[0]]]


@pytest.mark.parametrize("seed", range(3))
def test_against_a_walk(spark, seed):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    weights = [(1, 2, 3), (1,), (7, 1)][seed]
    mixed = mixing.mix(df, weights=weights)
    got = [tuple(r) for r in mixed.drop("copies").collect()]
    want = plain_mix(rows, weights)
    assert sorted((r[0], r[1], r[2], r[4]) for r in got) == sorted((r[0], r[1], r[2], r[4]) for r in want)
    assert sorted(r[3] for r in got) == pytest.approx(sorted(r[3] for r in want))
    by = {}
    for i, n, total, target, taken in got:
        of = by.setdefault({r[0]: r[2] for r in rows}[i], [target, 0, 0, total])
        of[1], of[2] = of[1] + taken, max(of[2], n)
        assert taken <= 3 * n
    assert all(abs(took - target) <= longest + 1 and target <= 3 * total + 1e-6 for target, took, longest, total in by.values())
    assert sum(x[0] for x in by.values()) == pytest.approx(sum(r[1] for r in got))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(df.repartition(3), weights=weights).collect()))  # runs agree, however the rows lie


def test_odd_rows(spark):
    rows = [(r[0], r[1], "s" if i % 3 else None) for i, r in enumerate(cases.documents())] + [(900, None, "empty"), (901, " ", "empty")]
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, source string, size long, k__ string")
    mixed = mixing.mix(df, keep=("text", "size", "k__"))
    assert mixed.columns == ["doc_id", "text", "k__", "size", "source_size", "target", "copies", "taken"]
    got = mixed.collect()
    assert sorted([(r.doc_id, r.size, r.source_size, r.taken) for r in got], key=str) == sorted([(r[0], r[1], r[2], r[4]) for r in plain_mix(rows)], key=str)
    whole = mixing.repeated(mixed)
    assert whole.columns == ["doc_id", "text", "k__"] and whole.count() == sum(r.copies for r in got)
    assert all(r.taken == 0 and r.target == 0 for r in got if r.doc_id in (900, 901))


def test_none_and_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(r) for r in mixing.mix(spark.createDataFrame([(1, None, None), (2, "", None)], schema)).select("size", "source_size", "target", "taken").collect()] == [(0, 0, 0.0, 0)] * 2
    same = [(1, "a b c", "s")] * 50 + [(2, "d", "t")]
    got = mixing.mix(spark.createDataFrame(same, schema)).collect()
    assert sorted((r.doc_id, r.copies) for r in got) == sorted((i, t // n) for i, n, _, _, t in plain_mix(same))


def test_targets_of_more_words_than_an_int_holds(spark):
    sizes = {"a": 900_000_000, "b": 500_000_000, "c": 300_000_000}
    got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {r.source: r.target for r in got.collect()} == {s: pytest.approx(float(t)) for s, t in plain_targets(sizes).items()}
