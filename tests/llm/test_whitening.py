"""Whitening against numpy on the driver, in exact numbers where they are asked for."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from yore.llm import whitening

DIR = "/root/testdata/sf0.001"


def plain(vectors, components=32):
    """(n, deviations, whitened, explained) of whole vectors without nulls."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    y = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    return n, [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum()


def compare(rows, explained, error, vectors, components=32):
    n, deviation, want, share = plain(vectors, components)
    rows = sorted(rows, key=lambda r: r[0])
    got = np.array([r.whitened for r in rows])
    assert [r.n for r in rows] == [n] * n and [int(r.deviation) for r in rows] == deviation
    sign = np.sign((got * want).sum(0))
    assert got.shape == want.shape and np.abs(got * sign - want).max() < 1e-8 and np.abs(explained - share).max() < 1e-10
    assert error < 1e-9 and np.abs(np.cov(got.T, bias=True) - np.eye(got.shape[1])).max() < 1e-9


@pytest.mark.parametrize("tile", [1, 5, 32, 64])
def test_tiles_of_any_size(spark, tile, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 100)  # many row blocks
    rng = random.Random(3)
    axes = [[rng.gauss(0, 1) for _ in range(11)] for _ in range(11)]
    vectors = [[sum(a * b * (j + 1) for j, (a, b) in enumerate(zip(z, ax, strict=True))) for ax in axes] for z in ([rng.gauss(0, 1) for _ in range(11)] for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    rows, explained, error = whitening.whiten(df, components=7, tile=tile)
    compare(rows.collect(), explained, error, vectors, 7)


def test_odd_rows(spark):
    rng = random.Random(5)
    sound = [(i, [rng.gauss(0, 1) for _ in range(4)], 0) for i in range(50)] + [(60, [0.5, 0.25, 0.0, -1.0], 1)] * 2
    odd = [(100, None, 0), (101, [1.0, None, 0.0, 0.0], 0), (102, [math.nan] + [0.0] * 3, 0), (103, [math.inf] + [0.0] * 3, 0), (104, [1e300] + [0.0] * 3, 0), (105, [1.0, 2.0], 0), (106, [], 0)]
    df = spark.createDataFrame([*sound, *odd, (None, [0.1, 0.2, 0.3, 0.4], 0)], "vec_id long, embedding array<double>, whitened long").repartition(3)
    rows, explained, error = whitening.whiten(df)
    got = rows.collect()
    assert sorted((r.vec_id for r in got), key=str) == sorted([*range(50), 60, 60, None], key=str)
    assert len(explained) == 4 and abs(sum(explained) - 1) < 1e-9 and error < 1e-9
    want = dict(zip([x[0] for x in sound] + [None], plain([x[1] for x in sound] + [[0.1, 0.2, 0.3, 0.4]])[1], strict=True))
    assert all(int(r.deviation) == want[r.vec_id] for r in got)


def test_nothing_to_scale(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [0.5, 1.0])], [(1, [0.5, 1.0])] * 3, [(1, [])]):
        found, explained, error = whitening.whiten(spark.createDataFrame(rows, schema))
        assert len(explained) == 0 and error == 0 and all(r.whitened == [] and r.deviation == 0 for r in found.collect())
    found, explained, _ = whitening.whiten(spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 2.0])], schema))
    assert len(explained) == 1 and abs(explained[0] - 1) < 1e-12 and sorted(abs(r.whitened[0]) for r in found.collect()) == pytest.approx([1, 1])


def test_the_query(spark):
    found = whitening.op12_whiten(spark, DIR).toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").toPandas()
    n, deviation, want, share = plain(table.embedding.tolist())
    got = found.whitened.to_numpy().reshape(n, 32)
    assert found.component.tolist() == [*range(1, 33)] * n and found.deviation.tolist() == [d for d in deviation for _ in range(32)]
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-7 and found.identity_error.nunique() == 1 and found.identity_error.iloc[0] < 1e-4
    assert np.allclose(found.explained.to_numpy().reshape(n, 32), share, rtol=1e-6) and set(found.n) == {n}
