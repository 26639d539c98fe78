"""Periodic runs against a plain search for every period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from yore.llm import periodic

DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    """For every period, stretches in which words so far apart are equal."""
    n, found = len(words), []
    named = {w: i for i, w in enumerate(dict.fromkeys(words))}
    a = np.array([named[w] for w in words])
    for q in range(1, n // exponent + 1):
        steps = np.diff(np.concatenate(([0], (a[q:] == a[:-q]).astype(int), [0])))
        for s, e in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist(), strict=True):
            size = e - s + q
            if size >= max(least, exponent * q) and not any(q % d == 0 and (a[s + d : s + size] == a[s : s + size - d]).all() for d in range(1, q)):
                found.append((s, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """What op11 must return for a document."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(runs), *top, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(0, 30)), max_size=4))
def test_runs_of_any_texts(parts):
    texts = [a + (b * 30)[:n] + a[::-1] for a, b, n in parts]
    for least, exponent in ((6, 4), (2, 2), (3, 3), (10, 2)):
        assert periodic.runs_of_texts(texts, least, exponent) == [plain_runs(t, least, exponent) for t in texts]


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 800:
        a, b = b, b + a
    assert periodic.runs_of_texts([b], 2, 2) == [plain_runs(b, 2, 2)]


def test_long_texts_and_strings_of_many_pieces(monkeypatch):
    rng = random.Random(4)
    word = lambda: "w%d" % rng.randrange(400)
    unit = [word() for _ in range(700)]
    text = [word() for _ in range(3000)] + unit * 5 + [word() for _ in range(2000)] + ["x"] * 4000 + ["a", "b"] * 3
    runs = periodic.runs_of_texts([text])[0]
    assert (3000, 3500, 700) in runs and any(r[1:] == (4000, 1) for r in runs) and runs == plain_runs(text)
    texts = [[rng.choice("ab") for _ in range(rng.randint(0, 60))] for _ in range(60)]
    monkeypatch.setattr(periodic, "STRING", 50)
    assert periodic.runs_of_texts(texts) == [plain_runs(t) for t in texts]
    assert periodic.runs_of_texts([["a"] * 100_000]) == [[(0, 100_000, 1)]]


def test_odd_rows(spark):
    rows = [*cases.documents(), (700, "a b " * 40 + "c", "en", 1), (701, "x y \x85 " * 9, "en", 1)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).selectExpr("doc_id", "text", "spans AS runs", "lang AS n_words", "spans AS other")
    found = periodic.find(docs).collect()
    assert sorted(found[0].asDict()) == ["collapsed", "doc_id", "n_words", "other", "runs", "text"] and len(found) == len(rows)
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert r.n_words == len(words) and [tuple(x) for x in r.runs] == plain_runs(words), r.doc_id
    by = {r.doc_id: r for r in found}
    assert by[700].collapsed == "a b c" and by[405].collapsed == "ab" and by[401].collapsed == "" and by[701].runs[0].period == 2
    none = periodic.find(docs.limit(0))
    assert none.count() == 0 and "collapsed" in none.columns


def test_the_query(spark):
    found = sorted((tuple(r) for r in periodic.op11_runs(spark, DIR).collect()), key=lambda r: r[0])
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    assert found == sorted(digest(*r) for r in docs) and sum(r[1] > 0 for r in found) > 10


@pytest.mark.parametrize("rows", [[], [(None, "a a a a a a a"), (10, None), (10, None), (-3, ""), (7, " \n")]])
def test_the_query_over_odd_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r) for r in periodic.op11_runs(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == sorted((digest(*r) for r in rows), key=str)
