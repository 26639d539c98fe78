import hashlib
import random

import numpy as np
import pytest

from tests.llm.cases import SCHEMA, documents
from yore.llm import suffix


def brute(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = {}
    for b in data:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] = count.get(b[i : i + length], 0) + 1
    out = []
    for b in data:
        hit = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        on = np.cumsum(hit)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~on])
        out.append((len(b), int(on.sum()), int((np.diff(np.concatenate(([0], on.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_matches_brute_force(spark, most):
    rows = documents()
    found = suffix.remove(spark.createDataFrame(rows, SCHEMA), digest=True, most=most).collect()
    want = brute([r[1] for r in rows])
    assert sorted((str(r[0]), *w) for r, w in zip(rows, want)) == sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)


def test_spans_keep_the_other_columns(spark):
    rows = documents(2)[:50]
    found = suffix.remove(spark.createDataFrame(rows, SCHEMA))
    assert found.columns == ["doc_id", "text", "lang", "n_bytes", "n_removed", "n_spans", "spans", "kept"]
    for r in found.collect():
        data = (r.text or "").encode()
        assert sum(s.end - s.start for s in r.spans) == r.n_removed == len(data) - len(r.kept)


def test_empty_table(spark):
    assert suffix.remove(spark.createDataFrame([], SCHEMA), digest=True).collect() == []


def test_pieces_of_long_texts_find_the_same_anchors(monkeypatch):
    data = np.random.default_rng(3).integers(97, 101, 50_000, dtype=np.uint8)
    whole = suffix.Anchors().find(data, halves=True)
    monkeypatch.setattr(suffix, "CHUNK", 4096)
    parts = suffix.Anchors().find(data, halves=True)
    assert set(whole[0].tolist()) <= set(parts[0].tolist())
    at = np.searchsorted(parts[0], whole[0])
    assert all(np.array_equal(a, b[at]) for a, b in zip(whole, parts))


def test_maximal_repeats_are_all_groups_with_diverse_sides():
    rng = random.Random(5)
    for _ in range(200):
        contexts = [(bytes(rng.choices(b"ab", k=rng.randint(0, 6))), bytes(rng.choices(b"ab", k=rng.randint(0, 6)))) for _ in range(rng.randint(2, 7))]
        need = rng.randint(0, 6)
        got = {(tuple(sorted(m)), l, r) for m, l, r in suffix.maximal_repeats(contexts, need)}
        want = set()
        for i in range(len(contexts)):
            for j in range(i):
                l, r = (suffix.shared(contexts[i][k], contexts[j][k]) for k in (0, 1))
                if l + r >= need:
                    same = lambda x: all(contexts[x][k][:n] == contexts[i][k][:n] and len(contexts[x][k]) >= n for k, n in ((0, l), (1, r)))
                    want.add((tuple(x for x in range(len(contexts)) if same(x)), l, r))
        assert got == want


def test_groups_hold_equal_strings(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(documents(), SCHEMA)
    found = suffix.repeat_groups(docs).join(docs.select(F.xxhash64("text").alias("k_a"), "text").dropDuplicates(["k_a"]), "k_a").collect()
    strings = {}
    for r in found:
        strings.setdefault((r.h, r.side, r.half, r.repeat), []).append(r.text.encode()[r.start : r.end])
        strings[r.h, r.side, r.half, r.repeat] += [r.text.encode()[r.last_start : r.last_start + r.end - r.start]] * (r.times > 1)
    assert strings and all(len(set(x)) == 1 and len(x) > 1 and len(x[0]) >= 200 for x in strings.values())


@pytest.mark.parametrize("most", [1000, 1])
def test_groups_miss_no_occurrence(spark, most):
    """Every string of 20 bytes that occurs twice is in a group with all its places."""
    from collections import defaultdict

    rng = random.Random(9)
    piece = ["".join(rng.choices("abc ", k=30)) for _ in range(12)]
    texts = ["".join(rng.choices("abcd ", k=rng.randint(0, 40))).join(rng.choices(piece, k=rng.randint(1, 5))) for _ in range(40)]
    texts += [texts[0], texts[1], texts[1] + "x", "-" * 150, "y" + "-" * 90, "=+" * 60, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hashes = {r.text: r.k for r in docs.selectExpr("text", "xxhash64(text) k").collect()}
    places = defaultdict(set)
    for t in set(texts) - {None}:
        for p in range(len(t) - 19):
            places[t[p : p + 20]].add((hashes[t], p))
    text_of, said = {k: t for t, k in hashes.items()}, defaultdict(set)
    for r in suffix.repeat_groups(docs, length=20, gram=6, most=most).collect():
        step = (r.last_start - r.start) // (r.times - 1) if r.times > 1 else 0
        for i in range(r.times):
            for o in range(r.end - r.start - 19):
                said[r.h, r.side, r.half, r.repeat, o].add((r.k_a, r.start + i * step + o))
    best = {}
    for group in said.values():
        k, p = next(iter(group))
        w = text_of[k][p : p + 20]
        best[w] = max(best.get(w, 0), len(group))
        assert group <= places[w]
    counts = defaultdict(int)
    for t in texts:
        for p in range(len(t or "") - 19):
            counts[t[p : p + 20]] += 1
    want = {w: len(x) for w, x in places.items() if counts[w] > 1}
    assert len(want) > 300 and all(best.get(w) == n for w, n in want.items())


def test_low_entropy_has_few_rows(spark):
    size = 300_000
    texts = ["-" * size, "=-" * (size // 2), "".join(random.Random(1).choices("abcdefghij", k=size))]
    counts = [suffix.anchors(spark.createDataFrame([(1, 2, t)], "k_a long, k_b long, text string"), 200, 40).count() for t in texts]
    assert max(counts[:2]) < counts[2] and suffix.remove(spark.createDataFrame([(1, texts[0])], "doc_id long, text string"), digest=True).first().n_removed == size
