"""Near copies of the pipeline, against a comparison of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.cases import SCHEMA, documents
from yore.llm import jaccard as J
from yore.llm.simhash import ring_holds


def brute(rows, size=5):
    """The (id, text) of each group that stays, comparing all pairs of rows."""
    def said(t):
        w = (t or "").encode().translate(J._FOLD).split()
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))

    sets, group = [said(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return [{rows[i] for i in range(len(rows)) if group[i] == g} for g in sorted(set(group))]


def near(rng, n):
    """Documents of which many are edited copies, at similarities around 0.8."""
    rows = []
    while len(rows) < n:
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows), " ".join(words), "en", 0))
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(3000)}"
    return rows


@pytest.mark.parametrize("block", [1024, 2])
def test_groups_match_brute_force(spark, block):
    rows = documents() + [(1000 + i, *x) for i, *x in near(random.Random(5), 150)]
    found = [(r.doc_id, r.text) for r in J.one_of_each(spark.createDataFrame(rows, SCHEMA), block=block).collect()]
    groups = brute([r[:2] for r in rows])
    assert len(found) == len(groups)
    for g in groups:
        kept = [x for x in found if x in g]
        assert len(kept) == 1 and kept[0][0] == min((i for i, _ in g if i is not None), default=None)


def test_pipeline_stage_drops_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()}
    assert found == {min(i for i, _ in g) for g in brute([(r.doc_id, r.text) for r in docs.collect()])}


def test_links_of_a_block():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(60), rng.randint(30, 55))), dtype="<u8") for _ in range(80)]
    got = {frozenset(x) for x in J.links_of(list(range(80)), sets, tile=7)}
    want = {frozenset((i, j)) for i in range(80) for j in range(i) if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))}
    label = list(range(80))
    for x in [*got]:
        a, b = (label[i] for i in x)
        label = [a if k == b else k for k in label]
    assert got <= want and all(len({label[i] for i in x}) == 1 for x in want) and want


def test_fingerprints_part_no_alike_pair():
    rng = random.Random(2)
    sets = [J.shingles(t) for _, t, *_ in near(rng, 200)]
    prints, sizes = [J.parity(x) for x in sets], np.array([len(x) for x in sets])
    assert len({len(x) for x in prints}) > 2
    part_of = {}
    for k, part in enumerate(J.may_be_alike(prints, sizes)):
        part_of |= {int(i): k for i in part}
    alike = [(i, j) for i in range(200) for j in range(i) if J.alike(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert alike and all(part_of.get(i, -1) == part_of.get(j, -2) for i, j in alike) and len(set(part_of.values())) > 20
    assert all(len(J.may_be_alike([prints[i], prints[j]], sizes[[i, j]])) == 1 for i, j in alike)


def test_shorter_fingerprints_are_halves_laid_over_each_other():
    said = J.shingles(" ".join(f"w{i}" for i in range(1000)))
    long = np.frombuffer(J.parity(said), dtype="<u8").reshape(1, -1)
    bits = 32 * long.shape[1]
    want = np.packbits((np.bincount((said >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()
    assert J.halved(long).tobytes() == want


def test_the_ring_prunes_no_row_within_the_quota():
    rng = np.random.default_rng(3)
    for words in (1, 3, 8, 20):
        diff = rng.integers(0, 1 << 63, (400, words), dtype=np.uint64) & rng.integers(0, 1 << 63, (400, words), dtype=np.uint64)
        diff[:100] &= rng.integers(0, 1 << 63, (100, words), dtype=np.uint64)
        bits = np.bitwise_count(diff).sum(axis=1)
        quota = rng.integers(0, int(bits.max()) + 2, 400).astype(float)
        assert (ring_holds(diff, quota, 8) == (bits <= quota)).all()


def test_pipeline_stage_links_close_fingerprints(spark):
    """Fingerprints within two bits link, as in op4_simhash, whatever the sets of shingles; one class may have several fingerprints."""
    rng = random.Random(6)
    tail = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    rows = [(i, "one two three " * 60 + tail(12 + i)) for i in range(8)]  # the repeated words set the fingerprint
    rows += [(100 + i, "four five six seven eight " * (2 + i) + "four five six seven") for i in range(6)]  # one set of shingles
    rows += [(200 + i, t) for i, t in enumerate([None, "", " \t"])] + [(300 + i, t) for i, (_, t, *_) in enumerate(near(rng, 60))]
    prints = [J.fingerprint(t) for _, t in rows]
    groups = [set(g) for g in brute(rows)]
    only = len(groups)
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = (next(g for g in groups if rows[k] in g) for k in (i, j))
                if a is not b:
                    groups = [g for g in groups if g is not a and g is not b] + [a | b]
    assert len(groups) <= only - 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()} == {min(i for i, _ in g) for g in groups}
