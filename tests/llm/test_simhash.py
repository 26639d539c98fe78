import random

import pytest
import xxhash

from tests.llm.cases import SCHEMA, documents
from yore.llm import simhash as S


def slow_print(text, size=3):
    words = (text or "").encode().translate(S._FOLD).split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """(id, print) -> id of component by comparing all pairs."""
    label = {p: p for _, p in prints}
    todo = list(label)
    while todo:
        x = todo.pop()
        for y in label:
            if bin(x ^ y).count("1") <= 2 and label[y] > label[x]:
                label[y] = label[x]
                todo.append(y)
    least = {}
    for i, p in prints:
        if i is not None:
            least[label[p]] = min(least.get(label[p], i), i)
    return [(i, p, least.get(label[p])) for i, p in prints]


@pytest.mark.parametrize("block", [512, 1])
def test_documents_match_brute_force(spark, block):
    rows = documents()
    found = S.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    want = components([(r[0], slow_print(r[1])) for r in rows])
    assert sorted(map(str, want)) == sorted(str((r[0], r[1] & (2**64 - 1), r[2])) for r in found)


@pytest.mark.parametrize("block", [512, 4])
def test_links_lose_nothing(spark, block):
    rng = random.Random(4)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(400):
        x = rng.choice(prints)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        prints.append(x)
    rows = [(i, p if p < 2**63 else p - 2**64) for i, p in enumerate(prints)]
    found = {r[0]: r[1] for r in spark.createDataFrame(rows, "doc_id long, fp long").join(S.components(spark.createDataFrame(rows, "doc_id long, fp long"), block=block), "fp").select("doc_id", "component_id").collect()}
    want = {i: c for i, _, c in components(list(enumerate(prints)))}
    assert found == want


def test_one_of_each_and_empty(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    all_ids = {r[2] for r in S.near_duplicates(docs).collect()}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, all_ids))
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_one_row_of_each_component_without_ids(spark):
    rng = random.Random(7)
    a, b, c, d = ([rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)] for _ in range(4))
    rows = [(None, " ".join(a)), (None, " ".join(a)), (None, " ".join(b)), (7, " ".join(c)), (7, " ".join(d)), (7, " ".join(d)), (None, " ".join(d)), (8, " ".join(c))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, S.one_of_each(docs).collect())) == sorted(map(str, docs.distinct().filter("doc_id = 7 or (doc_id is null and text in ('%s', '%s'))" % (" ".join(a), " ".join(b))).collect()))
