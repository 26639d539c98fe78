import pytest

from tests.llm.cases import SCHEMA, documents
from yore.llm import decontaminate as D


def brute(docs, items, window=10):
    wins = {}
    for item, text in items:
        w = D.words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).update({str(item)} - {"None"})
    out = []
    for text in docs:
        w, hit, who = D.words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    who |= wins[tuple(w[i : i + n])]
        out.append((len(w), len(hit), sorted(who)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_matches_brute_force_by_broadcast_and_by_join(spark, limit):
    rows = documents()
    items = [(1, rows[3][1][:200]), (2, rows[7][1]), (3, "erthat, LICHUNG"), (4, None), (5, ""), (None, rows[9][1]), (2, "onhand the"), (6, rows[46][1])]
    docs = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.flag(docs, bench, broadcast_bytes=limit)
    assert found.columns == ["doc_id", "text", "lang", "n_words", "n_hit", "items", "spans"]
    want = sorted((str(r[0]), str(r[1]), *map(str, w)) for r, w in zip(rows, brute([r[1] for r in rows], items)))
    got = found.collect()
    assert want == sorted((str(r.doc_id), str(r.text), str(r.n_words), str(r.n_hit), str(list(r["items"]))) for r in got)
    assert all(sum(s.end - s.start for s in r.spans) == r.n_hit for r in got)


def test_empty_tables_and_removal(spark):
    docs = spark.createDataFrame([(1, "keep this Alpha beta, gamma end", "en", 0), (2, None, "en", 0)], SCHEMA)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.flag(docs, none).collect()] == [0, 0]
    assert D.flag(docs.limit(0), none).count() == 0
    bench = spark.createDataFrame([(1, "alpha BETA gamma")], "item_id long, text string")
    assert sorted(str(r.text) for r in D.without_spans(docs, bench).collect()) == ["None", "keep this  end"]
    assert [r.doc_id for r in D.clean(docs, bench).collect()] == [2]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_columns_that_clash_and_long_texts(spark, limit):
    text = "one two three four five six seven eight nine ten " * 3000
    docs = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5, 6, 7)], "doc_id long, text string, k_a int, k_id int, k_b int, items__ int, w__ int, met int, row__ int")
    bench = spark.createDataFrame([(9, "six seven eight nine ten one two three four five")], "item_id long, text string")
    found = D.flag(docs, bench, broadcast_bytes=limit)
    r = found.first()
    assert found.columns == [*docs.columns, "n_words", "n_hit", "items", "spans"] and tuple(r)[:9] == tuple(docs.first())
    assert (r.n_words, r.n_hit, [tuple(x) for x in r.spans], list(r["items"])) == (30000, 29990, [(5, 29995)], ["9"])
