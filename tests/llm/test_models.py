"""Language models: language ID by held-out accuracy and exact inference, Brown scores against plain counting."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, documents
from yore.llm import brown, langid


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    lengths, k = np.array([3, 1, 4, 0, 2]), 3
    scores, moves = rng.normal(size=(int(lengths.sum()), k)), rng.normal(size=(k, k))
    _, active, place = langid.by_time(lengths)
    laid = np.empty_like(scores)
    laid[place] = scores
    marginal, expected = langid.forward_backward(laid, active, moves, pairs=True)
    marginal, at, pairs = marginal[place], 0, np.zeros((k, k))
    for n in lengths:
        paths = list(itertools.product(range(k), repeat=int(n)))
        weight = np.array([math.exp(sum(scores[at + t, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))) for p in paths])
        weight /= weight.sum()
        for t in range(n):
            assert np.allclose([sum(w for w, p in zip(weight, paths) if p[t] == y) for y in range(k)], marginal[at + t])
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w
        at += n
    assert np.allclose(pairs, expected)


EN, DE, FR = "the and of thing with onward eating reason shone".split(), "der und nicht lichung schein heiten verzug über".split(), "les des une été voix queaux mentoi élève".split()


def test_languages_are_found_on_held_out_documents(spark):
    rng = np.random.default_rng(5)
    say = lambda words, n: " ".join(rng.choice(words, n))
    rows = [(i, say(w, int(rng.integers(5, 60))), lang, 0) for i in range(300) for lang, w in [(("en", EN), ("de", DE), ("fr", FR))[i % 3]]]
    rows += [(1000, say(EN, 30) + " " + say(DE, 30), None, 0), (1001, None, "en", 0), (1002, "12 #! 3", "en", 0), (1003, "", None, 0), (1004, "x" * 3000, "en", 0), (None, say(DE, 9), "de", 0), (5, rows[5][1], rows[5][2], 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("spans", "score")
    field = langid.learn(docs.filter(langid.fold() != 2))
    found = langid.identify(docs, field, runs=True).collect()
    assert len(found) == len(rows)
    wrong = [r for r in found if r.doc_id is not None and r.doc_id < 300 and r.lang_pred != r.lang]
    assert len(wrong) <= 3 and all(0 <= r.score <= 1 for r in found)
    by = {r.doc_id: r for r in found}
    assert {by[i].lang_pred for i in (1001, 1002, 1003)} == {"und"} and by[None].lang_pred == "de"
    runs = by[1000].runs
    assert [x.lang for x in runs][:1] == ["en"] and runs[-1].lang == "de" and sum(x.n_words for x in runs) == 60
    kept = langid.known_language(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found} - {1001, 1002, 1003, 1004}
    none = langid.identify(docs.limit(3), langid.learn(docs.limit(0))).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 3
    assert langid.identify(docs.limit(0), field).count() == 0


def test_no_known_language(spark):
    """Junk and a language that nothing was learned from go, all others stay."""
    rng = np.random.default_rng(6)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz     "), 600)) for _ in range(30)] + ["ξ όλα αυτά είναι καλά " * 9, "q" * 5000]
    more = spark.createDataFrame([(10**6 + i, x, None) for i, x in enumerate(junk)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(more)
    want = {r.doc_id for r in docs.filter("text rlike '[A-Za-z]'").collect()}
    assert {r.doc_id for r in langid.known_language(both).collect()} == want
    others = {r.doc_id for r in docs.filter("lang = 'es'").collect()}
    field = langid.learn(docs.filter("lang <> 'es'"))
    found = langid.identify(docs, field).filter(F.col("known_share") >= field.floor)
    kept = {r.doc_id for r in found.collect()}
    assert len(kept & others) <= 0.05 * len(others) and len(kept - others) >= 0.98 * (len(want) - len(others))


def test_long_words_keep_all_their_trigrams():
    a, b = "x" * 30 + "ab" * 20 + "y" * 30, "x" * 30 + "ba" * 20 + "y" * 30
    assert sorted(langid.features(a)) != sorted(langid.features(b)) and len(langid.features("z" * 10_000)) == 10_005


def test_texts_are_grouped_by_characters():
    texts = ["a" * n for n in (5, 900, 3, 0, 40, 2000)] + [None]
    groups = list(langid.blocks_of(texts, 1000))
    assert sorted(i for g in groups for i in g) == list(range(7)) and [5] in groups
    assert all(sum(len(texts[i] or "") for i in g) <= 1000 or len(g) == 1 for g in groups)


def test_scores_match_plain_counting(spark):
    rows = documents() + [(950 + i, "w" * 70 + f" rare{i} THE the", "en", 0) for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    train = docs.filter(~brown.held_out())
    words = [brown.words_of(t) + [brown.END] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    c = Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for common in (200_000, 10, 0):
        learned = brown.learn(train, seeds=8, classes=6, common=common)
        got = brown.score(docs, learned).collect()
        assert len(got) == len(rows)
        want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (i, *_), ws in zip(rows, words))
        assert want == sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
        # every word of the training texts has a class of its own, in the model or in the rest
        model, rest = learned[0], {r.word.encode(): (r.n, r.of) for r in learned[1].collect()}
        assert {w: k for w, (k, _) in rest.items()} == {w: k for w, k in c.items() if brown.name_of(w) not in model.common}
        of = lambda w: int(model.of[model.common[brown.name_of(w)]] if brown.name_of(w) in model.common else rest[w][1] if w in rest else model.unseen[brown.ending(w)])
        # transitions, the sizes of classes and scores, by plain counting
        size, kinds, pairs = Counter(), Counter(), np.zeros((6, 6))
        for w, k in c.items():
            size[of(w)] += k
            kinds[of(w)] += 1
        for ws, h in zip(words, held):
            path = [of(w) for w in [brown.END, *ws]]
            for x, y in zip(path, path[1:]):
                pairs[x, y] += not h
        prior = (pairs.sum(axis=0) + 0.5) / (pairs.sum() + 3)
        assert np.allclose(10**model.follow, (pairs + 2 * prior) / (pairs.sum(axis=1, keepdims=True) + 2)) and np.allclose((10**model.follow).sum(axis=1), 1)
        for (i, t, *_), ws in zip(rows, words):
            path = [of(w) for w in [brown.END, *ws]]
            expect = sum(model.follow[a, b] for a, b in zip(path, path[1:])) + sum(math.log10((c[w] + 0.5) / (size[of(w)] + 0.5 * (kinds[of(w)] + 1))) for w in ws)
            assert any(str(r.doc_id) == str(i) and r.n_tokens == len(ws) and abs(r.score - expect) < 1e-6 * max(1, abs(expect)) for r in got)


def test_all_words_move_to_the_class_of_their_neighbours(spark):
    """Two languages of 300 words each, whose words never meet: words beyond the common ones find their own as well."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{'ab'[i % 2]}{x}" for x in np.minimum(rng.zipf(1.3, 80), 300)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, rest, *_ = brown.learn(docs, seeds=20, classes=3, common=100)
    of = {w.decode(): int(model.of[i]) for w, i in model.common.items()} | {r.word: r.of for r in rest.collect()}
    sides = [Counter(of[w] for w in of if w.startswith(x)) for x in "ab"]
    assert sum(len(t.split()) for t in texts) and rest.count() > 200
    assert sides[0].most_common(1)[0][0] != sides[1].most_common(1)[0][0]
    assert all(s.most_common(1)[0][1] >= 0.97 * s.total() for s in sides)


def test_exchange_raises_the_likelihood_and_empty_tables_work(spark):
    rng = np.random.default_rng(2)
    group = rng.integers(0, 3, 30)
    pairs = rng.poisson(np.where((group[:, None] + 1) % 3 == group[None, :], 20, 0.5)).astype(float)

    def likelihood(of):
        one = np.eye(5)[of]
        n = one.T @ pairs @ one
        return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum()

    of = brown.exchange(pairs, 0, 5)
    start = np.zeros(30, int)
    start[1:] = 1 + np.arange(29) % 4
    assert likelihood(of) > likelihood(start) and of[0] == 0 and (of[1:] > 0).all()
    empty = spark.createDataFrame([], SCHEMA)
    docs = spark.createDataFrame(documents()[:5], SCHEMA)
    assert brown.score(empty, brown.learn(docs)).count() == 0
    assert all(r.n_known == 0 and r.train_tokens == 0 for r in brown.score(docs, brown.learn(empty)).collect())


def test_any_word_moves_by_the_exact_gain():
    rng = np.random.default_rng(5)
    classes, m = 6, 40
    pairs = rng.poisson(rng.gamma(0.4, 2.0, (m, m))).astype(float)
    of = np.concatenate(([0], rng.integers(1, classes, m - 1)))

    def likelihood(of):
        one = np.eye(classes)[of]
        n = one.T @ pairs @ one
        return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum(), n

    one, n = np.eye(classes)[of], likelihood(of)[1]
    counts = np.concatenate((pairs.T @ one, pairs @ one), axis=1)
    got = brown.best(counts, n, of, np.diagonal(pairs))
    for u in range(1, m):  # against the likelihood of every class that the word could have
        each = [likelihood(np.where(np.arange(m) == u, c, of))[0] for c in range(1, classes)]
        assert abs(each[got[u] - 1] - max(each)) < 1e-6
        # a word of no class yet, whose pairs with itself no one has counted
        rest = pairs.copy()
        rest[u] = rest[:, u] = 0
        q, r = pairs[:, u].copy(), pairs[u].copy()
        q[u] = r[u] = 0
        bare = one.T @ rest @ one

        def after(c):
            n = bare.copy()
            n[:, c] += q @ one
            n[c] += r @ one
            return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum()

        new = brown.best(np.concatenate((q @ one, r @ one))[None], bare)[0]
        assert abs(after(new) - max(map(after, range(1, classes)))) < 1e-6
    # the exchange ends where no unit of any class gains by another; what is pinned stays
    start = np.concatenate((of[:-classes], np.arange(classes)))
    done = brown.exchange(pairs, 0, classes, rounds=50, start=start, pinned=classes)
    assert (done[-classes:] == np.arange(classes)).all() and likelihood(done)[0] > likelihood(start)[0]
    for u in range(1, m - classes):
        assert likelihood(done)[0] + 1e-6 > max(likelihood(np.where(np.arange(m) == u, c, done))[0] for c in range(1, classes))


def test_a_round_of_exchange_never_lowers_the_likelihood(spark):
    rng = random.Random(2)
    kinds = [[f"{k}{i}" for i in range(12)] for k in "abcd"]
    texts = [" ".join(rng.choice(kinds[(j + s) % 4 if rng.random() < 0.7 else rng.randrange(4)]) for j in range(12)) for s in (rng.randrange(4) for _ in range(150))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)

    def likelihood(moves):
        model, rest, *_ = brown.learn(docs, seeds=4, classes=5, moves=moves)
        assert rest.count() == 0
        n = np.zeros((5, 5))
        for t in texts:
            path = [int(model.of[model.common[w]]) for w in [brown.END, *brown.words_of(t), brown.END]]
            np.add.at(n, (path[:-1], path[1:]), 1)
        return brown._f(n).sum() - brown._f(n.sum(1)).sum() - brown._f(n.sum(0)).sum()

    assert likelihood(1) >= likelihood(0) - 1e-6  # here all 48 words at once would


def test_words_that_are_all_as_frequent_have_classes(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 150}" for j in range(150))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, rest, tokens, distinct = brown.learn(docs, seeds=30, classes=4, common=40)
    assert 20 < len(model.common) <= 41 and len(set(model.of.tolist())) == 4 and rest.count() == distinct - len(model.common)
    with pytest.raises(ValueError, match="128"):
        brown.learn(docs, classes=129)


def test_figures_are_no_letters():
    assert langid.words_of("½ x² 12 ²³ _ été") == ["x²", "été"]
