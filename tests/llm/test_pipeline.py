"""The pipeline and the queries as registered, on the smallest tables."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_windows
from tests.llm.test_jaccard import brute as brute_groups
from yore.llm import langid

DIR = "/root/testdata/sf0.001"


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DIR)
        out.write.parquet(str(tmp_path / str(i)))
        new = spark.read.parquet(str(tmp_path / str(i)))
        kept = {r[0] for r in new.select("doc_id").collect()}
        if i < 4:
            assert new.columns == docs.columns
        if i == 0:
            field = langid.learn(docs.filter(langid.fold() != 2))
            tagger = langid.Tagger(field)
            n, _, _, share = tagger.tag(list(rows.values()))
            assert kept == {k for k, c, x in zip(rows, n, share) if c and x >= field.floor}
            assert len(kept) > 0.97 * len(rows)
        if i == 1:
            assert kept == {min(k for k, _ in g) for g in brute_groups(list(rows.items()))}
        if i == 2:
            hit = brute_windows(list(rows.values()), items)
            assert kept == {k for k, (_, n, _) in zip(rows, hit) if n == 0}
        if i == 3:
            assert kept == set(rows)
            assert not any(a in r.text for r in new.collect() for a in ("@mail", "+1 ("))
        if i == 4:
            assert kept == set(rows)
        rows = {k: t for k, t in rows.items() if k in kept} if i < 3 else {r.doc_id: r.text for r in new.collect()} if i == 3 else rows
        docs = new


def test_run_gives_pieces(spark):
    assert corpus_pipeline.run(spark, DIR).count() > 0


@pytest.mark.parametrize("name", [k for k in entry.queries() if k.startswith("op")])
def test_queries_return_every_row(spark, name):
    found = entry.queries()[name](spark, DIR)
    source = "pages" if name.startswith("op3_") else "documents"
    key = "page_id" if source == "pages" else "doc_id"
    want = spark.read.parquet(f"{DIR}/{source}.parquet").count()
    rows = found.select(key).collect()
    assert len({r[0] for r in rows}) == want and (len(rows) == want or name.startswith("op10_"))


def test_run_on_odd_rows_and_on_none(spark, tmp_path):
    """Nulls, copies, shared and null ids, extra columns with the operators' own names; and empty tables."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(3)
    source = [(r.text, r.lang) for r in spark.read.parquet(f"{DIR}/documents.parquet").filter("length(text) > 600").limit(60).collect()]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(source)]
    words = source[0][0].split()
    mail = (source[6][0] + " " + source[7][0]).split()
    rng.shuffle(mail)
    mail = "mail me@some.org " + " ".join(mail)
    rows += [(100, source[0][0], "en"), (101, " ".join(words[: len(words) // 2] + ["changed"] + words[len(words) // 2 :]), None), (None, source[1][0], "en"), (None, source[2][0] + " " + source[3][0], "en"), (7, source[4][0] + " " + source[5][0], "en")]
    rows += [(200, None, "en"), (201, "", None), (202, "12 # 34", None), (203, "".join(rng.choice("qxzjwv") for _ in range(4000)), None), (204, mail, "en"), (204, mail, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("spans", "items", "k_a", "lang_pred", "score", "row", "node", "source", "n_chars")})
    docs.write.parquet(str(tmp_path / "odd/documents.parquet"))
    items = spark.createDataFrame([(1, " ".join(source[8][0].split()[:12])), (None, None)], "item_id long, text string")
    items.write.parquet(str(tmp_path / "odd/benchmark.parquet"))
    stage, kept = docs, []
    for i, (_, f) in enumerate(corpus_pipeline.STAGES[:4]):
        f(spark, stage, str(tmp_path / "odd")).write.parquet(str(tmp_path / f"s{i}"))
        stage = spark.read.parquet(str(tmp_path / f"s{i}"))
        assert stage.columns == docs.columns
        kept.append(stage.select("doc_id", "text").collect())
    assert {r.doc_id for r in kept[0]} & {200, 201, 202, 203} == set() and len(kept[0]) == len(rows) - 4
    groups = brute_groups([(r.doc_id, r.text) for r in kept[0]])
    left = [(r.doc_id, r.text) for r in kept[1]]
    assert len(left) == len(groups) and all(sum(x in g for x in left) == 1 for g in groups) and {100, 101} & {i for i, _ in left} == set()
    assert {r.doc_id for r in kept[1]} - {r.doc_id for r in kept[2]} >= {8} and len(kept[3]) == len(kept[2])
    assert [r.text[:13] for r in kept[3] if r.doc_id == 204] == ["mail <EMAIL> "]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / "odd")).select("doc_id").collect()} == {r.doc_id for r in kept[3]}
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    items.limit(0).write.parquet(str(tmp_path / "none/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
