"""Distances between intervals, pinned scopes, incremental folds, summaries, steps and texts, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from yore.functions import texts
from yore.operators import near, project, runs, steps
from yore.operators.summary import candidates, summary

RNG = random.Random(12)


def test_spans_within_a_distance(spark):
    make = lambda n: [(i, RNG.randint(0, 2), s := RNG.randint(0, 300), s + RNG.randint(0, 40)) for i in range(n)]
    rows, anchors = make(70), make(25)
    a, b = spark.createDataFrame(rows, "id int, k int, s long, e long"), spark.createDataFrame(anchors, "i int, k int, s long, e long")
    far = {"after": lambda s, e, p, q: s - q if q < s else None, "before": lambda s, e, p, q: p - e if p > e else None, "near": lambda s, e, p, q: max(p - e, s - q, 0)}
    for kind, distance in far.items():
        for lo, hi in ((0, 5), (3, 20), (0, 0)):
            got = {r.id: r.near for r in near.has_span_within(a, b, "s", "e", kind, lo, hi, 50, ["k"]).collect()}
            want = {i: any(k == j and (x := distance(s, e, p, q)) is not None and lo <= x <= hi for _, j, p, q in anchors) for i, k, s, e in rows}
            assert got == want, (kind, lo, hi)
    assert near.has_span_within(a, b.limit(0), "s", "e", "near", 0, 9, 50).filter("near").count() == 0
    with pytest.raises(ValueError):
        near.has_span_within(a, b, "s", "e", "beside", 0, 9, 50)


def test_spans_without_an_end_or_a_key(spark):
    rows = [(1, 0, 10, 20), (2, 0, 30, None), (3, None, 10, 20), (4, 0, None, 5), (5, 1, 10, None)]
    anchors = [(0, 22, None), (0, None, 3), (1, 10, 12), (None, 10, 20)]
    a, b = spark.createDataFrame(rows, "id int, k int, s long, e long"), spark.createDataFrame(anchors, "k int, s long, e long")
    of = lambda kind, lo, hi: {r.id: r.near for r in near.has_span_within(a, b, "s", "e", kind, lo, hi, 50, ["k"]).collect()}
    assert of("near", 0, 3) == {1: True, 2: False, 3: False, 4: False, 5: True}
    assert of("near", 1, 9) == {1: True, 2: True, 3: False, 4: False, 5: False}
    assert of("after", 0, 9) == {1: False, 2: True, 3: False, 4: False, 5: False} and of("before", 0, 9) == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert {r.id: r.n for r in near.count_overlapping(a, b, "s", "e", 7, ["k"], "n").collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_scans_over_bins_without_a_key(spark):
    per_bin = spark.createDataFrame([(i * 700, i % 3 or None) for i in range(-4, 9)], "bin__ long, v long")
    rows = [tuple(r) for r in sorted(per_bin.collect())]
    for how, of in (("sum", sum), ("max", max), ("last", lambda x: x[-1])):
        got = {r.bin__: r.c for r in near.carried(per_bin, [], "v", "c", how).collect()}
        assert got == {b: of(x) if (x := [v for c, v in rows if c < b and v is not None]) else None for b, _ in rows}, how


def test_kinds_in_time_order(spark):
    a, b = spark.createDataFrame([(i, i * 10) for i in range(20)], "id int, occurred_at int"), spark.createDataFrame([(100 + i, i * 10 + 5) for i in range(20)], "id int, occurred_at int")
    assert [r.id for r in steps.combined([a, b], size=3).collect()] == [119, 19, 118] and steps.combined([a, b]).count() == 40
    assert steps.combined([a.drop("occurred_at"), b], size=30).count() == 30


def test_runs_that_hold_at_a_rows_own_time(spark):
    rows = [(i, RNG.randint(0, 2), RNG.randint(0, 100)) for i in range(60)]
    held = [(RNG.randint(0, 2), s if (s := RNG.randint(-9, 90)) >= 0 else None, e if (e := s + RNG.randint(0, 30)) < 95 else None) for _ in range(12)]
    found = near.held_at(spark.createDataFrame(rows, "id int, k int, t long"), spark.createDataFrame(held, "k int, s long, e long"), "t", "s", "e", 13, ["k"])
    want = {i: any(k == j and (s is None or s <= t) and (e is None or e > t) for j, s, e in held) for i, k, t in rows}
    assert {r.id: r.held for r in found.collect()} == want


@pytest.mark.parametrize("many", [False, True])
def test_folding_what_a_batch_touches(spark, many):
    rows = [(c, RNG.randint(0, 9), 0, RNG.choice(["x", "y", None]), a, 0) for c in range(30) for a in range(RNG.randint(1, 8))]
    seen = spark.createDataFrame([(c, v, v, x, a, g) for c, v, _, x, a, g in rows], "c int, valid_at long, observed_at long, value string, action int, grade int")
    old, batch = seen.filter("c >= 10 or valid_at < 5"), seen.filter("c < 10 and valid_at >= 5")
    before, whole = runs.runs(old, ["c"], many), runs.runs(seen, ["c"], many)
    told = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert told(runs.refolded(before, seen, batch, ["c"], many)) == told(whole)
    # what changed, laid over the old runs, gives the new ones
    key = lambda r: (r.c, r.value, r.ordinal)
    nth = lambda df: {key(r): r for r in runs.changes(df.limit(0), df, ["c"]).collect()}
    state, new = nth(before), nth(whole)
    for r in runs.changes(before, whole, ["c"]).collect():
        assert (r.change == "removed") == (key(r) not in new) and (r.change == "added") == (key(r) not in state)
        state = {k: v for k, v in state.items() if k != key(r)} | ({key(r): r} if r.change != "removed" else {})
    assert {k: v[4:] for k, v in state.items()} == {k: v[4:] for k, v in new.items()}


def test_confirms_move_the_observed_axis_alone(spark):
    found = spark.createDataFrame([("a", 5, 9, 1), ("b", 5, 9, 1), ("c", 5, 9, 1)], "claim string, observed_at long, last_observed long, period_from long")
    confirms = spark.createDataFrame([("a", 3), ("a", 12), ("b", 7)], "claim string, at long")
    assert sorted(map(tuple, runs.confirmed(found, confirms, "claim", "at").collect())) == [("a", 3, 12, 1), ("b", 5, 9, 1), ("c", 5, 9, 1)]


def test_boundaries_take_what_all_sightings_agree_on(spark):
    found = spark.createDataFrame([("a", 10), ("b", 10), ("c", None)], "action string, period_from long")
    actions = spark.createDataFrame([("a", 7, False), ("b", 7, True), ("c", 7, False)], "action string, earliest long, conflict boolean")
    assert sorted(map(tuple, runs.sharpened(found, actions).select("action", "period_from").collect())) == [("a", 7), ("b", 10), ("c", None)]


def test_summaries(spark):
    assert candidates({"a": 5, "b.name": 2, "c.name": 3, "d": 9, "e": 0}, ["b.name", "c.name"], ["d"]) == ["c.name", "b.name", "a"]
    none = spark.createDataFrame([], "t long, k string")
    assert [tuple(r) for r in summary(none, {"k": F.col("k")}, at="t").collect()] == [("total", "", 0), ("census", "k", 0)]
    one = spark.createDataFrame([(5, "x")], "t long, k string")
    assert {r.facet for r in summary(one, {"k": F.col("k")}, at="t").collect()} == {"total", "census", "span"}  # one bucket tells nothing
    two = spark.createDataFrame([(5, "x"), (6, "y"), (86_400_000, None)], "t long, k string")
    assert {r.facet for r in summary(two.limit(2), {"k": F.col("k")}, at="t").collect()} == {"total", "census", "span"}
    assert {r.facet for r in summary(two, {"k": F.col("k")}, at="t").collect()} == {"total", "census", "span", "time:day"}


def test_steps(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", None), (3, "c", 7)], "id int, kind string, n int")
    good, bad = steps.typed(rows, {"n": F.col("n").isNotNull(), "big": F.col("n") > 5})
    assert [r.id for r in good.collect()] == [3] and {r.id: r.errors for r in bad.collect()} == {1: ["big"], 2: ["n", "big"]}
    order = []
    mark = lambda name: lambda df: order.append(name) or df
    shown = steps.optional(rows, truncate=mark("truncate"), flatten=mark("flatten"), plugin=mark("plugin"), download=mark("download"), fields=["id"], sample=1.0)
    assert order == ["download", "plugin", "flatten", "truncate"] and shown.columns == ["id"] and shown.count() == 3
    asked = []
    fetch = lambda urls: asked.extend(r[0] for r in urls.collect()) or urls.withColumn("body", F.concat(F.lit("<"), "kind", F.lit(">")))
    twice = rows.union(rows)
    assert sorted({r.body for r in steps.downloaded(twice, "kind", fetch).collect()}) == ["<a>", "<b>", "<c>"] and sorted(asked) == ["a", "b", "c"]
    counted, totals = steps.totalled(rows, "run", failed=F.col("n").isNull())
    assert counted.count() == 3 and totals.get == {"processed": 3, "failed": 1}
    assert steps.dispatched(rows, "kind", {}).count() == 0
    timed = steps.combined([rows.withColumnRenamed("n", "occurred_at"), spark.createDataFrame([(9, 6)], "id int, occurred_at int")])
    assert [r.id for r in timed.collect()][:3] == [3, 9, 1]
    assert [r.id for r in steps.combined([rows.filter("id = 3"), rows.filter("id < 3")]).collect()][0] == 3


def test_references_keep_the_identity_alone():
    node = '{"@type":"T","@key":["account.sourceId","member[*].handle","@x","action.y","name"],"name":"n","extra":1,"account":{"@type":"A","@key":["sourceId"],"sourceId":"s","more":2},"member":[{"@type":"M","@key":["handle"],"handle":"h","x":1},"plain"],"sameAs":[1]}'
    assert project.referenced(node) == {"@type": "T", "@key": ["account.sourceId", "member[*].handle", "@x", "action.y", "name"], "name": "n", "account": {"@type": "A", "@key": ["sourceId"], "sourceId": "s"}, "member": [{"@type": "M", "@key": ["handle"], "handle": "h"}, "plain"]}


def test_text_rules(spark):
    def values(expr, rows):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
        return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]

    assert values(texts.untracked, ["http://x/?gclid=1)", "http://x/?a=1&YCLID=2&b=3", "http://x/?_hsmi=1&mkt_tok=2#f"]) == ["http://x/?)", "http://x/?a=1&b=3", "http://x/?#f"]
    assert values(texts.tidy, ["(http://x/?gclid=1) a&gclid=1", "👩‍👧 ​x  \n\n\n\ny \t", None]) == ["(http://x/) a&gclid=1", "👩‍👧 x\n\ny", None]
    assert values(lambda c: texts.tidy(c, bulk=True), ["[words](http://x/" + "y" * 300 + ") http://z/" + "y" * 300 + " end"]) == ["words  end"]
    assert values(lambda c: texts.holds(c, "Erdős"), ["Erdős", "erdos", "Erdős", "erd"]) == [True, True, True, False]
    assert values(texts.isrc, ["ISRC: us-rc1-76-07839", "usrc17607839", "isrc", None]) == ["USRC17607839", "USRC17607839", None, None]
    assert values(lambda c: texts.shortened(c, 10), ["abcdefghijklmnop", "A" * 60, "data:a/b;base64," + "A" * 40]) == ["abcdefghijklmnop", "A" * 10 + "...", "data:a/b;base64,..."]


def test_suggestions_miss_no_close_name(spark):
    names = ["".join(RNG.choices("abc", k=RNG.randint(1, 9))) for _ in range(120)]
    asked = ["".join(RNG.choices("abc", k=RNG.randint(0, 9))) for _ in range(40)]

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    found = texts.suggestions(spark.createDataFrame([(a,) for a in asked], "asked string"), spark.createDataFrame([(n,) for n in names], "name string"), 2, 3)
    want = sorted((a, n, k) for a in set(asked) for k, n in sorted((distance(a, n), n) for n in set(names) if n != a and distance(a, n) <= 2)[:3])
    assert sorted(map(tuple, found.collect())) == want


def test_tables_dealt_alike_take_tasks_by_rows_and_meet_where_they_are(spark, monkeypatch):
    from yore.plans import registry
    from yore.sources import shared

    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    monkeypatch.setattr(shared, "DEALT", 1000)
    found = registry.QUERIES["encounters_transitive"](spark, d)
    # one more task for each 1,000 rows, and no shuffle but that of the two tables
    assert found.rdd.getNumPartitions() == -(-lines // 1000) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(event") <= 2 * (plan.count("Final Plan") + plan.count("Initial Plan") or 1)


def test_a_record_is_made_once_for_each_field_of_its_label(spark):
    from pyspark.sql import functions as F

    from yore.functions import texts

    node = F.to_json(F.struct(F.lit("T").alias("@type"), F.col("id").cast("string").alias("title"), F.lit("2024").alias("endTime")))
    rows = spark.range(2).select(texts.record_label(node).alias("l"))
    assert rows._jdf.queryExecution().analyzed().toString().count("to_json") == 3
    assert [tuple(r.l) for r in rows.collect()] == [("T", "0", "2024"), ("T", "1", "2024")]
    none = spark.createDataFrame([(None,)], "n string").select(texts.record_label(F.col("n")).alias("l")).first().l
    assert tuple(none) == ("records", None, None)
