"""Payloads folded end to end, in any order, and conditions on the result."""

import json
import random

import pytest
from pyspark.sql import functions as F

from yore.operators import entities as E
from yore.plans.store import fold

BOOK = {"@type": "Book", "source": "s", "sourceId": "b1", "@key": ["source", "sourceId"]}
ANN = {"@type": "Person", "source": "s", "sourceId": "p1", "name": "Ann", "@key": ["source", "sourceId"]}


def person(source, i, **more):
    return {"@type": "Person", "source": source, "sourceId": i, "@key": ["source", "sourceId"], **more}


def act(i, at, kind="ReadAction", **more):
    return {"@type": kind, "@key": ["source", "sourceId"], "source": "s", "sourceId": i, "timestamp": at, "@assertedAt": "2024-01-01T00:00:00Z", "agent": "@me", **more}


PAYLOADS = [
    act("r1", "2020-01-01", object={**BOOK, "name": "Old Title", "author": [ANN], "genre": ["a", "b"]}),
    act("r2", "2020-06-01", object={**BOOK, "name": "New Title", "genre": ["b"], "@asserts": ["genre"]}),
    act("r3", "2022-01-01", object=person("x", "1", name="Jane")),
    act("r4", "2022-02-01", object=person("y", "2", url="https://e.x/j", mood="curious")),
    act("r5", "2022-03-01", object=person("x", "1", url="https://e.x/j")),
    act("r6", "2021", kind="MessageAction", recipient=[ANN, person("x", "1")], object={"@type": "Message", "@key": ["source", "sourceId"], "source": "s", "sourceId": "m", "text": "hello there"}),
    act("w1", "2023-01-01", kind="WeighAction", object=person("s", "me", sameAs=["@me"], weight=80)),
    act("w2", "2023-02-01", kind="WeighAction", object=person("s", "me", weight=78.5)),
    act("bad", "2023-02-01", object={"@type": "Book", "name": "no identity"}),
]


def store(spark, payloads):
    bodies = [(json.dumps(p), 1_700_000_000_000) for p in payloads] + [("not json", 0)]
    return fold(spark.createDataFrame(bodies, "body string, asserted_at long").repartition(3))


@pytest.fixture(scope="module")
def made(spark):
    return store(spark, PAYLOADS)


def names(df):
    return sorted(str(r.name) for r in df.collect())


def test_fold(spark, made):
    got = {r.name: r for r in made.entities.collect()}
    assert {"New Title", "Ann", "Jane"} <= set(got) and sum(r.me for r in got.values()) == 1
    titles = made.properties.filter("predicate = 'name'").join(made.sourced.filter("source_id = 'b1'").select("subject"), "subject").orderBy("first_valid").collect()
    assert [(json.loads(t.value), t.period_to is None) for t in titles] == [("Old Title", False), ("New Title", True)] and titles[0].period_to == titles[1].period_from
    genres = {json.loads(r.value): r.period_to for r in made.properties.filter("predicate = 'genre'").collect()}
    assert genres["a"] is not None and genres["b"] is None  # the second payload asserts its genres
    assert made.sourced.filter("source in ('x', 'y')").select("entity").distinct().count() == 1  # merged by url
    assert sorted(r.error.split()[0] for r in made.errors.collect()) == ["Expecting", "a"]
    assert made.actions.count() == 9 and made.edges.filter("role = 'recipient'").count() == 2


def test_conditions(made):
    e, p = made.entities, made.properties
    assert names(E.with_value(e, p, "name", "Old Title")) == [] and names(E.with_value(e, p, "name", "Old Title", scope="past")) == ["New Title"]
    assert names(E.with_value(e, p, "author", "Ann")) == ["New Title"] and names(E.with_any(e, p, "mood")) == ["Jane"]
    books = E.of_type(e, ["Book"])
    assert names(E.linked(e, p, "author", E.of_type(e, ["Person"]))) == ["New Title"]
    assert names(E.linked(books, p, "author", e.limit(0), how="none")) == ["New Title"]
    assert names(E.linked(books, p, "author", e, how="every")) == ["New Title"] and names(E.linked(books, p, "author", e, how="count", op="=", n=1)) == ["New Title"]
    assert E.measured(e, made.metrics, "weight", lambda c: c < 79).filter("me").count() == 1 and E.measured(e, made.metrics, "weight", lambda c: c < 79, until=1_674_000_000_000).count() == 0
    assert names(E.saying(e, made.words, ["new", "title"])) == ["New Title"]
    assert names(E.from_source(e, made.sourced, F.col("source") == "y")) == ["Jane"]
    ann = e.filter("name = 'Ann'")
    assert [r.source_id for r in E.acting(made.actions, made.edges, "recipient", ann).collect()] == ["m"] or E.acting(made.actions, made.edges, "recipient", ann).count() == 1
    assert E.acting(made.actions, made.edges, "recipient", no=True).count() == 8


def test_any_order_gives_the_same_tables(spark, made):
    rng = random.Random(2)
    for _ in range(2):
        again = store(spark, rng.sample(PAYLOADS, len(PAYLOADS)) + rng.sample(PAYLOADS, 3))
        for t in ("entities", "properties", "edges", "metrics", "words", "actions"):
            rows = lambda s: sorted(str({k: v for k, v in r.asDict().items() if k not in ("sightings", "n")}) for r in getattr(s, t).collect())
            assert rows(made) == rows(again), t


def test_projections(made):
    from yore.operators import project

    jane = made.entities.filter("name = 'Jane'").first().entity
    assert [r for r in project.current(made.properties).filter(F.col("entity") == jane).collect()][0]["values"]["mood"] == '"curious"'
    book = made.entities.filter("name = 'New Title'")
    assert {r.predicate for r in project.history(made.properties).join(book, "entity").first().runs} == {"name", "author", "genre"}
    near = {r.distance for r in project.neighbourhood(made.properties, book, 2).collect()}
    assert near == {0, 1}
    assert project.hydrated(book.unionByName(made.entities.filter("name = 'Ann'")), made.properties, ["author", "author.memberOf"]).filter("name = 'New Title'").first()["author"] == ["Ann"]
    assert len(project.sources(made.sourced).filter(F.col("entity") == jane).first().records) == 2
    assert project.backlinks(made.properties, made.entities.filter("name = 'Ann'").first().entity).count() == 1


def test_shapes(spark):
    from yore.operators import project

    entities = spark.createDataFrame([(k, k.upper(), None) for k in "abcd"], "entity string, name string, types array<string>")
    rows = [("a", "to", None, "b", None), ("b", "to", None, "c", None), ("c", "to", None, "a", None), ("a", "says", '"x"', None, None), ("a", "says", '"y"', None, None), ("a", "says", '"old"', None, 9), ("b", "of", None, "d", None), ("d", "says", "1", None, None)]
    properties = spark.createDataFrame([(*r[:4], None, r[4]) for r in rows], "entity string, predicate string, value string, object string, period_from long, period_to long")
    of = lambda shape, *keys: {r.entity: json.loads(r.json) for r in project.shaped(entities, properties, entities.filter(F.col("entity").isin(*keys)), shape).collect()}
    assert of({"says": None}, "a", "b") == {"a": {"@id": "a", "name": "A", "says": ["x", "y"]}, "b": {"@id": "b", "name": "B"}}
    assert of({"says": None, "history": True}, "a")["a"]["says"] == [{"value": "old", "from": None, "to": 9}, {"value": "x", "from": None, "to": None}, {"value": "y", "from": None, "to": None}]
    assert of(project.deep(1), "a")["a"] == {"@id": "a", "name": "A", "says": ["x", "y"], "to": [{"@id": "b", "name": "B"}]}
    whole = of(project.deep(4), "a")["a"]["to"][0]
    assert whole["of"] == [{"@id": "d", "name": "D", "says": [1]}] and whole["to"][0]["to"] == [{"@id": "a", "name": "A"}]  # the circle ends where it began
    assert of({"to": {"to": None, "*": {"says": None}}}, "a")["a"]["to"][0] == {"@id": "b", "name": "B", "of": [{"@id": "d", "name": "D", "says": [1]}], "to": [{"@id": "c", "name": "C"}]}
    assert project.paths_of({"a": {"b": None, "c": {"d": None}}, "*": None, "history": True}) == ["*", "a.b", "a.c.d"]
    assert of({"to": None}, "none") == {}


def test_chains_that_nothing_ends_are_summed_up_as_runs_says(spark):
    """Chains of one value, of many values, with markers and with changes: apart or not, the runs are the same, and only those that change are put in order."""
    import random

    from pyspark.sql import functions as F

    from yore.operators import runs
    from yore.operators.shred import Ontology
    from yore.plans import store

    rng, rows = random.Random(9), []
    for i in range(400):
        subject, predicate = f"s{rng.randrange(30)}", rng.choice(["name", "mood", "genre", "author"])
        values = [f'"{subject}"'] if predicate == "name" and subject < "s2" else ['"a"', '"b"'] + [None] * (subject > "s15")
        at = rng.randrange(40)
        seen = at + rng.choice([0, 0, 5])
        rows.append((subject, predicate, at, seen, seen + rng.randrange(9), rng.choice(values), f"e{rng.randrange(300)}", 0, f"c{i}"))
    observed = spark.createDataFrame(rows, "subject string, predicate string, valid_at long, observed_at long, confirmed_at long, value string, action string, grade int, claim string")
    told = lambda df: sorted(map(str, df.select("subject", "predicate", "value", "period_from", "period_to", "first_valid", "last_valid", "last_observed", "n", "grade").collect()))
    assert told(store.chains(observed, Ontology(), apart=True)) == told(store.chains(observed, Ontology()))
    whole, changing = runs.lasting(observed, ["subject", "predicate"], F.col("predicate").isin("genre", "author"))
    assert 0 < changing.count() < observed.select("subject", "predicate").distinct().count() and whole.count() > 0


def test_a_fold_moves_little_of_its_log(spark):
    """Bytes that lifecycle_facet shuffles and writes for a payload, with tables too large to be sent to all tasks: at 6 GB, 972 are 70 GB."""
    from yore.plans.stored import lifecycle_facet

    def moved():
        many = spark._jvm.java.util.ArrayList
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(many(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), many())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() + s.outputBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before, kept = moved(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64k")
    try:
        assert len(lifecycle_facet(spark, "/root/testdata/sf0.01").collect()) == 186
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert sum(n for k, n in moved().items() if k not in before) / 20_000 < 700
