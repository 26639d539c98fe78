"""Conditions as values over a folded store, and what is refused before anything runs."""

import json

import pytest
from pyspark.sql import functions as F

from yore.operators import summary
from yore.operators.conditions import SELF, During, Either, Has, Near, Reduced, Refused, Words, actions, entities, pinned, refusals
from yore.plans.store import fold
from tests.test_ledger import act, ms, thing

ANN, BEN = thing("Person", "ann", name="Ann", birthDate="1950-03"), thing("Person", "ben", name="Ben", birthDate="1960")
ONE, TWO = thing("Book", "one", name="One", author=[ANN], genre=["x"], text="a long story"), thing("Book", "two", name="Two", author=[ANN, BEN], datePublished="1990")
LOG = [
    act("r1", "2024-01-01", timestamp="2020-01-01", agent="@me", object=ONE),
    act("r2", "2024-01-01", timestamp="2020-01-05", endTime="2020-01-07", agent="@me", object=TWO),
    act("r3", "2024-01-01", timestamp="2021-06-01", agent=ANN, object=TWO),
    act("w1", "2024-01-01", "WalkAction", timestamp="2020-01-06", agent="@me"),
    act("w2", "2024-01-01", "WalkAction", timestamp="2021-06-01", agent=BEN),
    act("l1", "2024-01-01", "LikeAction", timestamp="2020-02-01", agent="@me", object=ONE),
    act("m1", "2024-01-01", "MessageAction", timestamp="2020-03-01", agent="@me", recipient=[BEN], object=thing("Message", "m", text="hi there")),
    act("g1", "2022-01-01", "WeighAction", timestamp="2022-01-01", agent="@me", object=thing("Person", "ann", weight=60, mood="odd", title=12)),
    act("g2", "2023-01-01", "WeighAction", timestamp="2023-01-01", agent="@me", object=thing("Person", "ann", weight=62, mood="even")),
]


@pytest.fixture(scope="module")
def made(spark):
    return fold(spark.createDataFrame([(json.dumps(p), 0) for p in LOG], "body string, asserted_at long").repartition(2))


def test_entities(made):
    names = lambda *c: sorted(r.name for r in entities(made, c).collect() if r.name)
    assert names(Has("type", "=", "Person")) == ["Ann", "Ben"] and names(Has("type", "=", ("Book", "Person"), no=True)) == []
    assert names(Has("author", "=", "Ben")) == ["Two"] and names(Has("author", within=(Has("birthDate", "<", "1955"),))) == ["One", "Two"]
    assert names(Has("author", within=(Has("name", "=", "Ann"),), how="every")) == ["One"] and names(Has("author", count=(">=", 2))) == ["Two"]
    assert names(Has("birthDate", "=", "1950")) == ["Ann"] and names(Has("birthDate", ">", "1950")) == ["Ben"] and names(Has("birthDate", "between", "1949", "1960")) == ["Ann", "Ben"]
    assert names(Has("datePublished")) == ["Two"] and names(Has("liked", "=", SELF)) == ["One"] and names(Has("type", "=", "Book"), Has("liked", no=True)) == ["Two"]
    assert names(Has("encountered", "=", SELF)) == ["One", "Two"] and names(During("during", ms(2020, 1, 2), ms(2021, 1, 1), (Has("encountered", "=", SELF),))) == ["Two"]
    assert names(Has("interactedWith")) == ["Ben"] and names(Reduced("last", "encountered", ">=", "2021")) == ["Two"] and names(Reduced("first", "encountered", "=", "2020-01")) == ["One", "Two"]
    assert names(Has("weight", ">", 61)) == ["Ann"] and names(During("at", ms(2022, 6, 1), None, (Has("weight", "<=", 61),))) == ["Ann"]
    assert names(Has("mood", "=", "odd")) == [] and names(During("past", None, None, (Has("mood", "=", "odd"),))) == ["Ann"] and names(Has("title", ">=", 12)) == ["Ann"]
    assert names(Words("long STORY")) == ["One"] and names(Words("story", no=True), Has("type", "=", "Book")) == ["Two"]
    assert names(Either(((Has("genre", "=", "x"),), (Has("birthDate", "=", "1960"),)))) == ["Ben", "One"] and names(Either(((Has("genre"),),), no=True), Has("type", "=", "Book")) == ["Two"]
    assert names(Near("after", (Has("type", "=", "BirthAction"),), anyone=True, lo=1, hi=11 * 366 * 86_400_000)) == ["Ben"]
    assert names(Has("handle")) == [] and names(Has("source", "=", "s"), Has("id", "=", entities(made, [Has("name", "=", "Ann")]).first().entity)) == ["Ann"]


def test_actions(made):
    of = lambda *c: sorted(r.source_id for r in actions(made, c).collect() if r.source_id)
    assert of(Has("type", "=", "ReadAction"), Has("agent", "=", SELF)) == ["r1", "r2"] and of(Has("object", within=(Has("author", "=", "Ben"),))) == ["r2", "r3"]
    assert of(Has("timestamp", "=", "2021")) == ["r3", "w2"] and of(Has("duration", ">=", 86_400_000)) == ["r2"] and of(Has("recipient", count=("=", 1))) == ["m1"]
    assert of(Has("type", "=", "WalkAction"), Near("while", (Has("type", "=", "ReadAction"),))) == ["w1"]
    assert of(Has("type", "=", "WalkAction"), Near("near", (Has("type", "=", "ReadAction"),), hi=0, anyone=True)) == ["w1", "w2"]
    assert of(Near("after", (Has("object", "=", "One"),), hi=5 * 86_400_000)) == ["r2", "w1"]
    assert of(During("during", ms(2020, 1, 6), ms(2020, 1, 31), (Has("agent"),))) == ["r2", "w1"] and of(Has("agent", "=", "Ben", no=True), Has("type", "=", "WalkAction")) == ["w1"]
    assert of(Either(((Has("type", "=", "LikeAction"),), (Has("agent", "=", "Ann"),)))) == ["l1", "r3"]


@pytest.mark.parametrize(
    ("root", "condition", "said"),
    [
        ("entity", Has("autor"), "did you mean author"),
        ("entity", Has("genre", count=(">", 1)), "quantifier counts"),
        ("entity", Has("genre", within=(Has("name"),)), "leads to nothing"),
        ("entity", Has("encountered", count=(">", 1)), "cannot be counted"),
        ("entity", Has("liked", how="every"), "cannot be counted"),
        ("entity", Has("birthDate", "=", "soon"), "no date"),
        ("entity", Has("birthDate", within=(Has("name"),)), "leads to nothing"),
        ("entity", Has("weight", ">", "heavy"), "is a number"),
        ("entity", Has("title", ">", "x"), "needs a number"),
        ("entity", Has("hasPart", how="every"), "read backwards"),
        ("entity", Has("handle", ">", "a"), "names a record"),
        ("entity", Has("type", "=", SELF), "names of types"),
        ("entity", Has("name", "="), "missing its value"),
        ("entity", Has("name", "like", "x"), "there is no like"),
        ("entity", During("past", None, None, (Has("weight"),)), "no scope past"),
        ("entity", During("asof", 1, None, (Has("encountered"),)), "no scope asof"),
        ("entity", During("current", None, None, (Has("hasPart"),)), "without a scope"),
        ("entity", During("during", 1, None, (Has("name"),)), "needs a window"),
        ("entity", During("ever", None, None, ()), "scopes nothing"),
        ("entity", During("ever", None, None, (Has("name"), Has("mood")), no=True), "only one"),
        ("entity", During("past", None, None, (During("ever", None, None, (Has("name"),)),)), "not nested"),
        ("entity", During("past", None, None, (Has("author", within=(During("ever", None, None, (Has("name"),)),)),)), "not nested"),
        ("entity", During("past", None, None, (Near("after", (Has("agent"),)),)), "does not scope other events"),
        ("entity", During("sometime", None, None, (Has("name"),)), "there is no scope"),
        ("entity", Near("while", (Has("agent"),)), "asked of an action"),
        ("entity", Reduced("first", "name", "=", "2020"), "entity's encounters"),
        ("entity", Reduced("first", "encountered"), "compared to a date"),
        ("entity", Words("  "), "no words"),
        ("entity", Either(()), "every side"),
        ("entity", "name", "no condition"),
        ("action", Near("near", (Has("agent"),)), "needs a window"),
        ("action", Near("after", ()), "needs an anchor"),
        ("action", Near("after", (Has("agent"),), lo=5, hi=1), "no distance"),
        ("action", Near("after", (Has("name"),)), "an action has no field name"),
        ("action", Words("x"), "no text"),
        ("action", Has("author"), "no field author"),
        ("action", Has("agent", ">", 1), "not asked of the role"),
        ("action", Has("agent", how="every"), "not asked for every"),
        ("action", Has("duration"), "compared"),
        ("action", Has("timestamp", "=", "noon"), "no date"),
        ("action", Has("type", within=(Has("name"),)), "leads to nothing"),
        ("action", Has("agent", within=(Has("nam"),)), "no field nam"),
    ],
)
def test_refusals(root, condition, said):
    reasons = refusals([condition], root)
    assert any(said in r for r in reasons), reasons
    with pytest.raises(Refused, match="; ".join(reasons)[:10].replace("(", r"\(")):
        (entities if root == "entity" else actions)(None, [condition])  # nothing of the store is touched


def test_the_owner_must_be_known():
    assert refusals([Has("liked", "=", SELF)], me=False) and not refusals([Has("liked", "=", SELF)])


def test_what_conditions_pin():
    asked = [Has("agent", "=", SELF), Has("object", within=(Has("artist", within=(Has("name", "=", "Y"),)),)), Has("target", within=(Has("id", "=", "k"),)), Has("with", within=(Has("name", "=", "Z"),), no=True), During("past", None, None, (Has("result", "=", SELF),))]
    assert pinned(asked) == {"agent.name", "object.artist.name", "target.name", "result.name"}


def test_summaries_of_a_store(made):
    rows = [tuple(r) for r in summary.of_actions(made, [Has("type", "=", "ReadAction"), Has("agent", "=", SELF)]).collect()]
    got = {(f, k): n for f, k, n in rows}
    assert got["total", ""] == 2 and got["census", "object"] == 2 and got["census", "object.author"] == 2 and got["census", "object.attachment"] == 0 and got["census", "object.genre"] == 1
    assert ("time:day", "2020-01-01") in got and not any(f == "source" for f, _ in got) and not any(f.startswith("agent") for f, _ in got)
    assert got["object.author.name", "Ann"] == 2 and got["object.author.name", "Ben"] == 1
    people = {(r.facet, r.key): r["count"] for r in summary.of_entities(made, [Has("type", "=", ("Book", "Person"))]).collect()}
    assert people["total", ""] == 5 and people["type", "Book"] == 2 and people["census", "author"] == 2 and people["author.name", "Ann"] == 2
