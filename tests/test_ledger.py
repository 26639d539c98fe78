"""The incremental fold against the whole one: any cut of a log into batches, in any order, gives the same tables."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from yore.operators import encounters as met
from yore.operators import entities as E
from yore.plans import store
from yore.plans.ledger import Ledger
from yore.sources import buckets
from yore.sources.buckets import Buckets


def ms(*day):
    return int(dt.datetime(*day, tzinfo=dt.timezone.utc).timestamp() * 1000)


def thing(kind, i, **more):
    return {"@type": kind, "source": "s", "sourceId": i, "@key": ["source", "sourceId"], **more}


def act(i, seen, kind="ReadAction", **more):
    return {**thing(kind, i), "@assertedAt": seen, **more}


NOVEL, HOUSE = thing("Book", "novel", name="A Novel"), thing("Organization", "house", name="A House")
LOG = [
    act("r1", "2024-01-01", object=thing("Book", "b1", name="1984", genre=["a", "b"])),
    act("r1", "2024-02-01", object=thing("Book", "b1", name="1984", genre=["a", "b"])),  # the same claim, seen again
    act("r2", "2024-03-01", object=thing("Book", "b1", name="Nineteen Eighty-Four", genre=["b"], **{"@asserts": ["genre"]})),
    act("r3", "2023-06-01", object=thing("Book", "b1", mood="odd", url="https://e.x/b1")),
    act("p1", "2024-06-01", "PublishAction", object=NOVEL, agent=HOUSE, timestamp="1862"),
    act("p1", "2024-06-02", "PublishAction", object=NOVEL, timestamp="1862-03-30"),  # finer, and without the agent
    act("x1", "2024-01-05", object=thing("Book", "b9", name="Told", **{"@kind": "x"}), **{"@kind": "restated"}),
    act("x1", "2024-05-05", object=thing("Book", "b9", name="Told", **{"@kind": "x"}), **{"@kind": "restated"}),
    act("l1", "2024-01-05", "LikeAction", agent="@me", object=NOVEL, timestamp="2020"),
    act("l2", "2024-01-05", "UnlikeAction", agent="@me", object=NOVEL, timestamp="2021"),
    act("d1", "2024-01-05", object=thing("Person", "ann", name="Ann", birthDate="1950", deathDate="some day")),
    act("d2", "2024-01-06", object=thing("Person", "ann", birthDate="1950-04", handle="ann")),
    act("m1", "2024-01-07", "MessageAction", timestamp="2024-01-02", agent="@me", recipient=[thing("Person", "ann")], object=thing("Message", "m", text="hi")),
    act("m2", "2024-01-07", "MessageAction", timestamp="2024-01-03", agent="@me", recipient=[thing("Person", "ann")], object=thing("Message", "n", partOf=[NOVEL])),
    act("b1", "2024-01-08", "BirthAction", object=thing("Person", "bob", name="Bob"), location=thing("Place", "rome", name="Rome"), timestamp="1960-01-01"),
]
TABLES = ("sourced", "entities", "actions", "edges", "properties", "metrics", "words", "encounters", "special", "errors")


def log_of(spark, payloads):
    rows = [(json.dumps(p), 1_700_000_000_000) for p in payloads] + [("no json", 0)]
    return spark.createDataFrame(rows, "body string, asserted_at long").repartition(2)


def tables(s, names=TABLES):
    return {t: sorted(str(sorted(r.asDict().items(), key=str)) for r in getattr(s, t).collect()) for t in names}


@pytest.fixture(scope="module")
def whole(spark):
    return store.fold(log_of(spark, LOG))


@pytest.fixture(scope="module")
def expected(whole):
    return tables(whole)


@pytest.mark.parametrize("seed", range(2))
def test_any_batches_in_any_order_equal_the_whole_fold(spark, tmp_path, expected, seed):
    rng = random.Random(seed)
    log = rng.sample(LOG, len(LOG))
    cuts = sorted(rng.sample(range(1, len(log)), 2))
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=4)
    for a, b in zip([0, *cuts], [*cuts, len(log)], strict=True):
        ledger.append(log_of(spark, log[a:b] + rng.sample(log[:b], 1)))  # some of it comes again
    assert Ledger(spark, str(tmp_path / "l")).append(log_of(spark, log[:5])) is None
    got = tables(Ledger(spark, str(tmp_path / "l"), buckets=99).store())
    for t in TABLES:
        assert got[t] == expected[t], t


def test_confirms_move_the_observed_axis_alone(spark, whole):
    runs = {(r.value, r.predicate): r for r in whole.properties.filter("predicate in ('name', 'genre')").collect()}
    first, told = runs['"1984"', "name"], runs['"Told"', "name"]
    assert (first.first_valid, first.last_valid, first.last_observed) == (ms(2024, 1, 1), ms(2024, 1, 1), ms(2024, 2, 1))
    assert told.last_observed == ms(2024, 1, 5)  # what was only restated is not made more recent by confirms
    late = store.fold(log_of(spark, [LOG[1], LOG[0]]).withColumn("claim", F.lit("c")).withColumn("kind", F.when(F.col("body").contains("2024-01-01"), "confirm").otherwise("assert")).filter("body like '{%'"))
    again = late.properties.filter("predicate = 'name'").first()
    assert (again.first_valid, again.last_observed) == (ms(2024, 1, 1), ms(2024, 2, 1))  # the earlier sighting came later, as a confirm


def test_boundaries_sharpen_with_their_action(spark, whole):
    p = whole.properties.filter("predicate = 'publisher'").collect()
    assert [x.period_from for x in p] == [ms(1862, 3, 30)] and p[0].object is not None
    coarse = store.fold(log_of(spark, LOG[4:5])).properties.filter("predicate = 'publisher'").first()
    assert coarse.period_from == ms(1862, 1, 1)
    assert [x.period_from for x in whole.properties.filter("predicate = 'birthPlace'").collect()] == [ms(1960, 1, 1)]


def test_dates_of_a_life_are_actions(whole):
    ann = whole.entities.filter("name = 'Ann'")
    born = E.occurrences(whole.actions, whole.edges, ["BirthAction"]).join(ann, "entity").collect()
    assert [(r.earliest, r.latest) for r in born] == [(ms(1950, 4, 1), ms(1950, 5, 1) - 1)]
    names = lambda df: sorted(r.name for r in df.collect() if r.name)
    of = lambda lo, hi, **more: names(E.dated(whole.entities, whole.actions, whole.edges, "birthDate", lo, hi, **more))
    assert of(ms(1950, 1, 1), ms(1950, 3, 31)) == [] and of(ms(1950, 1, 1), None) == ["Ann", "Bob"] and "Ann" not in of(None, None, no=True)
    assert [r.error for r in whole.errors.filter("predicate = 'deathDate'").collect()] == ["a date that is none"]
    with pytest.raises(ValueError, match="dates no action"):
        E.dated(whole.entities, whole.actions, whole.edges, "name")
    assert names(E.by_occurrence(whole.entities, whole.actions, whole.edges, lambda e: e.filter(F.col("at") < ms(1900, 1, 1)))) == ["A Novel"]


def test_encounters(whole):
    names = {r.entity: r.name for r in whole.entities.collect()}
    rows = {(names[r.subject], r.level, names.get(r.through)) for r in whole.encounters.collect()}
    assert ("1984" not in {r[0] for r in rows}) and ("Nineteen Eighty-Four", "encounter", None) in rows and ("Ann", "interaction", None) in rows
    who = lambda df: sorted(r.name or "me" for r in df.collect() if r.name or r.me)
    assert who(met.with_encounter(whole.entities, whole.encounters, met.EXCHANGED)) == ["Ann", "me"]
    assert who(met.with_encounter(whole.entities, whole.encounters, met.EXCHANGED, scope="at", lo=ms(2024, 1, 2))) == ["Ann", "me"]
    assert who(met.with_encounter(whole.entities, whole.encounters, met.EXCHANGED, scope="before", lo=ms(2024, 1, 2))) == []
    assert who(met.reduced(whole.entities, whole.encounters, lambda t: t == ms(2024, 1, 3), met.EXCHANGED, last=True)) == ["Ann", "me"]
    with pytest.raises(ValueError, match="asof"):
        met.when(F.col("at"), "asof", 0)


def test_specials_and_identifiers(whole):
    s = whole.special.collect()
    assert [(r.predicate, r.period_from, r.period_to) for r in s] == [("liked", ms(2020, 1, 1), ms(2021, 1, 1))]
    assert [(r.source_id, r.handle) for r in whole.sourced.filter("handle is not null").collect()] == [("ann", '"ann"')]


def test_a_batch_reads_and_writes_only_its_buckets(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), buckets=16)
    ledger.append(log_of(spark, LOG))
    before = {t: dict(v) for t, v in ledger.tables.versions.items()}
    change = ledger.append(spark.createDataFrame([(json.dumps(act("r9", "2025-01-01", object=thing("Book", "b1", name="Renamed"))), 0)], "body string, asserted_at long"))
    assert sorted((r.predicate, r.change) for r in change.collect()) == [("name", "added"), ("name", "changed")]
    for t in ("runs", "observed", "log", "facts"):
        assert sum(before[t].get(k) != v for k, v in ledger.tables.versions[t].items()) == 1, t
    subject = change.first().subject
    at = ledger.tables.touched(change, "subject")
    files = ledger.tables.read("runs", at).inputFiles()
    assert len(at) == 1 and files and all("runs/v=2-" in f and f"/bucket={at[0]}/" in f for f in files)
    assert {r.value for r in ledger.tables.read("runs", at).filter((F.col("subject") == subject) & (F.col("predicate") == "name")).collect()} == {'"1984"', '"Nineteen Eighty-Four"', '"Renamed"'}


def test_a_confirm_writes_no_fact_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "VERSIONS", 2)
    ledger = Ledger(spark, str(tmp_path), buckets=1)
    ledger.append(log_of(spark, LOG[:5]))
    facts, log = ledger.tables.versions["facts"][0], ledger.tables.versions["log"][0]
    ledger.append(log_of(spark, [act("r3", "2023-05-01", object=thing("Book", "b1", mood="odd", url="https://e.x/b1"))]))  # earlier, so that its facts move
    assert ledger.tables.versions["facts"][0] == facts and ledger.tables.versions["log"][0][:1] == log and len(ledger.tables.versions["log"][0]) == 2
    ledger.append(log_of(spark, LOG[5:]))
    assert len(ledger.tables.versions["log"][0]) == 1  # several versions become one
    whole = store.fold(log_of(spark, [*LOG, act("r3", "2023-05-01", object=thing("Book", "b1", mood="odd", url="https://e.x/b1"))]))
    assert tables(Ledger(spark, str(tmp_path)).store()) == tables(whole)


def test_a_failed_batch_leaves_nothing_and_writers_collide(spark, tmp_path):
    ledger, other = Ledger(spark, str(tmp_path), buckets=4), Ledger(spark, str(tmp_path), buckets=4)
    ledger.tables.stage("log", spark.createDataFrame([("a", "c", "assert", 1, "{}")], ledger.tables.schemas["log"][0]), [0, 1, 2, 3])
    assert Ledger(spark, str(tmp_path)).tables.read("log").count() == 0  # no manifest, no rows
    ledger.append(log_of(spark, LOG[:2]))
    with pytest.raises(FileExistsError):
        other.append(log_of(spark, LOG[2:4]))
    assert Ledger(spark, str(tmp_path)).tables.read("log").count() == 3
    assert Buckets(spark, str(tmp_path), ledger.tables.schemas).count == 4


def test_a_stream_and_its_trace(spark, tmp_path):
    schema = "body string, asserted_at long"
    for k, part in enumerate((LOG[:6], LOG[4:])):
        log_of(spark, part).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ledger = Ledger(spark, str(tmp_path / "l"), buckets=4)
    ledger.follow(stream, str(tmp_path / "c")).awaitTermination()
    trace = {(r.batch, r.step, r.source): r.n for r in ledger.trace().collect()}
    assert ledger.tables.batch == 2 and sum(n for (_, step, _), n in trace.items() if step.startswith("log ")) == len(LOG) + 1
    assert sum(n for (_, step, _), n in trace.items() if step == "fact error") == 2
    assert sum(n for (_, step, s), n in trace.items() if step == "run added") - sum(n for (_, step, s), n in trace.items() if step == "run removed") == ledger.runs().count()
    assert any(step == "run closed" and s == "s" for _, step, s in trace)
    assert ledger.runs().count() == Ledger(spark, str(tmp_path / "l")).runs().count()
