import json
import plistlib
import zipfile

from pyspark.sql import functions as F

from yore.sources import readers, sinks
from yore.streaming import fold


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.json").write_text('{"n":1}{"n":2}\n[{"n":3}]\n')
    (tmp_path / "a/bad.json").write_text("{nope")
    assert sorted(json.loads(r.body)["n"] for r in readers.json_stream(spark, str(tmp_path / "a")).collect()) == [1, 2, 3]
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z/e.zip", "w") as z:
        z.writestr("in/one.json", "{}")
        z.writestr("in/two.txt", "no")
    assert [(r.name, bytes(r.content)) for r in readers.archive(spark, str(tmp_path / "z")).collect()] == [("in/one.json", b"{}")]
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.plist").write_bytes(plistlib.dumps({"k": [1, 2]}, fmt=plistlib.FMT_BINARY))
    assert json.loads(readers.plist(spark, str(tmp_path / "p")).first().body) == {"k": [1, 2]}
    (tmp_path / "box").write_text("From a@b Mon\nMessage-ID: <1>\nSubject: one\nFrom: a@b\n\nhello\n>From here\n\nFrom c@d Tue\nSubject: two\n\nbye\n")
    mails = readers.mbox(spark, str(tmp_path / "box")).select(readers.parsed_mail("message").alias("m")).select("m.*").collect()
    assert sorted(m.subject for m in mails) == ["one", "two"] and any("\nFrom here" in m.body for m in mails)
    (tmp_path / "h").mkdir()
    (tmp_path / "h/zsh").write_text(": 1700000000:0;ls\n#1700000005\ncd /\nplain\n")
    assert [(r.at, r.command) for r in readers.shell_history(spark, str(tmp_path / "h")).orderBy("n").collect()] == [(1700000000, "ls"), (1700000005, "cd /"), (None, "plain")]
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "t.csv")).collect()] == [("1", "x\ny")]


def test_window_reaches_the_scan(spark):
    df = readers.within(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), "l_shipdate", "1998-01-01", "1998-02-01").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_shipdate" in plan and "l_comment" not in plan


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, (2, ["a", "b"]), None)], "id int, n struct<x:int,l:array<string>>, e string")
    assert sinks.flat(df).columns == ["id", "n.x", "n.l", "e"]
    sinks.to_csv(df, str(tmp_path / "c"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "c"), header=True).collect()] == [("1", "2", "a; b", None)]
    sinks.to_yaml(df, str(tmp_path / "y"))
    assert spark.read.text(str(tmp_path / "y"), wholetext=True).first()[0].strip().splitlines()[0] == "- id: 1"
    assert sinks.preview(spark.range(5), 3)[1] is True


def test_streamed_ingest_equals_batch(spark, tmp_path):
    rows = [("a", "1", 1), ("b", "1", 2), ("c", "2", 3)]
    schema = "cid string, claim string, asserted_at int"
    for i in range(2):  # the same rows arrive twice
        spark.createDataFrame(rows, schema).write.mode("append").json(str(tmp_path / "in"))
        q = fold.ingest(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "cp"))
        q.awaitTermination()
        assert q.exception() is None
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.cid, r.kind) for r in got) == [("a", "assert"), ("b", "confirm"), ("c", "assert")]


def test_sessions(spark):
    df = spark.createDataFrame([("u", 0), ("u", 600), ("u", 6000), ("v", 0)], "k string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert sorted((r.k, r["count"]) for r in fold.sessions(df, "at", "k").collect()) == [("u", 1), ("u", 2), ("v", 1)]
    assert sum(r["count"] for r in fold.tumbling(df, "at", "1 hour").collect()) == 4


def pages_of(at, size):
    return [(i, f"row {i}") for i in range(at, min(at + size, 25))]


def shard_pages(shard, cursor, size):
    at = int(cursor or 0)
    return [f"{shard}{i}" for i in range(at, min(at + size, 7))], at + size if at + size < 7 else None


def test_paged_sources(spark):
    from yore.sources.paged import paged

    found = paged(spark, "tests.test_sources:pages_of", "n int, body string", size=10).collect()
    assert sorted(tuple(r) for r in found) == [(i, f"row {i}") for i in range(25)]
    shards = paged(spark, "tests.test_sources:shard_pages", style="cursor", size=3, shards="a,b")
    assert shards.rdd.getNumPartitions() == 2 and sorted(r.body for r in shards.collect()) == [f"{s}{i}" for s in "ab" for i in range(7)]


def test_sql_functions(spark):
    from yore.functions.sql import register

    register(spark)
    assert spark.sql("SELECT html_to_text('<p>a</p>') AS t").first().t == "a"
    got = spark.sql("SELECT fingerprint(x) AS f FROM VALUES (1, 'b'), (1, 'a'), (2, 'a'), (2, 'b'), (3, 'c') AS v(k, x) GROUP BY k").collect()
    assert len({r.f for r in got}) == 2
    assert sorted(tuple(r) for r in spark.sql("""SELECT * FROM json_fields('{"a": {"b": [1, null]}}')""").collect()) == [("a.b[0]", "1"), ("a.b[1]", None)]


def test_mail_bodies(spark):
    from yore.functions.texts import email_body

    raw = "Hello\r\n\r\nYes.\n> quoted\n\nTo unsubscribe click here\nOn Mon, 1 Jan 2024, Ann <a@b.c> wrote:\n> old\n-- \nme"
    assert spark.createDataFrame([(raw,)], "x string").select(email_body(F.col("x"))).first()[0] == "Hello\n\nYes."


def test_layouts_are_found_by_what_they_look_like(spark, tmp_path):
    from yore.sources import layouts as L

    for path, text in {"a/Takeout/Chrome/History.json": "{}", "a/notes.csv": "id,when\n1,2", "b/deep/x/mail.mbox": "From a@b Mon\nSubject: s\nX-Id: 1\n\nFrom here\nFrom c@d Tue\n", "b/big.json": " " * 5000 + "{'needle'}", "c/1/2/3/4/5/6/7/8/9/notes.csv": "id,when"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    found = set(L.find(str(tmp_path), {
        "takeout": [L.name("takeout"), L.holds_path("Chrome/*.json")], "notes": [L.columns("when", "id")], "mail": [L.mail("subject", "x-id")],
        "needle": [L.head("needle"), L.neither(L.name("*.csv"))], "none": [L.either(L.name("z*"), L.columns("zz"))],
    }))
    assert {(k, p.removeprefix(str(tmp_path) + "/")) for k, p in found} == {("takeout", "a/Takeout"), ("notes", "a/notes.csv"), ("mail", "b/deep/x/mail.mbox"), ("needle", "b/big.json")}
    assert readers.count_mbox(spark, str(tmp_path / "b/deep/x/mail.mbox")) == 3


def test_inverse_predicates_and_lookup_by_any_key(spark):
    from yore.operators import entities as E

    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    runs = spark.createDataFrame([("b", "isPartOf", "a", None, None, 1), ("c", "isPartOf", "b", 1, 2, 1)], "entity string, predicate string, object string, period_from long, period_to long, first_valid long")
    ids = lambda df: sorted(r.entity for r in df.collect())
    assert ids(E.with_any(entities, runs, "hasPart")) == ["a", "b"] and ids(E.with_any(entities, runs, "hasPart", scope="current")) == ["a"]
    assert ids(E.with_any(entities, runs, "hasPart", no=True)) == ["c"] and ids(E.with_any(entities, runs, "isPartOf")) == ["b", "c"]
    records = spark.createDataFrame([("k1", "a"), ("k2", "a"), ("k3", "b")], "subject string, entity string")
    assert ids(E.by_key(entities, records, "k2")) == ["a"] and ids(E.by_key(entities, records, "zz")) == []


def test_a_batch_looks_only_into_its_buckets(spark, tmp_path):
    log = str(tmp_path / "log")
    schema = "cid string, claim string, asserted_at int"
    fold.append_new(spark.createDataFrame([(f"c{i}", f"k{i}", i) for i in range(60)], schema), log)
    before = sorted(p.name for p in (tmp_path / "log").rglob("*.parquet"))
    (tmp_path / "log/bucket=0").rename(tmp_path / "aside") if (tmp_path / "log/bucket=0").exists() else None
    fold.append_new(spark.createDataFrame([("c5", "k5", 5), ("new", "k5", 99)], schema), log)  # one bucket
    rows = {r.cid: (r.kind, r.bucket) for r in spark.read.parquet(log).collect()}
    assert rows["new"] == ("confirm", rows["c5"][1]) and rows["c5"][0] == "assert"
    assert len([p for p in (tmp_path / "log").rglob("*.parquet") if p.name not in before]) == 1
