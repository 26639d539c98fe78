"""Attachments, split exports and places."""

import base64
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from yore.operators import places
from yore.sources import attachments, exports


def uri(content: bytes, mime="image/png"):
    return f"data:{mime};base64,{base64.b64encode(content).decode()}"


def sha(content: bytes):
    return hashlib.sha256(content).hexdigest()


def test_contents_move_out_of_payloads(spark, tmp_path):
    (tmp_path / "in/a b").mkdir(parents=True)
    (tmp_path / 'in/a b/"q".txt').write_bytes(b"from a file")
    path = str(tmp_path / 'in/a b/"q".txt')
    node = lambda **x: {"@type": "X", "object": {"@type": "ImageObject", **x}}
    bodies = [
        node(contentData=uri(b"one")), node(contentData=uri(b"one"), name="again", mimeType="own/mime"), node(contentPath=path), node(contentPath=path, more=[{"@type": "Y", "contentData": uri(b"two", "")}], attachmentCid="stale"),
        node(contentData="data:x,plain"), node(contentData="data:;base64,@@"), node(contentPath="relative"), node(contentPath="/nowhere"), node(contentData=uri(b"x"), contentPath=path), {"contentData": uri(b"no node")}, node(name="none"),
    ]
    log = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, "no json"), (91, None), (92, json.dumps(bodies[0]))], "n int, body string")
    kept, blobs, rejects = attachments.extracted(log, at=attachments.files(spark, str(tmp_path / "in")))
    got = {r.n: r.body for r in kept.collect()}
    of = lambda n: json.loads(got[n])["object"]
    assert of(0) == {"@type": "ImageObject", "attachmentCid": sha(b"one"), "mimeType": "image/png"} and of(1)["mimeType"] == "own/mime" and got[92] == got[0]
    assert of(2)["attachmentCid"] == of(3)["attachmentCid"] == sha(b"from a file") and of(3)["more"] == [{"@type": "Y", "attachmentCid": sha(b"two")}]
    assert json.loads(got[9]) == bodies[9] and json.loads(got[10]) == bodies[10] and got[90] == "no json"
    assert {r.cid: bytes(r.content) for r in blobs.collect()} == {sha(x): x for x in (b"one", b"two", b"from a file")}
    assert {r.n: r.error.split(":")[0] for r in rejects.collect()} == {4: "contentData is no base64 data URI", 5: "contentData has malformed base64", 6: "contentPath is not absolute", 7: "contentPath cannot be read", 8: "a node has both contentData and contentPath"}
    again, none, _ = attachments.extracted(kept.filter("n < 9"))  # what was moved stays
    assert {r.n: json.loads(r.body) for r in again.collect()} == {n: json.loads(b) for n, b in got.items() if n < 9} and none.count() == 0
    assert attachments.extracted(log.filter("n = 2"))[2].count() == 1  # no files given


def test_each_blob_is_written_once(spark, tmp_path):
    at, mark = str(tmp_path / "blobs"), str(tmp_path / "failed")
    rows = [(sha(b"%d" % i), "a/b", b"%d" % i) for i in range(40)]
    blobs = spark.createDataFrame(rows + rows[:10], "cid string, mime string, content binary").repartition(4)

    def once_fails(batches):
        import os

        from pyspark import TaskContext

        for batch in batches:
            yield batch
        if TaskContext.get().partitionId() == 0 and TaskContext.get().attemptNumber() == 0 and not os.path.exists(mark):
            open(mark, "w").close()
            raise RuntimeError("lost after its rows")

    try:  # local mode does not try a task again, so the batch fails and is tried again as a whole
        attachments.store(blobs.mapInArrow(once_fails, blobs.schema), at)
    except Exception as e:
        assert "lost after its rows" in str(e)
    attachments.store(blobs, at)
    assert attachments.store(blobs, at).count() == 0 and attachments.store(spark.createDataFrame([(sha(b"new"), None, b"new"), rows[0]], blobs.schema), at).count() == 1
    got = spark.read.parquet(at).collect()
    assert len(got) == 41 and {r.cid for r in got} == {r[0] for r in rows} | {sha(b"new")} and all(sha(bytes(r.content)) == r.cid for r in got)


@pytest.fixture
def takeout(tmp_path):
    for k in (1, 2, 3):
        with zipfile.ZipFile(tmp_path / f"takeout-x-00{k}.zip", "w", zipfile.ZIP_DEFLATED if k > 1 else zipfile.ZIP_STORED) as z:
            for i in range(20):
                z.writestr(f"Mail/part{k}/{i}.json", json.dumps({"n": k * 100 + i}) * 50)
            z.writestr("Mail/shared.txt", f"of part {k}")
            z.writestr("Mail/empty.json", "")
    (tmp_path / "other.zip").write_bytes(b"PK nothing")
    return tmp_path


def test_a_split_export(spark, takeout):
    found = exports.export(spark, str(takeout / "takeout-x-002.zip"), tasks=6)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 62 and {bytes(r.content) for r in rows if r.name == "Mail/shared.txt"} == {b"of part 1"} and not any(r.error for r in rows)
    assert all(json.loads(bytes(r.content)[: len(r.content) // 50])["n"] for r in rows if "/part" in r.name) and len({r.task for r in rows}) > 3
    inside = exports.export(spark, str(takeout / "takeout-x-001.zip/Mail/part3"), r"1\d\.json").collect()
    assert sorted(r.name for r in inside) == [f"1{i}.json" for i in range(10)]
    assert [(r.name.rpartition("/")[2], r.error) for r in exports.export(spark, str(takeout / "other.zip")).collect()] == [("other.zip", "no zip")]


def test_folders(spark, takeout, tmp_path):
    (takeout / "other.zip").unlink()
    assert exports.export(spark, str(takeout), r".*\.json").count() == 61  # nothing but zips: one export
    (tmp_path / "plain/sub").mkdir(parents=True)
    (tmp_path / "plain/sub/a.json").write_text("{}")
    (tmp_path / "plain/one.zip").write_bytes((takeout / "takeout-x-001.zip").read_bytes())
    assert [r.name for r in exports.export(spark, str(tmp_path / "plain"), r".*json").collect()] == ["sub/a.json"]
    (tmp_path / "single").mkdir()
    (tmp_path / "single/one.zip").write_bytes((takeout / "takeout-x-001.zip").read_bytes())
    assert exports.export(spark, str(tmp_path / "single")).count() == 22


def test_damaged_members(spark, takeout):
    path = takeout / "takeout-x-003.zip"
    raw = bytearray(path.read_bytes())
    with zipfile.ZipFile(path) as z:
        m = z.infolist()[0]
    raw[m.header_offset + 60 : m.header_offset + 70] = b"\xff" * 10
    (takeout / "bad.zip").write_bytes(bytes(raw))
    rows = exports.export(spark, str(takeout / "bad.zip")).collect()
    assert [r.name for r in rows if r.error] == [m.filename] and sum(r.content is not None for r in rows) == 21


def test_places(spark):
    rows = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, None), (1.00000000001, 2.0, None), (None, None, "Rome"), (None, None, None), (1.0, None, None)], "lat double, lon double, address string")
    found = places.values(rows, "lat", "lon", "address")
    assert sorted((r.lat is not None, r.address) for r in found.collect()) == [(False, "Rome"), (True, None)] or found.count() == 2
    people = spark.createDataFrame([(str(i), f"P{i}", i % 5) for i in range(12)], "key string, label string, recent int")
    spots = spark.createDataFrame([(f"x{i}", f"S{i}", i) for i in range(6)], "key string, label string, recent int")
    whole = sorted([(-r.recent, r.kind, r.key) for r in places.united(people, spots, "recent").collect()])
    seen, after = [], None
    while True:
        got = [(r.recent, r.kind, r.key) for r in places.united_page(people, spots, "recent", 4, after).collect()]
        seen += got[:4]
        if len(got) <= 4:
            break
        after = got[3]
    assert [(-a, b, c) for a, b, c in seen] == whole and len(whole) == 18
    acts = spark.createDataFrame([(1, "a", 5.0, 5.0), (2, "a", None, None), (3, "b", None, 1.0), (4, None, None, None)], "id int, object string, lat double, lon double")
    held = spark.createDataFrame([("a", None, "p", 7.0, 7.0), ("a", None, "q", 8.0, 8.0), ("b", 9, "p", 7.0, 7.0)], "entity string, period_to long, place string, lat double, lon double")
    assert {r.id: r.lat for r in places.located(acts, held).collect()} == {1: 5.0, 2: 7.0, 3: None, 4: None}
