"""Payload builders and what a mail says."""

import json

from pyspark.sql import functions as F

from yore.functions import mail
from yore.operators import payloads
from yore.operators.shred import Ontology, shred_one


def told(df, *columns):
    return [json.loads(r[0]) if r[0] else None for r in df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).collect()]


def test_media(spark):
    rows = spark.createDataFrame([("image/png", None), ("video/mp4", None), ("application/pdf", None), (None, "AudioObject"), (None, None)], "mime string, kind string")
    assert [r[0] for r in rows.select(payloads.media_type(F.col("mime"), F.col("kind"))).collect()] == ["ImageObject", "VideoObject", "DocumentObject", "AudioObject", "DocumentObject"]
    made = told(rows.limit(1), F.to_json(payloads.media(F.col("mime"), url=F.lit("u"), data=F.lit("QQ=="), width=F.lit(3))))[0]
    assert made == {"@type": "ImageObject", "@key": ["url"], "mimeType": "image/png", "width": 3, "contentData": "data:image/png;base64,QQ==", "url": "u"}
    assert told(rows.filter("mime is null").limit(1), F.to_json(payloads.media(F.col("mime"), data=F.lit("QQ=="))))[0]["contentData"] == "data:application/octet-stream;base64,QQ=="


def test_the_owner(spark):
    one = spark.range(1)
    assert told(one, F.to_json(payloads.own("x", F.lit("7"), F.lit("me"))))[0] == {"@type": "Person", "@key": ["@type", "source", "sourceId"], "source": "x", "sourceId": "7", "handle": "me", "sameAs": ["@me"]}
    assert told(one, F.to_json(payloads.own("x", handle=F.lit("me"), same=["u"])))[0]["sameAs"] == ["u", "@me"] and told(one, F.to_json(payloads.own("x")))[0]["@key"] == ["@type", "source"]


def test_mails(spark):
    person = "struct<address:string,name:string>"
    rows = spark.createDataFrame(
        [
            (1, "<a@x>", 1000, ("Ann@X.org", "Ann"), [("me@x.org", None), ("ME@x.org", "I"), ("bob@x.org", "Bob"), (None, "no one")], "hi", "text", "<z@x>", ["t"]),
            (2, None, 1000, ("ann@x.org", None), [], "hi", None, None, []), (3, " ", 1000, ("ANN@x.org", None), None, "hi", "", None, None), (4, "<b@x>", None, ("ann@x.org", None), [], None, None, None, None), (5, "<c@x>", 1, None, [], None, None, None, None),
        ],
        f"id int, message_id string, at long, sender {person}, recipients array<{person}>, subject string, text string, reply_to string, tags array<string>",
    )
    got = {r.id: json.loads(r.payload) if r.payload else None for r in payloads.mails(rows, ["me@x.org"]).collect()}
    one = got[1]
    assert one["timestamp"] == "1970-01-01T00:00:01.000Z" and one["agent"]["handle"] == "ann@x.org" and "sameAs" not in one["agent"]
    assert [(p["handle"], p.get("sameAs")) for p in one["recipient"]] == [("me@x.org", ["@me"]), ("bob@x.org", None)]
    assert one["result"]["sourceId"] == "a@x" and one["result"]["inReplyTo"][0]["sourceId"] == "z@x" and one["result"]["tags"] == ["t"] and "@id" not in one["result"]
    assert got[2]["@id"] == got[3]["@id"] and got[2]["result"]["@id"] == got[3]["result"]["@id"] and "text" not in got[3]["result"] and got[4] is None and got[5] is None
    keys = [{r["target"] for r in shred_one(json.dumps(p), 0, Ontology()) if r["what"] == "edge" and r["predicate"] == "result"} for p in (one, got[2], got[3])]
    assert keys[1] == keys[2] != keys[0]


def test_when_a_payload_was_asserted(spark):
    bodies = ['{"timestamp":"2020-01-01T00:00:00Z","a":1}', '{"startTime":"2020","a":1}', '{"@assertedAt":"x","timestamp":"2020-01-01T00:00:00Z"}', "{}", "no json"]
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").coalesce(1)
    of = lambda **how: [json.loads(r[0]).get("@assertedAt") if r[0].startswith("{") else r[0] for r in rows.select(payloads.asserted(F.col("b"), **how)).collect()]
    day = "1970-01-01T00:00:00.005Z"
    assert of(snapshot=False) == ["2020-01-01T00:00:00Z", None, "x", None, "no json"]
    assert of(snapshot=True, crawled=F.lit(5)) == [day, day, "x", day, "no json"] and of(snapshot=False, recorded=F.lit(5)) == [day, day, "x", day, "no json"]


def test_snapshots_say_that_they_are_whole(spark):
    body = {"@type": "A", "object": {"@type": "B", "@asserts": ["x"], "sameAs": [{"@type": "C"}], "part": [{"@type": "D"}, {"k": 1}]}}
    rows = spark.createDataFrame([(json.dumps(body),), ("no",), (None,), ("[1]",)], "b string").coalesce(1)
    got = [r[0] for r in rows.select(payloads.complete("b")).collect()]
    assert json.loads(got[0]) == {"@type": "A", "object": {"@type": "B", "@asserts": ["x", "*"], "sameAs": [{"@type": "C"}], "part": [{"@type": "D", "@asserts": ["*"]}, {"k": 1}]}} and got[1:] == ["no", None, "[1]"]


def test_what_a_mail_says(spark):
    html = '<p>Real <b>news</b> of some length that is surely longer than the little stub of a text.</p><div style="display:none">hidden</div><img src="x.png" alt="logo">'
    cases = {
        1: ("Hello\n\nSee you\n-- \nAnn\nBoss", None, "Hello\n\nSee you"),
        2: ("Yes.\n\nOn Mon, 1 Jan 2024, Bob <b@x> wrote:\n> Really?\n> No", None, "Yes."),
        3: ("Ja\n\nAm 1.1.2024 um 10:00 schrieb Bob:\n> Wirklich?", None, "Ja"),
        4: ("Fine\n\n-----Original Message-----\nFrom: Bob\nhi", None, "Fine"),
        5: ("Top\n\nFrom: Bob\nSent: Monday\nTo: Ann\nSubject: x\n\nold", None, "Top"),
        6: ("> only\n> a quote", None, "> only\n> a quote"),
        7: ("ok\n> a\n> b", None, "ok"),
        8: ("View this email in your browser", html, None),
        9: (None, html, None),
        10: ("", None, ""),
        11: (None, None, None),
        12: ("short and sent\n\nSent from my phone", None, "short and sent"),
    }
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in cases.items()], "k int, text string, html string")
    got = {r.k: r.said for r in mail.bodies(rows, out="said").collect()}
    for k, (_, b, want) in cases.items():
        if b is None:
            assert got[k] == want, k
    for k in (8, 9):
        assert "**news**" in got[k] and "hidden" not in got[k] and "logo" not in got[k]
    letter = "News\n" * 20 + "\n[read](http://x/" + "y" * 300 + ")\n\nYou are receiving this since you asked\nUnsubscribe here\nAddress 1"
    bulk = spark.createDataFrame([(letter, None), ("how to unsubscribe\n" + "long text\n" * 30, None)], "t string, h string").coalesce(1)
    bulk = mail.bodies(bulk, "t", "h", bulk=True).select("body").collect()
    assert bulk[0][0].endswith("News\n\nread") and bulk[1][0].startswith("how to unsubscribe") and bulk[1][0].endswith("long text")


def test_a_node_is_identified_once_and_its_text_compared_only_with_its_like(monkeypatch):
    from yore.operators import shred

    calls = {"identity": 0, "canonical": 0}

    def counted(name, f):
        def g(*a):
            calls[name] += 1
            return f(*a)

        return g

    monkeypatch.setattr(shred, "_identity", counted("identity", shred._identity))
    monkeypatch.setattr(shred, "canonical", counted("canonical", shred.canonical))
    node = lambda i, **more: {"@type": "Book", "@id": i, **more}
    body = json.dumps(node("a", agent=node("x"), object=node("y", creator=[node("x"), node("z"), node("z", genre=[1.0])])) | {"@type": "ReadAction"})
    rows = list(shred_one(body, 0, Ontology()))
    assert calls["identity"] == 6  # the action and five nodes
    assert calls["canonical"] == 5  # x and z are named twice: four nodes, and the value of z
    assert sorted((r["subject"], r["type"]) for r in rows if r["what"] == "entity") == [("x", "Book"), ("y", "Book"), ("z", "Book"), ("z", "Book")]
    assert [r["value"] for r in rows if r.get("value")] == ["1"]


def test_claims_do_not_depend_on_how_a_number_is_written():
    from yore.functions.identity import canonical, canonical_text, key_of

    for text in ('{"b": 1.0, "a": [2.50, -0.0, 1e2, 1e400, NaN], "@kind": "confirm"}', '{"b": {"é": "\\u00e9", "x": 1E-2}, "a": true}'):
        said = {k: v for k, v in json.loads(text).items() if k != "@kind"}
        assert canonical_text(text, ("@kind",)) == canonical(said)
    assert key_of("x") == "fvyrmqvxe2yeialcpsu7xlbs6xefgd5rsa6mjwycewdrpeq2jcaq"


def test_a_batch_of_long_payloads_is_not_held_as_texts():
    import tracemalloc

    import pyarrow as pa

    from yore.plans import store

    bodies = pa.array([json.dumps({"@type": "ReadAction", "@id": str(i), "text": "x" * 4000}) for i in range(5000)])
    tracemalloc.start()
    keys = store.claim_of.func(bodies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(keys) == 5000 and peak < 6_000_000 < bodies.nbytes / 3
