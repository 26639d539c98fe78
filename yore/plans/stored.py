"""Queries over a store folded from a log: confirms, batches, lifecycle dates, encounters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yore.operators import encounters as met
from yore.operators import entities, near, payloads, places, project, runs, summary
from yore.operators.conditions import During, Either, Has, Near
from yore.operators.conditions import actions as actions_that
from yore.operators.conditions import entities as entities_that
from yore.operators.intervals import millis
from yore.plans.base import ACTIONS_SQL, DAY, actions, ms, query, table
from yore.plans.fold import SINGLE_RUNS
from yore.plans.ledger import Ledger
from yore.plans.store import fold
from yore.sources import attachments
from yore.sources.shared import folder


def _iso(ms):
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def moods(spark, d) -> DataFrame:
    """A log in which every event says its user's mood, an error that there is none, and is seen three times: late, first, and last.

    (id, nth, cid, claim, kind, asserted_at, body). The assert is the late sighting, so the anchor is a confirm's; every
    seventh event is only restated, which no confirm makes more recent.
    """
    nth = F.explode(F.array(*map(F.lit, range(3))))
    rows = actions(spark, d).select("id", "agent", "type", "t", nth.alias("nth"))
    later = F.when(F.col("nth") == 0, 3 * DAY).when(F.col("nth") == 1, 0).otherwise(F.when(F.col("id") % 2 == 0, 10 * DAY).otherwise(DAY))
    state = lambda kept: F.struct(F.lit("Person").alias("@type"), F.concat(F.lit("u"), "agent").alias("@id"), F.lit("events").alias("source"), *kept)
    user = [state([F.col("type").alias("mood")]), state([F.array(F.lit("mood")).alias("@asserts")])]
    body = lambda u: F.to_json(F.struct(F.lit("UpdateAction").alias("@type"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("@id"), F.lit("events").alias("source"), u.alias("agent")))
    kind = F.when(F.col("nth") > 0, "confirm").when(F.col("id") % 7 == 0, "restated").otherwise("assert")
    return rows.select(
        "id", "nth", F.concat_ws("-", "id", "nth").alias("cid"), F.concat(F.lit("c"), "id").alias("claim"), kind.alias("kind"), (F.col("t") + later).alias("asserted_at"),
        F.when(F.col("type") == "error", body(user[1])).otherwise(body(user[0])).alias("body"),
    )


#: Runs of moods, with when each was last seen.
_SEEN = f"max(observed_at + CASE WHEN action % 7 = 0 THEN 0 WHEN action % 2 = 0 THEN {10 * DAY} ELSE {3 * DAY} END) AS last_observed"
_MOODS = SINGLE_RUNS.replace("max(observed_at) AS last_observed", _SEEN) + " SELECT subject, value, CASE WHEN run > 1 OR coalesce(opened = 0 AND marked < first_valid, false) THEN first_valid END AS period_from, period_to, first_valid, last_valid, last_observed, n FROM g"


def _mood_runs(found: DataFrame) -> DataFrame:
    return found.filter("predicate = 'mood'").select(F.expr("bigint(substring(subject, 2))").alias("subject"), F.expr("substring(value, 2, length(value) - 2)").alias("value"), "period_from", "period_to", "first_valid", "last_valid", "last_observed", "n")


@query("fold_confirms", _MOODS)
def fold_confirms(spark, d):
    return _mood_runs(fold(moods(spark, d)).properties)


@query("fold_batches", _MOODS)
def fold_batches(spark, d):
    ledger = Ledger(spark, f"{folder(spark)}/yore-tables/ledger-{uuid.uuid4().hex}", buckets=8)
    log = moods(spark, d)
    for k in range(3):  # the later sighting of half of the events comes before the first, and some come twice
        ledger.append(log.filter((F.col("nth") + F.col("id")) % 3 == k).unionByName(log.filter(F.col("id") % 50 == k)))
    return _mood_runs(ledger.runs())


def _works(spark, d) -> DataFrame:
    """Orders as works of their customer: when each was published is told by a year, a month or a day, by its kind, and twice with another precision where it is a third one."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("timestamp").alias("at"), F.explode(F.array(F.lit(0), F.lit(1))).alias("nth"))
    form = (F.col("id") + F.col("nth")) % 3
    date = F.when(form == 0, F.date_format("at", "yyyy")).when(form == 1, F.date_format("at", "yyyy-MM")).otherwise(F.date_format("at", "yyyy-MM-dd"))
    work = F.struct(F.lit("Book").alias("@type"), F.concat(F.lit("w"), "id").alias("@id"), F.lit("orders").alias("source"), F.concat(F.lit("Work "), "id").alias("name"), date.alias("datePublished"))
    body = F.struct(F.lit("ReadAction").alias("@type"), F.concat(F.lit("r"), "id", F.lit("-"), "nth").alias("@id"), F.lit("orders").alias("source"), work.alias("object"))
    return rows.filter("nth = 0 or id % 3 = 0").select(F.to_json(body).alias("body"), F.lit(1_800_000_000_000).alias("asserted_at"))


#: What is known of when a work was published: of two dates what both allow.
_PUBLISHED = """w AS (SELECT o_orderkey AS id, o_orderdate AS od, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [0, 1] ELSE [0] END) AS nth FROM orders),
f AS (SELECT id, CASE (id + nth) % 3 WHEN 0 THEN date_trunc('year', od) WHEN 1 THEN date_trunc('month', od) ELSE date_trunc('day', od) END AS lo, CASE (id + nth) % 3 WHEN 0 THEN date_trunc('year', od) + INTERVAL 1 YEAR WHEN 1 THEN date_trunc('month', od) + INTERVAL 1 MONTH ELSE date_trunc('day', od) + INTERVAL 1 DAY END AS hi FROM w),
p AS (SELECT id, max(epoch_us(lo) // 1000) AS earliest, min(epoch_us(hi) // 1000) - 1 AS latest FROM f GROUP BY 1)"""


@query("lifecycle_facet", f"WITH {_PUBLISHED} SELECT id, earliest, latest FROM p WHERE earliest <= {ms(1995, 7) - 1} AND latest >= {ms(1995, 6)}")
def lifecycle_facet(spark, d):
    """Works published in June 1995, as far as one knows."""
    s = fold(_works(spark, d))
    found = entities.dated(s.entities, s.actions, s.edges, "datePublished", ms(1995, 6), ms(1995, 7) - 1)
    when = entities.occurrences(s.actions, s.edges.filter("role = 'object'"), ["PublishAction"]).select("entity", "earliest", "latest")  # the edges that dated() reads
    return found.join(when, "entity").select(F.expr("bigint(substring(name, 6))").alias("id"), "earliest", "latest")


@query("entity_event_edge", f"WITH {_PUBLISHED} SELECT id FROM p WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P' AND earliest > epoch_us(o_orderdate) // 1000 AND earliest - epoch_us(o_orderdate) // 1000 <= {DAY})")
def entity_event_edge(spark, d):
    """Works published within a day after some pending order."""
    s = fold(_works(spark, d))
    anchors = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(millis("o_orderdate").alias("at"))
    found = entities.by_occurrence(s.entities, s.actions, s.edges, lambda events: near.has_point_within(events, anchors, F.col("at") - DAY, DAY - 1, "at").filter("near"))
    return found.select(F.expr("bigint(substring(name, 6))").alias("id"))


def _talks(spark, d) -> DataFrame:
    """Events as reading and writing: a view reads a page by another, a click writes to a user, a purchase writes to one in a channel; other events meet no one."""
    rows = actions(spark, d)
    node = lambda kind, key, *more: F.struct(F.lit(kind).alias("@type"), key.alias("@id"), F.lit("events").alias("source"), *more)
    user = lambda n: node("Person", F.concat(F.lit("u"), n), F.concat(F.lit("User "), n).alias("name"))
    other = (F.col("agent") * 7 + F.col("id")) % 50
    page = node("Article", F.concat(F.lit("p"), F.col("id") % 40), F.array(user(F.col("id") % 40 % 9)).alias("creator"))
    channel = node("Channel", F.concat(F.lit("c"), F.col("id") % 5))
    base = [F.concat(F.lit("e"), "id").alias("@id"), F.lit("events").alias("source"), _iso(F.col("t")).alias("timestamp"), user(F.col("agent")).alias("agent")]
    say = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("@type"), *base, *more))
    note = lambda *more: node("Message", F.concat(F.lit("m"), "id"), *more).alias("object")
    to = F.array(user(other)).alias("recipient")
    body = (
        F.when(F.col("type") == "view", say("ReadAction", page.alias("object"))).when(F.col("type") == "click", say("MessageAction", note(), to))
        .when(F.col("type") == "purchase", say("MessageAction", note(F.array(channel).alias("isPartOf")), to)).otherwise(say("SleepAction"))
    )
    return rows.select(body.alias("body"), F.lit(1_800_000_000_000).alias("asserted_at"))


_MET = f"""{ACTIONS_SQL}, m AS (SELECT 'e' || id AS action, t AS \"at\", 'u' || agent AS who, CASE type WHEN 'view' THEN 'p' || (id % 40) WHEN 'click' THEN 'u' || ((agent * 7 + id) % 50) ELSE 'c' || (id % 5) END AS subject, CASE WHEN type = 'view' THEN 'encounter' ELSE 'interaction' END AS level, NULL AS through FROM actions WHERE type IN ('view', 'click', 'purchase')
UNION ALL SELECT 'e' || id, t, 'u' || agent, 'u' || (id % 40 % 9), 'encounter', 'p' || (id % 40) FROM actions WHERE type = 'view')"""


@query("encounters_folded", f"WITH {_MET} SELECT * FROM m")
def encounters_folded(spark, d):
    return fold(_talks(spark, d)).encounters.select("action", "at", "who", "subject", "level", "through")


_FROM, _TO = ms(2024, 1, 5), ms(2024, 1, 20)


@query("encounter_at", f"WITH {_MET}, b AS (SELECT subject AS entity, who AS other, \"at\" FROM m WHERE level = 'interaction' UNION ALL SELECT who, subject, \"at\" FROM m WHERE level = 'interaction') SELECT DISTINCT entity FROM b WHERE \"at\" >= {_FROM} AND \"at\" < {_TO} AND other IN ('u1', 'u2', 'u3', 'c1') AND entity NOT IN (SELECT subject FROM m WHERE level = 'encounter' AND \"at\" > {_TO})")
def encounter_at(spark, d):
    """Who exchanged something with one of four in two weeks, and is not met after them."""
    s = fold(_talks(spark, d))
    others = s.entities.filter(F.col("entity").isin("u1", "u2", "u3", "c1"))
    found = met.with_encounter(s.entities, s.encounters, met.EXCHANGED, others, scope="during", lo=_FROM, hi=_TO)
    return met.with_encounter(found, s.encounters, no=True, scope="after", lo=_TO).select("entity")


@query("ask_entities", f"WITH {_MET} SELECT DISTINCT subject AS entity FROM m x WHERE level = 'encounter' AND through IS NULL AND \"at\" >= {_FROM} AND \"at\" < {_TO} AND who IN ('u1', 'u2') AND (CAST(substr(subject, 2) AS INT) % 9 IN (3, 4) OR subject IN (SELECT subject FROM m GROUP BY 1 HAVING min(\"at\") > {ms(2024, 1, 3) - 1}))")
def ask_entities(spark, d):
    """Articles that one of two users met in two weeks, and that two others made or no one had met in the first two days."""
    s = fold(_talks(spark, d))
    ids = lambda *names: Either(tuple((Has("id", "=", n),) for n in names))
    asked = [
        Has("type", "=", "Article"), During("during", _FROM, _TO, (Has("encountered", within=(ids("u1", "u2"),)),)),
        Either(((Has("creator", within=(ids("u3", "u4"),)),), (During("before", ms(2024, 1, 3), None, (Has("encountered", no=True),)),))),
    ]
    return entities_that(s, asked).select("entity")


_HOUR = 3_600_000


@query("ask_actions", f"WITH {ACTIONS_SQL} SELECT 'e' || id AS action FROM actions r WHERE type IN ('click', 'purchase') AND (agent * 7 + id) % 50 <> 7 AND EXISTS (SELECT 1 FROM actions a WHERE a.type = 'view' AND a.agent = r.agent AND a.t < r.t AND r.t - a.t <= {6 * _HOUR}) AND NOT EXISTS (SELECT 1 FROM actions a WHERE a.type = 'purchase' AND a.id <> r.id AND abs(a.t - r.t) <= {_HOUR // 6})")
def ask_actions(spark, d):
    """Messages, not to one user, within six hours after their writer read something, and without anyone's purchase within ten minutes."""
    s = fold(_talks(spark, d))
    asked = [Has("type", "=", "MessageAction"), Has("recipient", within=(Has("id", "=", "u7"),), no=True), Near("after", (Has("type", "=", "ReadAction"),), hi=6 * _HOUR)]
    bought = (Has("type", "=", "MessageAction"), Has("object", within=(Has("isPartOf"),)))
    return actions_that(s, [*asked, Near("near", bought, hi=_HOUR // 6, anyone=True, no=True)]).select("action")


_TOPS = "SELECT '{path}' AS facet, key, count FROM (SELECT {key} AS key, count(*) AS count FROM {rows} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8) UNION ALL SELECT '{path}', '@other', CAST(sum(count) AS BIGINT) FROM (SELECT count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {key}) AS rank FROM {rows} GROUP BY {key}) WHERE rank > 8 HAVING count(*) > 0"


@query(
    "summary_store",
    f"WITH {ACTIONS_SQL}, v AS (SELECT * FROM actions WHERE type = 'view') SELECT 'total' AS facet, '' AS key, count(*) AS count FROM v UNION ALL SELECT 'census', unnest(['timestamp', 'startTime', 'agent', 'object', 'object.creator']), count(*) FROM v "
    "UNION ALL SELECT 'census', unnest(['endTime', 'result', 'instrument', 'target', 'location', 'object.attachment']), 0 UNION ALL SELECT 'span', 'first', min(t) FROM v UNION ALL SELECT 'span', 'last', max(t) FROM v UNION ALL SELECT 'time:day', strftime(make_timestamp(t * 1000), '%Y-%m-%d'), count(*) FROM v GROUP BY 2 UNION ALL ("
    + _TOPS.format(path="agent.name", key="'User ' || agent", rows="v") + ") UNION ALL (" + _TOPS.format(path="object.creator.name", key="'User ' || (id % 40 % 9)", rows="v") + ")",
)
def summary_store(spark, d):
    return summary.of_actions(fold(_talks(spark, d)), [Has("type", "=", "ReadAction")])


@query("snapshot_absence", """WITH s AS (SELECT l_suppkey % 3 AS source, date_trunc('month', l_shipdate) AS ts, l_orderkey % 20 AS subject, l_returnflag || l_linenumber AS value FROM lineitem),
t AS (SELECT source, ts, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS next FROM (SELECT DISTINCT source, ts FROM s)),
v AS (SELECT DISTINCT source || '-' || subject AS subject, value, epoch_us(s.ts) // 1000 AS ts, epoch_us(next) // 1000 AS next FROM s JOIN t USING (source, ts)),
k AS (SELECT *, coalesce(lag(next) OVER (PARTITION BY subject, value ORDER BY ts) = ts, false) AS goes_on FROM v),
r AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY subject, value ORDER BY ts) AS run FROM k)
SELECT subject, value, min(ts) AS first_valid, max(ts) AS last_valid, arg_max_null(next, ts) AS period_to FROM r GROUP BY subject, value, run""")
def snapshot_absence(spark, d):
    """Monthly snapshots of three sources: a value ends at the first snapshot of its source without it."""
    at = millis(F.date_trunc("month", F.col("l_shipdate").cast("timestamp")))
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 3).cast("string").alias("source"), at.alias("valid_at"), (F.col("l_orderkey") % 20).cast("string").alias("s"), F.concat("l_returnflag", "l_linenumber").alias("value")).distinct()
    observed = rows.select("source", F.concat_ws("-", "source", "s").alias("subject"), "valid_at", F.col("valid_at").alias("observed_at"), "value", F.concat_ws(":", "source", "valid_at").alias("action"), F.lit(0).alias("grade"))
    whole = observed.drop("source").unionByName(runs.absences(observed, ["subject"], "source"))
    return runs.runs(whole, ["subject"], many=True).select("subject", "value", "first_valid", "last_valid", "period_to")


@query("attachment_refs", "SELECT doc_id, sha256(text) AS cid, 'text/plain' AS mime, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL")
def attachment_refs(spark, d):
    """Documents as payloads that carry their text inline; every node gets the hash of its content, every content is there once."""
    node = F.struct(F.lit("Document").alias("@type"), F.concat(F.lit("d"), "doc_id").alias("@id"), F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.replace(F.base64(F.encode("text", "utf-8")), F.lit("\r\n"), F.lit(""))).alias("contentData"))
    log = table(spark, d, "documents").select("doc_id", F.to_json(F.struct(F.lit("AddAction").alias("@type"), node.alias("object"))).alias("body"))
    kept, blobs, _ = attachments.extracted(log)
    of = kept.select("doc_id", F.get_json_object("body", "$.object.attachmentCid").alias("cid"), F.get_json_object("body", "$.object.mimeType").alias("mime")).filter("cid is not null")
    return of.join(blobs.select("cid", F.octet_length("content").cast("long").alias("size")), "cid").select("doc_id", "cid", "mime", "size")


@query("page_with_places", "WITH o AS (SELECT c_custkey, c_nationkey, max(epoch_us(o_orderdate) // 1000) AS recent FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), u AS (SELECT 'entity' AS kind, CAST(c_custkey AS VARCHAR) AS key, 'Customer ' || c_custkey AS label, recent FROM o UNION ALL SELECT 'place', CAST(n_nationkey AS VARCHAR), any_value(n_name), max(recent) FROM o JOIN nation ON n_nationkey = c_nationkey GROUP BY n_nationkey) SELECT * FROM u WHERE recent < 1000000000000 ORDER BY recent DESC, kind, key LIMIT 101")
def page_with_places(spark, d):
    """Customers and their nations' places in one page, by when they were last met, after a cursor."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), millis("o_orderdate").alias("t")).groupBy("key").agg(F.max("t").alias("recent"))
    met_at = orders.join(table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("n")), "key")
    of_places = met_at.groupBy(F.col("n").alias("key")).agg(F.max("recent").alias("recent")).join(table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")), "key")
    return places.united_page(met_at.withColumn("label", F.concat(F.lit("Customer "), "key")), of_places, "recent", 100, (1_000_000_000_000, "place", "~"))


@query("geo_object_location", """WITH h AS (SELECT c_custkey AS k, c_nationkey * 2.0 + (c_custkey % 10) / 100.0 AS lat, c_nationkey * 3.0 AS lon FROM customer WHERE c_custkey % 4 <> 0),
m AS (SELECT o_orderstatus AS l, CASE WHEN o_orderkey % 3 = 0 THEN (o_orderkey % 50) / 1.0 ELSE lat END AS lat, CASE WHEN o_orderkey % 3 = 0 THEN 10.0 ELSE lon END AS lon FROM orders LEFT JOIN h ON k = o_custkey),
c AS (SELECT CAST(round(lat / (25 / 111.0)) AS BIGINT) AS cell_lat, CAST(round(lon / (25 / 111.0)) AS BIGINT) AS cell_lon, l, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM m WHERE lat IS NOT NULL GROUP BY 1, 2, 3)
SELECT cell_lat, cell_lon, round(arg_min(lat, (-n, l)), 6) AS lat, round(arg_min(lon, (-n, l)), 6) AS lon, CAST(sum(n) AS BIGINT) AS count, arg_min(l, (-n, l)) AS label FROM c GROUP BY 1, 2""")
def geo_object_location(spark, d):
    """Orders on a grid: a third have a point, the others are where their customer is now, if anywhere."""
    at = lambda c: F.when(F.col("o_orderkey") % 3 == 0, c)
    acts = table(spark, d, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderstatus").alias("label"), at((F.col("o_orderkey") % 50) / 1.0).alias("lat"), at(F.lit(10.0)).alias("lon"))
    held = table(spark, d, "customer").select(
        F.col("c_custkey").alias("entity"), F.when(F.col("c_custkey") % 4 == 0, 1).alias("period_to"), F.col("c_nationkey").cast("string").alias("place"),
        (F.col("c_nationkey") * 2.0 + (F.col("c_custkey") % 10) / 100.0).cast("double").alias("lat"), (F.col("c_nationkey") * 3.0).cast("double").alias("lon"),
    )
    found = places.grid(acts, held, 25, "label")
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("shaped_json", """SELECT 'c' || c_custkey AS entity, '{"@id":"c' || c_custkey || '","name":"C ' || c_custkey || '","nation":[{"@id":"n' || n_nationkey || '","name":"' || n_name || '","customers":' || k.l || ',"region":[{"@id":"r' || r_regionkey || '","name":"' || r_name || '"}]}],"segment":["' || c_mktsegment || '"]}' AS json
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey JOIN (SELECT c_nationkey AS n, c_custkey % 2 AS odd, '[' || string_agg('{"@id":"c' || c_custkey || '","name":"C ' || c_custkey || '"}', ',' ORDER BY '{"@id":"c' || c_custkey || '","name":"C ' || c_custkey || '"}') || ']' AS l FROM (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY c_nationkey) GROUP BY ALL) k ON k.n = c_nationkey""")
def shaped_json(spark, d):
    """Customers with their nation, its region and its first customer, as JSON: what leads back is only named."""
    who, lands, parts = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    cid, nid, rid = (F.concat(F.lit(p), c) for p, c in (("c", "c_custkey"), ("n", "c_nationkey"), ("r", "n_regionkey")))
    none = lambda kind: F.lit(None).cast(kind)
    thing = lambda df, key, name: df.select(key.alias("entity"), name.alias("name"), none("array<string>").alias("types"))
    lands = lands.withColumn("c_nationkey", F.col("n_nationkey"))
    entities = thing(who, cid, F.concat(F.lit("C "), "c_custkey")).unionByName(thing(lands, nid, F.col("n_name"))).unionByName(thing(parts, F.concat(F.lit("r"), "r_regionkey"), F.col("r_name")))
    said = lambda df, e, p, v=None, o=None: df.select(e.alias("entity"), F.lit(p).alias("predicate"), (v if v is not None else none("string")).alias("value"), (o if o is not None else none("string")).alias("object"), none("long").alias("period_from"), none("long").alias("period_to"))
    first = who.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    properties = said(who, cid, "segment", F.concat(F.lit('"'), "c_mktsegment", F.lit('"'))).unionByName(said(who, cid, "nation", o=nid)).unionByName(said(lands, nid, "region", o=rid)).unionByName(said(first, nid, "customers", o=cid))
    return project.shaped(entities, properties, thing(who, cid, cid), {"segment": None, "nation": {"region": None, "customers": None}})


@query("mails_folded", "SELECT 'bot' || conv_id % 7 || '@x.org' AS handle, count(*) AS exchanged, min(1700000000000 + conv_id * 1000000 + turn * 1000) AS first FROM conversations GROUP BY 1")
def mails_folded(spark, d):
    """Turns as mails between their owner and one of seven others, as payloads folded: with whom how much was exchanged."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    one = lambda address, name: F.struct(address.alias("address"), name.alias("name"))
    me, bot = one(F.lit("Me@x.org"), F.lit("I")), one(F.concat(F.lit("Bot"), F.col("conv_id") % 7, F.lit("@x.org")), F.lit(None).cast("string"))
    asks = F.col("role") == "user"
    mid = lambda turn: F.concat(F.lit("<"), "conv_id", F.lit("."), turn, F.lit("@x.org>"))
    mail = rows.select(
        mid(F.col("turn")).alias("message_id"), (F.lit(1_700_000_000_000) + F.col("conv_id") * 1_000_000 + F.col("turn") * 1000).alias("at"), F.when(asks, me).otherwise(bot).alias("sender"), F.array(F.when(asks, bot).otherwise(me), F.when(asks, bot).otherwise(me)).alias("recipients"),
        F.concat(F.lit("Re "), "conv_id").alias("subject"), F.col("text"), F.when(F.col("turn") > 0, mid(F.col("turn") - 1)).alias("reply_to"), F.array().cast("array<string>").alias("tags"),
    )
    log = payloads.mails(mail, ["me@x.org"]).select(payloads.asserted(F.col("payload"), snapshot=False).alias("body"), F.lit(0).cast("long").alias("asserted_at"))
    s = fold(log)
    own = s.entities.filter("me").select("entity")
    each = met.sides(s.encounters, met.EXCHANGED).join(own, "entity").groupBy(F.col("other").alias("entity")).agg(F.count("*").alias("exchanged"), F.min("at").alias("first"))
    seen = s.properties.filter("predicate = 'handle' and period_to is null").groupBy("entity").agg(F.min(F.expr("substring(value, 2, length(value) - 2)")).alias("handle"))
    return each.join(seen, "entity").select("handle", "exchanged", "first")
