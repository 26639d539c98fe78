"""Distances between intervals, pinned scopes, incremental folds, summaries, checks and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.functions import texts, times
from yore.operators import near, project, runs, steps
from yore.operators.intervals import millis
from yore.operators.pages import actions_page, recency
from yore.operators.summary import summary
from yore.plans import fold
from yore.plans.base import DAY, SPANS_SQL, query, spans, table


def _spans(name: str, kind: str, lo: int, hi: int, sql: str):
    @query(name, f"WITH {SPANS_SQL} SELECT r.id FROM spans r WHERE r.status = 'F' AND EXISTS (SELECT 1 FROM spans a WHERE a.status = 'P' AND a.agent = r.agent AND {sql})")
    def found(spark, d):
        rows = spans(spark, d)
        roots, anchors = rows.filter("status = 'F'").select("id", "agent", "s", "e"), rows.filter("status = 'P'").select("agent", "s", "e")
        return near.has_span_within(roots, anchors, "s", "e", kind, lo, hi, 90 * DAY, ["agent"]).filter("near").select("id")


_spans("after_span", "after", 0, 20 * DAY, f"a.e < r.s AND r.s - a.e <= {20 * DAY}")
_spans("after_span_range", "after", 10 * DAY, 30 * DAY, f"r.s - a.e BETWEEN {10 * DAY} AND {30 * DAY}")
_spans("before_span", "before", 0, 20 * DAY, f"a.s > r.e AND a.s - r.e <= {20 * DAY}")
_spans("near_span", "near", 0, 5 * DAY, f"greatest(a.s - r.e, r.s - a.e, 0) <= {5 * DAY}")
_spans("near_span_range", "near", 10 * DAY, 20 * DAY, f"greatest(a.s - r.e, r.s - a.e, 0) BETWEEN {10 * DAY} AND {20 * DAY}")


@query("during_pinned", f"WITH {SPANS_SQL} SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM spans a WHERE a.status = 'F' AND a.agent = o_custkey AND a.s <= epoch_us(o_orderdate) // 1000 AND a.e > epoch_us(o_orderdate) // 1000)")
def during_pinned(spark, d):
    rows = table(spark, d, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("agent"), millis("o_orderdate").alias("t"))
    return near.held_at(rows, spans(spark, d).filter("status = 'F'"), "t", "s", "e", 90 * DAY, ["agent"]).filter("held").select("id")


def _split(spark, d):
    """Observations, and those of the first three weeks."""
    whole = fold.observed(spark, d)
    return whole, whole.filter(F.col("valid_at") < 1_705_795_200_000)


@query("fold_incremental", fold.ORACLE_OF_RUNS)
def fold_incremental(spark, d):
    whole, before = _split(spark, d)
    late = whole.filter(F.col("valid_at") >= 1_705_795_200_000)
    found = runs.refolded(runs.runs(before, ["subject"]), whole, late, ["subject"])
    return found.select("subject", "value", "period_from", "period_to", "first_valid", "last_valid", "n")


@query("fold_incremental_many", fold.ORACLE_OF_MANY)
def fold_incremental_many(spark, d):
    whole, before = _split(spark, d)
    late = whole.filter(F.col("valid_at") >= 1_705_795_200_000)
    found = runs.refolded(runs.runs(before, ["subject"], many=True), whole, late, ["subject"], many=True)
    return found.select("subject", "value", "first_valid", "last_valid", "period_to", "n")


@query("fold_changes")
def fold_changes(spark, d):
    whole, before = _split(spark, d)
    return runs.changes(runs.runs(before, ["subject"]), runs.runs(whole, ["subject"]), ["subject"])


@query("confirm_recency", "WITH b AS (SELECT doc_id, md5(text) AS claim FROM documents) SELECT claim, min(doc_id) AS first, max(doc_id) AS last_confirmed FROM b GROUP BY 1")
def confirm_recency(spark, d):
    log = runs.gate(table(spark, d, "documents").select("doc_id", F.md5("text").alias("claim")).withColumn("at", F.col("doc_id")), "doc_id", "claim", "at")
    kept = log.filter("kind = 'assert'").select("claim", F.col("at").alias("first"), F.col("at").alias("last_confirmed"))
    return runs.confirmed(kept, log.filter("kind = 'confirm'"), "claim", "at", "first", "last_confirmed")


@query("lifecycle_hoist", "SELECT 'BirthAction:' || o_custkey AS action, o_custkey AS subject, max(epoch_us(o_orderdate) // 1000) AS earliest, min(epoch_us(o_orderdate) // 1000 + CAST(o_totalprice * 1000000 AS BIGINT)) AS latest, count(*) AS sightings FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def lifecycle_hoist(spark, d):
    at = millis("o_orderdate")
    told = table(spark, d, "orders").select(
        F.col("o_custkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "birthDate").otherwise("name").alias("predicate"), at.alias("earliest"), (at + F.round(F.col("o_totalprice") * 1_000_000).cast("long")).alias("latest"), at.alias("observed_at")
    )
    return runs.hoisted(told, {"birthDate": "BirthAction", "deathDate": "DeathAction"})[1].select("action", "subject", "earliest", "latest", "sightings")


@query("identifiers_elected", "WITH b AS (SELECT l_orderkey AS subject, arg_min(l_shipmode, (l_returnflag = 'R', -epoch_us(l_shipdate), l_shipmode)) AS h, min(l_returnflag = 'R') AS closed FROM (SELECT l_orderkey, l_returnflag, l_shipdate, CAST(l_suppkey AS VARCHAR) AS l_shipmode FROM lineitem) GROUP BY 1) SELECT subject, CASE WHEN NOT closed THEN h END AS handle FROM b")
def identifiers_elected(spark, d):
    at = millis("l_shipdate")
    found = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("subject"), F.lit("handle").alias("predicate"), F.col("l_suppkey").cast("string").alias("value"), F.when(F.col("l_returnflag") == "R", at).alias("period_to"), F.lit(0).alias("grade"), at.alias("last_valid"), at.alias("last_observed")
    )
    return runs.identifiers(found, ["handle"])


_FACET = "SELECT '{path}' AS facet, key, count FROM (SELECT CAST({value} AS VARCHAR) AS key, count(*) AS count FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8)"
_OTHER = "SELECT '{path}', '@other', CAST(sum(count) AS BIGINT) FROM (SELECT count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, CAST({value} AS VARCHAR)) AS rank FROM {rows} WHERE {value} IS NOT NULL GROUP BY {value}) WHERE rank > 8 HAVING count(*) > 0"


@query(
    "summary_facets",
    "WITH o AS (SELECT orders.*, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey) SELECT 'total' AS facet, '' AS key, count(*) AS count FROM o UNION ALL SELECT 'census', unnest(['customer.name', 'order', 'priority', 'segment', 'status']), count(*) FROM o "
    "UNION ALL SELECT 'span', 'first', min(epoch_us(o_orderdate) // 1000) FROM o UNION ALL SELECT 'span', 'last', max(epoch_us(o_orderdate) // 1000) FROM o UNION ALL SELECT 'time:year', strftime(o_orderdate, '%Y'), count(*) FROM o GROUP BY 2 UNION ALL ("
    + ") UNION ALL (".join(f.format(path=p, value=v, rows="o") for p, v in (("customer.name", "c_name"), ("priority", "o_orderpriority"), ("segment", "c_mktsegment"), ("status", "o_orderstatus")) for f in (_FACET, _OTHER))
    + ")",
)
def summary_facets(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("t", millis("o_orderdate"))
    paths = {"status": F.col("o_orderstatus"), "customer.name": F.col("c_name"), "priority": F.col("o_orderpriority"), "order": F.col("o_orderkey"), "segment": F.col("c_mktsegment")}
    return summary(rows, paths, named=["customer.name"], at="t", always=["status"])


@query(
    "summary_entities",
    "WITH c AS (SELECT c_mktsegment, n_name, CASE WHEN c_acctbal > 0 THEN c_acctbal > 5000 END AS rich FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT 'total' AS facet, '' AS key, count(*) AS count FROM c UNION ALL SELECT 'census', 'nation.name', count(*) FROM c UNION ALL SELECT 'census', 'rich', count(rich) FROM c UNION ALL SELECT 'census', 'type', count(*) FROM c UNION ALL ("
    + ") UNION ALL (".join(f.format(path=p, value=v, rows="c") for p, v in (("rich", "rich"), ("type", "c_mktsegment")) for f in (_FACET, _OTHER))
    + ")",
)
def summary_entities(spark, d):
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    paths = {"type": F.col("c_mktsegment"), "nation.name": F.col("n_name"), "rich": F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 5000)}
    return summary(rows, paths, named=["nation.name"], always=["type"], leave=["nation.name"])


@query("validate_rows", "SELECT o_orderkey AS id, CASE WHEN o_totalprice > 1000 THEN '' ELSE 'price' END || CASE WHEN o_orderpriority IS NOT NULL AND o_orderstatus <> 'P' THEN '' ELSE ',status' END AS errors FROM orders WHERE o_totalprice <= 1000 OR o_orderstatus = 'P'")
def validate_rows(spark, d):
    _, rejects = steps.typed(table(spark, d, "orders"), {"price": F.col("o_totalprice") > 1000, ",status": F.col("o_orderstatus") != "P"})
    return rejects.select(F.col("o_orderkey").alias("id"), F.array_join("errors", "").alias("errors"))


@query("validated_rows", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 1000 AND o_orderstatus <> 'P'")
def validated_rows(spark, d):
    return steps.typed(table(spark, d, "orders"), {"price": F.col("o_totalprice") > 1000, "status": F.col("o_orderstatus") != "P"})[0].select(F.col("o_orderkey").alias("id"))


@query("dispatch_union", "SELECT event_id AS id, value AS amount, NULL::VARCHAR AS fault FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, NULL, 'fault ' || user_id FROM events WHERE event_type = 'error'")
def dispatch_union(spark, d):
    rows = table(spark, d, "events").withColumnRenamed("event_id", "id")
    routes = {"purchase": lambda df: df.select("id", F.col("value").alias("amount")), "error": lambda df: df.select("id", F.concat(F.lit("fault "), "user_id").alias("fault"))}
    return steps.dispatched(rows, "event_type", routes)


@query("step_chain", "SELECT id, unnest(range(1, k % 4 + 1)) AS part FROM (SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'view') WHERE k % 4 > 0")
def step_chain(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    each = steps.flat(F.when(k % 4 > 0, F.sequence(F.lit(1).cast("long"), k % 4)), "part")
    return steps.chain(table(spark, d, "events"), [lambda df: df.filter("event_type <> 'view'"), each, lambda df: df.select(F.col("event_id").alias("id"), "part")])


@query("combine_kinds", "SELECT o_orderkey AS id, (epoch_us(o_orderdate) // 1000) AS occurred_at FROM orders UNION ALL SELECT event_id, (epoch_us(ts) // 1000) FROM events")
def combine_kinds(spark, d):
    return steps.combined([table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), millis("o_orderdate").alias("occurred_at")), table(spark, d, "events").select(F.col("event_id").alias("id"), millis("ts").alias("occurred_at"))])


_DATES = [
    ("strftime(o_orderdate, '%Y-%m-%d')", 0, 1, 1), ("strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')", 1, 1, 0), ("strftime(o_orderdate, '%Y-02-30')", 0, 0, 0), ("strftime(o_orderdate, '%Y-13')", 0, 0, 0), ("left(strftime(o_orderdate, '%Y'), 3) || 'X?'", 0, 1, 1),
    ("strftime(o_orderdate, '%Y-XX-05')", 0, 0, 0), ("strftime(o_orderdate, '%Y-%m') || '/' || strftime(o_orderdate, '%Y-%m-%d')", 0, 0, 1), ("strftime(o_orderdate, '%Y') || '/1990'", 0, 0, 0), ("strftime(o_orderdate, '%Y') || '/20XX~'", 0, 0, 1), ("'XXXX-05'", 0, 1, 1), ("strftime(o_orderdate, '%Y-%m-%dT25:00:00Z')", 0, 0, 0),
]


@query(
    "date_forms",
    "SELECT o_orderkey AS id, " + ", ".join(f"CASE o_orderkey % {len(_DATES)} " + " ".join(f"WHEN {i} THEN {'true' if x[j] else 'false'}" for i, x in enumerate(_DATES)) + f" END AS {name}" for j, name in ((1, "instant"), (2, "date_time"), (3, "date_range"))) + " FROM orders",
)
def date_forms(spark, d):
    at = lambda form: F.date_format("o_orderdate", form)
    said = [
        at("yyyy-MM-dd"), at("yyyy-MM-dd'T'HH:mm:ss'Z'"), at("yyyy-'02-30'"), at("yyyy-'13'"), F.concat(F.substring(at("yyyy"), 1, 3), F.lit("X?")), at("yyyy-'XX-05'"),
        F.concat(at("yyyy-MM"), F.lit("/"), at("yyyy-MM-dd")), at("yyyy'/1990'"), at("yyyy'/20XX~'"), F.lit("XXXX-05"), at("yyyy-MM-dd'T25:00:00Z'"),
    ]
    text = F.get(F.array(*said), (F.col("o_orderkey") % len(said)).cast("int"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("x"))
    return rows.select("id", times.is_instant(F.col("x")).alias("instant"), times.is_date_time(F.col("x")).alias("date_time"), times.is_date_range(F.col("x")).alias("date_range"))


def _node():
    """A payload that names itself, its object, its result, or nothing, by the event's id."""
    name = F.concat(F.lit("n "), F.col("event_id"))
    forms = [
        F.to_json(F.struct(F.lit("T").alias("@type"), name.alias("title"), F.lit(7).alias("name"))), F.to_json(F.struct(F.lit("").alias("name"), F.struct(name.alias("handle")).alias("object"))),
        F.to_json(F.struct(F.lit("U").alias("@type"), F.struct(F.lit(3).alias("n")).alias("object"), F.struct(name.alias("text")).alias("result"), F.lit("2024").alias("startTime"))), F.to_json(F.struct(F.lit(1).alias("k"))),
    ]
    which = F.col("event_id") % 4
    return F.when(which == 0, forms[0]).when(which == 1, forms[1]).when(which == 2, forms[2]).when(which == 3, forms[3])  # only the one that is asked for is made


@query("node_label", "SELECT event_id AS id, CASE WHEN event_id % 4 < 3 THEN 'n ' || event_id END AS label FROM events")
def node_label(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), texts.node_label(_node()).alias("label"))


@query("record_label", "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'T' WHEN 2 THEN 'U' ELSE 'records' END AS type, CASE WHEN event_id % 4 < 3 THEN 'n ' || event_id END AS title, CASE WHEN event_id % 4 = 2 THEN '2024' END AS date FROM events")
def record_label(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), texts.record_label(_node()).alias("l")).select("id", "l.*")


def _records(spark, d):
    handle = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("h"), F.col("l_suppkey")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("source"), F.struct("l_suppkey", "l_partkey").alias("key"), handle.alias("handle"), F.concat(F.lit("u"), F.col("l_partkey")).alias("url"), (F.col("l_suppkey") % 7 == 0).alias("canonical"))


@query("first_handle", "SELECT l_orderkey AS entity, 'h' || arg_min(l_suppkey, (l_returnflag, l_suppkey, l_partkey)) AS handle FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1")
def first_handle(spark, d):
    return project.first_handles(_records(spark, d))


@query("best_url", "SELECT l_orderkey AS entity, 'u' || arg_min(l_partkey, (l_suppkey % 7 <> 0, l_returnflag, l_suppkey, l_partkey)) AS url FROM lineitem GROUP BY 1")
def best_url(spark, d):
    return project.best_urls(_records(spark, d))


@query("best_image", "SELECT o_orderkey AS entity, coalesce(b, u, s) AS image, CASE WHEN b IS NOT NULL THEN 'blob' WHEN u IS NOT NULL THEN 'url' ELSE 'snapshot' END AS kind FROM orders LEFT JOIN (SELECT l_orderkey AS k, min('b' || l_partkey) FILTER (l_returnflag = 'A') AS b, min('u' || l_suppkey) FILTER (l_returnflag = 'R') AS u, arg_max('s' || l_partkey, l_partkey * 1000 + l_suppkey) FILTER (l_returnflag = 'N') AS s FROM lineitem GROUP BY 1) ON k = o_orderkey WHERE coalesce(b, u, s) IS NOT NULL")
def best_image(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "entity")
    of = lambda flag, *cols: lines.filter(F.col("l_returnflag") == flag).select("entity", *cols)
    part = lambda p, c: F.concat(F.lit(p), F.col(c))
    shots = of("N", part("s", "l_partkey").alias("cid"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("media"))
    return project.images(table(spark, d, "orders").select(F.col("o_orderkey").alias("entity")), of("A", part("b", "l_partkey").alias("cid")), of("R", part("u", "l_suppkey").alias("url")), shots)


@query("place_of_value", "SELECT o_orderkey AS id, n_name AS place FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey")
def place_of_value(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("at"))
    return project.named_places(rows, table(spark, d, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("value"), F.col("n_name").alias("name")), "at").select("id", "place")


@query("canonical_snapshot", "SELECT '{\"key\":' || n_nationkey || ',\"name\":' || CASE WHEN n_regionkey = 1 THEN 'null' ELSE '\"' || n_name || '\"' END || '}' AS line FROM nation")
def canonical_snapshot(spark, d):
    return project.snapshot(table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("name"), F.col("n_nationkey").alias("key")))


@query("page_actions_ended", f"WITH {SPANS_SQL} SELECT id FROM spans WHERE (coalesce(e, s), id) < (904608000000, 9000) ORDER BY coalesce(e, s) DESC, id DESC LIMIT 21")
def page_actions_ended(spark, d):
    return actions_page(spans(spark, d), 20, (904_608_000_000, 9000), "s", "e").select("id")


@query("page_recency_others", "SELECT c_custkey AS id, coalesce(max(epoch_us(o_orderdate) // 1000), 0) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 WHERE c_custkey <> 7 GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 50")
def page_recency_others(spark, d):
    met = table(spark, d, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"), millis("o_orderdate").alias("t"))
    found = recency(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), "id", met, "t", 0, self_key=7)
    return found.orderBy(F.desc("recent"), F.desc("id")).limit(50)
