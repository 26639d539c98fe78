"""Joins: links, time distance, overlap, as-of."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.operators import links, near
from yore.operators.components import resolve
from yore.operators.runs import toggled
from yore.plans.base import ACTIONS_SQL, DAY, SPANS_SQL, actions, query, spans, table

HOUR = 3_600_000


def customers(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))


@query("semi_association", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_association(spark, d):
    return links.having(customers(spark, d), orders(spark, d).filter("price > 400000"), ["id"]).select("id")


@query("anti_association", "SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_association(spark, d):
    return links.having(customers(spark, d), orders(spark, d).filter("price > 400000"), ["id"], no=True).select("id")


@query("or_existence", "SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 480000)")
def or_existence(spark, d):
    found = links.flagged(customers(spark, d), orders(spark, d).filter("price > 480000"), ["id"], "rich")
    return found.filter("nation = 3 or rich").select("id")


@query("disjunctive_join", "SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000) OR EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)")
def disjunctive_join(spark, d):
    rich = orders(spark, d).filter("price > 490000")
    near_by = table(spark, d, "supplier").filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation"))
    return links.either(customers(spark, d), [(rich, ["id"]), (near_by, ["nation"])]).select("id")


def _cardinality(name: str, op: str, n: int):
    @query(name, f"SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE coalesce(n, 0) {op} {n}")
    def count_links(spark, d):
        return links.counted(customers(spark, d), orders(spark, d), ["id"], op, n).select("id")


for _name, _op, _n in (("count_cardinality_eq", "=", 10), ("count_cardinality_gt", ">", 15), ("count_cardinality_ge", ">=", 15), ("count_cardinality_lt", "<", 6), ("count_cardinality_le", "<=", 5)):
    _cardinality(_name, _op, _n)


@query("every_neighbor", "SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND NOT (l_quantity > 20))")
def every_neighbor(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), "l_quantity")
    return links.every(rows, lines, ["id"], F.col("l_quantity") > 20)


@query("inverse_edge", "SELECT p_partkey AS id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount = 0.1)")
def inverse_edge(spark, d):
    lines = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_discount = 0.1").select(F.col("l_partkey").alias("id"))
    return links.having(table(spark, d, "part").select(F.col("p_partkey").alias("id")), lines, ["id"])


@query("backlinks", "SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_partkey = 7 ORDER BY id DESC")
def backlinks(spark, d):
    return table(spark, d, "lineitem").filter("l_partkey = 7").select(F.col("l_orderkey").alias("id")).distinct().orderBy(F.desc("id"))


@query("nested_traversal", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))))")
def nested_traversal(spark, d):
    region = table(spark, d, "region").filter("r_name = 'ASIA'").select(F.col("r_regionkey").alias("n_regionkey"))
    nation = links.having(table(spark, d, "nation"), region, ["n_regionkey"]).select(F.col("n_nationkey").alias("s_nationkey"))
    supplier = links.having(table(spark, d, "supplier"), nation, ["s_nationkey"]).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = links.having(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), supplier, ["l_suppkey"]).select(F.col("l_orderkey").alias("id"))
    return links.having(table(spark, d, "orders").select(F.col("o_orderkey").alias("id")), lines, ["id"])


@query("negated_role", "SELECT s_suppkey AS id FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey WHERE coalesce(n_regionkey <> 1, true)")
def negated_role(spark, d):
    nation = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return links.having(table(spark, d, "supplier"), nation, ["s_nationkey"], no=True).select(F.col("s_suppkey").alias("id"))


@query("role_edges_pivot", "SELECT l_orderkey AS id, count(DISTINCT l_suppkey) AS suppliers, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def role_edges_pivot(spark, d):
    flags = F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.countDistinct("l_suppkey").alias("suppliers"), flags.alias("flags"))


@query("cooccur_same_action", "WITH l AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS size FROM l GROUP BY 1) SELECT l_suppkey AS member, count(*) AS n_events, CAST(sum(size - 1) AS BIGINT) AS n_others FROM l JOIN n USING (l_orderkey) WHERE size > 1 GROUP BY 1")
def cooccur_same_action(spark, d):
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("member"))
    return links.together(edges, "event", "member")


def _distance(name: str, kind: str, by: bool, lo: str, width: int, condition: str):
    @query(name, f"WITH {ACTIONS_SQL} SELECT r.id FROM actions r WHERE r.type = 'purchase' AND EXISTS (SELECT 1 FROM actions a WHERE a.type = '{kind}'{' AND a.agent = r.agent' if by else ''} AND {condition})")
    def within(spark, d):
        every = actions(spark, d)
        roots = every.filter("type = 'purchase'").select("id", "agent", "t")
        anchors = every.filter(F.col("type") == kind).select("agent", F.col("t").alias("p"))
        return near.has_point_within(roots, anchors, F.expr(lo), width, "p", ["agent"] if by else None).filter("near").select("id")


_GAP = 6 * HOUR
_distance("after_gap", "view", True, f"t - {_GAP} + 1", _GAP - 2, f"a.t < r.t AND r.t - a.t < {_GAP}")
_distance("before_gap", "error", True, "t + 1", _GAP - 2, f"a.t > r.t AND a.t - r.t < {_GAP}")
_distance("after_range", "click", True, f"t - {48 * HOUR}", 24 * HOUR, f"r.t - a.t BETWEEN {24 * HOUR} AND {48 * HOUR}")
_distance("near_gap", "signup", True, f"t - {_GAP} + 1", 2 * _GAP - 2, f"abs(r.t - a.t) < {_GAP}")
_distance("near_anyone", "error", False, "t - 59999", 119_998, "abs(r.t - a.t) < 60000")


@query("after_any", f"WITH {ACTIONS_SQL} SELECT r.id FROM actions r WHERE r.type = 'purchase' AND EXISTS (SELECT 1 FROM actions a WHERE a.type = 'view' AND a.agent = r.agent AND a.t < r.t)")
def after_any(spark, d):
    every = actions(spark, d)
    first = every.filter("type = 'view'").groupBy("agent").agg(F.min("t").alias("first"))
    return every.filter("type = 'purchase'").join(first, "agent").filter("first < t").select("id")


@query("while_overlap", f"WITH {SPANS_SQL} SELECT r.id, count(*) AS overlaps FROM spans r JOIN spans a ON a.agent = r.agent AND a.id <> r.id AND a.s <= r.e AND a.e >= r.s GROUP BY r.id")
def while_overlap(spark, d):
    rows = spans(spark, d)
    found = near.count_overlapping(rows, rows, "s", "e", 90 * DAY, ["agent"])
    return found.select("id", (F.col("overlaps") - 1).alias("overlaps")).filter("overlaps > 0")


@query("asof_metric_latest", f"WITH {ACTIONS_SQL} SELECT r.id, (SELECT a.value FROM actions a WHERE a.type = 'view' AND a.agent = r.agent AND a.t <= r.t ORDER BY a.t DESC, a.value DESC LIMIT 1) AS reading FROM actions r WHERE r.type = 'purchase'")
def asof_metric_latest(spark, d):
    every = actions(spark, d)
    facts = every.filter("type = 'view'").select("agent", F.col("t").alias("since"), F.col("value").alias("reading"))
    return near.as_of(every.filter("type = 'purchase'").select("id", "agent", "t"), facts, ["agent"], "t", "since", ["reading"], 7 * DAY).select("id", "reading")


@query("latest_metric_compare", f"WITH {ACTIONS_SQL}, l AS (SELECT agent, arg_max(value, (t, value)) AS v FROM actions GROUP BY agent) SELECT agent AS id, v AS reading FROM l WHERE v > 45")
def latest_metric_compare(spark, d):
    last = actions(spark, d).groupBy(F.col("agent").alias("id")).agg(F.max_by("value", F.struct("t", "value")).alias("reading"))
    return last.filter("reading > 45")


_RUNS = "runs AS (SELECT agent, t AS f, lead(t) OVER (PARTITION BY agent ORDER BY t, id) AS u, open FROM (SELECT *, lag(open, 1, false) OVER (PARTITION BY agent ORDER BY t, id) AS was FROM (SELECT agent, t, id, type = 'signup' AS open FROM actions WHERE type IN ('signup', 'error'))) WHERE open <> was)"


@query("while_asof_agent", f"WITH {ACTIONS_SQL}, {_RUNS} SELECT a.id FROM actions a WHERE a.type = 'view' AND EXISTS (SELECT 1 FROM runs r WHERE r.agent = a.agent AND r.open AND r.f <= a.t AND (r.u IS NULL OR r.u > a.t))")
def while_asof_agent(spark, d):
    every = actions(spark, d)
    runs = toggled(every, ["agent"], "type", "t", "signup", "error", "id")
    found = near.as_of(every.filter("type = 'view'").select("id", "agent", "t"), runs.select("agent", F.col("period_from").alias("since"), F.coalesce("period_to", F.lit(2**62)).alias("until")), ["agent"], "t", "since", ["until"], 7 * DAY)
    return found.filter("until > t").select("id")


@query("connected_components", "WITH RECURSIVE e AS (SELECT DISTINCT 'c' || o_custkey AS a, 'p' || l_partkey AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50 AND l_discount >= 0.09), v AS (SELECT a FROM e UNION SELECT b FROM e), r AS (SELECT a AS n, a AS l FROM v UNION SELECT CASE WHEN r.n = e.a THEN e.b ELSE e.a END, r.l FROM r JOIN e ON r.n = e.a OR r.n = e.b) SELECT n AS record, min(l) AS entity FROM r WHERE n LIKE 'c%' GROUP BY 1")
def connected_components(spark, d):
    lines = table(spark, d, "lineitem").filter("l_quantity >= 50 and l_discount >= 0.09").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("p"))
    edges = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("record")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    keys = edges.groupBy("record").agg(F.collect_set("p").alias("k")).select("record", F.array_append("k", F.col("record")).alias("keys"))
    return resolve(keys, "record", "keys")


@query("left_enrich", "SELECT o_orderkey AS id, c_name AS name, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def left_enrich(spark, d):
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    return o.join(c, o.o_custkey == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left").select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("nation"))


@query("neighbourhood_two_hops", "WITH a AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_partkey = 3), b AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_suppkey IN (SELECT l_suppkey FROM a)) SELECT 's' AS kind, l_suppkey AS id FROM a UNION ALL SELECT 'p', l_partkey FROM b")
def neighbourhood_two_hops(spark, d):
    edges = table(spark, d, "lineitem").select("l_partkey", "l_suppkey")
    first = edges.filter("l_partkey = 3").select("l_suppkey").distinct()
    second = edges.join(first, "l_suppkey", "left_semi").select("l_partkey").distinct()
    return first.select(F.lit("s").alias("kind"), F.col("l_suppkey").alias("id")).union(second.select(F.lit("p"), "l_partkey"))


@query("set_operations", "(SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def set_operations(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, d, "supplier").select("s_nationkey")
    n = table(spark, d, "nation").filter("n_regionkey = 0").select("n_nationkey")
    return c.intersect(s).subtract(n)
