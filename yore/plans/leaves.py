"""Pages, filters and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.functions import texts
from yore.operators import intervals, pages
from yore.plans.base import ACTIONS_SQL, DAY, SPANS_SQL, actions, ms, query, spans, table

LATE = ms(2024, 1, 20)


@query("page_actions_newest", f"WITH {ACTIONS_SQL} SELECT id, type, t FROM actions ORDER BY t DESC, id DESC LIMIT 101")
def page_actions_newest(spark, d):
    return pages.page(actions(spark, d).select("id", "type", "t"), [F.desc("t"), F.desc("id")], 100)


@query("page_actions_cursor", f"WITH {ACTIONS_SQL} SELECT id, type, t FROM actions WHERE t < {LATE} OR (t = {LATE} AND id < 500) ORDER BY t DESC, id DESC LIMIT 101")
def page_actions_cursor(spark, d):
    return pages.page(actions(spark, d).select("id", "type", "t"), [F.desc("t"), F.desc("id")], 100, pages.after_key([("t", True), ("id", True)], [LATE, 500]))


@query("page_entities_keyset", "SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey > 40 ORDER BY c_custkey LIMIT 51")
def page_entities_keyset(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return pages.page(rows, [F.asc("id")], 50, pages.after_key([("id", False)], [40]))


@query("page_recency", "SELECT c_custkey AS id, coalesce(max((epoch_us(o_orderdate) // 1000)), 0) AS recent FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey ORDER BY recent DESC, id DESC LIMIT 101")
def page_recency(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("id"), intervals.millis("o_orderdate").alias("t"))
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return pages.page(pages.recency(who, "id", orders, "t", 0), [F.desc("recent"), F.desc("id")], 100)


@query(
    "page_similarity",
    "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7), s AS (SELECT vec_id AS id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q.e[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings, q) SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 25",
)
def page_similarity(spark, d):
    rows = table(spark, d, "embeddings")
    vector = rows.filter("vec_id = 7").first()["embedding"]
    return pages.similar(rows.withColumnRenamed("vec_id", "id"), "id", "embedding", vector, 25).withColumn("score", F.round("score", 6))


@query("merge_streams_topk", f"WITH {ACTIONS_SQL} SELECT * FROM (SELECT 'event' AS stream, id, t FROM actions UNION ALL SELECT 'order', o_orderkey, (epoch_us(o_orderdate) // 1000) FROM orders) ORDER BY t DESC, stream, id LIMIT 200")
def merge_streams_topk(spark, d):
    orders = table(spark, d, "orders").select(F.lit("order").alias("stream"), F.col("o_orderkey").alias("id"), intervals.millis("o_orderdate").alias("t"))
    return pages.merge_newest([actions(spark, d).select(F.lit("event").alias("stream"), "id", "t"), orders], "t", ["stream", "id"], 200)


#: Types and their parents; a type holds all below it.
PARENTS = {"view": "Consume", "click": "Consume", "purchase": "Trade", "signup": "Join", "error": "Fault", "Consume": "Action", "Trade": "Action", "Join": "Action"}


def closure(kind: str, parents: dict[str, str] = PARENTS) -> list[str]:
    """A type and all types below it; an unknown type is alone."""
    found, todo = {kind}, [kind]
    while todo:
        up = todo.pop()
        todo += [c for c, p in parents.items() if p == up and c not in found]
        found |= set(todo)
    return sorted(found)


@query("filter_type_closure", f"WITH {ACTIONS_SQL} SELECT id, type FROM actions WHERE type IN ('view', 'click', 'purchase', 'signup')")
def filter_type_closure(spark, d):
    return actions(spark, d).filter(F.col("type").isin(closure("Action"))).select("id", "type")


@query("filter_negated_set", f"WITH {ACTIONS_SQL} SELECT id, type FROM actions WHERE NOT (type = 'view' OR type = 'click') AND agent <> 8")
def filter_negated_set(spark, d):
    return actions(spark, d).filter(~F.col("type").isin("view", "click") & (F.col("agent") != 8)).select("id", "type")


@query("filter_numeric_guard", f"WITH {ACTIONS_SQL} SELECT id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM actions WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST(json_extract(props, '$.k') AS DOUBLE) >= 90")
def filter_numeric_guard(spark, d):
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    number = F.get_json_object("props", "$.k").rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$")
    return actions(spark, d).filter(number & (v >= 90)).select("id", v.alias("k"))


@query("filter_dual_literal", f"WITH {ACTIONS_SQL} SELECT id FROM actions WHERE json_extract_string(props, '$.k') = '15'")
def filter_dual_literal(spark, d):
    return actions(spark, d).filter(F.get_json_object("props", "$.k") == "15").select("id")


@query("filter_time_overlap", f"WITH {SPANS_SQL} SELECT id, s, e FROM spans WHERE s <= {ms(1997, 6, 30)} AND e >= {ms(1997)}")
def filter_time_overlap(spark, d):
    return spans(spark, d).filter(intervals.meets(F.col("s"), F.col("e"), ms(1997), ms(1997, 6, 30))).select("id", "s", "e")


@query("filter_time_cmp", f"WITH {SPANS_SQL} SELECT id FROM spans WHERE s > {ms(1999) - 1} AND s <= {ms(2000) - 1}")
def filter_time_cmp(spark, d):
    at = F.col("s")
    return spans(spark, d).filter(intervals.compared(at, ">", ms(1998), ms(1999) - 1) & intervals.compared(at, "<=", ms(1999), ms(2000) - 1)).select("id")


@query("filter_duration", f"WITH {SPANS_SQL} SELECT id, e - s AS lasted FROM spans WHERE e - s BETWEEN {3 * DAY} AND {900 * DAY}")
def filter_duration(spark, d):
    lasted = intervals.duration(F.col("s"), F.col("e"))
    return spans(spark, d).filter(lasted.between(3 * DAY, 900 * DAY)).select("id", lasted.alias("lasted"))


@query("filter_feed_window", f"WITH {SPANS_SQL} SELECT id FROM spans WHERE s < {ms(1998)} AND coalesce(e, s) >= {ms(1997, 11)}")
def filter_feed_window(spark, d):
    return spans(spark, d).filter(intervals.feed_window(F.col("s"), F.col("e"), ms(1997, 11), ms(1998))).select("id")


@query("filter_histogram_window", f"WITH {SPANS_SQL} SELECT id FROM spans WHERE s >= {ms(1997, 11)} AND s < {ms(1998)}")
def filter_histogram_window(spark, d):
    return spans(spark, d).filter((F.col("s") >= ms(1997, 11)) & (F.col("s") < ms(1998))).select("id")


@query(
    "filter_fulltext",
    r"SELECT doc_id FROM documents WHERE regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' license ') AND regexp_matches(' ' || regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g') || ' ', ' version 2 ')",
)
def filter_fulltext(spark, d):
    return table(spark, d, "documents").filter(texts.holds(F.col("text"), "license version-2")).select("doc_id")


@query("filter_mime", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority ILIKE '%-m%'")
def filter_mime(spark, d):
    return table(spark, d, "orders").filter(texts.mime_like(F.col("o_orderpriority"), "*-M*")).select(F.col("o_orderkey").alias("id"))


@query("scan_window_pushdown", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '1998-02-01'")
def scan_window_pushdown(spark, d):
    from yore.sources.readers import within

    return within(table(spark, d, "lineitem"), "l_shipdate", "1998-01-01", "1998-02-01").select("l_orderkey", "l_linenumber", "l_quantity")


@query("take_type_limited", f"WITH {ACTIONS_SQL} SELECT id FROM actions WHERE type = 'error' ORDER BY id LIMIT 21")
def take_type_limited(spark, d):
    return actions(spark, d).filter("type = 'error'").select("id").orderBy("id").limit(21)


@query("sample_bernoulli")
def sample_bernoulli(spark, d):
    return table(spark, d, "documents").sample(0.1, seed=7).select("doc_id")
