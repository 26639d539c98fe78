"""Windows over time, recency of confirms, encounters from both sides, and other rows of the blueprint."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from yore.operators import groups, links, pages
from yore.operators.intervals import millis
from yore.plans.base import ACTIONS_SQL, DAY, SPANS_SQL, actions, query, spans, table

_REST = 2 * 3_600_000


@query(
    "rest_periods",
    f"""WITH {SPANS_SQL},
b AS (SELECT agent, s, e, status, coalesce(CAST(s - max(e) OVER (PARTITION BY agent ORDER BY s, e, status ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {_REST} AS INTEGER), 0) AS brk FROM spans),
g AS (SELECT *, sum(brk) OVER (PARTITION BY agent ORDER BY s, e, status ROWS UNBOUNDED PRECEDING) AS grp FROM b)
SELECT agent, min(s) AS start, max(e) AS "end", count(*) AS count FROM g GROUP BY agent, grp""",
)
def rest_periods(spark, d):
    return groups.episodes(spans(spark, d), "s", "e", _REST, "status", ["agent"], width=400 * DAY).select("agent", "start", "end", "count")


@query("encounters_both_sides", "SELECT id FROM (SELECT c_custkey AS id FROM customer) WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') OR id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 450)")
def encounters_both_sides(spark, d):
    who = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    errors = table(spark, d, "events").filter("event_type = 'error' and value > 450").select(F.col("user_id").alias("id"))
    return links.having(who, urgent.union(errors), ["id"])


@query("tumbling_windows", "SELECT (epoch_us(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) // 1000) AS start, event_type AS type, count(*) AS count FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "6 hours").alias("w"), F.col("event_type").alias("type")).agg(F.count("*").alias("count")).select(F.unix_millis("w.start").alias("start"), "type", "count")


@query("sliding_windows", "SELECT (epoch_us(b + INTERVAL 6 HOUR * k) // 1000) AS start, count(*) AS count FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS b FROM events), range(-1, 1) r(k) GROUP BY 1")
def sliding_windows(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.window("at", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("count")).select(F.unix_millis("w.start").alias("start"), "count")


@query(
    "session_windows",
    "WITH b AS (SELECT user_id, epoch_us(ts) AS t, coalesce(CAST(epoch_us(ts) - lag(epoch_us(ts)) OVER w >= 7200000000 AS INTEGER), 0) AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS n FROM b) SELECT user_id AS id, min(t) // 1000 AS start, count(*) AS count FROM g GROUP BY user_id, n",
)
def session_windows(spark, d):
    rows = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.session_window("at", "2 hours").alias("w"), F.col("user_id").alias("id")).agg(F.count("*").alias("count")).select("id", F.unix_millis("w.start").alias("start"), "count")


@query("histogram_oldest_first", f"WITH {ACTIONS_SQL} SELECT t // {DAY} * {DAY} AS start, count(*) AS count FROM actions WHERE type = 'view' GROUP BY 1 ORDER BY 1")
def histogram_oldest_first(spark, d):
    return groups.histogram(actions(spark, d).filter("type = 'view'"), "t", "day", newest_first=False)


@query("page_similarity_offset", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 3), s AS (SELECT vec_id AS id, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q.e[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings, q) SELECT id FROM s ORDER BY score DESC, id LIMIT 10 OFFSET 20")
def page_similarity_offset(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return pages.similar(rows, "id", "embedding", rows.filter("id = 3").first()["embedding"], 10, 20).select("id")


@query("similar_members", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 5), s AS (SELECT vec_id AS id, label, list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * q.e[i]::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.e, lambda x: x::DOUBLE * x::DOUBLE)))) AS score FROM embeddings, q) SELECT id FROM (SELECT id, label FROM s ORDER BY score DESC, id LIMIT 50) WHERE label = 1")
def similar_members(spark, d):
    rows = table(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    near = pages.similar(rows, "id", "embedding", rows.filter("id = 5").first()["embedding"], 50)
    return links.having(rows.filter("label = 1").select("id"), near, ["id"])


@query("windows_values", "SELECT o_orderkey AS id, CAST(ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS quarter, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS cheapest, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, count(*) OVER (PARTITION BY o_custkey ORDER BY epoch_us(o_orderdate) // 86400000000 RANGE BETWEEN 30 PRECEDING AND CURRENT ROW) AS month FROM orders")
def windows_values(spark, d):
    rows = table(spark, d, "orders").withColumn("day", F.floor(millis("o_orderdate") / DAY))
    by = Window.partitionBy("o_custkey")
    price = by.orderBy("o_totalprice", "o_orderkey")
    whole = price.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(
        F.col("o_orderkey").alias("id"), F.ntile(4).over(price).cast("long").alias("quarter"), F.first("o_orderkey").over(price).alias("cheapest"), F.nth_value("o_orderkey", 2).over(whole).alias("second"),
        F.count("*").over(by.orderBy("day").rangeBetween(-30, 0)).alias("month"),
    )


@query("entity_counts_by_source", "SELECT source AS key, count(DISTINCT doc_id) AS count FROM documents GROUP BY 1 ORDER BY 2 DESC, 1")
def entity_counts_by_source(spark, d):
    return groups.count_by(table(spark, d, "documents"), "doc_id", F.col("source"))


@query("family_of_predicates", "SELECT id, min(t) AS first FROM (SELECT o_custkey AS id, (epoch_us(o_orderdate) // 1000) AS t FROM orders WHERE o_orderstatus IN ('F', 'O')) GROUP BY 1")
def family_of_predicates(spark, d):
    rows = table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O")).select(F.col("o_custkey").alias("id"), millis("o_orderdate").alias("t"))
    return rows.groupBy("id").agg(F.min("t").alias("first"))


@query("union_columns", "SELECT s_suppkey AS id, s_name AS name, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def union_columns(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return s.unionByName(c, allowMissingColumns=True)


@query("contact_lookup", "SELECT o_orderkey AS id, c_name AS contact FROM orders LEFT JOIN (SELECT regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS k, c_name FROM customer) ON k = 'customer' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')")
def contact_lookup(spark, d):
    book = table(spark, d, "customer").select(F.regexp_replace(F.lower("c_name"), "[^a-z0-9]", "").alias("k"), F.col("c_name").alias("contact"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("customer"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("k"))
    return rows.join(book, "k", "left").select("id", "contact")
