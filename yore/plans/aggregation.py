"""Counts, facets, histograms, episodes, cells, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.operators import groups
from yore.plans.base import ACTIONS_SQL, DAY, actions, query, table


@query("count_actions", f"WITH {ACTIONS_SQL} SELECT count(*) AS n FROM actions WHERE type = 'view'")
def count_actions(spark, d):
    return actions(spark, d).filter("type = 'view'").agg(F.count("*").alias("n"))


@query("count_by_column", f"WITH {ACTIONS_SQL} SELECT type AS key, count(DISTINCT id) AS count FROM actions GROUP BY 1 ORDER BY 2 DESC, 1")
def count_by_column(spark, d):
    return groups.count_by(actions(spark, d), "id", F.col("type"))


@query("count_by_time", f"WITH {ACTIONS_SQL} SELECT strftime(make_timestamp(t * 1000), '%Y-%m-%d') AS key, count(DISTINCT id) AS count FROM actions GROUP BY 1 ORDER BY 1")
def count_by_time(spark, d):
    return groups.count_by(actions(spark, d), "id", groups.bucket(F.col("t"), "day"), by_key=True)


@query("count_by_path", "SELECT r_name AS key, count(DISTINCT o_orderkey) AS count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1 ORDER BY 2 DESC, 1")
def count_by_path(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    chain = o.join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey")), "c_custkey").join(table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey")), "n_nationkey").join(table(spark, d, "region"), "r_regionkey")
    return groups.count_by(chain, "o_orderkey", F.col("r_name"))


@query("count_by_multi_limit", "SELECT l_shipmode AS key, n AS count FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 4)")
def count_by_multi_limit(spark, d):
    return groups.count_by(table(spark, d, "lineitem"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"), limit=4)


@query("facet_topn_other", "WITH c AS (SELECT o_custkey % 20 AS key, count(*) AS n FROM orders GROUP BY 1), top AS (SELECT * FROM c ORDER BY n DESC, key LIMIT 8), s AS (SELECT count(*) AS d, CAST(sum(n) AS BIGINT) AS t FROM c) SELECT CAST(key AS VARCHAR) AS key, n AS count, d AS distinct, t AS total FROM top, s UNION ALL SELECT '@other', t - (SELECT CAST(sum(n) AS BIGINT) FROM top), d, t FROM s")
def facet_topn_other(spark, d):
    rows = table(spark, d, "orders").withColumn("k", F.lpad((F.col("o_custkey") % 20).cast("string"), 2, "0"))
    return groups.facet(rows, F.col("k"), 8).withColumn("key", F.regexp_replace("key", "^0(?=.)", ""))


def _histogram(unit: str):
    @query(f"histogram_{unit}", f"SELECT (epoch_us(date_trunc('{unit}', o_orderdate)) // 1000) AS start, count(*) AS count FROM orders GROUP BY 1 ORDER BY 1 DESC")
    def histogram(spark, d):
        from yore.operators.intervals import millis

        return groups.histogram(table(spark, d, "orders").select(millis("o_orderdate").alias("t")), "t", unit)


for _unit in ("day", "month", "year"):
    _histogram(_unit)


_GAP = DAY
_EPISODES = f"""WITH {ACTIONS_SQL},
b AS (SELECT agent, t, type, coalesce(CAST(t - max(t) OVER (PARTITION BY agent ORDER BY t, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {_GAP} AS INTEGER), 0) AS brk FROM actions),
g AS (SELECT *, sum(brk) OVER (PARTITION BY agent ORDER BY t, type ROWS UNBOUNDED PRECEDING) AS grp FROM b),
n AS (SELECT agent, grp, type, min(t) AS s, max(t) AS e, count(*) AS n FROM g GROUP BY 1, 2, 3)
SELECT agent, min(s) AS start, max(e) AS "end", CAST(sum(n) AS BIGINT) AS count, arg_min(type, (-n, type)) AS label FROM n GROUP BY agent, grp"""


@query("episodes_gap", _EPISODES)
def episodes_gap(spark, d):
    rows = actions(spark, d).withColumn("end", F.col("t"))
    return groups.episodes(rows, "t", "end", _GAP, "type", ["agent"])


@query("geo_grid", "WITH p AS (SELECT c_custkey, c_mktsegment AS label, (c_custkey % 900) / 10.0 AS lat, (c_custkey * 7 % 1800) / 10.0 - 90 AS lon FROM customer), c AS (SELECT CAST(round(lat / (500 / 111.0)) AS BIGINT) AS cell_lat, CAST(round(lon / (500 / 111.0)) AS BIGINT) AS cell_lon, label, avg(lat) AS a, avg(lon) AS o, count(*) AS n FROM p GROUP BY 1, 2, 3) SELECT cell_lat, cell_lon, round(arg_min(a, (-n, label)), 6) AS lat, round(arg_min(o, (-n, label)), 6) AS lon, CAST(sum(n) AS BIGINT) AS count, arg_min(label, (-n, label)) AS label FROM c GROUP BY 1, 2")
def geo_grid(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), ((F.col("c_custkey") % 900) / 10.0).alias("lat"), ((F.col("c_custkey") * 7 % 1800) / 10.0 - 90).alias("lon"))
    return groups.cells(rows, "lat", "lon", 500, "label").withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query("census", "SELECT 'o_custkey' AS slot, count(o_custkey) AS count FROM orders UNION ALL SELECT 'high', count(CASE WHEN o_totalprice > 300000 THEN 1 END) FROM orders")
def census(spark, d):
    rows = table(spark, d, "orders").withColumn("high", F.when(F.col("o_totalprice") > 300000, 1))
    return groups.census(rows, ["o_custkey", "high"])


@query("summary_actions", f"WITH {ACTIONS_SQL} SELECT 'total' AS section, '' AS key, count(*) AS count FROM actions UNION ALL SELECT 'first', '', min(t) FROM actions UNION ALL SELECT 'last', '', max(t) FROM actions UNION ALL SELECT 'type', type, count(*) FROM actions GROUP BY 2 UNION ALL SELECT 'day', strftime(make_timestamp(t * 1000), '%Y-%m-%d'), count(*) FROM actions GROUP BY 2")
def summary_actions(spark, d):
    rows = actions(spark, d).withColumn("day", groups.bucket(F.col("t"), "day"))
    sets = rows.groupingSets([[], [F.col("type")], [F.col("day")]], "type", "day").agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"), F.grouping_id().alias("g"))
    line = lambda s, k, v: F.struct(F.lit(s).alias("section"), k.alias("key"), v.alias("count"))
    none = F.lit("")
    total = F.array(line("total", none, F.col("n")), line("first", none, F.col("lo")), line("last", none, F.col("hi")))
    told = F.when(F.col("g") == 3, total).when(F.col("g") == 1, F.array(line("type", F.col("type"), F.col("n")))).otherwise(F.array(line("day", F.col("day"), F.col("n"))))
    return sets.select(F.explode(told).alias("x")).select("x.*")


@query("reduce_first_last", f"WITH {ACTIONS_SQL} SELECT agent AS id, min(t) AS first, max(t) AS last FROM actions GROUP BY 1 HAVING min(t) < {1704067200000 + 2 * DAY}")
def reduce_first_last(spark, d):
    found = actions(spark, d).groupBy(F.col("agent").alias("id")).agg(F.min("t").alias("first"), F.max("t").alias("last"))
    return found.filter(F.col("first") < 1704067200000 + 2 * DAY)


@query("survey_profile", f"WITH {ACTIONS_SQL}, m AS (SELECT *, strftime(make_timestamp(t * 1000), '%Y-%m') AS month FROM actions) SELECT month, count(*) AS count, min(t) AS earliest, max(t) AS latest, round(sum(value), 2) AS sum_value FROM m GROUP BY ROLLUP (month)")
def survey_profile(spark, d):
    return groups.profile(actions(spark, d), "t", ["value"]).withColumn("sum_value", F.round("sum_value", 2))


@query("survey_by_month_local", "SELECT strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Toronto', '%Y-%m') AS month, count(*) AS count FROM events GROUP BY 1")
def survey_by_month_local(spark, d):
    return groups.profile(actions(spark, d), "t", [], "America/Toronto").filter("month is not null").select("month", "count")


@query("cube_counts", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus) HAVING count(*) > 10")
def cube_counts(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity")
    return rows.cube("flag", "status").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity")).filter("n > 10")


@query("distinct_concat", "SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def distinct_concat(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.countDistinct("o_orderpriority").alias("priorities"))


@query("approximate_distinct")
def approximate_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_quantity", 0.5).alias("median"))


@query("windows_ranked", "SELECT l_orderkey, l_linenumber, rank() OVER w AS rank, dense_rank() OVER w AS dense, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS before FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity DESC)")
def windows_ranked(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("l_orderkey")
    w = by.orderBy(F.desc("l_quantity"))
    line = by.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(w).cast("long").alias("rank"), F.dense_rank().over(w).cast("long").alias("dense"), F.lag("l_quantity").over(line).alias("before"))
