"""The register of queries, and the driver's tables seen as actions, spans and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yore.operators.intervals import millis

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same views in SQL.
ACTIONS_SQL = "actions AS (SELECT event_id AS id, event_type AS type, user_id AS agent, (epoch_us(ts) // 1000) AS t, value, props FROM events)"
SPANS_SQL = "spans AS (SELECT o_orderkey AS id, any_value(o_custkey) AS agent, (epoch_us(any_value(o_orderdate)) // 1000) AS s, greatest((epoch_us(any_value(o_orderdate)) // 1000), max((epoch_us(l_shipdate) // 1000))) AS e, any_value(o_orderstatus) AS status FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"
DAY = 86_400_000


def query(name: str, sql: str | None = None):
    """Register the decorated function under a name, with its oracle."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def actions(spark, sf_dir: str) -> DataFrame:
    """events as point actions: id, type, agent, t, value, props."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("user_id").alias("agent"), millis("ts").alias("t"), "value", "props")


def spans(spark, sf_dir: str) -> DataFrame:
    """orders as actions that last until their last shipment: id, agent, s, e, status."""
    last = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max(millis("l_shipdate")).alias("ship"))
    start = millis("o_orderdate")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("agent"), start.alias("s"), F.col("o_orderstatus").alias("status"))
    return orders.join(last, "id", "left").select("id", "agent", "s", F.greatest("s", "ship").alias("e"), "status")


def ms(year: int, month: int = 1, day: int = 1) -> int:
    import datetime as dt

    return int(dt.datetime(year, month, day, tzinfo=dt.timezone.utc).timestamp() * 1000)
