"""Dates and epochs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from yore.functions import times
from yore.operators.intervals import millis
from yore.plans.base import ACTIONS_SQL, actions, query, table


@query("date_ranges_month", "SELECT o_orderkey AS id, (epoch_us(date_trunc('month', o_orderdate)) // 1000) AS lower, (epoch_us(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) // 1000) - 1 AS upper FROM orders")
def date_ranges_month(spark, d):
    r = times.date_range(F.date_format("o_orderdate", "yyyy-MM"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r["lower"].alias("lower"), r["upper"].alias("upper"))


@query("date_ranges_year", "SELECT o_orderkey AS id, (epoch_us(date_trunc('year', o_orderdate)) // 1000) AS lower, (epoch_us(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR) // 1000) - 1 AS upper, 'year' AS precision FROM orders")
def date_ranges_year(spark, d):
    r = times.date_range(F.date_format("o_orderdate", "yyyy"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), r["lower"].alias("lower"), r["upper"].alias("upper"), r["precision"].alias("precision"))


@query("date_ranges_none", "SELECT o_orderkey AS id, true AS none FROM orders")
def date_ranges_none(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), times.date_range(F.concat("o_orderstatus", F.lit("-13"))).isNull().alias("none"))


@query("range_intersect", "SELECT o_orderkey AS id, (epoch_us(date_trunc('day', o_orderdate)) // 1000) AS lower, 'day' AS precision FROM orders")
def range_intersect(spark, d):
    month, day = times.date_range(F.date_format("o_orderdate", "yyyy-MM")), times.date_range(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), month.alias("m"), day.alias("y"))
    both = times.intersect(F.col("m"), F.col("y"))
    return rows.select("id", both["lower"].alias("lower"), both["precision"].alias("precision"))


@query("range_format", "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def range_format(spark, d):
    rows = table(spark, d, "orders")
    said = lambda f: times.coarsest(times.date_range(F.date_format("o_orderdate", f))["lower"], times.date_range(F.date_format("o_orderdate", f))["upper"])
    return rows.select(F.col("o_orderkey").alias("id"), said("yyyy").alias("year"), said("yyyy-MM").alias("month"), said("yyyy-MM-dd").alias("day"))


@query("instants", f"WITH {ACTIONS_SQL} SELECT id, t AS same, t AS digits FROM actions")
def instants(spark, d):
    rows = actions(spark, d)
    return rows.select("id", times.instant(times.iso(F.col("t"))).alias("same"), times.instant(F.col("t").cast("string")).alias("digits"))


_LO, _HI = times.relative("last week", dt.datetime(2024, 1, 17, 12, tzinfo=dt.timezone.utc))


@query("filter_relative_window", f"WITH {ACTIONS_SQL} SELECT id FROM actions WHERE t BETWEEN 1704672000000 AND 1705276799999")
def filter_relative_window(spark, d):
    return actions(spark, d).filter(F.col("t").between(_LO, _HI)).select("id")


@query("epoch_conversions", "SELECT event_id AS id, (epoch_us(ts) // 1000) AS chrome, (epoch_us(ts) // 1000) AS apple FROM events")
def epoch_conversions(spark, d):
    t = millis("ts")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), times.chrome((t + 11_644_473_600_000) * 1000).cast("long").alias("chrome"), times.apple(t / 1000.0 - 978_307_200).alias("apple"))
