"""Counts, facets, histograms, episodes and cells over actions or entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from yore.operators.near import carried

KM_PER_DEGREE = 111.0


def count_by(rows: DataFrame, root: str, key: Column, limit: int | None = None, by_key: bool = False) -> DataFrame:
    """(key, count): distinct roots of each key; null keys are left out. Most frequent first, or by key."""
    found = rows.select(F.col(root).alias("r__"), key.alias("key")).filter("key is not null").groupBy("key").agg(F.countDistinct("r__").alias("count"))
    found = found.orderBy("key") if by_key else found.orderBy(F.desc("count"), "key")
    return found.limit(limit) if limit else found


def facet(rows: DataFrame, key: Column, top: int) -> DataFrame:
    """(key, count, distinct, total): the most frequent keys, and @other for the rest."""
    counts = rows.select(key.alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("count"))
    first = counts.orderBy(F.desc("count"), "key").limit(top)
    sums = counts.agg(F.count("*").alias("distinct"), F.sum("count").alias("total"))
    rest = sums.crossJoin(first.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("s__"))).select(F.lit("@other").alias("key"), (F.col("total") - F.col("s__")).alias("count")).filter("count > 0")
    return first.union(rest).crossJoin(sums)  # one row


def bucket(at: Column, unit: str) -> Column:
    """The UTC year, month or day of epoch milliseconds, as text."""
    return F.date_format(F.timestamp_millis(at), {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])


def histogram(rows: DataFrame, at: str, unit: str, newest_first: bool = True) -> DataFrame:
    """(start, count) with the bucket's first millisecond."""
    start = F.unix_millis(F.date_trunc(unit, F.timestamp_millis(F.col(at))))
    found = rows.filter(F.col(at).isNotNull()).groupBy(start.alias("start")).agg(F.count("*").alias("count"))
    return found.orderBy(F.desc("start") if newest_first else "start")


def time_unit(first: int, last: int) -> str:
    """How finely to show a span: years beyond two, months beyond two months, days below."""
    days = (last - first) / 86_400_000
    return "year" if days > 730 else "month" if days > 62 else "day"


def episodes(rows: DataFrame, start: str, end: str, gap: int, label: str, by: list[str] | None = None, width: int = 86_400_000 * 7) -> DataFrame:
    """(by, start, end, count, label): groups of rows whose gaps are at most `gap`, with the most frequent label (the least of ties).

    A row begins a group if it starts more than `gap` after every earlier row's end. The furthest end so far is taken
    within bins and carried over from the bins before, so that no single task sees a whole key.
    """
    by = by or []
    one = rows.select(*by, F.col(start).alias("s__"), F.coalesce(end, start).alias("e__"), F.col(label).alias("l__")).filter("s__ is not null").withColumn("bin__", F.floor(F.col("s__") / width))

    def before(df: DataFrame, value: Column, how: str) -> DataFrame:
        return carried(df.groupBy(*by, "bin__").agg(value.alias("v__")), by, "v__", "c__", how).drop("v__")

    within = W.Window.partitionBy(*by, "bin__").orderBy("s__", "e__", "l__")
    seen = one.join(before(one, F.max("e__"), "max"), [*by, "bin__"])
    furthest = F.greatest(F.max("e__").over(within.rowsBetween(W.Window.unboundedPreceding, -1)), F.col("c__"))
    marked = seen.withColumn("new__", F.coalesce((F.col("s__") - furthest > gap).cast("int"), F.lit(0))).drop("c__")
    numbered = marked.join(before(marked, F.sum("new__"), "sum"), [*by, "bin__"]).withColumn("g__", F.sum("new__").over(within.rowsBetween(W.Window.unboundedPreceding, 0)) + F.coalesce("c__", F.lit(0)))
    labelled = numbered.groupBy(*by, "g__", "l__").agg(F.min("s__").alias("s__"), F.max("e__").alias("e__"), F.count("*").alias("n__"))
    return labelled.groupBy(*by, "g__").agg(
        F.min("s__").alias("start"), F.max("e__").alias("end"), F.sum("n__").alias("count"), F.min_by("l__", F.struct(-F.col("n__"), F.col("l__"))).alias("label")
    ).drop("g__")


def cells(rows: DataFrame, lat: str, lon: str, km: float, label: str) -> DataFrame:
    """(cell_lat, cell_lon, lat, lon, count, label): a grid of km-wide cells; the position is the mean of the most frequent label's rows (the least of ties)."""
    deg = km / KM_PER_DEGREE
    placed = rows.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(
        F.round(F.col(lat) / deg).cast("long").alias("cell_lat"), F.round(F.col(lon) / deg).cast("long").alias("cell_lon"), F.col(lat).alias("a__"), F.col(lon).alias("o__"), F.col(label).alias("l__")
    )
    named = placed.groupBy("cell_lat", "cell_lon", "l__").agg(F.avg("a__").alias("a__"), F.avg("o__").alias("o__"), F.count("*").alias("n__"))
    first = F.struct(-F.col("n__"), F.col("l__"))
    return named.groupBy("cell_lat", "cell_lon").agg(
        F.min_by("a__", first).alias("lat"), F.min_by("o__", first).alias("lon"), F.sum("n__").alias("count"), F.min_by("l__", first).alias("label")
    )


def census(rows: DataFrame, slots: list[str]) -> DataFrame:
    """(slot, count): in how many rows each column has a value; one pass."""
    counts = rows.agg(*[F.count(c).alias(c) for c in slots])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("slot"), F.col(c).alias("count")) for c in slots])).alias("x")).select("x.*")


def profile(rows: DataFrame, at: str, measures: list[str], zone: str = "UTC") -> DataFrame:
    """(month, count, earliest, latest and sums of the measures): per local month, and in total where the month is null."""
    local = F.date_format(F.from_utc_timestamp(F.timestamp_millis(F.col(at)), zone), "yyyy-MM")
    return rows.withColumn("month", local).rollup("month").agg(
        F.count("*").alias("count"), F.min(at).alias("earliest"), F.max(at).alias("latest"), *[F.sum(m).alias(f"sum_{m}") for m in measures]
    )
