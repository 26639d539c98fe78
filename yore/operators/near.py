"""Joins on time distance. None compares rows pairwise: existence within a distance needs only the least and the greatest
anchor of each bin, overlap only counts, and an as-of value only the last row of each bin; all of these are sums that
combine before a shuffle, so that a hot key or a crowded hour stays a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def has_point_within(rows: DataFrame, anchors: DataFrame, lo: Column, width: int, point: str, by: list[str] | None = None, out: str = "near") -> DataFrame:
    """rows with the boolean `out`: whether anchors has a point in the closed range [lo, lo + width]. by: columns that must be equal too.

    Bins hold width + 1 milliseconds, so a range meets two of them, or is one: in the first the greatest point decides,
    in the last the least.
    """
    by, bin_of = by or [], lambda t: F.floor(t / (width + 1))
    bins = anchors.filter(F.col(point).isNotNull()).groupBy(*by, bin_of(F.col(point)).alias("bin__")).agg(F.min(point).alias("least__"), F.max(point).alias("most__"))
    base = rows.withColumns({"lo__": lo, "b0__": bin_of(lo), "b1__": bin_of(lo + width)})
    first = bins.select(*by, F.col("bin__").alias("b0__"), F.col("most__").alias("m0__"))
    last = bins.select(*by, F.col("bin__").alias("b1__"), F.col("least__").alias("l1__"))
    met = base.join(first, [*by, "b0__"], "left").join(last, [*by, "b1__"], "left")
    found = F.coalesce(F.col("m0__") >= F.col("lo__"), F.lit(False)) | F.coalesce(F.col("l1__") <= F.col("lo__") + width, F.lit(False))
    return met.withColumn(out, found).select(*rows.columns, out)


def carried(per_bin: DataFrame, by: list[str], value: str, name: str, how: str) -> DataFrame:
    """per_bin (by, bin__ and more) with `name`: the sum, max or last non-null of a column over all bins before; null for the first.

    Bins go in groups of 1,024: without a key no task sees more than so many, or one row a group.
    """
    inner = W.Window.partitionBy(*by, "group__").orderBy("bin__").rowsBetween(W.Window.unboundedPreceding, -1)
    outer = W.Window.partitionBy(*by).orderBy("group__").rowsBetween(W.Window.unboundedPreceding, -1)
    grouped = per_bin.withColumn("group__", F.floor(F.col("bin__") / 1024))
    whole = {"sum": F.sum(value), "max": F.max(value), "last": F.max_by(value, F.when(F.col(value).isNotNull(), F.col("bin__")))}[how]
    over = lambda c, w: F.last(c, ignorenulls=True).over(w) if how == "last" else (F.sum if how == "sum" else F.max)(c).over(w)
    groups = grouped.groupBy(*by, "group__").agg(whole.alias("v__")).withColumn("o__", over("v__", outer)).drop("v__")
    both = {"sum": F.coalesce(F.col("i__") + F.col("o__"), "i__", "o__"), "max": F.greatest("i__", "o__"), "last": F.coalesce("i__", "o__")}[how]
    found = grouped.withColumn("i__", over(value, inner)).join(groups, [*by, "group__"])
    return found.withColumn(name, both).drop("group__", "i__", "o__")


def _counts(rows: DataFrame, points: DataFrame, at: str, width: int, by: list[str]) -> DataFrame:
    """rows (with columns by and at) with before__: how many points are less than, and upto__: how many are at most `at`."""
    bin_of = lambda c: F.floor(F.col(c) / width)
    both = rows.select(*by, F.col(at).alias("t__")).distinct().withColumn("n__", F.lit(0)).unionByName(points.groupBy(*by, F.col("p__").alias("t__")).agg(F.count("*").cast("int").alias("n__")))
    per_time = both.groupBy(*by, "t__").agg(F.sum("n__").alias("n__")).withColumn("bin__", bin_of("t__"))
    per_bin = per_time.groupBy(*by, "bin__").agg(F.sum("n__").alias("all__"))
    per_bin = carried(per_bin, by, "all__", "base__", "sum").drop("all__").fillna({"base__": 0})
    within = W.Window.partitionBy(*by, "bin__").orderBy("t__").rowsBetween(W.Window.unboundedPreceding, 0)
    told = per_time.withColumn("run__", F.sum("n__").over(within)).join(per_bin, [*by, "bin__"])
    return told.select(*by, "t__", (F.col("base__") + F.col("run__")).alias("upto__"), (F.col("base__") + F.col("run__") - F.col("n__")).alias("before__"))


def count_overlapping(rows: DataFrame, anchors: DataFrame, start: str, end: str, width: int, by: list[str] | None = None, out: str = "overlaps") -> DataFrame:
    """rows with the number of anchors whose closed interval meets the row's: those that start by its end, less those that end before its start. A row that is an anchor itself counts itself. width: of the bins.

    An interval without an end is its start alone; one without a start meets none, and neither does a row without a key.
    """
    by = by or []
    anchors = _spanned(anchors.select(*by, F.col(start).alias("s__"), F.col(end).alias("e__")), "s__", "e__")
    asked = rows.withColumns({"a__": F.col(start), "z__": F.coalesce(end, start)})
    times = _spanned(asked.select(*by, "a__", "z__"), "a__", "z__")
    starts = _counts(times, anchors.select(*by, F.col("s__").alias("p__")), "z__", width, by).select(*by, F.col("t__").alias("z__"), F.col("upto__").alias("started__"))
    ends = _counts(times, anchors.select(*by, F.col("e__").alias("p__")), "a__", width, by).select(*by, F.col("t__").alias("a__"), F.col("before__").alias("ended__"))
    found = asked.join(starts, [*by, "z__"], "left").join(ends, [*by, "a__"], "left")
    return found.select(*rows.columns, F.coalesce(F.col("started__") - F.col("ended__"), F.lit(0).cast("long")).alias(out))


def _spanned(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with a start, which is their end where they have none."""
    return rows.filter(F.col(start).isNotNull()).withColumn(end, F.coalesce(end, start))


def as_of(rows: DataFrame, facts: DataFrame, by: list[str], at: str, since: str, value: list[str], width: int) -> DataFrame:
    """rows with the `value` columns of the last fact of the same key whose `since` is at most the row's `at`; null without one. Of facts with equal times, the greatest values win.

    Rows and facts are ordered within bins of a key, and each bin starts from the last fact of the bins before, so that
    a key with very many rows is spread over tasks.
    """
    bin_of = lambda c: F.floor(F.col(c) / width)
    fact = F.struct(F.col(since).alias("t"), *value)
    last = facts.groupBy(*by, bin_of(since).alias("bin__")).agg(F.max(fact).alias("f__"))
    marks = rows.select(*by, bin_of(at).alias("bin__")).distinct().join(last, [*by, "bin__"], "full")
    earlier = carried(marks.select(*by, "bin__", "f__"), by, "f__", "c__", "last").drop("f__")
    here = facts.select(*by, bin_of(since).alias("bin__"), F.col(since).alias("t__"), F.lit(0).alias("k__"), fact.alias("f__"))
    asked = rows.select(*by, bin_of(at).alias("bin__"), F.col(at).alias("t__")).distinct().select("*", F.lit(1).alias("k__"), F.lit(None).alias("f__"))
    asked = asked.withColumn("f__", F.col("f__").cast(here.schema["f__"].dataType))
    order = W.Window.partitionBy(*by, "bin__").orderBy("t__", "k__", "f__").rowsBetween(W.Window.unboundedPreceding, 0)
    told = here.unionByName(asked).withColumn("l__", F.last("f__", ignorenulls=True).over(order)).filter("k__ = 1").join(earlier, [*by, "bin__"], "left")
    found = told.select(*by, F.col("t__").alias(at), F.coalesce("l__", "c__").alias("v__"))
    return rows.join(found, [*by, at], "left").select(*rows.columns, *[F.col(f"v__.{v}").alias(v) for v in value])


def has_span_within(rows: DataFrame, anchors: DataFrame, start: str, end: str, kind: str, lo: int, hi: int, width: int, by: list[str] | None = None, out: str = "near") -> DataFrame:
    """rows with the boolean `out`: whether an anchor's interval is lo to hi milliseconds away from the row's, both of columns start and end.

    An interval without an end is its start alone. kind after: the anchor ends before the row starts; before: it starts after the row ends; near: either, or, if lo is 0,
    they meet. Distances are those of the facing edges, so after and before ask for one end of the anchors only, and
    meeting is an overlap with the row widened by hi. width: of the bins that overlaps are counted in.
    """
    by = by or []
    apart = max(lo, 1)
    anchors = _spanned(anchors.select(*by, F.col(start).alias("as__"), F.col(end).alias("ae__")), "as__", "ae__")
    last = F.coalesce(end, start)

    def one_side(df: DataFrame, side: str, name: str) -> DataFrame:
        if hi < apart:
            return df.withColumn(name, F.lit(False))
        point, first = ("ae__", F.col(start) - hi) if side == "after" else ("as__", last + apart)
        return has_point_within(df, anchors.select(*by, F.col(point).alias("p__")), first, hi - apart, "p__", by, name)

    if kind in ("after", "before"):
        return one_side(rows, kind, out)
    if kind != "near":
        raise ValueError(f"unknown kind {kind!r}")
    if lo > 0:
        both = one_side(one_side(rows, "after", "a__"), "before", "b__")
        return both.withColumn(out, F.col("a__") | F.col("b__")).drop("a__", "b__")
    wide = rows.withColumns({"as__": F.col(start) - hi, "ae__": last + hi})
    found = count_overlapping(wide, anchors, "as__", "ae__", width, by, "n__")
    return found.select(*rows.columns, (F.col("n__") > 0).alias(out))


def held_at(rows: DataFrame, runs: DataFrame, at: str, start: str, end: str, width: int, by: list[str] | None = None, out: str = "held") -> DataFrame:
    """rows with the boolean `out`: whether a run [start, end) holds at the row's own time. A null start is unbounded, a null end open.

    That is: more runs have begun by then than have ended. Runs may overlap.
    """
    by = by or []
    least = F.lit(-(2**62)).cast("long")
    begun = _counts(rows, runs.select(*by, F.coalesce(F.col(start), least).alias("p__")), at, width, by).select(*by, F.col("t__").alias(at), F.col("upto__").alias("begun__"))
    over = _counts(rows, runs.filter(F.col(end).isNotNull()).select(*by, F.col(end).alias("p__")), at, width, by).select(*by, F.col("t__").alias(at), F.col("upto__").alias("over__"))
    found = rows.join(begun, [*by, at], "left").join(over, [*by, at], "left")
    return found.select(*rows.columns, (F.coalesce("begun__", F.lit(0)) > F.coalesce("over__", F.lit(0))).alias(out))
