"""Joins along links: existence, absence, counts and "every" over neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def having(rows: DataFrame, links: DataFrame, on: list[str], no: bool = False) -> DataFrame:
    """rows with (or, with `no`, without) a link of equal `on` columns."""
    return rows.join(links, on, "left_anti" if no else "left_semi")


def flagged(rows: DataFrame, links: DataFrame, on: list[str], out: str) -> DataFrame:
    """rows with the boolean `out`: whether a link exists; for conditions under OR."""
    return rows.join(links.select(*on).distinct().withColumn(out, F.lit(True)), on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def counted(rows: DataFrame, links: DataFrame, on: list[str], op: str, n: int) -> DataFrame:
    """rows whose number of links compares to n; rows without links have zero."""
    counts = links.groupBy(*on).agg(F.count("*").alias("n__"))
    c = F.coalesce("n__", F.lit(0))
    test: Column = {"=": c == n, ">": c > n, ">=": c >= n, "<": c < n, "<=": c <= n}[op]
    return rows.join(counts, on, "left").filter(test).drop("n__")


def every(rows: DataFrame, links: DataFrame, on: list[str], test: Column) -> DataFrame:
    """rows with at least one link of which none fails the test; a link whose test is null neither passes nor fails."""
    fails = links.groupBy(*on).agg(F.count(F.when(~test, 1)).alias("fails__"))
    return rows.join(fails.filter("fails__ = 0"), on, "left_semi")


def together(links: DataFrame, event: str, member: str) -> DataFrame:
    """(member, n_events, n_others): how many events each member shares with others and how many members those have besides it, without pairing members."""
    sizes = links.select(event, member).distinct().groupBy(event).agg(F.count("*").alias("size__"))
    return (
        links.select(event, member).distinct().join(sizes.filter("size__ > 1"), event).groupBy(member).agg(F.count("*").alias("n_events"), F.sum(F.col("size__") - 1).alias("n_others"))
    )


def either(rows: DataFrame, tests: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """rows that any of the (links, on) has, each by its own equi-join."""
    flags = []
    for i, (links, on) in enumerate(tests):
        rows = flagged(rows, links, on, f"f{i}__")
        flags.append(F.col(f"f{i}__"))
    test = flags[0]
    for f in flags[1:]:
        test = test | f
    return rows.filter(test).drop(*[f"f{i}__" for i in range(len(tests))])
