"""Steps that transform records one after another: chains, routes, checks with rejects, and totals of a run."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from yore.operators.pages import merge_newest

Step = Callable[[DataFrame], DataFrame]


def chain(rows: DataFrame, steps: list[Step]) -> DataFrame:
    """rows through all steps, in their order."""
    return reduce(lambda df, step: step(df), steps, rows)


def flat(make: Column, out: str) -> Step:
    """A step that gives a row for each element of an array, as column `out`; an empty or null array drops the record."""
    return lambda rows: rows.withColumn(out, F.explode(make))


def typed(rows: DataFrame, tests: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all tests, the others with `errors`, the names of the tests that they fail). A test that is null fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    told = rows.withColumn("errors", failed)
    return told.filter(F.size("errors") == 0).drop("errors"), told.filter(F.size("errors") > 0)


def dispatched(rows: DataFrame, kind: str, routes: dict[str, Step]) -> DataFrame:
    """Each record through the step of its kind; kinds without a route are dropped. Results may differ in columns."""
    parts = [step(rows.filter(F.col(kind) == name)) for name, step in routes.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else rows.limit(0)


def optional(rows: DataFrame, download: Step | None = None, plugin: Step | None = None, fields: list[str] | None = None, flatten: Step | None = None, sample: float | None = None, seed: int = 1, truncate: Step | None = None) -> DataFrame:
    """The steps that a run may ask for, always in this order: attachments first, what is only for show last."""
    steps = [download, plugin, (lambda df: df.select(*fields)) if fields else None, flatten, (lambda df: df.sample(sample, seed)) if sample is not None else None, truncate]
    return chain(rows, [s for s in steps if s])


def downloaded(rows: DataFrame, url: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rows with what fetch gives for their url: each distinct url is fetched once, by fetch(DataFrame of url) -> url and more."""
    return rows.join(fetch(rows.filter(F.col(url).isNotNull()).select(url).distinct()), url, "left")


def combined(parts: list[DataFrame], at: str = "occurred_at", size: int = 0) -> DataFrame:
    """Several kinds as one: in time order, newest first, if all of them have a time, else one after another. With a size, the first so many rows, for which each kind gives its own first; without one, a sort of all rows."""
    timed = all(at in p.columns for p in parts)
    numbered = [p.withColumn("part__", F.lit(i)) for i, p in enumerate(parts)]
    if size and timed:
        return merge_newest(numbered, at, ["part__"], size).drop("part__")
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.limit(size) if size else p for p in numbered])
    whole = whole.orderBy(F.desc(at), "part__") if timed else whole.orderBy("part__")
    return (whole.limit(size) if size else whole).drop("part__")


def totalled(rows: DataFrame, name: str, **tests: Column) -> tuple[DataFrame, Observation]:
    """(rows, totals): `processed` and how many pass each test, counted while rows run, without a pass of their own."""
    totals = Observation(name)
    return rows.observe(totals, F.count("*").alias("processed"), *[F.count(F.when(test, 1)).alias(k) for k, test in tests.items()]), totals
