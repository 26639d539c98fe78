"""Pages: a sorted slice and whether there is more. Each is a top-k that Spark plans as TakeOrdered, never a full sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], size: int, after: Column | None = None) -> DataFrame:
    """The first `size` rows after the cursor, and one more if there is one: a caller that gets it knows there is a next page. size 0: all rows."""
    rows = rows.filter(after) if after is not None else rows
    rows = rows.orderBy(*order)
    return rows.limit(size + 1) if size else rows


def after_key(cols: list[tuple[str, bool]], values: list) -> Column:
    """The rows beyond a cursor: columns (name, descending) with the cursor's values, compared from left to right."""
    found = F.lit(False)
    equal = F.lit(True)
    for (name, down), value in zip(cols, values, strict=True):
        found |= equal & (F.col(name) < value if down else F.col(name) > value)
        equal &= F.col(name) == value
    return found


def actions_page(rows: DataFrame, size: int, after: tuple[int, object] | None = None, occurred: str = "occurred_at", end: str = "end", key: str = "id") -> DataFrame:
    """The newest actions by when they ended, or, without an end, occurred; then by key, descending. after: the last page's last (time, key)."""
    timed = rows.withColumn("ts__", F.coalesce(F.col(end), F.col(occurred)))
    cursor = after_key([("ts__", True), (key, True)], [*after]) if after else None
    return page(timed, [F.desc("ts__"), F.desc(key)], size, cursor).drop("ts__")


def recency(entities: DataFrame, key: str, encounters: DataFrame, at: str, floor: int, self_key=None) -> DataFrame:
    """entities with `recent`: when each was last encountered, or the floor; without oneself, if self_key is given."""
    entities = entities.filter(F.col(key) != self_key) if self_key is not None else entities
    last = encounters.groupBy(key).agg(F.max(at).alias("recent"))
    return entities.join(last, key, "left").withColumn("recent", F.coalesce("recent", F.lit(floor)))


def merge_newest(streams: list[DataFrame], at: str, tie: list[str], k: int) -> DataFrame:
    """The newest k rows of several streams: each gives its own k first."""
    order = [F.desc(at), *tie]
    all_of = None
    for s in streams:
        top = s.orderBy(*order).limit(k) if k else s
        all_of = top if all_of is None else all_of.unionByName(top, allowMissingColumns=True)
    return all_of.orderBy(*order).limit(k) if k else all_of.orderBy(*order)


def similar(rows: DataFrame, key: str, vector: str, query: list[float], k: int, offset: int = 0) -> DataFrame:
    """(key, score): the k rows with the greatest cosine to the query from a rank on; zero vectors score 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = F.col(vector)
    length = F.sqrt(dot(v, v)) * F.lit(sum(x * x for x in query) ** 0.5)
    scored = rows.select(key, F.when(length > 0, dot(v, q) / length).otherwise(0.0).alias("score"))
    return scored.orderBy(F.desc("score"), key).offset(offset).limit(k)
