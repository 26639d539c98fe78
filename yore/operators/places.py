"""Places that are values and no entities: a point and an address, which is the same place wherever it is said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.operators.groups import cells
from yore.operators.pages import after_key, page

#: What roots of a page are.
ENTITY, PLACE = "entity", "place"


def key(lat: Column, lon: Column, address: Column) -> Column:
    """The key of a place: of its point to seven digits and its address, of which either may be missing."""
    digits = lambda x: F.coalesce(F.format_string("%.7f", x.cast("double")), F.lit(""))
    return F.sha2(F.concat_ws("|", digits(lat), digits(lon), F.coalesce(address, F.lit(""))), 256)


def values(rows: DataFrame, lat: str, lon: str, address: str) -> DataFrame:
    """(place, lat, lon, address): the distinct places that rows name; rows without a point and an address name none."""
    said = rows.select(F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"), F.col(address).alias("address"))
    some = said.filter("lat is not null and lon is not null or address is not null").distinct()
    return some.select(key(F.col("lat"), F.col("lon"), F.col("address")).alias("place"), "lat", "lon", "address").dropDuplicates(["place"])


def united(entities: DataFrame, places: DataFrame, order: str) -> DataFrame:
    """(kind, key, label, order) of both kinds of roots. entities and places: key, label and the order column."""
    of = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), "label", order)
    return of(entities, ENTITY).unionByName(of(places, PLACE))


def united_page(entities: DataFrame, places: DataFrame, order: str, size: int, after: tuple | None = None) -> DataFrame:
    """A page of both kinds under one order: the greatest `order` first, entities before places, then by key. after: the last row's (order, kind, key). Each kind gives a page of its own first."""
    keys = [(order, True), ("kind", False), ("key", False)]
    columns = [F.desc(order), "kind", "key"]
    cursor = after_key(keys, [*after]) if after else None
    whole = united(entities, places, order)
    parts = [page(whole.filter(F.col("kind") == k), columns, size, cursor) for k in (ENTITY, PLACE)]
    return page(parts[0].unionByName(parts[1]), columns, size)


def located(actions: DataFrame, held: DataFrame, lat: str = "lat", lon: str = "lon", thing: str = "object") -> DataFrame:
    """actions with lat and lon: their own, or where they have none, the place that their object is at now, by the least key of several. held: runs (entity, period_to, place, lat, lon)."""
    now = held.filter("period_to is null and lat is not null and lon is not null").groupBy(F.col("entity").alias(thing)).agg(F.min(F.struct("place", "lat", "lon")).alias("at__"))
    own = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    rest = [c for c in actions.columns if c not in (lat, lon)]
    return actions.join(now, thing, "left").select(*rest, F.when(own, F.col(lat)).otherwise(F.col("at__.lat")).alias(lat), F.when(own, F.col(lon)).otherwise(F.col("at__.lon")).alias(lon))


def grid(actions: DataFrame, held: DataFrame, km: float, label: str, thing: str = "object") -> DataFrame:
    """groups.cells() of actions that have a place, or whose object is at one now."""
    return cells(located(actions, held, thing=thing), "lat", "lon", km, label)
