"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yore.sources.shared import cut, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).distinct()
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(u, v): component is the smallest node that it reaches.

    Alternates large-star and small-star steps, each a partial aggregation and an equi-join that adaptive
    execution can split, and ends when a round changes nothing: every edge is then a node and its component. Each round
    is checkpointed, so a lost executor costs one round at most.
    """
    edges = cut(edges.select("u", "v").filter("u <> v").distinct())
    print_of = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = print_of(edges)
    while last[0]:
        edges = cut(_small_star(_large_star(edges)).filter("u <> v").distinct())
        now = print_of(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def resolve(records: DataFrame, record: str, keys: str, once: bool = False) -> DataFrame:
    """(record, entity): records that share any of their keys, directly or over others, are one entity, whose id is the least key reachable. records: record, keys (array of strings).

    Keys are numbered by hash, and a record links its keys to its least one, so that a record with many keys gives a
    star and no pairs. Records without keys are left out. A record that shares no key is its own least key: it is only
    compared with the others' keys, of which few are sent to it. once: each record is one row, so that its keys need not
    come together first.
    """
    if once:
        least = records.select(record, F.array_min(keys).alias("m__")).filter("m__ is not null")
        named = records.select(F.explode(keys).alias("k__"), F.array_min(keys).alias("m__")).filter("k__ is not null")
    else:
        each = records.select(record, F.explode(keys).alias("k__")).filter("k__ is not null").distinct()
        least = each.groupBy(record).agg(F.min("k__").alias("m__"))
        named = each.join(least, record)
    edges = named.filter("k__ <> m__").select(F.xxhash64("k__").alias("u"), F.xxhash64("m__").alias("v"))
    parts = written(connected_components(edges))
    ids = least.withColumn("node", F.xxhash64("m__"))
    names = ids.join(parts, "node").groupBy("component").agg(F.min("m__").alias("entity"))
    heads = written(parts.join(names, "component").select("node", "entity"))
    return ids.join(heads, "node", "left").select(record, F.coalesce("entity", "m__").alias("entity"))
