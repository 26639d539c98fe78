"""Entities and actions as rows for a reader: current values, history, neighbours, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def current(properties: DataFrame) -> DataFrame:
    """(entity, values): a map from predicate to its open literal values, sorted and joined by semicolons."""
    each = properties.filter("period_to is null and value is not null").groupBy("entity", "predicate").agg(F.array_join(F.array_sort(F.collect_set("value")), "; ").alias("v"))
    return each.groupBy("entity").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicate", "v")))).alias("values"))


def history(properties: DataFrame) -> DataFrame:
    """(entity, runs): all runs of an entity in time order."""
    run = F.struct(F.coalesce("period_from", F.lit(-(2**62))).alias("at"), "predicate", F.coalesce("value", "object").alias("value"), "period_from", "period_to")
    found = properties.groupBy("entity").agg(F.array_sort(F.collect_set(run)).alias("runs"))
    return found.select("entity", F.transform("runs", lambda r: F.struct(r["predicate"].alias("predicate"), r["value"].alias("value"), r["period_from"].alias("period_from"), r["period_to"].alias("period_to"))).alias("runs"))


def neighbourhood(properties: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(entity, distance): what open links reach from `start` (entity) in at most so many hops, in either direction. One join a hop with what was new in the last."""
    links = properties.filter("period_to is null and object is not null").select("entity", "object").distinct()
    both = links.union(links.select("object", "entity")).distinct()
    seen = start.select("entity", F.lit(0).alias("distance")).distinct()
    edge = seen
    for n in range(1, hops + 1):
        edge = edge.join(both, "entity").select(F.col("object").alias("entity")).distinct().join(seen, "entity", "left_anti").withColumn("distance", F.lit(n))
        seen = seen.unionByName(edge)
    return seen


def hydrated(entities: DataFrame, properties: DataFrame, paths: list[str]) -> DataFrame:
    """(entity, name, links): for each path of link predicates such as `author` or `author.memberOf`, the names at its end."""
    out = entities.select("entity", "name")
    for path in paths:
        at = entities.select("entity", F.col("entity").alias("here__"))
        for predicate in path.split("."):
            step = properties.filter((F.col("predicate") == predicate) & F.col("period_to").isNull() & F.col("object").isNotNull()).select(F.col("entity").alias("here__"), F.col("object").alias("next__")).distinct()
            at = at.join(step, "here__").select("entity", F.col("next__").alias("here__")).distinct()
        named = at.join(entities.select(F.col("entity").alias("here__"), F.col("name").alias("n__")), "here__").groupBy("entity").agg(F.array_sort(F.collect_set("n__")).alias(path))
        out = out.join(named, "entity", "left").withColumn(path, F.coalesce(F.col(f"`{path}`"), F.array().cast("array<string>")))
    return out


def sources(sourced: DataFrame) -> DataFrame:
    """(entity, iri, records): the least key and all source records of an entity."""
    return sourced.groupBy("entity").agg(F.min("subject").alias("iri"), F.array_sort(F.collect_set(F.struct("source", "source_id", "type"))).alias("records"))


def backlinks(properties: DataFrame, entity: str) -> DataFrame:
    """Entities with an open link to one."""
    return properties.filter((F.col("object") == entity) & F.col("period_to").isNull()).select("entity").distinct().orderBy(F.desc("entity"))


def first_handles(records: DataFrame) -> DataFrame:
    """(entity, handle): of an entity's source records with a handle, that of the least source and key. records: entity, source, key, handle."""
    return records.filter("handle is not null").groupBy("entity").agg(F.min_by("handle", F.struct("source", "key")).alias("handle"))


def best_urls(records: DataFrame) -> DataFrame:
    """(entity, url): of an entity's source records with a url, one that is declared canonical first, then that of the least source and key. records: entity, source, key, url, canonical."""
    return records.filter("url is not null").groupBy("entity").agg(F.min_by("url", F.struct((~F.coalesce("canonical", F.lit(False))).alias("other"), "source", "key")).alias("url"))


def images(entities: DataFrame, blobs: DataFrame, urls: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(entity, image, kind): the image that shows an entity: a stored blob (entity, cid), else a url (entity, url), else the newest snapshot that shows it (entity, media, cid); the least of several."""
    a = blobs.groupBy("entity").agg(F.min("cid").alias("blob__"))
    b = urls.groupBy("entity").agg(F.min("url").alias("url__"))
    c = snapshots.groupBy("entity").agg(F.max_by("cid", "media").alias("shot__"))
    found = entities.select("entity").join(a, "entity", "left").join(b, "entity", "left").join(c, "entity", "left")
    kind = F.when(F.col("blob__").isNotNull(), "blob").when(F.col("url__").isNotNull(), "url").when(F.col("shot__").isNotNull(), "snapshot")
    return found.select("entity", F.coalesce("blob__", "url__", "shot__").alias("image"), kind.alias("kind")).filter("image is not null")


def snapshot(rows: DataFrame) -> DataFrame:
    """(line): each row as JSON with its columns in the order of their names, sorted; equal tables give equal snapshots, whatever the order of rows and columns."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}).alias("line")).orderBy("line")


def named_places(rows: DataFrame, places: DataFrame, on: str, out: str = "place") -> DataFrame:
    """rows with the name of the place that their location value `on` leads to; null where it leads to none. places: value, name; of several names the least."""
    one = places.groupBy(F.col("value").alias(on)).agg(F.min("name").alias(out))
    return rows.join(one, on, "left")


def referenced(node: str | dict) -> dict:
    """A node's identity alone: its type, its key or id, and the fields that the key names, nested ones as references too."""
    import json

    node = json.loads(node) if isinstance(node, str) else node
    out = {k: node[k] for k in ("@type", "@key", "@id") if k in node}
    is_node = lambda x: isinstance(x, dict) and isinstance(x.get("@type"), str)
    for f in node.get("@key") or ():
        head = f.split("[*]")[0].split(".")[0] if isinstance(f, str) and not f.startswith(("@", "action.")) else None
        if head and head in node and head not in out:
            v = node[head]
            out[head] = referenced(v) if is_node(v) else [referenced(x) if is_node(x) else x for x in v] if isinstance(v, list) else v
    return out


def deep(levels: int) -> dict:
    """The shape of everything that holds, over so many links."""
    return {"*": deep(levels - 1)} if levels > 1 else {"*": None}


def paths_of(shape: dict, under: str = "") -> list[str]:
    """The dotted paths that a shape follows, sorted; of a path's beginnings only the longest is told."""
    found = []
    for name, inner in shape.items():
        if name != "history":
            at = f"{under}.{name}" if under else name
            found += paths_of(inner, at) if inner else [at]
    return sorted(found)


def shaped(entities: DataFrame, properties: DataFrame, roots: DataFrame, shape: dict) -> DataFrame:
    """(entity, json) of roots (entity): what a shape asks of each, as one JSON text with predicates in order and values sorted.

    shape: predicate -> None (its values; of a link the key and name of what it leads to) or the shape of what it leads
    to; the name * stands for all predicates that have no shape of their own, and "history": True for all runs with
    their periods, not only those that hold. What would lead back to something on the way there is only named, so a
    shape ends on any circle. Each level is a join and two groupings of the level above; only what is asked for is read.
    """
    named = entities.select(F.col("entity").alias("n__"), "name", "types")
    at = roots.select("entity").distinct().select(F.col("entity").alias("rid__"), F.array("entity").alias("way__"), "entity")
    return _level(named, properties, at, shape).select(F.col("rid__").alias("entity"), "json")


def _quoted(x: Column) -> Column:
    told = F.to_json(F.struct(x.alias("v")))
    return F.when(x.isNotNull(), F.substring(told, F.lit(6), F.length(told) - 6))


def _head(key: Column, name: Column) -> Column:
    """The first members of an entity's JSON."""
    return F.concat(F.lit('"@id":'), _quoted(key), F.coalesce(F.concat(F.lit(',"name":'), _quoted(name)), F.lit("")))


def _level(named: DataFrame, properties: DataFrame, at: DataFrame, shape: dict) -> DataFrame:
    """(rid__, json) of the entities at one node of a shape. at: rid__ (which place in the answer), way__ (the entities on the way there), entity."""
    own = [p for p in shape if p not in ("*", "history")]
    runs = properties if shape.get("history") else properties.filter("period_to is null")
    runs = runs if "*" in shape else runs.filter(F.col("predicate").isin(own))
    rows = at.join(runs.select("entity", "predicate", "value", "object", "period_from", "period_to").distinct(), "entity")
    rows = rows.join(named.select(F.col("n__").alias("object"), F.col("name").alias("o__")), "object", "left")
    short = F.concat(F.lit("{"), _head(F.col("object"), F.col("o__")), F.lit("}"))
    rows = rows.withColumn("v__", F.when(F.col("object").isNotNull(), short).otherwise(F.col("value")))
    back = F.array_contains("way__", F.col("object"))
    for name, inner in shape.items():
        if inner and name != "history":
            asked = F.col("object").isNotNull() & ~back & (~F.col("predicate").isin(own) if name == "*" else F.col("predicate") == name)
            rid = F.when(asked, F.concat_ws("/", "rid__", "predicate", "object"))
            rows = rows.withColumn("c__", rid)
            below = rows.filter("c__ is not null").select(F.col("c__").alias("rid__"), F.concat("way__", F.array("object")).alias("way__"), F.col("object").alias("entity")).dropDuplicates(["rid__"])
            found = _level(named, properties, below, inner)
            rows = rows.join(found.select(F.col("rid__").alias("c__"), F.col("json").alias("j__")), "c__", "left").withColumn("v__", F.coalesce("j__", "v__")).drop("c__", "j__")
    if shape.get("history"):
        period = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
        rows = rows.withColumn("v__", F.concat(F.lit('{"value":'), "v__", F.lit(',"from":'), period("period_from"), F.lit(',"to":'), period("period_to"), F.lit("}")))
    each = rows.groupBy("rid__", "predicate").agg(F.array_join(F.array_sort(F.collect_set("v__")), ",").alias("v__"))
    members = each.select("rid__", F.concat(_quoted(F.col("predicate")), F.lit(":["), "v__", F.lit("]")).alias("m__"))
    whole = members.groupBy("rid__").agg(F.array_join(F.array_sort(F.collect_list("m__")), ",").alias("m__"))
    head = at.select("rid__", "entity").join(named, F.col("entity") == F.col("n__"), "left").join(whole, "rid__", "left")
    return head.select("rid__", F.concat(F.lit("{"), _head(F.col("entity"), F.col("name")), F.coalesce(F.concat(F.lit(","), "m__"), F.lit("")), F.lit("}")).alias("json"))
