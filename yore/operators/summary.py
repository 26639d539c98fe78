"""What a set of rows is about: how many, when, and the breakdowns that group it best."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.operators import conditions as C
from yore.operators.groups import bucket, facet, time_unit
from yore.operators.shred import ROLES, Ontology
from yore.sources.shared import written

#: How many paths are tried, how many breakdowns are kept, and how many keys each shows.
TRIED, KEPT, TOP = 6, 3, 8
#: Predicates whose values are texts or addresses of their own and group nothing; fixed values.
UNGROUPED = ("name", "body", "text", "description", "url", "path", "matchedPath", "attachmentCid", "identifier")
#: Roles whose fillers' predicates are counted too.
SUBJECTS = ("object", "result", "target")


def candidates(coverage: dict[str, int], named: Iterable[str], pinned: Iterable[str] = ()) -> list[str]:
    """Paths worth a breakdown, best first: those that name things before plain values, denser before sparser, then by name. Paths that a query pins to one value and empty ones are out."""
    named, pinned = set(named), set(pinned)
    return sorted((p for p, n in coverage.items() if n > 0 and p not in pinned), key=lambda p: (p not in named, -coverage[p], p))


def summary(rows: DataFrame, paths: dict[str, Column], named: Iterable[str] = (), at: str | None = None, end: str | None = None, always: Iterable[str] = (), leave: Iterable[str] = ()) -> DataFrame:
    """(facet, key, count): `total`; `census`, how many rows have each path; `span`, the first and last millisecond; a breakdown by time where rows spread; one for each path of `always` with more than one value; and the KEPT best of TRIED candidates that group: more than one value, fewer values than rows.

    paths: name -> value; named: paths that name things; at, end: when a row happened; leave: paths that the query pins.
    What the counts need of rows is read once, in two passes over it; each breakdown that is shown is one more aggregate.
    """
    found = rows.select(*[v.alias(p) for p, v in paths.items()], *([F.col(at).alias("at__"), F.coalesce(F.col(end), F.col(at)).alias("end__") if end else F.col(at).alias("end__")] if at else []))
    q = lambda p: F.col(f"`{p}`")
    head = found.agg(F.count("*").alias("total__"), *[F.count(q(p)).alias(p) for p in paths], *([F.min("at__").alias("lo__"), F.max("end__").alias("hi__")] if at else [])).first()
    total, coverage = head["total__"], {p: head[p] for p in paths}
    told = [("total", "", total), *[("census", p, n) for p, n in sorted(coverage.items())]]
    timed = at and total and head["lo__"] is not None
    unit = time_unit(head["lo__"], head["hi__"]) if timed else None
    if timed:
        told += [("span", "first", head["lo__"]), ("span", "last", head["hi__"])]
    out = found.sparkSession.createDataFrame(told, _ROWS)
    if total > 1:
        tried = candidates({p: n for p, n in coverage.items() if p not in set(always)}, named, leave)[:TRIED]
        buckets = [bucket(F.col("at__"), unit).alias("time__")] if timed else []
        distinct = found.agg(*[F.countDistinct(q(p)).alias(p) for p in [*always, *tried]], *[F.countDistinct(b).alias("time__") for b in buckets], F.lit(0).alias("none__")).first()
        if timed and distinct["time__"] > 1:
            out = out.union(found.filter("at__ is not null").groupBy(*buckets).agg(F.count("*").alias("count")).select(F.lit(f"time:{unit}"), "time__", "count"))
        kept = [p for p in tried if 1 < distinct[p] < coverage[p]][:KEPT]
        for p in [*[p for p in always if distinct[p] > 1], *kept]:
            out = out.union(facet(found, q(p).cast("string"), TOP).select(F.lit(p), "key", "count"))
    return out


_ROWS = "facet string, key string, count long"


def _of_pairs(pairs: DataFrame, named: set[str], leave: set[str]) -> DataFrame:
    """Breakdowns of (root, path, key) pairs, each root once a key: the KEPT best of TRIED paths."""
    once = written(pairs.distinct())
    coverage = {r.path: r.n for r in once.groupBy("path").agg(F.countDistinct("root").alias("n")).collect()}  # paths of the ontology
    tried = candidates(coverage, named, leave)[:TRIED]
    groups = {r.path: (r.keys, r.n) for r in once.filter(F.col("path").isin(tried)).groupBy("path").agg(F.countDistinct("key").alias("keys"), F.count("*").alias("n")).collect()} if tried else {}
    out = once.sparkSession.createDataFrame([], _ROWS)
    for p in [p for p in tried if 1 < groups[p][0] < groups[p][1]][:KEPT]:
        out = out.union(facet(once.filter(F.col("path") == p), F.col("key"), TOP).select(F.lit(p), "key", "count"))
    return out


def _values(store) -> DataFrame:
    """(entity, predicate, key, names) of all that holds now: a link's key is the name that it leads to."""
    now = store.properties.filter("period_to is null")
    names = store.entities.select(F.col("entity").alias("object"), F.col("name").alias("n__"))
    return now.join(names, "object", "left").select("entity", "predicate", F.coalesce("n__", F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")).alias("key"), F.col("object").isNotNull().alias("names"))


def _standing(rows: DataFrame, root: str, paths: list[str], total: int) -> DataFrame:
    out = rows.sparkSession.createDataFrame([], _ROWS)
    for p in paths if total > 1 else []:
        groups = facet(rows.select(root, p).distinct(), F.col(p), TOP)
        out = out.union(groups.filter("distinct > 1").select(F.lit(p), "key", "count"))
    return out


def of_actions(store, conditions: Iterable = (), ontology: Ontology | None = None) -> DataFrame:
    """summary() of the actions of a store that meet conditions: their columns and roles, and what holds of the things in SUBJECTS. The census lists attachments even where there are none; paths that the conditions pin and UNGROUPED predicates give no breakdown."""
    conditions, ontology = list(conditions), ontology or Ontology()
    rows = written(C.actions(store, conditions, ontology).select("action", "source", "start", "end", "occurred_at"))
    head = summary(rows, {"startTime": F.col("start"), "endTime": F.col("end")}, at="occurred_at", end="end", leave=("startTime", "endTime"))
    total = rows.count()
    filled = written(store.edges.join(rows.select("action"), "action", "left_semi"))
    fillers = filled.join(store.entities.select("entity", "name"), "entity", "left")
    under = filled.filter(F.col("role").isin(*SUBJECTS)).join(_values(store), "entity")
    path = F.concat_ws(".", "role", "predicate")
    census = filled.groupBy(F.col("role").alias("key")).agg(F.countDistinct("action").alias("count")).union(under.groupBy(path.alias("key")).agg(F.countDistinct("action").alias("count")))
    slots = rows.sparkSession.createDataFrame([(r, 0) for r in [*ROLES, "timestamp"]], "key string, count long")
    empty = filled.filter(F.col("role").isin(*SUBJECTS)).select(F.concat("role", F.lit(".attachment")).alias("key"), F.lit(0).cast("long").alias("count")).distinct()
    counts = slots.union(rows.agg(F.count("*").alias("count")).select(F.lit("timestamp"), "count")).union(census).union(empty).groupBy("key").agg(F.max("count").alias("count"))
    pairs = fillers.select(F.col("action").alias("root"), F.concat("role", F.lit(".name")).alias("path"), F.col("name").alias("key"))
    pairs = pairs.union(under.filter(~F.col("predicate").isin(*UNGROUPED)).select("action", F.when(F.col("names"), F.concat(path, F.lit(".name"))).otherwise(path), "key")).filter("key is not null")
    named = {f"{r}.name" for r in ROLES} | {f"{r}.{p}.name" for r in SUBJECTS for p in ontology.predicates}
    shown = _of_pairs(pairs, named, C.pinned(conditions)) if total > 1 else rows.sparkSession.createDataFrame([], _ROWS)
    return head.union(counts.select(F.lit("census"), "key", "count")).union(_standing(rows, "action", ["source"], total)).union(shown)


def of_entities(store, conditions: Iterable = (), ontology: Ontology | None = None) -> DataFrame:
    """summary() of the entities of a store that meet conditions: their types and sources, and what holds of them."""
    conditions, ontology = list(conditions), ontology or Ontology()
    rows = written(C.entities(store, conditions, ontology).select("entity", "types"))
    total = rows.count()
    held = written(_values(store).join(rows, "entity", "left_semi"))
    census = held.groupBy(F.col("predicate").alias("key")).agg(F.countDistinct("entity").alias("count"))
    sources = store.sourced.join(rows, "entity", "left_semi").select("entity", "source")
    standing = _standing(rows.select("entity", F.explode("types").alias("type")), "entity", ["type"], total).union(_standing(sources, "entity", ["source"], total))
    pairs = held.filter(~F.col("predicate").isin(*UNGROUPED)).select(F.col("entity").alias("root"), F.when(F.col("names"), F.concat("predicate", F.lit(".name"))).otherwise(F.col("predicate")).alias("path"), "key").filter("key is not null")
    shown = _of_pairs(pairs, {f"{p}.name" for p in ontology.predicates}, C.pinned(conditions)) if total > 1 else rows.sparkSession.createDataFrame([], _ROWS)
    head = rows.sparkSession.createDataFrame([("total", "", total)], _ROWS)
    return head.union(census.select(F.lit("census"), "key", "count")).union(standing).union(shown)
