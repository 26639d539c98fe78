"""Conditions on the entities and actions of a store, each a semi- or anti-join or a filter, so that they compose and Spark plans them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.functions.identity import canonical
from yore.operators import links
from yore.operators.intervals import meets, valid
from yore.operators.shred import Ontology

INVERSE = {"hasPart": "isPartOf", "hasMember": "memberOf"}


def of_type(entities: DataFrame, types: list[str]) -> DataFrame:
    return entities.filter(F.arrays_overlap("types", F.array(*map(F.lit, types))))


def scoped(properties: DataFrame, predicate: str, scope: str = "current", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """The runs of a predicate in a scope."""
    return properties.filter((F.col("predicate") == predicate) & valid(F.col("period_from"), F.col("period_to"), scope, lo, hi, F.col("first_valid")))


def with_value(entities: DataFrame, properties: DataFrame, predicate: str, value, scope: str = "current", no: bool = False, **at) -> DataFrame:
    """Entities whose predicate equals a text, as text or as the number or truth that it spells, or points to an entity of that name."""
    texts = {canonical(value)} | ({value} if isinstance(value, str) and value.replace(".", "", 1).lstrip("-").isdigit() or value in ("true", "false") else set())
    named = entities.filter(F.col("name") == str(value)).select(F.col("entity").alias("object"))
    runs = scoped(properties, predicate, scope, **at)
    hit = runs.filter(F.col("value").isin(*texts)).select("entity").union(runs.join(named, "object", "left_semi").select("entity"))
    return links.having(entities, hit, ["entity"], no)


def with_any(entities: DataFrame, properties: DataFrame, predicate: str, scope: str = "ever", no: bool = False, **at) -> DataFrame:
    """Entities that have (or, with `no`, lack) the predicate; closed runs count by default. An inverse predicate is had by what the forward one points to."""
    forward = INVERSE.get(predicate)
    if forward:
        pointed = scoped(properties, forward, scope, **at).filter("object is not null").select(F.col("object").alias("entity"))
        return links.having(entities, pointed, ["entity"], no)
    return links.having(entities, scoped(properties, predicate, scope, **at), ["entity"], no)


def with_number(entities: DataFrame, properties: DataFrame, predicate: str, test, scope: str = "current", **at) -> DataFrame:
    """Entities whose predicate is a JSON number that passes test(column)."""
    runs = scoped(properties, predicate, scope, **at).filter(F.col("value").rlike(r"^-?[0-9]"))
    return links.having(entities, runs.filter(test(F.col("value").try_cast("double"))), ["entity"])


def measured(entities: DataFrame, metrics: DataFrame, predicate: str, test, until: int | None = None) -> DataFrame:
    """Entities whose latest reading of a metric (at most at `until`) passes test(column)."""
    rows = metrics.filter(F.col("predicate") == predicate)
    rows = rows.filter(F.col("valid_at") <= until) if until is not None else rows
    last = rows.groupBy("entity").agg(F.max_by("number", F.struct("valid_at", "observed_at", "number")).alias("n__"))
    return links.having(entities, last.filter(test(F.col("n__"))), ["entity"])


def linked(entities: DataFrame, properties: DataFrame, predicate: str, targets: DataFrame, how: str = "some", op: str = ">=", n: int = 1, scope: str = "current", **at) -> DataFrame:
    """Entities whose links lead to `targets` (entity): some, none, every, or count compared to n. An inverse predicate walks the forward one backwards."""
    forward = INVERSE.get(predicate)
    runs = scoped(properties, forward or predicate, scope, **at).filter("object is not null")
    edges = runs.select(F.col("object").alias("entity"), F.col("entity").alias("to__")) if forward else runs.select("entity", F.col("object").alias("to__"))
    edges = edges.distinct()
    goal = targets.select(F.col("entity").alias("to__")).distinct()
    if how in ("some", "none"):
        return links.having(entities, edges.join(goal, "to__", "left_semi"), ["entity"], no=how == "none")
    if how == "count":
        return links.counted(entities, edges.join(goal, "to__", "left_semi"), ["entity"], op, n)
    if how == "every":
        return links.every(entities, links.flagged(edges, goal, ["to__"], "ok__"), ["entity"], F.col("ok__"))
    raise ValueError(f"unknown quantifier {how!r}")


def by_key(entities: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The entity that any of its source records' keys names. records: subject, entity."""
    return links.having(entities, records.filter(F.col("subject") == key), ["entity"])


def from_source(entities: DataFrame, sourced: DataFrame, test: Column, no: bool = False) -> DataFrame:
    """Entities with a source record that passes the test on source and source_id."""
    return links.having(entities, sourced.filter(test), ["entity"], no)


def saying(entities: DataFrame, words: DataFrame, phrase: list[str]) -> DataFrame:
    """Entities whose text has all of these words."""
    return links.having(entities, words.filter(F.size(F.array_except(F.array(*map(F.lit, phrase)), F.col("tokens"))) == 0), ["entity"])


def acting(actions: DataFrame, edges: DataFrame, role: str, who: DataFrame | None = None, no: bool = False) -> DataFrame:
    """Actions whose role is filled, by one of `who` (entity) if given; with `no`, those of which that is not so."""
    rows = edges.filter(F.col("role") == role)
    rows = rows.join(who.select("entity"), "entity", "left_semi") if who is not None else rows
    return links.having(actions, rows, ["action"], no)


def occurrences(actions: DataFrame, edges: DataFrame, types: list[str]) -> DataFrame:
    """(entity, action, at, earliest, latest): actions of these types that an entity is the object or the result of, such as its publication."""
    of = edges.filter(F.col("role").isin("object", "result")).select("action", "entity").distinct()
    return actions.filter(F.col("type").isin(types)).select("action", F.col("occurred_at").alias("at"), "earliest", "latest").join(of, "action").select("entity", "action", "at", "earliest", "latest")


def dated(entities: DataFrame, actions: DataFrame, edges: DataFrame, predicate: str, lo: int | None = None, hi: int | None = None, kinds: dict[str, str] | None = None, no: bool = False) -> DataFrame:
    """Entities whose date, which is that of an action on them, can lie in [lo, hi]. kinds: predicate -> type, as in an Ontology."""
    kinds = kinds or Ontology().lifecycle
    if predicate not in kinds:
        raise ValueError(f"{predicate} dates no action")
    when = occurrences(actions, edges.filter("role = 'object'"), [kinds[predicate]]).filter(meets(F.col("earliest"), F.col("latest"), lo, hi))
    return links.having(entities, when, ["entity"], no)


def by_occurrence(entities: DataFrame, actions: DataFrame, edges: DataFrame, test, types: list[str] | None = None, no: bool = False) -> DataFrame:
    """Entities with an action of their life that test(rows of occurrences()) keeps: with operators.near, those that came about so long after or before something."""
    return links.having(entities, test(occurrences(actions, edges, types or list(Ontology().lifecycle.values()))), ["entity"], no)
