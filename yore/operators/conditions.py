"""Conditions on the entities or the actions of a store, as values that compose, with a check of what cannot be answered.

`entities` and `actions` answer a list of conditions, all of which must hold; each becomes joins and filters of the
other operators, planned by Spark as one query. Nothing runs before `refusals` has found nothing to object to: a
question that the store cannot answer raises Refused with all reasons, and never gives an empty answer instead.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.functions.texts import terms
from yore.operators import encounters as met
from yore.operators import entities as E
from yore.operators import links, near
from yore.operators.intervals import compared, valid
from yore.operators.shred import MANY_ROLES, ROLES, Ontology, range_of

#: Conditions on an entity that read its source records or columns, and on an action that read its own.
RECORD, COLUMN = ("source", "id", "handle", "email"), ("type", "source", "timestamp", "endTime", "duration")
ENCOUNTERS = {"encountered": met.MET, "interactedWith": met.EXCHANGED}
#: Scopes that take no time, one, and two.
WINDOWS = {"ever": 0, "current": 0, "past": 0, "at": 1, "before": 1, "after": 1, "asof": 1, "during": 2, "throughout": 2}
OPS = ("any", "=", "<", "<=", ">", ">=", "between")
#: What a value says that stands for the store's owner.
SELF = "@me"
#: Of bins that spans are counted in.
WIDTH = 90 * 86_400_000


class Refused(ValueError):
    """What a store cannot answer; `reasons` has one text for each thing."""

    def __init__(self, reasons: list[str]):
        super().__init__("; ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Has:
    """That a path has a value (op any), one that compares to `value` (between: from value to `to`), or leads to what meets `within`.

    how: of the things that it leads to some do, every one does (and there is one), or so many as `count` (op, n) says.
    """

    path: str
    op: str = "any"
    value: object = None
    to: object = None
    within: tuple = ()
    how: str = "some"
    count: tuple[str, int] | None = None
    no: bool = False


@dataclass(frozen=True)
class Either:
    """That one of several lists of conditions holds."""

    parts: tuple[tuple, ...]
    no: bool = False


@dataclass(frozen=True)
class Words:
    """That a text has all of these words."""

    text: str
    no: bool = False


@dataclass(frozen=True)
class During:
    """Conditions as of some time: the scope holds for each path in them."""

    scope: str
    lo: int | None
    hi: int | None
    parts: tuple
    no: bool = False


@dataclass(frozen=True)
class Near:
    """That an action which meets `anchor` is lo to hi milliseconds away: before, after, near, or while (overlapping). Of the same agent, unless anyone's will do; an entity is where its own life's actions are."""

    edge: str
    anchor: tuple
    lo: int = 0
    hi: int | None = None
    anyone: bool = False
    no: bool = False


@dataclass(frozen=True)
class Reduced:
    """That the first or last time of an encounter compares to a date."""

    which: str
    path: str
    op: str = "any"
    value: object = None
    to: object = None


Condition = Has | Either | Words | During | Near | Reduced


def kind_of(path: str, ontology: Ontology) -> str | None:
    """What a path on an entity is: type, record, name, encounter, special, lifecycle, inverse, link, metric or text; None if there is none such."""
    if path == "type":
        return "type"
    if path in RECORD:
        return "record"
    if path in ENCOUNTERS:
        return "encounter"
    for kind, names in (("special", ontology.special), ("lifecycle", ontology.lifecycle), ("inverse", E.INVERSE)):
        if path in names:
            return kind
    return ontology.predicates[path][1] if path in ontology.predicates else None


def _number(value) -> bool:
    try:
        float(value)
    except (TypeError, ValueError):
        return False
    return True


def _dates(c) -> Iterator[str]:
    """What is wrong with the dates of a comparison."""
    for v in [c.value] + [c.to] * (c.op == "between"):
        if range_of(v)[0] is None:
            yield f"{c.path} compares a time: {v!r} is no date" if v is not None else f"{c.path} is missing its date"


def _of_entity(c: Has, ontology: Ontology, scope: str | None) -> Iterator[str]:
    kind, timed = kind_of(c.path, ontology), scope not in (None, "ever")
    if kind is None:
        near_to = difflib.get_close_matches(c.path, [*ontology.predicates, *ontology.lifecycle, *ontology.special, *E.INVERSE, *ENCOUNTERS, *RECORD], 3)
        yield f"there is no field {c.path}" + (f"; did you mean {', '.join(near_to)}" if near_to else "")
        return
    quantified = c.how != "some" or c.count is not None
    if quantified and kind in ("text", "metric", "record", "type"):
        yield f"{c.path} holds values: a quantifier counts things that a path leads to"
    if quantified and kind in ("encounter", "special", "lifecycle"):
        yield f"{c.path} cannot be counted"
    if quantified and kind == "inverse" and c.how == "every":
        yield f"{c.path} is read backwards, where every is not asked for"
    if c.within and kind in ("text", "metric", "record", "type", "lifecycle"):
        yield f"{c.path} leads to nothing that could meet conditions"
    if kind == "type" and (c.op != "=" or not isinstance(c.value, (str, list, tuple)) or c.value == SELF):
        yield "type takes names of types"
    if kind == "record" and c.op not in ("any", "="):
        yield f"{c.path} names a record: {c.op} is not asked of it"
    if kind == "metric":
        if scope == "past" or scope in ("during", "throughout", "before", "after"):
            yield f"readings of {c.path} have no scope {scope}"
        if c.op != "any" and not _number(c.value):
            yield f"{c.path} is a number: {c.value!r} is none"
    if kind == "lifecycle" and c.op != "any":
        yield from _dates(c)
    if kind == "encounter" and scope is not None and scope not in met.SCOPES:
        yield f"encounters have no scope {scope}"
    if kind == "inverse" and timed:
        yield f"{c.path} is read backwards, without a scope"
    if kind in ("inverse", "encounter", "special") and c.op not in ("any", "="):
        yield f"{c.op} is not asked of {c.path}"
    if kind == "special" and scope == "asof":
        yield f"{c.path} has no scope asof"
    if kind in ("text", "link") and c.op not in ("any", "=") and not _number(c.value):
        yield f"{c.op} needs a number for {c.path}: {c.value!r} is none"


def _of_action(c: Has, ontology: Ontology, scope: str | None) -> Iterator[str]:
    if c.path in COLUMN:
        if c.how != "some" or c.count or c.within:
            yield f"{c.path} is a column of an action and leads to nothing"
        if c.path in ("timestamp", "endTime") and c.op != "any":
            yield from _dates(c)
        if c.path == "duration" and c.op in ("any", "="):
            yield "duration is compared (>=) or between two"
        elif c.path == "duration" and not all(map(_number, [c.value] + [c.to] * (c.op == "between"))):
            yield "duration takes milliseconds"
        if c.path in ("type", "source") and c.op != "=":
            yield f"{c.path} takes a name"
    elif c.path in ROLES + MANY_ROLES:
        if c.op not in ("any", "="):
            yield f"{c.op} is not asked of the role {c.path}"
        if c.how == "every":
            yield f"the role {c.path} is not asked for every"
    else:
        yield f"an action has no field {c.path}: ask its {', '.join(ROLES)}"


def refusals(conditions: Iterable[Condition], root: str = "entity", ontology: Ontology | None = None, me: bool = True, scope: str | None = None) -> list[str]:
    """Why a store cannot answer conditions on an entity or an action (root); empty if it can. me: whether the store knows its owner; scope: that the conditions stand in."""
    ontology, found = ontology or Ontology(), []
    inner = lambda parts, at=root, scope=scope: refusals(parts, at, ontology, me, scope)
    for c in conditions:
        if isinstance(c, Has):
            if c.op not in OPS or c.how not in ("some", "every"):
                found.append(f"there is no {c.op if c.op not in OPS else c.how}")
                continue
            if c.op not in ("any",) and c.value is None:
                found.append(f"{c.path} is missing its value")
                continue
            found += (_of_entity if root == "entity" else _of_action)(c, ontology, scope)
            if c.value == SELF and not me:
                found.append(f"the store does not know whom {SELF} means")
            found += inner(c.within, "entity")
        elif isinstance(c, Either):
            found += [] if c.parts and all(c.parts) else ["a choice needs something on every side"]
            for part in c.parts:
                found += inner(part)
        elif isinstance(c, Words):
            if root == "action":
                found.append("an action has no text: ask what takes part in it")
            if not c.text.strip():
                found.append("no words to look for")
        elif isinstance(c, During):
            wanted = WINDOWS.get(c.scope)
            if wanted is None:
                found.append(f"there is no scope {c.scope}")
            elif [c.lo, c.hi][:wanted].count(None):
                found.append(f"{c.scope} needs a window")
            if not c.parts:
                found.append(f"{c.scope} scopes nothing")
            if c.no and len(c.parts) > 1:
                found.append(f"only one condition can be negated under {c.scope}")
            if scope is not None:
                found.append(f"{c.scope} within {scope}: scopes are not nested")
            if any(isinstance(x, (Near, Reduced)) for x in c.parts):
                found.append(f"{c.scope} does not scope other events")
            found += inner([x for x in c.parts if not isinstance(x, (Near, Reduced))], scope=c.scope)
        elif isinstance(c, Near):
            if c.edge not in ("before", "after", "near", "while"):
                found.append(f"there is no {c.edge}")
            if not c.anchor:
                found.append(f"{c.edge} needs an anchor")
            if c.edge == "near" and c.hi is None:
                found.append("near needs a window")
            if c.edge == "while" and root == "entity":
                found.append("while is asked of an action, not of an entity")
            if c.hi is not None and c.hi < c.lo or c.lo < 0:
                found.append(f"{c.lo} to {c.hi} is no distance")
            found += inner(c.anchor, "action", None)
        elif isinstance(c, Reduced):
            if c.path not in ENCOUNTERS or c.which not in ("first", "last") or root == "action":
                found.append(f"{c.which} is asked of an entity's encounters, not of {c.path}")
            if c.op == "any":
                found.append(f"{c.which}({c.path}) is compared to a date")
            else:
                found += _dates(c)
            if scope is not None:
                found.append(f"{c.which}({c.path}) has no scope")
        else:
            found.append(f"{c!r} is no condition")
    return found


def pinned(conditions: Iterable[Condition], under: tuple[str, ...] = ()) -> set[str]:
    """Paths that the conditions leave with one name: those that lead to the owner, or to something whose name or id is given. A breakdown by them would be one bar."""
    found: set[str] = set()
    for c in conditions:
        if isinstance(c, During):
            found |= set() if c.no else pinned(c.parts, under)
        if not isinstance(c, Has) or c.no:
            continue
        at = (*under, c.path)
        named = any(isinstance(x, Has) and not x.no and x.op == "=" and x.path in ("name", "id") for x in c.within)
        if named or c.value == SELF and c.op == "=":
            found.add(".".join((*at, "name")))
        found |= pinned(c.within, at)
    return found


def _test(c, number: bool = True):
    """column -> whether it compares as the condition says; dates compare by their bounds."""
    if number:
        at = lambda v: (float(v), float(v))
    else:
        at = range_of
    if c.op == "any":
        return lambda x: x.isNotNull()
    lo, hi = at(c.value)
    if c.op == "between":
        return lambda x: x.between(lo, at(c.to)[1])
    return lambda x: compared(x, c.op, lo, hi)


class _Answer:
    def __init__(self, store, ontology: Ontology):
        self.s, self.o = store, ontology

    def entities(self, conditions: Iterable[Condition], scope: tuple | None = None) -> DataFrame:
        rows = self.s.entities
        for c in conditions:
            rows = self.entity(rows, c, scope)
        return rows

    def either(self, rows: DataFrame, c: Either, key: str, answer) -> DataFrame:
        """One membership for each part; a row in several is in once."""
        ids = None
        for part in c.parts:
            these = answer(part).select(key)
            ids = these if ids is None else ids.union(these)
        return links.having(rows, ids, [key], c.no)

    def me(self) -> DataFrame:
        return self.s.entities.filter("me")

    def entity(self, rows: DataFrame, c: Condition, scope: tuple | None) -> DataFrame:
        if isinstance(c, Either):
            return self.either(rows, c, "entity", lambda part: self.entities(part, scope))
        if isinstance(c, Words):
            return links.having(rows, E.saying(rows, self.s.words, [w for t in terms(c.text) for w in t.split()]), ["entity"], c.no)
        if isinstance(c, During):
            parts = [replace(x, no=c.no != x.no) for x in c.parts] if c.no else c.parts
            for x in parts:
                rows = self.entity(rows, x, (c.scope, c.lo, c.hi))
            return rows
        if isinstance(c, Reduced):
            return met.reduced(rows, self.s.encounters, _test(c, number=False), ENCOUNTERS[c.path], c.which == "last")
        if isinstance(c, Near):
            anchors = self.actions(c.anchor)
            return E.by_occurrence(rows, self.s.actions, self.s.edges, lambda events: self.away(events.withColumn("end", F.lit(None).cast("long")), "at", anchors, c, []), list(self.o.lifecycle.values()), c.no)
        kind = kind_of(c.path, self.o)
        return getattr(self, f"of_{kind}")(rows, c, scope or (("ever" if c.op == "any" and not c.within else "current"), None, None))

    def of_type(self, rows, c, scope):
        wanted = [c.value] if isinstance(c.value, str) else list(c.value)
        return links.having(rows, E.of_type(rows, wanted), ["entity"], c.no)

    def of_record(self, rows, c, scope):
        if c.path == "id":
            return links.having(rows, self.s.sourced.filter(F.col("subject") == c.value), ["entity"], c.no)
        test = F.col(c.path).isNotNull() if c.op == "any" else F.col(c.path).isin(c.value, f'"{c.value}"')
        return E.from_source(rows, self.s.sourced, test, c.no)

    def of_text(self, rows, c, scope):
        at = dict(zip(("scope", "lo", "hi"), scope, strict=True))
        if c.op == "any":
            return E.with_any(rows, self.s.properties, c.path, no=c.no, **at)
        if c.op == "=":
            return E.with_value(rows, self.s.properties, c.path, c.value, no=c.no, **at)
        return links.having(rows, E.with_number(rows, self.s.properties, c.path, _test(c), **at), ["entity"], c.no)

    def of_link(self, rows, c, scope):
        if not c.within and c.value != SELF and c.how == "some" and c.count is None:
            return self.of_text(rows, c, scope)
        at = dict(zip(("scope", "lo", "hi"), scope, strict=True))
        goal = self.me() if c.value == SELF else self.entities(c.within)
        how, op, n = ("count", *c.count) if c.count else (c.how, ">=", 1)
        return links.having(rows, E.linked(rows, self.s.properties, c.path, goal, how, op, n, **at), ["entity"], c.no)

    def of_inverse(self, rows, c, scope):
        if not c.within and c.op == "any" and c.count is None:
            return E.with_any(rows, self.s.properties, c.path, no=c.no)
        if c.op == "=":
            c = replace(c, within=(Has("name", "=", c.value),), value=None, op="any") if c.value != SELF else c
        return self.of_link(rows, c, scope)

    def of_metric(self, rows, c, scope):
        if c.op == "any":
            return links.having(rows, self.s.metrics.filter(F.col("predicate") == c.path), ["entity"], c.no)
        until = scope[1] if scope[0] in ("at", "asof") else None
        return links.having(rows, E.measured(rows, self.s.metrics, c.path, _test(c), until), ["entity"], c.no)

    def of_lifecycle(self, rows, c, scope):
        of = lambda lo=None, hi=None: E.dated(rows, self.s.actions, self.s.edges, c.path, lo, hi, self.o.lifecycle)
        if c.op in ("any", "=", "between"):
            lo, hi = (None, None) if c.op == "any" else (range_of(c.value)[0], range_of(c.to if c.op == "between" else c.value)[1])
            hit = of(lo, hi)
        else:
            when = E.occurrences(self.s.actions, self.s.edges.filter("role = 'object'"), [self.o.lifecycle[c.path]])
            hit = links.having(rows, when.filter(_test(c, number=False)(F.col("at"))), ["entity"])
        return links.having(rows, hit, ["entity"], c.no)

    def of_special(self, rows, c, scope):
        runs = self.s.special.filter((F.col("predicate") == c.path) & valid(F.col("period_from"), F.col("period_to"), *scope))
        if c.value == SELF or c.within:
            who = self.me() if c.value == SELF else self.entities(c.within)
            runs = runs.join(who.select(F.col("entity").alias("agent")), "agent", "left_semi")
        return links.having(rows, runs, ["entity"], c.no)

    def of_encounter(self, rows, c, scope):
        others = self.me() if c.value == SELF else self.entities(c.within) if c.within else None
        return met.with_encounter(rows, self.s.encounters, ENCOUNTERS[c.path], others, c.no, *scope)

    def actions(self, conditions: Iterable[Condition], scope: tuple | None = None) -> DataFrame:
        rows = self.s.actions
        for c in conditions:
            rows = self.action(rows, c)
        return rows

    def action(self, rows: DataFrame, c: Condition) -> DataFrame:
        if isinstance(c, Either):
            return self.either(rows, c, "action", self.actions)
        if isinstance(c, During):  # an action is a point or a span of its own
            start, end = F.col("occurred_at"), F.coalesce("end", "occurred_at")
            test = met.when(start, c.scope, c.lo, c.hi) if c.scope not in ("during", "at") else (start <= (c.lo if c.scope == "at" else c.hi)) & (end >= c.lo)
            rows = self.negated(rows, test, c.no)
            for x in c.parts:
                rows = self.action(rows, x)
            return rows
        if isinstance(c, Near):
            key = [] if c.anyone else ["agent__"]
            agent = self.s.edges.filter("role = 'agent'").groupBy("action").agg(F.min("entity").alias("agent__"))
            of = lambda df: df if c.anyone else df.join(agent, "action", "left")
            return links.having(rows, self.away(of(rows), "occurred_at", of(self.actions(c.anchor)), c, key), ["action"], c.no)
        if c.path in COLUMN:
            return self.negated(rows, self.column(c), c.no)
        who = self.me() if c.value == SELF else self.entities([Has("name", "=", c.value)]) if c.op == "=" else self.entities(c.within) if c.within else None
        if c.count:
            edges = self.s.edges.filter(F.col("role") == c.path)
            edges = edges.join(who.select("entity"), "entity", "left_semi") if who is not None else edges
            return links.having(rows, links.counted(rows, edges, ["action"], *c.count), ["action"], c.no)
        return E.acting(rows, self.s.edges, c.path, who, c.no)

    @staticmethod
    def negated(rows: DataFrame, test: Column, no: bool) -> DataFrame:
        test = F.coalesce(test, F.lit(False))
        return rows.filter(~test if no else test)

    @staticmethod
    def column(c: Has) -> Column:
        if c.path in ("type", "source"):
            return F.col(c.path).isin(*([c.value] if isinstance(c.value, str) else c.value))
        if c.path == "duration":
            return _test(c)(F.col("end") - F.col("occurred_at"))
        return _test(c, number=False)(F.col("occurred_at" if c.path == "timestamp" else "end"))

    @staticmethod
    def away(rows: DataFrame, start: str, anchors: DataFrame, c: Near, key: list[str]) -> DataFrame:
        """The rows that an anchor is so far away from; no row is its own anchor."""
        spans = anchors.select("action", *key, F.col("occurred_at").alias("s__"), F.col("end").alias("e__"))
        timed = rows.withColumns({"s__": F.col(start), "e__": F.col("end")})
        own = links.flagged(timed, spans, ["action"], "own__")
        if c.edge == "while" or c.edge == "near" and c.lo == 0:
            wide = own.withColumns({"s__": F.col("s__") - (c.hi or 0), "e__": F.coalesce("e__", "s__") + (c.hi or 0)}) if c.edge == "near" else own
            found = near.count_overlapping(wide, spans, "s__", "e__", WIDTH, key, "n__")
            return found.filter(F.col("n__") > F.col("own__").cast("int")).drop("n__", "own__", "s__", "e__")
        found = near.has_span_within(own, spans, "s__", "e__", c.edge, c.lo, c.hi if c.hi is not None else 1 << 42, WIDTH, key)
        return found.filter("near").drop("near", "own__", "s__", "e__")


def _asked(store, conditions, root: str, ontology: Ontology | None) -> _Answer:
    conditions, ontology = list(conditions), ontology or Ontology()
    reasons = refusals(conditions, root, ontology)
    if reasons:
        raise Refused(reasons)
    return _Answer(store, ontology)


def entities(store, conditions: Iterable[Condition], ontology: Ontology | None = None) -> DataFrame:
    """The entities of a store (plans.store.Store) that meet all conditions; raises Refused before anything runs."""
    return _asked(store, conditions, "entity", ontology).entities(conditions)


def actions(store, conditions: Iterable[Condition], ontology: Ontology | None = None) -> DataFrame:
    """The actions of a store that meet all conditions; raises Refused before anything runs."""
    return _asked(store, conditions, "action", ontology).actions(conditions)
