"""Payloads as rows. A payload is a JSON action whose roles hold nodes; a node has a type, an identity and predicates.

Each payload gives flat rows: one `action`, an `edge` for every filler of a role, an `entity` for every node seen, an
`observation` for every literal or link of a node (a marker, with neither, where a node asserts a predicate without a
value), and a `metric` for every number of a measured predicate. A date of a node's life is no value but one more
`action`, of which the node is the object; and a role that says something lasting of the action's object, such as where
it was born, is an observation of that from the action's time on. Only this flattening is Python, a small function a
payload; everything after it is DataFrame work. Payloads that are no JSON objects, nodes without any identity, and
dates that are none give an `error` row.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yore.functions.identity import canonical, key_of

ROLES = ("agent", "object", "result", "instrument", "target", "location")
MANY_ROLES = ("recipient", "attendee", "with")
ME = key_of(canonical({"reserved": "me"}))
COLUMNS = {
    "what": "string", "action": "string", "subject": "string", "keys": "array<string>", "type": "string", "source": "string", "source_id": "string", "predicate": "string",
    "value": "string", "target": "string", "number": "double", "valid_at": "long", "observed_at": "long", "start": "long", "end": "long", "earliest": "long", "latest": "long", "error": "string",
}
_ARROW = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
#: Keys of nodes, of which most come again.
_key_of = lru_cache(4096)(key_of)
#: Payloads that a task holds as Python's texts, with their rows, at a time.
PAYLOADS = 256


@dataclass
class Ontology:
    """What the names in payloads mean.

    predicates: name -> (whether it has many values, its kind: text, link or metric); others are dropped. lifecycle: a
    date predicate -> the type of the action that it dates. facets: an action's type -> (role, the predicate of its
    object that the role's filler is). encounters: an action's type -> who is met, its object or a message's other
    party. propagating: links over which meeting a thing meets another. special: a state -> the types of action that
    begin and end it.
    """

    predicates: dict[str, tuple[bool, str]] = field(
        default_factory=lambda: {
            "name": (False, "text"), "description": (False, "text"), "text": (False, "text"), "title": (False, "text"), "handle": (False, "text"), "email": (False, "text"), "address": (False, "text"),
            "genre": (True, "text"), "keywords": (True, "text"), "mood": (False, "text"),
            "birthPlace": (False, "link"), "deathPlace": (False, "link"), "home": (False, "link"), "inAlbum": (True, "link"), "partOf": (True, "link"), "performer": (True, "link"), "series": (True, "link"),
            "author": (True, "link"), "artist": (True, "link"), "member": (True, "link"), "memberOf": (True, "link"), "isPartOf": (True, "link"), "creator": (True, "link"), "publisher": (False, "link"), "about": (True, "link"),
            "activeEnergyBurned": (False, "metric"), "weight": (False, "metric"), "duration": (False, "metric"), "followers": (False, "metric"),
        }
    )
    # the names below are fixed values
    lifecycle: dict[str, str] = field(default_factory=lambda: {"datePublished": "PublishAction", "dateCreated": "CreateAction", "birthDate": "BirthAction", "deathDate": "DeathAction"})
    facets: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"BirthAction": ("location", "birthPlace"), "DeathAction": ("location", "deathPlace"), "MoveAction": ("location", "home"), "CreateAction": ("agent", "creator"), "PublishAction": ("agent", "publisher")}
    )
    encounters: dict[str, str] = field(
        default_factory=lambda: {"ReadAction": "object", "ListenAction": "object", "WatchAction": "object", "ViewAction": "object", "PlayAction": "object", "MessageAction": "message"}
    )
    propagating: tuple[str, ...] = ("artist", "creator", "inAlbum", "partOf", "performer", "series")
    special: dict[str, tuple[str, str]] = field(default_factory=lambda: {"liked": ("LikeAction", "UnlikeAction"), "following": ("FollowAction", "UnfollowAction"), "bookmarked": ("BookmarkAction", "UnbookmarkAction")})


def range_of(text) -> tuple[int | None, int | None]:
    """[first, last] millisecond of a year, month, day or instant."""
    return _range_of(text) if isinstance(text, str) else (None, None)


@lru_cache(4096)
def _range_of(text: str) -> tuple[int | None, int | None]:
    try:
        parts = [int(x) for x in text.split("-")] if len(text) <= 10 else []
        if parts:
            y, m, d = (parts + [1, 1])[:3]
            start = dt.datetime(y, m, d, tzinfo=dt.timezone.utc)
            after = start + dt.timedelta(1) if len(parts) == 3 else start.replace(year=y + 1) if len(parts) == 1 else (start + dt.timedelta(32)).replace(day=1)
            return int(start.timestamp() * 1000), int(after.timestamp() * 1000) - 1
        at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
        ms = int((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)
        return ms, ms
    except ValueError:
        return None, None


def _identity(node: dict) -> tuple[str | None, list[str]]:
    """(key, all keys) of a node: its own fields, its url, and what it is the same as."""
    fields = {f: node[f] for f in node.get("@key") or () if isinstance(f, str) and node.get(f) is not None}
    if set(fields) == {"url"}:
        fields = {"source": "url", **fields}
    key = node.get("@id") or (_key_of(canonical(fields)) if fields else None)
    keys = [key] if key else []
    if isinstance(node.get("url"), str):
        keys.append(_key_of(canonical({"source": "url", "url": node["url"]})))
    for other in node.get("sameAs") or ():
        keys += [ME] if other == "@me" else _identity(other)[1] if isinstance(other, dict) else [_key_of(canonical({"source": "url", "url": other}))]
    return key or (keys[0] if keys else None), sorted(set(keys))


def _shared(dates) -> tuple[int | None, int | None]:
    """What the ranges of one or more dates have in common; where they have nothing, the last one's."""
    at: tuple[int | None, int | None] = (None, None)
    for x in dates if isinstance(dates, list) else [dates]:
        lo, hi = range_of(x)
        if lo is not None:
            at = (max(at[0], lo), min(at[1], hi)) if at[0] is not None and max(at[0], lo) <= min(at[1], hi) else (lo, hi)
    return at


def _key(node) -> str | None:
    """The key of what fills a role."""
    return ME if node == "@me" else _identity(node)[0] if isinstance(node, dict) else None


def shred_one(body: str, asserted_at: int, ontology: Ontology, anchored: bool = False) -> Iterator[dict]:
    """Rows of one payload, as dicts of COLUMNS. anchored: asserted_at is when it was first seen, whatever the payload says of that."""
    try:
        payload = json.loads(body)
        if not isinstance(payload, dict) or "@type" not in payload:
            raise ValueError("no typed object")
    except ValueError as e:
        yield {"what": "error", "error": str(e)[:200]}
        return
    observed = range_of(payload.get("@assertedAt"))[0]
    if anchored:
        observed, payload = None, {k: v for k, v in payload.items() if k not in ("@assertedAt", "@kind")}
    observed = asserted_at if observed is None else observed
    lower, upper = range_of(payload.get("startTime") or payload.get("timestamp"))
    end = range_of(payload.get("endTime"))[1]
    action = _identity(payload)[0] or key_of(canonical(payload))
    valid = observed if lower is None else lower
    yield {
        "what": "action", "action": action, "type": payload["@type"], "source": payload.get("source"), "source_id": payload.get("sourceId"), "valid_at": valid, "observed_at": observed,
        "start": lower, "end": end, "earliest": lower, "latest": upper if upper is not None else observed,
    }
    todo: list[tuple[dict, str, list[str]]] = []

    def met(node) -> str | None:
        if node == "@me":
            node = {"@type": "Person", "@id": ME}
        if not isinstance(node, dict):
            return None
        key, keys = _identity(node)
        if key:
            todo.append((node, key, keys))
        return key

    said, facet = ontology.facets.get(payload["@type"], (None, None))
    whole = payload.get("object") if said else None
    whole = next((k for k in map(_key, whole if isinstance(whole, list) else [whole]) if k), None)
    said = said if whole else None
    for role in ROLES + MANY_ROLES:
        found = payload.get(role)
        for node in found if isinstance(found, list) else [found] if found is not None else []:
            key = met(node)
            if key and role == said:
                yield {"what": "observation", "action": action, "subject": whole, "source": payload.get("source"), "predicate": facet, "target": key, "valid_at": valid, "observed_at": observed, "start": lower}
            elif key:
                yield {"what": "edge", "action": action, "predicate": role, "target": key, "valid_at": valid, "observed_at": observed, "start": lower}
            else:
                yield {"what": "error", "action": action, "predicate": role, "error": "a role without an identity"}
    seen: dict[str, dict | set[str]] = {}
    while todo:
        node, key, keys = todo.pop()
        marks = seen.get(key)
        if marks is None:
            seen[key] = node  # equal nodes have one key, so that what it says is only compared if another has it
        else:
            marks = seen[key] = {canonical(marks)} if isinstance(marks, dict) else marks
            mark = canonical(node)
            if mark in marks:
                continue
            marks.add(mark)
        base = {"action": action, "subject": key, "source": node.get("source"), "valid_at": valid, "observed_at": observed, "start": lower}
        yield {"what": "entity", "keys": keys, "type": node.get("@type"), "source_id": node.get("sourceId"), **base}
        for predicate, kind in () if ontology.lifecycle.keys().isdisjoint(node) else ontology.lifecycle.items():
            if node.get(predicate) is not None:
                first, last = _shared(node[predicate])
                if first is None:
                    yield {"what": "error", "action": action, "predicate": predicate, "error": "a date that is none"}
                    continue
                happened = key_of(canonical({"@synthetic": True, "@type": kind, "object": key}))
                yield {"what": "action", "action": happened, "type": kind, "source": node.get("source"), "valid_at": first, "observed_at": observed, "start": first, "earliest": first, "latest": last}
                yield {"what": "edge", "action": happened, "predicate": "object", "target": key, "valid_at": first, "observed_at": observed, "start": first}
        asserts = set(node.get("@asserts") or ())
        named = node.keys() | asserts if asserts else node
        for predicate in [p for p in ontology.predicates if p in named]:
            many, kind = ontology.predicates[predicate]
            found = node.get(predicate)
            values = found if isinstance(found, list) else [found] if found is not None else []
            for v in values:
                if kind == "link":
                    target = met(v)
                    if target:
                        yield {"what": "observation", "predicate": predicate, "target": target, **base}
                    else:
                        yield {"what": "error", "action": action, "predicate": predicate, "error": "a link without an identity"}
                elif kind == "metric":
                    if isinstance(v, (int, float)) and not isinstance(v, bool):
                        yield {"what": "metric", "predicate": predicate, "number": float(v), **base}
                elif not isinstance(v, dict):
                    yield {"what": "observation", "predicate": predicate, "value": canonical(v), **base}
            if predicate in asserts or ("*" in asserts and many and values):
                yield {"what": "observation", "predicate": predicate, **base}


def shred(log: DataFrame, body: str = "body", asserted: str = "asserted_at", ontology: Ontology | None = None, keep: dict[str, str] | None = None, anchored: bool = False) -> DataFrame:
    """The rows of all payloads of a log (JSON texts, with when they were asserted in milliseconds). keep: columns of the log, with their types, that each of its payload's rows gets; anchored: see shred_one()."""
    ontology, keep = ontology or Ontology(), keep or {}
    columns = COLUMNS | keep
    schema = ", ".join(f"`{c}` {t}" for c, t in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(out: list[list], kept: list[pa.Array]) -> pa.RecordBatch:
            told = [pa.array(x, _ARROW[t], from_pandas=True) for x, t in zip(out, COLUMNS.values(), strict=True)]
            return pa.RecordBatch.from_arrays([*told, *(x.cast(_ARROW[t]) for x, t in zip(kept, keep.values(), strict=True))], names=list(columns))

        for batch in batches:
            for at in range(0, len(batch), PAYLOADS):
                rows, of = [], []
                for i, (b, t) in enumerate(zip(*(c.to_pylist() for c in batch.slice(at, PAYLOADS).columns[:2]), strict=True)):
                    rows += shred_one(b, t, ontology, anchored)
                    of += [at + i] * (len(rows) - len(of))
                yield told([[r.get(c) for r in rows] for c in COLUMNS], [c.take(pa.array(of, pa.int64())) for c in batch.columns[2:]])

    return log.select(F.coalesce(body, F.lit("")), F.col(asserted).cast("long"), *keep).mapInArrow(run, schema)
