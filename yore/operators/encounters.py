"""Who met what: a log of point events derived from actions, and conditions on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.operators import links, runs

#: What meeting an object and exchanging a message are called. An exchange goes both ways.
MET, EXCHANGED = "encounter", "interaction"
#: Scopes that a point can be asked for; any other is refused.
SCOPES = ("ever", "current", "past", "at", "during", "throughout", "before", "after")


def emitted(actions: DataFrame, edges: DataFrame, stated: DataFrame, related: DataFrame, kinds: dict[str, str], propagating: tuple[str, ...]) -> DataFrame:
    """(action, at, who, subject, level, through): one row for each action of a kind that meets someone, and one for each thing that what it met is related to.

    Of an action of kind `object`, its object is met. Of a `message`, the channel that the object (or, without
    one, the result) is stated to be part of there, else its recipient. Of several, that with the least key; the agent is met by no one and may be null. Things
    met are followed over one link of `propagating`, with `through` as the thing that led there; messages are not.

    actions: action, type, occurred_at; edges: action, role, entity; stated: action, of, predicate, object (links that
    the action itself states); related: entity, predicate, object (links that ever held).
    """
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("type"))
    role = lambda r, name: edges.filter(F.col("role") == r).groupBy("action").agg(F.min("entity").alias(name))
    rows = actions.filter(F.col("type").isin(list(kinds))).select("action", F.col("occurred_at").alias("at"), kind.alias("kind"))
    rows = rows.join(role("object", "o__"), "action", "left").join(role("result", "r__"), "action", "left").join(role("agent", "who"), "action", "left").join(role("recipient", "recipient"), "action", "left")
    made = F.when(F.col("kind") == "message", F.coalesce("o__", "r__")).otherwise(F.col("o__"))  # sending a message may also make it
    rows = rows.withColumn("object", made).drop("o__", "r__").filter("object is not null")
    channel = stated.filter("predicate = 'isPartOf'").groupBy("action", F.col("of").alias("object")).agg(F.min(stated["object"]).alias("channel"))
    rows = rows.join(channel, ["action", "object"], "left")
    subject = F.when(F.col("kind") == "object", F.col("object")).otherwise(F.coalesce("channel", "recipient"))
    direct = rows.select("action", "at", "who", subject.alias("subject"), F.when(F.col("kind") == "object", MET).otherwise(EXCHANGED).alias("level")).filter("subject is not null")
    to = related.filter(F.col("predicate").isin(list(propagating))).select(F.col("entity").alias("subject"), F.col("object").alias("target")).distinct()
    far = runs.spread(direct.filter(F.col("level") == MET).select(F.col("action").alias("event"), "who", "at", "subject"), to)
    far = far.select(F.col("event").alias("action"), "at", "who", "subject", F.lit(MET).alias("level"), "through").filter("subject <> through")
    return direct.withColumn("through", F.lit(None).cast(direct.schema["subject"].dataType)).unionByName(far)


def when(at: Column, scope: str = "ever", lo: int | None = None, hi: int | None = None) -> Column:
    """Whether a point event is in a scope. It neither opens nor closes, so ever, current and past hold of all; at: just then; during and throughout: in [lo, hi)."""
    if scope not in SCOPES:
        raise ValueError(f"a point event has no scope {scope!r}")
    if scope in ("ever", "current", "past"):
        return F.lit(True)
    return {"at": lambda: at == lo, "before": lambda: at < lo, "after": lambda: at > lo}.get(scope, lambda: (at >= lo) & (at < hi))()


def sides(log: DataFrame, level: str = MET) -> DataFrame:
    """(entity, other, at, action) of a level: an encounter is read from what was met, an exchange from both sides."""
    rows = log.filter(F.col("level") == level)
    subject = rows.select(F.col("subject").alias("entity"), F.col("who").alias("other"), "at", "action")
    return subject.unionByName(rows.filter("who is not null").select(F.col("who").alias("entity"), F.col("subject").alias("other"), "at", "action")) if level == EXCHANGED else subject


def with_encounter(entities: DataFrame, log: DataFrame, level: str = MET, others: DataFrame | None = None, no: bool = False, scope: str = "ever", lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Entities that were met, or exchanged something, within a scope; with any of `others` (entity) if given. With `no`, those of which that is not so."""
    rows = sides(log, level).filter(when(F.col("at"), scope, lo, hi))
    rows = rows.join(others.select(F.col("entity").alias("other")).distinct(), "other", "left_semi") if others is not None else rows
    return links.having(entities, rows, ["entity"], no)


def reduced(entities: DataFrame, log: DataFrame, test, level: str = MET, last: bool = False) -> DataFrame:
    """Entities whose first (or last) encounter's time passes test(column); those without any do not."""
    at = (F.max if last else F.min)("at").alias("at__")
    return links.having(entities, sides(log, level).groupBy("entity").agg(at).filter(test(F.col("at__"))), ["entity"])
