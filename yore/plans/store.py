"""From a log of payloads to derived tables. Nothing depends on the order in which payloads arrive: keys are content hashes, a claim is seen from its first sighting to its last, and every choice among rows has a total order.

The steps stand alone, since the ledger (`plans/ledger.py`) takes the same ones over the parts of its tables that a
batch touches: sightings -> claims -> facts -> registers and observations -> chains -> the tables of a Store.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.functions.identity import canonical_text, key_of
from yore.functions.texts import tokens
from yore.functions.times import date_range
from yore.operators import encounters as met
from yore.operators import runs
from yore.operators.components import resolve
from yore.operators.shred import ME, PAYLOADS, Ontology, shred
from yore.sources.shared import release, written

#: What a source record can be renamed in.
IDENTIFIERS = ("handle", "email")


@dataclass
class Store:
    """sourced: subject, entity, source, source_id, type, and current identifiers. entities: entity, name, types. actions, edges (action, role, entity), properties (entity, predicate, value or object, periods), metrics, words (entity, tokens), encounters (see operators.encounters), special (entity, predicate, agent, periods), errors."""

    sourced: DataFrame
    entities: DataFrame
    actions: DataFrame
    edges: DataFrame
    properties: DataFrame
    metrics: DataFrame
    words: DataFrame
    encounters: DataFrame
    special: DataFrame
    errors: DataFrame


@F.arrow_udf(T.StringType())
def claim_of(bodies: pa.Array) -> pa.Array:
    """The key of what a payload claims, whenever and however it was asserted; of a text that is no JSON object, of the text."""

    def one(body: str | None) -> str:
        try:
            return key_of(canonical_text(body or "", ("@assertedAt", "@kind")))
        except ValueError:
            return key_of(body or "")

    return pa.array([one(x) for at in range(0, len(bodies), PAYLOADS) for x in bodies.slice(at, PAYLOADS).to_pylist()], pa.string())


def sightings(log: DataFrame, body: str = "body", asserted: str = "asserted_at") -> DataFrame:
    """(cid, claim, kind, seen_at, body) of a log's rows: what is claimed, and when it was seen; the payload says when, or else the column. kind is that of the log or the payload: assert, restated or confirm."""
    said = lambda name: F.get_json_object(body, f"$['{name}']")
    kind = F.col("kind") if "kind" in log.columns else said("@kind")
    claim = F.col("claim") if "claim" in log.columns else claim_of(F.col(body))
    seen = F.coalesce(date_range(said("@assertedAt"))["lower"], F.col(asserted).cast("long"), F.lit(0))
    rows = log.select(claim.alias("claim"), F.coalesce(kind, F.lit("assert")).alias("kind"), seen.alias("seen_at"), F.col(body).alias("body"), *[F.col(c).cast("string") for c in ("cid",) if c in log.columns])
    cid = F.col("cid") if "cid" in rows.columns else F.concat_ws(":", "claim", "kind", "seen_at")
    return rows.select(cid.alias("cid"), "claim", "kind", "seen_at", "body")


def claims(seen: DataFrame) -> DataFrame:
    """(claim, body, first_seen, last_seen): a claim holds from its first sighting on, whether that was its assert or a confirm; confirms of what the store only restated do not make it more recent."""
    restated = F.max(F.col("kind") == "restated") & ~F.max(F.col("kind") == "assert")
    first = F.struct(F.col("body").isNull().alias("none"), (F.col("kind") != "assert").alias("later"), "seen_at", "cid" if "cid" in seen.columns else "kind")
    found = seen.groupBy("claim").agg(F.min_by("body", first).alias("body"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("z__"), restated.alias("r__"))
    return found.select("claim", "body", "first_seen", F.when(F.col("r__"), F.col("first_seen")).otherwise(F.col("z__")).alias("last_seen"))


def facts(told: DataFrame, ontology: Ontology, named: bool = True) -> DataFrame:
    """The shredded rows of claims, with the claim, if `named`, and when it was last seen; of claims without a body none."""
    return shred(told.filter("body is not null"), asserted="first_seen", ontology=ontology, keep=({"claim": "string"} if named else {}) | {"last_seen": "long"}, anchored=True)


def registers(rows: DataFrame) -> DataFrame:
    """One row an action of facts: what all its sightings agree on."""
    found = runs.registers(rows.filter("what = 'action'"), ["action"], ["observed_at", "source", "source_id", "type"], ["type", "source", "source_id", "start", "observed_at"], "earliest", "latest", "end")
    return found.withColumn("occurred_at", F.coalesce("earliest", "observed_at"))


def observations(rows: DataFrame) -> DataFrame:
    """Observations of facts as runs() takes them, still placed where their own claims say; `start` is null where that is a sighting."""
    value = F.coalesce("value", F.concat(F.lit("@"), "target"))
    return rows.filter("what = 'observation'").select("subject", "predicate", "valid_at", "observed_at", F.col("last_seen").alias("confirmed_at"), value.alias("value"), "action", F.lit(0).alias("grade"), "start", *(c for c in ("claim",) if c in rows.columns))


def sharpened(observed: DataFrame, actions: DataFrame) -> DataFrame:
    """Observations placed where their action happened move to the start of what all its sightings agree on, so that a finer date sharpens boundaries that a coarser one opened."""
    # an action sighted once happened where its observations are already, and what has no start is not placed by its action
    known = actions.filter("not conflict and earliest is not null and sightings > 1").select("action", F.col("earliest").alias("e__"))
    placed = observed.filter("start is not null").join(known, "action", "left").withColumn("valid_at", F.coalesce("e__", "valid_at")).drop("e__")
    return placed.unionByName(observed.filter("start is null"))


def chains(observed: DataFrame, ontology: Ontology, apart: bool = False) -> DataFrame:
    """Validity runs of all (subject, predicate). Sightings that differ in their claims alone count once.

    apart: sightings are written once and chains that nothing ever ends are added up apart (see runs.lasting), as most
    names are, so that neither all sightings of a thing come together nor the others' windows wait for them.
    """
    many = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p, (m, _) in ontology.predicates.items() for x in (p, m)]), F.col("predicate")), F.lit(False))
    same = ["subject", "predicate", "valid_at", "observed_at", "value", "action", "grade"]
    once = observed.groupBy(*same).agg(F.max("confirmed_at").alias("confirmed_at"))
    if apart:
        once = written(once, "zstd")
        whole, changing = runs.lasting(once, ["subject", "predicate"], many)
        once = written(once.join(changing, ["subject", "predicate"], "left_semi"), "zstd")
        return whole.unionByName(chains(once, ontology))
    return runs.runs(once.filter(~many), ["subject", "predicate"]).unionByName(runs.runs(once.filter(many), ["subject", "predicate"], many=True))


def _text(value: Column) -> Column:
    """The text that a JSON string says."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def assembled(rows: DataFrame, found: DataFrame, actions: DataFrame, ontology: Ontology) -> Store:
    """The tables of a store from facts, the runs of their chains, and the registers of their actions."""
    of = lambda what: rows.filter(F.col("what") == what)
    first = F.struct("observed_at", "action", "source", "type")
    seen = of("entity").groupBy("subject").agg(
        F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"), F.collect_set("type").alias("types"), F.min_by(F.struct("source", "source_id"), first).alias("s"), F.min_by("type", first).alias("type"),
    )
    seen = written(seen.select("subject", "keys", "types", "s.*", "type"), "zstd")
    # most subjects are an entity alone, which has their name: only the others are looked up
    moved = written(resolve(seen, "subject", "keys", once=True).filter("entity <> subject"), "zstd")

    def resolved(df: DataFrame, subject: str, name: str) -> DataFrame:
        return df.join(moved.select(F.col("subject").alias(subject), F.col("entity").alias("e__")), subject, "left").withColumn(name, F.coalesce("e__", subject)).drop("e__")

    sourced = resolved(seen, "subject", "entity").select("subject", "entity", "source", "source_id", "type").join(runs.identifiers(found, list(IDENTIFIERS)), "subject", "left")
    mine = F.max(F.array_contains("keys", ME)).alias("me")  # named by any record
    types = resolved(seen, "subject", "entity").groupBy("entity").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"), mine)

    link = F.when(F.col("value").startswith("@"), F.expr("substring(value, 2)"))
    linked = resolved(resolved(found, "subject", "entity").withColumn("t__", link), "t__", "object")
    properties = written(linked.withColumn("value", F.when(F.col("t__").isNull(), F.col("value"))).drop("t__"), "zstd")
    release(rows.sparkSession)

    of_urls = written(seen.filter("source = 'url'").select("subject", F.lit(True).alias("u__")), "zstd")
    is_name = properties.filter("predicate = 'name' and period_to is null").join(of_urls, "subject", "left")
    best = runs.elect(is_name, ["entity"], [F.asc(F.coalesce("u__", F.lit(False))), F.desc("last_valid"), F.desc("last_observed"), F.asc("value"), F.asc("subject")])
    entities = types.join(best.select("entity", _text(F.col("value")).alias("name")), "entity", "left").select("entity", "name", "types", "me")

    # dealt by what they are joined by
    edges = resolved(of("edge").select("action", F.col("predicate").alias("role"), F.col("target").alias("subject")), "subject", "entity").select("action", "role", "entity").repartition("action").distinct()
    metrics = resolved(of("metric").select("subject", "predicate", "action", "valid_at", "observed_at", "number").distinct(), "subject", "entity").drop("subject")
    literal = properties.filter("value is not null and period_to is null").select("entity", "value").distinct().groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("value")), " ").alias("text"))
    words = literal.select("entity", tokens(F.col("text")).alias("tokens"))

    stated = observations(rows).filter("value like '@%'").select("action", "subject", "predicate", F.expr("substring(value, 2)").alias("t__"))
    stated = resolved(resolved(stated, "t__", "object"), "subject", "of").select("action", "of", "predicate", "object").distinct()
    links = properties.filter("object is not null").select("entity", "predicate", "object").distinct()
    meetings = met.emitted(actions, edges, stated, links, ontology.encounters, ontology.propagating)
    return Store(sourced, entities, actions, edges, properties, metrics, words, meetings, specials(actions, edges, ontology), of("error").select("action", "predicate", "error"))


def specials(actions: DataFrame, edges: DataFrame, ontology: Ontology) -> DataFrame:
    """(entity, predicate, agent, period_from, period_to): states that one kind of action begins and another ends, for each object and agent; without an agent, null."""
    role = lambda r, name: edges.filter(F.col("role") == r).select("action", F.col("entity").alias(name))
    rows = actions.join(role("object", "entity"), "action").join(role("agent", "agent"), "action", "left").select("action", "type", "occurred_at", "entity", "agent")
    parts = [runs.toggled(rows, ["entity", "agent"], "type", "occurred_at", a, b, "action").withColumn("predicate", F.lit(name)) for name, (a, b) in ontology.special.items()]
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.select("entity", "predicate", "agent", "period_from", "period_to")


def fold(log: DataFrame, ontology: Ontology | None = None, **columns) -> Store:
    """All derived tables of a log. columns: the names of its body and asserted columns, if others; a `claim` and a `kind` are used where the log has them."""
    ontology, session = ontology or Ontology(), log.sparkSession
    seen = sightings(log, **columns)
    if "cid" not in log.columns:
        seen = seen.drop("cid")
    if "claim" not in log.columns:
        seen = seen.withColumn("claim", F.unhex(F.substring(F.sha2("claim", 256), 1, 32)))  # 128 bits tell claims apart; no table of a store names one
    rows = written(facts(claims(seen), ontology, named=False), "zstd")
    release(session)
    actions = written(registers(rows), "zstd")
    release(session)
    return assembled(rows, chains(sharpened(observations(rows), actions), ontology, apart=True), actions, ontology)
