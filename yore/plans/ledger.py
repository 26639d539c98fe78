"""The incremental fold: a store that takes the log in batches and folds again only what a batch touches.

What a batch touches is found by key, bucket by bucket: its claims; the actions that these are sightings of; the
subjects that they say something of, or that are anchored at an action whose date has become finer. Only those buckets
are read and written (see sources.buckets), whatever has gathered before. To the log, the facts and the anchors a batch
only adds: a fact stays as it was first told, and when its claim was seen first and last is what the log says. The result does not depend on how the log is
cut into batches nor on their order: it equals plans.store.fold of the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from yore.operators import runs
from yore.operators.shred import COLUMNS, Ontology
from yore.plans import store
from yore.sources.buckets import Buckets
from yore.sources.shared import written

_FACTS = ", ".join(f"`{c}` {t}" for c, t in (COLUMNS | {"claim": "string", "last_seen": "long"}).items())
_RUNS = "subject string, predicate string, value string, period_from long, period_to long, first_valid long, last_valid long, last_observed long, n long, grade int"
SCHEMAS = {
    "log": ("cid string, claim string, kind string, seen_at long, body string", "claim"),
    "facts": (_FACTS, "claim"),  # as first told
    "sighted": (_FACTS, "action"),  # the facts on actions
    "anchors": ("action string, subject string", "action"),  # whose observations are placed at an action
    "observed": ("subject string, predicate string, valid_at long, observed_at long, confirmed_at long, value string, action string, grade int, start long, claim string, earliest long", "subject"),
    "runs": (_RUNS, "subject"),
    "trace": ("batch long, step string, source string, n long", "batch"),
}


def _moved(rows: DataFrame, bounds: DataFrame, last: str) -> DataFrame:
    """Rows of claims whose first or last sighting is another now; what was placed at the first sighting moves with it."""
    b = bounds.select("claim", F.col("first_seen").alias("a__"), F.col("last_seen").alias("z__"))
    at = lambda c: F.when(F.col("a__").isNotNull() & F.col("start").isNull(), F.col("a__")).otherwise(F.col(c))
    new = {"observed_at": F.coalesce("a__", "observed_at"), last: F.coalesce("z__", last), "valid_at": at("valid_at")}
    if "latest" in rows.columns:
        new["latest"] = F.when(F.col("what") == "action", at("latest")).otherwise(F.col("latest"))
    return rows.join(b, "claim", "left").withColumns(new).drop("a__", "z__")


class Ledger:
    """A store under a path that every executor shares. buckets counts for a new one; later it is as the path says."""

    def __init__(self, session: SparkSession, path: str, ontology: Ontology | None = None, buckets: int = 64):
        self.session, self.ontology = session, ontology or Ontology()
        self.tables = Buckets(session, path, SCHEMAS, buckets)

    def append(self, batch: DataFrame, **columns) -> DataFrame | None:
        """Take a batch of the log; what the log has already is left out. The difference that it makes to the runs (see runs.changes), or None if nothing is new."""
        t = self.tables
        seen = written(store.sightings(batch, **columns))
        before = t.read("log", t.touched(seen, "claim")).select("cid", "claim", "kind", "seen_at", F.when(F.col("body").isNotNull(), "").alias("body"))
        fresh, of_claims = t.add("log", seen.dropDuplicates(["claim", "cid"]).join(before, ["claim", "cid"], "left_anti"))
        if not of_claims:
            return None
        # the claims of the batch as they were and as they are, as store.claims() says; a body is read only from the batch
        rows = before.withColumn("old__", F.lit(True)).unionByName(fresh.withColumn("old__", F.lit(False)))
        old = F.col("old__")

        def bounds(where, first, last):
            kind = lambda name: F.max(F.when(where, F.col("kind") == name))
            a, z = F.min(F.when(where, F.col("seen_at"))), F.max(F.when(where, F.col("seen_at")))
            return a.alias(first), F.when(kind("restated") & ~kind("assert"), a).otherwise(z).alias(last)

        had = F.max(old & F.col("body").isNotNull()).alias("had")
        now = rows.groupBy("claim").agg(F.min(old).alias("o__"), had, *bounds(F.lit(True), "first_seen", "last_seen"), *bounds(old, "f__", "l__"), F.min(F.when(~old, F.col("body"))).alias("new_body"))
        now = written(now.filter("not o__").withColumn("new_body", F.when(~F.col("had"), F.col("new_body"))))
        moved = now.filter("had and (first_seen <> f__ or last_seen <> l__)").select("claim", "first_seen", "last_seen")
        claimed = t.dealt(now.filter("not had").select("claim", F.col("new_body").alias("body"), "first_seen", "last_seen"), "claim")
        told, _ = t.add("facts", store.facts(claimed, self.ontology), dealt=True)  # dealt before they are many
        new = told.filter("what = 'observation'")
        # of the facts that were there, what is placed at another time now
        hit = t.read("facts", of_claims).filter("what in ('action', 'observation')").select("claim", "what", "action", "subject")
        hit = written(hit.join(moved, "claim", "left_semi").select("what", "action", "subject").distinct())

        # actions: their sightings, and where all of them together now say that they happened
        acts = written(told.filter("what = 'action'").select("action").union(hit.filter("what = 'action'").select("action")).distinct())
        of_actions = t.touched(acts, "action")
        sighted = t.read("sighted", of_actions)
        at_hand = t.stage("sighted", _moved(sighted, moved, "last_seen").unionByName(told.filter("what = 'action'")), of_actions)
        anchors = t.read("anchors", of_actions)
        # an observation's own action is among its claim's, so new anchors fall into the buckets at hand
        t.add("anchors", new.filter("start is not null").select("action", "subject").distinct())
        earliest = lambda rows: store.registers(rows.join(acts, "action", "left_semi")).select("action", F.when(~F.col("conflict"), F.col("earliest")).alias("earliest"))
        finer = written(earliest(at_hand).join(earliest(sighted).withColumnRenamed("earliest", "w__").withColumn("k__", F.lit(True)), "action", "left"))
        sharper = finer.filter("k__ and not (earliest <=> w__)").select("action", "earliest")

        # subjects: what is said of them, and the runs of that
        subjects = written(new.select("subject").union(hit.filter("what = 'observation'").select("subject")).union(anchors.join(sharper, "action", "left_semi").select("subject")).distinct())
        of_subjects = t.touched(subjects, "subject")
        observed = _moved(t.read("observed", of_subjects), moved, "confirmed_at")
        if not sharper.isEmpty():  # else nothing moves
            observed = observed.join(sharper.select("action", F.col("earliest").alias("e__"), F.lit(True).alias("s__")), "action", "left").withColumn("earliest", F.when(F.col("s__"), F.col("e__")).otherwise(F.col("earliest"))).drop("e__", "s__")
        fresh_observed = store.observations(told).join(finer.select("action", "earliest"), "action", "left")
        whole = t.stage("observed", observed.unionByName(fresh_observed), of_subjects)
        placed = whole.join(subjects, "subject", "left_semi").withColumn("valid_at", F.when(F.col("start").isNotNull(), F.coalesce("earliest", "valid_at")).otherwise(F.col("valid_at"))).drop("earliest")
        folded = written(store.chains(placed, self.ontology))
        stood = t.read("runs", of_subjects)
        t.stage("runs", stood.join(subjects, "subject", "left_anti").unionByName(folded.select(*stood.columns)), of_subjects)
        difference = written(runs.changes(stood.join(subjects, "subject", "left_semi"), folded.select(*stood.columns), ["subject", "predicate"]))

        self._trace(fresh, told, difference)
        t.commit()
        return difference

    def _trace(self, fresh: DataFrame, new: DataFrame, difference: DataFrame) -> None:
        """Count what the batch did, step by step and source by source."""
        batch = F.lit(self.tables.batch + 1).cast("long").alias("batch")
        of = lambda rows, step, source: rows.groupBy(step.alias("step"), source.cast("string").alias("source")).agg(F.count("*").alias("n"))
        source = F.get_json_object("body", "$.source")
        subject = new.filter("what = 'entity'").groupBy("subject").agg(F.min("source").alias("source"))
        runs_of = difference.join(subject, "subject", "left")
        ended = F.when(F.col("change") == "added", "run added").when(F.col("change") == "removed", "run removed").otherwise("run changed")
        rows = of(fresh, F.concat(F.lit("log "), "kind"), source).unionByName(of(new, F.concat(F.lit("fact "), "what"), F.col("source"))).unionByName(of(runs_of, ended, F.col("source")))
        rows = rows.unionByName(of(runs_of.filter("change <> 'removed' and period_to is not null"), F.lit("run closed"), F.col("source")))
        rows = written(rows.select(batch, "step", "source", "n"))
        at = self.tables.touched(rows, "batch")
        self.tables.stage("trace", self.tables.read("trace", at).unionByName(rows), at)

    def trace(self) -> DataFrame:
        """(batch, step, source, n): of each batch the new rows of the log by kind, the facts by what they are (errors are what was rejected), and the runs added, changed, removed, and closed."""
        return self.tables.read("trace")

    def runs(self) -> DataFrame:
        """The runs of all chains."""
        return self.tables.read("runs")

    def store(self) -> store.Store:
        """All derived tables as they are now."""
        t = self.tables
        actions = written(store.registers(t.read("sighted")))
        seen = store.claims(t.read("log").withColumn("body", F.when(F.col("body").isNotNull(), "")))
        facts = written(_moved(t.read("facts"), seen, "last_seen"))
        return store.assembled(facts, t.read("runs"), actions, self.ontology)

    def follow(self, stream: DataFrame, checkpoint: str, **columns) -> StreamingQuery:
        """Take a stream of assertions, a batch at a time, until what is there is read. A micro-batch that is tried again changes nothing."""

        def take(batch: DataFrame, _: int) -> None:
            self.append(batch, **columns)

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
