"""Folding observations into validity runs, elections and registers. All are windows and aggregates, so the result does not depend on the order in which rows arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from yore.operators.near import as_of
from yore.sources.shared import written

#: Milliseconds of the bins that markers are ordered in.
WIDTH = 400 * 86_400_000


def runs(observed: DataFrame, chain: list[str], many: bool = False) -> DataFrame:
    """Validity runs of (chain, value): period_from, period_to, first and last valid_at, last_observed, n, grade.

    observed: the chain columns, valid_at, observed_at, value (null: a marker that the predicate was seen without one),
    action, grade. With `many`, each value has runs of its own and a marker ends all that it does not confirm;
    otherwise a marker or another value ends a run. A marker at a time at which the value is confirmed too has no effect.
    If there is a column confirmed_at, last_observed reaches to it: a confirm moves that and nothing else.
    A run's start is known if it is not the chain's first, its grade is 1, or it was observed later than it was valid,
    or a marker came before it; else period_from is null.
    """
    observed = observed if "confirmed_at" in observed.columns else observed.withColumn("confirmed_at", F.col("observed_at"))
    if many:
        return _of_values(observed, chain)
    order = ["valid_at", "observed_at", F.col("value").isNotNull(), "action", "value"]
    keys, rows = chain, observed
    by = W.Window.partitionBy(*keys).orderBy(*order)
    before = by.rowsBetween(W.Window.unboundedPreceding, -1)
    marker = F.col("value").isNull()
    at_time = W.Window.partitionBy(*keys, "valid_at")
    rows = rows.withColumn("last__", F.last("value", ignorenulls=True).over(before)).withColumn("said__", F.collect_set("value").over(at_time))
    rows = rows.withColumn("marked__", F.min(F.when(marker, F.col("valid_at"))).over(before)).withColumn("opened__", F.count("value").over(before))
    kept = rows.filter(~(marker & F.coalesce(F.array_contains("said__", F.col("last__")), F.lit(False))))
    kept = kept.withColumn("prior__", F.lag("value").over(by)).withColumn("start__", (~marker & ~F.coalesce(F.col("prior__") == F.col("value"), F.lit(False))).cast("int"))
    kept = kept.withColumn("run__", F.sum("start__").over(by.rowsBetween(W.Window.unboundedPreceding, 0)))
    kept = kept.withColumn("next__", F.lead(F.struct("valid_at", "value", "run__")).over(by))
    closes = F.when(F.col("next__").isNotNull() & (F.col("next__.value").isNull() | (F.col("next__.run__") != F.col("run__"))), F.col("next__.valid_at"))
    first = F.struct("valid_at", "observed_at", "action")
    folded = (
        kept.withColumn("closing__", closes)
        .filter("value is not null")
        .groupBy(*keys, "run__", "value")
        .agg(
            F.min(F.struct("valid_at", "observed_at", "action", "grade", "marked__", "opened__")).alias("f__"),
            F.max(first).alias("l__"), F.max(F.greatest("observed_at", "confirmed_at")).alias("last_observed"), F.min("closing__").alias("period_to"), F.count("*").alias("n"), F.max("grade").alias("grade"),
        )
    )
    known = (F.col("run__") > 1) | (F.col("f__.grade") == 1) | (F.col("f__.valid_at") != F.col("f__.observed_at")) | F.coalesce((F.col("f__.opened__") == 0) & (F.col("f__.marked__") < F.col("f__.valid_at")), F.lit(False))
    return folded.select(
        *chain, "value", F.when(known, F.col("f__.valid_at")).alias("period_from"), "period_to", F.col("f__.valid_at").alias("first_valid"), F.col("l__.valid_at").alias("last_valid"), "last_observed", "n", "grade",
    )


def _of_values(observed: DataFrame, chain: list[str]) -> DataFrame:
    """runs() where each value has runs of its own: one lasts until the first marker after a sighting and before the next one.

    Markers meet values as of their times, by an as-of join over the chain's distinct marker times, and not one by one.
    """
    markers = observed.filter("value is null").select(*chain, F.col("valid_at").alias("m__")).distinct()
    values = observed.filter("value is not null")
    asked = values.select(*chain, "valid_at").distinct().withColumn("at__", -F.col("valid_at") - 1)
    back = markers.select(*chain, (-F.col("m__")).alias("since__"), F.col("m__").alias("closing__"))
    after = as_of(asked, back, chain, "at__", "since__", ["closing__"], WIDTH).drop("at__")
    first = markers.groupBy(*chain).agg(F.min("m__").alias("marked__"))
    rows = values.join(after, [*chain, "valid_at"], "left").join(first, chain, "left")
    by = W.Window.partitionBy(*chain, "value").orderBy("valid_at", "observed_at", "action")
    starts = F.lag("valid_at").over(by).isNull() | F.coalesce(F.lag("closing__").over(by) < F.col("valid_at"), F.lit(False))
    rows = rows.withColumn("start__", starts.cast("int")).withColumn("run__", F.sum("start__").over(by.rowsBetween(W.Window.unboundedPreceding, 0)))
    folded = rows.groupBy(*chain, "value", "run__").agg(
        F.min(F.struct("valid_at", "observed_at", "action", "grade", "marked__")).alias("f__"), F.max(F.struct("valid_at", "observed_at", "action")).alias("l__"),
        F.max(F.greatest("observed_at", "confirmed_at")).alias("last_observed"), F.max_by("closing__", "valid_at").alias("period_to"), F.count("*").alias("n"), F.max("grade").alias("grade"),
    )
    known = (F.col("run__") > 1) | (F.col("f__.grade") == 1) | (F.col("f__.valid_at") != F.col("f__.observed_at")) | F.coalesce(F.col("f__.marked__") < F.col("f__.valid_at"), F.lit(False))
    return folded.select(
        *chain, "value", F.when(known, F.col("f__.valid_at")).alias("period_from"), "period_to", F.col("f__.valid_at").alias("first_valid"), F.col("l__.valid_at").alias("last_valid"), "last_observed", "n", "grade",
    )


def lasting(observed: DataFrame, chain: list[str], many: Column) -> tuple[DataFrame, DataFrame]:
    """(runs of the chains that nothing ends, the other chains' columns): a chain without a marker that has one value, or is of `many`, has one run for each value, as runs() would say, and takes no order, only sums. observed: as for runs(), with confirmed_at."""
    each = observed.groupBy(*chain, "value").agg(
        F.min(F.struct("valid_at", "observed_at", "action", "grade")).alias("f__"), F.max("valid_at").alias("last_valid"),
        F.max(F.greatest("observed_at", "confirmed_at")).alias("last_observed"), F.count("*").alias("n"), F.max("grade").alias("grade"),
    )
    each = written(each, "zstd")
    ended = F.max(F.col("value").isNull()) | ((F.count("*") > 1) & ~F.first(many))
    changing = written(each.groupBy(*chain).agg(ended.alias("e__")).filter("e__").select(*chain), "zstd")  # few are sent to the others, and these stay where they are
    known = (F.col("f__.grade") == 1) | (F.col("f__.valid_at") != F.col("f__.observed_at"))
    whole = each.join(changing, chain, "left_anti").select(
        *chain, "value", F.when(known, F.col("f__.valid_at")).alias("period_from"), F.lit(None).cast("long").alias("period_to"), F.col("f__.valid_at").alias("first_valid"), "last_valid", "last_observed", "n", "grade",
    )
    return whole, changing


def refolded(old: DataFrame, observed: DataFrame, touched: DataFrame, chain: list[str], many: bool = False) -> DataFrame:
    """All runs after a batch, of which only the chains that it touches are folded again; the others stay as they were. observed: all observations, the batch's too."""
    touched = touched.select(*chain).distinct()
    return old.join(touched, chain, "left_anti").unionByName(runs(observed.join(touched, chain, "left_semi"), chain, many))


def changes(old: DataFrame, new: DataFrame, chain: list[str]) -> DataFrame:
    """(chain, value, ordinal, change, and the new run's columns or, of a removed one, the old's): what differs between two folds. Runs of a value meet by their place in time; change is added, removed or changed."""
    rest = [c for c in new.columns if c not in (*chain, "value")]
    nth = F.row_number().over(W.Window.partitionBy(*chain, "value").orderBy("first_valid"))
    of = lambda df, name: df.select(*chain, "value", nth.alias("ordinal"), F.struct(*rest).alias(name))
    both = of(old, "o__").join(of(new, "n__"), [*chain, "value", "ordinal"], "full").filter(~F.col("o__").eqNullSafe(F.col("n__")))
    change = F.when(F.col("o__").isNull(), "added").when(F.col("n__").isNull(), "removed").otherwise("changed")
    return both.select(*chain, "value", "ordinal", change.alias("change"), F.coalesce("n__", "o__").alias("r__")).select(*chain, "value", "ordinal", "change", "r__.*")


def confirmed(rows: DataFrame, confirms: DataFrame, claim: str, asserted: str, first: str = "observed_at", last: str = "last_observed") -> DataFrame:
    """rows (with the claim that each came from) whose `last` reaches to the claim's latest confirm and whose `first` to its earliest sighting. Confirms move the observed axis alone; periods of validity stay."""
    seen = confirms.groupBy(claim).agg(F.min(asserted).alias("a__"), F.max(asserted).alias("z__"))
    moved = {first: F.least(first, "a__"), last: F.greatest(last, "z__")}
    return rows.join(seen, claim, "left").withColumns({c: v for c, v in moved.items() if c in rows.columns}).drop("a__", "z__")


def sharpened(found: DataFrame, actions: DataFrame, at: str = "period_from", action: str = "action") -> DataFrame:
    """Runs whose boundary takes the occurrence range that all sightings of their action agree on: its lower end where the register knows one. actions: registers() rows."""
    known = actions.filter("not conflict and earliest is not null").select(F.col(action), F.col("earliest").alias("e__"))
    return found.join(known, action, "left").withColumn(at, F.when(F.col(at).isNotNull(), F.coalesce("e__", at))).drop("e__")


def identifiers(found: DataFrame, names: list[str]) -> DataFrame:
    """(subject, one column for each predicate of names): each source record's current identifier: of its runs an open one first, then the higher grade, the last valid and observed, the least value. Null if the best run is closed."""
    rank = F.struct(F.col("period_to").isNotNull().alias("closed"), (-F.col("grade")).alias("grade"), (-F.col("last_valid")).alias("valid"), (-F.col("last_observed")).alias("observed"), "value")
    best = found.filter(F.col("predicate").isin(names)).groupBy("subject", "predicate").agg(F.min(rank).alias("b"))
    value = F.when(~F.col("b.closed"), F.col("b.value"))
    return best.groupBy("subject").pivot("predicate", names).agg(F.first(value))


def hoisted(observed: DataFrame, kinds: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(observations without lifecycle dates, actions that they stand for): a date predicate such as birthDate says when an action of its kind happened to the subject. Ranges of one action intersect, as in registers(). observed: subject, predicate, earliest, latest, observed_at."""
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    dated = observed.filter(F.col("predicate").isin(list(kinds))).withColumn("type", F.element_at(kind, F.col("predicate")))
    dated = dated.withColumns({"action": F.concat_ws(":", "type", "subject"), "end__": F.lit(None).cast("long")})
    found = registers(dated, ["action"], ["observed_at", "subject"], ["type", "subject", "observed_at"], "earliest", "latest", "end__").drop("end")
    return observed.filter(~F.col("predicate").isin(list(kinds))), found


def absences(observed: DataFrame, chain: list[str], source: str = "source") -> DataFrame:
    """Markers for what a source's snapshots stop saying: where a value is not in the next snapshot of its source, one of its chain at that time, which ends every run that this snapshot does not confirm.

    observed: full snapshots as observations, with their source; a snapshot is all that a source says at one valid_at, so
    one that says nothing at all must leave a row with a null value. The last snapshot of a source leaves all open.
    """
    at = observed.select(source, "valid_at", F.struct("observed_at", "action").alias("o__")).groupBy(source, "valid_at").agg(F.min("o__").alias("o__"))
    following = at.withColumn("next__", F.lead(F.struct(F.col("valid_at").alias("at"), F.col("o__"))).over(W.Window.partitionBy(source).orderBy("valid_at")))
    said = observed.filter("value is not null").select(source, *chain, "value", "valid_at").distinct()
    due = said.join(following.filter("next__ is not null").select(source, "valid_at", "next__"), [source, "valid_at"]).drop("valid_at").withColumn("valid_at", F.col("next__.at"))
    gone = due.join(said, [source, *chain, "value", "valid_at"], "left_anti").select(*chain, "valid_at", "next__").distinct()
    return gone.select(*chain, "valid_at", F.col("next__.o__.observed_at").alias("observed_at"), F.lit(None).cast("string").alias("value"), F.col("next__.o__.action").alias("action"), F.lit(0).alias("grade"))


def toggled(actions: DataFrame, chain: list[str], kind: str, at: str, opens: str, closes: str, tie: str) -> DataFrame:
    """(chain, period_from, period_to): from an opening action to the next closing one; openings of an open run extend it, closings without one do nothing."""
    by = W.Window.partitionBy(*chain).orderBy(at, tie)
    rows = actions.filter(F.col(kind).isin(opens, closes)).select(*chain, at, tie, (F.col(kind) == opens).alias("open__"))
    rows = rows.withColumn("was__", F.lag("open__").over(by)).filter(F.col("open__") != F.coalesce("was__", F.lit(False)))
    rows = rows.withColumn("period_to", F.lead(at).over(by))
    return rows.filter("open__").select(*chain, F.col(at).alias("period_from"), "period_to")


def elect(candidates: DataFrame, by: list[str], best: list[Column]) -> DataFrame:
    """The best row of each key; `best` orders them. A minimum over structs where the order allows it is cheaper; this is for mixed orders."""
    rank = F.row_number().over(W.Window.partitionBy(*by).orderBy(*best))
    return candidates.withColumn("rank__", rank).filter("rank__ = 1").drop("rank__")


def registers(sightings: DataFrame, key: list[str], founding: list[str], keep: list[str], lower: str, upper: str, end: str) -> DataFrame:
    """One row a key: the founding sighting's `keep` columns, the intersection of the sightings' ranges [lower, upper] (conflict if empty), and the latest end. Nulls say nothing."""
    return (
        sightings.groupBy(*key)
        .agg(F.min_by(F.struct(*keep), F.struct(*founding)).alias("k__"), F.max(lower).alias("earliest"), F.min(upper).alias("latest"), F.max(end).alias("end"), F.count("*").alias("sightings"))
        .select(*key, "k__.*", "earliest", "latest", "end", "sightings", F.coalesce(F.col("earliest") > F.col("latest"), F.lit(False)).alias("conflict"))
    )


def gate(batch: DataFrame, cid: str, claim: str, asserted: str) -> DataFrame:
    """What a log keeps of incoming assertions: of equal ids one, with kind assert for the first of a claim (by time, then id) and confirm for later ones."""
    once = batch.dropDuplicates([cid])
    first = once.groupBy(claim).agg(F.min(F.struct(asserted, cid)).alias("f__"))
    return once.join(first, claim).withColumn("kind", F.when(F.col(cid) == F.col(f"f__.{cid}"), "assert").otherwise("confirm")).drop("f__")


def spread(events: DataFrame, edges: DataFrame) -> DataFrame:
    """Encounters of what an encountered subject is linked to, one hop. events: event, who, subject, at; edges: subject, target, via. One row an event and target, by the least subject."""
    far = events.join(edges, "subject").groupBy("event", "who", "at", "target").agg(F.min("subject").alias("through"))
    return far.select("event", "who", F.col("target").alias("subject"), "at", "through")


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest `order` columns."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r__")).select(*key, "r__.*")
