"""The fold: the gate, runs, elections, registers, encounters."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.functions import texts
from yore.operators import intervals, runs
from yore.plans.base import ACTIONS_SQL, DAY, actions, ms, query, table
from yore.sources.shared import dealt

_OBS = f"{ACTIONS_SQL}, obs AS (SELECT agent AS subject, t AS valid_at, t AS observed_at, CASE WHEN type <> 'error' THEN type END AS value, id AS action FROM actions)"


def observed(spark, d):
    """Events as observations: the value is the type, an error a marker."""
    return actions(spark, d).select(F.col("agent").alias("subject"), F.col("t").alias("valid_at"), F.col("t").alias("observed_at"), F.when(F.col("type") != "error", F.col("type")).alias("value"), F.col("id").alias("action"), F.lit(0).alias("grade"))


_SINGLE = f"""WITH {_OBS},
k AS (SELECT *, lag(value) OVER w AS prior, min(CASE WHEN value IS NULL THEN valid_at END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS marked, count(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened FROM obs WINDOW w AS (PARTITION BY subject ORDER BY valid_at, observed_at, value IS NOT NULL, action, value)),
r AS (SELECT *, sum(CASE WHEN value IS NOT NULL AND NOT coalesce(prior = value, false) THEN 1 ELSE 0 END) OVER w AS run, lead(valid_at) OVER w AS next_at, lead(value) OVER w AS next_value FROM k WINDOW w AS (PARTITION BY subject ORDER BY valid_at, observed_at, value IS NOT NULL, action, value)),
g AS (SELECT subject, run, any_value(value) AS value, min(valid_at) AS first_valid, max(valid_at) AS last_valid, max(observed_at) AS last_observed, count(*) AS n, arg_min(marked, action) AS marked, arg_min(opened, action) AS opened,
  min(CASE WHEN next_at IS NOT NULL AND NOT coalesce(next_value = value, false) THEN next_at END) AS period_to FROM r WHERE value IS NOT NULL GROUP BY subject, run)"""


SINGLE_RUNS = _SINGLE
ORACLE_OF_RUNS = _SINGLE + " SELECT subject, value, CASE WHEN run > 1 OR coalesce(opened = 0 AND marked < first_valid, false) THEN first_valid END AS period_from, period_to, first_valid, last_valid, n FROM g"


@query("runs_single", ORACLE_OF_RUNS)
def runs_single(spark, d):
    return runs.runs(observed(spark, d), ["subject"]).select("subject", "value", "period_from", "period_to", "first_valid", "last_valid", "n")


_MANY = f"""WITH {_OBS}, c AS (SELECT DISTINCT subject, value AS of FROM obs WHERE value IS NOT NULL),
a AS (SELECT *, value AS of FROM obs WHERE value IS NOT NULL UNION ALL SELECT obs.*, of FROM obs JOIN c USING (subject) WHERE value IS NULL),
k AS (SELECT *, lag(value) OVER w AS prior, lead(valid_at) OVER w AS next_at, lead(value) OVER w AS next_value FROM a WINDOW w AS (PARTITION BY subject, of ORDER BY valid_at, observed_at, value IS NOT NULL, action, value)),
r AS (SELECT *, sum(CASE WHEN value IS NOT NULL AND prior IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject, of ORDER BY valid_at, observed_at, value IS NOT NULL, action, value) AS run FROM k)
SELECT subject, of AS value, min(valid_at) AS first_valid, max(valid_at) AS last_valid, min(CASE WHEN next_at IS NOT NULL AND next_value IS NULL THEN next_at END) AS period_to, count(*) AS n FROM r WHERE value IS NOT NULL GROUP BY subject, of, run"""


ORACLE_OF_MANY = _MANY


@query("runs_many", _MANY)
def runs_many(spark, d):
    return runs.runs(observed(spark, d), ["subject"], many=True).select("subject", "value", "first_valid", "last_valid", "period_to", "n")


def _scope(name: str, scope: str, sql: str, lo: int | None = None, hi: int | None = None):
    @query(name, _SINGLE + f", p AS (SELECT subject, value, CASE WHEN run > 1 OR coalesce(opened = 0 AND marked < first_valid, false) THEN first_valid END AS f, period_to AS u, first_valid AS seen FROM g) SELECT subject, value, f AS period_from, u AS period_to FROM p WHERE {sql}")
    def scoped(spark, d):
        found = runs.runs(observed(spark, d), ["subject"])
        test = intervals.valid(F.col("period_from"), F.col("period_to"), scope, lo, hi, F.col("first_valid"))
        return found.filter(test).select("subject", "value", "period_from", "period_to")


_A, _B = ms(2024, 1, 10), ms(2024, 1, 12)
_scope("scope_current", "current", "u IS NULL")
_scope("scope_past", "past", "u IS NOT NULL")
_scope("scope_at", "at", f"(f IS NULL OR f <= {_A}) AND (u IS NULL OR u > {_A})", _A)
_scope("scope_during", "during", f"(f IS NULL OR f <= {_B}) AND (u IS NULL OR u > {_A})", _A, _B)
_scope("scope_throughout", "throughout", f"(f IS NULL OR f <= {_A}) AND (u IS NULL OR u > {_A + DAY // 24})", _A, _A + DAY // 24)
_scope("scope_asof", "asof", f"seen <= {_A}", _A)
_scope("scope_before", "before", f"coalesce(u <= {_A}, false)", _A)
_scope("scope_after", "after", f"coalesce(f >= {_A}, false)", _A)


@query("special_run", f"WITH {ACTIONS_SQL} SELECT agent AS subject, t AS period_from, u AS period_to FROM (SELECT agent, t, open, lead(t) OVER (PARTITION BY agent ORDER BY t, id) AS u FROM (SELECT *, lag(open, 1, false) OVER (PARTITION BY agent ORDER BY t, id) AS was FROM (SELECT agent, t, id, type = 'signup' AS open FROM actions WHERE type IN ('signup', 'error'))) WHERE open <> was) WHERE open")
def special_run(spark, d):
    return runs.toggled(actions(spark, d).withColumnRenamed("agent", "subject"), ["subject"], "type", "t", "signup", "error", "id")


@query("elect_winner", "SELECT source, doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (lang = 'en') DESC, n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def elect_winner(spark, d):
    return runs.elect(table(spark, d, "documents").select("source", "doc_id", "lang", "n_chars"), ["source"], [F.desc(F.col("lang") == "en"), F.desc("n_chars"), F.asc("doc_id")]).select("source", "doc_id", "lang")


@query("dedupe_latest", f"WITH {ACTIONS_SQL} SELECT agent, type, id, t FROM (SELECT *, row_number() OVER (PARTITION BY agent, type ORDER BY t DESC, id DESC) AS r FROM actions) WHERE r = 1")
def dedupe_latest(spark, d):
    return runs.latest(actions(spark, d).select("agent", "type", "id", "t"), ["agent", "type"], ["t", "id"])


@query("action_registers", "WITH s AS (SELECT l_orderkey AS key, l_linenumber AS n, l_partkey AS part, l_suppkey AS supp, l_extendedprice AS price, (epoch_us(l_shipdate) // 1000) AS lo, (epoch_us(l_shipdate) // 1000) + 34560000000 AS hi FROM lineitem) SELECT key, arg_min(part, (n, part, supp, price)) AS part, max(lo) AS earliest, min(hi) AS latest, count(*) AS sightings, max(lo) > min(hi) AS conflict FROM s GROUP BY key")
def action_registers(spark, d):
    lo = intervals.millis("l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_extendedprice").alias("price"), lo.alias("lo"), (lo + 400 * DAY).alias("hi"))
    return runs.registers(rows, ["key"], ["n", "part", "supp", "price"], ["part"], "lo", "hi", "lo").select("key", "part", "earliest", "latest", "sightings", "conflict")


@query("ingest_gate", "WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS cid, md5(text) AS claim, doc_id AS n FROM documents) SELECT cid, claim, CASE WHEN n = min(n) OVER (PARTITION BY claim) THEN 'assert' ELSE 'confirm' END AS kind FROM b")
def ingest_gate(spark, d):
    batch = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("cid"), F.md5("text").alias("claim"), F.col("doc_id").alias("at"))
    return runs.gate(batch, "cid", "claim", "at").select("cid", "claim", "kind")


@query("encounters_transitive", "SELECT o_orderkey AS event, o_custkey AS who, (epoch_us(o_orderdate) // 1000) AS at, s_nationkey AS subject, min(l_suppkey) AS through FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def encounters_transitive(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("who"), intervals.millis("o_orderdate").alias("at"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("subject"))
    rows = lines.count()  # from the files' footers
    met = dealt(orders, rows, "event").join(dealt(lines, rows, "event"), "event")
    edges = table(spark, d, "supplier").select(F.col("s_suppkey").alias("subject"), F.col("s_nationkey").alias("target"))
    return runs.spread(met, edges).select("event", "who", "at", "subject", "through")


@query("fts_tiers", "SELECT n_nationkey AS id, lower(n_name) AS name, coalesce(string_agg(c_name, ' ' ORDER BY c_custkey), '') AS associations FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 5000 GROUP BY 1, 2")
def fts_tiers(spark, d):
    rich = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("l"))
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"))
    return nation.join(rich, "id", "left").select("id", "name", F.coalesce(F.array_join(F.transform("l", lambda x: x["c_name"]), " "), F.lit("")).alias("associations"))


@query("content_groups", "SELECT claim, count(*) AS n, min(doc_id) AS first FROM (SELECT md5(text) AS claim, doc_id FROM documents) GROUP BY 1 HAVING count(*) > 1")
def content_groups(spark, d):
    return table(spark, d, "documents").groupBy(F.md5("text").alias("claim")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1")


@query("tokens_index", r"SELECT word, count(*) AS docs FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ', 'aaaaaaceeeeiiiinoooooouuuuyy'), '[^\p{L}\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) >= 100")
def tokens_index(spark, d):
    each = table(spark, d, "documents").select(F.explode(F.array_distinct(texts.tokens(F.col("text")))).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("docs")).filter("docs >= 100")


def payloads(spark, d):
    """Events as JSON payloads: an action of the event's type by a user, whose last value is a metric."""
    user = F.struct(F.lit("Person").alias("@type"), F.array(F.lit("source"), F.lit("sourceId")).alias("@key"), F.lit("events").alias("source"), F.col("agent").cast("string").alias("sourceId"), F.concat(F.lit("User "), F.col("agent")).alias("name"), F.col("value").alias("weight"))
    body = F.struct(F.concat(F.initcap("type"), F.lit("Action")).alias("@type"), F.array(F.lit("source"), F.lit("sourceId")).alias("@key"), F.lit("events").alias("source"), F.col("id").cast("string").alias("sourceId"), F.date_format(F.timestamp_millis("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"), user.alias("agent"))
    return actions(spark, d).select(F.to_json(body).alias("body"), F.lit(1_800_000_000_000).alias("asserted_at"))


@query("fold_payloads", f"WITH {ACTIONS_SQL} SELECT 'User ' || agent AS name, count(*) AS acts, min(t) AS first, arg_max(value, (t, value)) AS latest FROM actions GROUP BY 1")
def fold_payloads(spark, d):
    from yore.plans.store import fold

    s = fold(payloads(spark, d))
    acts = s.edges.filter("role = 'agent'").join(s.actions, "action").groupBy("entity").agg(F.count("*").alias("acts"), F.min("occurred_at").alias("first"))
    last = s.metrics.groupBy("entity").agg(F.max_by("number", F.struct("valid_at", "number")).alias("latest"))
    return s.entities.join(acts, "entity").join(last, "entity").select("name", "acts", "first", "latest")
