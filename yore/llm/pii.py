"""Personal data: base patterns, and identifiers found by the contexts that known ones stand in.

Base matches are exact. Bootstrapping starts from them and from long hexadecimal strings (kind secret) as seeds. Tokens
that look like identifiers are candidates; the one, two and three lexical units before a candidate (a run of letters or
one mark each) are its patterns. Over the graph of patterns and instances (the candidates' strings), with the number of
times they meet, a pattern's score for a kind is the share of its meetings with instances of that kind, an instance's
score that of its best supported pattern; seeds keep theirs. After ROUNDS rounds, patterns with at least SUPPORT
distinct instances and CONFIDENCE are trusted, and candidates in their context which are no base match are new spans.

One pass over the texts reduces each to its base spans and candidates; only these move. Counts are aggregated before
each shuffle, and the joins are plain equi-joins that adaptive execution can split. Null texts are empty, rows that
repeat get the same spans, ties go to the kind first in KINDS, an empty table gives an empty table. Very long texts and
texts of very many matches are read whole, in a time that grows little faster than their length. Columns of any other
name are kept by redact() and not read by spans().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.llm.common import cut, let, row_key, running, table

KINDS = ("email", "ip", "card", "phone", "secret")
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.7
#: Characters of the pieces that a text is cut into before spans are taken out of it.
CHUNK = 1024

#: Base patterns. Possessive forms and look-behinds of what the plain forms match: a run is scanned from its start once.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Candidates: five or more letters, digits and joining marks with a digit among them. Marks that end a run are no part of it, as in "is AB12345."; the last look-behind tests the length.
CANDIDATE = r"(?<![A-Za-z0-9+/_.@-])(?=[A-Za-z+/_.@-]*+[0-9])[A-Za-z0-9+][A-Za-z0-9+_]*+(?:[/.@-]++[A-Za-z0-9+_]++)*+(?<=[A-Za-z0-9+/_.@-]{5})"
SECRET = r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"
SPAN = "array<struct<start:bigint,end:bigint,value:string,left:string>>"
#: The first three units (and white space) of a text that is read backwards.
UNITS = r"^\s*+(?:(?:\p{L}++|[^\p{L}\s])\s*+){0,3}"


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """array<struct<start, end, value, left>> of the pattern's matches: code points, end exclusive, and with context the three units before.

    A match of a candidate holds two units at least, so the two matches before with what is between hold three, however
    far back they reach. Positions are running sums of lengths, so that texts with very many matches take little longer.
    """

    def walk(found: Column) -> Column:
        def told(pieces: Column, before: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                at = lambda xs, j: F.coalesce(F.get(xs, j), F.lit(""))
                back = F.reverse(F.concat(at(found, i - 2), at(pieces, i - 1), at(found, i - 1), at(pieces, i)))
                left = F.reverse(F.regexp_extract(back, UNITS, 0)) if context else F.lit("")
                begin = F.get(before, i) + F.length(at(pieces, i))
                return F.struct(begin.alias("start"), (begin + F.length(x)).alias("end"), x.alias("value"), left.alias("left"))

            return F.transform(found, span)

        def steps(pieces: Column) -> Column:
            sizes = F.transform(found, lambda x, i: (F.length(F.get(pieces, i)) + F.length(x)).cast("long"))
            return let(running(sizes, lambda a, b: a + b, F.lit(0).cast("long")), lambda before: told(pieces, before))

        return let(F.split(text, pattern), steps)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, walk(found)).otherwise(F.array().cast(SPAN)))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    value = lambda d, i: let(d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> spans that pass the kind's check."""
    none = F.array().cast(SPAN)
    length = lambda x: F.length(_digits(x))
    with_digit = text.rlike("[0-9]")
    return {
        "email": F.when(F.contains(text, F.lit("@")), matches(text, EMAIL)).otherwise(none),
        "ip": F.when(with_digit, F.filter(matches(text, IP), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))).otherwise(none),
        "card": F.when(with_digit, F.filter(matches(text, CARD), lambda s: F.when(length(s["value"]).between(13, 19), _luhn(_digits(s["value"]))).otherwise(False))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(matches(text, PHONE), lambda s: length(s["value"]).between(9, 15))).otherwise(none),
    }


def _patterns(left: Column) -> Column:
    """The last one, two and three units, joined by spaces."""
    units = F.regexp_extract_all(F.lower(left), F.lit(r"\p{L}+|[^\p{L}\s]"), F.lit(0))
    return let(units, lambda u: F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: n <= F.size(u)), lambda n: F.array_join(F.slice(u, F.size(u) - n + 1, n), " ")))


def reduced(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key() columns, base (array of kind, start, end in the order of KINDS and start) and candidates (start, end, value, kind of seed or null, patterns) of every row."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(*row_key(key, text), t.alias("t__"))
    spans = [F.transform(s, _named(i)) for i, s in enumerate(base_spans(F.col("t__")).values())]
    tokens = F.when(F.col("t__").rlike("[0-9]"), matches(F.col("t__"), CANDIDATE, True)).otherwise(F.array().cast(SPAN))
    found = found.withColumn("by_kind", F.array(*spans)).withColumn("base", F.flatten("by_kind")).withColumn("tokens", tokens).drop("t__")

    def candidate(c: Column, over: Column) -> Column:
        kind = F.coalesce(over, F.when(c["value"].rlike(SECRET), len(KINDS) - 1))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), kind.alias("kind"), over.isNotNull().alias("known"), _patterns(c["left"]).alias("patterns"))

    def with_base(over: Column) -> Column:
        return F.transform("tokens", lambda c, i: candidate(c, F.get(over, i)))

    alone = F.transform("tokens", lambda c: candidate(c, F.lit(None).cast("int")))
    both = (F.size("base") > 0) & (F.size("tokens") > 0)
    return found.withColumn("candidates", F.when(both, let(_met(F.col("tokens"), F.col("by_kind")), with_base)).otherwise(alone)).drop("tokens", "by_kind")


def _met(tokens: Column, by_kind: Column) -> Column:
    """For each token the first kind of which a span overlaps it, or null. Spans of one kind are apart and in order, so only the last one that starts by the token's start and the next one can.

    How many spans of each kind start by then is a running count over all starts in order.
    """
    kinds = range(len(KINDS) - 1)
    starts = [F.transform(F.get(by_kind, F.lit(k)), lambda s: F.struct(s["start"].alias("at"), s["kind"].alias("kind"))) for k in kinds]
    events = F.array_sort(F.concat(*starts, F.transform(tokens, lambda s: F.struct(s["start"].alias("at"), F.lit(len(KINDS)).alias("kind")))))
    add = lambda a, x: F.struct(*[(a[f"n{k}"] + x[f"n{k}"]).alias(f"n{k}") for k in kinds])
    none = F.struct(*[F.lit(0).alias(f"n{k}") for k in kinds])

    def counted(es: Column) -> Column:
        ones = F.transform(es, lambda e: F.struct(*[(e["kind"] == k).cast("int").alias(f"n{k}") for k in kinds]))
        by_event = lambda before: F.transform(es, lambda e, i: F.struct(e["kind"].alias("kind"), F.get(before, i).alias("n")))
        return F.transform(F.filter(let(running(ones, add, none), by_event), lambda e: e["kind"] == len(KINDS)), lambda e: e["n"])

    def kind_of(c: Column, n: Column) -> Column:
        over = lambda k: (F.get(F.get(by_kind, F.lit(k)), n[f"n{k}"] - 1)["end"] > c["start"]) | (F.get(F.get(by_kind, F.lit(k)), n[f"n{k}"])["start"] < c["end"])
        return F.coalesce(*[F.when(over(k), F.lit(k)) for k in kinds])

    return let(let(events, counted), lambda ns: F.transform(tokens, lambda c, i: kind_of(c, F.get(ns, i))))


def _named(i: int):
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def learn(small: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(pattern, kind) that are trusted, from reduced() rows."""
    each = small.select(F.explode("candidates").alias("c")).select("c.value", "c.kind", F.explode("c.patterns").alias("pattern"))
    edges = cut(each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.min("kind").alias("kind")))
    # steps of their own, so that the joins can split a pattern or an instance that meets very many
    seeds = cut(edges.groupBy("value").agg(F.min("kind").alias("seed")))
    enough = cut(edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("met")).filter(F.col("instances") >= support))
    graph = cut(edges.drop("kind").join(enough, "pattern").join(seeds, "value"))
    scores = graph.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    for i in range(rounds):
        met = graph.join(scores, "value").groupBy("pattern", "kind", "met").agg(F.sum(F.col("n") * F.col("score")).alias("sum"))
        patterns = met.select("pattern", "kind", (F.col("sum") / (F.col("met") + 1)).alias("score"))
        if i < rounds - 1:
            spread = graph.filter("seed is null").join(patterns, "pattern").groupBy("value", "kind").agg(F.max("score").alias("score"))
            scores = cut(graph.filter("seed is not null").select("value", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct().union(spread))
    best = patterns.filter(F.col("score") >= confidence).groupBy("pattern").agg(F.min_by("kind", F.struct(-F.col("score"), F.col("kind"))).alias("kind"))
    return best


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """row_key() columns, base and found (both arrays of kind, start, end) of every row of docs; repeated rows are repeated."""
    small = cut(reduced(docs, key, text))
    trusted = learn(small, **how)
    fresh = small.select("k_id", "k_a", "k_b", F.explode("candidates").alias("c")).filter("not c.known").select("k_id", "k_a", "k_b", "c.start", "c.end", F.explode("c.patterns").alias("pattern"))
    met = fresh.join(trusted, "pattern").groupBy("k_id", "k_a", "k_b", "start", "end").agg(F.min("kind").alias("kind"))
    by_row = met.groupBy("k_id", "k_a", "k_b").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("found"))
    left = small.select("k_id", "k_a", "k_b", "base")
    joined = left.join(by_row, left.k_id.eqNullSafe(by_row.k_id) & (left.k_a == by_row.k_a) & (left.k_b == by_row.k_b), "left")
    return joined.select(left.k_id, left.k_a, left.k_b, "base", F.coalesce("found", F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")).alias("found"))


def _said(spans: Column, names: tuple[str, ...]) -> Column:
    kinds = F.array(*map(F.lit, names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with every span in the text replaced by its kind in capitals and angle brackets; overlapping spans become one, of the first's kind. Null texts stay null."""
    by_row = spans(docs, key, text, **how).withColumn("spans", F.concat("base", "found")).filter(F.size("spans") > 0).select("k_id", "k_a", "k_b", "spans").distinct()
    left = docs.select(F.struct(*docs.columns).alias("row"), *row_key(key, text))
    joined = left.join(by_row, left.k_id.eqNullSafe(by_row.k_id) & (left.k_a == by_row.k_a) & (left.k_b == by_row.k_b), "left")
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    told = F.col("row")[text]

    def cut_out(chunks: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, from the chunks of CHUNK that hold them; a substring of the whole text would read it from its start for each span."""
        first = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice(chunks, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substring(held, (a - first * CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def rebuilt(chunks: Column, all_spans: Column, before: Column) -> Column:
        # before: the furthest end of the spans before each
        told_one = lambda s, i: F.when(s["start"] >= F.get(before, i), F.concat(cut_out(chunks, F.get(before, i), s["start"]), F.get(kinds, s["kind"]))).otherwise("")
        tail = cut_out(chunks, F.element_at(before, -1), F.length(told).cast("long"))
        return F.concat(F.array_join(F.transform(all_spans, told_one), ""), tail)

    chunks = F.regexp_extract_all(told, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    ends = lambda xs: running(F.transform(xs, lambda s: s["end"]), lambda a, b: F.greatest(a, b), F.lit(0).cast("long"))
    new = let(chunks, lambda c: let(ordered, lambda xs: let(ends(xs), lambda before: rebuilt(c, xs, before))))
    return joined.select(*[F.when(F.col("spans").isNull(), told).otherwise(new).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op7_pii(spark, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    everything = F.array_sort(F.concat("base", "found"))
    return found.select(
        F.col("k_id").alias("doc_id"), *[count(k) for k in KINDS[:4]], F.sha2(_said(F.col("base"), KINDS), 256).alias("base_sha256"), _said(everything, KINDS).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
