"""Mixing sources to target weights by systematic sampling.

Every source has a weight; its target is its share of all words, but at most CAP times its own words, what is beyond
going to the other sources by weight. A document's expected copies are its source's target over the source's words.
They are added up over the source's documents in the order of size, and with one random offset added, a document is
taken once for each whole number that the sum passes at it. So it is taken the expected number of times, rounded up or
down, and since like sizes stand together, a source's taken words miss its target by less than its longest document.

Expected copies are counted in units of 2^-28, so sums are exact and no document exceeds CAP copies. Documents are
ranked by a range partitioning of (source, size, key), which parts a source of any size, written once; only counts per
range and source are summed over. The offset follows from the seed, so runs agree.

Words in null and empty texts: none; such a document adds to no target but is ranked and may be taken. A null source is
one of its own, the last. Repeated rows are ranked one after another and which of them is taken more often is not told
apart. An empty table gives an empty table. Only the key, the source and the text are read, and what `keep` names;
columns of keep that bear a name of the result are replaced.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from yore.llm.common import table, written
from yore.llm.quality import words_of

#: Weights of the sources in order, repeating; copies of a document at most; the random offset's seed.
WEIGHTS, CAP, SEED = (1, 2, 3), 3, 13
UNIT = 1 << 28
RESULT = ("size", "source_size", "target", "copies", "taken")


def offset(seed: int = SEED) -> int:
    """The random offset of a seed, in units of 2^-28 of a copy."""
    return random.Random(seed).randrange(UNIT)


def ranges(df: DataFrame, *order: Column) -> DataFrame:
    """df as a table in the shared folder, sorted, with at__: a number that rises with the order, its bits from 33 on naming one range of it and those below counting the rows of the range."""
    return written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id()))


def starts(ranged: DataFrame, by: list[str]) -> DataFrame:
    """For every range and every value of `by` in it: low (its first at__) and before (the rows of the value in earlier ranges). by: the first columns of the order, or none."""
    counted = ranged.groupBy(F.shiftright("at__", 33).alias("range__"), *by).agg(F.min("at__").alias("low"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(*by).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1))
    return counted.select("range__", *by, "low", F.coalesce(before, F.lit(0)).alias("before"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources (source, source_size) with target (double). Weights go by the sources' code points, null last.

    Each round holds the sources that are above the cap there and shares what is left anew; it ends when none is above.
    """
    named = ranges(sources, F.col("source").asc_nulls_last())
    first = starts(named, [])
    turn = F.pmod(F.col("at__") - F.col("low") + F.col("before"), F.lit(len(weights))).cast("int")
    found = written(
        named.join(F.broadcast(first), F.shiftright("at__", 33) == F.col("range__"))  # one row a range
        .select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).alias("weight"))
    )
    held, total, level, n = F.lit(False), None, F.lit(0.0), -1
    while True:
        r = found.agg(F.count_if(held), F.sum("source_size"), F.sum(F.when(held, cap * F.col("source_size")).otherwise(0)), F.sum(F.when(~held, F.col("weight")).otherwise(0))).first()
        total = total or r[1] or 0
        if r[0] == n or not r[3]:
            break
        n, left, share = r[0], total - r[2], r[3]
        level = F.col("weight") * F.lit(left).cast("long") / F.lit(share).cast("double")  # from 2^31 / 3 words on the product is no int
        held = cap * F.col("source_size") < level
    return found.select("source", "source_size", F.when(held, cap * F.col("source_size")).otherwise(level).cast("double").alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document its key, its size in words, its source's source_size and target, and how often the mix has it: copies, and taken (words). With it the columns of docs that keep names."""
    keep = tuple(c for c in keep if c not in RESULT)
    rows = docs.select(F.col(key).alias("k__"), F.col(source).alias("source"), F.size(words_of(F.col(text))).cast("long").alias("size"), F.struct(*keep).alias("keep__") if keep else F.lit(None).cast("string").alias("keep__"))
    # the order's last part only parts rows that agree in key and size, which the result can't tell apart
    placed = ranges(written(rows), F.col("source").asc_nulls_last(), F.col("size"), F.col("k__"), F.xxhash64("keep__"))
    told = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    expected = F.when(F.col("source_size") > 0, F.least(F.floor(UNIT * F.col("target") / F.col("source_size")), F.lit(cap * UNIT))).otherwise(0).cast("long")
    first = starts(placed, ["source"]).withColumnRenamed("source", "s__")
    first = first.join(told, F.col("s__").eqNullSafe(F.col("source"))).select("range__", "s__", "low", "before", "source_size", "target", expected.alias("expected"))
    rank = F.col("at__") - F.col("low") + F.col("before")
    passed = lambda n: F.shiftright(F.col("expected") * n + F.lit(offset(seed)), 28)
    joined = placed.join(first, (F.shiftright("at__", 33) == F.col("range__")) & F.col("source").eqNullSafe(F.col("s__")))
    taken = joined.withColumn("copies", passed(rank + 1) - passed(rank))
    return taken.select(F.col("k__").alias(key), *[F.col(f"keep__.{c}").alias(c) for c in keep if c != key], "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of mix() as many times as it has copies, without the columns that mix() adds."""
    return mixed.withColumn("copy__", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).drop("copy__", *RESULT)


def op13_mix(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight FROM d GROUP BY 1),
-- a source is held at its cap if that is below its part of what the sources with smaller caps for their weights leave
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM s),
c AS (SELECT *, (SELECT sum(source_size) FROM o) - coalesce(sum({CAP} * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over, sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM o),
h AS (SELECT *, {CAP} * source_size * share < weight * left_over AS held FROM c),
l AS (SELECT ((SELECT sum(source_size) FROM h) - coalesce(sum({CAP} * source_size) FILTER (held), 0)) AS free, sum(weight) FILTER (NOT held) AS parts FROM h),
t AS (SELECT source, source_size, CASE WHEN held THEN CAST({CAP} * source_size AS DOUBLE) ELSE CAST(weight * free AS DOUBLE) / CAST(parts AS DOUBLE) END AS target FROM h, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor({UNIT} * target / source_size) AS BIGINT), {CAP * UNIT}) ELSE 0 END AS expected FROM t),
r AS (SELECT doc_id, size, source_size, target, expected, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS n FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(size * (((expected * n + {offset()}) >> 28) - ((expected * (n - 1) + {offset()}) >> 28)) AS BIGINT) AS taken FROM r
"""
