"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yore.sources.shared import cut, release, written

__all__ = ["cut", "release", "written"]

#: Words as runs of anything but ASCII white space.
SPACED = r"[^\x20\x09-\x0D]+"
#: Words as runs of digits, lower-case ASCII letters and anything beyond ASCII.
PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body is a lambda's inner part."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op, none) -> Column:
    """For each element, op over all before it (none for the first), and op over all at the end: one element more than values.

    In steps of 256 and of 256 steps, so that an array of n elements is grown by copies of at most n / 256 and of 256 elements.
    """
    grown = lambda xs: F.aggregate(
        xs, F.array(none), lambda out, x: F.concat(out, F.array(op(F.element_at(out, -1), x)))
    )

    def of(xs: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(xs) / 256).cast("int")), lambda i: F.slice(xs, i * 256 + 1, 256))
        return let(steps, joined)

    def joined(steps: Column) -> Column:
        return let(grown(F.transform(steps, lambda s: F.aggregate(s, none, lambda a, x: op(a, x)))), lambda before: inner(steps, before))

    def inner(steps: Column, before: Column) -> Column:
        # every step's own running values, its last one left out, after what came before the step
        each = F.transform(steps, lambda s, i: let(F.get(before, i), lambda b: F.transform(F.slice(grown(s), 1, F.size(s)), lambda x: op(b, x))))
        return F.concat(F.flatten(each), F.slice(before, -1, 1))

    return let(values, of)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def row_key(key: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart which may share an id: the id and two hashes of the text.

    Rows that agree in all of them are the same row repeated, and every operator gives them the same result.
    """
    return [F.col(key).alias("k_id"), F.xxhash64(text).alias("k_a"), F.xxhash64(F.col(text), F.lit(1)).alias("k_b")]


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """The join condition of row_key()'s columns; a null id equals a null id."""
    return left.k_id.eqNullSafe(right.k_id) & (left.k_a == right.k_a) & (left.k_b == right.k_b)
