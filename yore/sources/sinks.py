"""Sinks: files in Spark's formats, rows made readable, and whatever takes a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, sep: str = ".") -> DataFrame:
    """Nested fields as columns with dotted names."""

    def walk(schema: T.StructType, prefix: str, path: str):
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType, f"{prefix}{f.name}{sep}", f"{path}`{f.name}`.")
            else:
                yield F.col(f"{path}`{f.name}`").alias(prefix + f.name)

    return df.select(*walk(df.schema, "", ""))


def readable(df: DataFrame) -> DataFrame:
    """Text columns only: arrays joined by semicolons, times as ISO, other nested values as JSON."""

    def show(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), "; ")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        elif isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        return c.alias(f.name)

    return df.select(*[show(f) for f in df.schema.fields])


def to_csv(df: DataFrame, path: str) -> None:
    readable(flat(df)).write.option("header", True).option("emptyValue", "").mode("error").csv(path)


def to_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("error").json(path)


def to_yaml(df: DataFrame, path: str) -> None:
    """One list of mappings a partition, written as text."""
    pairs = [F.concat(F.lit("- " if i == 0 else "  "), F.lit(f"{c}: "), F.coalesce(F.to_json(F.struct(F.col(f"`{c}`").alias("v"))), F.lit("{}"))) for i, c in enumerate(df.columns)]
    lines = [F.regexp_replace(F.regexp_replace(p, r': \{"v":(.*)\}$', ": $1"), r": \{\}$", ": null") for p in pairs]
    df.select(F.concat_ws("\n", *lines).alias("value")).write.mode("error").text(path)


def to_each(df: DataFrame, send: Callable[[Iterator], None]) -> None:
    """Hand each partition's rows to a function on the executors, such as one that posts them."""
    df.foreachPartition(send)


def preview(df: DataFrame, n: int = 20) -> tuple[list, bool]:
    """The first n rows and whether there are more."""
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n
