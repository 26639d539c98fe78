"""Paged sources as a Spark data source: whatever gives pages (an API, an export) is read page by page on the executors."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def by_offset(fetch: Callable, size: int) -> Iterator:
    """fetch(offset, size) until a short page."""
    at = 0
    while True:
        rows = fetch(at, size)
        yield from rows
        if len(rows) < size:
            return
        at += size


def by_number(fetch: Callable, size: int, first: int = 1) -> Iterator:
    """fetch(number, size) until an empty or short page."""
    n = first
    while True:
        rows = fetch(n, size)
        yield from rows
        if len(rows) < size:
            return
        n += 1


def by_cursor(fetch: Callable, size: int) -> Iterator:
    """fetch(cursor, size) -> (rows, next cursor), from None until there is no next."""
    cursor = None
    while True:
        rows, cursor = fetch(cursor, size)
        yield from rows
        if cursor is None:
            return


STYLES = {"offset": by_offset, "number": by_number, "cursor": by_cursor}


class PagedSource(DataSource):
    """Options: fetch (module:function), style (offset, number or cursor), size, and shards, a comma-separated list that is read in parallel, each shard by fetch(shard, ...)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "body string"

    def reader(self, schema):
        return _PagedReader(self.options, schema)


class _PagedReader(DataSourceReader):
    def __init__(self, options, schema):
        self.fetch, self.style, self.size = options["fetch"], options.get("style", "offset"), int(options.get("size", "100"))
        self.shards = [s for s in options.get("shards", "").split(",") if s]
        self.width = len(schema.fields)

    def partitions(self):
        return [InputPartition(s) for s in self.shards or [None]]

    def read(self, partition):
        module, _, function = self.fetch.partition(":")
        fetch = getattr(importlib.import_module(module), function)
        call = fetch if partition.value is None else lambda at, size: fetch(partition.value, at, size)
        for row in STYLES[self.style](call, self.size):
            yield tuple(row) if isinstance(row, (tuple, list)) else (row,)


def paged(spark: SparkSession, fetch: str, schema: str | None = None, **options):
    """A DataFrame over a paged source."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").options(fetch=fetch, **{k: str(v) for k, v in options.items()})
    return (reader.schema(schema) if schema else reader).load()
