"""Tables in numbered buckets of which a batch reads and writes only those that it touches.

A bucket is a folder of Parquet files, <path>/<table>/v=<version>/bucket=<number>, or several, that are never changed: a
batch writes new versions of the buckets that it touches, or more rows beside the versions that are there, and then one
manifest, which names the versions of every bucket. Whoever
reads goes by the last manifest, so a batch shows whole or not at all, one that failed leaves nothing to see, and one
that is tried again after its manifest finds its own rows there. Of two writers the first one's manifest stands and the
other fails; versions have names of their own, so that neither writes where the other does. Versions that no manifest
names any more are not removed; give older ones a lifetime.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from yore.sources.shared import names, put


#: Versions of a bucket from which on more rows are not laid beside them, but make one version of all.
VERSIONS = 32


class Buckets:
    """The tables under a path. schemas: table -> (its columns, the column that deals its rows)."""

    def __init__(self, session: SparkSession, path: str, schemas: dict[str, tuple[str, str]], count: int = 64):
        self.session, self.path, self.schemas, self.count = session, path.rstrip("/"), schemas, count
        told = names(session, f"{self.path}/manifests")
        done = [x for x in told if x.isdigit()]
        self.batch, self.versions = 0, {t: {} for t in schemas}
        if done:
            text = session.read.text(f"{self.path}/manifests/{done[-1]}", wholetext=True).first()[0]
            said = json.loads(text)
            self.batch, self.count = said["batch"], said["count"]
            self.versions |= {t: {int(k): (v,) if isinstance(v, str) else tuple(v) for k, v in x.items()} for t, x in said["versions"].items()}
        self._staged: dict[str, dict[int, tuple[str, ...]]] = {}

    def of(self, value: Column) -> Column:
        """The bucket of a key."""
        return F.pmod(F.xxhash64(value), F.lit(self.count)).cast("int")

    def touched(self, df: DataFrame, key: str) -> list[int]:
        """The buckets that df's keys fall into: `count` numbers at most."""
        return sorted(r[0] for r in df.select(self.of(F.col(key))).distinct().collect())

    def read(self, table: str, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """A table, or what is in some of its buckets."""
        df = self._there(table, {k: v for k, v in self.versions[table].items() if buckets is None or k in set(buckets)})
        return df.select(*columns) if columns else df

    def _there(self, table: str, at: dict[int, tuple[str, ...]]) -> DataFrame:
        schema, _ = self.schemas[table]
        paths = [f"{self.path}/{table}/v={v}/bucket={k}" for k, vs in sorted(at.items()) for v in vs]
        return self.session.read.schema(schema).parquet(*paths) if paths else self.session.createDataFrame([], schema)

    def stage(self, table: str, rows: DataFrame, buckets: list[int]) -> DataFrame:
        """Write what buckets of a table will hold once the batch commits, and return it as written; rows must all fall into them. A large bucket is parted among tasks."""
        new = self._write(table, rows)
        self._staged[table] = {k: new.get(k, ()) for k in buckets}
        return self._there(table, new)

    def dealt(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows moved together by the buckets of a key; a large bucket is parted among tasks."""
        return rows.withColumn("bucket", self.of(F.col(key))).hint("rebalance", "bucket").drop("bucket")

    def add(self, table: str, rows: DataFrame, dealt: bool = False) -> tuple[DataFrame, list[int]]:
        """Write rows that a table will hold besides its own once the batch commits; the rows as written, and the buckets that they fall into. dealt: they lie together already, as what is made of dealt() rows does."""
        new = self._write(table, rows, dealt)
        held = {k: self.versions[table].get(k, ()) for k in new}
        many = {k: held[k] + new[k] for k in new if len(held[k]) >= VERSIONS}
        self._staged[table] = {k: held[k] + new[k] for k in new} | (self._write(table, self._there(table, many)) if many else {})
        return self._there(table, new), sorted(new)

    def _write(self, table: str, rows: DataFrame, together: bool = False) -> dict[int, tuple[str, ...]]:
        schema, key = self.schemas[table]
        wanted = [x.split()[0].strip("`") for x in schema.split(", ")]
        dealt = (rows if together else self.dealt(rows, key)).select(*wanted, self.of(F.col(key)).alias("bucket"))
        version = f"{self.batch + 1}-{uuid.uuid4().hex[:12]}"
        at = f"{self.path}/{table}/v={version}"
        dealt.write.partitionBy("bucket").parquet(at, compression="zstd")
        there = {int(x.split("=")[1]) for x in names(self.session, at) if x.startswith("bucket=")}
        return {k: (version,) for k in there}

    def commit(self) -> None:
        """Make what is staged the state that readers see; fails if another writer has committed this batch meanwhile."""
        versions = {t: {k: v for k, v in (at | self._staged.get(t, {})).items() if v} for t, at in self.versions.items()}
        put(self.session, f"{self.path}/manifests/{self.batch + 1:012d}", json.dumps({"batch": self.batch + 1, "count": self.count, "versions": versions}))
        self.batch, self.versions, self._staged = self.batch + 1, versions, {}
