"""Whitening of embeddings by a tiled covariance.

Rows are dealt into row blocks and every row block's matrix into column blocks of TILE dimensions. A pair of column
blocks is a tile of the covariance: column blocks meet by row block, each pair is multiplied where it meets, products
are summed per tile within a task and then over tasks, and the tiles, of which there are as many as the number of
dimensions allows however many rows there are, are put together and decomposed on the driver.

Embeddings become whole numbers first, so means and deviations are exact: with n rows, sums S and floors of the means
m, n * x - S is n * (x - m) - (S - n * m), in which no product is large. Everything is centred before it is multiplied.

A row is left out if its vector is null, has an entry that is null, not finite or beyond +-2^31 / SCALE, or is not as
long as most are (of lengths equally frequent, the greatest). Repeated rows count each; null keys stay. Components
whose eigenvalue is nothing but rounding (below LEAST of the greatest) cannot be scaled and are not returned: none for
one row, or rows all alike. An empty table gives an empty table. Columns other than the key and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.llm.common import table, written

#: Entries are counted in units of 1 / SCALE, from BASE on.
SCALE, BASE, COMPONENTS = 64, 1_000_000, 32
#: Dimensions a tile has on each side, numbers in a row block, and dimensions whose covariance the driver can decompose.
TILE, BLOCK, MOST = 32, 1 << 18, 8192
LEAST = 1e-12

_BLOCKS = "row_block long, column_block int, rows int, data binary"
_TILES = "a int, b int, data binary"


def whole(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """(key, x array<long>) of the rows that count, and the number of dimensions."""
    small = lambda e: F.coalesce(F.abs(e.cast("double")) < 2.0**31 / SCALE, F.lit(False))  # noqa: E731  a NaN is greater than all numbers
    # Spark may compute x before it drops a row, so x must exist for any entry
    x = F.transform(vector, lambda e: F.when(small(e), F.floor(SCALE * e.cast("double")) + BASE))
    fits = F.forall(vector, small)
    sound = df.select(key, vector).filter(F.col(vector).isNotNull() & fits)
    most = sound.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = most.d if most else 0
    return sound.filter(F.size(vector) == d).select(key, x.alias("x")), d


def sums(rows: DataFrame, column: str) -> tuple[int, list]:
    """How many rows there are, and the sum of every dimension of an array column; as many numbers as dimensions come to the driver."""
    found = rows.select(F.posexplode(column).alias("i", "e")).groupBy("i").agg(F.count("*").alias("n"), F.sum("e").alias("s")).orderBy("i").collect()
    return (found[0].n if found else 0), [r.s for r in found]


def column_blocks(rows: DataFrame, column: str, d: int, centred, tile: int) -> DataFrame:
    """Row blocks cut into column blocks. centred: array (rows, d) of the column -> doubles without their means. Row blocks are named by task, so a task that runs again gives the same."""
    high = max(1, BLOCK // max(d, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, high):
                part = batch.column(0).slice(at, high)
                y = centred(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d))
                for k in range(0, d, tile):
                    yield pa.RecordBatch.from_pydict({"row_block": pa.array([block], pa.int64()), "column_block": pa.array([k // tile], pa.int32()), "rows": pa.array([len(part)], pa.int32()), "data": pa.array([np.ascontiguousarray(y[:, k : k + tile]).tobytes()], pa.binary())})
                block += 1

    return rows.select(column).mapInArrow(run, _BLOCKS)


def tiled_covariance(rows: DataFrame, column: str, d: int, n: int, centred, tile: int = TILE) -> np.ndarray:
    """Covariance, with divisor n, of an array column of d numbers."""
    blocks = written(column_blocks(rows, column, d, centred, tile))
    left = blocks.select("row_block", F.col("column_block").alias("a"), "rows", F.col("data").alias("p"))
    pairs = left.join(blocks.select("row_block", F.col("column_block").alias("b"), F.col("data").alias("q")), "row_block").filter("a <= b")

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                p, q = (np.frombuffer(r[c]).reshape(r["rows"], -1) for c in "pq")
                tiles[r["a"], r["b"]] = tiles.get((r["a"], r["b"]), 0.0) + p.T @ q
        yield _told(tiles)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"])
                tiles[r["a"], r["b"]] = tiles.get((r["a"], r["b"]), 0.0) + x
        yield _told(tiles)

    # a task's sums, then those of all tasks for a tile
    found = pairs.select("a", "b", "rows", "p", "q").mapInArrow(multiplied, _TILES).repartition("a", "b").mapInArrow(summed, _TILES)
    cov = np.zeros((d, d))
    for r in found.collect():  # d * d / 2 numbers
        i, j = r.a * tile, r.b * tile
        x = np.frombuffer(r.data).reshape(min(tile, d - i), -1) / n
        cov[i : i + x.shape[0], j : j + x.shape[1]] = x
        cov[j : j + x.shape[1], i : i + x.shape[0]] = x.T
    return cov


def _told(tiles: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([k[0] for k in tiles], pa.int32()), "b": pa.array([k[1] for k in tiles], pa.int32()), "data": pa.array([x.tobytes() for x in tiles.values()], pa.binary())})


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> tuple[DataFrame, np.ndarray, float]:
    """(rows, explained, identity_error). rows: the key, n, deviation (decimal, exact) and whitened (array of a number per component), a table in the shared folder; explained: each component's share of the trace; identity_error: the largest absolute entry of whitened's covariance minus the identity."""
    rows, d = whole(df, key, vector)
    if d > MOST:
        raise ValueError(f"a covariance of {d} dimensions is too large to decompose on the driver")
    n, total = sums(rows, "x")
    mean = np.array([s // n for s in total], np.int64)
    rest = np.array([s % n for s in total], np.int64)
    exact = lambda x: n * (x - mean) - rest
    cov = tiled_covariance(rows, "x", d, n, lambda x: exact(x) / n, tile) if n else np.zeros((0, 0))
    value, axes = np.linalg.eigh(cov)
    value, axes = value[::-1][:components], axes[:, ::-1][:, :components]
    k = int(np.sum(value > LEAST * max(value[0], 0))) if len(value) else 0
    scaled = axes[:, :k] / np.sqrt(value[:k])
    explained = value[:k] / np.trace(cov) if k else value[:0]
    c2 = sum(int(r) * int(r) for r in rest)
    kind = rows.schema[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column(1)
            off = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), d) - mean
            white = ((n * off - rest) / n) @ scaled
            # the sum over dimensions of (n * off - rest)^2, in parts that are exact
            squares = [int(x) for x in (off * off).sum(1)]
            cross = [int(a) * (1 << 20) + int(b) for a, b in zip((off * (rest >> 20)).sum(1), (off * (rest & 0xFFFFF)).sum(1), strict=True)]
            deviation = [n * n * s - 2 * n * x + c2 for s, x in zip(squares, cross, strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * k, pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n] * len(part), pa.int64()), pa.array([str(x) for x in deviation], pa.string()), flat], names=[key, "n", "deviation", "whitened"])

    schema = T.StructType([kind, T.StructField("n", T.LongType()), T.StructField("deviation", T.StringType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    white = written(rows.mapInArrow(run, schema).withColumn("deviation", F.col("deviation").cast("decimal(38,0)")))
    error = 0.0
    if k:
        means = np.array(sums(white, "whitened")[1]) / n
        error = float(np.abs(tiled_covariance(white, "whitened", k, n, lambda x: x - means, tile) - np.eye(k)).max())
    return white, explained, error


def op12_whiten(spark, sf_dir: str) -> DataFrame:
    """A row for every vector and component. deviation is a long, null where it doesn't fit (from some 30 million rows on)."""
    white, explained, error = whiten(table(spark, sf_dir, "embeddings"))
    share: Column = F.get(F.array(*[F.lit(float(x)) for x in explained]) if len(explained) else F.array().cast("array<double>"), F.col("i"))
    rows = white.select("vec_id", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
