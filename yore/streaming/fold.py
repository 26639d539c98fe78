"""Incremental runs: micro-batches through the gate into an append-only log, and sessions over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from yore.operators.runs import gate
from yore.sources.shared import names, written


#: Buckets of a log, by the hash of the claim.
BUCKETS = 64


def append_new(batch: DataFrame, log: str, cid: str = "cid", claim: str = "claim", asserted: str = "asserted_at") -> None:
    """Append what the log does not have: equal ids are one row, a claim that the log knows is a confirm.

    The log is parted by claim into BUCKETS, of which only those that the batch falls into are looked at, and of these
    only ids and claims; so a claim's rows must keep one id each, as content ids do.
    """
    spark = batch.sparkSession
    fresh = written(gate(batch, cid, claim, asserted).withColumn("bucket", F.pmod(F.xxhash64(claim), F.lit(BUCKETS)).cast("int")))
    touched = {f"bucket={r[0]}" for r in fresh.select("bucket").distinct().collect()}  # BUCKETS at most
    there = [f"{log}/{x}" for x in names(spark, log) if x in touched]
    if there:
        schema = ", ".join(f"`{c}` {fresh.schema[c].dataType.simpleString()}" for c in (cid, claim))
        known = spark.read.schema(schema).parquet(*there)
        fresh = fresh.join(known.select(cid), cid, "left_anti")
        claims = known.select(claim).distinct().withColumn("known__", F.lit(True))
        fresh = fresh.join(claims, claim, "left").withColumn("kind", F.when(F.col("known__"), "confirm").otherwise(F.col("kind"))).drop("known__")
    written(fresh).write.mode("append").partitionBy("bucket").parquet(log)


def ingest(stream: DataFrame, log: str, checkpoint: str, **columns) -> StreamingQuery:
    """Run a stream of assertions into the log until what is there is read."""
    return stream.writeStream.foreachBatch(lambda batch, _: append_new(batch, log, **columns)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(stream: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, count) of sessions over a stream or a table; rows later than the watermark are dropped from a stream."""
    found = stream.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("count"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")


def tumbling(stream: DataFrame, at: str, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, count) of tumbling or sliding windows."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(w.alias("w")).agg(F.count("*").alias("count")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
