"""Binary content of payloads, moved out of them: nodes keep the hash of their content, and each content is stored once.

A node gives content as a base64 data URI (contentData) or as the path of a file (contentPath), never both. Files are
read by Spark from the folders that hold them, and meet the payloads by path. A payload whose content is malformed, or
names a relative or missing path, is rejected whole with the reason. The same bytes have the same name however they
came, so a payload that is read again, before or after its content was moved, stays the same.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yore.sources.shared import names, written

_INPUTS = ("contentData", "contentPath")
_ROWS = "key string, body string, error string, blobs array<struct<cid:string,mime:string,content:binary>>, paths array<string>"


class _Malformed(ValueError):
    pass


def _data(uri: str) -> tuple[bytes, str | None]:
    m = re.fullmatch(r"data:([^;,]*)((?:;[^;,]*)*);base64,(.*)", uri, re.S)
    if not m:
        raise _Malformed("contentData is no base64 data URI")
    try:
        return base64.b64decode(m[3], validate=True), m[1] or None
    except binascii.Error as e:
        raise _Malformed("contentData has malformed base64") from e


def moved(body: str) -> tuple[str, list[tuple[str, str | None, bytes]], list[str]]:
    """(body with hashes, (hash, mime, content) of its data URIs, paths that it names). What a path holds is not known yet: its hash is `path:` and the path."""
    blobs: dict[str, tuple] = {}
    paths: list[str] = []

    def walk(value):
        if isinstance(value, list):
            return [walk(x) for x in value]
        if not isinstance(value, dict):
            return value
        given = [f for f in _INPUTS if isinstance(value.get(f), str)] if "@type" in value else []
        if len(given) == 2:
            raise _Malformed("a node has both contentData and contentPath")
        out = {k: walk(v) for k, v in value.items() if not given or k not in (*_INPUTS, "attachmentCid")}
        if given == ["contentData"]:
            content, mime = _data(value["contentData"])
            cid = hashlib.sha256(content).hexdigest()
            blobs.setdefault(cid, (cid, out.get("mimeType", mime), content))
            out["attachmentCid"] = cid
            if mime and "mimeType" not in out:
                out["mimeType"] = mime
        elif given:
            path = value["contentPath"]
            if not re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:/", path):
                raise _Malformed(f"contentPath is not absolute: {path}")
            paths.append(path)
            out["attachmentCid"] = f"path:{path}"
        return out

    told = json.dumps(walk(json.loads(body)), ensure_ascii=False)
    return told, list(blobs.values()), sorted(set(paths))


def _walked(bodies: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, body in zip(frame["key"], frame["body"], strict=True):
                try:
                    told, blobs, paths = moved(body)
                    rows.append((key, told, None, [dict(zip(("cid", "mime", "content"), b, strict=True)) for b in blobs], paths))
                except _Malformed as e:
                    rows.append((key, body, str(e), [], []))
                except ValueError:  # no JSON: nothing to move
                    rows.append((key, body, None, [], []))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _ROWS.split(", ")])

    return bodies.mapInPandas(run, _ROWS)


def files(session: SparkSession, *folders: str) -> DataFrame:
    """(path, content) of all files below folders, whatever storage they are in."""
    return session.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(folders)).select("path", "content")


def extracted(log: DataFrame, body: str = "body", at: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(log with its contents moved out, blobs, rejects).

    blobs: cid, mime, content, each cid once; rejects: the rows of log whose content cannot be had, with `error`. at:
    the files (path, content) that payloads may name; without it any path is an error. Equal payloads are walked once.
    """
    key = F.sha2(F.coalesce(body, F.lit("")), 256)
    walked = written(_walked(log.select(key.alias("key"), F.coalesce(body, F.lit("")).alias("body")).distinct()))
    named = walked.select("key", F.explode("paths").alias("path"))
    plain = F.regexp_replace("path", r"^file:/*", "/")
    if at is None:
        found = named.withColumn("cid", F.lit(None).cast("string"))
        read = walked.sparkSession.createDataFrame([], "cid string, mime string, content binary")
    else:
        wanted = named.select(plain.alias("path")).distinct()
        held = written(at.withColumn("path", plain).join(wanted, "path", "left_semi").withColumn("cid", F.sha2("content", 256)))
        found = named.withColumn("p__", plain).join(held.select(F.col("path").alias("p__"), "cid"), "p__", "left").drop("p__")
        read = held.select("cid", F.lit(None).cast("string").alias("mime"), "content")
    each = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "cid"))).alias("at__"), F.max(F.when(F.col("cid").isNull(), F.concat(F.lit("contentPath cannot be read: "), "path"))).alias("missing"))
    json_of = lambda x: F.to_json(F.struct(x.alias("v")))
    inner = lambda x: F.substring(json_of(x), F.lit(6), F.length(json_of(x)) - 6)  # noqa: E731  the JSON text of a string
    put = F.aggregate(F.coalesce("at__", F.array().cast("array<struct<path:string,cid:string>>")), F.col("body"), lambda b, x: F.replace(b, inner(F.concat(F.lit("path:"), x["path"])), inner(x["cid"])))
    done = written(walked.join(each, "key", "left").select("key", F.when(F.coalesce("error", "missing").isNull(), put).alias("b__"), F.coalesce("error", "missing").alias("e__")))
    rows = log.withColumn("key__", key).join(done.withColumnRenamed("key", "key__"), "key__").drop("key__")
    kept = rows.filter("e__ is null").withColumn(body, F.col("b__")).drop("b__", "e__")
    blobs = walked.filter("error is null").join(done.filter("e__ is null").select("key"), "key", "left_semi").select(F.explode("blobs").alias("b")).select("b.*").unionByName(read)
    return kept, blobs.groupBy("cid").agg(F.min("mime").alias("mime"), F.any_value("content").alias("content")), rows.filter("e__ is not null").withColumn("error", F.col("e__")).drop("b__", "e__")


def store(blobs: DataFrame, path: str) -> DataFrame:
    """Add blobs (cid, mime, content) to the table at path, each cid once: what the table has is not written again, whichever batch or retry names it. Returns (cid) of what was new.

    The table is parted by the first two characters of the cid; only parts that the blobs fall into are looked at, and
    only their cids. A task that is tried again leaves one file, by Spark's commits.
    """
    session = blobs.sparkSession
    once = written(blobs.dropDuplicates(["cid"]).withColumn("part", F.substring("cid", 1, 2)))
    parts = [r[0] for r in once.select("part").distinct().collect()]  # 256 at most
    there = [f"{path}/part={p}" for p in parts if f"part={p}" in set(names(session, path))]
    fresh = once
    if there:
        known = session.read.schema("cid string").parquet(*there)
        fresh = written(once.join(known, "cid", "left_anti"))
    fresh.hint("rebalance", "part").write.mode("append").partitionBy("part").parquet(path)
    return fresh.select("cid")
