"""Exports of a service: a folder, a zip, a zip that is one of several parts, a folder of nothing but zips, or a folder within a zip.

A zip's index is read where the zip is, its members are cut out of it as they are, still compressed, and dealt over all
tasks, which unpack them: a single zip does not wait for one task to unpack it whole. Of a member that several parts
have, the first part's counts. A zip is one value of Spark's, so a part may have 2 GB.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yore.sources.shared import names

#: A part of a split export, by its name; a fixed value.
PART = r"(.+)-\d{3}\.zip"


def _is_zip(name: str) -> bool:
    return name.lower().endswith(".zip")


def zips_of(session: SparkSession, path: str) -> tuple[list[str], str]:
    """(the zips that an export is in, the folder within them); no zips if it is a folder of files."""
    path = path.rstrip("/")
    here = path.rpartition("/")[2]
    at, inner = path, ""
    while at.count("/") > 1 and not _is_zip(at):  # a path may run through a zip
        at, _, step = at.rpartition("/")
        inner = f"{step}/{inner}"
    if _is_zip(at):
        folder, _, name = at.rpartition("/")
        stem = re.fullmatch(PART, name, re.I)
        parts = [n for n in names(session, folder) if (m := re.fullmatch(PART, n, re.I)) and m[1] == stem[1]] if stem else [name]
        return [f"{folder}/{n}" for n in sorted(parts)], "" if here == name else inner
    inside = [n for n in names(session, path) if not n.startswith(".")]
    return ([f"{path}/{n}" for n in inside], "") if inside and all(map(_is_zip, inside)) else ([], "")


def cut_out(content: bytes, wanted: str) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, method, size, compressed bytes) of a zip's members whose names match."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for m in z.infolist():
            if not m.is_dir() and re.match(wanted, m.filename):
                n, k = struct.unpack_from("<HH", content, m.header_offset + 26)
                start = m.header_offset + 30 + n + k
                yield m.filename, m.compress_type, m.file_size, content[start : start + m.compress_size]


def unpacked(method: int, size: int, raw: bytes) -> bytes:
    if method == zipfile.ZIP_STORED:
        return raw
    if method != zipfile.ZIP_DEFLATED:
        raise ValueError(f"members of compression {method} are not read")
    out = zlib.decompressobj(-15).decompress(raw)
    if len(out) != size:
        raise ValueError("a member is cut short")
    return out


_MEMBERS, _FILES = "zip string, name string, method int, size long, raw binary", "name string, content binary, error string"


def members(session: SparkSession, zips: list[str], wanted: str = r".*", tasks: int | None = None) -> DataFrame:
    """(name, content, error) of the members of zips whose names match, over `tasks` tasks (the session's shuffle partitions). A member that cannot be read has an error and no content; so has a zip without an index, under its own name."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = list(cut_out(content.as_buffer().to_pybytes(), wanted))
                except zipfile.BadZipFile:
                    rows = [(path, -1, 0, b"")]
                for name, method, size, raw in rows:
                    yield pa.RecordBatch.from_pydict({"zip": [path], "name": [name], "method": pa.array([method], pa.int32()), "size": [size], "raw": pa.array([raw], pa.binary())})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                try:
                    content, error = (unpacked(r["method"], r["size"], r["raw"]), None) if r["method"] >= 0 else (None, "no zip")
                except (ValueError, zlib.error) as e:
                    content, error = None, str(e)
                yield pa.RecordBatch.from_pydict({"name": [r["name"]], "content": pa.array([content], pa.binary()), "error": pa.array([error], pa.string())})

    if not zips:
        return session.createDataFrame([], _FILES)
    content = session.read.format("binaryFile").load(zips).select("path", "content").repartition(len(zips), "path")
    rows = content.mapInArrow(index, _MEMBERS)
    first = rows.groupBy("name").agg(F.min("zip").alias("zip"))
    dealt = rows.join(first, ["name", "zip"]) if len(zips) > 1 else rows
    n = tasks or int(session.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("zip", "name", "method", "size", "raw").repartition(n, F.xxhash64("zip", "name")).mapInArrow(unpack, _FILES)


def export(session: SparkSession, path: str, wanted: str = r".*", tasks: int | None = None) -> DataFrame:
    """(name, content, error) of the files of an export whose names, from its root on, match."""
    zips, folder = zips_of(session, path)
    if zips:
        found = members(session, zips, re.escape(folder) + f"(?:{wanted})" if folder else wanted, tasks)
        return found.withColumn("name", F.when(F.col("name").startswith(folder), F.substring("name", F.lit(len(folder) + 1), F.length("name"))).otherwise(F.col("name")))
    files = session.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    root = re.sub(r"^file:/*", "/", path.rstrip("/"))
    name = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), "^" + re.escape(root) + "/", "")
    return files.select(name.alias("name"), "content", F.lit(None).cast("string").alias("error")).filter(F.col("name").rlike(f"^(?:{wanted})"))
