"""Sources beyond Spark's own formats; each gives a DataFrame and reads where the executors are."""

from __future__ import annotations

import io
import json
import plistlib
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def within(df: DataFrame, column: str, since=None, until=None) -> DataFrame:
    """Rows with since < column < until; bare comparisons, so that they reach a Parquet or JDBC scan."""
    if since is not None:
        df = df.filter(F.col(column) > F.lit(since).cast(df.schema[column].dataType))
    if until is not None:
        df = df.filter(F.col(column) < F.lit(until).cast(df.schema[column].dataType))
    return df


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and text columns."""
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')


def records(text: str) -> Iterator[dict]:
    """JSON objects of a text: one object, an array, one a line, or one after another."""
    decoder, at = json.JSONDecoder(), 0
    while (m := re.compile(r"[\s,]*").match(text, at)) and m.end() < len(text):
        value, at = decoder.raw_decode(text, m.end())
        yield from value if isinstance(value, list) else [value]


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def _each(files: DataFrame, schema: str, parse) -> DataFrame:
    """A row for each tuple that parse(content) gives, after the file's path; a file that cannot be parsed gives none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in f"path string, {schema}".split(", ")]
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, *row) for row in parse(bytes(content))]
                except (ValueError, zipfile.BadZipFile, plistlib.InvalidFileException):
                    continue
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, f"path string, {schema}")


def json_stream(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, body): every JSON object of the files, whatever holds them together."""
    return _each(_files(spark, path), "n long, body string", lambda b: [(i, json.dumps(r, ensure_ascii=False)) for i, r in enumerate(records(b.decode()))])


def archive(spark: SparkSession, path: str, member: str = r".*\.json$") -> DataFrame:
    """(path, name, content) of the members of zip files whose names match."""

    def members(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return [(n, z.read(n)) for n in z.namelist() if re.match(member, n)]

    return _each(_files(spark, path, "*.zip"), "name string, content binary", members)


def plist(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): property lists as JSON; bytes and dates as text."""
    return _each(_files(spark, path, "*.plist"), "body string", lambda b: [(json.dumps(plistlib.loads(b), default=str, ensure_ascii=False, sort_keys=True),)])


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """(message): raw messages of mailboxes, split at From lines after an empty line, with quoted From lines restored. Spark splits the files."""
    lines = spark.read.text(path, lineSep="\n\nFrom ")
    return lines.select(F.regexp_replace(F.regexp_replace("value", r"\A(?:From )?[^\n]*\n", ""), r"(?m)^>(>*From )", "$1").alias("message"))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("message_id", "date", "sender", "recipients", "subject", "body")]))
def parsed_mail(messages: pd.Series) -> pd.DataFrame:
    """Headers and plain body of raw messages."""

    def one(raw: str) -> tuple:
        m = message_from_bytes((raw or "").encode(), policy=policy.default)
        body = m.get_body(preferencelist=("plain", "html"))
        text = body.get_content() if body is not None else ""
        return tuple(str(m[h]) if m[h] else None for h in ("Message-ID", "Date", "From", "To", "Subject")) + (text,)

    return pd.DataFrame([one(x) for x in messages], columns=["message_id", "date", "sender", "recipients", "subject", "body"])


def shell_history(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, at, command): zsh lines with times, bash lines after a #time line, or plain ones; `at` in epoch seconds or null."""

    def lines(content: bytes):
        at, out = None, []
        for line in content.decode("utf-8", "replace").splitlines():
            if m := re.match(r"#(\d{9,})$", line):
                at = int(m[1])
            elif m := re.match(r": (\d+):\d+;(.*)", line):
                out.append((len(out), int(m[1]), m[2]))
            elif line:
                out.append((len(out), at, line))
                at = None
        return out

    return _each(_files(spark, path), "n long, at long, command string", lines)


def schema_match(df: DataFrame, wanted: dict[str, bool]) -> str:
    """full, partial or none: which of the wanted columns (name -> required) a table has."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in wanted if c.lower() not in have]
    return "full" if not missing else "none" if any(wanted[c] for c in missing) else "partial"


def count_mbox(spark: SparkSession, path: str) -> int:
    """How many messages mbox files hold, by their separators alone."""
    return spark.read.text(path).filter(F.col("value").startswith("From ")).count()
