"""The library's Python functions under names for SQL, beside one aggregate and one table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.functions import identity, markup
from yore.functions.identity import key_of


@F.pandas_udf(T.StringType())
def fingerprint(values: pd.Series) -> str:
    """One key for a group of texts, whatever their order."""
    return key_of("\n".join(sorted(values.dropna())))


class Fields:
    """(path, value) of every leaf of a JSON text."""

    def eval(self, body: str):
        import json

        def walk(value, path):
            if isinstance(value, dict):
                for k, v in value.items():
                    yield from walk(v, f"{path}.{k}" if path else k)
            elif isinstance(value, list):
                for i, v in enumerate(value):
                    yield from walk(v, f"{path}[{i}]")
            else:
                yield path, None if value is None else str(value)

        if body:
            yield from walk(json.loads(body), "")


def register(spark: SparkSession) -> None:
    """content_key, html_to_text, html_to_markdown, html_unescape, fingerprint (an aggregate), json_fields (a table function)."""
    for name, f in (("content_key", identity.content_key), ("html_to_text", markup.to_text), ("html_to_markdown", markup.to_markdown), ("html_unescape", markup.unescape), ("fingerprint", fingerprint)):
        spark.udf.register(name, f)
    spark.udtf.register("json_fields", F.udtf(Fields, returnType="path string, value string"))
