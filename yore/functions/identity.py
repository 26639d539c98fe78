"""Content keys: hashes of values that do not depend on the order of a JSON object's keys."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_SORTED = json.JSONEncoder(sort_keys=True, separators=(",", ":"), ensure_ascii=False)


#: Two digits of base32 for each ten bits.
_DIGITS = [a + b for a in "abcdefghijklmnopqrstuvwxyz234567" for b in "abcdefghijklmnopqrstuvwxyz234567"]


def canonical(value) -> str:
    """JSON with sorted keys at every level and without spaces; arrays keep their order, and a whole float is an integer."""
    return _SORTED.encode(value if isinstance(value, str) else _plain(value))


def canonical_text(text: str, leave: tuple[str, ...] = ()) -> str:
    """canonical() of a JSON text's object, without the fields in `leave`; a ValueError if it is none."""
    said = json.loads(text, parse_float=_number)
    if not isinstance(said, dict):
        raise ValueError("no object")
    return _SORTED.encode({k: v for k, v in said.items() if k not in leave})


def _number(text: str):
    return _plain(float(text))


def _plain(value):
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return int(value) if isinstance(value, float) and value.is_integer() else value


def key_of(text: str) -> str:
    """Lower-case base32 without padding of the text's SHA-256."""
    n = int.from_bytes(hashlib.sha256(text.encode()).digest()) << 4  # 260 bits: 52 digits
    return "".join([_DIGITS[n >> at & 1023] for at in range(250, -1, -10)])


@F.pandas_udf(T.StringType())
def content_key(values: pd.Series) -> pd.Series:
    """The key of a JSON text's value; of text that is no JSON, as a string."""

    def one(text):
        try:
            return key_of(canonical(json.loads(text)))
        except ValueError:
            return key_of(canonical(text))

    return values.map(one, na_action="ignore")


def path(column, *steps):
    """The value at a path of names in a JSON text; the name * takes all elements of an array, joined by commas."""
    where = "$" + "".join("[*]" if s == "*" else f".{s}" for s in steps)
    found = F.get_json_object(column, where)
    if "*" not in steps:
        return found
    many = F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))  # one element comes bare
    return F.array_join(F.from_json(many, "array<string>"), ",")
