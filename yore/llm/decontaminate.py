"""Benchmark decontamination by exact n-gram windows.

A window is WINDOW consecutive words of a benchmark item (all of them, if it has fewer). Its normalised form is the
sequence of words. Small benchmarks, and only those of at most BROADCAST_BYTES of text as counted first, are broadcast
as a hash set of windows; a document is then read once, in a map without any shuffle, and each hit is verified word by
word since the set's keys are the words themselves. A larger benchmark goes by an equi-join on the windows' hashes
with the same results.

Null texts have no words. An empty benchmark hits nothing. Items with a null id mark words but are not listed; items
that share an id are listed once. Documents keep all their columns; added ones are n_words, n_hit, items (the sorted
ids as strings) and spans (word ranges [start, end) that were hit, merged). Very long texts are read whole, repeated rows
get the same result each, an empty table gives an empty table; columns that have the names of added ones are replaced by
flag() and kept by clean() and without_spans(), and any other name does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.llm.common import let, row_key, running, same_key, table

WINDOW, BROADCAST_BYTES = 10, 32 << 20

#: Letters A-Z become lower case; bytes that no word has become spaces.
_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
ADDED = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8."""
    return (text or "").encode().translate(_WORDS).split()


def windows_of(items: list[tuple], window: int = WINDOW) -> tuple[dict, dict]:
    """(word -> number from 1, length -> {window as bytes of numbers -> item ids})."""
    numbers: dict[bytes, int] = {}
    by_length: dict[int, dict[bytes, set]] = {}
    for item_id, text in items:
        found = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words(text)], dtype="<u4")
        n = min(window, len(found))
        for at in range(len(found) - n + 1 if n else 0):
            ids = by_length.setdefault(n, {}).setdefault(found[at : at + n].tobytes(), set())
            if item_id is not None:
                ids.add(str(item_id))
    return numbers, by_length


def hits(text: str | None, numbers: dict, by_length: dict) -> tuple[int, np.ndarray, set]:
    """(number of words, which are hit, item ids) of one text."""
    found = words(text)
    n = len(found)
    get = numbers.get
    ids = np.fromiter((get(w, 0) for w in found), dtype="<u4", count=n)
    hit, items = np.zeros(n + 1, dtype=np.int64), set()
    known = np.concatenate(([0], np.cumsum(ids != 0)))
    raw = ids.tobytes()
    for length, windows in by_length.items():
        if n < length:
            continue
        for at in np.flatnonzero(known[length:] - known[:-length] == length).tolist():  # only where every word is one of the benchmark's
            who = windows.get(raw[4 * at : 4 * (at + length)])
            if who is not None:
                hit[at] += 1
                hit[at + length] -= 1
                items |= who
    return n, np.cumsum(hit)[:n] > 0, items


def runs(marked: np.ndarray) -> list[dict]:
    """Maximal ranges of true."""
    step = np.flatnonzero(np.diff(np.concatenate(([0], marked.astype(np.int8), [0]))))
    return [{"start": a, "end": b} for a, b in step.reshape(-1, 2).tolist()]


def flag(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs with ADDED columns, which replace columns of these names."""
    docs = docs.select(*[c for c in docs.columns if c.lower() not in {f.name for f in ADDED}])
    bench = bench.select(F.col(item).alias("item"), F.col(item_text).alias("words")).filter("words is not null")
    size = bench.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    if size > broadcast_bytes:
        return _by_join(docs, bench, text, key, window)
    model = docs.sparkSession.sparkContext.broadcast(windows_of([tuple(r) for r in bench.collect()], window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hits(x, *model.value) for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            more = [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([int(x[1].sum()) for x in found], pa.int64()),
                pa.array([sorted(x[2]) for x in found], pa.list_(pa.string())),
                pa.array([runs(x[1]) if x[2] or x[1].any() else [] for x in found], SPANS),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[f.name for f in ADDED]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *ADDED]))


def _plain_words(text: str):
    return F.regexp_extract_all(F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def _windows(df: DataFrame, text: str, lengths) -> DataFrame:
    """df with a row for each place of a window: at, n, two hashes of the window's words (h, g) and the words as one string."""
    said = df.withColumn("w__", F.coalesce(_plain_words(text), F.array().cast("array<string>")))
    at = lambda n: F.when(F.size("w__") >= n, F.sequence(F.lit(0), F.size("w__") - n)).otherwise(F.array().cast("array<int>"))
    places = F.flatten(F.transform(lengths, lambda n: F.transform(at(n), lambda i: F.struct(i.cast("long").alias("at"), n.alias("n")))))
    found = said.withColumn("p__", F.explode(places)).select(
        *[c for c in df.columns if c != text], "p__.at", "p__.n", F.array_join(F.slice("w__", F.col("p__.at").cast("int") + 1, F.col("p__.n")), " ").alias("window")
    )
    return found.withColumns({"h": F.xxhash64("window"), "g": F.xxhash64("window", F.lit(1))})


def _by_join(docs: DataFrame, bench: DataFrame, text: str, key: str, window: int) -> DataFrame:
    """The same columns for benchmarks of any size: documents' windows meet the benchmark's by 128 bits of hash, and what meets is verified by its words."""
    n_words = F.size(F.coalesce(_plain_words("words"), F.array().cast("array<string>")))
    sized = bench.withColumn("len__", F.least(n_words, F.lit(window))).filter("len__ > 0")
    lengths = sorted(r[0] for r in sized.select("len__").distinct().collect())  # at most `window` numbers
    test = _windows(sized, "words", F.array("len__")).groupBy("n", "h", "g", "window").agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("ids"))
    rows = docs.select(F.struct(*docs.columns).alias("row__"), F.col(text).alias("t__"), *row_key(key, text))
    keys = rows.select("k_id", "k_a", "k_b", "t__").distinct()
    places = _windows(keys, "t__", F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")).drop("window")
    met = places.join(test, ["n", "h", "g"]).select("k_id", "k_a", "k_b", "at", "n", "window", "ids")
    # only hits meet their text again
    words = keys.join(met.groupBy("k_id", "k_a", "k_b").agg(F.collect_list(F.struct("at", "n", "window", "ids")).alias("met")).withColumnsRenamed({"k_id": "m_id", "k_a": "m_a", "k_b": "m_b"}), F.expr("k_id <=> m_id and k_a = m_a and k_b = m_b"))
    said = words.withColumn("w__", _plain_words("t__"))
    verified = said.select("k_id", "k_a", "k_b", F.filter("met", lambda m: F.array_join(F.slice("w__", m["at"].cast("int") + 1, m["n"]), " ") == m["window"]).alias("met")).filter(F.size("met") > 0)
    spans = F.array_sort(F.transform("met", lambda m: F.struct(m["at"].alias("start"), (m["at"] + m["n"]).alias("end"))))
    by_row = verified.select("k_id", "k_a", "k_b", F.array_sort(F.array_distinct(F.flatten("met.ids"))).alias("items__"), _joined(spans).alias("spans__"))
    joined = rows.join(by_row, same_key(rows, by_row), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        *[F.col("row__")[c].alias(c) for c in docs.columns],
        F.coalesce(F.size(_plain_words("t__")), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.aggregate("spans__", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items__", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans__", none).alias("spans"),
    )


def _joined(spans: Column) -> Column:
    """Ranges that are in order, joined where they touch: a range begins where a start is beyond all ends before it, and ends at the furthest end before the next beginning."""

    def of(xs: Column, before: Column) -> Column:
        begins = F.filter(F.transform(xs, lambda x, i: F.when(x["start"] > F.get(before, i), F.struct(x["start"].alias("start"), F.get(before, i).alias("before")))), lambda x: x.isNotNull())
        ends = lambda bs: F.transform(bs, lambda b, i: F.struct(b["start"].alias("start"), F.coalesce(F.get(bs, i + 1)["before"], F.element_at(before, -1)).alias("end")))
        return let(begins, ends)

    furthest = lambda xs: running(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(-1).cast("long"))
    return let(spans, lambda xs: let(furthest(xs), lambda before: of(xs, before)))


def clean(docs: DataFrame, bench: DataFrame, **how) -> DataFrame:
    """docs without those that hold a window of the benchmark; columns that have the names of added ones stay as they are."""
    there, back = _aside(docs)
    return back(flag(there, bench, **how).filter("n_hit = 0").select(*there.columns))


def _aside(docs: DataFrame):
    """(docs with columns that clash with added ones renamed, a function that renames them back)."""
    clash = {c: f"{c}__in" for c in docs.columns if c.lower() in {f.name for f in ADDED}}
    return docs.withColumnsRenamed(clash), lambda df: df.withColumnsRenamed({b: a for a, b in clash.items()})


def without_spans(docs: DataFrame, bench: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs whose hit words are cut out of the text: of each run, from its first word's first letter to its last word's last; all other characters stay."""
    import re

    docs, back = _aside(docs)
    found, names = flag(docs, bench, text, **how), docs.columns
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def cut_out(value, spans):
        places = [m.span() for m in word.finditer(value)]
        out, at = [], 0
        for s in spans:
            out.append(value[at : places[s["start"]][0]])
            at = places[s["end"] - 1][1]
        return "".join(out) + value[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, j = batch.schema.get_field_index(text), batch.schema.get_field_index("spans")
            new = [cut_out(t, s) if s else t for t, s in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist(), strict=True)]
            yield batch.set_column(i, batch.schema.field(i), pa.array(new, batch.schema.field(i).type)).select(names)

    return back(found.mapInArrow(run, docs.schema))


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = flag(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS win
  FROM b, LATERAL (SELECT unnest(range(0, len(w) - least(len(w), 10) + 1)) AS i) WHERE len(w) > 0
), d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(0, greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)
), met AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win
), hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM met) GROUP BY doc_id
), who AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN who USING (doc_id)
"""
