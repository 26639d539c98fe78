import zlib

import numpy as np
import pytest

from tests.llm.cases import SCHEMA, documents
from yore.llm import packing as P

tokenizers = pytest.importorskip("public_tokenizers")
JSON, RANKS = tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken")


def check(pieces, texts, length, segments, loss, ids_of):
    by_sequence, by_text = {}, {}
    for r in pieces:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_text.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and len(rows) <= segments and sum(r.loss_tokens for r in rows) <= loss
    got = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in pieces)
    n = sum(len(ids_of(t)) + 1 for _, t in texts)
    assert sum(r.length for r in pieces) == n
    want = {}
    for k, t in texts:
        want.setdefault(str(k), []).append(np.append(ids_of(t), 0).astype("<u4"))
    for k, start, size, crc in got:
        assert any(zlib.crc32(x[start : start + size].tobytes()) == crc and start + size <= len(x) for x in want[k])


def test_every_id_is_in_one_piece(spark):
    rows = documents()
    encode = P.encoder(JSON)
    ids_of = lambda t: encode([t or ""])[0]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    check(P.pack(docs, JSON, RANKS).collect(), [r[:2] for r in rows], 1024, P.SEGMENTS, 1024, ids_of)
    small = P.pack(docs.withColumn("answer", docs.doc_id % 2 == 0), JSON, None, length=128, segments=3, loss=50, bears="answer").collect()
    check(small, [r[:2] for r in rows], 128, 3, 50, ids_of)
    assert P.pack(docs.limit(0), JSON).collect() == []


def test_padding_is_small(spark):
    rows = [(i, t, "en", 0) for i, (_, t, *_) in enumerate(documents()) if t] * 20
    size = {}
    for r in P.pack(spark.createDataFrame(rows, SCHEMA), JSON, RANKS).collect():
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in size.values())
    assert padding <= 0.02 * sum(size.values())


def test_three_limits_at_once(spark):
    """The query's own limits, with loss on some documents alone: no sequence exceeds any of the three, and the loss limit is often the one that is met."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    found = P.pack(docs.withColumn("answer", docs.doc_id % 3 != 0), JSON, RANKS, loss=512, bears="answer").collect()
    by_sequence = {}
    for r in found:
        t, n, b = by_sequence.get(r.sequence_id, (0, 0, 0))
        by_sequence[r.sequence_id] = (t + r.length, n + 1, b + r.loss_tokens)
    assert all(t <= 1024 and n <= P.SEGMENTS and b <= 512 for t, n, b in by_sequence.values())
    assert sum(b == 512 > t - b for t, _, b in by_sequence.values()) > 10 and sum(0 < b < t for t, _, b in by_sequence.values()) > 10


def test_keys_of_any_type_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "x y", 1), (None, None, 2)], "name string, text string, start int")
    found = P.pack(docs, JSON, key="name")
    assert found.columns == ["name", *P.PIECES] and {r.name for r in found.collect()} == {"a", None}


def test_fast_ids_equal_the_tokenizers(spark):
    texts = ["", "a", " x  y\n\n z\t\r\n", "it's I'LL we've", "é ß ñ œ Ǆ ʰ x", "日本 語 тест", "²³ ½ ª", "<|endoftext|> x", "a" * 5000, " " * 5000, "1 23,456.7", "\x00\x1c\x85 "]
    for a, b in zip(P.encoder(JSON, RANKS)(texts), P.encoder(JSON)(texts)):
        assert np.array_equal(a, b)
