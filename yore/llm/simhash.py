"""Near-duplicates by SimHash fingerprints and the pigeonring filter.

A fingerprint has 64 bits, one if it is set in over half of the hashes of the text's word shingles. Two texts link if
their fingerprints differ in at most TAU bits. The ring of 64 bits is cut into RING segments. The pigeonring principle
says that two linked fingerprints have a segment from which every chain of l consecutive segments differs in at most
l * TAU / RING bits, for every l from 1 to RING. As long as that quota is below one, the chain must agree exactly, so
the segments of that prefix are an exact key; the rest of the chain prunes what shares the key before the full Hamming
check.

Null and empty texts have the fingerprint zero and link like any other. Equal fingerprints are one class, so copies
are never paired. Fingerprints that share a key come together in bounded blocks; what shares a key with more than BLOCK
others (which a block would not bound) goes the exact linear way: each fingerprint with its 64 one-bit variants, since
two fingerprints differ in at most two bits if and only if a word exists within one bit of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.llm.common import cut, row_key, table
from yore.operators.components import connected_components

TAU, RING, BLOCK, SHINGLE = 2, 9, 512, 3


def edges_of_ring(ring: int) -> list[int]:
    """Where the ring's segments begin, and 64."""
    return [round(64 * i / ring) for i in range(ring + 1)]


def exact_prefix(tau: int, ring: int) -> int:
    """How many segments in a row must agree in every bit."""
    return max(l for l in range(1, ring + 1) if l * tau < ring)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64 bits as an unsigned number. Shingles are hashed by XXH64 with seed 42."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return 0
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    n = max(1, len(words) - size + 1)
    hash_of = xxhash.xxh64_intdigest
    hashes = np.array([hash_of(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


#: White space is ASCII only, and so are the letters that are lower-cased.
_FOLD = bytes(range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint", size: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            got = np.array([fingerprint(x, size) for x in batch.column(at).to_pylist()], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())]))


def _bits(x: np.ndarray) -> np.ndarray:
    """Number of set bits of unsigned numbers."""
    return np.bitwise_count(x)


def _chain_holds(x: int, others: np.ndarray, first: int, tau: int, ring: int) -> np.ndarray:
    """Which of others pass the chain that starts at the segment first, for every length of chain, the last being the full Hamming check."""
    cuts, diff = edges_of_ring(ring), others ^ np.uint64(x)
    ok, total = np.ones(len(others), dtype=bool), np.zeros(len(others), dtype=np.int64)
    for l in range(1, ring + 1):
        a, b = cuts[(first + l - 1) % ring], cuts[(first + l - 1) % ring + 1]
        mask = np.uint64(((1 << (b - a)) - 1) << a)
        total += _bits(diff & mask)
        ok &= total * ring <= l * tau
    return ok


def ring_holds(diff: np.ndarray, quota: np.ndarray, ring: int) -> np.ndarray:
    """Which rows of differing bits (64-bit words) have at most `quota` set bits, for fingerprints of any length.

    The words are cut into at most `ring` segments. Rows without a segment from which the chains of one, two and more
    consecutive segments stay within their share of the quota are pruned before the full Hamming check.
    """
    cuts = np.unique(np.linspace(0, diff.shape[1], ring + 1).astype(np.int64))
    ring = len(cuts) - 1
    by_segment = np.add.reduceat(np.bitwise_count(diff), cuts[:-1], axis=1, dtype=np.int64)
    share = (quota / diff.shape[1])[:, None]
    lengths = np.diff(cuts)
    holds, total, allowed = np.ones(by_segment.shape, dtype=bool), np.zeros_like(by_segment), np.zeros(ring, np.int64)
    for l in range(ring - 1):
        total += np.roll(by_segment, -l, axis=1)
        allowed += np.roll(lengths, -l)
        holds &= total <= share * allowed + 1e-9
    ok = holds.any(axis=1)
    ok[ok] = by_segment[ok].sum(axis=1) <= quota[ok]
    return ok


def spanning_links(values: list[int], first: int, tau: int, ring: int) -> list[tuple[int, int]]:
    """Links of a forest that joins what one block links: each value that is reached, with what reached it. Every value is checked against the unreached ones once."""
    left = np.array(sorted(set(values)), dtype=np.int64)
    links = []
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            x = todo.pop()
            hit = _chain_holds(x & (2**64 - 1), left.view(np.uint64), first, tau, ring)
            for y in left[hit].tolist():
                links.append((x, y))
                todo.append(y)
            left = left[~hit]
    return links


def fingerprint_links(prints: DataFrame, tau: int = TAU, ring: int = RING, block: int = BLOCK) -> DataFrame:
    """(u, v) links between distinct fingerprints (column fp) that connect all that differ in at most tau bits."""
    if tau != 2 and tau != 1:
        raise ValueError("the linear way for large blocks is exact for one or two bits")
    cuts, agree = edges_of_ring(ring), exact_prefix(tau, ring)
    masks = [0] * ring
    for i in range(ring):
        for l in range(agree):
            a, b = cuts[(i + l) % ring], cuts[(i + l) % ring + 1]
            masks[i] |= ((1 << (b - a)) - 1) << a
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keyed = prints.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("first"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for i, m in enumerate(masks)])).alias("k")
    ).select("fp", "k.first", "k.part")
    sizes = keyed.groupBy("first", "part").agg(F.count("*").alias("n")).filter("n > 1")
    shared = cut(keyed.join(sizes, ["first", "part"]))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for first, values in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in spanning_links(values, first, tau, ring)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    small = shared.filter(F.col("n") <= block).groupBy("first", "part").agg(F.collect_list("fp").alias("fps")).select("first", "fps").mapInArrow(links, "u long, v long")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)).cast("long") for i in range(64)])
    near = shared.filter(F.col("n") > block).select("fp").distinct().select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    if tau == 1:
        return small.union(near.filter("z <> fp").join(prints.select(F.col("fp").alias("z")), "z", "left_semi").select(F.col("fp").alias("u"), F.col("z").alias("v")))
    centre = near.groupBy("z").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1").select("z", "u")
    return small.union(near.join(centre, "z").select("u", F.col("fp").alias("v")).filter("u <> v"))


def components(prints: DataFrame, key: str = "doc_id", tau: int = TAU, ring: int = RING, block: int = BLOCK) -> DataFrame:
    """(fp, component_id) for the fingerprints of prints(key, fp): the smallest key among all that links reach. A component whose keys are all null has a null id."""
    least = cut(prints.groupBy("fp").agg(F.min(key).alias("least")))
    parts = connected_components(fingerprint_links(least.select("fp"), tau, ring, block))
    named = cut(least.join(parts, least.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    groups = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(groups, "component").select("fp", "component_id")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, **how) -> DataFrame:
    """(key, fp, component_id) of every row; repeated rows and ties share their component, an empty table gives an empty one."""
    prints = cut(with_fingerprints(docs.select(key, text), text, "fp", size).select(key, "fp"))
    return prints.join(components(prints, key, **how), "fp").select(key, "fp", "component_id")


def _only_rows(docs: DataFrame, elected: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of docs that elected (_election() structs, column e) names, one of each, with the columns of docs.

    Rows move once, by three hashes: the join is by these alone, with the id compared in what meets, so that it leaves
    repeated rows together where they are told apart from.
    """
    named = elected.select(F.col("e.k_id").alias("e_id"), F.xxhash64("e.k_id").alias("e_c"), F.col("e.k_a").alias("e_a"), F.col("e.k_b").alias("e_b"))
    left = docs.select(F.struct(*docs.columns).alias("row__"), *row_key(key, text)).withColumn("k_c", F.xxhash64("k_id"))
    same_id = F.coalesce(left.k_id == named.e_id, left.k_id.isNull() & named.e_id.isNull())
    kept = left.join(named.hint("merge"), (left.k_c == named.e_c) & (left.k_a == named.e_a) & (left.k_b == named.e_b) & same_id)
    return kept.dropDuplicates(["k_c", "k_a", "k_b"]).select(*[F.col("row__")[c].alias(c) for c in docs.columns])


def _election() -> Column:
    """What the least of a component is chosen by: the id, nulls last, then the text's hashes."""
    return F.min(F.struct(F.col("k_id").isNull().alias("none"), "k_id", "k_a", "k_b"))


def _elected(least: DataFrame, links: DataFrame) -> DataFrame:
    """The least e of each component of node, from (node, e)."""
    parts = connected_components(links)
    named = least.join(parts.withColumnRenamed("node", "n__"), F.col("node") == F.col("n__"), "left").select(F.coalesce("component", "node").alias("component"), "e")
    return named.groupBy("component").agg(F.min("e").alias("e"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, tau: int = TAU, ring: int = RING, block: int = BLOCK) -> DataFrame:
    """One row of each component, with the columns of docs: that with the least key, nulls last, then with the least hash of the text."""
    marked = with_fingerprints(docs.select(*row_key(key, text), F.col(text).alias("text__")), "text__", "fp", size).drop("text__")
    least = cut(marked.groupBy(F.col("fp").alias("node")).agg(_election().alias("e")))
    return _only_rows(docs, cut(_elected(least, fingerprint_links(least.select(F.col("node").alias("fp")), tau, ring, block))), key, text)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
