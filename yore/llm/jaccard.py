"""Near copies by the Jaccard similarity of word shingles, exactly: no pair of LEAST or more is missed, none below is linked.

Texts with the same set of shingles are one class. Two sets with a similarity of at least 4/5 share a shingle among the
first n - ceil(4n/5) + 1 of both, in any order that is the same for all texts (prefix filter). The order is by how often
a shingle's bucket occurs in the corpus, so that the prefixes hold rare ones; the table of buckets has a fixed size and
sets the order only, not the result. Classes of like sizes that share a shingle of their prefixes form a block, blocks
with the same classes are one.

A set's fingerprint holds the parity of what falls on each of its bits, of which there are as many as elements, rounded
up to a power of two; halves laid over each other give the shorter fingerprint of the same set. Two fingerprints never
differ in more bits than their sets in elements, and sets that are alike differ in a ninth of both at most. So the
pigeonring filter and the full Hamming check of simhash.ring_holds() part a block into what may be alike, and in each
part the overlaps of all sets are counted. A block of over BLOCK classes is cut into pieces that meet in pairs, so that a
task holds two pieces at a time and no pair is left out.

A radius of the 64 bits that op4_simhash compares would not do alone: texts with a similarity of 0.8 differ in some 10 of
them, often in more, and at such a radius no part of a fingerprint that must agree is long enough to be a key. With a
radius for them given, texts whose fingerprints of op4_simhash are that close are linked as well, by the same exact
search as there: fingerprints link as they do in op4, and each stands for all classes that have it.

Null texts are empty; a text of fewer words than a shingle has one of all its words, so all texts without words are one
class. Very long texts are read whole and have long fingerprints. Repeated rows are copies; an empty table gives an
empty table; columns keep their names, whatever they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.llm.common import row_key, written
from yore.llm.simhash import _FOLD, _elected, _election, _only_rows, fingerprint, fingerprint_links, ring_holds
from yore.operators.components import connected_components

SHINGLE, BUCKETS, BLOCK, LEAST_BITS, RING = 5, 1 << 18, 1024, 64, 8
CHUNK = 1 << 14


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set of hashes of the text's word shingles, in order; of a shorter text, that of all its words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    whole = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    starts = ends - [len(w) for w in words]
    n = len(words) - size + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(whole, 42)], dtype="<u8")
    hash_of = xxhash.xxh64_intdigest
    return np.unique(np.array([hash_of(whole[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], dtype="<u8"))


def alike(both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of a and b elements with `both` in common have a Jaccard similarity of 4/5 or more."""
    return 9 * both >= 4 * (a + b)


def parity(said: np.ndarray) -> bytes:
    """The parity of the elements on each bit of the fingerprint."""
    bits = max(LEAST_BITS, 1 << (len(said) - 1).bit_length())
    return np.packbits((np.bincount((said >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def halved(prints: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of 64-bit words) of half as many bits of the same sets."""
    half = prints.shape[1] // 2
    return prints[:, :half] ^ prints[:, half:]


def may_be_alike(prints: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """Indices of the parts of a block, of two or more, that hold every pair which is alike.

    Sets that are alike have lengths of fingerprints within a factor of two, since their sizes are within 5/4.
    """
    if len(prints) == 2:
        (a, b), (x, y) = sizes.tolist(), prints
        while len(x) != len(y) and max(len(x), len(y)) <= 2 * min(len(x), len(y)):
            x, y = sorted((x, y), key=len)
            y = (int.from_bytes(y[: len(x)]) ^ int.from_bytes(y[len(x) :])).to_bytes(len(x))
        near = 5 * min(a, b) >= 4 * max(a, b) and 9 * (int.from_bytes(x) ^ int.from_bytes(y)).bit_count() <= a + b
        return [np.arange(2)] if near else []
    words = np.array([len(x) // 8 for x in prints])
    rows, as_is, half, place = {}, {}, {}, np.zeros(len(prints), np.int64)
    for w in np.unique(words).tolist():
        rows[w] = np.flatnonzero(words == w)
        place[rows[w]] = np.arange(len(rows[w]))
        as_is[w] = np.frombuffer(b"".join(prints[i] for i in rows[w]), dtype="<u8").reshape(len(rows[w]), w)
        half[w] = halved(as_is[w]) if w > 1 else None
    left = {w: np.ones(len(i), bool) for w, i in rows.items()}
    parts = []
    for seed in range(len(prints)):
        if not left[words[seed]][place[seed]]:
            continue
        left[words[seed]][place[seed]] = False
        todo, part = [seed], [seed]
        while todo:
            x = todo.pop()
            w, at = int(words[x]), place[x]
            for other, mine, theirs in ((w, as_is[w][at], as_is), (2 * w, as_is[w][at], half), (w // 2, half[w][at] if w > 1 else None, as_is)):
                if mine is None or other not in rows:
                    continue
                some = np.flatnonzero(left[other])
                some = some[(5 * sizes[rows[other][some]] >= 4 * sizes[x]) & (5 * sizes[x] >= 4 * sizes[rows[other][some]])]
                if not len(some):
                    continue
                quota = (sizes[rows[other][some]] + sizes[x]) / 9
                hit = some[ring_holds(theirs[other][some] ^ mine, quota, RING)]
                left[other][hit] = False
                part += rows[other][hit].tolist()
                todo += rows[other][hit].tolist()
        if len(part) > 1:
            parts.append(np.array(part))
    return parts


def bucket_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """How many shingles fall into each bucket, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                np.add.at(total, (shingles(x, size) % BUCKETS).astype(np.int64), 1)
        parts = range(0, BUCKETS, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([total[i : i + CHUNK].astype("<i8").tobytes() for i in parts], pa.binary())], names=["part", "n"])

    def add(key, rows):
        total = np.zeros(CHUNK, dtype=np.int64)
        for x in rows.column("n").to_pylist():
            total += np.frombuffer(x, dtype="<i8")
        return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([total.tobytes()], pa.binary())})

    found = docs.select(text).mapInArrow(count, "part long, n binary").groupBy("part").applyInArrow(add, "part long, n binary").collect()
    total = np.zeros(BUCKETS, dtype=np.int64)
    for r in found:
        total[r["part"] : r["part"] + CHUNK] = np.frombuffer(r["n"], dtype="<i8")
    return total


def size_class(n: Column) -> Column:
    """Sets that are alike are of the same or neighbouring classes, since their sizes are within 5/4."""
    return F.floor(F.log(n) / np.log(1.2501)).cast("tinyint")


def by_size(sizes: np.ndarray, nodes: np.ndarray) -> Iterator[np.ndarray]:
    """The nodes of each two neighbouring size classes, or of one without neighbours, if there are two or more. sizes: in order."""
    cuts = np.flatnonzero(np.diff(sizes)) + 1
    groups = list(zip(sizes[np.concatenate(([0], cuts))].tolist(), np.split(nodes, cuts), strict=True))
    for i, (size, some) in enumerate(groups):
        if i + 1 < len(groups) and groups[i + 1][0] == size + 1:
            yield np.sort(np.concatenate((some, groups[i + 1][1])))
        elif len(some) > 1 and not (i and groups[i - 1][0] == size - 1):
            yield some


def blocks(prefixes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(block, node): distinct groups of classes of like sizes that share a shingle of their prefixes, from (h, size, node), each once."""
    dealt = prefixes.repartition("h").sortWithinPartitions("h", "size", "node")

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[int] = set()

        def close(sizes: np.ndarray, whole: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for nodes in by_size(sizes, whole) if len(whole) > 1 else ():
                name = xxhash.xxh64_intdigest(nodes.tobytes(), 7)
                if name in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(name)
                # pieces of a large block, two at a time; a block that fits is its only piece
                pieces = np.array_split(nodes, -(-len(nodes) // block))
                for i in range(len(pieces)):
                    for j in range(i + 1 if len(pieces) > 1 else i, len(pieces)):
                        some = np.concatenate([pieces[i], pieces[j]]) if j > i else pieces[i]
                        label = np.full(len(some), xxhash.xxh64_intdigest(some.tobytes(), 7), dtype="<u8").view("<i8")
                        yield label, some

        def batch_of(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in (0, 1)], names=["block", "node"])

        last, held, out = None, [], []
        for batch in batches:
            h, size, node = (batch.column(i).to_numpy() for i in range(3))
            if not len(h):
                continue
            cuts = np.flatnonzero(np.diff(h)) + 1
            for k, (sizes, nodes) in enumerate(zip(np.split(size, cuts), np.split(node, cuts), strict=True)):
                here = h[0] if k == 0 else h[cuts[k - 1]]
                if here != last:
                    if held:
                        for found in close(*map(np.concatenate, zip(*held, strict=True))):
                            out.append(found)
                            if len(out) >= 4096:
                                yield batch_of(out)
                                out = []
                    last, held = here, []
                held.append((sizes, nodes))
        if held:
            out.extend(close(*map(np.concatenate, zip(*held, strict=True))))
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(group, "block long, node long").distinct()


def parts(members: DataFrame) -> DataFrame:
    """(block, node): the distinct parts of the blocks that may be alike, from (block, node, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        last, nodes, sizes, bits, seen = None, [], [], [], set()

        def close() -> list[tuple[int, int]]:
            if len(nodes) < 2:
                return []
            out, named = [], np.array(nodes, dtype=np.int64)
            for part in may_be_alike(bits, np.array(sizes)):
                some = np.sort(named[part])
                label = xxhash.xxh64_intdigest(some.tobytes(), 7)
                if label not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(label)
                    out += [(label - (1 << 64) if label >> 63 else label, x) for x in some.tolist()]
            return out

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["block", "node"])

        for batch in batches:
            found = []
            for name, node, n, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != last:
                    found += close()
                    last, nodes, sizes, bits = name, [], [], []
                nodes.append(node)
                sizes.append(n)
                bits.append(b)
            yield batch_of(found)
        yield batch_of(close())

    return members.repartition("block").sortWithinPartitions("block").select("block", "node", "n", "bits").mapInArrow(run, "block long, node long").distinct()


def links_of(nodes: list[int], sets: list[np.ndarray], tile: int = 4096) -> list[tuple[int, int]]:
    """Links of a forest that joins the sets of one block that are alike."""
    if len(nodes) < 2:
        return []
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    if len(nodes) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(nodes[0], nodes[1])] if alike(both, sizes[0], sizes[1]) else []
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, tile):
        a, b = np.searchsorted(column, [at, at + tile])
        part = np.zeros((len(sets), tile), dtype=np.float32)
        part[row[a:b], column[a:b] - at] = 1
        both += part @ part.T
    near = 9 * both >= 4 * (sizes[:, None] + sizes[None, :])
    left, found = np.ones(len(sets), dtype=bool), []
    for first in range(len(sets)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x] & left).tolist():
                left[y] = False
                found.append((nodes[x], nodes[y]))
                todo.append(y)
    return found


def links(members: DataFrame) -> DataFrame:
    """(u, v) links between alike classes, from (block, node, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nodes, sets = None, [], []

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            found = []
            for name, node, said in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if name != last:
                    found += links_of(nodes, sets)
                    last, nodes, sets = name, [], []
                nodes.append(node)
                sets.append(np.frombuffer(said, dtype="<u8"))
            yield batch_of(found)
        yield batch_of(links_of(nodes, sets))

    return members.repartition("block").sortWithinPartitions("block").select("block", "node", "shingles").mapInArrow(run, "u long, v long")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, block: int = BLOCK, tau: int | None = None) -> DataFrame:
    """One row of each group of documents that links of a Jaccard similarity of 4/5 or more connect, with the columns of docs: that with the least key, nulls last, then with the least hash of the text. With tau, SimHash fingerprints that differ in at most tau bits link too."""
    counts = docs.sparkSession.sparkContext.broadcast(bucket_counts(docs, text, size))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            nodes, sizes, bits, firsts, prints = [], [], [], [], []
            for x in batch.column(3).to_pylist():
                prints.append(0 if tau is None else fingerprint(x))
                said = shingles(x, size)
                nodes.append(xxhash.xxh64_intdigest(said.tobytes(), 1))
                sizes.append(len(said))
                bits.append(parity(said))
                order = np.lexsort((said, counts.value[(said % BUCKETS).astype(np.int64)]))
                firsts.append(said[order[: len(said) - (4 * len(said) + 4) // 5 + 1]].view("<i8"))
            arrays = [pa.array(np.array(nodes, dtype="<u8").view("<i8")), pa.array(sizes, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(np.array(prints, dtype="<u8").view("<i8"))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *arrays], names=["k_id", "k_a", "k_b", "node", "n", "bits", "first", "fp"])

    rows = docs.select(*row_key(key, text), F.col(text).alias("text__"))
    marked = rows.mapInArrow(mark, f"k_id {docs.schema[key].dataType.simpleString()}, k_a long, k_b long, node long, n long, bits binary, first array<long>, fp long")
    # all rows of a class agree in what is taken from the first; texts that only repeat its shingles may have a fingerprint each
    classes = written(marked.groupBy("node").agg(_election().alias("e"), F.collect_set("fp").alias("fps"), *[F.first(c).alias(c) for c in ("n", "bits", "first")]))
    found = written(blocks(classes.select(F.explode("first").alias("h"), size_class(F.col("n")).alias("size"), "node"), block))
    groups = written(parts(found.join(classes.select("node", "n", "bits"), "node")))
    # the sets of the classes that any part holds, by one row of each
    asked = written(classes.select("node", "e").join(groups.select("node").distinct(), "node", "left_semi"))
    linked = _linked(groups, written(_sets_of(docs, asked, key, text, size)))
    if tau is not None:
        linked = linked.union(_of_prints(classes.select("node", F.explode("fps").alias("fp")), tau))
    return _only_rows(docs, written(_elected(classes.select("node", "e"), linked)), key, text)


def _of_prints(prints: DataFrame, tau: int) -> DataFrame:
    """(u, v) links of classes whose fingerprints differ in at most tau bits, from (node, fp): the least class of a fingerprint stands for it."""
    least = written(prints.groupBy("fp").agg(F.min("node").alias("least")))
    same = prints.join(least, "fp").select(F.col("least").alias("u"), F.col("node").alias("v"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}__"))
    near = fingerprint_links(least.select("fp"), tau).join(of("u"), "u").join(of("v"), "v")
    return same.union(near.select("u__", "v__")).filter("u <> v")


def _sets_of(docs: DataFrame, asked: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(node, shingles) of the asked classes."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingles(x, size) for x in batch.column(0).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes(), 1) for x in sets], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "shingles"])

    return _only_rows(docs.select(key, text), asked, key, text).select(text).mapInArrow(whole, "node long, shingles binary")


def _linked(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) links that connect what links in the parts of groups connect.

    A class stands in a part for each rare shingle that it shares, but the largest of them mostly holds all its near
    copies. So each set goes to the largest part first; then only parts that its links leave in pieces are compared.
    """
    sizes = groups.groupBy("block").count()
    largest = groups.join(sizes, "block").groupBy("node").agg(F.max_by("block", F.struct("count", "block")).alias("block"))
    first = written(links(largest.join(sets, "node")))
    label = written(groups.join(connected_components(first), "node", "left").select("block", "node", F.coalesce("component", "node").alias("component")))
    apart = label.groupBy("block").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("block")
    return first.union(links(label.select("block", "node").join(apart, "block").join(sets, "node")))
