"""Exact removal of long repeats by a sparse, enhanced suffix array.

A string of LENGTH bytes that occurs twice has the same minimiser in both places: the k-gram of GRAM bytes in it whose
hash is least. So only minimisers (about one byte in eighty) are suffixes to compare, and only those whose k-gram is
not unique. A suffix's context is what any window of LENGTH bytes around it can hold: LENGTH - GRAM bytes before and
after the k-gram. Contexts that are equal as a whole are counted by their hash and need no bytes. Any other repeat holds
at least half of those bytes on one side, so contexts meet by k-gram and the hash of the half before or after it, and
those that meet none are done. The bytes of the others, one of each distinct context, come together: they are sorted by
what follows, a stack scan over the longest common prefixes of neighbours gives the interval tree, and in each interval
the same scan over what comes before gives the groups that agree to the left; groups whose members differ in the next
byte on both sides are the maximal repeats, with all their occurrences. What lies in a repeat of LENGTH bytes or more is
covered.

A group of MOST distinct contexts has some 5 MB of bytes and takes a task seconds. Groups of more do not come together:
their windows are counted one by one, some 160 rows a context, which splits over any number of tasks. Places that follow each other with equal k-grams and
contexts, as in a ruled line, are one row. Texts are identified by 128 bits of hash, so copies are
compared once and share their result. Null texts are empty, and texts of fewer than LENGTH bytes keep all; repeated
rows cover each other like any copies; ties do not matter; an empty table gives an empty table. Very long texts are
hashed CHUNK bytes at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yore.llm.common import release, table, written

LENGTH, GRAM, MOST = 200, 40, 1 << 14
#: Bytes that are hashed at a time; longer texts go in overlapping pieces.
CHUNK = 1 << 20
_STEP = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2 ** 64


class Anchors:
    """Finds the minimisers of a text, with hashes of their k-grams and contexts."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram, self.window, self.side = length, gram, length - gram + 1, length - gram
        self.value = np.random.default_rng(2024).integers(1, 1 << 63, 256, dtype=np.uint64)
        n = CHUNK + 4 * length + 2
        self.up, self.down = np.full(n, _STEP, np.uint64), np.full(n, pow(_STEP, -1, 1 << 64), np.uint64)
        self.up[0] = self.down[0] = 1
        np.multiply.accumulate(self.up, out=self.up)
        np.multiply.accumulate(self.down, out=self.down)

    @staticmethod
    def _mix(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def find(self, data: np.ndarray, halves: bool = False) -> tuple[np.ndarray, ...]:
        """(positions, hashes of k-grams, of contexts) of a text's bytes and, with halves, of the half before and the half after, zero where the text is too short."""
        found = [self._piece(data, at, halves) for at in range(0, max(1, len(data) - self.length + 1), CHUNK)]
        pos = np.concatenate([x[0] for x in found])
        keep = np.diff(pos, prepend=-1) > 0  # pieces overlap
        return tuple(np.concatenate([x[i] for x in found])[keep] for i in range(3 + 2 * halves))

    def _piece(self, data: np.ndarray, at: int, halves: bool) -> tuple[np.ndarray, ...]:
        """Minimisers of the windows that start in [at, at + CHUNK)."""
        first = max(0, at - self.length)  # contexts reach before and after the piece
        end = min(len(data), at + CHUNK + self.length - 1)
        last = min(len(data), end + self.length)
        if end - at < self.length:
            return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * (2 + 2 * halves)
        part = data[first:last]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(self.value[part] * self.up[: len(part)], out=sums[1:])
        a, b = at - first, end - first
        h = self._mix((sums[a + self.gram : b + 1] - sums[a : b - self.gram + 1]) * self.down[a : b - self.gram + 1])
        low = np.uint64(2 * CHUNK - 1)
        m, w = len(h), self.window
        key = np.full(m + -m % w, np.uint64(2**64 - 1))
        key[:m] = (h & ~low) | np.arange(m, dtype=np.uint64)
        key = key.reshape(-1, w)
        before = np.minimum.accumulate(key, axis=1).ravel()
        after = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        pos = (np.minimum(after[: m - w + 1], before[w - 1 : m]) & low).astype(np.int64)
        pos = pos[np.flatnonzero(np.diff(pos, prepend=-1))]
        left, right = np.maximum(pos + a - self.side, 0), np.minimum(pos + a + self.length, len(part))
        context = (sums[right] - sums[left]) * self.down[left]
        sizes = ((pos + a - left) * 1000 + (right - pos - a)).astype(np.uint64)
        if not halves:
            return pos + at, h[pos], self._mix(context ^ self._mix(sizes * np.uint64(_STEP)))
        half = self.side // 2
        here, past = pos + a, pos + a + self.gram

        def of(start: np.ndarray, end: np.ndarray, fits: np.ndarray) -> np.ndarray:
            start, end = np.where(fits, start, 0), np.where(fits, end, 0)
            return np.where(fits, self._mix((sums[end] - sums[start]) * self.down[start]), np.uint64(0))

        before, after = of(here - half, here, here >= half), of(past, past + half, past + half <= len(part))
        return pos + at, h[pos], self._mix(context ^ self._mix(sizes * np.uint64(_STEP))), before, after


def shared(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "little") ^ int.from_bytes(b[:m], "little")
    return m if not x else ((x & -x).bit_length() - 1) >> 3


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of every interval of the tree over neighbours' common prefixes, of depth `least` and more. lcp[i]: of i and i + 1. A stack scan: an interval ends where the prefix gets shorter."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            yield d, first, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def maximal_repeats(contexts: list[tuple[bytes, bytes]], need: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, left, right): the groups of contexts (what is before, reversed; what is after) that agree in exactly so many bytes on either side, together `need` or more. Members are all that agree."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i][1])
    lcp = [shared(contexts[i][1], contexts[j][1]) for i, j in zip(order, order[1:], strict=False)]
    longest = max((len(x[0]) for x in contexts), default=0)
    for right, first, last in intervals(lcp, max(0, need - longest)):
        child, n = {}, 0  # members in one child agree in more bytes on the right
        for p in range(first, last + 1):
            n += p > first and lcp[p - 1] == right
            child[order[p]] = n
        inner = sorted(order[first : last + 1], key=lambda i: contexts[i][0])
        backward = [shared(contexts[i][0], contexts[j][0]) for i, j in zip(inner, inner[1:], strict=False)]
        for left, a, b in intervals(backward, max(0, need - right)):
            members = inner[a : b + 1]
            if any(child[x] != child[members[0]] for x in members):
                yield members, left, right


def anchors(texts: DataFrame, length: int, gram: int, halves: bool = False) -> DataFrame:
    """(h, x, k_a, k_b, pos, last, n): k-gram, context, text and place of every minimiser; with halves also the hashes of half the bytes before and after it.

    A run of minimisers that agree in k-gram and context, as in a ruled line, is one row with the first place, the last
    one and their number: places that follow each other are never further apart than a repeat reaches.
    """
    names = ["h", "x", "k_a", "k_b", "pos", "last", "n", *(["half_before", "half_after"] if halves else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Anchors(length, gram).find
        for batch in batches:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            rows: list[list] = [[] for _ in names]
            size = 0
            for i, value in enumerate(batch.column(2)):
                data = np.frombuffer(value.as_buffer() or b"", np.uint8)
                if len(data) >= length:
                    pos, h, x, *both = (y.view(np.int64) for y in find(data, halves))
                    first = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]))))
                    n, m = np.diff(first, append=len(pos)), len(first)
                    for to, got in zip(rows, (h[first], x[first], np.full(m, a[i]), np.full(m, b[i]), pos[first], pos[first + n - 1], n, *(y[first] for y in both)), strict=True):
                        to.append(got)
                    size += m
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=names)
                    rows, size = [[] for _ in names], 0
            if size:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], names=names)

    return texts.filter(F.octet_length("text") >= length).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeated_anchors(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The rows of anchors() whose k-gram occurs again, with `mixed`: whether its contexts differ."""
    counts = anchors(texts, length, gram).groupBy("h").agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # a table of its own: joined straight to the aggregate, a k-gram with a large share of all rows could not be split
    again = written(counts.filter("n > 1").select("h", (F.col("lo") != F.col("hi")).alias("mixed")))
    return written(anchors(texts, length, gram, halves=True).join(again, "h"))


GROUP = ["h", "side", "half"]


def meeting(distinct: DataFrame, lone: bool = True) -> DataFrame:
    """Rows of distinct contexts in groups (h, side, half, size) of two or more of which, with lone, at least one is alone. A context can be in a group for each side."""
    each = distinct.select(
        "h", "x", "c", "k_a", "k_b", "pos",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("half_before").alias("half")), F.struct(F.lit(1).alias("side"), F.col("half_after").alias("half")))).alias("g"),
    ).select("h", "g.side", "g.half", "x", "c", "k_a", "k_b", "pos").filter("half <> 0")
    sizes = each.groupBy(*GROUP).agg(F.count("*").alias("size"), F.min("c").alias("c")).filter("size > 1 and c = 1" if lone else "size > 1").drop("c")
    return each.join(written(sizes), GROUP)


def contexts_of(texts: DataFrame, docs_key: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, side, half, x, c, size, before, after) of the wanted contexts, whose k_a, k_b and pos say where one is. docs_key: one row of each text, with a row id."""
    side = length - gram
    lists = wanted.groupBy("k_a", "k_b").agg(F.collect_list(F.struct("pos", "h", "side", "half", "x", "c", "size")).alias("places"))
    lists = lists.join(docs_key, ["k_a", "k_b"])
    rows = texts.join(lists, (texts.k_a == lists.k_a) & (texts.k_b == lists.k_b) & texts.id.eqNullSafe(lists.least)).select("text", "places")
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary()]
    names = [*GROUP, "x", "c", "size", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for value, places in zip(batch.column(0), batch.column(1), strict=True):
                data = value.as_buffer().to_pybytes()
                for p in places.as_py():
                    at = p["pos"]
                    out.append((p["h"], p["side"], p["half"], p["x"], p["c"], p["size"], data[max(0, at - side) : at][::-1], data[at + gram : at + length]))
                if len(out) > 20_000:
                    yield told(out)
                    out = []
            if out:
                yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "h long, side int, half long, x long, c long, size long, before binary, after binary")


def _groups_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(group, (x, c, before, after) of its contexts) of rows that come sorted by group; a group has at most MOST distinct contexts."""
    group, rows = None, {}
    for batch in batches:
        for h, side, half, x, c, _, before, after in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (h, side, half) != group:
                if rows:
                    yield group, list(rows.values())
                group, rows = (h, side, half), {}
            rows[x] = (x, c, before, after)
    if rows:
        yield group, list(rows.values())


def _by_group(contexts: DataFrame, rows_of, names: list[str]) -> DataFrame:
    """rows_of(group, contexts) of each group, one group at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for group, rows in _groups_in(batches):
            for row in rows_of(group, rows):
                out.append(row)
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return contexts.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def repeats(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, side, half, repeat, x, left, right): the members of the maximal repeats of each group; `repeat` numbers them in it."""

    def rows_of(group, rows):
        for n, (members, left, right) in enumerate(maximal_repeats([row[2:] for row in rows], length - gram)):
            yield from ((*group, n, rows[i][0], left, gram + right) for i in members)

    return _by_group(contexts, rows_of, [*GROUP, "repeat", "x", "left", "right"])


def reaches(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, x, left, right): how far repeats cover before and after a k-gram, of contexts that occur once."""

    def rows_of(group, rows):
        left, right = [-1] * len(rows), [-1] * len(rows)
        for members, l, r in maximal_repeats([row[2:] for row in rows], length - gram):
            for i in members:
                left[i], right[i] = max(left[i], l), max(right[i], r)
        yield from ((group[0], row[0], l, gram + r) for row, l, r in zip(rows, left, right, strict=True) if l >= 0 and row[1] == 1)

    return _by_group(contexts, rows_of, ["h", "x", "left", "right"])


def windows_of(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, side, half, x, c, l, w, v): every window of every context, by the bytes before the k-gram and 128 bits of hash."""
    side = length - gram
    at = contexts.select(*GROUP, "x", "c", "before", "after", F.explode(F.sequence(F.lit(0), F.lit(side))).alias("l"))
    fits = (F.octet_length("before") >= F.col("l")) & (F.octet_length("after") >= side - F.col("l"))
    piece = F.concat(F.substring("before", F.lit(1), F.col("l")), F.substring("after", F.lit(1), side - F.col("l")))
    return at.filter(fits).select(*GROUP, "x", "c", "l", F.xxhash64(piece).alias("w"), F.xxhash64(piece, F.lit(1)).alias("v"))


def reaches_by_window(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """What reaches() gives, by counting every window; for groups of too many contexts to come together."""
    windows = windows_of(contexts, length, gram)
    often = windows.groupBy(*GROUP, "l", "w", "v").agg(F.sum("c").alias("n")).filter("n > 1").drop("n")
    met = windows.filter("c = 1").join(written(often), [*GROUP, "l", "w", "v"])
    return met.groupBy("h", "x").agg(F.max("l").cast("long").alias("left"), F.max(F.lit(length) - F.col("l")).cast("long").alias("right"))


def repeats_by_window(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """What repeats() gives, cut into windows: a repeat for each window that two or more contexts have."""
    windows = windows_of(contexts, length, gram)
    often = windows.groupBy(*GROUP, "l", "w", "v").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    met = windows.join(written(often), [*GROUP, "l", "w", "v"])
    return met.select(*GROUP, F.xxhash64("l", "w", "v").alias("repeat"), "x", F.col("l").cast("long").alias("left"), (F.lit(length) - F.col("l")).cast("long").alias("right"))


def prepared(docs: DataFrame, key: str, text: str, length: int, gram: int, lone: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repeated_anchors(), distinct contexts of k-grams with more than one, with their count c, contexts_of() those that may repeat in part)."""
    texts = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("k_a"), F.xxhash64(F.col(text), F.lit(1)).alias("k_b"), F.col(text).alias("text"))
    found = repeated_anchors(texts.select("k_a", "k_b", "text"), length, gram)
    release(docs.sparkSession)
    first = F.min(F.struct("k_a", "k_b", "pos", "half_before", "half_after"))
    distinct = written(found.filter("mixed").groupBy("h", "x").agg(F.sum("n").alias("c"), first.alias("at")).select("h", "x", "c", "at.*"))
    one = texts.groupBy("k_a", "k_b").agg(F.min("id").alias("least"))
    contexts = written(contexts_of(texts, one, meeting(distinct, lone), length, gram))
    release(docs.sparkSession)
    return found, distinct, contexts


def covered(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(k_a, k_b, spans): of each text with repeats, the byte ranges (start, end) that they cover; ranges may overlap and reach beyond the text."""
    side = length - gram
    found, distinct, contexts = prepared(docs, key, text, length, gram)
    reach = reaches(contexts.filter(F.col("size") <= most), length, gram)
    if contexts.filter(F.col("size") > most).limit(1).count():
        reach = reach.union(reaches_by_window(contexts.filter(F.col("size") > most), length, gram))
    twice = distinct.filter("c > 1").select("h", "x", F.lit(side).cast("long").alias("left"), F.lit(length).cast("long").alias("right"))
    partly = found.filter("mixed").join(reach.union(twice), ["h", "x"]).select("k_a", "k_b", (F.col("pos") - F.col("left")).alias("start"), (F.col("last") + F.col("right")).alias("end"))
    wholly = found.filter("not mixed").select("k_a", "k_b", (F.col("pos") - side).alias("start"), (F.col("last") + length).alias("end"))
    return wholly.union(partly).groupBy("k_a", "k_b").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def repeat_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(h, side, half, repeat, k_a, k_b, start, end, times, last_start): every occurrence of every maximal repeat, as far as a k-gram's context reaches, which is every window around it.

    The first four name a group. Side 0 and 1: contexts that agree in part; where more than `most` do, a group for each
    window instead of each maximal repeat. Side 2: contexts that are equal as a whole (half is their hash). A run of
    `times` occurrences in equal steps, as in a ruled line, is one row with the last one's start. One long repeat appears
    once for each k-gram in it.
    """
    side = length - gram
    found, distinct, contexts = prepared(docs, key, text, length, gram, lone=False)
    members = repeats(contexts.filter(F.col("size") <= most), length, gram).union(repeats_by_window(contexts.filter(F.col("size") > most), length, gram))
    partly = found.filter("mixed").join(members, ["h", "x"]).select(
        *[F.col(c).cast("long") for c in (*GROUP, "repeat")], "k_a", "k_b", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end"), F.col("n").alias("times"), (F.col("last") - F.col("left")).alias("last_start")
    )
    equal = found.filter("not mixed").drop("mixed").unionByName(found.filter("mixed").drop("mixed").join(distinct.filter("c > 1").select("h", "x"), ["h", "x"], "left_semi"))
    sizes = docs.select(F.xxhash64(text).alias("k_a"), F.xxhash64(F.col(text), F.lit(1)).alias("k_b"), F.octet_length(text).alias("size")).distinct()
    start = F.greatest(F.col("pos") - side, F.lit(0))
    wholly = equal.join(sizes, ["k_a", "k_b"]).select(
        "h", F.lit(2).cast("long").alias("side"), F.col("x").alias("half"), F.lit(0).cast("long").alias("repeat"), "k_a", "k_b", start.alias("start"), F.least(F.col("pos") + length, F.col("size")).alias("end"), F.col("n").alias("times"), (F.col("last") - F.col("pos") + start).alias("last_start")
    )
    return partly.union(wholly)


def merged(spans: list[tuple[int, int]] | None, size: int) -> list[tuple[int, int]]:
    """Ranges within [0, size), joined where they touch."""
    out: list[list[int]] = []
    for a, b in sorted(spans or ()):
        a, b = max(a, 0), min(b, size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = False, **how) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, spans (byte ranges removed) and kept (the bytes left), which replace columns of these names; or with digest only key, the counts and kept_sha256."""
    spans = covered(docs, key, text, **how)
    spans = written(spans)
    release(docs.sparkSession)
    left = docs.select(key, text) if digest else docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept")
    left = left.withColumns({"k_a__": F.xxhash64(text), "k_b__": F.xxhash64(F.col(text), F.lit(1))})
    rows = left.join(spans.select(F.col("k_a").alias("k_a__"), F.col("k_b").alias("k_b__"), F.col("spans").alias("spans__")), ["k_a__", "k_b__"], "left").drop("k_a__", "k_b__")
    names = [c for c in left.columns if c not in ("k_a__", "k_b__")]
    keep = [key] if digest else names
    kinds = dict(docs.dtypes)
    added = "n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "spans array<struct<start:bigint,end:bigint>>, kept binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            out: list[list] = [[], [], [], [], []]
            for value, found in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                ranges = merged([(x["start"], x["end"]) for x in found.as_py() or ()], len(data))
                kept, last = [], 0
                for a, b in ranges:
                    kept.append(data[last:a])
                    last = b
                rest = b"".join([*kept, data[last:]])
                row = (len(data), len(data) - len(rest), len(ranges), hashlib.sha256(rest).hexdigest() if digest else [{"start": a, "end": b} for a, b in ranges], rest)
                for to, x in zip(out, row, strict=True):
                    to.append(x)
            cols = [pa.array(x, pa.int64()) for x in out[:3]]
            cols += [pa.array(out[3], pa.string())] if digest else [pa.array(out[3], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], *cols], names=[*keep, "n_bytes", "n_removed", "n_spans", *(["kept_sha256"] if digest else ["spans", "kept"])])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + added)


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
