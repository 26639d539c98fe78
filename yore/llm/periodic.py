"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with smallest period q, of at least max(LEAST, EXPONENT * q) words, that no neighbouring
word extends. Per batch of texts:

1. Every word of a run stands in it EXPONENT times at least, so a word that is rarer in its stretch is in no run and
   parts the text there. What is left, in pieces of LEAST words or more, becomes one string with a separator of its own
   after each piece; no square holds a separator, so none crosses pieces or texts.
2. Blocks of the Lempel-Ziv factorisation: around the border of each, common extensions to both sides give squares
   that cover the leftmost occurrence of every kind of square (`covering`).
3. These are marked in the suffix tree, and from each mark walks along suffix links, each with one word appended,
   reach the rotations until one is marked already or does not occur: the whole vocabulary (`vocabulary`).
4. Squares with primitive roots are located under their marks; occurrences of one period that start side by side merge
   into runs (`runs_of`).

Extensions compare names of factors whose lengths are powers of two, so a string of n words takes n log n time and
memory. Everything happens within a row; rows are not shuffled and no text waits for another task. Null and empty texts
have no words and no runs; repeated rows give the same each; an empty table gives an empty table; a very long text is
handled whole. Columns named runs, n_words or collapsed are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.llm.common import SPACED, let, table
from yore.llm.quality import words_of

LEAST, EXPONENT = 6, 4
#: Words of pieces that go into one string, and characters of texts that a task holds as words; a longer piece or text goes alone.
STRING, HELD = 1 << 16, 1 << 22
#: After so many rounds of parting, what is left is taken as it is.
ROUNDS = 12
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")])


class Factors:
    """Names of the factors of a string whose lengths are powers of two; the string's last symbol must be its own. `order` has the suffixes sorted, `rank` their places."""

    def __init__(self, string: np.ndarray):
        n = len(string)
        name = np.unique(string, return_inverse=True)[1].astype(np.int64)
        self.names, length = [], 1
        while True:
            self.names.append(np.append(name, -1).astype(np.int32))
            following = np.full(n, -1, np.int64)
            if length < n:
                following[: n - length] = name[length:]
            key = name * (n + 1) + following + 1
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            name = np.empty(n, np.int64)
            name[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
            length *= 2
            if name[order[-1]] == n - 1:
                self.order, self.rank, self.n = order, name, n
                return

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal; i and j differ."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names = self.names[level]
            step = (names[np.minimum(i, self.n)] == names[np.minimum(j, self.n)]) & (i < self.n) & (j < self.n)
            step = step.astype(np.int64) << level
            i, j, found = i + step, j + step, found + step
        return found

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j are equal, these included; i and j differ, -1 has none."""
        i, j, found = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            names, back = self.names[level], (1 << level) - 1
            a, b = i - back, j - back
            step = ((a >= 0) & (b >= 0) & (names[np.maximum(a, 0)] == names[np.maximum(b, 0)])).astype(np.int64) << level
            i, j, found = i - step, j - step, found + step
        return found


def blocks(f: Factors) -> np.ndarray:
    """Where the Lempel-Ziv blocks start: each is the longest factor that starts earlier too, or one new symbol."""
    order = f.order.tolist()
    before, after, stack = [-1] * f.n, [-1] * f.n, []
    for at in order:  # nearest earlier starts on both sides among the sorted suffixes
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1] if stack else -1
        stack.append(at)
    at = np.arange(f.n)
    longest = np.zeros(f.n, np.int64)
    for near in map(np.array, (before, after)):
        has = near >= 0
        longest[has] = np.maximum(longest[has], f.forward(at[has], near[has]))
    longest, starts, h = longest.tolist(), [], 0
    while h < f.n:
        starts.append(h)
        h += max(1, longest[h])
    return np.array(starts)


def covering(f: Factors, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares, among them, for every kind of square, one from which steps to the right along the same period lead to its leftmost occurrence."""
    ends = np.append(starts[1:], f.n)
    size = ends - starts
    reach = size + np.append(size[1:], 0)
    found = []

    def counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(sizes)), sizes)
        return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1

    # squares that start in the block, whose left half ends in it and whose right half takes in the next block's first symbol
    of, k = counted(size)
    h, q = ends[of], ends[of] - k
    fits = np.flatnonzero((h < f.n) & (f.names[0][np.minimum(h, f.n)] == f.names[0][q]))
    h, q, k = h[fits], q[fits], k[fits]
    right, left = f.forward(h, q), f.backward(h - 1, q - 1)
    fits = right + left >= k
    found.append((np.maximum(q - left, q - k + 1)[fits], k[fits]))

    # squares that start before the block and whose left half ends in it
    of, k = counted(reach)
    h, q, end = starts[of], starts[of] + k, ends[of]
    fits = np.flatnonzero((h > 0) & (q < f.n) & (f.names[0][h] == f.names[0][np.minimum(q, f.n)]) & (f.names[0][h - 1] == f.names[0][q - 1]))
    h, q, k, end = h[fits], q[fits], k[fits], end[fits]
    right, left = f.forward(h, q), f.backward(h - 1, q - 1)
    start = np.maximum(h - left, h - k + 1)
    fits = (right + left >= k) & (start + k <= end)
    found.append((start[fits], k[fits]))
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Tree:
    """The suffix tree. Nodes: leaf k is the k-th suffix of the order, inner nodes follow, the root is the first of them. first and last: a node's range in the order."""

    def __init__(self, string: np.ndarray, f: Factors):
        n, self.root = f.n, f.n
        shared = [0, *f.forward(f.order[:-1], f.order[1:]).tolist(), -1]
        depth, first, last = [*(n - f.order).tolist(), 0], [*range(n), 0], [*range(n), n - 1]
        parent, stack = [n] * (n + 1), [n]
        for k in range(1, n + 1):
            below, h = k - 1, shared[k]
            while stack and depth[stack[-1]] > h:
                v = stack.pop()
                last[v], parent[below], below = k - 1, v, v
            if h < 0:
                break
            if depth[stack[-1]] < h:
                depth.append(h)
                first.append(first[below])
                last.append(k - 1)
                parent.append(n)
                stack.append(len(depth) - 1)
            parent[below] = stack[-1]
        parent[n] = n
        self.depth, self.first, self.last, self.parent = depth, first, last, parent
        self.symbols, self.order = string.tolist(), f.order.tolist()
        self.base = len(self.symbols) + int(string.max()) + 1
        up, at = np.array(parent), f.order[np.array(first)]
        keys = up * self.base + string[np.minimum(at + np.array(depth)[up], n - 1)]
        self.child = dict(zip(keys.tolist(), count()))
        del self.child[keys[n].item()]  # the root's own
        self.child.update(zip(keys[n + 1 :].tolist(), count(n + 1)))
        self.child.update(zip(keys[:n].tolist(), range(n)))
        self.links()

    def links(self) -> None:
        """The suffix link of every inner node, from its parent's."""
        n, depth, parent, order, first = self.root, self.depth, self.parent, self.order, self.first
        self.link = {n: n}
        for v in (np.argsort(np.array(depth[n:]), kind="stable") + n).tolist():
            if v != n:
                self.link[v] = self.down(self.link[parent[v]], max(depth[parent[v]] - 1, 0), order[first[v]] + 1, depth[v] - 1)

    def down(self, node: int, matched: int, at: int, length: int) -> int:
        """The first node with `length` symbols or more on the way of the symbols from `at` on; node has `matched` of them."""
        child, symbols, depth, base = self.child, self.symbols, self.depth, self.base
        while matched < length:
            node = child[node * base + symbols[at + matched]]
            matched = depth[node]
        return node

    def at(self, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The node on or above whose edge end the factors end."""
        depth, node = np.array(self.depth), rank[start]
        ups = [np.array(self.parent, np.int32)]
        while (ups[-1] != self.root).any():
            ups.append(ups[-1][ups[-1]])
        for up in reversed(ups):
            higher = up[node]
            node = np.where(depth[higher] >= length, higher, node)
        return node

    def rotated(self, node: int, length: int) -> int | None:
        """Where the factor that ends at node ends up if its first symbol goes to its end; None if that doesn't occur."""
        at, up = self.order[self.first[node]], self.parent[node]
        a = self.symbols[at]
        to = self.down(self.link[up], max(self.depth[up] - 1, 0), at + 1, length - 1)
        if self.depth[to] == length - 1:
            return self.child.get(to * self.base + a)
        return to if self.symbols[self.order[self.first[to]] + length - 1] == a else None


def vocabulary(tree: Tree, f: Factors, start: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, period) of every kind of square, from a leftmost covering set."""
    marks = set(zip(tree.at(start, 2 * period, f.rank).tolist(), period.tolist()))
    for node, p in list(marks):
        while (node := tree.rotated(node, 2 * p)) is not None and (node, p) not in marks:
            marks.add((node, p))
    found = np.array(sorted(marks), np.int64).reshape(-1, 2)
    return found[:, 0], found[:, 1]


def primitive(f: Factors, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether the squares that start there have no smaller period that divides theirs: none by a prime less."""
    least = np.arange(int(period.max()) + 1 if len(period) else 1)
    for r in range(2, int(len(least) ** 0.5) + 1):
        if least[r] == r:
            of = least[r * r :: r]
            of[of == np.arange(r * r, len(least), r)] = r
    sound, rest = np.ones(len(at), bool), period.copy()
    while (todo := np.flatnonzero((rest > 1) & sound)).size:
        r, p, i = least[rest[todo]], period[todo], at[todo]
        sound[todo] = f.forward(i, i + p // r) < 2 * p - p // r
        rest[todo] //= r
    return sound


def runs_of(string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal repetitions, of exponent 2 or more, of a string whose last symbol is its own."""
    f = Factors(string)
    start, period = covering(f, blocks(f))
    if not len(start):
        return start, start, start
    tree = Tree(string, f)
    node, period = vocabulary(tree, f, start, period)
    first, last = np.array(tree.first)[node], np.array(tree.last)[node]
    sound = primitive(f, f.order[first], period)
    first, last, period = first[sound], last[sound], period[sound]
    times = last - first + 1
    at = f.order[np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())]
    key = np.sort(np.repeat(period, times) * (f.n + 1) + at)
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1] + 1))
    tail = np.append(head[1:], len(key)) - 1
    period, start = key[head] // (f.n + 1), key[head] % (f.n + 1)
    return start, key[tail] - key[head] + 2 * period, period


def pieces(words: np.ndarray, text: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, piece, word) of what runs can be in. text: the number of each word's text, rising; words are named apart from other texts'."""
    place, piece, n = np.arange(len(words)), text, -1
    for _ in range(ROUNDS):
        if len(place) == n:
            break
        n = len(place)
        if n == len(text):
            often = np.bincount(words)[words] >= exponent
        else:
            words, times = np.unique(piece * (int(words.max(initial=0)) + 1) + words, return_inverse=True, return_counts=True)[1:]
            often = times[words] >= exponent
        place, piece, words = place[often], piece[often], words[often]
        if not len(place):
            break
        piece = np.cumsum(np.append(False, (np.diff(place) != 1) | (np.diff(piece) != 0)))
        long = np.bincount(piece)[piece] >= least
        place, piece, words = place[long], piece[long], words[long]
    return place, piece, words


def runs_of_texts(texts: list[list], least: int = LEAST, exponent: int = EXPONENT) -> list[list[tuple[int, int, int]]]:
    """For each list of words the (start, length, period) of its runs, sorted by start, then period."""
    named, known = [], 0
    for words in texts:
        names = dict(zip(dict.fromkeys(words), count(known)))
        known += len(names)
        named.append(np.fromiter(map(names.__getitem__, words), np.int64, len(words)))
    sizes = [len(x) for x in named]
    begin = np.cumsum([0, *sizes])
    place, piece, word = pieces(np.concatenate([*named, np.zeros(0, np.int64)]), np.repeat(np.arange(len(texts)), sizes), least, exponent)
    found: list[list] = [[] for _ in texts]
    heads = np.flatnonzero(np.diff(piece, prepend=-1)) if len(piece) else np.zeros(0, np.int64)
    at = 0
    while at < len(heads):
        to = max(at + 1, int(np.searchsorted(heads, heads[at] + STRING, "right")) - 1 if heads[-1] > heads[at] + STRING else len(heads))
        low, high = heads[at], heads[to] if to < len(heads) else len(place)
        # a separator after every piece: symbols of a piece move right by the pieces before it
        shift = np.cumsum(np.diff(piece[low:high], prepend=piece[low]) != 0)
        n = high - low + to - at
        string = np.full(n, -1, np.int64)
        where = np.arange(high - low) + shift
        string[where] = np.unique(piece[low:high] * (int(word.max()) + 1) + word[low:high], return_inverse=True)[1]
        gaps = np.flatnonzero(string < 0)
        string[gaps] = int(string.max()) + 1 + np.arange(len(gaps))
        back = np.zeros(n, np.int64)
        back[where] = place[low:high]
        start, length, period = runs_of(string)
        fits = length >= np.maximum(least, exponent * period)
        start = back[start[fits]]
        of = np.searchsorted(begin, start, "right") - 1
        for t, *run in zip(of.tolist(), (start - begin[of]).tolist(), length[fits].tolist(), period[fits].tolist()):
            found[t].append(tuple(run))
        at = to
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in found]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period."""
    if runs:
        drop = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            drop[start + period] += 1
            drop[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(drop).tolist(), strict=False) if not d]
    return " ".join(words)


def find(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs with n_words, runs (structs of start, length and period in words, sorted by start and period) and collapsed: the text with every run cut to its first period, words joined by one space. Columns in `drop` are not returned."""
    new = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c not in new and c not in drop]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    rows = docs.select(*keep, F.col(text).alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(len(keep))), 0).to_numpy(zero_copy_only=False)
            group = np.cumsum(sizes, dtype=np.int64) // HELD
            for k in np.unique(group).tolist():
                low, high = np.searchsorted(group, [k, k + 1]).tolist()
                part = batch.slice(low, high - low)
                texts = [WORD.findall(x or "") for x in part.column(len(keep)).to_pylist()]
                runs = runs_of_texts(texts, least, exponent)
                said = [collapsed(w, r) for w, r in zip(texts, runs, strict=True)]
                kind = pa.list_(pa.field("element", pa.struct([pa.field(c, pa.int64(), False) for c in RUN.names]), False))
                found = [pa.array([len(w) for w in texts], pa.int64()), pa.array([[dict(zip(RUN.names, r)) for r in x] for x in runs], kind), pa.array(said, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *found], names=[*keep, *new])

    return rows.mapInArrow(run, schema)


def repeating(doc_id: Column, text: Column) -> Column:
    """The text that the query judges: where crc32(doc_id) is a multiple of 10, its words from some place on repeat with some period. A null doc_id changes nothing."""

    def changed(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(F.crc32(doc_id.cast("string")) / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    some = text.rlike(SPACED)
    return F.when((F.crc32(doc_id.cast("string")) % 10 == 0) & some, let(words_of(text), changed)).otherwise(text)


def op11_runs(spark, sf_dir: str) -> DataFrame:
    """Per document the number of runs, its longest run, and digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("doc_id"), F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = find(docs, drop=("text",)).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
