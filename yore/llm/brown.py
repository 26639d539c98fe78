"""Language-model scores from Brown classes.

Tokens are the words of a text and one end. Every word of the training texts has a class of its own choice, by the exact
gain of exchange clustering. The SEEDS most frequent words start from an exchange among themselves, the common words
beyond them where their neighbours' classes make them likeliest. Then, in MOVES rounds, all of them are exchanged with
all common words as partners: the seeds one after the other, the others in Spark and all at once, as in distributed
exchange clustering (Uszkoreit and Brants, 2008); a last round that lowers the likelihood is taken back. At last every other
word, however rare, goes where the gain is greatest. The model's probability of a token is the smoothed
probability of its class after the class before it (the end stands before the first token) times the smoothed
probability of the word in its class. A word that the
training texts do not have takes the class that most rare words of its ending have.

Words are counted over all training texts and stay distributed, and so do the classes of all but the COMMON most
frequent words, whose words (a digest beyond 64 bytes), counts and classes are broadcast, a fixed bound. They are the hot
ones, so what is left spreads evenly, and every other word meets its count and class in a join. The driver holds classes
x classes numbers. Neighbours' classes are counted for every word, transitions over every pair of tokens.

Null texts are empty: the end alone. Repeated rows are scored once and returned as often; a null id counts as training.
Without any training text, every token is unseen. An empty table gives an empty table. Very long texts and words are
read whole. Ties between classes go to the first. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yore.llm.common import cut, table, written

SEEDS, CLASSES, ROUNDS, MOVES, COMMON, FOLDS, HELD_OUT = 500, 40, 6, 1, 200_000, 5, 1
#: Slots that a level of equally frequent words is cut by.
SLOTS = 4096
#: Buckets of the endings that place unseen words; words of a row of neighbour counts.
ENDINGS, BLOCK = 4096, 8
#: Tokens that are looked at together.
LINE = 200_000
END = b"\n"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: A class and side, and how often; so there are 128 classes at most.
_TIMES = np.dtype([("key", "u1"), ("n", "<u4")])


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def name_of(word: bytes) -> bytes:
    """What stands for a word in the broadcast table: itself or, of over 64 bytes, a digest that no word equals."""
    return word if len(word) <= 64 else END + hashlib.sha256(word).hexdigest().encode()


def ending(word: bytes) -> int:
    """The number of a word's ending: its last three bytes."""
    return zlib.crc32(word[-3:]) % ENDINGS


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, the end included. Each task adds up what it has read before anything moves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def told(counts: Counter) -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string()), pa.array([counts[w] for w in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                seen.update(words_of(x))
                seen[END] += 1
                if len(seen) > 600_000:
                    yield from told(seen)
                    seen = Counter()
        yield from told(seen)

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def numbers_of(words: list[bytes], common: dict[bytes, int]) -> np.ndarray:
    """The common words' numbers, -1 for others."""
    at = np.fromiter(map(common.get, words, repeat(-1)), np.int64, len(words))
    for j in np.flatnonzero(at < 0).tolist():
        if len(words[j]) > 64:
            at[j] = common.get(name_of(words[j]), -1)
    return at


def lines_of(texts: Iterable[str | None], most: int = LINE) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(tokens, how many of each text) of some texts at a time, in order, each text's end last; `most` tokens or one text more."""
    line: list[bytes] = []
    sizes: list[int] = []
    for x in texts:
        before = len(line)
        line += words_of(x)
        line.append(END)
        sizes.append(len(line) - before)
        if len(line) >= most:
            yield line, np.array(sizes)
            line, sizes = [], []
    if line:
        yield line, np.array(sizes)


def beside(of: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before and after each token of a line: the end stands before a text's first word as well as after its last."""
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    left, right = np.roll(of, 1), np.roll(of, -1)
    left[starts], right[ends] = of[ends], of[starts]
    return left, right


def numbered(docs: DataFrame, common: dict[bytes, int], text: str = "text") -> DataFrame:
    """(ids, others) of every text, so that later passes read no text: its tokens' numbers (int32; -1 for words that are not common) and those other words in order, parted by spaces."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, sizes in lines_of(batch.column(0).to_pylist()):
                at = numbers_of(line, shared.value).astype("<i4")
                cuts = [0, *np.cumsum(sizes).tolist()]
                far = np.flatnonzero(at < 0)
                others, parts = [line[j] for j in far.tolist()], np.searchsorted(far, cuts).tolist()
                told = [[at[a:b].tobytes() for a, b in pairwise(cuts)], [b" ".join(others[a:b]) for a, b in pairwise(parts)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in told], names=["ids", "others"])

    return docs.select(text).mapInArrow(run, "ids binary, others binary")


def numbered_lines(batch: pa.RecordBatch, most: int = LINE) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(numbers, how many of each text, the words of those that are -1) of some of numbered()'s texts at a time; `most` tokens or one text more."""
    ids = batch.column(0)
    if not len(ids):
        return
    cuts = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, ids.offset * 4) // 4
    whole = np.frombuffer(ids.buffers()[2], "<i4", int(cuts[-1]))
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(cuts, cuts[at] + most, "right")) - 1)
        some = b" ".join(x for x in batch.column(1).slice(at, to - at).to_pylist() if x)
        yield whole[cuts[at] : cuts[to]].astype(np.int64), np.diff(cuts[at : to + 1]), some.split()
        at = to


def count_bigrams(lines: DataFrame, place: np.ndarray, size: int) -> DataFrame:
    """(a, b, n): how often seed b follows seed a. lines: numbered() rows; place: the seed that each common word is, size - 1 for any other word, which stands last too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size * size, np.int64)
        for batch in batches:
            for at, sizes, _ in numbered_lines(batch):
                ids = place[at]
                seen += np.bincount(beside(ids, sizes)[0] * size + ids, minlength=size * size)
        at = np.flatnonzero(seen)
        at = at[(at // size < size - 1) & (at % size < size - 1)]
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(seen[at])], names=["a", "b", "n"])

    return lines.mapInArrow(run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, fixed: int, classes: int = CLASSES, rounds: int = ROUNDS, start: np.ndarray | None = None, pinned: int = 0) -> np.ndarray:
    """Class of each unit by exchange clustering of a units x units matrix of bigram counts. The unit `fixed` is class 0 alone; the others start as `start` says or else by rank, in turn. The last `pinned` units stay: they are partners only."""
    m = len(pairs)
    total = pairs.sum(axis=1) + pairs.sum(axis=0)
    of = np.zeros(m, np.int64) if start is None else start.copy()
    ranked = [u for u in np.argsort(-total, kind="stable").tolist() if u != fixed and u < m - pinned]
    for i, u in enumerate(ranked if start is None else ()):
        of[u] = 1 + i % (classes - 1)
    one = np.zeros((m, classes))
    one[np.arange(m), of] = 1
    n = one.T @ pairs @ one
    for _ in range(rounds):
        moved = 0
        for u in ranked:
            old, own = of[u], pairs[u, u]
            r, q = np.bincount(of, pairs[u], classes), np.bincount(of, pairs[:, u], classes)
            r[old] -= own
            q[old] -= own
            n[old] -= r
            n[:, old] -= q
            n[old, old] -= own
            with_row, with_col = _f(n + r) - _f(n), _f(n + q[:, None]) - _f(n)
            corner = np.diagonal(n)
            gain = with_row.sum(axis=1) - np.diagonal(with_row) + with_col.sum(axis=0) - np.diagonal(with_col) + _f(corner + r + q + own) - _f(corner)
            left, right = n.sum(axis=1) + q, n.sum(axis=0) + r  # the neighbours' own share stays wherever the unit goes
            a, b = r.sum() + own, q.sum() + own
            gain -= _f(left + a) - _f(left) + _f(right + b) - _f(right)
            gain[0] = -np.inf
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            of[u] = new
            n[new] += r
            n[:, new] += q
            n[new, new] += own
            moved += new != old
        if not moved:
            break
    return of


def likeliest(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The class of each row of neighbours' class counts (left, then right) that raises the likelihood of the class bigrams n most, not that of the end."""
    classes = len(n)
    left = np.log((n + 1) / (n.sum(axis=0) + classes))
    right = np.log((n + 1) / (n.sum(axis=1, keepdims=True) + classes))
    gain = counts[:, :classes] @ left + counts[:, classes:] @ right.T
    return gain[:, 1:].argmax(axis=1) + 1


def level_of(n: np.ndarray) -> float:
    """What the log likelihood of class bigrams n owes to the classes."""
    return _f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum()


def best(counts: np.ndarray, n: np.ndarray, old: np.ndarray | None = None, own: np.ndarray | None = None, most: int = 1000) -> np.ndarray:
    """The class of each row of neighbours' class counts (left, then right) that raises the likelihood of the class bigrams n most, by the exact gain of exchange(), not that of the end.

    old: the rows' present classes, if n counts them there; then a row is taken out of n before it is judged. own: how
    often each follows itself, which counts holds as neighbours of the class `old`.
    """
    classes = len(n)
    out = np.ones(len(counts), np.int64)
    total = n.sum(axis=1), n.sum(axis=0)
    for at in range(0, len(counts), most):
        part = slice(at, at + most)
        q, r = (counts[part, :classes].astype(float), counts[part, classes : 2 * classes].astype(float))
        each, self_n = np.arange(len(q)), np.zeros(len(q))
        if old is not None:
            o, self_n = old[part], (self_n if own is None else own[part])
            q[each, o] -= self_n
            r[each, o] -= self_n
        gain = np.zeros((len(q), classes))
        for x, other, table in ((q, r, n), (r, q, n.T)):
            i, d = np.nonzero(x)
            if not len(i):
                continue
            v = x[i, d]
            # the gain in the cells of a neighbour's class and any new one; rows that say the same have it once
            keys, which = np.unique(np.stack((d, v)), axis=1, return_inverse=True)
            kd, kv = keys[0].astype(np.int64), keys[1]
            of_key = _f(table[kd] + kv[:, None]) - _f(table[kd])
            of_key[np.arange(len(kd)), kd] = 0
            rows = of_key[which.ravel()]
            if old is not None:
                oi = o[i]
                rows[np.arange(len(i)), oi] = _f(table[d, oi]) - _f(table[d, oi] - v)
                same = np.flatnonzero(d == oi)
                base = table[d[same]] - other[i[same]]
                rows[same] = _f(base + v[same, None]) - _f(base)
                rows[same, d[same]] = 0
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
            gain[i[starts]] += np.add.reduceat(rows, starts)
        corner = np.tile(np.diagonal(n), (len(q), 1))
        a, b = r.sum(axis=1) + self_n, q.sum(axis=1) + self_n
        left, right = np.tile(total[0], (len(q), 1)), np.tile(total[1], (len(q), 1))
        if old is None:
            left += q
            right += r
        else:
            corner[each, o] -= q[each, o] + r[each, o] + self_n
            left[each, o] -= a
            right[each, o] -= b
        gain += _f(corner + q + r + self_n[:, None]) - _f(corner)
        gain -= _f(left + a[:, None]) - _f(left) + _f(right + b[:, None]) - _f(right)
        out[part] = gain[:, 1:].argmax(axis=1) + 1
        if old is not None:  # a row moves only if that gains
            stay = gain[each, out[part]] <= gain[each, o] + 1e-9
            out[part] = np.where(stay, o, out[part])
    return out


NEIGHBOURS = "block int, word string, next string, data binary, n long"


def neighbours(lines: DataFrame, known: np.ndarray, classes: int, rare: bool) -> DataFrame:
    """NEIGHBOURS rows: how often words have a neighbour of each class, on the left and on the right, and how often they follow themselves; lines: numbered() rows; known: the common words' classes, -1 where there is none yet.

    block: BLOCK common words, data a matrix of counts. With rare, also word: any other word, n of which were met, data
    of _TIMES; and word and next: two other words, n of which were met in a row.
    """
    shared = lines.sparkSession.sparkContext.broadcast(known)
    width = 2 * classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        size = -(-len(known) // BLOCK) * BLOCK
        dense = np.zeros(size * width, np.int32)
        words_met: list[bytes] = []
        lefts: list[np.ndarray] = []
        rights: list[np.ndarray] = []
        pairs: Counter = Counter()

        def told(block, word, following, data, n) -> pa.RecordBatch:
            words = lambda xs: pa.array(xs, pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), words(word), words(following), pa.array(data, pa.binary()), pa.array(n, pa.int64())], names=["block", "word", "next", "data", "n"])

        def flush() -> Iterator[pa.RecordBatch]:
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words_met), np.int64, len(words_met))
            left, right = np.concatenate(lefts), np.concatenate(rights)
            both = np.concatenate((ids[left >= 0] * 256 + left[left >= 0], ids[right >= 0] * 256 + classes + right[right >= 0]))
            keys, n = np.unique(both, return_counts=True)
            times = np.empty(len(keys), _TIMES)
            times["key"], times["n"] = keys % 256, n
            cuts = np.searchsorted(keys, np.arange(len(number) + 1) * 256).tolist()
            raw, each, met = times.tobytes(), _TIMES.itemsize, np.bincount(ids, minlength=len(number)).tolist()
            names = list(number)
            for at in range(0, len(names), 50_000):
                part = range(at, min(at + 50_000, len(names)))
                yield told([None] * len(part), [names[i] for i in part], [None] * len(part), [raw[each * cuts[i] : each * cuts[i + 1]] for i in part], [met[i] for i in part])
            twos = list(pairs)
            for at in range(0, len(twos), 50_000):
                part = twos[at : at + 50_000]
                yield told([None] * len(part), [a for a, _ in part], [b for _, b in part], [None] * len(part), [pairs[x] for x in part])
            for x in (words_met, lefts, rights, pairs):
                x.clear()

        for batch in batches:
            for at, sizes, some in numbered_lines(batch):
                of = np.where(at >= 0, known[at], -1)
                left, right = beside(of, sizes)
                base, near = at * width, at >= 0
                for side, shift in ((left, 0), (right, classes)):
                    both = near & (side >= 0)
                    np.add.at(dense, base[both] + side[both] + shift, np.int32(1))
                np.add.at(dense, base[near & (beside(at, sizes)[0] == at)] + 2 * classes, np.int32(1))
                if not rare:
                    continue
                far = np.flatnonzero(~near)
                if len(far):
                    words_met += some
                    lefts.append(left[far])
                    rights.append(right[far])
                    pairs.update((some[i], some[i + 1]) for i in np.flatnonzero(np.diff(far) == 1).tolist())
                    if len(words_met) > 300_000:
                        yield from flush()
        if words_met:
            yield from flush()
        blocks = dense.reshape(size // BLOCK, -1)
        some = np.flatnonzero(blocks.any(axis=1)).tolist()
        for at in range(0, len(some), 4000):
            part = some[at : at + 4000]
            yield told(part, [None] * len(part), [None] * len(part), [blocks[i].tobytes() for i in part], [0] * len(part))

    return lines.mapInArrow(run, NEIGHBOURS)


def _transitions(counts: np.ndarray, of: np.ndarray, both: np.ndarray, classes: int) -> np.ndarray:
    """Classes x classes: pairs of a neighbour and a word of class `of`; its right neighbours count only where `both`."""
    one = np.zeros((len(of), classes))
    one[np.arange(len(of)), of] = 1
    return counts[:, :classes].T @ one + one[both].T @ counts[both, classes : 2 * classes]


def _matrix_rows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a, b = np.nonzero(n)
    return a.astype(np.int32), b.astype(np.int32), n[a, b].astype(np.int64)


def _blocks(data: pa.Array, classes: int, kind: str) -> np.ndarray:
    """The counts of a column of blocks, a row each; all have one length, so that the column is a matrix as it stands."""
    width = BLOCK * (2 * classes + 1)
    return np.frombuffer(data.buffers()[2], kind, len(data) * width, data.offset * width * np.dtype(kind).itemsize).reshape(len(data), width) if len(data) else np.zeros((0, width), kind)


def _summed(met: DataFrame, words: int, classes: int) -> DataFrame:
    """(block, data): the blocks of NEIGHBOURS rows added up, each one once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), _blocks(batch.column(1), classes, "<i4"), strict=True):
                if block not in total:
                    total[block] = np.zeros(counts.size, np.int64)
                total[block] += counts
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "data"])

    parts = max(1, words // (1024 * BLOCK))  # so that a task sums some thousand blocks at most
    return met.filter("block is not null").select("block", "data").repartition(parts, "block").mapInArrow(run, "block int, data binary")


def move_common(sums: DataFrame, known: np.ndarray, fixed: dict[int, int], n: np.ndarray, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(the common words' new classes, the transitions that they are part of); sums: _summed() rows; fixed: classes that stay; exact: by the gain of exchange, else to first order, as a start."""
    classes = len(n)
    stay = np.full(len(known), -1)
    stay[list(fixed)] = list(fixed.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros((classes, classes))
        rows = []
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), _blocks(batch.column(1), classes, "<i8"), strict=True):
                counts = counts.reshape(BLOCK, 2 * classes + 1)[: len(known) - block * BLOCK]
                place = slice(block * BLOCK, block * BLOCK + len(counts))
                if (stay[place] >= 0).all():
                    of = stay[place]
                else:
                    told = best(counts, n, known[place], counts[:, 2 * classes]) if exact else likeliest(counts[:, : 2 * classes], n)
                    of = np.where(stay[place] >= 0, stay[place], told)
                moves += _transitions(counts, of, known[place] < 0, classes)
                rows.append((block, of.astype("<i2").tobytes()))
        a, b, m = _matrix_rows(moves)
        none = [None] * len(a)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows] + none, pa.int32()), pa.array([x[1] for x in rows] + none, pa.binary()), pa.array([None] * len(rows) + a.tolist(), pa.int32()), pa.array([None] * len(rows) + b.tolist(), pa.int32()), pa.array([0] * len(rows) + m.tolist(), pa.int64())], names=["block", "of", "a", "b", "n"])

    placed = cut(sums.mapInArrow(run, "block int, of binary, a int, b int, n long"))
    out = np.where(stay >= 0, stay, known if exact else 1)  # a common word without a known neighbour
    for r in placed.filter("block is not null").select("block", "of").toArrow().to_pylist():  # one row for BLOCK of the common words
        part = np.frombuffer(r["of"], "<i2")
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out, _sum_of(placed.filter("a is not null"), classes)


def exchanged(sums: DataFrame, of: np.ndarray, seeds: np.ndarray, pairs: np.ndarray, end: int, n: np.ndarray) -> np.ndarray:
    """The common words' classes after one round of exchange in which all common words are partners. sums: their neighbours' counts by the classes `of`, n: the transitions of those; seeds: numbers of the words that pairs counts, of which `end` stays."""
    classes, size = len(n), len(seeds)
    rows = sums.filter(F.col("block").isin(np.unique(seeds // BLOCK).tolist())).toArrow().to_pylist()  # the seeds' blocks alone
    held = {r["block"]: np.frombuffer(r["data"], "<i8").reshape(BLOCK, -1) for r in rows}
    counts = np.array([held[u // BLOCK][u % BLOCK] if u // BLOCK in held else np.zeros(2 * classes + 1) for u in seeds.tolist()], float)
    one = np.zeros((size, classes))
    one[np.arange(size), of[seeds]] = 1
    # what is beyond the seeds is a unit for each class, which stays
    units = np.zeros((size + classes, size + classes))
    units[:size, :size] = pairs
    units[size:, :size] = counts[:, :classes].T - one.T @ pairs
    units[:size, size:] = counts[:, classes : 2 * classes] - pairs @ one
    units[size:, size:] = n - one.T @ pairs @ one - units[size:, :size] @ one - one.T @ units[:size, size:]
    moved = exchange(units, end, classes, start=np.concatenate((of[seeds], np.arange(classes))), pinned=classes)
    return move_common(sums, of, dict(zip(seeds.tolist(), moved[:size].tolist(), strict=True)), n, exact=True)[0]


def _sum_of(rows: DataFrame, classes: int) -> np.ndarray:
    """The classes x classes matrix of (a, b, n) rows."""
    n = np.zeros((classes, classes))
    for r in rows.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # at most classes x classes rows
        n[r["a"], r["b"]] = r["n"]
    return n


def place_rare(met: DataFrame, n: np.ndarray) -> DataFrame:
    """(word, n, of, ending) of every word beyond the common ones, and (a, b, n) rows of the transitions that they and common ones are part of."""
    classes = len(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moves = np.zeros((classes, classes))
        names, data, times = [], [], []

        def close() -> pa.RecordBatch:
            nonlocal moves
            sizes = np.array([len(x) // _TIMES.itemsize for x in data])
            counts = np.zeros((len(names), 2 * classes))
            raw = np.frombuffer(b"".join(data), _TIMES)
            np.add.at(counts, (np.repeat(np.arange(len(names)), sizes), raw["key"]), raw["n"])
            of = best(counts, n)
            moves += _transitions(counts, of, np.ones(len(of), bool), classes)
            words = [w.encode() for w in names]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(times, pa.int64()), pa.array(of, pa.int32()), pa.array([ending(w) for w in words], pa.int32()), pa.nulls(len(of), pa.int32()), pa.nulls(len(of), pa.int32())], names=["word", "n", "of", "ending", "a", "b"])

        for batch in batches:
            for word, raw, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if names and names[-1] == word:
                    data[-1] += raw
                    times[-1] += m
                    continue
                if len(names) >= 20_000:
                    yield close()
                    names, data, times = [], [], []
                names.append(word)
                data.append(raw)
                times.append(m)
        if names:
            yield close()
        a, b, m = _matrix_rows(moves)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.string()), pa.array(m), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32()), pa.array(a), pa.array(b)], names=["word", "n", "of", "ending", "a", "b"])

    rows = met.filter("word is not null and next is null").select("word", "data", "n")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(run, "word string, n long, of int, ending int, a int, b int")


@dataclass
class Model:
    """What scoring broadcasts; every part has a fixed bound.

    common: word -> its number in of (class) and log_count; unseen: class of each ending; follow[c, d]: log10 of class d
    after class c; spread[c]: log10 of the class's smoothed size, by which a word's count is divided.
    """

    common: dict[bytes, int]
    of: np.ndarray
    log_count: np.ndarray
    unseen: np.ndarray
    follow: np.ndarray
    spread: np.ndarray


def learn(docs: DataFrame, text: str = "text", seeds: int = SEEDS, classes: int = CLASSES, common: int = COMMON, moves: int = MOVES) -> tuple[Model, DataFrame, int, int]:
    """(model, (word, n, of) of the words that the model does not carry, number of training tokens, number of distinct ones)."""
    if classes > 128:
        raise ValueError("there are 128 classes at most")
    words = cut(count_words(docs, text))
    tokens, distinct = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    # whole levels of counts, the greatest first; where not even that fits, its words in the first of SLOTS by hash
    level, slot = F.floor(16 * F.log2("n")).cast("int"), F.pmod(F.xxhash64("word"), F.lit(SLOTS)).cast("int")
    least, so_far, last = None, 0, None
    for at, n in sorted(map(tuple, words.groupBy(level).count().collect()), reverse=True):  # at most 16 * 63 rows
        if so_far + n > common:
            last = at
            break
        least, so_far = at, so_far + n
    frequent = words.filter(level >= least) if least is not None else words.limit(0)
    if last is not None and least is None:
        up_to = -1
        for at, n in sorted(map(tuple, words.filter(level == last).groupBy(slot).count().collect())):  # at most SLOTS rows
            if so_far + n > common:
                break
            so_far, up_to = so_far + n, at
        frequent = words.filter((level == last) & (slot <= up_to))
    short = F.when(F.octet_length("word") <= 64, F.col("word")).otherwise(F.concat(F.lit(END.decode()), F.sha2(F.col("word").cast("binary"), 256)))
    top = sorted(((r[0].encode(), r[1]) for r in frequent.select(short, "n").collect()), key=lambda x: (-x[1], x[0]))  # at most `common` rows
    if END not in dict(top):  # the end is always one of them
        top = [(END, (words.filter(F.col("word") == END.decode()).agg(F.sum("n")).first()[0] or 0)), *top]
    number = {w: i for i, (w, _) in enumerate(top)}
    first = {w: i for w, i in number.items() if i < seeds or w == END}
    # the seeds have numbers from 0; the end may stand beyond
    place = {w: i for i, w in enumerate(first)}
    lines = written(numbered(docs, number, text), "zstd")
    pairs = np.zeros((len(first), len(first)))
    seed_of = np.full(len(top) + 1, len(first))  # the last is for -1
    seed_of[list(first.values())] = range(len(first))
    counted = count_bigrams(lines, seed_of, len(first) + 1).toArrow()  # at most seeds x seeds rows
    pairs[counted["a"].to_numpy(), counted["b"].to_numpy()] = counted["n"].to_numpy()
    of_seeds = exchange(pairs, place[END], classes)
    fixed = {first[w]: int(of_seeds[place[w]]) for w in first}
    one = np.zeros((len(first), classes))
    one[np.arange(len(first)), of_seeds] = 1
    n = one.T @ pairs @ one
    of = np.full(len(top), -1)
    of[list(fixed)] = list(fixed.values())
    summed = lambda met: _summed(met, len(top), classes)
    of, n = move_common(summed(neighbours(lines, of, classes, False)), of, fixed, n)
    stand = lambda sums: move_common(sums, of, dict(enumerate(of.tolist())), n)[1]
    for _ in range(moves):
        sums = written(summed(neighbours(lines, of, classes, False)))
        was, before = of, stand(sums)
        of = exchanged(sums, of, np.array(list(first.values())), pairs, place[END], before)
    # the classes of the common words stand: what their neighbours are is counted once more, and all others are placed
    met = written(neighbours(lines, of, classes, True))
    n = stand(summed(met))
    if moves and level_of(n) < level_of(before):  # words that moved at once got in each other's way: that round is taken back
        of = was
        met = written(neighbours(lines, of, classes, True))
        n = stand(summed(met))
    placed = written(place_rare(met, n))
    rest = placed.filter("word is not null").select("word", "n", "of")
    twos = met.filter("next is not null").select("word", "next", F.col("n").alias("times"))
    a, b = rest.select("word", F.col("of").alias("a")), rest.select(F.col("word").alias("next"), F.col("of").alias("b"))
    n = n + _sum_of(placed.filter("a is not null"), classes) + _sum_of(twos.join(a, "word").join(b, "next").select("a", "b", F.col("times").alias("n")), classes)
    counts = np.array([x for _, x in top], np.float64)
    class_n, class_v = np.bincount(of, counts, classes), np.bincount(of, counts > 0, classes)
    for r in rest.groupBy("of").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # at most `classes` rows
        class_n[r["of"]] += r["n"]
        class_v[r["of"]] += r["v"]
    by_ending = placed.filter("word is not null").groupBy("ending", "of").count().groupBy("ending").agg(F.max_by("of", F.struct("count", -F.col("of"))).alias("of"))
    unseen = np.full(ENDINGS, 1 + int(class_v[1:].argmax()))
    for r in by_ending.collect():  # at most ENDINGS rows
        unseen[r["ending"]] = r["of"]
    prior = (n.sum(axis=0) + 0.5) / (n.sum() + 0.5 * classes)
    follow = np.log10((n + 2.0 * prior) / (n.sum(axis=1, keepdims=True) + 2.0))
    model = Model(number, of, np.log10(counts + 0.5), unseen, follow, np.log10(class_n + 0.5 * (class_v + 1)))
    return model, rest, tokens, distinct


PARTS = [("hash", pa.int64(), "long"), ("word", pa.string(), "string"), ("tokens", pa.int64(), "long"), ("known", pa.int64(), "long"), ("counts", pa.float64(), "double"), ("other", pa.float64(), "double"), ("before", pa.int32(), "int"), ("after", pa.int32(), "int"), ("guess", pa.int32(), "int"), ("pos", pa.int32(), "int")]


def score(docs: DataFrame, learned: tuple[Model, DataFrame, int, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score of every row."""
    model, rest, tokens, distinct = learned
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key_type = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text, with all that its common words say, and one for each other word with the classes beside it (-1: another such word; then pos is its place)."""
        m = shared.value
        for batch in batches:
            ids, hashes, done = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), 0
            for line, sizes in lines_of(batch.column(2).to_pylist()):
                at = numbers_of(line, m.common)
                of = np.where(at >= 0, m.of[at], -1)
                before, after = beside(of, sizes)
                near = at >= 0
                starts = np.cumsum(sizes) - sizes
                total = lambda x: np.add.reduceat(x, starts)  # noqa: B023, E731
                logs = np.where(near, m.log_count[at], 0.0)
                other = np.where(near, np.where(before >= 0, m.follow[before, of], 0.0) - m.spread[of], 0.0)
                far = np.flatnonzero(~near)
                row = np.arange(len(sizes))
                owner = np.concatenate((row, np.repeat(row, sizes)[far])) + done
                words = [line[j] for j in far.tolist()]
                n, none = len(sizes), np.full(len(sizes), -1)
                guess = m.unseen[np.fromiter(map(ending, words), np.int64, len(words))]
                pos = np.where((before[far] < 0) | (after[far] < 0), far - np.repeat(starts, sizes)[far], -1)
                ours = lambda x, rest: np.concatenate((x, np.full(len(far), rest, x.dtype)))  # noqa: B023, E731
                names = pa.array([b" %d" % h for h in hashes[done : done + n].tolist()] + words, pa.binary()).cast(pa.string())
                cols = [hashes[owner], names, ours(sizes.astype(np.int64), 0), ours(total((logs > 0).astype(np.int64)), 0), ours(total(logs), 0.0), ours(total(other), 0.0)]
                cols += [np.concatenate((none, x)).astype(np.int32) for x in (before[far], after[far], guess, pos)]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), *[c if isinstance(c, pa.Array) else pa.array(c, k) for c, (_, k, _) in zip(cols, PARTS, strict=True)]], names=["id", *[x for x, _, _ in PARTS]])
                done += n

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each row adds to its text's sums. Words of no class beside them here wait for pairs()."""
        m = shared.value
        for batch in batches:
            get = {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names) if name != "id"}
            word = get["tokens"] == 0
            n, of = np.nan_to_num(get["n"].astype(float)), np.where(np.isnan(get["of"].astype(float)), get["guess"], get["of"]).astype(np.int64)
            before, after = get["before"], get["after"]
            counts = np.where(word, np.log10(n + 0.5), get["counts"])
            ours = -m.spread[of] + np.where(before >= 0, m.follow[np.maximum(before, 0), of], 0) + np.where(after >= 0, m.follow[of, np.maximum(after, 0)], 0)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.where(word, n > 0, get["known"]).astype(np.int64)), pa.array(counts), pa.array(np.where(word, ours, get["other"])), batch.column(3), pa.array(of.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "hash", "tokens", "known", "counts", "other", "pos", "of"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The transitions between words of a row that all had to meet their class first."""
        m = shared.value
        for batch in batches:
            more = []
            for places in batch.column(batch.num_columns - 1).to_pylist():
                of = {x["pos"]: x["of"] for x in places}
                more.append(sum(m.follow[c, of[p + 1]] for p, c in of.items() if p + 1 in of))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(more, pa.float64())], names=[*batch.schema.names[:-1], "more"])

    parts = rows.mapInArrow(run, f"id {key_type}, " + ", ".join(f"{n} {k}" for n, _, k in PARTS))
    met = parts.join(rest, "word", "left").select("id", "hash", "tokens", "pos", "known", "counts", "other", "before", "after", "guess", "n", "of")
    weighed = met.mapInArrow(weigh, f"id {key_type}, hash long, tokens long, known long, counts double, other double, pos int, of int")
    sums = weighed.groupBy("id", "hash").agg(
        F.count(F.when(F.col("tokens") > 0, 1)).alias("rows"), *[F.sum(c).alias(c) for c in ("tokens", "known", "counts", "other")],
        F.collect_list(F.when(F.col("pos") >= 0, F.struct("pos", "of"))).alias("places"),
    )
    each = lambda x: F.col(x) / F.col("rows")
    done = sums.mapInArrow(pairs, f"id {key_type}, hash long, rows long, tokens long, known long, counts double, other double, more double").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    n_tokens = each("tokens").cast("long")
    return done.select(
        F.col("id").alias(key), n_tokens.alias("n_tokens"), each("known").cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (each("counts") - n_tokens * F.lit(math.log10(tokens + 0.5 * (distinct + 1)))).alias("base_score"),
        (each("counts") + each("other") + F.col("more")).alias("score"),
    )


def held_out(key: str = "doc_id", folds: int = FOLDS, fold: int = HELD_OUT):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def op5_brown(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, learn(docs.filter(~held_out()))).withColumn("held_out", held_out())
