"""Packing tokenised texts into training sequences by vector bin packing.

Every text becomes token ids and one end id. A text of more tokens than a sequence is cut: its full sequences stand
alone and the remainder is an item. Items have a demand in three dimensions: tokens, segments (one each) and tokens
that bear loss. Each sequence is filled bin by bin with the dot-product heuristic: of a bounded pool of items that
still fit in every dimension, the one goes in whose demand has the largest dot product with what is left of the
limits. When nothing fits whole, an item is cut to fill the rest exactly.

Each task packs its own rows as it reads them, in one pass, without a shuffle: no row waits for another task, and the
pool is the only state. What is left in a task at the end is cut into sequences whose lengths are powers of two, which
need no padding. Sequence ids hold the task's partition, so a task that is run again after a loss gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from yore.llm.common import table

LENGTH, SEGMENTS, POOL, END = 1024, 64, 512, 0
#: What a piece says besides its document's key; all are long.
PIECES = ["start", "length", "ids_crc32", "doc_tokens", "loss_tokens", "sequence_id", "offset"]


def encoder(path: str, plain: str | None = None, longest_word: int = 2000) -> Callable[[list[str]], list[np.ndarray]]:
    """Texts -> ids of the byte-level BPE in the tokenizers file at path.

    plain: the same vocabulary as tiktoken ranks. tiktoken gives the same ids and is several times faster; it takes the
    texts whose characters both libraries surely class alike (up to U+024F) and whose words are short. All others, and
    all where plain is None, go to tokenizers.
    """
    import re

    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    fast = None
    if plain:
        import base64

        import tiktoken

        with open(plain, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        import public_tokenizers

        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = re.compile(r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]")
    surely = lambda x: not odd.search(x) and len(max(x.split(), key=len, default="")) < longest_word

    def encode(texts: list[str]) -> list[np.ndarray]:
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            if fast and surely(text):
                out[i] = fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            else:
                rest.append(i)
        for at in range(0, len(rest), 64):
            for i, x in zip(rest[at : at + 64], slow.encode_batch_fast([texts[i] for i in rest[at : at + 64]], add_special_tokens=False), strict=True):
                out[i] = np.array(x.ids, dtype="<u4")
        return out

    return encode


class Packer:
    """Takes items (key, ids, start, doc_tokens, loss) and gives rows of a key and PIECES; see the module's text."""

    def __init__(self, base: int, length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL):
        self.next, self.length, self.segments, self.loss, self.most = base, length, segments, loss or length, pool
        self.items: list[tuple] = []
        self.tokens, self.bearing = np.zeros(2 * pool, np.int64), np.zeros(2 * pool, np.int64)
        self.rows: list[tuple] = []

    def put(self, key, ids: np.ndarray, bears: bool = True) -> None:
        """bears: whether the tokens bear loss."""
        n, at, step = len(ids), 0, min(self.length, self.loss) if bears else self.length
        while at < n:
            a = min(step, n - at)
            item = (key, ids[at : at + a], at, n, a * bears)
            self._close([item]) if a == self.length else self._add(item)
            at += a

    def _add(self, item: tuple) -> None:
        i = len(self.items)
        self.items.append(item)
        self.tokens[i], self.bearing[i] = len(item[1]), item[4]
        if len(self.items) >= self.most:
            self._fill()

    def _take(self, i: int) -> tuple:
        """Item i; the last moves to its place."""
        item, last = self.items[i], self.items.pop()
        n = len(self.items)
        if i < n:
            self.items[i] = last
            self.tokens[i], self.bearing[i] = self.tokens[n], self.bearing[n]
        return item

    def _fill(self) -> None:
        """Close one sequence with items of the pool."""
        left, seats, loss, chosen = self.length, self.segments, self.loss, []
        while self.items and left and seats and loss:
            n = len(self.items)
            t, b = self.tokens[:n], self.bearing[:n]
            score = t * (left / self.length**2) + (seats / self.segments**2) + b * (loss / self.loss**2)
            fits = (t <= left) & (b <= loss)
            if seats == 1:
                fits &= (t == left) | (b == loss)  # the last seat is for what fills the sequence, if there is such an item
            if not fits.any():
                break
            item = self._take(int(np.where(fits, score, -1.0).argmax()))
            chosen.append(item)
            left, seats, loss = left - len(item[1]), seats - 1, loss - item[4]
        if self.items and left and seats and loss:
            n = len(self.items)
            long = self.tokens[:n] > np.where(self.bearing[:n] > 0, min(left, loss), left)
            i = int(np.where(long, self.tokens[:n], -1).argmax()) if long.any() else int(self.tokens[:n].argmax())
            key, ids, at, of, bears = self._take(i)
            a = min(len(ids), left, loss if bears else left)
            chosen.append((key, ids[:a], at, of, a * (bears > 0)))
            if a < len(ids):  # nothing fits whole: the longest is cut
                self._put_back((key, ids[a:], at + a, of, (len(ids) - a) * (bears > 0)))
        self._close(chosen)

    def _put_back(self, item: tuple) -> None:
        i = len(self.items)
        self.items.append(item)
        self.tokens[i], self.bearing[i] = len(item[1]), item[4]

    def _close(self, chosen: list[tuple]) -> None:
        offset = 0
        for key, ids, at, of, loss in chosen:
            self.rows.append((key, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), of, loss, self.next, offset))
            offset += len(ids)
        self.next += 1

    def end(self) -> None:
        """Pack what is left; the last sequences have lengths that are powers of two where items may be cut there."""
        while self.items:
            total = int(self.tokens[: len(self.items)].sum())
            if total >= self.length or len(self.items) > self.segments or int(self.bearing[: len(self.items)].sum()) > self.loss:
                self._fill()
                continue
            rest, self.items = self.items, []
            while rest:
                size = 1 << (sum(len(x[1]) for x in rest).bit_length() - 1)
                chosen = []
                while size:
                    key, ids, at, of, loss = rest.pop()
                    a = min(size, len(ids))
                    chosen.append((key, ids[:a], at, of, a * (loss > 0)))
                    if a < len(ids):
                        rest.append((key, ids[a:], at + a, of, (len(ids) - a) * (loss > 0)))
                    size -= a
                self._close(chosen)


def pack(docs: DataFrame, path: str, plain: str | None = None, key: str = "doc_id", text: str = "text", length: int = LENGTH, segments: int = SEGMENTS, loss: int | None = None, pool: int = POOL, end: int = END, bears: str | None = None) -> DataFrame:
    """The key (of whatever type) and PIECES for every row of docs.

    bears: a boolean column, true where a row's tokens bear loss (of instruction data, the answers); None or null: they
    do. A null or empty text is the end id alone; a null key stays null; repeated rows are packed each, ties go to the
    item that came first; an empty table gives no pieces. Very long texts are tokenised whole and cut into sequences.
    Other columns are not read, whatever their names.
    """
    of_key = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, plain)
        packer = Packer(TaskContext.get().partitionId() << 40, length, segments, loss, pool)
        kind = to_arrow_type(of_key)

        def flush() -> pa.RecordBatch:
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), *[pa.array([r[i] for r in rows], pa.int64()) for i in range(1, 8)]], names=[key, *PIECES])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = encode([x or "" for x in part.column(1).to_pylist()])
                of_loss = part.column(2).to_pylist() if bears else [True] * len(ids)
                for k, x, b in zip(part.column(0).to_pylist(), ids, of_loss, strict=True):
                    packer.put(k, np.append(x, np.uint32(end)), b is not False)
                if len(packer.rows) > 10_000:
                    yield flush()
        packer.end()
        yield flush()

    return docs.select(key, text, *[bears] * bool(bears)).mapInArrow(run, T.StructType([T.StructField(key, of_key), *[T.StructField(c, T.LongType()) for c in PIECES]]))


def op10_pack(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    found = pack(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    return found.drop("loss_tokens")
