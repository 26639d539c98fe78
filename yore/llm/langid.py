"""Language ID by a linear-chain conditional random field over words.

A word's features are its prefixes and suffixes, its character trigrams and the word itself (the lexicon), hashed into
BUCKETS; a label's emission score is the sum of its weights for them, and a learned matrix scores each transition. The
field is fitted on the driver by gradient ascent on the conditional likelihood of a bounded sample: about SAMPLE
labelled documents a language, picked by a hash of the row. Half of the training sequences' joints switch between two
documents, so that the transitions are those of code-switched text.

Prediction runs forward-backward over all words of a text at once for all texts of a batch, in one map without a
shuffle. A text's score for a language is the mean over its words, weighted by letters, of the word's marginal; the
best language is the prediction. Words are runs of letters, lower-cased. Texts that are null or have no letter are
`und` with score 0; so is everything when no document has a label. Repeated rows and ties get the same result each (a
tie goes to the language first in the alphabet); an empty table gives an empty table. Very long texts and words are read
whole; texts are tagged some AT_ONCE characters at a time, longest together, or alone if they are longer.

Marginals sum to one whatever the text, so they cannot say that none of the languages is it. That is told by the share
of a text's trigrams that the sample holds; texts below a floor, which is learned by holding one half of the sample
against the other, are of no known language.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from yore.llm.common import table

BUCKETS, SAMPLE, HALF, STEPS, CACHE, AT_ONCE = 1 << 17, 150, 16, 40, 200_000, 1 << 20
#: Bits of the table of known trigrams; letters that a text has of its own accord as known ones, so that a rare trigram does not reject a few words; what is taken off the share that all but one in a hundred of the sample reach.
KNOWN, GIVEN, MARGIN = 1 << 20, 20, 0.05
OTHERS = 5
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters; a run of nothing but figures such as ½ is none."""
    return [w for w in LETTERS.findall((text or "").lower()) if w.isalpha() or any(map(str.isalpha, w))]


def codes(word: str) -> list[int]:
    """Hashes of a word's trigrams and of its other OTHERS features."""
    w = f"^{word}$"
    grams = [w[i : i + 3] for i in range(len(w) - 2)]
    grams += [w[:2], w[:4] + "~", w[-2:], "~" + w[-4:], "=" + word]
    return [zlib.crc32(g.encode()) for g in grams]


def features(word: str) -> list[int]:
    """Buckets of a word's features."""
    return [c % BUCKETS for c in codes(word)]


def trigrams(word: str) -> np.ndarray:
    """Their places in the table of known ones."""
    return np.array(codes(word)[:-OTHERS]) % KNOWN


@dataclass
class Field:
    """Labels, weights (BUCKETS x labels), transitions (from x to), the known trigrams and the least share of them in a text of these languages."""

    labels: list[str]
    weights: np.ndarray
    moves: np.ndarray
    known: np.ndarray
    floor: float = 0.0


def known_share(words: list[str], known: np.ndarray) -> float:
    """The share of known trigrams in words, by letters."""
    letters = [len(w) for w in words]
    return (sum(n * known[trigrams(w)].mean() for n, w in zip(letters, words, strict=True)) + GIVEN) / (sum(letters) + GIVEN)


def known_trigrams(rows: list[tuple[str, str]]) -> tuple[np.ndarray, float]:
    """(the table of trigrams in all texts, the floor of their share)."""
    halves = [np.zeros(KNOWN, bool), np.zeros(KNOWN, bool)]
    said = [words_of(text) for text, _ in rows]
    for i, words in enumerate(said):
        for w in set(words):
            halves[i % 2][trigrams(w)] = True
    shares = [known_share(words, halves[1 - i % 2]) for i, words in enumerate(said) if words]
    return halves[0] | halves[1], float(np.quantile(shares, 0.01)) - MARGIN if len(shares) > 1 else 0.0


def emissions(words: list[str], field: Field) -> np.ndarray:
    """Scores of words x labels and, in the last column, the share of each word's trigrams that are known."""
    found = [codes(w) for w in words]
    if not found:
        return np.zeros((0, len(field.labels) + 1), np.float32)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.cumsum(sizes) - sizes
    flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
    known = field.known[flat % KNOWN].astype(np.float32)
    known[(starts + sizes)[:, None] - np.arange(1, OTHERS + 1)] = 0
    share = np.add.reduceat(known, starts) / (sizes - OTHERS)
    return np.concatenate((np.add.reduceat(field.weights[flat % BUCKETS], starts, axis=0), share[:, None]), axis=1, dtype=np.float32)


def by_time(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sequences of these lengths: their order from the longest, how many are active at each time, and for each word (sequence by sequence, as given) its place in an array that is laid out time by time."""
    order = np.argsort(-lengths, kind="stable")
    longest = int(lengths.max(initial=0))
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(longest), side="right")
    offset = np.concatenate(([0], np.cumsum(active)))
    rank = np.empty(len(lengths), dtype=np.int64)
    rank[order] = np.arange(len(lengths))
    begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    t = np.arange(int(lengths.sum())) - np.repeat(begins, lengths)
    return order, active, offset[t] + np.repeat(rank, lengths)


def forward_backward(scores: np.ndarray, active: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, laid out by time, and the expected number of each transition (zero unless pairs)."""
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(moves)
    offset = np.concatenate(([0], np.cumsum(active))).tolist()
    alpha = np.empty_like(e)
    n = active.tolist()
    for t, m in enumerate(n):
        a = e[offset[t] : offset[t + 1]] if t == 0 else (alpha[offset[t - 1] : offset[t - 1] + m] @ step) * e[offset[t] : offset[t + 1]]
        alpha[offset[t] : offset[t + 1]] = a / a.sum(axis=1, keepdims=True)
    expected = np.zeros_like(moves)
    beta = np.ones((n[0] if n else 0, e.shape[1]), e.dtype)
    for t in range(len(n) - 1, 0, -1):
        m, a, b = n[t], offset[t - 1], offset[t]
        after = e[b : b + m] * beta[:m]
        if pairs:
            before = alpha[a : a + m]
            z = ((before @ step) * after).sum(axis=1, keepdims=True)
            expected += step * ((before / z).T @ after)
        alpha[b : b + m] *= beta[:m]
        back = after @ step.T
        beta[:m] = back / back.sum(axis=1, keepdims=True)
    if n:
        alpha[: n[0]] *= beta
    return alpha / np.maximum(alpha.sum(axis=1, keepdims=True), 1e-30), expected


def fit(rows: list[tuple[str, str]], steps: int = STEPS, seed: int = 7, rate: float = 0.5, decay: float = 1e-5) -> Field:
    """The field of (text, language) rows."""
    labels = sorted({lang for _, lang in rows})
    number = {x: i for i, x in enumerate(labels)}
    halves = [(w[i : i + HALF], number[lang]) for text, lang in rows if (w := words_of(text)) for i in range(0, len(w), HALF)]
    field = Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32), *known_trigrams(rows))
    if len(labels) < 2 or not halves:
        return field
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(halves))
    with_other = rng.random(len(halves)) < 0.5
    chains = [[halves[i], halves[mixed[i] if with_other[i] else min(i + 1, len(halves) - 1)]] for i in range(len(halves))]
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for chain in chains for half, _ in chain for w in half])
    gold = np.array([y for chain in chains for half, y in chain for _ in half])
    lengths = np.array([sum(len(half) for half, _ in chain) for chain in chains])
    _, active, place = by_time(lengths)
    feats = [features(w) for w in index]
    sizes = np.array([len(f) for f in feats])
    flat, owner = np.concatenate([np.array(f) for f in feats]), np.repeat(np.arange(len(feats)), sizes)
    first = np.zeros(len(ids), bool)
    first[np.cumsum(lengths) - lengths] = True
    k = len(labels)
    observed = np.zeros((k, k))
    np.add.at(observed, (gold[:-1][~first[1:]], gold[1:][~first[1:]]), 1)
    right = np.stack([np.bincount(ids, gold == y, len(feats)) for y in range(k)], axis=1)
    used, small = np.unique(flat, return_inverse=True)
    w, g2 = np.zeros((len(used), k)), np.full((len(used), k), 1e-6)
    moves, m2 = np.zeros((k, k)), np.full((k, k), 1e-6)
    starts = np.cumsum(sizes) - sizes
    by_feature = np.argsort(small, kind="stable")
    feature_starts = np.flatnonzero(np.diff(small[by_feature], prepend=-1))
    owner_sorted = owner[by_feature]
    for _ in range(steps):
        word_scores = np.add.reduceat(w[small], starts, axis=0)
        laid = np.empty((len(ids), k))
        laid[place] = word_scores[ids]
        marginal, expected = forward_backward(laid, active, moves, pairs=True)
        marginal = marginal[place]
        guess = np.stack([np.bincount(ids, marginal[:, y], len(feats)) for y in range(k)], axis=1)
        slope = np.add.reduceat((right - guess)[owner_sorted], feature_starts, axis=0) / len(ids) - decay * w
        g2 += slope**2
        w += rate * slope / np.sqrt(g2)
        slope = (observed - expected) / len(ids) - decay * moves
        m2 += slope**2
        moves += rate * slope / np.sqrt(m2)
    field.weights[used] = w
    field.moves[:] = moves
    return field


class Tagger:
    """Marginals of the words of many texts; keeps the emissions of words that it has seen lately."""

    def __init__(self, field: Field):
        self.field, self.known, self.table = field, {}, np.zeros((0, len(field.labels) + 1), np.float32)

    def _ids(self, words: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known, self.table = {}, self.table[:0]
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        self.table = np.concatenate((self.table, emissions(fresh, self.field)))
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(per text: number of words; texts x labels: mean marginal by letters; per text: label of each word; per text: share of known trigrams)."""
        said = [words_of(x) for x in texts]
        lengths = np.array([len(w) for w in said], dtype=np.int64)
        words = [w for x in said for w in x]
        k = len(self.field.labels)
        if not words or not k:
            return lengths * bool(k), np.zeros((len(texts), k)), [np.zeros(n, np.int64) for n in lengths], np.zeros(len(texts))
        _, active, place = by_time(lengths)
        ids = self._ids(words)
        laid = np.empty((len(words), k), np.float32)
        laid[place] = self.table[ids, :-1]
        marginal = forward_backward(laid, active, self.field.moves)[0][place]
        size = np.fromiter(map(len, words), dtype=np.float32, count=len(words))
        of = np.repeat(np.arange(len(texts)), lengths)
        total = np.stack([np.bincount(of, marginal[:, y] * size, len(texts)) for y in range(k)], axis=1)
        mean = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
        share = (np.bincount(of, self.table[ids, -1] * size, len(texts)) + GIVEN) / (np.bincount(of, size, len(texts)) + GIVEN)
        return lengths, mean, np.split(marginal.argmax(axis=1), np.cumsum(lengths)[:-1]), share


def sample(docs: DataFrame, text: str, lang: str, key: str, per_language: int = SAMPLE) -> list[tuple[str, str]]:
    """About per_language labelled rows of each language, spread over all rows by a hash; the languages are counted first."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(lang).count().collect()  # one row a language
    if not counts:
        return []
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, per_language / r[1])))])
    drawn = F.pmod(F.xxhash64(F.lit("sample"), key, text), F.lit(1_000_003)) / 1_000_003
    return [tuple(r) for r in rows.filter(drawn < F.element_at(share, F.col(lang))).select(text, lang).limit(2 * per_language * len(counts)).collect()]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", **how) -> Field:
    return fit(sorted(sample(docs, text, lang, key, **how)))


RUNS = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))


def blocks_of(texts: list[str | None], most: int) -> Iterator[list[int]]:
    """Indices of texts in groups of at most `most` characters (a longer text is one of its own), from the shortest to the longest."""
    group, size = [], 0
    for i in sorted(range(len(texts)), key=lambda i: len(texts[i] or "")):
        n = len(texts[i] or "")
        if group and size + n > most:
            yield group
            group, size = [], 0
        group.append(i)
        size += n
    if group:
        yield group


def identify(docs: DataFrame, field: Field, text: str = "text", runs: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """docs with lang_pred, score and known_share and, with runs, the runs of words of one language (columns of these names are replaced)."""
    docs = docs.drop("lang_pred", "score", "known_share", *["runs"] * runs)
    model = docs.sparkSession.sparkContext.broadcast(field)  # BUCKETS x languages numbers and KNOWN flags
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("known_share", T.DoubleType())]
    if runs:
        added.append(T.StructField("runs", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_words", T.LongType())]))))

    def tell_runs(tags: np.ndarray) -> list[dict]:
        cuts = [0, *(np.flatnonzero(np.diff(tags)) + 1).tolist(), len(tags)]
        return [{"lang": model.value.labels[tags[a]], "first_word": a, "n_words": b - a} for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model.value)
        labels = [*model.value.labels, "und"]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            best, score, share, told = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts)), [[]] * len(texts)
            for group in blocks_of(texts, at_once):
                n, mean, tags, known = tagger.tag([texts[i] for i in group])
                if mean.shape[1]:
                    best[group] = np.where(n > 0, mean.argmax(axis=1), -1)
                score[group] = np.where(n > 0, mean.max(axis=1, initial=0.0), 0.0)
                share[group] = np.where(n > 0, known, 0.0)
                if runs and len(labels) > 1:
                    for i, x in zip(group, tags, strict=True):
                        told[i] = tell_runs(x)
            more = [pa.array([labels[i] for i in best], pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(np.clip(share, 0, 1), pa.float64())]
            if runs:
                more.append(pa.array(told, RUNS))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def fold(key: str = "doc_id", folds: int = 4):
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(key).cast("string")) % folds


def known_language(docs: DataFrame, **how) -> DataFrame:
    """Documents in a language that the labelled ones have, with the columns of docs: they have a letter, and the share of their trigrams that the sample holds reaches the floor learned from it. Learns from the labelled documents outside the fold that is held out."""
    field = learn(docs.filter(F.coalesce(fold() != 2, F.lit(True))), **how)
    names = ["lang_pred", "score", "known_share"]
    found = identify(docs.withColumnsRenamed({c: f"{c}__" for c in names}), field)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("known_share") >= field.floor)).drop(*names)
    return kept.withColumnsRenamed({f"{c}__": c for c in names})


def op9_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = learn(docs.filter(fold() != 2))
    return identify(docs.select("doc_id", "text", F.coalesce(fold() == 2, F.lit(False)).alias("held_out")), field).select("doc_id", "held_out", "lang_pred", "score")
