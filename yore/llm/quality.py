"""Quality rules as weak supervision.

Every rule votes good (1) or bad (-1) on a document or abstains (0). Votes of all documents are counted by pattern, of
which k rules have at most 3^k; expectation-maximisation over that bounded table estimates how often each rule is
right when it votes and how many documents are good. A document's verdict is the posterior probability that it is good
given its votes, not a demand that it pass every rule.

Everything a row needs is computed within the row by SQL functions; no text is shuffled, and the only thing that moves
is the table of patterns. Null texts have no words and fail; repeated rows and ties get the same verdict each; an empty
table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.llm.common import SPACED, cut, let, table

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SPACE, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_common", "n_upper", "n_stops")
#: Common words of the languages at hand (English, French, German, Spanish), lower case.
COMMON = (
    "the of and to in a is that it for was with as be on are this by at from "
    "de la le les et des en un une du que est pour qui dans sur pas au "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als "
    "el los las y del se por con para una su al lo como"
).split()


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _repeated(words: Column, window: int) -> Column:
    """How many words stand in a window of words that the text has twice or more, the first place included."""

    def count(hashes: Column) -> Column:
        twice = let(
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"])),
                    lambda x: x["i"],
                )
            ),
        )
        covered = let(twice, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(F.lit(0))

    hashes = F.when(F.size(words) > window, F.transform(F.sequence(F.lit(1), F.size(words) - window + 1), lambda i: F.xxhash64(F.slice(words, i, window)))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, count)


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and the counts that the rules use. Columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = F.translate(t, SPACE, "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(SPACED))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        _repeated(w, window).cast("long").alias("n_repeat_words"),
        F.size(F.array_intersect(w, F.array(*map(F.lit, COMMON)))).cast("long").alias("n_common"),
    )
    return (
        docs.withColumn("m__", let(words_of(F.col(text)), of_words))
        .withColumn("l__", let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))))
        .withColumns(
            {
                "n_words": F.col("m__.n_words"),
                "word_chars": F.length(bare).cast("long"),
                "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": F.col("l__.n_dup_lines"),
                "n_repeat_words": F.col("m__.n_repeat_words"),
                "n_lines": F.col("l__.n_lines"),
                "n_common": F.col("m__.n_common"),
                "n_upper": (F.length(t) - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
                "n_stops": (F.length(t) - F.length(F.translate(t, ".!?", ""))).cast("long"),
            }
        )
        .drop("m__", "l__")
    )


def votes() -> dict[str, Column]:
    """Rule -> vote from the columns of measures()."""
    c, n = F.col, F.greatest(F.col("n_words"), F.lit(1))

    def rule(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    length = c("word_chars") / n
    symbols, lines = c("n_symbols") / n, c("n_dup_lines") / F.greatest(c("n_lines"), F.lit(1))
    repeated, upper = c("n_repeat_words") / n, c("n_upper") / F.greatest(c("word_chars"), F.lit(1))
    return {
        "word_length": rule((length < 2.5) | (length > 14), (length >= 3.5) & (length <= 10)),
        "symbols": rule(symbols > 0.3, symbols < 0.05),
        "dup_lines": rule(lines > 0.3, (c("n_lines") >= 2) & (c("n_dup_lines") == 0)),
        "repeats": rule(repeated > 0.2, repeated < 0.02),
        "capitals": rule(upper > 0.4, upper < 0.15),
        "common_words": rule((c("n_words") >= 30) & (c("n_common") < 2), c("n_common") >= 3),
        "sentences": rule((c("n_words") >= 60) & (c("n_stops") * 80 < c("n_words")), (c("n_stops") > 0) & (c("n_stops") * 2 < c("n_words"))),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[tuple[float, float]]]:
    """(share of good documents, per rule how often its vote is right on good and on bad documents) by expectation-maximisation over vote patterns and their counts.

    Abstaining says nothing. The first guess takes a document with any bad vote as bad with probability 0.9, one without
    as good with 0.9. Counts start with one right and a quarter of a wrong vote, so that rules which never vote and
    empty tables have estimates; a rule is never held to be worse than chance.
    """
    k = len(patterns[0][0]) if patterns else 0
    good = [0.1 if -1 in vote else 0.9 for vote, _ in patterns]
    share, right = 0.8, [(0.8, 0.8)] * k
    for _ in range(rounds):
        total = sum(n for _, n in patterns)
        share = min(max((sum(p * n for p, (_, n) in zip(good, patterns, strict=True)) + 0.8) / (total + 1), 0.02), 0.98)
        for j in range(k):
            n = {(v, y): sum((p if y else 1 - p) * m for p, (vote, m) in zip(good, patterns, strict=True) if vote[j] == v) for v in (1, -1) for y in (0, 1)}
            on_good, on_bad = (n[1, 1] + 1) / (n[1, 1] + n[-1, 1] + 1.25), (n[-1, 0] + 1) / (n[-1, 0] + n[1, 0] + 1.25)
            on_good = min(on_good, 0.999)
            right[j] = (on_good, min(max(on_bad, 1.001 - on_good), 0.999))
        good = [1 / (1 + math.exp(-min(max(log_odds(share, right, vote), -500), 500))) for vote, _ in patterns]
    return share, right


def log_odds(share: float, right: list[tuple[float, float]], vote: tuple[int, ...]) -> float:
    """Of good against bad, given one document's votes."""
    return math.log(share / (1 - share)) + sum(math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0 for v, (g, b) in zip(vote, right, strict=True))


def judge(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` of docs with the measures, the votes' posterior as `quality` (0 to 1), base_failed and kept.

    The measures are computed once and checkpointed with `keep`, which the votes are then counted and judged from; keep
    the text only if it is wanted in the result.
    """
    measured = cut(measures(docs, text).select(*[c for c in keep if c not in MEASURES], *MEASURES))
    voted = votes()
    counted = measured.select(*[v.alias(k) for k, v in voted.items()]).groupBy(*voted).count()
    patterns = [(tuple(r[:-1]), r[-1]) for r in counted.collect()]  # at most 3 ** len(voted) rows
    share, right = estimate(sorted(patterns))
    logit = F.lit(math.log(share / (1 - share)))
    for (_, vote), (g, b) in zip(voted.items(), right, strict=False):
        logit = logit + F.when(vote > 0, math.log(g / (1 - b))).when(vote < 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return measured.withColumn("quality", 1 / (1 + F.exp(-logit))).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= 0.5))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
