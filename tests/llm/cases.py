"""Documents with every odd case, shared by the tests of this folder."""

from __future__ import annotations

import random

WORDS = "the of and to in der die und nicht les des une pour los las que con erthat onhand theing ationed lichung mentoi ciónes tionble".split()


def text(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "x", "ung"]) for _ in range(n))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, spans): nulls, empty and blank texts, copies, near copies, shared passages, a long text, repeated rows, null ids. `spans` is a column whose name operators use too."""
    rng = random.Random(seed)
    base = [text(rng, rng.randint(1, 120)) for _ in range(40)]
    shared = text(rng, 70)
    rows = [(i, t, rng.choice(["en", "de", None]), i) for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", 0) for i in range(6)]
    rows += [(200 + i, base[i] + " changed", "fr", 0) for i in range(6)]
    rows += [(300 + i, text(rng, 20) + " " + shared + " " + text(rng, 20 * i), "en", 0) for i in range(5)]
    rows += [(400, None, "en", 0), (401, "", "en", 0), (402, " \n\t ", None, 0), (403, "a", "de", 0), (404, "a" * 3000, "en", 0), (405, "ab " * 500, "en", 0), (406, "Line one\nLine one\n\nLine two", "en", 0)]
    rows += [(500, text(rng, 5000), "en", 0)]
    rows += [(600, base[3], "en", 0), (600, base[3], "en", 0), (601, shared, "en", 0), (601, shared + " tail", "en", 0), (None, base[4], "en", 0), (None, None, None, 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, spans long"
