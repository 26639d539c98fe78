"""Every license rule on texts written for it, and texts with very many places."""

import random
import re
import time
from re import _constants as C
from re import _parser as P

from tests.llm.cases import SCHEMA
from yore.llm import licenses, pii


UPPER = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def say(tree, rng):
    """A text that the parsed expression matches."""
    out = []
    for op, value in tree:
        if op is C.LITERAL:
            out.append(chr(value))
        elif op is C.BRANCH:
            out.append(say(rng.choice(value[1]), rng))
        elif op is C.SUBPATTERN:
            out.append(say(value[3], rng))
        elif op is C.MAX_REPEAT:
            least, most, part = value
            out += [say(part, rng) for _ in range(rng.randint(least, min(int(most), least + 2)))]
        else:
            kind, x = value[0]
            out.append("q" if kind is C.CATEGORY else chr(x if kind is C.LITERAL else rng.randint(*x)))
    return "".join(out)


def test_every_rule_fires_on_its_own_text(spark):
    rng = random.Random(1)
    rules = licenses.rules()
    texts = [(i, say(P.parse(rule[4]), rng)) for i, rule in enumerate(rules) for _ in range(4)]
    for i, t in texts:
        _, _, words, some, pattern = rules[i]
        assert re.fullmatch(pattern, t) and set(words) <= set(t.split()) and (not some or set(some) & set(t.split())), (pattern, t)
    found = licenses.detect(spark.createDataFrame([(i, f"Some words. {t.translate(UPPER)}, and more.", "en", 0) for i, t in texts], SCHEMA)).collect()
    for r in found:
        # the rule itself, or one that covers the same words with no lower priority
        n = len(re.findall(r"[^\W_]+", r.text)) - 4
        _, priority, *_ = rules[r.doc_id]
        assert any(x.start <= 2 and x.end >= 2 + n and x.priority <= priority for x in r.detections), (rules[r.doc_id], r.text)


def test_names_that_were_missed(spark):
    texts = {"SPDX-License-Identifier: 0BSD": "bsd-0-clause", "licensed under the FreeBSD license": "bsd-2-clause", "see the Apache License, Version 2.0 for": "apache-2.0", "the Mozilla Public License 2.0": "mpl-2.0", "the Ruby license": "ruby", "Unicode License": "unicode", "GPLv3 license": "gpl-3.0"}
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], SCHEMA)
    for r in licenses.detect(docs).collect():
        assert texts[r.text] in {x.label for x in r.detections}, r.text


def test_very_many_places_take_seconds(spark):
    n = 4_000
    text = "mail a@b.co, cc by, 10.0.0.1 all rights reserved. " * n
    docs = spark.createDataFrame([(1, text, "en", 0)], SCHEMA)
    began = time.time()
    assert len(licenses.detect(docs).first().base) == 2 * n
    assert len(pii.spans(docs).first().base) == 2 * n
    assert pii.redact(docs).first().text == text.replace("a@b.co", "<EMAIL>").replace("10.0.0.1", "<IP>")
    assert time.time() - began < 120
