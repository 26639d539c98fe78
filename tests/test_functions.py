import datetime as dt

import pytest
from pyspark.sql import functions as F

from yore.functions import identity, markup, texts, times


def values(spark, expr, rows):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_date_ranges(spark):
    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    got = values(spark, times.date_range, ["1949", "1949-03", "1949-03-03", "1949-02-31", "1949-13", "junk", "2024-01-02T03:04:05Z", None])
    assert [None if g is None else tuple(g) for g in got] == [
        (ms(1949, 1, 1), ms(1950, 1, 1) - 1, "year"), (ms(1949, 3, 1), ms(1949, 4, 1) - 1, "month"), (ms(1949, 3, 3), ms(1949, 3, 4) - 1, "day"),
        (ms(1949, 3, 3), ms(1949, 3, 4) - 1, "day"), None, None, (ms(2024, 1, 2, 3, 4, 5),) * 2 + ("instant",), None,
    ]


def test_relative_dates():
    now = dt.datetime(2024, 3, 13, 15, tzinfo=dt.timezone.utc)
    day = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)
    assert times.relative("today", now) == (day(2024, 3, 13), day(2024, 3, 14) - 1)
    assert times.relative("last week", now) == (day(2024, 3, 4), day(2024, 3, 11) - 1)
    assert times.relative("this month", now) == (day(2024, 3, 1), day(2024, 4, 1) - 1)
    assert times.relative("last year", now) == (day(2023, 1, 1), day(2024, 1, 1) - 1)
    assert times.relative("-3d", now)[0] == day(2024, 3, 10, 15) and times.duration("2w") == 1_209_600_000
    for bad in ("someday", "-3x", "next week"):
        with pytest.raises(ValueError):
            times.relative(bad, now)


def test_texts(spark):
    assert values(spark, texts.untracked, ["https://x.y/?utm_source=a&b=2&fbclid=z", "u?gclid=1#f", "Why? No & yes ?", None]) == ["https://x.y/?b=2", "u?#f", "Why? No & yes ", None]
    assert values(spark, texts.tidy, ["a  \n\n\n\nb​ c"]) == ["a\n\nb c"]
    assert values(spark, lambda c: texts.holds(c, "Élan foo-bar"), ["elan, FOO bar", "elan foo x bar", "foobar elan", None]) == [True, False, False, False]
    assert values(spark, lambda c: texts.holds(c, " ?! "), ["x"]) == [False]
    assert values(spark, texts.mended, ["Ã©tÃ©", "été", "plain"]) == ["été", "été", "plain"]
    assert values(spark, texts.phone, ["(555) 123-4567", "+44 20 7946 0958", "123", None]) == ["+15551234567", "+442079460958", None, None]
    assert values(spark, texts.kebab, ["FooBar baz_qux"]) == ["foo-bar-baz-qux"] and values(spark, texts.camel, ["foo-bar baz"]) == ["fooBarBaz"]
    assert values(spark, lambda c: texts.shortened(c, 24), ["data:a/b;base64," + "QUJD" * 9, "not base64!", "QUJD"]) == ["data:a/b;base64,QUJDQ...", "not base64!", "QUJD"]


def test_markup(spark):
    page = '<html><head><title>t</title></head><body><h1>Hi &amp; bye</h1><p>A <b>bold</b> <a href="http://x.y">link</a></p><ul><li>one</li><li>two</li></ul><script>no()</script></body></html>'
    text = values(spark, markup.to_text, [page, None, ""])
    assert "Hi & bye" in text[0] and "link (http://x.y)" in text[0] and "no()" not in text[0] and text[1:] == [None, ""]
    mark = values(spark, markup.to_markdown, [page])[0]
    assert "# Hi & bye" in mark and "**bold**" in mark and "[link](http://x.y)" in mark and "- one" in mark


def test_content_keys_ignore_the_order_of_names(spark):
    a, b, c, d = values(spark, identity.content_key, ['{"a":1,"b":[1,{"d":2,"c":3}]}', '{"b":[1.0,{"c":3,"d":2}], "a":1}', '{"a":2}', "not json"])
    assert a == b != c and len(a) == 52 and d


def test_references_without_their_semicolon_stay(spark):
    said = ["a &amp; b&middot;&quot;", "cut at &amp", "cut at &am", "&ampx; &copy2024 &frob;", "&#233;&#xe9; &#233", "&amp;copy;", None]
    assert values(spark, markup.unescape, said) == ['a & b·"', "cut at &amp", "cut at &am", "&ampx; &copy2024 &frob;", "éé &#233", "&copy;", None]


def test_pages_are_read_some_at_a_time():
    import pyarrow as pa

    held, said = [], [None if i % 7 == 0 else f"<p>{i}" for i in range(2 * markup.PAGES + 5)]

    class Watched:
        def __init__(self, rows): self.rows = rows
        def __len__(self): return len(self.rows)
        def slice(self, at, n): return Watched(self.rows.slice(at, n))
        def to_pylist(self): held.append(len(self.rows)); return self.rows.to_pylist()

    got = markup._each(Watched(pa.array(said)), lambda x: markup.read(x, True))
    assert got.to_pylist() == [x and x[3:] for x in said] and max(held) == markup.PAGES and len(held) == 3


def test_a_label_computes_its_node_once(spark):
    df = spark.range(3).select(texts.node_label(F.concat(F.lit('{"object":{"title":"'), F.hex("id"), F.lit('"}}'))).alias("l"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("hex(") == 1
    assert [r.l for r in df.collect()] == ["0", "1", "2"]
    assert values(spark, texts.node_label, ['{"object":"{\\"name\\":\\"x\\"}"}', '{"object":[{"name":"x"}]}', '{"result":{"object":{"url":"u"}}}', "none", None]) == [None, None, "u", None, None]
