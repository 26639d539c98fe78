"""Text clean-up and search, as column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that show as nothing, without the joiners and direction marks that a script or an emoji needs; fixed values.
INVISIBLE = "[\u00AD\u034F\u115F\u1160\u17B4\u17B5\u180E\u200B\u2060\u2061\u2062\u2063\u2064\u3164\uFEFF\uFFA0]"
#: Names of query parameters that only track; fixed values.
TRACKING = r"(?:utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|_hsenc|_hsmi|mkt_tok|yclid|igshid)"
#: Addresses in a text, and from how many characters on a mailing's only count clicks; fixed values.
ADDRESS, LONG = r"(?:https?|mailto):[^\s<>()\]]+", 201


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once a row even where body is a lambda's inner part."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def replaced(text: Column, pattern: str, new) -> Column:
    """text with each match of pattern replaced by new(match)."""

    def joined(t: Column, found: Column) -> Column:
        put = lambda x, i: F.concat(x, F.coalesce(_let(F.get(found, i), new), F.lit("")))
        return F.array_join(F.transform(F.split(t, pattern), put), "")

    return _let(text, lambda t: F.when(t.rlike(pattern), _let(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda found: joined(t, found))).otherwise(t))


def untracked(url: Column) -> Column:
    """A url without its tracking parameters: cut at every &, parameters with such a name emptied, empty ones left out, and no ? or & at the end."""
    emptied = lambda x, first: F.regexp_replace(x, rf"(?i)({first}\?){TRACKING}=[^#\s)\]]*", "$1")

    def kept(parts: Column) -> Column:
        rest = F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: emptied(x, "^|")), lambda x: x != "")
        return F.array_join(F.concat(F.array(emptied(F.get(parts, F.lit(0)), "")), rest), "&")

    return F.rtrim(F.replace(_let(F.split(url, "&"), kept), F.lit("?&"), F.lit("?")), F.lit("?&"))


def tidy(text: Column, bulk: bool = False) -> Column:
    """Text without invisible characters and tracking parameters, whose lines end in no space, of which no two in a row are empty, nor the first or last.

    bulk: a mailing, whose addresses of LONG characters or more go; of a Markdown link to one its words stay.
    """
    text = replaced(visible(text), ADDRESS, untracked)
    if bulk:
        worded = F.regexp_replace(text, rf"\[([^\]]*)\]\([^)\s]{{{LONG},}}\)", "$1")
        text = replaced(worded, ADDRESS, lambda url: F.when(F.length(url) < LONG, url))
    parts = F.transform(F.split(text, r"(?:[^\S\n]*+\n){2,}"), lambda x: F.regexp_replace(x, r"[^\S\n]+(?=\n|\z)", ""))
    return F.regexp_replace(F.array_join(parts, "\n\n"), r"^\s+|\s+\z", "")


def _bare_letters() -> tuple[str, str]:
    """Latin letters with marks, and each one's bare letter, by their canonical decompositions."""
    pairs = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


_MARKED, _BARE = _bare_letters()
_TO_BARE = str.maketrans(_MARKED, _BARE)


def unmarked(text: Column) -> Column:
    """Lower case without accents and other marks."""
    return F.regexp_replace(F.translate(F.lower(text), _MARKED, _BARE), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Lower-case words without accents, split at all that is no letter or digit."""
    return F.array_remove(F.split(F.coalesce(unmarked(text), F.lit("")), r"[^\p{L}\p{N}]+"), "")


def terms(query: str) -> list[str]:
    """The terms of a query as tokens() gives them; one with marks inside is a phrase."""
    bare = lambda s: "".join(c for c in s.lower().translate(_TO_BARE) if unicodedata.category(c) != "Mn")
    phrases = [" ".join(re.findall(r"[^\W_]+", bare(t))) for t in query.split()]
    return [p for p in phrases if p]


def holds(text: Column, query: str) -> Column:
    """Whether a text has every term of a query; a term with marks inside is a phrase. An empty query holds nowhere."""
    phrases = terms(query)
    if not phrases:
        return F.lit(False)
    said = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    test = F.lit(True)
    for p in phrases:
        test &= F.contains(said, F.lit(f" {p} "))
    return test


def kebab(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1-$2"), r"[\s_]+", "-"))


def pascal(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1 $2"), r"[-_\s]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 10_000)))), "")


def camel(text: Column) -> Column:
    whole = pascal(text)
    return F.concat(F.lower(F.substring(whole, 1, 1)), F.substring(whole, 2, 1_000_000))


def mended(text: Column) -> Column:
    """UTF-8 that was read as Latin-1, read again; other text stays."""
    again = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    odd = text.rlike("[Â-ô][\u0080-¿]") & ~text.rlike("[^\u0000-ÿ]")
    return F.when(odd & ~F.contains(again, F.lit("�")), again).otherwise(text)


def shortened(text: Column, longest: int = 100, suffix: str = "...", least: int = 50) -> Column:
    """A data URI's Base64 of more than `longest` characters, cut so that with what stands before it and the suffix it has no more; other Base64 of `least` characters and more than `longest`, cut; other text stays."""
    head, payload = F.regexp_extract(text, r"^data:[^;]+;base64,(?=.)", 0), F.regexp_extract(text, r"^data:[^;]+;base64,(.+)$", 1)
    room = F.greatest(F.lit(longest - len(suffix)) - F.length(head), F.lit(0))
    plain = text.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(text) >= least) & (F.length(text) > longest)
    return (
        F.when(F.length(payload) > longest, F.concat(head, F.substring(payload, F.lit(1), room), F.lit(suffix)))
        .when((F.length(payload) == 0) & plain, F.concat(F.substring(text, 1, longest), F.lit(suffix)))
        .otherwise(text)
    )


def shortened_json(value: Column, longest: int = 100, suffix: str = "...") -> Column:
    """JSON whose strings, at any depth, are shortened like shortened()."""

    def cut(found: Column) -> Column:
        bare = F.substring(found, F.lit(2), F.length(found) - 2)
        return F.concat(F.lit('"'), shortened(bare, longest, suffix), F.lit('"'))

    # Base64 and data URIs have nothing that JSON escapes but the slash
    return replaced(value, rf'"(?:data:[^;"\\]+;base64,)?[A-Za-z0-9+/]{{{min(50, longest)},}}={{0,2}}"', cut)


def phone(text: Column, country: str = "1") -> Column:
    """+ and digits of a phone number; ten digits get the country's code; null if there are fewer than seven digits or more than fifteen."""
    digits = F.regexp_replace(text, r"[^0-9]", "")
    whole = F.when(F.trim(text).startswith("+"), digits).when(F.length(digits) == 10, F.concat(F.lit(country), digits)).otherwise(digits)
    return F.when(F.length(whole).between(7, 15), F.concat(F.lit("+"), whole))


def isrc(text: Column) -> Column:
    """A recording code in capitals without hyphens, spaces and the label ISRC; null if it is none."""
    bare = F.regexp_replace(F.regexp_replace(F.upper(F.regexp_replace(text, r"^\s+|\s+\z", "")), r"^ISRC:?\s*", ""), r"[-\s]", "")
    return F.when(bare.rlike(r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), bare)


def mime_like(mime: Column, glob: str) -> Column:
    """image/* and the like, without regard to case."""
    return F.ilike(mime, F.lit(glob.replace("%", r"\%").replace("_", r"\_").replace("*", "%")))


def metric(value: Column, unit: Column) -> Column:
    """°F as °C, kJ as kcal, lb and stone as kg; other units stay."""
    return (
        F.when(unit.isin("°F", "degF"), (value - 32) * 5 / 9).when(unit == "kJ", value / 4.184).when(unit == "lb", value * 0.45359237).when(unit == "st", value * 6.35029318).otherwise(value)
    )


def email_body(text: Column) -> Column:
    """What someone wrote in a mail: without quoted lines, what follows a reply header, a signature and a bulk footer."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?ms)^(?:On [^\n]{5,200}\n?[^\n]{0,100}wrote:|-{2,}\s?Original Message\s?-{2,}|_{10,}|Le [^\n]{5,200} a écrit\s?:|Am [^\n]{5,200} schrieb[^\n]{0,80}:).*\z", "")
    text = F.regexp_replace(text, r"(?m)^>.*\n?", "")
    text = F.regexp_replace(text, r"(?ms)^-- ?\n.*\z", "")
    text = F.regexp_replace(text, r"(?im)^.*(?:unsubscribe|view (?:this email )?in (?:your )?browser).*\n?", "")
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


#: Properties that name a node, in the order in which they are tried; fixed values.
LABELS = ["name", "title", "headline", "handle", "text", "body", "url"]


def node_label(node: Column, depth: int = 4) -> Column:
    """What names a JSON node: its first naming text, else the label of its object, else that of its result, down to `depth` nodes."""

    def at(whole: Column, path: str, left: int) -> Column:
        def label(said: Column) -> Column:
            # only texts name: numbers and nodes do not
            named = [F.when(said.rlike(rf'"{k}"\s*:\s*"'), F.nullif(F.get_json_object(whole, f"${path}.{k}"), F.lit(""))) for k in LABELS]
            return F.when(said.isNotNull(), F.coalesce(*named, *([at(whole, f"{path}.object", left - 1), at(whole, f"{path}.result", left - 1)] if left > 1 else [])))

        return _let(F.get_json_object(whole, f"${path}"), label)  # what is not there is not looked into

    return _let(node, lambda whole: at(whole, "", depth))


def record_label(node: Column, kind: Column | None = None) -> Column:
    """struct<type, title, date> of a JSON payload: its type (else `kind`, else records), its label on one line, and when it happened."""
    of = lambda whole, k: F.nullif(F.get_json_object(whole, f"$.{k}"), F.lit(""))
    title = F.nullif(F.regexp_replace(F.regexp_replace(node_label(node), r"\s+", " "), r"^ | $", ""), F.lit(""))
    # each field makes the payload once; a field alone makes no other
    date = _let(node, lambda whole: F.coalesce(of(whole, "timestamp"), of(whole, "startTime"), of(whole, "endTime")))
    return F.struct(F.coalesce(F.get_json_object(node, "$.@type"), *([kind] if kind is not None else []), F.lit("records")).alias("type"), title.alias("title"), date.alias("date"))


def suggestions(asked: DataFrame, names: DataFrame, most: int = 3, best: int = 3) -> DataFrame:
    """(asked, name, distance): for each asked word the `best` closest names at an edit distance of at most `most`, of several the least; the word itself, if it is a name, does not count among them. asked: asked; names: name.

    Words within `most` edits share one of most + 1 pieces of the shorter or of its neighbours' lengths: a name is cut
    in most + 1 pieces, one of which the asked word must hold at a place at most `most` off, so that only words with a
    common piece are compared.
    """
    n = most + 1
    size = F.length("name")
    cut = lambda i: F.floor(size * i / n).cast("int")
    pieces = F.array(*[F.struct(F.lit(i).alias("i"), size.alias("size"), F.substring(F.col("name"), cut(i) + 1, cut(i + 1) - cut(i)).alias("piece")) for i in range(n)])
    keyed = names.distinct().select("name", F.explode(pieces).alias("p")).select("name", "p.*")
    lengths = F.sequence(F.greatest(F.length("asked") - most, F.lit(0)), F.length("asked") + most)

    def held(i: int, total: Column) -> Column:
        at, width = F.floor(total * i / n).cast("int"), (F.floor(total * (i + 1) / n) - F.floor(total * i / n)).cast("int")
        places = F.sequence(F.greatest(at - most, F.lit(0)), at + most)
        return F.transform(places, lambda a: F.struct(F.lit(i).alias("i"), total.alias("size"), F.substring(F.col("asked"), a + 1, width).alias("piece")))

    parts = F.array_distinct(F.flatten(F.transform(lengths, lambda total: F.flatten(F.array(*[held(i, total) for i in range(n)])))))
    met = asked.distinct().select("asked", F.explode(parts).alias("p")).select("asked", "p.*").join(keyed, ["i", "size", "piece"]).select("asked", "name").distinct()
    close = met.withColumn("distance", F.levenshtein("asked", "name")).filter((F.col("distance") <= most) & (F.col("asked") != F.col("name")))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy("distance", "name"))
    return close.withColumn("rank__", rank).filter(F.col("rank__") <= best).drop("rank__")
