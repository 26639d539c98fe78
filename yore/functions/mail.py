"""What a person wrote in a mail: without markup, quoted history, signature, and, of a mailing, its footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.functions import markup, texts

#: How a text part says that the real one is the HTML; and how the lines before a quote, a signature and a footer begin.
_ELSEWHERE = r"(?i)\bview (?:this|it|the)\b.{0,30}\b(?:online|browser)\b|\bhtml (?:version|e-?mail)\b|(?:not support|enable) html"
_QUOTE = (
    r"(?:(?:On|Am|Le|El|Il|Op|Em) [^\n]{4,200}(?:\n[^\n]{1,120})?(?:wrote|schrieb[^\n]*|a écrit ?|escribió|ha scritto|schreef|escreveu) ?:|-{2,} ?(?:Original Message|Forwarded message|Ursprüngliche Nachricht|Message d'origine) ?-{2,}|_{10,}\n+From: "
    r"|(?:From|Von|De): [^\n]+\n(?:(?:Sent|Date|To|Cc|Subject|Gesendet|An|Betreff|Envoyé|À|Objet): [^\n]*\n?){2,})"
)
_SIGNED = r"(?m)^(?:-- ?$|Sent from my [^\n]{1,40}$|Get Outlook for [^\n]{1,20}$)"
_FOOTER = r"(?im)^[^\n]*(?:\bunsubscribe\b|you(?:'re| are) receiving this|manage (?:your )?(?:e-?mail )?preferences|no longer wish to receive|view (?:this|it) (?:e-?mail )?in (?:your|a) browser)[^\n]*$"
#: Elements that a reader does not see; their own inner elements of the same name end them early.
_HIDDEN = r"""(?is)<(div|span|p|td|table)\b[^>]*\bstyle\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden|max-height\s*:\s*0|mso-hide\s*:\s*all)[^"']*["'][^>]*>.*?</\1>"""


def _before(text: Column, pattern: str) -> Column:
    """The text before the first match; the whole if that leaves nothing."""
    cut = F.get(F.split(text, pattern, 2), F.lit(0))
    return F.when(F.trim(cut) != "", cut).otherwise(text)


def bare(markdown: Column) -> Column:
    """A mail's Markdown without images, which are logos and counters there."""
    return F.trim(F.regexp_replace(texts.visible(markdown), r"!\[[^\]]*\]\([^)]*\)", ""))


def written(text: Column) -> Column:
    """A text without the messages it quotes and its signature; one that is nothing but these keeps them."""
    own = _before(_before(text, r"(?m)^" + _QUOTE), _SIGNED)
    unquoted = F.regexp_replace(own, r"(?:(?:\A|\n)>[^\n]*)+\s*\z", "")
    return F.when(F.trim(unquoted) != "", unquoted).otherwise(text)


def footed(text: Column) -> Column:
    """A mailing without the end that says how to leave it: from the first such line in its last third on."""
    at = F.regexp_instr(text, F.lit(_FOOTER))
    late = F.substring(text, F.floor(F.length(text) * 2 / 3).cast("int") + 1, F.length(text))
    where = F.regexp_instr(late, F.lit(_FOOTER))
    kept = F.concat(F.substring(text, F.lit(1), F.floor(F.length(text) * 2 / 3).cast("int")), F.substring(late, F.lit(1), where - 1))
    return F.when((at > 0) & (where > 0), kept).otherwise(text)


def bodies(rows: DataFrame, text: str = "text", html: str = "html", out: str = "body", bulk: bool = False) -> DataFrame:
    """rows with what was written: the text part, or the HTML as Markdown where there is none or the text only points at it; without what is hidden, quotes and signature; of a mailing (bulk) without its footer; tidied. Null if there is neither part."""
    raw = F.trim(texts.visible(F.coalesce(text, F.lit(""))))
    shown = rows.withColumns({"h__": markup.to_markdown(F.regexp_replace(html, _HIDDEN, "")), "t__": markup.to_markdown(F.when(markup.looks_like_html(raw), F.regexp_replace(raw, _HIDDEN, "")))})
    parts = shown.withColumns({"h__": F.coalesce(bare(F.col("h__")), F.lit("")), "t__": F.coalesce(bare(F.col("t__")), raw)})
    h, t = F.col("h__"), F.col("t__")
    stub = (h != "") & ((F.length(t) < 400) & t.rlike(_ELSEWHERE) | (F.length(t) < 80) & (F.length(h) > 4 * F.length(t)))
    own = parts.withColumn("t__", F.when((t != "") & ~stub, t).when(h != "", h).otherwise(t)).withColumn("t__", written(t))
    own = own.withColumn("t__", texts.tidy(footed(t), bulk=True) if bulk else texts.tidy(t))
    kept = [c for c in rows.columns if c != out]
    return own.select(*kept, F.when(F.col(text).isNotNull() | F.col(html).isNotNull(), t).alias(out))
