"""What SQL can say of four operators: their exact parts, taken from the operators' own results, and the SQL that these must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame

from yore.llm import licenses, pii, quality, urls

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def urls_rules(spark, sf_dir: str) -> DataFrame:
    return urls.op3_urls(spark, sf_dir).select("page_id", "host", "path", "rule")


def licenses_phrases(spark, sf_dir: str) -> DataFrame:
    return licenses.op6_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_patterns(spark, sf_dir: str) -> DataFrame:
    return pii.op7_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


def quality_measures(spark, sf_dir: str) -> DataFrame:
    return quality.op8_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES = {"urls_rules": urls_rules, "licenses_phrases": licenses_phrases, "pii_patterns": pii_patterns, "quality_measures": quality_measures}

_URLS = f"""
WITH p AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format(x="regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rh, rp) AS (VALUES ('com', '/'), ('example.com', '/en/'), ('www.example.com', '/en/'), ('net', '/es/'), ('net', '/fr/'))
SELECT page_id, host, path, (SELECT arg_max(rh || rp, length(rh || rp)) FROM r WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule FROM h
"""

_LICENSES = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format(x="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(phrase, label) AS (VALUES (['cc', 'by'], 'cc-by'), (['general', 'public', 'license'], 'gpl'), (['all', 'rights', 'reserved'], 'reserved')),
m AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d), p WHERE w[i + 1 : i + len(phrase)] = phrase),
g AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM m GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM d LEFT JOIN g USING (doc_id)
"""

_FORMS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda j: CASE WHEN j % 2 = 0 THEN CAST(reverse({_DIGITS})[j + 1] AS INTEGER) WHEN CAST(reverse({_DIGITS})[j + 1] AS INTEGER) > 4 THEN 2 * CAST(reverse({_DIGITS})[j + 1] AS INTEGER) - 9 ELSE 2 * CAST(reverse({_DIGITS})[j + 1] AS INTEGER) END)) % 10 = 0"
_TESTS = {"email": "true", "ip": "list_max(list_transform(string_split(v, '.'), lambda x: CAST(x AS HUGEINT))) <= 255", "card": f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15"}


def _spans(k: int, kind: str, form: str) -> str:
    """Places of a pattern's matches: the lengths of what stands between them and of the matches before add up."""
    return (
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, s, s + length(v) AS e FROM (SELECT doc_id, f[i] AS v, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s "
        f"FROM (SELECT doc_id, f, b, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{form}') AS f, regexp_split_to_array(text, '{form}') AS b FROM documents WHERE text IS NOT NULL))) WHERE {_TESTS[kind]}"
    )


_PII = (
    "WITH s AS (" + " UNION ALL ".join(_spans(k, *x) for k, x in enumerate(_FORMS)) + "), g AS (SELECT doc_id, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY k, s) AS said, "
    + ", ".join(f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, _) in enumerate(_FORMS)) + " FROM s GROUP BY 1) SELECT doc_id, "
    + ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _ in _FORMS) + ", sha256(coalesce(said, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)"
)

_QUALITY = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, range(0, 5) x(j) WHERE n > 1 GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed
FROM w LEFT JOIN r USING (doc_id)
"""

ORACLES = {"urls_rules": _URLS, "licenses_phrases": _LICENSES, "pii_patterns": _PII, "quality_measures": _QUALITY}
