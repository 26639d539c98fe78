"""Scalar functions over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from yore.functions import identity, markup, texts
from yore.plans.base import query, table


@query("flatten_fields", "SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS \"props.k\", event_type AS type FROM events")
def flatten_fields(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("long").alias("props.k"), F.col("event_type").alias("type"))


@query("project_paths", "SELECT event_id AS id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def project_paths(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), identity.path(F.col("props"), "k").alias("k"), identity.path(F.col("props"), "none").alias("none"))


@query("path_splat", "SELECT CAST(o_custkey AS BIGINT) AS id, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def path_splat(spark, d):
    rows = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("s"))).alias("j"))
    return rows.select("id", identity.path(F.col("j"), "s", "*").alias("statuses"))


@query("rows_json", "SELECT conv_id AS id, string_agg(role, '; ' ORDER BY turn, role, text) AS roles, count(*) AS turns FROM conversations GROUP BY 1")
def rows_json(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    return table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(turns, lambda x: x["role"]), "; ").alias("roles"), F.count("*").alias("turns"))


_STRIP = r"regexp_replace(regexp_replace(regexp_replace({x}, '([?&])(utm_\w+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|_hsenc|_hsmi|mkt_tok|yclid|igshid)=[^&#\s)\]]*', '\1', 'gi'), '([?&])&+', '\1', 'g'), '[?&]+$', '')"


@query("strip_tracking", "SELECT page_id AS id, " + _STRIP.format(x="u") + " AS url FROM (SELECT page_id, url || CASE WHEN contains(url, '?') THEN '&' ELSE '?utm_source=a&b=2&UTM_Term=x&' END || 'fbclid=xyz&_hsenc=p' || CASE WHEN page_id % 3 = 0 THEN '#top' ELSE '' END AS u FROM pages)")
def strip_tracking(spark, d):
    more = F.when(F.contains("url", F.lit("?")), "&").otherwise("?utm_source=a&b=2&UTM_Term=x&")
    mark = F.when(F.col("page_id") % 3 == 0, "#top").otherwise("")
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), texts.untracked(F.concat("url", more, F.lit("fbclid=xyz&_hsenc=p"), mark)).alias("url"))


_MAIL = " see (https://a.b/c?utm_source=x&q=1&gclid=2) and [words](https://l.ong/{long}) or mailto:a@b.c?igshid=3  \n\n\n\n end \t"
_TIDY = r"regexp_replace(regexp_replace(regexp_replace({x}, '[^\S\n]+(\n|$)', '\1', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


@query("tidy_text", "SELECT doc_id, md5(" + _TIDY.format(x="text || ' see (https://a.b/c?q=1) and [words](https://l.ong/' || repeat('x', 300) || E') or mailto:a@b.c  \\n\\n\\n\\n end \\t'") + ") AS tidy FROM documents")
def tidy_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(texts.tidy(F.concat("text", F.lit(_MAIL.format(long="x" * 300))))).alias("tidy"))


@query("tidy_mailing", "SELECT doc_id, md5(" + _TIDY.format(x="text || E' see (https://a.b/c?q=1) and words or mailto:a@b.c  \\n\\n\\n\\n end \\t'") + ") AS tidy FROM documents")
def tidy_mailing(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(texts.tidy(F.concat("text", F.lit(_MAIL.format(long="x" * 300))), bulk=True)).alias("tidy"))


@query("invisible", "SELECT doc_id, length(replace(text, 'a', 'a' || chr(8205) || chr(1564))) AS n FROM documents")
def invisible(spark, d):
    marked = F.regexp_replace("text", "a", "a\u200b\u2060\ufeff\u3164\u200d\u061c")
    return table(spark, d, "documents").select("doc_id", F.length(texts.visible(marked)).cast("long").alias("n"))


@query(
    "base64_truncate",
    "WITH b AS (SELECT doc_id, base64(encode(text)) AS p FROM documents) SELECT doc_id, 'data:text/plain;base64,' || CASE WHEN length(p) > 100 THEN substr(p, 1, 100 - 23 - 3) || '...' ELSE p END AS uri, CASE WHEN length(p) > 100 THEN substr(p, 1, 100) || '...' ELSE p END AS plain, "
    "'{\"a\":[{\"b\":\"' || CASE WHEN length(p) > 100 THEN substr(p, 1, 100) || '...' ELSE p END || '\"}],\"c\":\"x\"}' AS json FROM b",
)
def base64_truncate(spark, d):
    payload = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), r"[\r\n]", "")
    rows = table(spark, d, "documents").select("doc_id", payload.alias("p"))
    json = F.to_json(F.struct(F.array(F.struct(F.col("p").alias("b"))).alias("a"), F.lit("x").alias("c")))
    return rows.select("doc_id", texts.shortened(F.concat(F.lit("data:text/plain;base64,"), "p")).alias("uri"), texts.shortened(F.col("p")).alias("plain"), texts.shortened_json(json).alias("json"))


@query("base64_decode", "SELECT doc_id, md5(text) AS same FROM documents")
def base64_decode(spark, d):
    back = F.decode(F.unbase64(F.base64(F.encode("text", "UTF-8"))), "UTF-8")
    return table(spark, d, "documents").select("doc_id", F.md5(back).alias("same"))


@query("mojibake", "SELECT doc_id, md5(text) AS same FROM documents")
def mojibake(spark, d):
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return table(spark, d, "documents").select("doc_id", F.md5(texts.mended(broken)).alias("same"))


@query("case_conversion", "SELECT DISTINCT lower(replace(o_orderpriority, ' ', '-')) AS kebab FROM orders")
def case_conversion(spark, d):
    return table(spark, d, "orders").select(texts.kebab(F.col("o_orderpriority")).alias("kebab")).distinct()


@query("phone_numbers", "SELECT c_custkey AS id, '+1' || lpad(CAST(2000000000 + c_custkey AS VARCHAR), 10, '0') AS phone FROM customer")
def phone_numbers(spark, d):
    n = (F.col("c_custkey") + 2000000000).cast("string")
    said = F.concat(F.lit("("), F.substring(n, 1, 3), F.lit(") "), F.substring(n, 4, 3), F.lit("-"), F.substring(n, 7, 4))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), texts.phone(said).alias("phone"))


@query("isrc_codes", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'USABC' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') END AS isrc FROM customer")
def isrc_codes(spark, d):
    code = F.concat(F.when(F.col("c_custkey") % 3 == 1, " isrc: us-abc-").when(F.col("c_custkey") % 3 == 2, "us abc-").otherwise("1s-abc-"), F.lpad(F.col("c_custkey").cast("string"), 7, "0"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), texts.isrc(code).alias("isrc"))


@query("unit_conversion", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN round((o_totalprice - 32) * 5 / 9, 4) WHEN 'O' THEN round(o_totalprice / 4.184, 4) ELSE round(o_totalprice * 0.45359237, 4) END AS value FROM orders")
def unit_conversion(spark, d):
    unit = F.when(F.col("o_orderstatus") == "F", "degF").when(F.col("o_orderstatus") == "O", "kJ").otherwise("lb")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(texts.metric(F.col("o_totalprice"), unit), 4).alias("value"))


@query("suggest_names", "SELECT asked, name, distance FROM (SELECT a.n_name AS asked, b.n_name AS name, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance, row_number() OVER (PARTITION BY a.n_name ORDER BY levenshtein(a.n_name, b.n_name), b.n_name) AS rank FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 3) WHERE rank <= 3")
def suggest_names(spark, d):
    names = table(spark, d, "nation").select("n_name")
    return texts.suggestions(names.withColumnRenamed("n_name", "asked"), names.withColumnRenamed("n_name", "name")).filter("distance > 0")


@query("html_detect", "SELECT page_id AS id, page_id % 5 IN (0, 2, 4) AS html FROM pages")
def html_detect(spark, d):
    forms = [F.col("html"), F.lit("see <https://a.b/c> and x &amp; y"), F.lit("if a <b and c> d"), F.concat(F.lit("1 < 2 "), F.col("page_id")), F.lit("<p title='a > b'>x")]
    said = F.get(F.array(*forms), (F.col("page_id") % 5).cast("int"))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), markup.looks_like_html(said).alias("html"))


@query("html_to_text")
def html_to_text(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), markup.to_text("html").alias("text"))


@query("html_to_markdown")
def html_to_markdown(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), markup.to_markdown("html").alias("markdown"))


@query("html_unescape", "SELECT page_id AS id, md5(replace(replace(replace(replace(html, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')) AS text FROM pages")
def html_unescape(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), F.md5(markup.unescape("html")).alias("text"))


@query("content_keys")
def content_keys(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), identity.content_key("props").alias("key"))


@query("track", "SELECT user_id AS id, count(*) AS points, min((epoch_us(ts) // 1000)) AS first FROM events WHERE event_type = 'view' GROUP BY 1")
def track(spark, d):
    from yore.operators.intervals import millis

    samples = table(spark, d, "events").filter("event_type = 'view'").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(millis("ts").alias("t"), "value"))).alias("s"))
    return samples.select("id", F.size("s").cast("long").alias("points"), F.get("s", F.lit(0))["t"].alias("first"))
