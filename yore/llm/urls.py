"""URL filters: rules by host and path, and trust that spreads over host links.

Pages are reduced to hosts first, with counts, so that a host with a third of all pages is one row before anything is
shuffled. Host edges are the hosts that the pages' HTML names (absolute and protocol-relative addresses in any attribute
or in the text, and names that begin with www), weighted by how many pages name them, and one edge of weight DOMAIN each
way between a host and the domain right above it (down to two labels), which says little but joins hosts that no page
links. Hosts most of whose pages a rule allows are trusted seeds, hosts most of whose pages a rule blocks are blocked
seeds. Trust is personalised PageRank from the former along the links; distrust is personalised PageRank from the latter
against them, so that it reaches who links to a blocked host. Both go on until what is still to move is below TOLERANCE
of the whole. A host is blocked if its distrust is at least FLOOR times the mean share of a host and exceeds its trust by
more than MARGIN of both together. Rank that reaches a host without links is gone; only the comparison matters.

Null urls and urls without :// have empty hosts and paths, no rule and no rank, and are allowed. Null HTML has no
links; very long HTML is read whole. Repeated rows and ties get the same verdict each; empty tables give empty tables.
Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from yore.llm.common import ascii_lower, cut, table

#: (host, path, verdict) of the query; fixed values.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
DAMPING, TOLERANCE, EVERY, DOMAIN, FLOOR, MARGIN = 0.85, 1e-3, 6, 0.1, 0.1, 0.2
#: Edges that a task of a step of ranks takes.
TASK = 200_000
#: A host that HTML names: after http(s)://, after // where an attribute or a word begins, or a name in www.
LINK = r"""(?i)(?:(?<![a-z0-9])https?://|(?<=["'\s=(>])//|(?<![a-z0-9_.@/-])(?=www\.))([^/?#"'\s<>()\[\],;@\\]++)"""


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) for the hosts that any rule fits, rules an array of (length, path, rule, verdict), longest first. Among equal rules, block wins."""
    of = rules.select(F.col("host").alias("domain"), F.struct((F.length("host") + F.length("path")).alias("length"), "path", F.concat("host", "path").alias("rule"), "verdict").alias("r"))
    return (
        hosts.select("host", F.explode(suffixes(F.col("host"))).alias("domain"))
        .join(of, "domain")
        .groupBy("host")
        .agg(F.sort_array(F.collect_set("r"), asc=False).alias("rules"))
    )


def winning(rules: Column, path: Column) -> Column:
    """The longest of a host's rules whose path begins the page's path."""
    return F.get(F.filter(rules, lambda r: F.startswith(path, r["path"])), F.lit(0))


def named_hosts(html: Column) -> Column:
    """The distinct hosts that a page names; names end before the full stop of a sentence and have a dot inside."""
    hosts = F.transform(F.regexp_extract_all(html, F.lit(LINK), F.lit(1)), lambda h: F.rtrim(ascii_lower(h), F.lit(".:!")))
    found = F.array_distinct(F.filter(hosts, lambda h: F.contains(h, F.lit("."))))
    return F.when(F.contains(html, F.lit("//")) | html.ilike("%www.%"), found).otherwise(F.array().cast("array<string>"))


def host_edges(pages: DataFrame, hosts: DataFrame, domain: float = DOMAIN) -> DataFrame:
    """(src, dst, weight, pages) between different hosts. pages: host, html; the result's pages: how many name the other host, 0 for an edge between a host and its domain alone."""
    links = pages.filter("host <> ''").select(F.col("host").alias("src"), F.explode(named_hosts(F.col("html"))).alias("dst")).filter("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    named = hosts.filter("host <> ''").select("host").union(links.select("dst")).distinct()
    chain = named.select(F.filter(suffixes(F.col("host")), lambda d: F.contains(d, F.lit("."))).alias("d"))
    up = chain.filter(F.size("d") > 1).select(F.explode(F.arrays_zip(F.slice("d", 1, F.size("d") - 1).alias("src"), F.slice("d", 2, F.size("d") - 1).alias("dst"))).alias("e"))
    up = up.select("e.src", "e.dst").distinct().withColumns({"weight": F.lit(domain), "pages": F.lit(0.0)})
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", "pages")
    return links.withColumn("pages", F.col("weight")).union(up).union(down).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.sum("pages").cast("long").alias("pages"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, every: int = EVERY) -> DataFrame:
    """(host, trust, distrust) of the hosts that rank reaches, within `tolerance` of the ranks' limits in sum. seeds: host, kind (trust or distrust), share (of the kind; they sum to one)."""
    both = edges.select("src", "dst", "weight", F.lit("trust").alias("kind")).union(edges.select("dst", "src", "weight", F.lit("distrust")))
    out = both.groupBy("kind", "src").agg(F.sum("weight").alias("all"))
    flow = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("all") * damping).alias("part")))
    # as many tasks as the edges ask for: a small graph need not leave a file of every step for each shuffle partition
    tasks = 1 + flow.count() // TASK
    flow = flow.coalesce(tasks)
    seeds = cut(seeds.select("host", "kind", "share").coalesce(tasks)).coalesce(tasks)
    rank, left = seeds, 1.0
    while left > tolerance:
        new = rank
        for _ in range(every):
            sent = new.withColumnRenamed("host", "src").join(flow, ["kind", "src"]).select(F.col("dst").alias("host"), "kind", (F.col("share") * F.col("part")).alias("share"))
            new = sent.unionByName(seeds.withColumn("share", F.col("share") * (1 - damping))).groupBy("host", "kind").agg(F.sum("share").alias("share")).coalesce(tasks)
        new = cut(new)
        change = new.union(rank.withColumn("share", -F.col("share"))).groupBy("host", "kind").agg(F.abs(F.sum("share")).alias("change")).groupBy("kind").agg(F.sum("change").alias("change"))
        # each further step moves at most `damping` of what the one before moved
        left = (change.agg(F.max("change")).first()[0] or 0.0) * damping**every / (1 - damping**every)
        rank = new
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("share"))), F.lit(0.0)).alias(k)
    return rank.groupBy("host").agg(of("trust"), of("distrust"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", floor: float = FLOOR, margin: float = MARGIN, domain: float = DOMAIN, **how) -> DataFrame:
    """pages with host, path, rule (or null), verdict, trust and distrust; columns of these names are replaced.

    rules: host, path, verdict.
    """
    host, path = parts(F.col(url))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict", "trust", "distrust")]
    rows = pages.select(F.struct(*kept).alias("row__") if kept else F.struct(F.lit(0)).alias("row__"), host.alias("host"), path.alias("path"), F.col(html).alias("html"))
    hosts = cut(rows.groupBy("host").agg(F.count("*").alias("pages")))
    fitting = cut(rules_of_hosts(hosts, rules))
    # a step of its own, so that the join can split a host with very many pages
    judged = cut(rows.select("host", "path").join(fitting, "host").select("host", winning(F.col("rules"), F.col("path"))["verdict"].alias("v")))
    said = judged.groupBy("host").agg(F.count(F.when(F.col("v") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("v") == "block", 1)).alias("blocked"))
    seeds = cut(
        said.join(hosts, "host").filter("2 * allowed > pages or 2 * blocked > pages").select("host", F.when(2 * F.col("allowed") > F.col("pages"), "trust").otherwise("distrust").alias("kind"), "pages")
    )
    total = seeds.groupBy("kind").agg(F.sum("pages").alias("all"))
    seeds = seeds.join(total, "kind").select("host", "kind", (F.col("pages") / F.col("all")).alias("share"))
    edges = cut(host_edges(rows.select("host", "html"), hosts, domain))
    ranks = propagate(edges, seeds, **how)
    known = cut(hosts.select("host").join(fitting, "host", "left").join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"]))
    n_hosts = max(1, edges.select(F.col("src").alias("host")).union(hosts.select("host")).distinct().count())
    best = winning(F.col("rules"), F.col("path"))
    bad, good = F.col("distrust"), F.col("trust")
    method = F.when((bad * n_hosts >= floor) & (bad - good > margin * (bad + good)), "block").otherwise("allow")
    found = rows.join(known, "host").select("row__", "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], method).alias("verdict"), "trust", "distrust")
    return found.select(*[F.col("row__")[c].alias(c) for c in kept], "host", "path", "rule", "verdict", "trust", "distrust")


def op3_urls(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url", "html"), rules)
    return found.select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")
