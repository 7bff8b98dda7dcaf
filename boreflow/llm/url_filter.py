"""URL rules with redirect equivalence.

A rule (host, path, verdict) fits its host and all subdomains where the path of the url starts with the rule's; the
longest rule that fits decides.  Pages that no rule fits take the decision of their aliases: redirects (meta refresh)
and canonical links join urls to components, and in a component an explicit allow of any member goes before a block.
Without either, a page is allowed.

Urls of one node differ in scheme or fragment only, after dot segments (``/./``, ``/x/../``) are resolved; slashes that stand
in a row are kept.  Link targets are resolved against the page's ``<base>`` or url, with ``&amp;`` decoded first.  Where one
rule is given as allow and as block, allow holds, however many rules there are.

Null urls and urls without ``://`` have an empty host and path, fit no rule and have no aliases.  A null html has no links.
Rules with a null host or path fit nothing.  Repeated urls are one node; urls and pages of any length are read whole; an empty
table gives an empty result; further columns are kept, and those with the name of a result give way.
Only built-in functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boreflow.llm.components import connected_components
from boreflow.llm.shared import Scratch, fresh, lower_ascii

#: Rules up to which they become one expression; longer lists are joined by host suffix.
INLINE_RULES = 200


def host_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise("")


def path_of(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, host: str, path: str) -> DataFrame:
    """Adds ``rule`` (host + path of the longest rule that fits, else null) and ``decided`` (its verdict)."""
    if isinstance(rules, DataFrame):
        known = rules.select("host", "path", "verdict").where("host is not null and path is not null").distinct()
        if (n := known.limit(INLINE_RULES + 1).count()) > INLINE_RULES:
            return _join_rules(df, known, host, path)
        rules = [tuple(r) for r in known.take(n)]
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r[2] == "allow")):
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        found = F.when(_fits(F.col(host), F.col(path), F.lit(h), F.lit(p)), hit).otherwise(found)
    (tmp,) = fresh(df, "found")
    return df.withColumn(tmp, found).withColumns({"rule": F.col(tmp)["rule"], "decided": F.col(tmp)["verdict"]}).drop(tmp)


def _join_rules(df: DataFrame, rules: DataFrame, host: str, path: str) -> DataFrame:
    """The same by joins: hosts once each, their suffixes to rule hosts, and the few rules of a host back to its pages."""
    hosts = df.select(F.col(host).alias("h")).distinct()
    parts = F.split("h", r"\.")
    suffixes = hosts.select("h", F.posexplode(parts).alias("i", "_"), parts.alias("parts")).select(
        "h", F.array_join(F.slice("parts", F.col("i") + 1, F.size("parts")), ".").alias("suffix")
    )
    r = rules.select(F.col("host").alias("suffix"), F.struct("host", "path", "verdict").alias("r"))
    of_host = suffixes.join(r, "suffix").groupBy("h").agg(F.collect_list("r").alias("rs"))
    rs, h = fresh(df, "rs", "h")
    out = df.join(of_host.toDF(h, rs), F.col(host) == F.col(h), "left").drop(h)
    fit = F.filter(rs, lambda x: F.startswith(F.col(path), x["path"]))
    best = F.array_max(F.transform(fit, lambda x: F.struct(
        (F.length(x["host"]) + F.length(x["path"])).alias("n"), F.length(x["host"]).alias("m"),
        (x["verdict"] == "allow").alias("allows"), F.concat(x["host"], x["path"]).alias("rule"), x["verdict"].alias("verdict"),
    )))
    (tmp,) = fresh(out, "best")
    return out.withColumn(tmp, best).withColumns({"rule": F.col(tmp)["rule"], "decided": F.col(tmp)["verdict"]}).drop(tmp, rs)


def _undotted(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    above = lambda s: F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(1)))
    step = lambda s, x: F.when(x == "..", above(s)).when(x == ".", s).otherwise(F.concat(s, F.array(x)))
    flat = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    open_end = F.when(F.element_at(parts, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.contains(path, F.lit("/.")), F.concat(flat, open_end)).otherwise(path)


def node_of(url: Column) -> Column:
    """Urls that differ only in scheme, fragment or dot segments are one node."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = _undotted(path_of(url))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), F.when(path == "", "/").otherwise(path), query))


def _resolved(base: Column, to: Column) -> Column:
    """The url that a link on a page of url ``base`` leads to."""
    scheme = F.substring_index(base, "://", 1)
    page = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*/|.*?://[^/?#]*)", 1)
    return (
        F.when(F.instr(to, "://") > 0, to)
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(scheme, F.lit("://"), host_of(base), to))
        .when(F.startswith(to, F.lit("?")), F.concat(page, to))
        .when(F.startswith(to, F.lit("#")), F.concat(F.regexp_extract(base, r"(?s)^([^#]*)", 1), to))
        .otherwise(F.concat(folder, F.when(F.endswith(folder, F.lit("/")), F.lit("")).otherwise(F.lit("/")), to))
    )


def _decoded(href: Column) -> Column:
    return F.regexp_replace(href, r"(?i)&(?:amp|#38|#x26);", "&")


def links_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (url, base, to): canonical links and refreshes as they are written, of the few pages that have any."""
    tag = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<link\b[^>]*>|<meta\b[^>]*>)"), 1)
    canon = r"(?is)^<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
    fresh_ = r"(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl\s*=\s*[\"']?([^\"'\s>]+)"
    base = F.regexp_extract(html, r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    links = pages.where(F.col(html).rlike(r"(?i)canonical|http-equiv")).select(
        F.col(url).alias("url"), base.alias("base"), F.explode(tag).alias("tag")
    )
    target = F.concat(F.regexp_extract("tag", canon, 1), F.regexp_extract("tag", fresh_, 1))
    links = links.withColumn("to", _decoded(target)).where("to <> '' and instr(url, '://') > 0")
    return links.select("url", _decoded(F.col("base")).alias("base"), "to").distinct()


def alias_edges(links: DataFrame) -> DataFrame:
    """Rows (src, dst, dst_url): the page's node, and the node of its canonical link or redirect target."""
    at = F.when(F.col("base") == "", F.col("url")).otherwise(_resolved(F.col("url"), F.col("base")))
    links = links.withColumn("base", at).withColumn("dst_url", _resolved(F.col("base"), F.col("to")))
    return links.select(node_of(F.col("url")).alias("src"), node_of(F.col("dst_url")).alias("dst"), "dst_url").distinct()


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str, str]] | DataFrame,
    scratch: Scratch,
    url: str = "url",
    html: str = "html",
    more_edges: DataFrame | None = None,
) -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` (allow or block).

    ``more_edges``: redirects known from elsewhere, with columns from_url and to_url.
    """
    results = ("host", "path", "rule", "decided", "verdict")
    own = pages.select([c for c in pages.columns if c not in results or c in (url, html)])
    ruled = apply_rules(own.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}), rules, "host", "path")
    links = scratch.save(links_of(pages, url, html), "links")
    if more_edges is None and links.isEmpty():
        return ruled.withColumn("verdict", F.coalesce("decided", F.lit("allow"))).drop("decided")
    edges = alias_edges(links)
    if more_edges is not None:
        a, b = F.col("from_url"), F.col("to_url")
        extra = more_edges.select(node_of(a).alias("src"), node_of(b).alias("dst"), b.alias("dst_url"))
        back = more_edges.select(node_of(b).alias("src"), node_of(a).alias("dst"), a.alias("dst_url"))
        edges = edges.union(extra).union(back)
    edges = scratch.save(edges.where("src is not null and dst is not null"), "edges")
    parts = scratch.save(connected_components(edges, scratch), "parts")
    (node,) = fresh(ruled, "node")
    ruled = ruled.withColumn(node, node_of(F.col(url)))
    ends = edges.select(F.col("dst").alias("node"), host_of(F.col("dst_url")).alias("h"), path_of(F.col("dst_url")).alias("p"))
    said = apply_rules(ends.distinct(), rules, "h", "p").select("node", "decided")
    said = said.union(ruled.select(node, "decided")).where("decided is not null").distinct()
    votes = parts.join(said, "node").groupBy("component").agg(
        F.max(F.col("decided") == "allow").alias("allows"), F.max(F.col("decided") == "block").alias("blocks")
    )
    by_node = parts.join(votes, "component").select(
        F.col("node").alias(node), F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow").alias("alias")
    )
    out = ruled.join(by_node, node, "left").drop(node)
    return out.withColumn("verdict", F.coalesce("decided", "alias", F.lit("allow"))).drop("decided", "alias")
