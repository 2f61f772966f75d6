"""URL filters with redirect equivalence.

Rules decide first: a rule fits its host and all subdomains where the url's path starts with the
rule's, and the longest rule wins. Urls without a rule take the decision of their aliases:
redirect and canonical-link edges (from every ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``
outside comments, scripts and the like, and a table of observed redirects; relative targets are resolved
against the page's ``<base>`` or url) join urls into distributed
connected components. Nodes are normalised urls; nothing but an edge joins two of them. A block decision reaches every alias, and an explicit allow in the
component takes precedence over it. Everything runs as SQL expressions and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.shared import settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rule sets up to this size become one literal map inside the projection; larger ones are joined.
LITERAL_RULES = 1000
_VALUE = r"\s*=\s*[\"']?([^\"'\s>]+)"
_CANONICAL = r"(?is)<link\b(?=[^>]*(?<![\w-])rel\s*=\s*(?:\"[^\">]*\bcanonical\b|'[^'>]*\bcanonical\b|canonical\b))[^>]*(?<![\w-])href" + _VALUE
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*\burl" + _VALUE
_BASE = r"(?is)<base\b[^>]*(?<![\w-])href" + _VALUE
#: Parts of a page whose tags are no tags.
_INERT = r"(?is)<!--.*?(?:-->|\z)|<(script|style|template|textarea|title|noframes|xmp)\b.*?(?:</\1\s*>|\z)"
#: Character references that stand in targets; the ampersand's own comes last.
_REFERENCES = ((r"&(?:quot|#0*34|#[xX]0*22);", '"'), (r"&(?:apos|#0*39|#[xX]0*27);", "'"), (r"&(?:sol|#0*47|#[xX]0*2[fF]);", "/"), (r"&(?:colon|#0*58|#[xX]0*3[aA]);", ":"), (r"&(?:amp|#0*38|#[xX]0*26);", "&"))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    rest = _after_scheme(F.coalesce(url, F.lit("")))
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_key(url: Column) -> Column:
    """A url normalised: scheme and host in lower case, no default port, no fragment, ``/`` for an empty path; null for a url without a host."""
    scheme = F.translate(F.regexp_extract(url, r"^([^:/?#]+)://", 1), UPPER, LOWER)
    host = host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path, query = path_of(url), F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.when(host_of(url) != "", F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def _no_dots(path: Column) -> Column:
    """``.`` and ``..`` segments of a path resolved."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), F.array(F.lit("")), step)
    return F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def _bound(value: Column, use) -> Column:
    """use(value), the value written once: repeated, nested expressions outgrow the planner."""
    return F.transform(F.array(value), use)[0]


def resolve(base: Column, target: Column) -> Column:
    """A link's target as a full url; null where it is empty, has a scheme without ``//``, or base is no full url."""
    return _bound(F.struct(F.coalesce(base, F.lit("")).alias("base"), target.alias("target")), lambda x: _resolved(x["base"], x["target"]))


def _resolved(base: Column, target: Column) -> Column:
    root = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    own = F.concat(root, path_of(base))
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    path, rest = F.regexp_extract(target, r"^([^?#]*)", 1), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    whole = F.when(target.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target).when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | (root == ""), None)
        .when(target.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), target)).when(target.startswith("#"), F.concat(own, query, target))
        .when(target.startswith("?"), F.concat(own, target)).otherwise(F.concat(root, _bound(whole, _no_dots), rest))
    )


def _rule_literal(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> Column:
    by_host: dict[str, list] = {}
    for verdict, rule_host, rule_path in rules:
        by_host.setdefault(rule_host, []).append(F.struct(F.lit(len(rule_host) + len(rule_path)).alias("size"), F.lit(verdict).alias("verdict"), F.lit(rule_path).alias("path"), F.lit(rule_host + rule_path).alias("rule")))
    if not by_host:
        return F.lit(None).cast("struct<size:int,verdict:string,path:string,rule:string>")
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    # "allow" sorts before "block": of two rules as long, array_min over (-size, verdict) takes the allow
    ranked = F.transform(F.filter(fitting, lambda r: path.startswith(r["path"])), lambda r: F.struct((-r["size"]).alias("size"), r["verdict"].alias("verdict"), r["path"].alias("path"), r["rule"].alias("rule")))
    return F.array_min(ranked)


def apply_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Adds _host, _path and _hit (struct size, verdict, path, rule; null without a rule) to each row."""
    pages = pages.withColumns({"_host": host_of(F.col(url_col)), "_path": path_of(F.col(url_col))})
    if isinstance(rules, DataFrame):
        head = rules.select("verdict", "host", "path").limit(LITERAL_RULES + 1).collect()  # bounded by the limit
        if len(head) <= LITERAL_RULES:
            rules = [tuple(r) for r in head]
    if not isinstance(rules, DataFrame):
        return pages.withColumn("_hit", _rule_literal(rules, F.col("_host"), F.col("_path")))
    labels = F.split("_host", r"\.")
    keyed = pages.select("_host").distinct().withColumn("_suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    by_host = keyed.join(rules.select(F.col("host").alias("_suffix"), "verdict", "path"), "_suffix")
    hits = pages.select("_host", "_path").distinct().join(by_host, "_host").filter(F.col("_path").startswith(F.col("path")))
    best = hits.groupBy("_host", "_path").agg(F.min(F.struct((-(F.length("_suffix") + F.length("path"))).alias("size"), "verdict", "path", F.concat("_suffix", "path").alias("rule"))).alias("_hit"))
    return pages.join(best, ["_host", "_path"], "left")


def link_edges(pages: DataFrame, redirects: DataFrame | None = None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) normalised urls joined by canonical links, refresh redirects and the given table (src, dst urls; dst may be relative to src)."""
    edges = []
    if html_col in pages.columns:
        html = F.col(html_col)
        low = F.lower(html)
        linking = pages.filter(low.contains("canonical") | low.contains("refresh")).select(F.col(url_col).alias("src"), F.regexp_replace(html, _INERT, " ").alias("html"))
        found = F.concat(F.regexp_extract_all("html", F.lit(_CANONICAL), 1), F.regexp_extract_all("html", F.lit(_REFRESH), 1))
        found = linking.select("src", F.regexp_extract("html", _BASE, 1).alias("_base"), F.explode(found).alias("_to"))
        for pattern, sign in _REFERENCES:
            found = found.withColumns({c: F.regexp_replace(c, pattern, sign) for c in ("_base", "_to")})
        edges.append(found.select("src", resolve(F.coalesce(resolve(F.col("src"), F.col("_base")), F.col("src")), F.col("_to")).alias("dst")))
    if redirects is not None:
        edges.append(redirects.select("src", resolve(F.col("src"), F.col("dst")).alias("dst")))
    if not edges:
        return pages.sparkSession.createDataFrame([], "src string, dst string")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    out = out.filter("dst is not null").select(_bound(F.col("src"), url_key).alias("src"), _bound(F.col("dst"), url_key).alias("dst"))
    return out.filter("src != dst").distinct()  # nor an edge from or to a url without a host, which is no node


def aliases(edges: DataFrame) -> DataFrame:
    """(key, component) of the normalised urls of edges (src, dst), numbered first, so that equal numbers are equal urls."""
    edges = settle(edges, "links")
    urls = edges.select(F.col("src").alias("key")).union(edges.select("dst")).distinct()
    urls = settle(urls.withColumn("node", F.monotonically_increasing_id()), "urls")
    pairs = edges.join(urls.toDF("src", "a"), "src").join(urls.toDF("dst", "b"), "dst").select("a", "b")
    return urls.join(components(pairs), "node").select("key", "component")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (null without one), verdict, via (rule, alias or default).

    rules: (verdict, host, path). A null url or one without ``://`` has an empty host and path, no
    rule and the default verdict, whatever its page links to. Repeated rows each get their row; an empty table gives none. Other columns don't matter.
    """
    pages = pages.select(id_col, url_col, *([html_col] if html_col in pages.columns else []))
    keyed = apply_rules(pages, rules, id_col, url_col).withColumn("_key", _bound(F.col(url_col), url_key)).select(F.col(id_col), "_host", "_path", "_hit", "_key")
    # urls without an edge are groups by themselves; a key holds "://", so it never equals a number
    member = aliases(link_edges(pages, redirects, url_col, html_col)).select(F.col("key").alias("_key"), F.col("component").cast("string").alias("_comp"))
    grouped = lambda keys: keys.join(member, "_key", "left").withColumn("_comp", F.coalesce("_comp", "_key"))
    decided = keyed.filter("_hit is not null and _key is not null").groupBy("_key").agg(F.max(F.col("_hit.verdict") == "allow").alias("_a"))
    by_comp = grouped(decided).groupBy("_comp").agg(F.max("_a").alias("_a"))
    open_keys = keyed.filter("_hit is null and _key is not null").select("_key").distinct()
    spread = grouped(open_keys).join(by_comp, "_comp").select("_key", F.when(F.col("_a"), "allow").otherwise("block").alias("_spread"))
    out = keyed.join(spread, "_key", "left")
    hit = F.col("_hit")
    return out.select(
        F.col(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), hit["rule"].alias("rule"),
        F.coalesce(hit["verdict"], F.col("_spread"), F.lit(default)).alias("verdict"),
        F.when(hit.isNotNull(), "rule").when(F.col("_spread").isNotNull(), "alias").otherwise("default").alias("via"),
    )
