"""URL filters over redirect equivalence.

Nodes are URLs. An edge joins a URL to its address, which is what rewriting redirects lead
to (no scheme, user or default port, host in lower case without www or m, no fragment,
tracking parameter, index or .html ending), and this address to the targets of the page's
canonical links and refresh redirects, resolved against the page's URL. Block and allow
decisions hold for whole connected components; an allow anywhere in a component takes
precedence over any block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .plumbing import connected_components, discard, materialize

#: (pattern, replacement) for what follows the host, applied in turn
REWRITES = (
    ("([?&])(utm_[a-z]+|ref|gclid|fbclid)=[^&]*", "$1"),
    ("&+", "&"),
    ("[?]&+", "?"),
    ("[?&]+$", ""),
    ("/(index)?[.]html?($|[?])", "/$2"),
    ("[.]html?($|[?])", "$1"),
    ("/+$", ""),
)


@dataclass(frozen=True)
class Params:
    """``block`` lists hosts, each with all its subdomains; ``allow`` lists hosts or
    host/path addresses, each with the paths below it."""

    block: tuple[str, ...] = (
        "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "ads-track.example.com",
        "spam-farm.example.com", "adult-x.example.net",
    )
    allow: tuple[str, ...] = ("free-bets.example.com/de", "blog.cheap-pills.example.com")


def _scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))


def _rest(url: Column) -> Column:
    return F.regexp_replace(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")


def _host(url: Column) -> Column:
    """Host and port of a URL, the scheme's own port left out."""
    host = F.lower(F.regexp_replace(F.regexp_extract(_rest(url), "^([^/?]*)", 1), "^.*@", ""))
    host = F.when(_scheme(url).isin("http", ""), F.regexp_replace(host, ":80$", "")).otherwise(host)
    host = F.when(_scheme(url).isin("https", ""), F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.regexp_replace(host, "[.]+(:|$)", "$1")


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.trim(url), "(?s)#.*$", "")


def address(url: Column) -> Column:
    """What the rewriting redirects lead to."""
    url = _bare(url)
    tail = F.regexp_replace(_rest(url), "^[^/?]*", "")
    for pattern, to in REWRITES:
        tail = F.regexp_replace(tail, pattern, to)
    return F.concat(F.regexp_replace(_host(url), "^(www|m)[.]", ""), tail)


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, quoted or not; empty without one."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return F.regexp_replace(F.trim(F.regexp_replace(value, "^[\"']|[\"']$", "")), "&amp;", "&")


def _targets(html: Column) -> Column:
    """What the canonical links and refresh redirects of a page say, as written."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    canonical = F.transform(
        F.filter(links, lambda t: F.array_contains(F.split(F.lower(_attribute(t, "rel")), r"\s+"), "canonical")), lambda t: _attribute(t, "href")
    )
    refresh = F.transform(
        F.filter(metas, lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh"),
        lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*[\"']?([^\"']+)", 1),
    )
    return F.filter(F.transform(F.concat(canonical, refresh), F.trim), lambda x: x != "")


def resolve(page: Column, to: Column) -> Column:
    """The URL that a link of a page leads to (RFC 3986, 5.2); null for other kinds, like
    mailto, and for links into the page itself."""
    page, to = _bare(page), _bare(to)
    scheme = F.when(_scheme(page) == "", "http").otherwise(_scheme(page))
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(page), "^([^/?]*)", 1))
    path = F.regexp_extract(_rest(page), "^[^/?]*([^?]*)", 1)
    asked = F.regexp_extract(to, "^[^?]*(.*)$", 1)
    under = F.concat(F.regexp_replace(path, "[^/]*$", ""), F.regexp_extract(to, "^([^?]*)", 1))
    whole = F.when(to.startswith("/"), F.regexp_extract(to, "^([^?]*)", 1)).otherwise(F.when(under.startswith("/"), under).otherwise(F.concat(F.lit("/"), under)))
    steps = F.split(whole, "/", -1)
    done = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).when(s == ".", acc).otherwise(F.array_append(acc, s)),
    )
    # a path that ends in a dot step ends in a slash
    ends = F.element_at(steps, -1).isin(".", "..")
    flat = F.concat(F.array_join(done, "/"), F.when(ends, "/").otherwise(""))
    return (
        F.when(to == "", None)
        .when(_scheme(to) != "", to)
        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
        .when(to.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:[^0-9/]"), None)
        .when(to.startswith("?"), F.concat(root, path, to))
        .otherwise(F.concat(root, flat, asked))
    )


def decisions(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """(page_id, url, component, own, decision) for every row of ``pages`` with a url.

    component is the least URL of the page's component, a lone page's its own; own is
    the decision by the page's address alone, decision that of the component: ``allow``,
    else ``block``, else ``pass``. Rows without a url are left out, null html has no
    links, repeated rows are each decided, an empty table gives no rows.
    """
    spark = pages.sparkSession
    rows = pages.where("url is not null").select(
        F.col("page_id").cast("long").alias("page_id"), "url", address(F.col("url")).alias("at"), _targets(F.coalesce("html", F.lit(""))).alias("to"),
    )
    rows = materialize(rows, "urls")
    links = rows.select(F.col("url").alias("a"), F.col("at").alias("b"))
    to = rows.select("at", "url", F.explode("to").alias("to")).select("at", resolve(F.col("url"), F.col("to")).alias("to")).where("to is not null")
    links = links.unionAll(to.select("at", address(F.col("to")))).unionAll(to.select("to", address(F.col("to"))))
    comp = connected_components(links)
    node_list = comp.unionAll(rows.where("url = at").select(F.col("url").alias("node"), F.col("url").alias("component"))).groupBy("node").agg(
        F.min("component").alias("component")
    )
    blocks = spark.createDataFrame([(b,) for b in sorted(set(p.block))], "bad string")
    allows = spark.createDataFrame([(a,) for a in sorted(set(p.allow))], "good string")
    # a list of any length: every suffix of the host, every leading part of the address, is looked up
    named = node_list.select(
        "node", "component", F.regexp_extract(address(F.col("node")), "^([^/?:]*)", 1).alias("host"),
        F.regexp_replace(F.regexp_replace(address(F.col("node")), "[?].*$", ""), "^([^/:]*):[0-9]*", "$1").alias("path"),
    )
    suffixes = named.select("node", F.expr("explode(transform(sequence(1, size(split(host, '[.]', -1))), i -> array_join(slice(split(host, '[.]', -1), i, 1000), '.')))").alias("bad"))
    parts = named.select("node", F.expr("explode(transform(sequence(1, size(split(path, '/', -1))), i -> array_join(slice(split(path, '/', -1), 1, i), '/')))").alias("good"))
    bad = suffixes.join(blocks, "bad", "left_semi").select("node").distinct().withColumn("is_bad", F.lit(True))
    good = parts.join(allows, "good", "left_semi").select("node").distinct().withColumn("is_good", F.lit(True))
    nodes = named.select("node", "component").join(bad, "node", "left").join(good, "node", "left").select(
        "node", "component", F.coalesce("is_bad", F.lit(False)).alias("is_bad"), F.coalesce("is_good", F.lit(False)).alias("is_good")
    )
    nodes = materialize(nodes, "nodes")

    def verdict(g: str, b: str) -> Column:
        return F.when(F.col(g), "allow").when(F.col(b), "block").otherwise("pass")

    whole = nodes.groupBy("component").agg(F.bool_or("is_good").alias("any_good"), F.bool_or("is_bad").alias("any_bad"))
    told = nodes.join(whole, "component").select(
        F.col("node").alias("url"), "component", verdict("is_good", "is_bad").alias("own"), verdict("any_good", "any_bad").alias("decision")
    )
    out = materialize(rows.select("page_id", "url").join(told, "url").select("page_id", "url", "component", "own", "decision"), "decisions")
    for t in (rows, comp, nodes):
        discard(t)
    return out


def oracle(p: Params = Params()) -> str:
    """The same in DuckDB by other means: addresses are cut by position and split by separator,
    links found by splitting pages at tags, components by a recursive reachability query."""

    def bare(u: str) -> str:
        return f"split_part(trim({u}), '#', 1)"

    def address_sql(u: str) -> str:
        u = bare(u)
        after = f"(CASE WHEN contains({u}, '://') AND strpos({u}, '://') < strpos({u} || '/', '/') + 1 THEN substr({u}, strpos({u}, '://') + 3) ELSE {u} END)"
        kind = f"(CASE WHEN contains({u}, '://') THEN lower(split_part({u}, '://', 1)) ELSE '' END)"
        first = f"split_part(split_part({after}, '/', 1), '?', 1)"
        host = f"lower(string_split({first}, '@')[-1])"
        host = f"(CASE WHEN {kind} <> 'https' AND ends_with({host}, ':80') THEN {host}[:-4] WHEN {kind} <> 'http' AND ends_with({host}, ':443') THEN {host}[:-5] ELSE {host} END)"
        host = f"rtrim({host}, '.')"
        host = f"(CASE WHEN starts_with({host}, 'www.') THEN substr({host}, 5) WHEN starts_with({host}, 'm.') THEN substr({host}, 3) ELSE {host} END)"
        tail = f"substr({after}, length({first}) + 1)"
        path = f"split_part({tail}, '?', 1)"
        asked = f"array_to_string(list_filter(string_split(substr({tail}, length({path}) + 2), '&'), lambda x: x <> '' AND NOT (contains(x, '=') AND (split_part(x, '=', 1) IN ('ref', 'gclid', 'fbclid') OR (starts_with(x, 'utm_') AND length(split_part(x, '=', 1)) > 4)))), '&')"
        page = f"(CASE WHEN ends_with({path}, '/index.html') THEN {path}[:-11] WHEN ends_with({path}, '/index.htm') THEN {path}[:-10] WHEN ends_with({path}, '.html') THEN {path}[:-6] WHEN ends_with({path}, '.htm') THEN {path}[:-5] ELSE {path} END)"
        return f"{host} || CASE WHEN {asked} = '' THEN rtrim({page}, '/') ELSE {page} || '?' || {asked} END"

    bad = " OR ".join(f"host = '{b}' OR ends_with(host, '.{b}')" for b in sorted(set(p.block)))
    good = " OR ".join(f"path = '{a}' OR starts_with(path, '{a}/')" for a in sorted(set(p.allow)))
    at = address_sql("node")
    return f"""WITH RECURSIVE r AS (SELECT page_id, url, {address_sql('url')} AS at FROM pages WHERE url IS NOT NULL),
l AS (SELECT DISTINCT url AS a, at AS b FROM r),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach(node, seen) AS (SELECT a, a FROM e UNION SELECT reach.node, e.b FROM reach JOIN e ON reach.seen = e.a),
c AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
n AS (SELECT node, component, split_part(split_part(split_part({at}, '/', 1), '?', 1), ':', 1) AS host, split_part({at}, '?', 1) AS path FROM c),
f AS (SELECT node, component, ({bad}) AS b, ({good}) AS g FROM n),
w AS (SELECT component, bool_or(b) AS b, bool_or(g) AS g FROM f GROUP BY component)
SELECT page_id, url, f.component, CASE WHEN f.g THEN 'allow' WHEN f.b THEN 'block' ELSE 'pass' END AS own,
 CASE WHEN w.g THEN 'allow' WHEN w.b THEN 'block' ELSE 'pass' END AS decision
FROM r JOIN f ON f.node = r.url JOIN w ON w.component = f.component"""
