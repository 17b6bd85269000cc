"""URL filters with redirect equivalence (operator 1, DataFrame functions only).

Rules (host, path, allow or block) fit a host and all its subdomains if the url's path starts with
the rule's; the longest rule wins.  A url that no rule fits takes the decision of its aliases: urls
joined by redirect or canonical-link edges are one component, found by distributed connected
components.  An explicit allow in a component takes precedence over any block in it.  Of two fitting
rules of one length an allow wins, then the one of the longer host.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

#: Rules up to this number are literals in the plan; more are joined by host suffix.
MAX_LITERAL_RULES = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL_TAG = r"(?i)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
REFRESH_TAG = r"(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url as a node of the alias graph: scheme and host in lower case, without the fragment."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.translate(F.substring_index(bare, "://", 1), UPPER, LOWER)
    tail = F.regexp_extract(_rest(bare), r"(?s)^[^/?#]*(.*)$", 1)
    return F.when(F.instr(bare, "://") > 0, F.concat(scheme, F.lit("://"), host_of(bare), F.when(tail == "", "/").otherwise(tail)))


def resolve(base: Column, href: Column) -> Column:
    """An absolute url for a link: absolute, scheme-relative, host-relative or path-relative."""
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^/?#]*)*)/[^/?#]*", 1)
    folder = F.when(folder == "", origin).otherwise(folder)
    href = F.replace(href, F.lit("&amp;"), F.lit("&"))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(a, b): node pairs from canonical links and refresh redirects in html."""
    links = pages.where("url IS NOT NULL AND html IS NOT NULL").select("url", F.regexp_extract_all("html", F.lit(CANONICAL_TAG), 0).alias("c"), F.regexp_extract_all("html", F.lit(REFRESH_TAG), 0).alias("r"))
    links = links.where("size(c) > 0 OR size(r) > 0")
    hrefs = F.concat(F.transform("c", lambda x: F.regexp_extract(x, HREF, 1)), F.transform("r", lambda x: F.regexp_extract(x, REFRESH_URL, 1)))
    links = links.select("url", F.explode(hrefs).alias("href")).where("href != ''")
    return links.select(node_of(F.col("url")).alias("a"), node_of(resolve(F.col("url"), F.col("href"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    whole = rule_host == ""
    return (whole | (host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def _literal_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The winning rule as a struct, by a chain of conditions from the longest rule down."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", -len(r[0])))
    out = None
    for host, path, action in ordered:
        fit = _fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path))
        value = F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fit, value) if out is None else out.when(fit, value)
    return out if out is not None else F.lit(None).cast("struct<rule: string, action: string>")


def _joined_rules(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The winning rule of every distinct (host, path), by an equi-join on host suffixes."""
    spark = urls.sparkSession
    table = spark.createDataFrame(sorted(set(rules)), "rule_host string, rule_path string, action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().withColumn("rule_host", F.explode(F.array_distinct(F.concat(suffixes, F.array(F.lit(""))))))
    fits = each.join(table, "rule_host").where(F.startswith("path", "rule_path"))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")), F.col("action") == "allow", F.length("rule_host"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "action"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, component) of every page.

    pages: page_id, url and, for edges, html.  edges: (a, b) urls that redirect or link canonically to
    each other, besides those in html.  verdict is the rule's; where none fits, that of the url's
    component: allow if a rule allows any of its urls, else block if a rule blocks one, else allow.
    component is the least url of the component, or null where the url has no edge.
    A null url, or one without ://, has empty host and path and no alias.  Repeated pages give a row
    each; further columns of pages are ignored.
    """
    has_html = "html" in pages.columns
    own = pages.select("page_id", "url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url")), "node": node_of(F.col("url"))})
    judged = own.withColumn("best", _literal_rule(rules)) if len(rules) <= MAX_LITERAL_RULES else _joined_rules(own, rules)
    judged = judged.select("page_id", "url", "host", "path", "node", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))
    links = page_edges(pages) if has_html else None
    if edges is not None:
        given = edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        links = given if links is None else links.unionByName(given)
    verdicts = None
    if links is not None:
        links = materialize(links.where("a != b").distinct(), "links")
        component = connected_components(links)
        # urls that are only linked to are judged by the rules as well
        linked = component.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))})
        linked = linked.withColumn("best", _literal_rule(rules)) if len(rules) <= MAX_LITERAL_RULES else _joined_rules(linked, rules)
        state = linked.groupBy("component").agg(F.bool_or(F.col("best.action") == "allow").alias("allowed"), F.bool_or(F.col("best.action") == "block").alias("blocked"))
        verdicts = component.join(state, "component").select("node", "component", "allowed", "blocked")
        # urls without a node have no alias, and null keys would all meet in one task
        alone = judged.where("node IS NULL").withColumns({"component": F.lit(None).cast("string"), "allowed": F.lit(None).cast("boolean"), "blocked": F.lit(None).cast("boolean")})
        judged = judged.where("node IS NOT NULL").join(verdicts, "node", "left").unionByName(alone)
    else:
        judged = judged.withColumns({"component": F.lit(None).cast("string"), "allowed": F.lit(None).cast("boolean"), "blocked": F.lit(None).cast("boolean")})
    method = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "url", "host", "path", "rule", F.coalesce("action", method).alias("verdict"), "component")
