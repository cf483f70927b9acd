"""URL filter with redirect equivalence.

Rules block or allow hosts and paths. URLs that redirect to each other, or name each other as canonical, are one
document: their connected component shares a block decision, and an explicit allow comes first.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayspell.llm.common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK_TAG = r'''(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>'''
META_TAG = r'''(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>'''
HREF = r'''(?is)\bhref\s*=\s*["']?([^"'\s>]+)'''
REFRESH_TO = r'''(?is)\burl\s*=\s*['"]?([^"'\s>]+)'''


def behind_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty if there is none or the url is null."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")), F.lit(""))


def with_parts(df: DataFrame, url: str) -> DataFrame:
    """Adds u (the url), rest, host and path."""
    return (df.withColumn("u", F.col(url)).withColumn("rest", behind_scheme(F.col("u")))
            .withColumn("host", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)))


def address(host: Column, rest: Column) -> Column:
    """The node of a url: host, path and query; scheme and fragment name no other document."""
    return F.concat(host, F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule whose host is the url's or one above it and whose path begins the url's (null: none).
    Of equally long ones an allow comes first."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), rules[r] == "allow", r)):
        own, slash, start = rule.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(slash + start)
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def rule_verdict(rule: Column, rules: dict[str, str]) -> Column:
    verdict = F.lit(None).cast("string")
    for name, what in rules.items():
        verdict = F.when(rule == name, F.lit(what)).otherwise(verdict)
    return verdict


def _resolved(target: Column) -> Column:
    """An absolute url for a link target, seen from columns u, rest and host; null if it names no other page."""
    plain = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme = F.expr("substring(u, 1, instr(u, '://') + 2)")
    authority = F.regexp_extract("rest", r"^[^/?#]*", 0)
    folder = F.regexp_extract("rest", r"^[^/?#]*(/[^?#]*/|/)", 1)
    return (F.when((plain == "") | plain.startswith("#"), F.lit(None))
            .when(plain.contains("://"), plain)
            .when(F.col("rest") == "", F.lit(None))
            .when(plain.startswith("//"), F.concat(F.replace(scheme, F.lit("//"), F.lit("")), plain))
            .when(plain.startswith("/"), F.concat(scheme, authority, plain))
            .when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(scheme, authority, F.when(folder == "", F.lit("/")).otherwise(folder), plain)))


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(a, b) addresses that are one document: canonical links and refresh redirects of the pages' html, and the rows
    of `redirects` (from_url, to_url). Null and unresolvable targets bring no edge."""
    links = with_parts(pages.select("url", "html"), "url").where("rest <> ''").select(
        "u", "rest", "host",
        F.explode(F.array(
            F.regexp_extract(F.regexp_extract("html", LINK_TAG, 0), HREF, 1),
            F.regexp_extract(F.regexp_extract("html", META_TAG, 0), REFRESH_TO, 1))).alias("target"),
    ).where("target <> ''").select(address(F.col("host"), F.col("rest")).alias("a"), _resolved(F.col("target")).alias("to"))
    if redirects is not None:
        own = with_parts(redirects.select("from_url", "to_url"), "from_url").where("rest <> ''")
        links = links.union(own.select(address(F.col("host"), F.col("rest")).alias("a"), F.col("to_url").alias("to")))
    return (with_parts(links, "to").where("rest <> ''")
            .select("a", address(F.col("host"), F.col("rest")).alias("b")).where("a <> b").distinct())


def judge(pages: DataFrame, rules: dict[str, str], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by for every row of `pages` (page_id, url, html).

    A url with a fitting rule gets that rule's verdict. Any other gets its component's: allow if a member is
    explicitly allowed, else block if a member is blocked, else allow. Members are also addresses that occur only as
    targets. Null urls or html, repeated rows and equal ids give a row each; other columns are not read.
    """
    edges = alias_edges(pages, redirects)
    groups = connected_components(edges)
    host = F.regexp_extract("node", r"^[^/?#]*", 0)
    path = F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1)
    said = groups.withColumn("said", rule_verdict(fitting_rule(host, path, rules), rules))
    shared = said.groupBy("component").agg(
        F.max((F.col("said") == "allow").cast("int")).alias("allowed"),
        F.max((F.col("said") == "block").cast("int")).alias("blocked"))
    by_alias = (groups.join(shared, "component").where("coalesce(allowed, 0) = 0 and blocked = 1")
                .select("node", F.lit("block").alias("alias_verdict")))
    own = with_parts(pages.select("page_id", "url"), "url")
    own = own.withColumn("node", address(F.col("host"), F.col("rest"))).withColumn(
        "rule", fitting_rule(F.col("host"), F.col("path"), rules))
    own = own.select("page_id", "host", "path", "rule", "node").join(by_alias, "node", "left")
    by_rule = rule_verdict(F.col("rule"), rules)
    return own.select(
        "page_id", "host", "path", "rule",
        F.coalesce(by_rule, "alias_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), F.lit("rule")).when(F.col("alias_verdict").isNotNull(), F.lit("alias"))
        .otherwise(F.lit("default")).alias("decided_by"))


def parse_rules(lines: str) -> dict[str, str]:
    """`block net/, allow example.net/en/` as a mapping from rule to verdict."""
    found = re.findall(r"(block|allow)\s+([^\s,]+)", lines)
    return {rule: what for what, rule in found}
