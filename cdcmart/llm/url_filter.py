"""URL filter by redirect equivalence, with DataFrame operations only.

Every URL is judged by the longest rule that fits its host and path. URLs that
lead to one another are aliases: distributed connected components over redirect
and canonical-link edges gather them, and a block decision of one member reaches
every member without a rule of its own. Explicit allow rules take precedence:
a URL's own rule always decides for itself, and a component with an explicitly
allowed member is not blocked by its other members.

Edges come from the pages; their targets are references (RFC 3986), resolved against
the page or its ``<base href>``:

* ``<link rel="canonical" href=...>`` and ``<meta property="og:url" content=...>``;
* ``<meta http-equiv="refresh" content="...url=...">``;
* the redirects that a spelling implies: a URL leads to its plain spelling
  without scheme, leading ``www.`` or ``m.`` (where a name that can be registered
  is left), fragment, tracking parameters (``utm_*``, ``ref``) and trailing slash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_AMPERSAND = r"(?i)&(?:amp|#0*38|#x0*26);"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"


# "www." or "m." before two labels or more that are not a public suffix of two labels
_ALIAS_HOST = r"^(?:www|m)\.(?=[^.]+\.[^.])(?!(?:ac|co|com|edu|gov|net|org)\.[a-z]{2}(?::\d+)?$)"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://`` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest of ``(verdict, host, path)``
    that fits, or null. A rule fits its host and all subdomains, where the path
    starts with the rule's. Rules of one length: the first in order."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(enumerate(rules), key=lambda r: (len(r[1][1] + r[1][2]), -r[0]))  # the last that fits wins
    for _, (verdict, rule_host, rule_path) in ranked:
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def plain_spelling(url: Column) -> Column:
    """The spelling that variants of a URL redirect to (see the module)."""
    host = F.regexp_replace(host_of(url), _ALIAS_HOST, "")
    query = F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(r"^(?:utm_[^=]*|ref)(?:=|$)") & (p != "")), "&")
    return F.concat(host, F.regexp_replace(path_of(url), r"/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _targets(html: Column) -> Column:
    """URLs that a page's head declares itself to be or to lead to; references
    of the ampersand are decoded."""
    tags = F.regexp_extract_all(html, F.lit(_TAGS), F.lit(0))
    canonical = r"""(?is)^<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    social = r"""(?is)^<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*\bcontent\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)^<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
    found = F.transform(tags, lambda t: F.array(*[F.regexp_extract(t, p, 1) for p in (canonical, social, refresh)]))
    decoded = F.transform(F.flatten(found), lambda u: F.regexp_replace(u, _AMPERSAND, "&"))
    return F.filter(decoded, lambda u: u != "")


def _base(html: Column, url: Column) -> Column:
    """What references on the page are resolved against: its first ``<base href>``,
    itself resolved against the page, or the page."""
    tag = F.regexp_extract(html, r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    return F.when(tag != "", resolve(F.regexp_replace(tag, _AMPERSAND, "&"), url)).otherwise(url)


def _without_dots(path: Column) -> Column:
    """``path`` (from its first ``/``) without ``.`` and ``..`` segments."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/", -1)
    held = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), F.array().cast("array<string>"),
        lambda out, p: F.when(p == ".", out)
        .when(p == "..", F.when(F.size(out) > 0, F.slice(out, 1, F.size(out) - 1)).otherwise(out))
        .otherwise(F.array_append(out, p)),
    )
    last = F.element_at(parts, -1)
    up = F.when((last == "..") & (F.size(held) > 0), F.slice(held, 1, F.size(held) - 1)).otherwise(held)
    end = F.when(last.isin(".", ".."), F.lit("")).otherwise(last)
    plain = F.concat(F.lit("/"), F.array_join(F.array_append(up, end), "/"))
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), plain).otherwise(path)


def resolve(ref: Column, base: Column) -> Column:
    """The URL that the reference ``ref`` on a page at ``base`` stands for (RFC 3986,
    section 5.2, for bases with a host)."""
    scheme = F.regexp_extract(base, r"(?s)^([^:]*):", 1)
    origin = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _URL, 1))
    path = path_of(base)
    no_fragment = F.regexp_extract(base, r"(?s)^[^#]*", 0)
    ref_path, rest = F.regexp_extract(ref, r"(?s)^[^?#]*", 0), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.regexp_extract(ref, rf"(?s){_SCHEME}//([^/?#]*)([^?#]*)(.*)$", 2)
    cleaned = F.concat(F.regexp_extract(ref, rf"(?s){_SCHEME}//[^/?#]*", 0), _without_dots(whole), F.regexp_extract(ref, rf"(?s){_SCHEME}//[^/?#]*[^?#]*(.*)$", 1))
    merged = F.when(ref_path.startswith("/"), ref_path).otherwise(
        F.concat(F.when(path == "", F.lit("/")).otherwise(F.regexp_replace(path, r"[^/]*$", "")), ref_path)
    )
    return (
        F.when(ref.rlike(f"{_SCHEME}//"), cleaned)
        .when(ref.rlike(_SCHEME), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .when((ref == "") | ref.startswith("#"), F.concat(no_fragment, ref))
        .when(ref.startswith("?"), F.concat(origin, path, ref))
        .otherwise(F.concat(origin, _without_dots(merged), rest))
    )


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], url_col: str = "url", html_col: str = "html", id_col: str = "page_id"
) -> DataFrame:
    """One row per page: ``id_col``, ``host``, ``path``, ``rule`` (that fits, or
    null), ``verdict`` (``allow`` or ``block``) and ``component`` (the smallest
    URL of its aliases; null for a page without a usable url).

    A page without a fitting rule is blocked where a rule blocks one of its
    aliases and none allows one; else it is allowed. A null url, or one without
    ``://``, has empty host and path, no alias and is allowed. A null html has
    no links. Repeated pages get a row each; an empty table gives none.
    """
    url = F.col(url_col)
    usable = F.coalesce(url.contains("://"), F.lit(False))
    read = pages.select(
        F.col(id_col).alias("id"), F.when(usable, url).alias("url"),
        F.when(usable, _targets(F.coalesce(F.col(html_col), F.lit("")))).alias("links"),
        F.when(usable, _base(F.coalesce(F.col(html_col), F.lit("")), url)).alias("base"),
    )
    read = materialize(read, "urls")  # html is read once
    spelled = read.select("url", F.concat(F.lit("//"), plain_spelling(F.col("url"))).alias("to"))
    linked = read.select("url", "base", F.explode("links").alias("to")).select("url", resolve(F.col("to"), F.col("base")).alias("to"))
    linked = linked.where(F.col("to").contains("://"))
    edges = spelled.union(linked).union(linked.select(F.col("to").alias("url"), F.concat(F.lit("//"), plain_spelling(F.col("to"))).alias("to")))
    found = connected_components(edges.select(F.col("url").alias("a"), F.col("to").alias("b")))
    # a plain spelling has no scheme: it is judged as a web address
    as_url = F.when(F.col("node").startswith("//"), F.concat(F.lit("http:"), F.col("node"))).otherwise(F.col("node"))
    own = matching_rule(host_of(as_url), path_of(as_url), rules)["verdict"]
    decided = found.withColumn("own", own).groupBy("component").agg(
        F.max((F.col("own") == "allow").cast("int")).alias("allowed"), F.max((F.col("own") == "block").cast("int")).alias("blocked")
    )
    verdicts = found.join(decided, "component").select(
        F.col("node").alias("url"), "component",
        F.when((F.coalesce("allowed", F.lit(0)) == 0) & (F.coalesce("blocked", F.lit(0)) == 1), "block").otherwise("allow").alias("by_alias"),
    )
    judged = read.select("id", "url").join(verdicts, "url", "left")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    return judged.select(F.col("id").alias(id_col), host.alias("host"), path.alias("path"), "component", "by_alias").withColumn(
        "_own", matching_rule(F.col("host"), F.col("path"), rules)
    ).select(id_col, "host", "path", F.col("_own.rule").alias("rule"), F.coalesce("_own.verdict", "by_alias", F.lit("allow")).alias("verdict"), "component")
