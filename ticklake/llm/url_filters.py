"""Block decisions over urls that redirect to, or name as canonical, each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep
from .components import components

BLOCK, ALLOW = "block", "allow"
# (verdict, host, path): the rules of the contract
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def resolved(ref: Column, base: Column) -> Column:
    """``ref`` as a whole url, seen from the page ``base`` (RFC 3986); null if it names no page or ``base`` has no host.

    Whole urls stay as they are.  ``//host/path`` takes the scheme, ``/path`` also
    the host, ``?query`` also the path, and ``path`` the folder of ``base``; ``.`` and
    ``..`` are taken out of paths.  ``#part`` is ``base`` itself.
    """
    scheme = "^[A-Za-z][A-Za-z0-9+.-]*:"
    root = F.regexp_extract(base, scheme + "//[^/?#]+", 0)
    own = F.regexp_extract(base, scheme + "//[^/?#]+([^?#]*)", 1)
    folder = F.when(own == "", F.lit("/")).otherwise(F.regexp_replace(own, "[^/]*$", ""))
    end = F.regexp_extract(ref, "[?#].*$", 0)
    given = F.regexp_extract(ref, "^[^?#]*", 0)
    full = F.when(given.startswith("/"), given).otherwise(F.concat(folder, given))
    parts = F.split(F.substring(full, 2, F.length(full)), "/", -1)
    last = F.get(parts, F.size(parts) - 1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    clean = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit("")))
    return (
        F.when(ref.rlike(scheme + "//"), ref)
        .when((ref == "") | (root == "") | ref.rlike(scheme), F.lit(None).cast("string"))
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, scheme, 0), ref))
        .when(ref.startswith("#"), base)
        .when(ref.startswith("?"), F.concat(root, own, ref))
        .otherwise(F.concat(root, clean, end))
    )


def links(pages: DataFrame) -> DataFrame:
    """``a, b``: redirects (``http-equiv=refresh``) and canonical links that the ``html`` of a page names, as whole urls.

    Tags may run over several lines; those inside comments, scripts and styles do not
    count, and one that is not closed runs to the end.  ``rel`` may hold several words.
    Relative targets are seen from the page's ``<base href>``, or else from its url.
    """
    value = "\\s*=\\s*[\"']?\\s*([^\"'\\s>]+)"
    attr = "(?is)(?<![\\w-])"
    word = lambda q, x: f"{q}(?:[^{q}]*\\s)?{x}(?:\\s[^{q}]*)?{q}"
    names = lambda a, x: f"(?<![\\w-]){a}\\s*=\\s*(?:" + word('"', x) + "|" + word("'", x) + f"|{x}(?=[\\s/>]))"
    hidden = r"<!--.*?(?:-->|\z)|<(script|style)\b.*?(?:</\1\s*>|\z)"
    found = F.regexp_extract_all("html", F.lit(f"(?is){hidden}|<(?:link|meta|base)\\b[^>]*>"), F.lit(0))
    tags = F.filter(found, lambda x: x.rlike("(?i)^<[lmb]"))
    tag = pages.where("url is not null and html is not null").select("url", tags.alias("tags")).select("url", "tags", F.explode("tags").alias("tag"))
    seat = F.get(F.filter(F.transform("tags", lambda x: F.regexp_extract(x, "(?is)^<base\\b.*?(?<![\\w-])href" + value, 1)), lambda x: x != ""), F.lit(0))
    canonical = F.when(F.col("tag").rlike("(?is)^<link\\b.*?" + names("rel", "canonical")), F.regexp_extract("tag", attr + "href" + value, 1))
    redirect = F.when(F.col("tag").rlike("(?is)^<meta\\b.*?" + names("http-equiv", "refresh")), F.regexp_extract("tag", attr + "url" + value, 1))
    plain = lambda x: F.regexp_replace(x, "&amp;", "&")
    found = tag.select("url", "tags", plain(F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(redirect, F.lit("")))).alias("ref")).where("ref is not null")
    found = found.select("url", "ref", plain(seat).alias("seat"))
    base = F.coalesce(resolved(F.col("seat"), F.col("url")), F.col("url"))
    return found.select(F.col("url").alias("a"), resolved(F.col("ref"), base).alias("b")).where("b is not null")


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule (host and path together) that fits, as ``struct(rule, verdict)``; null if none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    Of rules of equal length the one that allows wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != ALLOW, r))
    found = None
    for verdict, h, p in ordered:
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, what) if found is None else found.when(fits, what)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def judged(pages: DataFrame, *, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, component`` for every row of ``pages(page_id, url, html)``.

    A url that a rule fits gets the rule's verdict: an explicit allow holds
    whatever its aliases are.  Any other is blocked if a url it is equivalent to
    is blocked by a rule, else allowed.  Urls are equivalent if redirect or
    canonical-link edges connect them, in either direction and over any number of
    steps; edges come from the pages' html and from ``redirects(from_url,
    to_url)``.  A target that is no page is judged by the rules as well.

    Components come from :func:`components` (minima and joins only).  Only urls
    with an edge take part; the rest is judged where it lies.  Null url: empty
    host and path, no rule, allowed.  Null html has no edges; a null page_id is
    kept; repeated rows count each; an empty table gives an empty result.
    """
    url = F.col("url")
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select(F.col("from_url").alias("a"), F.col("to_url").alias("b")))
    edges = keep(edges.where("a is not null and b is not null and a != b").distinct())
    rows = pages.select("page_id", "url", host(url).alias("host"), path(url).alias("path")).withColumn("own", fitting_rule(F.col("host"), F.col("path"), rules))
    if edges.isEmpty():
        rows = rows.withColumn("component", F.lit(None).cast("string")).withColumn("spread", F.lit(None).cast("boolean"))
    else:
        node = components(edges)
        node = keep(node.withColumn("blocked", F.coalesce(fitting_rule(host(F.col("node")), path(F.col("node")), rules)["verdict"] == BLOCK, F.lit(False))))
        spread = node.groupBy("component").agg(F.max("blocked").alias("spread")).where("spread")
        blocked = keep(node.join(spread, "component", "left").select(F.col("node").alias("url"), "component", "spread"))
        rows = rows.join(blocked, "url", "left")
    verdict = F.coalesce(F.col("own.verdict"), F.when(F.col("spread"), F.lit(BLOCK)), F.lit(ALLOW))
    return rows.select("page_id", "host", "path", F.col("own.rule").alias("rule"), verdict.alias("verdict"), "component")
