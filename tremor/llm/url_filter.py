"""URL filters: host and path rules, and for the rest a verdict of the host from link-graph propagation.

Personalised PageRank runs over the host graph twice at once: trust along the links from hosts with allowed
pages, distrust against the links from hosts with blocked pages (who links to bad hosts is suspect).  A host is
blocked if its distrust exceeds its trust by `threshold`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm.common import without, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
DAMPING, THRESHOLD = 0.85, 0.05
#: Propagation ends when no host's trust or distrust changes by more.
TOLERANCE = 1e-6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first :// (A-Z lower-cased) and path up to ? or #; both empty without ://."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits (null: none), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last that fits wins
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, share, back): links between different hosts, as shares of src's links and of dst's."""
    found = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)\bhref\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1)))
    target = host_and_path(F.concat(F.lit("x:"), F.regexp_replace("link", r"^[^/]*:", "")))[0]
    links = (pages.filter(F.col(host) != "").select(F.col(host).alias("src"), found.alias("link")).select("src", target.alias("dst"))
             .filter("dst <> '' and src <> dst").groupBy("src", "dst").count())
    links = written(pages.sparkSession, links, "host-links")
    out, into = (links.groupBy(k).agg(F.sum("count").alias(n)) for k, n in (("src", "sent"), ("dst", "got")))
    return written(pages.sparkSession, links.join(out, "src").join(into, "dst")
                   .select("src", "dst", (F.col("count") / F.col("sent")).alias("share"), (F.col("count") / F.col("got")).alias("back")), "host-graph")


def propagate(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) when they no longer change; seeds (host, allowed, blocked) hold every seed host.

    Three rounds at a time, the scores are written to the shared folder and held against those before: a round passes
    on at most `damping` of what changed, so the changes shrink by that factor and the loop ends.  Without links the
    seeds alone count; null hosts take no part.
    """
    spark = seeds.sparkSession
    start = seeds.select("host", (F.col("allowed") * (1 - damping)).alias("trust"), (F.col("blocked") * (1 - damping)).alias("distrust"))
    scores = start = written(spark, start.filter("host is not null"), "seeds")
    if links.isEmpty():
        return scores
    while True:
        before = scores
        for _ in range(3):
            sent = links.join(scores, F.col("src") == F.col("host")).select(
                F.col("dst").alias("host"), (F.col("trust") * F.col("share") * damping).alias("trust"), F.lit(0.0).alias("distrust"))
            back = links.join(scores, F.col("dst") == F.col("host")).select(
                F.col("src").alias("host"), F.lit(0.0).alias("trust"), (F.col("distrust") * F.col("back") * damping).alias("distrust"))
            scores = start.union(sent).union(back).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        scores = written(spark, scores, "trust")
        old = before.select(F.col("host").alias("h"), F.col("trust").alias("t"), F.col("distrust").alias("d"))
        moved = F.greatest(*[F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) for a, b in (("trust", "t"), ("distrust", "d"))])
        most = scores.join(old, F.col("host") == F.col("h"), "full").agg(F.max(moved).alias("m")).first()["m"]
        if (most or 0.0) <= tolerance:
            return scores


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url", html: str = "html", threshold: float = THRESHOLD,
          damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """`pages` without `html`, with host, path, rule and verdict.

    A page's verdict is that of its longest rule, else its host's: block where distrust - trust exceeds the
    threshold, allow otherwise (and for pages without a host).  Seeds are the shares of a host's pages that rules
    allow and block.  Columns named like the new ones are replaced; an empty table gives no rows.
    """
    spark = pages.sparkSession
    if url not in ("host", "path", "rule", "verdict"):
        pages = without(pages, "host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(f"`{url}`"))
    named = pages.withColumn("host", host).withColumn("path", path)
    narrow = named.select(*[F.col(f"`{c}`") for c in named.columns if c != html])
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = written(spark, narrow.withColumn("rule", rule).withColumn("verdict", verdict), "ruled")
    seeds = (ruled.filter("host <> ''").groupBy("host").agg(F.avg((F.col("verdict") == "allow").cast("double")).alias("a"),
             F.avg((F.col("verdict") == "block").cast("double")).alias("b"), F.count("*").alias("n"), F.count("verdict").alias("known"))
             .select("host", F.coalesce(F.col("a") * F.col("known") / F.col("n"), F.lit(0.0)).alias("allowed"),
                     F.coalesce(F.col("b") * F.col("known") / F.col("n"), F.lit(0.0)).alias("blocked")))
    scores = propagate(seeds, host_links(named, "host", f"`{html}`"), damping, tolerance)
    bad = scores.filter(F.col("distrust") - F.col("trust") > threshold).select("host", F.lit("block").alias("by_host"))
    bad = written(spark, bad, "blocked-hosts")
    return (ruled.join(bad, "host", "left").withColumn("verdict", F.coalesce("verdict", "by_host", F.lit("allow")))
            .select(*[F.col(f"`{c}`") for c in ruled.columns]))
