"""Operator 10: URL rules, and trust and distrust propagated over the host graph.

A rule decides the urls that it fits. For all others the host decides: trust flows from
hosts with allowed pages along links, distrust from hosts with blocked pages against
them (who links to a blocked host is suspect), each as a personalised PageRank over
host edges; a host whose distrust outweighs its trust is blocked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, written

DAMPING = 0.85
ROUNDS = 20
#: Share of a host's distrust in trust and distrust from which on it is blocked.
MAX_DISTRUST = 0.5


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def ruled(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """pages (with host and path) and the rule and verdict of the longest fitting (verdict, host, path), else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("host") == at) | F.col("host").endswith("." + at)) & F.col("path").startswith(start)
        rule, verdict = F.when(fits, at + start).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return pages.withColumns({"rule": rule, "ruled": verdict})


#: A host after `http://` or `https://` anywhere in a page, or after `//` at the start of an attribute or a refresh.
_LINK = "(?i)(?:https?://|(?:=\\s{0,9}[\"']?|;\\s{0,9}url=)\\s{0,9}//)(?:[^/?#@\"'\\s<>]{0,99}@)?([^/?#:@\"'\\s<>&,;()]+)"


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): pages of host src that link to, or name a url of, another host dst."""
    links = F.regexp_extract_all(F.coalesce(F.col("html"), F.lit("")), F.lit(_LINK), F.lit(1))
    each = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(links, F.lower))).alias("dst"))
    return each.filter("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank) by rounds of PageRank over edges (src, dst, n), restarting at seeds (host, weight).

    Weights are scaled to a sum of one. In each round a host passes DAMPING of its rank
    along its edges; all that is not passed on, which includes the whole rank of hosts
    without outgoing edges, goes back to the seeds, so the ranks always add up to one.
    Without edges the ranks are the seeds' weights.

    A round joins the ranks that came along edges, and the seeds' share, as they are (the
    step is linear), so both sides of the join are plain tables and adaptive execution
    can split a hub's edges.
    """
    weight = seeds.agg(F.sum("weight")).first()[0] or 0.0
    if not weight:
        return seeds.select("host", F.lit(0.0).alias("rank")).limit(0)
    start = written(seeds.select("host", (F.col("weight") / weight).alias("rank")), "seeds")
    if edges.isEmpty():
        return start
    total = written(edges.groupBy("src").agg(F.sum("n").alias("out")), "out")
    share = written(edges.join(bounded(total), "src").select("src", "dst", (F.col("n") / F.col("out")).alias("share")), "shares")
    now = start
    for _ in range(rounds):
        along = now.join(share, now.host == share.src).groupBy(F.col("dst").alias("host"))
        passed = written(along.agg((DAMPING * F.sum(F.col("rank") * F.col("share"))).alias("rank")), "rank")
        back = 1 - (passed.agg(F.sum("rank")).first()[0] or 0.0)
        now = passed.union(start.select("host", F.lit(back) * F.col("rank")))
    return now.groupBy("host").agg(F.sum("rank").alias("rank"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], max_distrust: float = MAX_DISTRUST) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of pages (page_id, url, html).

    A host with allowed pages is a trusted seed, one with blocked pages a blocked seed,
    by the share of its pages. A url that no rule fits is blocked if its host's distrust
    is over max_distrust of trust and distrust together; hosts that nothing reaches are
    allowed.

    A null url, or one without `://`, has an empty host and path, which no rule fits, and
    is allowed. Null html has no links; very long html is searched whole. Repeated rows give repeated rows; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = pages.select("page_id", "html", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    marked = ruled(rows, rules)
    seeds = marked.filter("host <> ''").groupBy("host").agg(F.avg((F.col("ruled") == "allow").cast("int")).alias("a"), F.avg((F.col("ruled") == "block").cast("int")).alias("b"), F.count("*").alias("pages"), F.count("ruled").alias("ruled"))
    share = F.col("ruled") / F.col("pages")
    seeds = written(seeds.filter("ruled > 0").select("host", (F.col("a") * share).alias("a"), (F.col("b") * share).alias("b")), "hosts")
    edges = written(host_edges(marked), "links")
    trust = personalised_rank(edges, seeds.filter("a > 0").select("host", F.col("a").alias("weight")))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_rank(back, seeds.filter("b > 0").select("host", F.col("b").alias("weight")))
    both = trust.withColumnRenamed("rank", "trust").join(distrust.withColumnRenamed("rank", "distrust"), "host", "full_outer")
    both = written(both.fillna(0.0, ["trust", "distrust"]), "hosts")
    joined = marked.drop("html").join(bounded(both), "host", "left").fillna(0.0, ["trust", "distrust"])
    suspect = F.col("distrust") > max_distrust * (F.col("trust") + F.col("distrust"))
    verdict = F.coalesce("ruled", F.when(suspect, "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
