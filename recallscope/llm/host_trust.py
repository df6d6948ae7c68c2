"""URL filter: rules first, then trust and distrust spread over the host graph.

Links are taken from the pages' html and summed to weighted edges between hosts.
Trust is a personalised PageRank from trusted hosts along the links; distrust the
same from blocked hosts against them (who links to bad hosts is suspect). A host
is blocked if its distrust reaches a threshold and exceeds its trust. Seeds are
the hosts most of whose pages a rule decides, and the hosts without pages, known
from links only, that a rule decides as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recallscope.llm.passing import packed, unpacked
from recallscope.session import materialize

DAMPING = 0.85
ROUNDS = 30
SETTLED = 1e-6
THRESHOLD = 0.02
ADDED = ("host", "path", "rule", "verdict", "trust", "distrust")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def suffixes(host: Column) -> Column:
    """The host and the domains above it."""
    labels = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def links(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): weighted edges between different hosts. Relative links stay on
    their host and make no edge; ``//host/...`` and absolute links do."""
    target = F.explode(F.regexp_extract_all(F.col(html), F.lit(r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s>]+)"), F.lit(1)))
    found = pages.where(F.col(host) != "").select(F.col(host).alias("src"), target.alias("to"))
    to = F.translate(F.regexp_extract("to", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1), UPPER, LOWER)
    return (found.select("src", to.alias("dst")).where("dst != '' and dst != src")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, settled: float = SETTLED) -> DataFrame:
    """(host, rank): ranks that start from the hosts of ``seeds`` (equal shares) and
    follow ``edges`` (src, dst, n); mass at hosts without links returns to the seeds.
    Ranks are in shares of a seed (a seed nobody links to has 1 - DAMPING at least).
    Each round is one join and one aggregate and is written to the checkpoint folder."""
    total = edges.groupBy("src").agg(F.sum("n").alias("out"))
    moves = materialize(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("out")).alias("w")))
    seeds = materialize(seeds.select("host").distinct().withColumn("start", F.lit(1.0)))
    count = seeds.count()
    ranks = seeds.select("host", F.col("start").alias("rank"))
    if not count or moves.isEmpty():
        return ranks
    for _ in range(rounds):
        moved = moves.join(ranks, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("rank") * F.col("w")).alias("r"))
        arrived = materialize(moved.groupBy("host").agg(F.sum("r").alias("r")))
        kept = arrived.agg(F.sum("r")).first()[0] or 0.0
        back = (1 - DAMPING) + DAMPING * (1 - kept / count)  # dangling mass goes back to the seeds
        new = materialize(arrived.select("host", (F.col("r") * DAMPING).alias("rank"))
                          .unionByName(seeds.select("host", (F.col("start") * back).alias("rank")))
                          .groupBy("host").agg(F.sum("rank").alias("rank")))
        change = (new.withColumnRenamed("rank", "a").join(ranks.withColumnRenamed("rank", "b"), "host", "full")
                  .agg(F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0))))).first()[0] or 0.0)
        ranks = new
        if change < settled * count:
            break
    return ranks


def host_trust(pages: DataFrame, rules: DataFrame, url_col: str = "url", html_col: str = "html",
               threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``pages`` without the html, with ``host``, ``path``, ``rule`` (the longest that
    fits, like ``net/``; else null), ``verdict`` (``allow`` or ``block``: the rule's, else
    the host's by trust and distrust), ``trust`` and ``distrust`` of the host.

    ``rules`` has (host, path, verdict); a rule fits its host and all subdomains if
    the url's path starts with its path; rules that say the same twice are one, and
    of contradicting ones block wins. A null url, or one without ``://``, has an empty
    host and path, no rule and is allowed; a null html has no links. Repeated rows
    count each; empty tables give empty results (no rules: everything is allowed).
    Input columns named like an added one are replaced. Rules are looked up once per
    distinct host; a host with a third of all pages is combined before the shuffle.
    """
    pages = pages.drop(*[c for c in ADDED if c in pages.columns and c not in (url_col, html_col)])
    passed = [c for c in pages.columns if c != html_col]
    read = pages.select(packed(passed), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    edges = materialize(links(pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))))

    ends = edges.select(F.explode(F.array("src", "dst")).alias("host"))
    hosts = (read.select("host").where("host != ''").unionByName(ends).distinct()
             .select("host", F.explode(suffixes(F.col("host"))).alias("__above")))
    fit = F.struct((F.length("__rule_host") + F.length("__rule_path")).alias("size"), (F.col("__verdict") == "block").alias("blocks"),
                   F.concat("__rule_host", "__rule_path").alias("rule"), F.col("__rule_path").alias("path"))
    named = rules.select(F.col("host").alias("__rule_host"), F.col("path").alias("__rule_path"), F.col("verdict").alias("__verdict"))
    per_host = (hosts.join(named, F.col("__above") == F.col("__rule_host")).groupBy("host")
                .agg(F.sort_array(F.collect_set(fit), asc=False).alias("__fits")))
    per_host = materialize(per_host)

    def fitted(rows: DataFrame) -> DataFrame:
        return rows.join(per_host, "host", "left").withColumn(
            "__fit", F.get(F.filter(F.coalesce("__fits", F.array().cast(per_host.schema["__fits"].dataType)),
                                    lambda r: F.col("path").startswith(r["path"])), F.lit(0)))

    ruled = fitted(read)
    # a host without pages counts as one page at its root
    unseen = ends.distinct().join(read.select("host").distinct(), "host", "left_anti").withColumn("path", F.lit("/"))
    share = ruled.where("host != ''").select("host", "__fit").unionByName(fitted(unseen).select("host", "__fit")).groupBy("host").agg(
        F.avg((F.coalesce(F.col("__fit.blocks"), F.lit(False))).cast("double")).alias("blocked"),
        F.avg((F.col("__fit").isNotNull() & ~F.coalesce(F.col("__fit.blocks"), F.lit(True))).cast("double")).alias("allowed"))
    share = materialize(share)
    trust = personalised_pagerank(edges, share.where("allowed > 0.5").select("host"))
    reverse = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = personalised_pagerank(reverse, share.where("blocked > 0.5").select("host"))
    scores = (share.select("host").join(trust.withColumnRenamed("rank", "trust"), "host", "left")
              .join(distrust.withColumnRenamed("rank", "distrust"), "host", "left")
              .select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    verdict = F.when(F.col("__fit").isNotNull(), F.when(F.col("__fit.blocks"), "block").otherwise("allow")).otherwise(
        F.when(F.coalesce(bad, F.lit(False)), "block").otherwise("allow"))
    return ruled.join(scores, "host", "left").select(
        *unpacked(passed), "host", "path", F.col("__fit.rule").alias("rule"), verdict.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
