"""URL filters: host rules first, link-graph trust for what no rule decides. DataFrame functions only.

Rules name a host (with its subdomains) and a path prefix; the longest rule that fits a url decides. Hosts that rules allow
are trusted seeds, hosts that rules block are distrusted seeds, each weighted by the pages the rules decided. Trust runs
along host edges (personalised PageRank), distrust runs against them (who links to a blocked host is suspect). Edges come
from absolute links of the pages and, both ways, from the domain tree (a host and its parent domain). A url that no rule
fits takes the verdict of its host: block where distrust exceeds ``threshold`` times trust.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.session import ensure_checkpoint_dir

#: Fixed values: (host and path prefix, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING = 0.85
ROUNDS = 10
THRESHOLD = 4.0
_LINK = r"""(?i)href\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]++)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*+)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*+([^?#]*+)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is ``host`` or a parent domain of it and whose path starts ``path``; null for none."""
    def fits(rule: str) -> Column:
        rule_host, slash, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r[0]), r[0]))
    return F.coalesce(*[F.when(fits(rule), F.lit(rule)) for rule, _ in ordered], F.lit(None).cast("string"))


def rule_verdict(rule: Column, rules=RULES) -> Column:
    return reduce(lambda out, r: out.when(rule == r[0], F.lit(r[1])), rules[1:], F.when(rule == rules[0][0], F.lit(rules[0][1])))


def parent_of(host: Column) -> Column:
    """The domain above (never a single label)."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*+\.", ""))


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src, dst, weight: links between different hosts (counted) and the domain tree both ways (weight 1)."""
    own = pages.select(host_of(F.col(url_col)).alias("src"), F.regexp_extract_all(F.col(html_col), F.lit(_LINK), F.lit(1)).alias("links"))
    linked = own.where("src != ''").select("src", F.explode("links").alias("link")).select("src", host_of(F.col("link")).alias("dst"))
    linked = linked.where("dst != '' AND dst != src").groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    hosts = own.select(F.col("src").alias("host")).union(linked.select("dst")).where("host != ''").distinct()
    tree = hosts.select("host", parent_of(F.col("host")).alias("up")).where("up IS NOT NULL").distinct()
    both = tree.select(F.col("host").alias("src"), F.col("up").alias("dst")).union(tree.select("up", "host")).withColumn("weight", F.lit(1.0))
    return linked.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def _spread_out(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """Personalised PageRank from ``seeds`` (host, seed: shares that add up to 1) along ``edges``.

    What a host without outgoing edges holds is not passed on. The number of rounds is fixed, so results do not depend on
    when a run stops.
    """
    total = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = edges.join(total, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share"))
    rank = seeds.select("host", F.col("seed").alias("score"))
    for done in range(1, rounds + 1):
        passed = rank.join(shares, rank["host"] == shares["src"]).select(F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
        restart = seeds.select("host", (F.col("seed") * (1 - damping)).alias("score"))
        rank = passed.union(restart).groupBy("host").agg(F.sum("score").alias("score"))
        if done % 5 == 0 and done < rounds:
            rank = rank.checkpoint()
    return rank


def host_trust(pages: DataFrame, rules=RULES, url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust for every host that a seed reaches."""
    ensure_checkpoint_dir(pages.sparkSession)
    edges = host_edges(pages, url_col, html_col).checkpoint()
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    decided = pages.select(host.alias("host"), rule_verdict(longest_rule(host, path, rules), rules).alias("verdict")).where("verdict IS NOT NULL AND host != ''")
    counts = decided.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allowed"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    counts = counts.checkpoint()
    allowed, refused = counts.agg(F.sum("allowed"), F.sum("blocked")).first()
    trusted = counts.where("allowed > 0").select("host", (F.col("allowed") / F.lit(allowed)).alias("seed"))
    blocked = counts.where("blocked > 0").select("host", (F.col("blocked") / F.lit(refused)).alias("seed"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    trust = _spread_out(edges, trusted, rounds, damping).withColumnRenamed("score", "trust")
    distrust = _spread_out(back, blocked, rounds, damping).withColumnRenamed("score", "distrust")
    return trust.join(distrust, "host", "full_outer").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, page_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and is allowed. A null html has no links.
    A host that no seed reaches is allowed. Repeated rows are answered one by one and count as seeds each time. Rules of one
    length cannot both fit one url unless they are equal, so there are no ties; an empty table gives an empty result.
    """
    judged = pages.select(F.col(page_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    judged = judged.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    scores = host_trust(pages, rules, url_col, html_col, rounds, damping)
    blocked = F.coalesce(F.col("distrust") > F.col("trust") * F.lit(threshold), F.lit(False))
    verdict = F.coalesce(rule_verdict(F.col("rule"), rules), F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return judged.join(scores, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"),
                                                      F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
