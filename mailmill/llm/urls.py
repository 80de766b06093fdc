"""URL filters: rules decide the pages they name, and pass trust and distrust on over links of hosts.

Trust starts at the hosts of pages that an allow rule names and follows links
(personalised PageRank). Distrust starts at the hosts of pages that a block rule
names and follows links backwards: who links to the blocked is suspect. A host
whose distrust is larger than `threshold` times its trust is blocked.

Only DataFrame functions are used. Links are counted per pair of hosts before
anything else, so an iteration moves one row per pair, and sums per host combine
before their shuffle. Each iteration's ranks are written to the shared folder.

A null url, or one without `://`, has an empty host and path; no rule fits it and
no link leaves it: it is allowed. Null html has no links. Repeated pages count as often
as they occur. Without any rule that fits, every page is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailmill.llm.tables import stored


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """(name, verdict) of the longest rule that fits, else null; of equal ones the first named."""
    fitting = None
    for rule in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.struct(F.lit(rule.host + rule.path).alias("name"), F.lit(rule.verdict).alias("verdict"))
        fitting = F.when(fits, found) if fitting is None else fitting.when(fits, found)
    return F.lit(None).cast("struct<name:string,verdict:string>") if fitting is None else fitting


def site_of(host: Column, labels: int) -> Column:
    """The last labels of a host name, by which its subdomains belong together."""
    return F.substring_index(host, ".", -labels)


def host_links(pages: DataFrame, site_labels: int = 3) -> DataFrame:
    """(src, dst, n): links of pages between different hosts, and between a host and its site."""
    hosts = pages.select(host_of(F.col("url")).alias("src"), F.col("html")).where("src != ''")
    linked = hosts.select("src", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("dst"))
    linked = linked.withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    site = site_of(F.col("src"), site_labels)
    own = hosts.select("src", F.explode(F.array(F.struct(F.col("src").alias("a"), site.alias("b")), F.struct(site.alias("a"), F.col("src").alias("b")))).alias("x")).select(F.col("x.a").alias("src"), F.col("x.b").alias("dst"))
    links = linked.unionByName(own).where("src != dst")
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, iterations: int = 6) -> DataFrame:
    """(host, trust, distrust) of personalised PageRank both ways from `seeds` (host, trust, distrust).

    Rank at a host without links onwards ends there. Each sort of rank sums to one at most.
    """
    out = links.groupBy("src").agg(F.sum("n").alias("all_out"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all_in"))
    shares = links.join(out, "src").join(into, "dst")
    onward = shares.select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all_out")).alias("t"), F.lit(0.0).alias("d"))
    back = shares.select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("n") / F.col("all_in")).alias("d"))
    steps = stored(onward.unionByName(back).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")), "link-shares")
    start = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    start = stored(start, "seeds")
    ranks = start
    for _ in range(iterations):
        moved = steps.join(ranks, "host").select(
            F.col("to").alias("host"), (F.col("trust") * F.col("t") * damping).alias("trust"), (F.col("distrust") * F.col("d") * damping).alias("distrust")
        )
        ranks = stored(moved.unionByName(start).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
    return ranks


def seeds_of(judged: DataFrame) -> DataFrame:
    """Shares of all allowed and of all blocked pages per host, of those that a rule names."""
    own = judged.where("rule is not null").groupBy("host").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    total = own.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    # The totals are one row.
    share = lambda n, of: F.coalesce(F.try_divide(F.col(n), F.col(of)), F.lit(0.0))
    return own.join(F.broadcast(total)).select("host", share("a", "all_a").alias("trust"), share("b", "all_b").alias("distrust"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = 0.85, iterations: int = 6, threshold: float = 1.0, site_labels: int = 3) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every page, repeated ones included."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    found = split.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    ruled = found.select("page_id", "host", "path", F.col("found.name").alias("rule"), F.col("found.verdict").alias("verdict"))
    ranks = propagate(host_links(pages, site_labels), seeds_of(ruled), damping, iterations)
    method = F.when(F.col("distrust") > F.col("trust") * threshold, "block").otherwise("allow")
    return ruled.join(ranks, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
