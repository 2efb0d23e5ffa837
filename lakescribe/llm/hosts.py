"""Verdicts on URLs: rules first, and the reputation of the host where no rule fits.

A rule is (host, path, verdict). It fits its host and all subdomains where the URL's path starts with the rule's; of the rules that fit the longest (host and path together) wins, of
equally long ones the one with the longer host, then the least host, path and verdict.

Reputation is empirical Bayes over labelled outcomes of pages (by default those that rules judge). Each host's share of blocked pages has a beta-binomial prior whose mean is its
registered domain's estimate, which is itself shrunk towards its suffix's, and that towards that of all pages. How strongly a level is shrunk is estimated from the data: the
within-parent correlation rho of the level's outcomes by moments gives the prior weight (1 - rho) / rho. A host is blocked where mean - z * sd of its posterior lies above
``limit``, so little evidence blocks nothing.

Where rows go: pages meet their host's row on (host, salt), so a host that holds a third of all pages is dealt to many tasks; counts are summed before they move. What reaches the driver is
two counts and one sum of moments a level, at any size. Only hosts, suffixes of hosts and rules meet by joins that depend on the number of rules.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import salts_for, written

#: Suffixes of more than one label below which domains are registered; any other suffix is a host's last label. A parameter: a full list can be given instead.
SUFFIXES = ("ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
LEAST_RHO, MOST_RHO = 0.001, 0.9
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def registered(host: Column, suffixes: Sequence[str] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain) of a host: a listed suffix or the last label, and one label more (the host itself where it has none)."""
    last, last2, last3 = (F.substring_index(host, ".", -n) for n in (1, 2, 3))
    listed = last2.isin(*suffixes) if suffixes else F.lit(False)
    return F.when(listed, last2).otherwise(last), F.when(listed, last3).otherwise(last2)


def _meet(rows: DataFrame, side: DataFrame, salts: int) -> DataFrame:
    """``rows`` with their host's row of ``side``. A host is dealt to ``salts`` parts by the pages' hashes, and its row goes to the parts that there are."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_row", F.lit(5)), F.lit(salts)).cast("int"))
    parts = rows.select("host", "_salt").distinct().join(side, "host")
    return rows.join(parts, ["host", "_salt"], "left").drop("_salt")


def fitting_rules(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, _rules): for each host the rules of the host and of the domains above it, the winning order first. Hosts without any are left out."""
    spark = hosts.sparkSession
    table = spark.createDataFrame([(h, p, v, len(h) + len(p), len(h)) for h, p, v in rules], "at string, path string, verdict string, n int, nh int")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    found = hosts.select("host", F.explode(above).alias("at")).join(table, "at")
    order = F.struct((-F.col("n")).alias("n"), (-F.col("nh")).alias("nh"), "at", "path", "verdict")
    return found.groupBy("host").agg(F.array_sort(F.collect_set(order)).alias("_rules"))


def _shrinkage(children: DataFrame, parents: DataFrame, on: str) -> float:
    """The prior weight of a level: (1 - rho) / rho, where rho is the correlation of outcomes within a child beyond its parent's rate, by moments."""
    p = F.col("pk") / F.col("pn")
    noise = p * (1 - p)
    rows = children.join(parents.select(on, F.col("k").alias("pk"), F.col("n").alias("pn")), on)
    s, a, b = rows.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)), F.sum(noise), F.sum(noise * (F.col("n") - 1))).first()
    rho = (s - a) / b if b else LEAST_RHO
    rho = min(MOST_RHO, max(LEAST_RHO, rho))
    return (1 - rho) / rho


def reputations(outcomes: DataFrame, hosts: DataFrame, *, limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(host, reputation, bound, blocked) of each of ``hosts`` (distinct host): posterior mean of the share of blocked pages, its lower bound, and whether that lies above ``limit``.

    ``outcomes`` has a row per labelled page or per host: host, k (blocked), n (labelled). Without outcomes the prior of all pages is 1/2 and nothing is blocked.
    """
    suffix, domain = registered(F.col("host"), suffixes)
    by_host = outcomes.groupBy("host").agg(F.sum("k").cast("double").alias("k"), F.sum("n").cast("double").alias("n")).filter("n > 0")
    by_host = written(by_host.select("host", domain.alias("domain"), suffix.alias("suffix"), "k", "n"), "host-outcomes")
    sums = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    by_domain = by_host.groupBy("domain", "suffix").agg(*sums)
    by_suffix = by_domain.groupBy("suffix").agg(*sums)
    k, n = by_suffix.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    m = (k + 0.5) / (n + 1)
    weights = [1.0, 1.0, 1.0]
    if n:
        everything = by_suffix.groupBy(F.lit(0).alias("all")).agg(*sums)
        weights = [_shrinkage(by_suffix.withColumn("all", F.lit(0)), everything, "all"), _shrinkage(by_domain, by_suffix, "suffix"), _shrinkage(by_host, by_domain.select("domain", "k", "n"), "domain")]
    rows = hosts.select("host", domain.alias("domain"), suffix.alias("suffix"))
    for name, level in (("suffix", by_suffix), ("domain", by_domain), ("host", by_host)):
        rows = rows.join(level.select(name, F.col("k").alias(f"k_{name}"), F.col("n").alias(f"n_{name}")), name, "left")

    def shrunk(name: str, weight: float, prior: Column) -> Column:
        return (F.coalesce(f"k_{name}", F.lit(0.0)) + weight * prior) / (F.coalesce(f"n_{name}", F.lit(0.0)) + weight)

    above = shrunk("domain", weights[1], shrunk("suffix", weights[0], F.lit(m)))
    mean, size = shrunk("host", weights[2], above), F.coalesce("n_host", F.lit(0.0)) + weights[2]
    rows = rows.select("host", mean.alias("reputation"), size.alias("_size"))
    bound = F.col("reputation") - z * F.sqrt(F.col("reputation") * (1 - F.col("reputation")) / (F.col("_size") + 1))
    return rows.select("host", "reputation", bound.alias("bound"), (bound > limit).alias("blocked"))


def judged_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], outcomes: DataFrame | None = None, *, url_col: str = "url", limit: float = 0.5, z: float = 1.645, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Every row of ``pages`` with host, path, rule (host and path of the rule that wins, or null), reputation (the host's) and verdict (allow or block).

    ``outcomes`` (host, k, n) are the labelled pages; None takes the pages that rules judge. Null URLs, and those without ``://``, have an empty host and path: rules
    cannot fit them, and their reputation is that of a host of its own. Rows that repeat are judged each; an empty table stays empty; without rules the prior decides.
    Columns of ``pages`` by the names that are added are replaced.
    """
    own = ["host", "path", "rule", "reputation", "verdict"]
    kept = [c for c in pages.columns if c.lower() not in own]
    salts = salts_for(pages.count(), least=16)
    rows = pages.select(F.struct(*kept).alias("_page"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.monotonically_increasing_id().alias("_row"))
    hosts = written(rows.select("host").distinct(), "hosts")
    first = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0)) if rules else None
    ruled = _meet(rows, fitting_rules(hosts, rules), salts).withColumn("_rule", first).drop("_rules") if rules else rows.withColumn("_rule", F.lit(None).cast("struct<at:string,path:string,verdict:string>"))
    ruled = written(ruled.select("_page", "host", "path", "_row", F.concat("_rule.at", "_rule.path").alias("rule"), F.col("_rule.verdict").alias("_verdict")), "ruled")
    if outcomes is None:
        outcomes = ruled.filter("_verdict IS NOT NULL").groupBy("host").agg(F.count_if(F.col("_verdict") == "block").alias("k"), F.count("*").alias("n"))
    known = reputations(outcomes, hosts, limit=limit, z=z, suffixes=suffixes)
    out = _meet(ruled, known, salts)
    return out.select("_page.*", "host", "path", "rule", "reputation", F.coalesce("_verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))
