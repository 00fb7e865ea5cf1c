"""URL filters: explicit rules first, else an empirical-Bayes reputation of the host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: (verdict, host and path) as the contract of the query has them.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


@dataclass(frozen=True)
class Reputation:
    """``z`` standard deviations below the posterior mean bad rate must still exceed ``max_bad``; ``least`` and ``most`` bound a prior's weight."""

    z: float = 1.645
    max_bad: float = 0.3
    least: float = 2.0
    most: float = 200.0


def host_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(after) + 4)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.length(F.substring_index(url, "://", 1)) + 4)
    return F.when(url.contains("://"), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls.  The list is code, a few hundred entries at most."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rule_path)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    return F.substring_index(F.regexp_replace(host, r":[0-9]*$", ""), ".", -1)


def domain_of(host: Column) -> Column:
    return F.substring_index(F.regexp_replace(host, r":[0-9]*$", ""), ".", -2)


def _sums(children: DataFrame, *by: str) -> DataFrame:
    """Outcomes of each parent and what its children's spread needs, as whole numbers so that no order of adding matters."""
    bad, n = F.col("bad"), F.col("n")
    return children.groupBy(*by).agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("k"),
        F.sum(F.when(n > 0, F.floor(bad * bad * 1000000 / n)).otherwise(0)).cast("long").alias("spread"),
    )


def prior_weight(parents: DataFrame, p: Reputation) -> float:
    """The weight of the beta priors that children get from their parents, by the method of moments over all parents.

    The spread of the children's rates beyond what sampling alone gives is the variance of the prior; with no such
    spread the weight is the largest allowed.
    """
    bad, n = F.col("bad"), F.col("n")
    r = parents.filter("n > 0").agg(
        F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.sum(F.col("k") - 1).alias("free"),
        F.sum(F.col("spread") - F.floor(bad * bad * 1000000 / n)).cast("long").alias("spread"),
        F.sum(n * 1000000 - F.floor(F.col("nn") * 1000000 / n)).cast("long").alias("size"),
    ).first()
    if not r["n"] or not r["size"]:
        return p.most
    rate = r["bad"] / r["n"]
    extra = (r["spread"] / 1e6 - r["free"] * rate * (1 - rate)) / (r["size"] / 1e6)
    return min(p.most, max(p.least, rate * (1 - rate) / extra - 1)) if extra > 0 else p.most


def host_reputation(outcomes: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """``outcomes``: host, bad (0/1, null: not labelled).  One row per host: ``bad``, ``n``, ``mean``, ``bound``.

    A suffix is shrunk towards the rate of all pages, a registered domain (the last two labels) towards its suffix, a
    host towards its domain, each by as much as the spread at that level warrants.  ``bound`` is the posterior mean bad
    rate less ``z`` posterior standard deviations.  Rows are summed per host first, so a host with a third of all pages
    is one row a task.
    """
    hosts = cut_lineage(
        outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("bad"), F.count("bad").alias("n"))
        .withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    )
    domains = cut_lineage(_sums(hosts, "suffix", "domain"))
    suffixes = _sums(domains.select("suffix", "bad", "n"), "suffix")
    root = _sums(suffixes.select("bad", "n"))
    w_suffix, w_domain, w_host = prior_weight(root, p), prior_weight(suffixes, p), prior_weight(domains, p)
    total = root.first()
    everyone = ((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2)
    m_suffix = suffixes.select("suffix", ((F.col("bad") + w_suffix * everyone) / (F.col("n") + w_suffix)).alias("m_suffix"))
    m_domain = domains.join(m_suffix, "suffix").select("domain", ((F.col("bad") + w_domain * F.col("m_suffix")) / (F.col("n") + w_domain)).alias("m_domain"))
    a = w_host * F.col("m_domain") + F.col("bad")
    size = F.col("n") + F.lit(w_host)
    mean = a / size
    return hosts.join(m_domain, "domain").select("host", "bad", "n", mean.alias("mean"), (mean - p.z * F.sqrt(mean * (1.0 - mean) / (size + 1.0))).alias("bound"))


def judge_urls(pages: DataFrame, labels: DataFrame, p: Reputation = Reputation(), rules=RULES) -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``labels`` (doc_id, quality, toxic) labels the page of the same number; an outcome is bad when quality is 0 or toxic
    is 1, a page with several labels is bad if one is, and a label without values counts as none.  A fitting rule
    decides; else a host whose posterior bound on its bad rate exceeds ``max_bad`` is blocked.  A page without host
    (null url, no ``://``, or an empty one) fits no rule and is allowed.
    """
    bad = F.greatest(F.when(F.col("quality") == 0, 1).when(F.col("quality").isNotNull(), 0), F.when(F.col("toxic") == 1, 1).when(F.col("toxic").isNotNull(), 0))
    labelled = labels.groupBy(F.col("doc_id").alias("__page")).agg(F.max(bad).alias("bad"))
    url = F.coalesce(F.col("url"), F.lit(""))
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    outcomes = parsed.join(labelled, F.col("page_id") == F.col("__page"), "left").select("host", "bad")
    doubtful = host_reputation(outcomes, p).filter((F.col("bound") > p.max_bad) & (F.col("host") != "")).select("host", F.lit(True).alias("__bad"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    by_rule = parsed.withColumns({"rule": rule, "__verdict": verdict})
    fallback = F.when(F.col("__bad"), "block").otherwise("allow")
    return by_rule.join(doubtful, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("__verdict", fallback).alias("verdict"))
