"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted per host.  Beta-binomial
priors shrink a suffix towards all pages, a registered domain towards its
suffix and a host towards its domain; the strength of each prior is estimated
from how much the children of that level differ.  A host is blocked whose
posterior bad rate is above the overall rate (times LIFT) with the wanted
certainty.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handprint.llm.common import narrowed, pinned

#: Fixed values: (verdict, rule); a rule is host, then path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"),
         ("allow", "org/fr/"))
#: Labels under a two-letter country code that belong to the public suffix.
SECOND = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if its bad rate is above LIFT times the overall rate, by LIKELY
#: standard deviations (0.253: with 60 % certainty).
LIFT = 1.0
LIKELY = 0.253
#: Standard deviations of a bound with 95 % certainty.
CERTAIN = 1.645
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """Last label; the last two where the last but one belongs to the suffix."""
    two = rf"(?:^|\.)((?:{'|'.join(SECOND)})\.[a-z]{{2}})$"
    long = F.regexp_extract(host, two, 1)
    return F.when(long != "", long).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """Suffix and the label before it; the host itself if there is none."""
    head = F.expr("left(host, greatest(length(host) - length(suffix) - 1, 0))")
    label = F.regexp_extract(head, r"([^.]*)$", 1)
    return F.when(label == "", host).otherwise(F.concat(label, F.lit("."), F.col("suffix")))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does.

    A rule fits its host and its subdomains where the path starts with the
    rule's path.
    """
    fitting = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        at, tail = rule.partition("/")[0], rule[rule.index("/"):]
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(tail))
        fitting.append(F.when(fits, F.struct(F.lit(rule).alias("rule"),
                                             F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fitting)


def strength(children: DataFrame) -> float:
    """Prior strength (in pages) of a level from its children's n and bad.

    The analysis-of-variance estimate of the beta-binomial correlation rho;
    the strength is 1 / rho - 1, within bounds.  One row reaches the driver.
    """
    n, bad = F.col("n").cast("double"), F.col("bad").cast("double")
    row = children.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("bad"),
        F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("bb")).first()
    if not row["k"] or row["k"] < 2 or row["n"] <= row["k"]:
        return STRONGEST
    k, total, rate = row["k"], row["n"], row["bad"] / row["n"]
    between = (row["bb"] - total * rate * rate) / (k - 1)
    within = (row["bad"] - row["bb"]) / (total - k)
    size = (total - row["nn"] / total) / (k - 1)
    spread = between + (size - 1) * within
    rho = (between - within) / spread if spread > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / rho - 1)) if rho > 0 else STRONGEST


def reputations(outcomes: DataFrame, certain: float = CERTAIN) -> DataFrame:
    """(host, n, bad, domain, suffix, rate, bound, overall) for every host of ``outcomes``.

    ``outcomes``: host, bad (boolean, null: page without label).  ``rate`` is the
    posterior mean of the bad rate, ``bound`` its lower bound (``certain``
    standard deviations below), ``overall`` the bad rate of all labelled pages.  Hosts without
    labelled pages get what their domain says.  Without any label all rates
    are 0 and nothing is blocked.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"),
        F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad"))
    hosts = hosts.withColumn("suffix", suffix_of(F.col("host")))
    hosts = pinned(hosts.withColumn("domain", domain_of(F.col("host"))), "hosts")
    totals = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = pinned(hosts.groupBy("domain", "suffix").agg(*totals), "domains")
    suffixes = pinned(domains.groupBy("suffix").agg(*totals), "suffixes")
    every = suffixes.agg(*totals).first()
    overall = every["bad"] / every["n"] if every["n"] else 0.0
    by_suffix, by_domain, by_host = strength(suffixes), strength(domains), strength(hosts)

    def shrunk(weight: float, prior: Column) -> Column:
        return (F.col("bad") + F.lit(weight) * prior) / (F.col("n") + F.lit(weight))
    suffixes = suffixes.select("suffix", shrunk(by_suffix, F.lit(overall)).alias("of_suffix"))
    domains = domains.join(suffixes, "suffix").select(
        "domain", "suffix", shrunk(by_domain, F.col("of_suffix")).alias("of_domain"))
    met = hosts.join(domains, ["domain", "suffix"])
    rate = shrunk(by_host, F.col("of_domain"))
    sd = F.sqrt(rate * (1 - rate) / (F.col("n") + F.lit(by_host) + 1))
    return met.select("host", "n", "bad", "domain", "suffix", rate.alias("rate"),
                      F.greatest(F.lit(0.0), rate - F.lit(certain) * sd).alias("bound"),
                      F.lit(overall).alias("overall"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id",
               url_col: str = "url", rules: Sequence[tuple[str, str]] = RULES,
               lift: float = LIFT, certain: float = LIKELY) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, rate, bound.

    ``outcomes``: id, bad (boolean): labelled pages; a page is bad if any of
    its labels says so, null labels say nothing.  A url without ``://``, or
    null, has empty host and path; such pages are one host.  The longest rule
    that fits decides (rule and verdict); otherwise rule is null and the
    host's reputation decides: block where ``bound`` is above ``lift`` times the
    overall rate.  Repeated rows count as pages of their own and get the same
    verdict; pages with a null id have no label; an empty table gives an
    empty result.

    Pages are counted per host before the shuffle, and meet their host's
    reputation in a join that Spark broadcasts if the hosts are few by their
    written size, and else shuffles, splitting hosts of many pages.
    """
    base = narrowed(pages, id=id_col, url=url_col).select(
        "id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    label = (narrowed(outcomes, of=outcomes.columns[0], bad=outcomes.columns[1])
             .groupBy("of").agg(F.max("bad").alias("bad")))
    labelled = base.join(label, base["id"] == label["of"], "left").select("host", "bad")
    known = pinned(reputations(labelled, certain).select("host", "rate", "bound", "overall"),
                   "reputations")
    rule = rule_for(F.col("host"), F.col("path"), rules)
    met = base.join(known, "host", "left").withColumn("by", rule)
    verdict = F.coalesce(F.col("by.verdict"),
                         F.when(F.col("bound") > lift * F.col("overall"), "block")
                         .otherwise("allow"))
    return met.select(F.col("id").alias(id_col), "host", "path", F.col("by.rule").alias("rule"),
                      verdict.alias("verdict"), "rate", "bound")
