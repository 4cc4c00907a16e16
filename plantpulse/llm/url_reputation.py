"""Empirical-Bayes reputation of hosts, and rules that override it.

Labelled page outcomes (bad or not) are shrunk level by level: a suffix towards the rate of all
pages, a registered domain towards its suffix, a host towards its registered domain. Each level is a beta
prior whose mean is the parent's posterior mean and whose strength is estimated from how much
children of that level differ (method of moments for the beta-binomial).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plantpulse.llm.staging import staged

# --- Fixed values: rules as (action, host, path), and suffixes of two labels. ---
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "co.nz", "com.br", "co.in")
# --- End of fixed values. ---


@dataclass(frozen=True)
class Policy:
    """``z``: standard deviations between posterior mean and bound. ``limit``: a host is blocked
    if the lower bound of its rate of bad pages exceeds it. ``weakest``/``strongest``: limits of the
    share of variance that lies between children of a level."""

    z: float = 1.645
    limit: float = 0.5
    weakest: float = 0.0001
    strongest: float = 0.99


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case;
    empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), *_LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty as the host is."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def matching_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(text, action) of the longest rule that fits host and path; null if none does."""
    longest_first = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None)
    for action, rule_host, rule_path in reversed(longest_first):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.struct(F.lit(rule_host + rule_path).alias("text"), F.lit(action).alias("action"))
        found = F.when(fits, rule).otherwise(found)
    return found


def _strength(children: DataFrame, parent_rate: Column, policy: Policy) -> DataFrame:
    """One row: pseudo-observations of the prior of a level, from (bad, n) per child."""
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - parent_rate, F.lit(2.0))
    moments = children.where((F.col("n") > 0) & (parent_rate > 0) & (parent_rate < 1)).agg(
        F.sum(F.round(spread / (parent_rate * (1 - parent_rate)), 6).cast("decimal(30,6)")).cast("double").alias("s"),
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
    )
    rho = F.when(F.col("n") > F.col("k"), (F.col("s") - F.col("k")) / (F.col("n") - F.col("k"))).otherwise(0.0)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(policy.weakest)), F.lit(policy.strongest))
    return moments.select(F.round(1 / rho - 1, 6).alias("strength"))


def reputations(outcomes: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Reputation of every host of ``outcomes`` (host, bad; bad is null for an unlabelled page).

    Columns: host, n, bad, rate (posterior mean) and bound (posterior mean minus ``z`` standard
    deviations), rounded to nine places. Pages are summed per host before anything is shuffled;
    later levels work on one row per host. A host without labels takes its domain's prior; without any label
    at all the rate is 1/2. Each level is staged (one row per host, suffix or domain): the plan of the next starts there,
    so plans do not nest.
    """
    hosts = outcomes.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad")
    ).withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    hosts = staged(hosts, "url-hosts")
    total = hosts.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.5)))
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = level.withColumn("parent_rate", total.scalar())
    level = staged(_shrunk(level, policy).select("suffix", F.col("rate").alias("parent_rate")), "url-suffixes")
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    level = _shrunk(domains.join(level, "suffix"), policy).select("domain", F.col("rate").alias("parent_rate"))
    level = staged(level, "url-domains")
    final = _shrunk(hosts.join(level, "domain"), policy)
    a, b = F.col("rate") * F.col("weight"), (1 - F.col("rate")) * F.col("weight")
    deviation = F.sqrt(a * b / (F.pow(F.col("weight"), F.lit(2.0)) * (F.col("weight") + 1)))
    return final.select(
        "host", "n", "bad", "rate", F.round(F.col("rate") - policy.z * deviation, 9).alias("bound")
    )


def _shrunk(children: DataFrame, policy: Policy) -> DataFrame:
    """Adds rate and weight (pseudo-observations) of the posterior to children with parent_rate."""
    children = children.withColumn("strength", _strength(children, F.col("parent_rate"), policy).scalar())
    weight = F.col("n") + F.col("strength")
    rate = F.round((F.col("bad") + F.col("strength") * F.col("parent_rate")) / weight, 9)
    return children.withColumns({"rate": rate, "weight": weight})


def judge(pages: DataFrame, outcomes: DataFrame, policy: Policy = Policy(), rules=RULES) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url); ``outcomes`` has (page_id, bad).

    Columns: page_id, host, path, rule, verdict (allow or block), bad_rate, bad_bound, n_labels.
    A rule decides if one fits, else the bound. Null or malformed url: host and path empty, judged
    as the empty host. Null bad, or a page without a row in ``outcomes``: unlabelled. Several outcomes of
    a page count once, as bad if any is. Repeated page rows each get a row and each count. Null page_id:
    judged, never labelled. Empty ``pages``: no rows. Other columns are ignored.
    """
    hosts = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    per_page = outcomes.groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    known = reputations(hosts.select("page_id", "host").join(per_page, "page_id", "left"), policy)
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("bound") > policy.limit, "block").otherwise("allow")
    return hosts.join(known, "host").withColumn("found", rule).select(
        "page_id",
        "host",
        "path",
        F.col("found.text").alias("rule"),
        F.coalesce(F.col("found.action"), by_method).alias("verdict"),
        F.col("rate").alias("bad_rate"),
        F.col("bound").alias("bad_bound"),
        F.col("n").alias("n_labels"),
    )
