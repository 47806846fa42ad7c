"""URL filters by empirical-Bayes host reputation, in DataFrame operations only.

Labelled page outcomes (bad or not) are counted per host, registered domain and
suffix. At each level a beta-binomial prior is fitted by moments: its mean is
the level's own rate shrunk towards the parent level, its strength follows from
the spread of the children's rates. The chain of priors runs from all pages to
the suffix, from the suffix to the registered domain, and from there to the
host. A page is blocked where the lower bound of its host's posterior bad rate
exceeds a limit.

Explicit rules (host, path) come before the reputation: the longest that fits wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host (with all its subdomains) and the start of a path, and what becomes of the pages it fits."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


#: Common public suffixes of two labels. Any other suffix is one label.
LONG_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "me.uk", "net.uk", "org.uk", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "org.nz",
    "com.br", "gov.br", "net.br", "org.br", "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.kr", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.tw", "org.tw", "com.hk", "org.hk",
    "com.mx", "org.mx", "com.ar", "com.co", "com.pe", "com.tr", "org.tr", "co.za", "org.za", "co.il", "org.il", "com.sg", "com.my", "co.th", "co.id", "com.ph", "com.vn", "com.ua", "com.pl", "com.es", "com.pt", "com.gr",
)


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def _is_address(bare: Column) -> Column:
    return bare.rlike(r"^([0-9]+(\.[0-9]+){3}|\[.*)$")


def registered_domain(host: Column) -> Column:
    """The label before the public suffix with it, of a host without user and port (the whole of it if it has fewer labels, or is an address)."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(bare), bare).when(two.isin(*LONG_SUFFIXES), F.substring_index(bare, ".", -3)).otherwise(two)


def suffix(host: Column) -> Column:
    """The public suffix of a host: the last label, or the last two where they are in LONG_SUFFIXES; ``ip`` for addresses."""
    bare = _bare(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_is_address(bare), "ip").when(two.isin(*LONG_SUFFIXES), two).otherwise(F.substring_index(bare, ".", -1))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null if none does); of equally long ones, the first in the list."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def _summed(children: DataFrame, parent: str, *firsts: str) -> DataFrame:
    """Of each ``parent``: n and k of its children, their number, and q (the sum of k * k / n), which is all that the spread of their rates needs."""
    return children.groupBy(parent).agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("c"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"), *[F.first(c).alias(c) for c in firsts])


def _strength(r: Column, n: Column, k: Column, c: Column, q: Column) -> Column:
    """Strength m of the beta prior of a parent's children around its rate r.

    From the moments of the children's rates p with sizes n: the variance that
    binomial noise doesn't explain, v = mean of (p - r)^2 - r (1 - r) / n
    weighted by n, gives m = r (1 - r) / v - 1, held between 1 and 1000.
    """
    v = F.try_divide(q - 2 * r * k + r * r * n - c * r * (1 - r), n)
    return F.when(v > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), F.try_divide(r * (1 - r), v) - 1))).otherwise(1000.0)


def _posterior(table: DataFrame, r: Column, m: Column) -> DataFrame:
    """``table`` with a, b and rate of its rows' posteriors under beta priors of rate r and strength m."""
    a, b = m * r + F.col("k"), m * (1 - r) + F.col("n") - F.col("k")
    return table.withColumns({"a": a, "b": b, "rate": a / (a + b)})


def _below(table: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    prior = parents.select(F.col(parent), F.col("rate").alias("__r"), _strength(F.col("rate"), F.col("n"), F.col("k"), F.col("c"), F.col("q")).alias("__m"))
    return _posterior(table.join(prior, parent), F.col("__r"), F.col("__m")).drop("__r", "__m")


def reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior of each host's bad rate: host, domain, suffix, n, k, a, b, rate and lower (rate less 1.6449 posterior deviations).

    ``outcomes``: host and bad (0/1; null outcomes and empty hosts are left out).
    """
    seen = outcomes.where("bad is not null and host <> ''")
    hosts = tx.stored(seen.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("k")).withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))))
    domains = tx.stored(_summed(hosts, "domain", "suffix"))
    suffixes = tx.stored(_summed(domains, "suffix"))
    n, k, c, q = suffixes.agg(F.sum("n"), F.sum("k"), F.count("*"), F.sum(F.col("k") * F.col("k") / F.col("n"))).first()
    # one success and one failure beforehand keep the root's rate off 0 and 1
    rate = F.lit(((k or 0) + 1) / ((n or 0) + 2))
    by_suffix = _posterior(suffixes, rate, _strength(rate, *(F.lit(float(x or 0)) for x in (n, k, c, q))))
    by_domain = _below(domains, by_suffix, "suffix")
    by_host = _below(hosts, by_domain.drop("suffix"), "domain")
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return by_host.withColumn("lower", F.greatest(F.lit(0.0), F.col("rate") - 1.6449 * deviation)).select("host", "domain", "suffix", "n", "k", "a", "b", "rate", "lower")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], url: str = "url", limit: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, rate, lower and verdict (allow or block).

    A rule that fits decides; else a host is blocked whose posterior bad rate
    exceeds ``limit`` at its lower bound; hosts without outcomes (and urls
    without a host) are allowed, with null rate and lower. Null urls, and urls without ``://``, have an
    empty host and path; urls of any length are read whole. Repeated pages are judged alike, and an
    empty table gives an empty one. Columns of ``pages``
    named like a result column are replaced.
    """
    made = ["host", "path", "rule", "rate", "lower", "verdict"]
    kept = tx.others(pages, made)
    split = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    name, ruled = rule_for(F.col("host"), F.col("path"), rules)
    known = reputation(outcomes).select(F.col("host").alias("__host"), "rate", "lower")
    judged = split.join(known, F.col("host") == F.col("__host"), "left").drop("__host")
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return judged.withColumn("rule", name).withColumn("verdict", F.coalesce(ruled, own)).select(*kept, *made)
