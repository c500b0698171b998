"""URL filters: rules by host and path, and empirical-Bayes host reputation for the rest.

Labelled page outcomes are counted per host, registered domain and suffix. On
each level the rate of bad pages is shrunk towards the level above through a
beta-binomial prior: the suffixes towards the overall rate, the domains towards
their suffix, the hosts towards their domain. How strongly is estimated from
the counts themselves (moment estimator of the intra-class correlation on each
level). A host is blocked where the lower posterior bound of its rate exceeds
the limit; few or no labels leave it with its domain's or suffix's reputation.

Counts are aggregated before they are shuffled and joins with a popular host
are salted; only three numbers per level reach the driver.

Defined cases: a null url, or one without ``://``, has an empty host and path
and belongs to one host of that name; a page without label adds nothing;
repeated rows count as often as they occur; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perkflow.llm.common import private_name

# Public suffixes of two labels that hosts are commonly registered under.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
                      "com.cn", "com.mx", "com.tr", "gov.uk", "net.au", "org.au", "org.uk")

SALTS = 16


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """``limit``: rate of bad pages that the lower bound must exceed; ``z``: width of the bound in deviations."""
    limit: float = 0.5
    z: float = 1.645
    least_correlation: float = 0.001
    most_correlation: float = 0.5


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_and_domain(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain; a numeric address is its own domain under the suffix ``ip``."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)))
    two = last_two.isin(*TWO_LABEL_SUFFIXES)
    numeric = name.rlike(r"^[0-9.]+$|^\[")
    suffix = F.when(numeric, F.lit("ip")).when(two, last_two).otherwise(F.element_at(labels, -1))
    taken = F.when(two, F.lit(3)).otherwise(F.lit(2))
    domain = F.when(numeric, name).otherwise(
        F.concat_ws(".", F.slice(labels, F.greatest(n - taken + 1, F.lit(1)), taken)))
    return suffix, domain


def _level(children: DataFrame, by: str) -> DataFrame:
    return children.groupBy(by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(groups: DataFrame, rep: Reputation) -> tuple[float, float]:
    """Overall (smoothed) rate and prior strength, from one row of sums over the groups with labels."""
    some = groups.where("n > 0")
    s = some.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                 F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"),
                 F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("pb")).first()
    if not s["n"]:
        return 0.5, 1 / rep.most_correlation - 1
    n, mean = s["n"], (s["bad"] + 0.5) / (s["n"] + 1)
    k, within = s["k"] - 1, mean * (1 - mean)
    # sum of n (p - mean)^2, from sums
    spread = s["pb"] - 2 * mean * s["bad"] + n * mean * mean
    room = within * (n - s["nn"] / n - k)
    rho = (spread - within * k) / room if room > 0 else rep.most_correlation
    rho = min(max(rho, rep.least_correlation), rep.most_correlation)
    return mean, 1 / rho - 1


def host_reputation(pages: DataFrame, host: str, bad: str, rep: Reputation = Reputation()) -> DataFrame:
    """(host, bound, blocked) for every host; ``bad``: 1, 0, or null without a label."""
    hosts = pages.groupBy(F.col(host).alias("host")).agg(
        F.count(bad).alias("n"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0)).alias("bad"))
    suffix, domain = suffix_and_domain(F.col("host"))
    hosts = hosts.withColumns({"suffix": suffix, "domain": domain})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = _level(domains, "suffix")
    mean, by_suffix = _strength(suffixes, rep)
    _, by_domain = _strength(domains, rep)
    _, by_host = _strength(hosts, rep)

    suffixes = suffixes.select("suffix", ((F.col("bad") + F.lit(by_suffix * mean)) / (F.col("n") + F.lit(by_suffix)))
                               .alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").select(
        "suffix", "domain",
        ((F.col("bad") + F.lit(by_domain) * F.col("suffix_rate")) / (F.col("n") + F.lit(by_domain))).alias("rate"))
    a = F.col("bad") + F.lit(by_host) * F.col("rate")
    total = F.col("n") + F.lit(by_host)
    p = a / total
    bound = p - F.lit(rep.z) * F.sqrt(p * (1 - p) / (total + 1))
    return hosts.join(domains, ["suffix", "domain"]).select(
        "host", bound.alias("bound"), (bound > rep.limit).alias("blocked"))


def judged(pages: DataFrame, key: str, url: str, bad: str, rules: list[Rule],
           rep: Reputation = Reputation()) -> DataFrame:
    """``pages`` plus one struct column ``judged``: host, path, rule, verdict. ``key`` spreads a host's pages."""
    h, tmp, b, s = (private_name(pages, n) for n in ("_host", "_rule", "_blocked", "_salt"))
    parsed = pages.withColumn(h, host_of(F.col(url)))
    blocked = host_reputation(parsed, h, bad, rep).select(
        F.col("host").alias(h), F.col("blocked").alias(b),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(s))
    path = path_of(F.col(url))
    out = parsed.withColumn(s, F.pmod(F.hash(key, url), F.lit(SALTS))) \
        .join(blocked, [h, s], "left") \
        .withColumn(tmp, rule_for(F.col(h), path, rules))
    by_host = F.when(F.col(b), F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("judged", F.struct(
        F.col(h).alias("host"), path.alias("path"), F.col(tmp)["rule"].alias("rule"),
        F.coalesce(F.col(tmp)["verdict"], by_host).alias("verdict"))).drop(h, tmp, b, s)
