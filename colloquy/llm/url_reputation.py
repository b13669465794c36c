"""URL filters: explicit rules first, then an empirical-Bayes reputation of hosts, in DataFrame functions alone.

A labelled page is one with an outcome (bad or not). Outcomes are counted per host, rolled up to registered domains and
public suffixes, and shrunk downwards through beta-binomial priors: a suffix towards the whole, a domain towards its
suffix, a host towards its domain. How much a prior weighs is estimated for each level from how far the children of a
parent differ. A host is blocked if the lower bound of its posterior rate of bad pages lies above the rate of the whole
corpus: it is then worse than usual beyond reasonable doubt. A host without labels has its domain's reputation, a domain
without labels its suffix's. Where outcomes have nothing to do with hosts, priors weigh as much as all labels and nothing
is blocked.

User names and ports do not count for the reputation. An IP address is its own domain. A registered domain has one label
more than its public suffix, which has two labels where a generic second label stands under a country.

Nulls: a null url, or one without ``://``, has an empty host and path (all of them are one host); an unlabelled page
counts for no outcome; without any label the rate is one half and nothing is blocked. Repeated rows count each time. Of
rules of equal length the one with the longer host wins. An empty table gives no rows. Columns not named here are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stage

# Fixed values: (verdict, host, path) of the explicit rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Public suffixes of two labels: a generic label under a country's.
TWO_LABEL_SUFFIX = r"(^|\.)(ac|co|com|edu|go|gob|gov|ltd|me|mil|ne|net|nom|or|org|plc|sch)\.[a-z]{2}$"
#: Normal quantile of the posterior's lower bound.
Z = 1.645

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null. The list is a short configuration."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def site_of(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def registered(site: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a site; an IP address is a domain of its own under the suffix ``ip``."""
    labels = F.split(site, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), F.lit(n)), ".")
    two, ip = site.rlike(TWO_LABEL_SUFFIX), site.rlike(r"^([0-9]{1,3}(\.[0-9]{1,3}){3}|\[.*\])$")
    return F.when(ip, site).when(two, last(3)).otherwise(last(2)), F.when(ip, "ip").when(two, last(2)).otherwise(last(1))


def _shrunk(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """``children`` (n, k) with the posterior (alpha, beta) and its mean ``rate``, given the parents' rates.

    The prior of a child is its parent's rate with a weight in pages, one weight for the whole level, by the method of
    moments: within a parent of rate p with t pages, S = sum n (k/n - p)^2 is expected to be
    (children - 1) p (1 - p) + between (t - sum n^2 / t). Summed over the parents that gives the variance ``between``
    children; the weight is p (1 - p) / between - 1. Where children do not differ more than chance has it, the prior is
    worth all labelled pages of the level; it is never worth less than one page.
    """
    part = children.where("n > 0").groupBy(parent).agg((F.count(F.lit(1)) - 1).alias("free"), F.sum("n").alias("t"), F.sum("k").alias("kk"), F.sum(F.col("n") * F.col("n")).alias("t2"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("s"))
    part = part.select("free", "t", "t2", (F.col("kk") / F.col("t")).alias("p"), (F.col("s") - F.col("kk") * F.col("kk") / F.col("t")).alias("s"))
    noise = F.col("p") * (1 - F.col("p"))
    level = part.agg(F.sum("t").alias("t"), (F.sum(F.col("t") * noise) / F.sum("t")).alias("spread"), F.try_divide(F.sum("s") - F.sum(F.col("free") * noise), F.nullif(F.sum(F.col("t") - F.col("t2") / F.col("t")), F.lit(0.0))).alias("between"))
    weight = F.when(F.col("between") > 0, F.greatest(F.lit(1.0), F.least(F.col("t").cast("double"), F.try_divide("spread", "between") - 1))).otherwise(F.col("t").cast("double"))
    level = level.select(F.coalesce(weight, F.lit(1.0)).alias("weight"))
    x = children.join(parents.select(F.col(parent).alias("__q"), F.col("rate").alias("mu")), F.col(parent) == F.col("__q")).drop("__q").crossJoin(F.broadcast(level))  # one row
    x = x.withColumn("alpha", F.col("weight") * F.col("mu") + F.col("k")).withColumn("beta", F.col("weight") * (1 - F.col("mu")) + F.col("n") - F.col("k"))
    return x.withColumn("rate", F.col("alpha") / (F.col("weight") + F.col("n"))).drop("mu", "weight")


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, bad?) rows, bad null where unlabelled -> per site: site, n, k, rate, bound (the posterior's lower bound) and
    usual_rate (that of the whole)."""
    sites = outcomes.groupBy(site_of(F.col("host")).alias("site")).agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    domain, suffix = registered(F.col("site"))
    sites = stage(sites.select("site", domain.alias("domain"), suffix.alias("suffix"), F.lit("").alias("all"), "n", "k"), "sites")
    roll = lambda df, *keys: df.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    domains = roll(sites, "domain", "suffix", "all")
    suffixes = roll(domains, "suffix", "all")
    whole = stage(roll(suffixes, "all").withColumn("rate", (F.col("k") + 1) / (F.col("n") + 2)), "whole")
    suffixes = stage(_shrunk(suffixes, whole, "all"), "suffixes")
    domains = stage(_shrunk(domains, suffixes, "suffix"), "domains")
    sites = _shrunk(sites, domains, "domain").crossJoin(F.broadcast(whole.select(F.col("rate").alias("usual_rate"))))  # one row
    a, b = F.col("alpha"), F.col("beta")
    bound = F.col("rate") - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return sites.select("site", "n", "k", "rate", bound.alias("bound"), "usual_rate")


def judged_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, block_rate, block_bound, usual_rate.

    ``outcomes`` has labelled pages as (page_id, bad); a page with several labels is bad if one of them says so.
    """
    host, path = url_parts(F.col("url").cast("string"))
    x = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    x = x.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    labelled = outcomes.where("bad is not null").groupBy(F.col("page_id").alias("__i")).agg(F.max("bad").alias("bad"))
    seen = x.select("page_id", "host").join(labelled, F.col("page_id") == F.col("__i"), "left").select("host", "bad")
    known = stage(reputation(seen), "reputation").select(F.col("site").alias("__s"), F.col("rate").alias("block_rate"), F.col("bound").alias("block_bound"), "usual_rate")
    verdict = F.coalesce("ruled", F.when(F.col("block_bound") > F.col("usual_rate"), "block").otherwise("allow"))
    figures = [F.round(c, 9).alias(c) for c in ("block_rate", "block_bound", "usual_rate")]
    return x.join(known, site_of(F.col("host")) == F.col("__s"), "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), *figures)
