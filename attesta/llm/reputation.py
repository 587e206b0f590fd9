"""URL filter: path rules first, then host reputation by hierarchical empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path); a rule fits its host and all subdomains.
Rule = tuple[str, str, str]
#: Suffixes of two labels (an excerpt; pass the list in use).
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "com.mx", "co.nz", "com.tr")
BLOCK_RATE = 0.3
Z = 1.645
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(
        F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))
    )


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null and where there is no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null and where there is no ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits as struct(rule, verdict), or null. Of equal length, the longer host, then block."""
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def suffix(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), two).otherwise(F.substring_index(host, ".", -1))


def domain(host: Column, two_label: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*two_label), F.substring_index(host, ".", -3)).otherwise(two)


def _concentration(children: DataFrame) -> float:
    """Weight of the prior, by the method of moments over children (n, bad, mean of the parent).

    With n outcomes around mean m, the squared distance of a child's rate has the mean
    m (1 - m) / n * (1 + (n - 1) / (weight + 1)). The prior weighs as much as 4 to 999 outcomes.
    """
    spread = F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("prior"), 2) / (F.col("prior") * (1 - F.col("prior")))
    row = children.filter("n > 0").agg(F.sum(spread), F.count(F.lit(1)), F.sum(F.col("n") - 1)).first()
    if not row[2]:
        return 10.0
    share = (row[0] - row[1]) / row[2]
    return 1 / min(max(share, 0.001), 0.2) - 1


def _posterior(children: DataFrame, weight: float) -> DataFrame:
    """Posterior `rate` and `weight`; what is not known of the parent's own mean (`known`) thins its prior out.

    The variances of a level and of the parent's mean add up, and the variance of a beta with weight w is
    m (1 - m) / (w + 1).
    """
    prior = 1 / (F.lit(1 / (weight + 1)) + 1 / (F.col("known") + 1)) - 1
    own = children.withColumn("_prior_weight", prior)
    rate = (F.col("_prior_weight") * F.col("prior") + F.col("bad")) / (F.col("_prior_weight") + F.col("n"))
    return own.withColumn("rate", rate).withColumn("weight", F.col("_prior_weight") + F.col("n")).drop("_prior_weight")


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound): posterior bad rate of every host and its lower bound.

    `pages` has (page_id, host), `outcomes` (page_id, bad 0 or 1); pages without an outcome count for
    nothing but give their host a row. Suffix, registered domain and host are beta-binomial levels: each
    takes the posterior mean of the level above as prior mean, with a weight fitted over all groups of
    its level. The bound is mean minus z standard deviations of the beta posterior. Null outcomes and
    page ids are left out; repeated outcomes of a page count as often as they occur.
    """
    known = outcomes.filter("page_id is not null and bad in (0, 1)")
    counted = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = counted.select("host", domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "bad")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    total = hosts.agg(*sums).first()
    everything = (total["n"] or 0) + 2
    overall = ((total["bad"] or 0) + 1) / everything
    up = [F.col("rate").alias("prior"), F.col("weight").alias("known")]
    suffixes = hosts.groupBy("suffix").agg(*sums).withColumns({"prior": F.lit(overall), "known": F.lit(float(everything))})
    suffixes = _posterior(suffixes, _concentration(suffixes)).select("suffix", *up)
    domains = hosts.groupBy("suffix", "domain").agg(*sums).join(suffixes, "suffix")
    domains = _posterior(domains, _concentration(domains)).select("domain", *up)
    own = hosts.join(domains, "domain")
    own = _posterior(own, _concentration(own))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return own.select("host", "n", "bad", "rate", F.greatest(F.lit(0.0), F.col("rate") - Z * deviation).alias("bound"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", block_rate: float = BLOCK_RATE
) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, bound) for every page.

    A fitting rule decides; else the page is blocked if its host's bad rate is above `block_rate` by
    its posterior bound. Hosts are counted before the join, so a host of any size is one row there.
    Null and malformed urls have empty host and path and share the empty host's reputation.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    known = reputations(rows.select("page_id", "host"), outcomes)
    matched = rows.withColumn("found", rule(F.col("host"), F.col("path"), rules)).join(known, "host")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("bound") > block_rate, "block").otherwise("allow"))
    return matched.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "rate", "bound")
