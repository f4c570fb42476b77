"""URL filtering: rules first, then empirical-Bayes host reputation.

Labelled page outcomes are counted by host, registered domain and suffix. Counts of
each level are shrunk towards the level above by a beta-binomial prior, whose
strength is estimated by moments from how much the level's rates differ; a host is
blocked when even the lower posterior bound of its bad rate is high. Only
DataFrame operations; what is broadcast is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: The query's rules: verdict by (host, path).
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: A host is blocked if its bad rate is above LIMIT with all but BOUND standard deviations of doubt.
LIMIT, BOUND = 0.5, 1.64
#: Least and greatest weight of the level above, in pages.
STRENGTH = (2.0, 1000.0)
#: Public suffixes of more than one name; of any other host the last name is the suffix.
SUFFIXES = """
    ac.jp ac.uk co.il co.in co.jp co.kr co.nz co.uk co.za com.ar com.au com.br com.cn com.hk com.mx com.sg com.tr
    com.tw edu.au gov.au gov.uk ne.jp net.au net.br net.cn or.jp org.au org.br org.cn org.nz org.uk
""".split()


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; null if none does."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _names(host: Column, suffixes: list[str]) -> Column:
    """How many names the host's longest suffix has: 1 if none of ``suffixes`` fits."""
    by = {n: [s for s in suffixes if s.count(".") + 1 == n] for n in sorted({s.count(".") + 1 for s in suffixes})}
    out = F.lit(1)
    for n, own in by.items():
        out = F.when(F.substring_index(host, ".", -n).isin(own), n).otherwise(out)
    return out


def suffix_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The longest of ``suffixes`` that the host ends with, else its last name."""
    names = F.split(host, r"\.")
    return F.array_join(F.slice(names, -F.least(_names(host, suffixes), F.size(names)), F.size(names)), ".")


def domain_of(host: Column, suffixes: list[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and one name before it."""
    names = F.split(host, r"\.")
    return F.array_join(F.slice(names, -F.least(_names(host, suffixes) + 1, F.size(names)), F.size(names)), ".")


def _strength(rates: DataFrame, mean: str) -> float:
    """Beta-binomial prior weight by moments, from rows (n, bad, mean): n (m (1 - m) - s) / (s - binomial part)."""
    m = F.col(mean)
    got = rates.where("n > 0").select(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - m) ** 2).alias("s"), F.sum(F.col("n") * m * (1 - m)).alias("v")).first()
    low, high = STRENGTH
    if not got["n"] or got["k"] < 2 or not got["v"]:
        return high
    between, inside, each = got["s"] / got["n"], got["v"] / got["n"], got["n"] / got["k"]
    # E[s] = v (1 + (n - 1) rho) / n with rho = 1 / (strength + 1)
    rho = (between / inside * each - 1) / max(each - 1, 1e-9)
    return min(high, max(low, 1 / rho - 1)) if rho > 0 else high


def reputation(outcomes: DataFrame, hosts: DataFrame | None = None, suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Posterior of each host that ``outcomes`` (host, bad 0/1) or ``hosts`` (host) knows: host, n, bad, rate, lower, upper.

    ``bad`` null is left out. A host without labels has n = 0 and the rate of its domain,
    else of its suffix, else of all. Its bounds come from the least strength of the levels
    from there down to it, for it may differ from that rate as much as they differ.
    Pages are counted by host once; all levels are sums of these counts.
    """
    known = outcomes.where(F.col("bad").isNotNull() & F.col("host").isNotNull()).select("host", F.col("bad").cast("long").alias("bad"))
    labelled = known.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    domain, suffix = domain_of(F.col("host"), suffixes).alias("domain"), suffix_of(F.col("host"), suffixes).alias("suffix")
    labelled = stage(labelled.select("host", "n", "bad", domain, suffix), "counts")
    total = labelled.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = (total["bad"] or 0) / total["n"] if total["n"] else 0.0
    level = stage(labelled.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    tops = level.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("above", F.lit(mean))
    s_top = _strength(tops, "above")
    tops = tops.select("suffix", ((F.col("bad") + F.lit(s_top * mean)) / (F.col("n") + F.lit(s_top))).alias("of_suffix"))
    level = level.join(tops, "suffix").withColumnRenamed("of_suffix", "above")
    s_level = _strength(level, "above")
    level = level.select("domain", ((F.col("bad") + F.lit(s_level) * F.col("above")) / (F.col("n") + F.lit(s_level))).alias("of_domain"))
    s = _strength(labelled.join(level, "domain").withColumnRenamed("of_domain", "above"), "above")
    every = labelled.select("host", "n", "bad", "domain", "suffix")
    if hosts is not None:
        new = hosts.where("host IS NOT NULL AND host <> ''").select("host").distinct().join(labelled.select("host"), "host", "left_anti")
        none = F.lit(0).cast("long")
        every = every.unionByName(new.select("host", none.alias("n"), none.alias("bad"), domain, suffix))
    every = every.join(level, "domain", "left").join(tops, "suffix", "left")
    above = F.coalesce("of_domain", "of_suffix", F.lit(mean))
    weight = F.when(F.col("of_domain").isNotNull(), s).when(F.col("of_suffix").isNotNull(), min(s, s_level)).otherwise(min(s, s_level, s_top))
    a = F.col("bad") + weight * above
    b = F.col("n") - F.col("bad") + weight * (1 - above)
    rate = a / (a + b)
    spread = F.sqrt(rate * (1 - rate) / (a + b + 1)) * BOUND
    return every.select("host", "n", "bad", rate.alias("rate"), (rate - spread).alias("lower"), (rate + spread).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: dict[str, str], suffixes: list[str] = SUFFIXES) -> DataFrame:
    """Judge each url: page_id, host, path, rule, verdict.

    The longest fitting rule decides; else a host is blocked when the lower bound of
    its bad rate is above LIMIT; hosts without labelled pages are judged by their domain
    or suffix. Only those hosts are joined, as a set of names. A null url or one without :// has an empty
    host and path; repeated rows are each returned; an empty table gives no rows.
    """
    rows = pages.select(F.col("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    bad = reputation(outcomes, rows.select("host"), suffixes).where(F.col("lower") > LIMIT).select("host", F.lit("block").alias("reputed"))
    verdict = F.lit(None).cast("string")
    for rule, said in rules.items():
        verdict = F.when(F.col("rule") == rule, said).otherwise(verdict)
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce(verdict, F.col("reputed"), F.lit("allow")).alias("verdict"))


def outcomes_by_document(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled outcomes (host, bad): a page whose path ends in a document's number has that document's quality label."""
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    ids = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id"))
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IS NOT NULL AND doc_id IS NOT NULL")
    return ids.where("doc_id IS NOT NULL").join(good, "doc_id").select("host", (F.col("quality") == 0).cast("int").alias("bad"))
