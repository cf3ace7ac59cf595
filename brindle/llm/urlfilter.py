"""URL filters: path rules first, then host reputation by empirical Bayes.

Pages on which a rule decides are the labelled outcomes. A host's chance of being blocked is a
beta posterior whose prior is its registered domain's posterior mean, whose prior is its
suffix's, whose prior is the overall rate; the strength of each prior is fitted to the spread
between the units of that level (method of moments). A page without a rule is blocked when the
lower bound of its host's posterior is over a limit. All of it is Spark SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import fits, lookup_join, materialise

#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Up to so many rules are one expression, more a table and a join.
MAX_RULES = 200
#: Labels that form a public suffix together with a country's two letters, as in co.uk or com.au.
SECOND = "ac asn co com edu go gob gov govt gv id ind ltd me mil ne net nhs nic nom or org plc police sch web".split()
Z = 1.645  # one-sided 95 % bound
LIMIT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url) -> tuple:
    """(host, path): after the first :// up to /, ?, # or the end; then up to ?, # or the end. Null or no ://: empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


RULE = "struct<len:int,rule:string,verdict:string>"


def rule_of(host, path, rules=RULES):
    """A struct (len, rule, verdict) of the longest rule that fits, or null."""
    found = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*found))) if found else F.lit(None).cast(RULE)


def with_rule(p: DataFrame, rules=RULES) -> DataFrame:
    """p (host, path and others) with __r, the longest rule that fits, or null."""
    if len(rules) <= MAX_RULES:
        return p.withColumn("__r", rule_of(F.col("host"), F.col("path"), rules))
    rows = [(h, path, len(h + path), h + path, v) for v, h, path in rules]
    table = materialise(p.sparkSession.createDataFrame(rows, "rh string, rp string, len int, rule string, verdict string"), "rules")
    both = materialise(p.groupBy("host", "path").agg(F.count("*").alias("w")), "urls")
    cut = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(cut)), lambda i: F.array_join(F.slice(cut, i, F.size(cut)), "."))
    found = both.select("host", "path", "w", F.explode(F.array_distinct(ends)).alias("rh")).join(F.broadcast(table) if fits(table) else table, "rh").where(F.col("path").startswith(F.col("rp")))
    best = found.groupBy(F.col("host").alias("h2"), F.col("path").alias("p2")).agg(F.max(F.struct("len", "rule", "verdict")).alias("__r"), F.first("w").alias("w"))
    return lookup_join(p, materialise(best, "ruled"), [("host", "h2"), ("path", "p2")], "w", F.xxhash64("page_id"), ["__r"])


def units_of(host) -> tuple:
    """(host, registered domain, public suffix) that a host's reputation is kept under.

    A port, a user name and a last dot are no part of it. An address is its own domain, under a
    suffix of its own kind. A public suffix is the last label, or the last two where a label of
    SECOND stands before a country's two letters; the domain has one label more, and a host that
    is a suffix itself is its own domain.
    """
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    cut = F.split(bare, r"\.")
    n = F.size(cut)
    two = (n >= 2) & F.element_at(cut, -1).rlike("^[a-z]{2}$") & F.get(cut, n - 2).isin(SECOND)
    address = bare.rlike(r"^\[|^[0-9]+(\.[0-9]+){3}$")
    last = lambda k: F.array_join(F.slice(cut, F.greatest(n - k + 1, F.lit(1)), F.least(F.lit(k), n)), ".")
    suffix = F.when(address, F.lit("[address]")).when(two, last(2)).otherwise(last(1))
    domain = F.when(address, bare).when(two, last(3)).otherwise(last(2))
    return bare, domain, suffix


def _shrunk(units: DataFrame, key: str, prior: str, k: str, n: str, name: str) -> DataFrame:
    """Posterior of each unit around its prior mean, with one strength for the level."""
    seen = F.col(n) > 0
    rate, base = F.col(k) / F.col(n), F.col(prior)
    # between-unit variance beyond binomial noise, over units with labelled pages
    fit = units.where(seen).agg(
        F.avg(base * (1 - base)).alias("__pq"),
        F.avg((rate - base) * (rate - base) - base * (1 - base) / F.col(n)).alias("__v"),
    )
    v = F.greatest(F.coalesce("__v", F.lit(0.0)), F.lit(1e-6))
    s = F.least(F.greatest(F.coalesce("__pq", F.lit(0.0)) / v - 1, F.lit(1.0)), F.lit(1e6))
    a, b = F.col(k) + base * F.col("__s"), F.col(n) - F.col(k) + (1 - base) * F.col("__s")
    out = units.crossJoin(F.broadcast(fit)).withColumn("__s", s)  # one row
    out = out.withColumn(f"{name}_mean", a / (a + b)).withColumn(f"{name}_sd", F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))
    return out.drop("__pq", "__v", "__s")


def reputation(labelled: DataFrame) -> DataFrame:
    """One row per host as units_of() has it: n pages, n_labelled, n_blocked, block_mean, block_bound. labelled: host, blocked (0, 1 or null)."""
    bare, domain, suffix = units_of(F.col("host"))
    hosts = labelled.withColumn("host", bare).groupBy("host").agg(F.count("*").alias("n"), F.count("blocked").alias("n_labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("n_blocked"))
    hosts = materialise(hosts.withColumns({"suffix": suffix, "domain": domain}), "hosts")
    total = [F.sum("n_labelled").alias("k_n"), F.sum("n_blocked").alias("k_b")]
    root = hosts.agg(*total).select(((F.coalesce("k_b", F.lit(0)) + 0.5) / (F.coalesce("k_n", F.lit(0)) + 1)).alias("root"))
    suffix = _shrunk(hosts.groupBy("suffix").agg(*total, F.count("*").alias("w")).crossJoin(F.broadcast(root)), "suffix", "root", "k_b", "k_n", "suffix")
    suffix = materialise(suffix.select(F.col("suffix").alias("s2"), "suffix_mean", "w"), "suffixes")
    domain = hosts.groupBy("domain", "suffix").agg(*total, F.count("*").alias("w"))
    domain = lookup_join(domain, suffix, [("suffix", "s2")], "w", F.col("domain"), ["suffix_mean"])
    domain = materialise(_shrunk(domain, "domain", "suffix_mean", "k_b", "k_n", "domain").select(F.col("domain").alias("d2"), "domain_mean", "w"), "domains")
    out = lookup_join(hosts, domain, [("domain", "d2")], "w", F.col("host"), ["domain_mean"])
    out = _shrunk(out, "host", "domain_mean", "n_blocked", "n_labelled", "host")
    return out.select("host", "n", "n_labelled", "n_blocked", F.col("host_mean").alias("block_mean"), (F.col("host_mean") - Z * F.col("host_sd")).alias("block_bound"))


def apply(pages: DataFrame, rules=RULES, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule, verdict, block_mean, block_bound for every row of pages (page_id, url).

    A null url, or one without ://, has an empty host and path; the empty host is a host like any
    other. Repeated rows each count as an outcome. Ties between rules of one length go to the
    larger text (they cannot both fit one host unless they are equal). Without any labelled page
    the prior is one half and nothing is over the limit. Very long urls are read whole; an empty
    table gives an empty result. Other columns are ignored.
    """
    host, path = parts(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    p = with_rule(p, rules)
    outcome = F.when(F.col("__r").isNotNull(), (F.col("__r.verdict") == "block").cast("int"))
    rep = materialise(reputation(p.select("host", outcome.alias("blocked"))), "reputation")
    p = p.withColumn("__unit", units_of(F.col("host"))[0])
    out = lookup_join(p, rep.withColumnRenamed("host", "h2"), [("__unit", "h2")], "n", F.xxhash64("page_id"), ["block_mean", "block_bound"])
    own = F.when(F.col("block_bound") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__r.rule").alias("rule"), F.coalesce("__r.verdict", own).alias("verdict"), "block_mean", "block_bound")
