"""Quality rules with host verdicts.

Every document is judged by its own rules; the failures of each rule are then counted by host,
each host's rate is shrunk with a beta prior fitted to all hosts, and a host whose posterior is
surely over a rule's limit rejects all its documents. The prior's mean is the overall rate; its
strength comes from the spread between hosts beyond binomial noise, hosts weighted by their
documents (Kleinman's moment estimator).
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import lookup_join, materialise, ship

MIN_WORDS = 50
#: A host whose shrunk failure rate of a rule is surely (one-sided 95 %) over this, and over the
#: overall rate, is rejected with all its documents.
HOST_LIMITS = {"short": 0.5, "repeat": 0.35, "symbols": 0.35, "dup_lines": 0.35}
Z = 1.645
_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
METRICS = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])


def measure(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one whole text; null counts as empty."""
    if not text:
        return 0, 0, 0, 0, 0
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    n = len(words)
    symbols = len(b) - len(b.translate(None, _SYMBOLS))
    chars = len(text) - (len(b) - len(b.translate(None, _SPACE)))
    dup = 0
    if b"\n" in b:
        lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            twice = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if twice[w] > 1:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
    return n, chars, symbols, dup, repeat


@F.pandas_udf(METRICS)
def _metrics(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=NAMES)


def rules(m: str) -> dict[str, F.Column]:
    """Failure of each rule, from a struct column of metrics."""
    c = lambda k: F.col(f"{m}.{k}")
    return {
        "short": c("n_words") < MIN_WORDS,
        "repeat": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 5 * c("n_dup_lines") > c("n_words"),
    }


def host_verdicts(failures: DataFrame, host: str = "__host", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """One row per host: n_docs, the shrunk rate of each rule, __rejected. failures: host and one 0/1 column per rule."""
    per = materialise(failures.groupBy(host).agg(F.count("*").alias("n_docs"), *[F.sum(k).alias(k) for k in limits]), "hosts")
    total = F.sum("n_docs")
    moments = [total.alias("__n"), (F.count("*") - 1).alias("__df"), (total - F.sum(F.col("n_docs") * F.col("n_docs")) / total).alias("__eff")]
    for k in limits:
        moments += [(F.sum(k) / total).alias(f"m_{k}"), (F.sum(F.col(k) * F.col(k) / F.col("n_docs")) - F.sum(k) * F.sum(k) / total).alias(f"v_{k}")]
    prior = per.agg(*moments)
    out = per.crossJoin(F.broadcast(prior))  # one row
    bad = F.lit(False)
    for k, limit in limits.items():
        m, v, pq = F.col(f"m_{k}"), F.col(f"v_{k}"), F.col(f"m_{k}") * (1 - F.col(f"m_{k}"))
        # rho = 1 / (a + b + 1) of the beta prior; hosts that differ by noise only, or a single host: the strongest prior
        room = pq * (F.col("__eff") - F.col("__df"))
        rho = F.when(room > 0, (v - pq * F.col("__df")) / room).otherwise(0.0)
        s = F.when(rho > 0, F.least(F.greatest(1 / rho - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        a, n = F.col(k) + m * s, F.col("n_docs") + s
        out = out.withColumn(f"rate_{k}", a / n)
        bound = F.col(f"rate_{k}") - Z * F.sqrt(a * (n - a) / (n * n * (n + 1)))
        bad = bad | (bound > F.greatest(m, F.lit(limit)))
    return out.select(host, "n_docs", *[f"rate_{k}" for k in limits], bad.alias("__rejected"))


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None) -> DataFrame:
    """__row (the columns in `keep`, all of docs by default), __m (metrics), __f_ and a rule's name (whether it fails), __base_failed.

    Null text counts as empty and fails; a null host is a group of its own; whole texts are
    measured, however long; repeated rows each count and each get the same verdict; an empty table
    gives an empty result; other columns travel in one struct, __row, so no name of theirs clashes.
    """
    ship(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0)]).alias("__row"), F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")).alias("__host"), _metrics(F.col(text)).alias("__m"))
    fails = rules("__m")
    return d.withColumns({f"__f_{k}": c for k, c in fails.items()}).withColumn("__base_failed", F.col("__f_short") | F.col("__f_repeat"))


def with_verdicts(judged: DataFrame, failures: DataFrame, spread) -> DataFrame:
    hosts = host_verdicts(failures.select("__host", *[F.col(f"__f_{k}").cast("long").alias(k) for k in HOST_LIMITS]))
    hosts = hosts.withColumnRenamed("__host", "__vhost")
    out = lookup_join(judged, hosts, [("__host", "__vhost")], "n_docs", spread, ["__rejected"])
    return out.withColumn("__kept", ~F.col("__base_failed") & ~F.coalesce("__rejected", F.lit(False)))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the metrics, base_failed, host_rejected, kept for every row of docs (doc_id, text, source).

    Null text counts as empty and fails; a null source is a host of its own; a host just at a
    limit is kept; repeated rows each count and get the same verdict; whole texts, however long;
    an empty table gives an empty result; other columns are ignored.
    """
    m = materialise(judge(docs, keep=["doc_id"]), "quality")  # narrow: no text
    out = with_verdicts(m, m, F.xxhash64("__row.doc_id"))
    return out.select("__row.doc_id", "__m.*", F.col("__base_failed").alias("base_failed"), F.col("__rejected").alias("host_rejected"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, columns unchanged, that pass their own rules and their host's verdict; edge cases as in assess()."""
    judged = judge(docs)
    narrow = judge(docs, keep=[])
    out = with_verdicts(judged, narrow, F.monotonically_increasing_id())
    return out.where("__kept").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
