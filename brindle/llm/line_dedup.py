"""Line deduplication by repeated runs of lines, in DataFrame functions only.

Two kinds of runs are looked at. Chunks: a document's lines are hashed; a rolling hash over
WINDOW neighbouring line hashes marks the last line of a chunk, so boundaries depend on the lines
around them and not on their position; chunks of several lines count, however short. Passages:
from each line on, and up to each line, the shortest run of whole lines with more than WORDS
words. Whether a run is such a passage depends on its own lines only, and any run of more than
WORDS words is the union of such passages in it, so every line of a run of that length which an
earlier place also holds is found, one-line texts included. Runs that repeat are told apart by
their SHA-256; all but the first (smallest doc_id, then position) are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import fits, hot_safe_join, let, materialise

WINDOW = 2
#: One boundary for so many lines on average.
DIVISOR = 2
BASE = 31
#: A passage has more words than this.
WORDS = 50
#: Passages of so few lines are found by plain comparisons, longer ones by a loop.
SHORT = 4


def _line_hashes(lines):
    """A 32-bit number of each line."""
    return F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))


def _n_words(line):
    return F.size(F.array_remove(F.split(F.translate(line, "\t\x0b\f\r", "    "), " "), ""))


def _span(first, last):
    """Both line numbers in one long: sets of longs are hashed, sets of structs are compared pair by pair."""
    return F.shiftleft(first.cast("long"), 32) + last


def runs_of(text, key):
    """array<struct<first, last, key>> of a text's chunks and passages; first and last are line numbers from 1, key(body) is made of the run's text."""

    def cut(s):
        body = lambda c: F.array_join(F.slice(s["l"], c["first"], c["last"] - c["first"] + 1), "\n")
        spans = F.array_distinct(F.concat(_chunks(s["h"]), _passages(s["n"], True), let(F.reverse(s["n"]), lambda n: _passages(n, False))))
        ends = F.transform(spans, lambda p: F.struct(F.shiftright(p, 32).cast("int").alias("first"), p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("last")))
        return F.transform(ends, lambda c: F.struct(c["first"], c["last"], key(body(c)).alias("key")))

    lines = F.split(text, "\n")
    full = F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("i"), _n_words(x).alias("n"))), lambda x: x["n"] > 0)
    return F.when(text.isNotNull(), F.transform(F.array(F.struct(lines.alias("l"), _line_hashes(lines).alias("h"), full.alias("n"))), cut)[0])


def _chunks(h):
    """Spans of the chunks of several lines."""
    n = F.size(h)
    at = lambda i: F.get(h, i - 1)
    rolled = lambda i: sum((F.coalesce(at(i - j), F.lit(0)) * BASE**j for j in range(1, WINDOW)), at(i))
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.pmod(rolled(i), F.lit(DIVISOR)) == 0))
    spans = let(ends, lambda ends: F.transform(ends, lambda e, k: F.struct(F.when(k == 0, F.lit(1)).otherwise(F.get(ends, k - 1) + 1).alias("b"), e.alias("e"))))
    return F.transform(F.filter(spans, lambda c: c["e"] > c["b"]), lambda c: _span(c["b"], c["e"]))


def _passages(full, onward: bool):
    """Spans of the shortest passage from each line; full: array<struct<i, n>>, number and words of the lines with words, backwards if not onward."""

    def far(k):  # each of the lines has a word, so one more than WORDS are enough
        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("int").alias("i"))
        add = lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when(a["i"].isNull() & (a["n"] + x["n"] > WORDS), x["i"]).otherwise(a["i"]).alias("i"))
        return F.aggregate(F.slice(full, k + 1, WORDS + 1), start, add, lambda a: a["i"])

    def end(k):
        at = lambda j: F.get(full, k + j)
        out, total = F, F.lit(0)
        for j in range(SHORT):
            total = total + at(j)["n"]
            out = out.when(total > WORDS, at(j)["i"])
        return out.otherwise(far(k))

    span = lambda x, k: _span(x["i"], end(k)) if onward else _span(end(k), x["i"])
    return F.filter(F.transform(full, span), lambda p: p.isNotNull())


def _merged(gone: DataFrame) -> DataFrame:
    """doc_id, th, cut: the ranges (first, last) of each document, sorted; those that overlap or adjoin are one."""
    longest = gone.groupBy("doc_id", "th", "first").agg(F.max("last").alias("last"))  # so repeated rows are one before a document's ranges meet in a task
    own = Window.partitionBy("doc_id", "th").orderBy("first")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    apart = longest.withColumn("apart", F.when(F.col("first") > reach + 1, 1).otherwise(0))
    k = F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = apart.withColumn("k", k).groupBy("doc_id", "th", "k").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return merged.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("cut"))


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), cut: the [first, last] line ranges to remove from each document that has any, no two with a common line."""

    def own(key):
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.explode(runs_of(F.col("text"), key)).alias("c"))

    twice = own(F.xxhash64).groupBy(F.col("c.key").alias("h2")).agg(F.count("*").alias("w")).where("w > 1")
    twice = materialise(twice, "hashes")
    all_runs = own(lambda body: F.struct(F.xxhash64(body).alias("h"), F.unhex(F.sha2(body, 256)).alias("s")))
    all_runs = all_runs.select("doc_id", "th", "c.first", "c.last", "c.key.h", "c.key.s")
    some = hot_safe_join(all_runs, twice, [("h", "h2")], "w", F.xxhash64("doc_id", "first"), ["w"], how="inner")
    some = materialise(some.drop("w", "h"), "runs")
    place = F.struct("doc_id", "th", "first")
    keep = some.groupBy("s").agg(F.min(place).alias("keep"), F.count("*").alias("w")).where("w > 1")
    keep = materialise(keep.select(F.col("s").alias("s2"), "keep", "w"), "keepers")
    # equal rows of documents are one document here: all its rows keep what the first keeps
    gone = hot_safe_join(some.withColumn("place", place), keep, [("s", "s2")], "w", F.xxhash64("doc_id", "first"), ["keep"], how="inner")
    gone = gone.where(~F.col("keep").eqNullSafe(F.col("place")))
    return _merged(gone)


def _cleaned(docs: DataFrame) -> DataFrame:
    """__row (all columns of docs), __text, __n_lines, __n_removed."""
    cut = materialise(repeated(docs).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("cut").alias("__cut")), "cuts")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    text = F.col("__row.text")
    same = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(text) == F.col("__h"))
    d = d.join(F.broadcast(cut) if fits(cut) else cut, same, "left")
    lines = F.split(text, "\n")
    # no line is in two ranges, so this holds no more numbers than the text has lines
    gone = F.flatten(F.transform("__cut", lambda c: F.sequence(c["first"], c["last"])))
    left = F.array_except(F.sequence(F.lit(1), F.size(lines)), gone)
    kept = let(lines, lambda a: F.transform(left, lambda i: F.get(a, i - 1)))
    whole = F.col("__cut").isNull()
    removed = F.when(whole, F.lit(0)).otherwise(F.size(lines) - F.size(left))
    return d.select("__row", F.when(whole, text).otherwise(F.array_join(kept, "\n")).alias("__text"), F.coalesce(F.size(lines), F.lit(0)).alias("__n_lines"), removed.alias("__n_removed"))


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, text without the repeated runs of lines, n_lines, n_removed for every row of docs (doc_id, text).

    Null texts stay as they are; a text whose lines are all repeats becomes empty; texts are read
    whole, however long; of equal runs the one with the smallest doc_id, then hash of the text,
    then place stays; repeated rows (same doc_id and text) are treated as one document; a null
    doc_id sorts first; an empty table gives an empty result; other columns are ignored.
    """
    return _cleaned(docs.select("doc_id", "text")).select("__row.doc_id", F.col("__text").alias("text"), F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"))


def dedup(docs: DataFrame) -> DataFrame:
    """The rows of docs with cleaned text, all other columns unchanged, whatever their names; edge cases as in remove()."""
    return _cleaned(docs).select(*[F.col("__text").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])
