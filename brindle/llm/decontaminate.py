"""Benchmark decontamination by canonical templates, in DataFrame functions only.

Words become template tokens: numbers, units after a number, and names (capitalised inside a
sentence) become typed placeholders, other words lose case and outer punctuation. Windows of
WIDTH tokens of the documents are hash-joined with the benchmark's, once as templates and once
as plain words without case and outer punctuation, so a copy in capitals is found too. A hit of
plain words always counts; one of templates counts when the window's slots are consistent: one
value of a slot type in the item always stands for one value in the document. So a question whose
numbers or names were changed throughout is still caught, and one changed in part by its windows
that do not contradict themselves. A capital letter that begins a sentence tells nothing, so the
benchmark's words there are taken as words and, once more, as names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import OUTER, fits, let, lookup_join, materialise, one_line

WIDTH = 8  # windows() hashes 2, 4 and 8 tokens
#: Words that are not slots, at least, in a window; fewer say too little.
LITERALS = 5
#: Units of measure that become a slot after a number.
UNITS = ["mm", "cm", "m", "km", "kg", "g", "mg", "lb", "oz", "l", "ml", "s", "min", "h", "hours", "days", "years", "miles", "km/h", "mph", "percent", "dollars", "euros", "usd", "eur"]
# Slots as single characters that no word can hold after cleaning.
NUM, NAME, UNIT = "\x01", "\x02", "\x03"


def plain(text):
    """The text in one line, one space between words, without the slot characters."""
    return one_line(F.translate(text, NUM + NAME + UNIT, "   "))


def canonical(flat, starts: bool = False):
    """A plain() text with its words replaced by template tokens; word for word. starts: capitals that begin a sentence are names too."""
    # a name: a capital letter after a word that does not end a sentence
    named = F.regexp_replace(flat, r"\p{Lu}(?<=(?:^|\s)[\p{P}\p{S}]{0,2}\p{Lu})\S*" if starts else r"\p{Lu}(?<=[^\s.!?:…] [\p{P}\p{S}]{0,2}\p{Lu})\S*", NAME)
    numbers = F.regexp_replace(named, r"\p{Nd}(?<=(?:^| )[\p{P}\p{S}]{0,2}\p{Nd})[\p{Nd}.,:/%-]*(?!\S)", NUM)
    units = let(numbers, lambda n: F.when(n.contains(NUM), F.regexp_replace(n, rf"(?i)(?<={NUM} )(?:{'|'.join(UNITS)})[.,;:!?]*(?!\S)", UNIT)).otherwise(n))
    return F.lower(F.regexp_replace(units, OUTER, ""))


def literal(flat):
    """A plain() text's words without case and outer punctuation; word for word."""
    return F.lower(F.regexp_replace(flat, OUTER, ""))


def windows(df: DataFrame, widths: list[int], starts: bool = False) -> DataFrame:
    """The other columns, m (tokens), pos (from 0), w (hash), __t (tokens) and __plain (words without case and outer punctuation) for each window of df.text.

    Windows have WIDTH tokens or as many as one of the smaller widths says. Each comes twice: by
    its template tokens and by its plain words, which are then __t as well; with `starts` a third
    time, with capitals at the start of sentences as names. Null texts have none.
    """
    keep = [c for c in df.columns if c != "text"]

    def pairs(a, gap: int, n):
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(F.get(a, i), F.get(a, i + gap)))

    def hashes(t, m):
        n = F.size(t) - m
        if m < WIDTH:
            out = F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(m)]))
        else:  # of 2, then 4, then 8 tokens
            out = let(pairs(t, 1, n + 6), lambda two: let(pairs(two, 2, n + 4), lambda four: pairs(four, 4, n)))
        return F.when(n >= 0, out)

    def both(s):
        return F.array(*[F.struct(t.alias("t"), s["p"].alias("p"), F.lit(m).alias("m"), hashes(t, m).alias("w")) for t in [s[k] for k in kinds] for m in [WIDTH, *widths]])

    # a generator's output is computed once, whatever reads it
    kinds = ["t", "p", "n"] if starts else ["t", "p"]
    forms = let(plain(F.col("text")), lambda flat: let(F.struct(*[F.split({"t": canonical(flat), "p": literal(flat), "n": canonical(flat, True)}[k], " ").alias(k) for k in kinds]), both))
    d = df.select(*keep, F.inline_outer(F.when(F.length(F.trim("text")) > 0, forms)).alias("__t", "__plain", "m", "__w"))
    return d.select(*keep, "m", "__t", "__plain", F.posexplode_outer("__w").alias("pos", "w")).where("w is not null")


def _slots(tokens, words, pos, m):
    """array<string> of the window's slot values with their type; words that are no slots are null."""
    t, p = F.slice(tokens, pos + 1, m), F.slice(words, pos + 1, m)
    return F.zip_with(t, p, lambda a, b: F.when(a.isin(NUM, NAME, UNIT), F.concat(a, b)))


def _literals(tokens, pos, m):
    return F.size(F.filter(F.slice(tokens, pos + 1, m), lambda a: ~a.isin(NUM, NAME, UNIT)))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), item_id, pos for every consistent window hit. benchmark: item_id, text."""
    b = windows(benchmark.select("item_id", "text"), list(range(1, WIDTH)), True).where(F.col("m") == F.least(F.lit(WIDTH), F.size("__t")))
    b = b.where(F.array_max(F.slice("__t", F.col("pos") + 1, F.col("m"))) != "")  # punctuation only says nothing
    b = b.where(_literals("__t", F.col("pos"), F.col("m")) >= F.least(F.lit(LITERALS), F.col("m")))
    b = materialise(b.select("item_id", "m", F.col("pos").alias("ipos"), F.col("w").alias("w2"), _slots("__t", "__plain", F.col("pos"), F.col("m")).alias("__bs")).distinct(), "windows")
    widths = sorted(r["m"] for r in b.where(F.col("m") < WIDTH).select("m").distinct().collect())  # of items shorter than WIDTH
    b = b.withColumnRenamed("m", "m2")
    few = fits(b)
    d = windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), widths)
    found = d.join(F.broadcast(b) if few else b, (F.col("w") == F.col("w2")) & (F.col("m") == F.col("m2")))
    pairs = F.arrays_zip(F.col("__bs").alias("b"), _slots("__t", "__plain", F.col("pos"), F.col("m")).alias("d"))
    pairs = F.array_distinct(F.filter(pairs, lambda p: p["b"].isNotNull()))
    consistent = let(pairs, lambda a: F.size(a) == F.size(F.array_distinct(F.transform(a, lambda p: p["b"]))))
    # a filter would move into the join, which then is not compiled and copies both arrays for each window
    found = found.select("doc_id", "th", "item_id", F.explode_outer(F.when(consistent, F.array("pos"))).alias("pos")).where("pos is not null")
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, th, n_hits, item_ids of each document with a hit."""
    return hits(docs, benchmark).groupBy("doc_id", "th").agg(F.count_distinct("pos").alias("n_hits"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))


def scan(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_hits, item_ids (sorted, maybe empty), contaminated for every row of docs.

    Null and empty texts hit nothing; texts are read whole, however long; repeated rows get the
    same answer, and items that tie all are listed; an empty benchmark marks nothing; benchmark
    items with null text are left out; an empty table gives an empty result; other columns are
    ignored.
    """
    c = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("d2"), F.col("th").alias("h2"), "n_hits", "item_ids", F.lit(1).alias("w")), "hits")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"))
    out = lookup_join(ids, c, [("doc_id", "d2"), ("th", "h2")], "w", F.col("doc_id"), ["n_hits", "item_ids"])
    none = F.array().cast("array<long>")
    return out.select("doc_id", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce(F.col("item_ids").cast("array<long>"), none).alias("item_ids"), F.col("n_hits").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a hit, columns unchanged, whatever their names; edge cases as in scan()."""
    c = materialise(contaminated(docs, benchmark).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h")), "hits")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    same = F.col("__row.doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("__row.text") == F.col("__h"))
    return d.join(F.broadcast(c) if fits(c) else c, same, "left_anti").select(*[F.col("__row")[c].alias(c) for c in docs.columns])
