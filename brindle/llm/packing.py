"""Best-fit packing with large-item matching.

Documents are tokenised once; the packing itself needs only how many pieces there are of each
length (a histogram of at most `capacity` counts), so it is planned on the driver at a cost that
does not grow with the corpus: pieces over a third of the capacity pair at most twice per bin by
greedy matching (largest with the largest partner that fits), then smaller pieces go by best fit
into the gaps, longest first, and what is left opens new bins filled the same way. The plan is a
list of bin patterns with multiplicities; pieces find their bin by their rank within their length.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialise, ship

CAPACITY = 2048
END = 0
#: Words cached by a worker process; the cache starts anew beyond it.
CACHE = 200_000

_tokens: dict = {}


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian uint32 bytes.

    Pieces of that vocabulary never reach over a space that follows a non-space character, so a
    text is cut there and each cut is encoded once per process.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.word = self._merger()
        self.cache: dict[str, bytes] = {}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]

    def _merger(self):
        """The same vocabulary as merge ranks: much faster for single words."""
        import tiktoken
        from public_tokenizers import PATTERN

        # the usual printable stand-ins for bytes in byte-level vocabularies
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        as_byte = {c: b for b, c in as_char.items()}
        vocab = self.tok.get_vocab(with_added_tokens=False)
        extra = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        ranks = {bytes(as_byte[c] for c in t): i for t, i in vocab.items() if t not in extra}
        return tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    _odd = re.compile(r"\s(?= )")

    def encode(self, text: str) -> bytes:
        if self._odd.search(text) or any(s in text for s in self.special):
            return self.raw([text])[0]
        first, *rest = text.split(" ")
        parts = [first, *[" " + x for x in rest]]
        if not rest and not first:
            return b""
        cache = self.cache
        new = {p for p in parts if p not in cache}
        if new:
            if len(cache) + len(new) > CACHE:
                cache.clear()
                new = set(parts)
            word = self.word
            for p in new:
                ids = word(p)
                cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        return b"".join([cache[p] for p in parts])


def encoder(path: str) -> Encoder:
    if path not in _tokens:
        _tokens[path] = Encoder(path)
    return _tokens[path]


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Null text is an empty text (one piece: the end id)."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        end = np.asarray([END], dtype="<u4").tobytes()
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["doc_id"].array, pdf["text"].array, strict=True):
                ids = (enc.encode(text) if isinstance(text, str) else b"") + end
                n = len(ids) // 4
                first = n % capacity or capacity
                at = 0
                for k in range((n + capacity - 1) // capacity):
                    size = first if k == 0 else capacity
                    rows.append((doc_id, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                    at += size
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids travel as text: pandas would turn a column with nulls into floats
    out = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(cut, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Bin patterns (lengths, in place order) with multiplicities that use each length just counts[length] times."""
    left = {n: c for n, c in counts.items() if c > 0}
    sizes = sorted(left)
    out: list[tuple[tuple[int, ...], int]] = []
    third = capacity // 3

    def drop(n: int) -> None:
        if left[n] == 0:
            del left[n]
            sizes.pop(bisect.bisect_left(sizes, n))

    def best(gap: int, least: int = 1) -> int | None:
        """The longest piece that is left and fits the gap, of at least `least`."""
        i = bisect.bisect_right(sizes, gap)
        return sizes[i - 1] if i and sizes[i - 1] >= least else None

    open_bins: list[tuple[list[int], int, int]] = []  # pattern, gap, how many
    while sizes and sizes[-1] > third:  # greedy matching of large pieces, two per bin at most
        a = sizes[-1]
        left[a] -= 1
        b = best(capacity - a, third + 1)
        left[a] += 1
        if b is None:
            open_bins.append(([a], capacity - a, left[a]))
            left[a] = 0
            drop(a)
            continue
        k = left[a] // 2 if a == b else min(left[a], left[b])
        if k == 0:  # a == b and one is left, though a pair was found
            if (b := best(min(capacity - a, a - 1), third + 1)) is None:
                open_bins.append(([a], capacity - a, 1))
                left[a] = 0
                drop(a)
                continue
            k = 1
        open_bins.append(([a, b], capacity - a - b, k))
        for n in {a, b}:
            left[n] -= k * (2 if a == b else 1)
            drop(n)
    # tight gaps first: they accept the fewest pieces
    todo = sorted(open_bins, key=lambda x: (x[1], x[0]))[::-1]
    while todo or sizes:
        if not todo:
            a = sizes[-1]
            k = max(1, left[a] // max(1, capacity // a))
            todo.append(([], capacity, k))
        pattern, gap, k = todo.pop()
        a = best(gap)
        if a is None:
            if pattern:
                out.append((tuple(pattern), k))
            continue
        fit = min(gap // a, left[a])
        if k * fit <= left[a]:
            n, each = k, fit
        else:
            each = max(1, left[a] // k) if left[a] >= k else 1
            n = min(k, left[a] // each)
        left[a] -= n * each
        drop(a)
        if n < k:
            todo.append((pattern, gap, k - n))
        todo.append((pattern + [a] * each, gap - a * each, n))
    merged: dict[tuple[int, ...], int] = {}
    for p, k in out:
        merged[p] = merged.get(p, 0) + k
    return list(merged.items())


def segments(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first bin, offset), sorted by rank: piece r is in bin first_bin + r - first_rank."""
    seg: dict[int, list[tuple[int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for lengths, k in patterns:
        at = 0
        for n in lengths:
            r = rank.get(n, 0)
            seg.setdefault(n, []).append((r, base, at))
            rank[n] = r + k
            at += n
        base += k
    return {n: np.asarray(v, dtype=np.int64) for n, v in seg.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of docs with sequence_id and offset.

    Repeated rows are packed once each; a null doc_id stays null; a null text is empty (one piece:
    the end id); an empty table gives an empty result; other columns are ignored. Whole texts are
    packed, however long: only documents over the capacity are cut, and all pieces but the first
    are full then. Ties between pieces of one length go by bucket, doc_id and piece. Windows run
    over counts by (length, bucket), at most 4096 for each length, whatever the corpus.
    """
    spark = docs.sparkSession
    p = materialise(pieces_of(docs, tokenizer, capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4096))), "pieces")
    # per (length, bucket) counts: at most capacity * 4096 rows, whatever the corpus
    per = materialise(p.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    seg = segments(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select("length", F.col("bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), "n")
    # a bucket of a length holds at most 1/4096 of that length's pieces, or one document's repeated rows
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = p.withColumn("r", F.row_number().over(own) - 1).join(starts.drop("n"), ["length", "bucket"]).withColumn("rank", F.col("r") + F.col("before"))
    plan_of = spark.sparkContext.broadcast(seg)  # bounded by the number of patterns, not by the corpus

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = plan_of.value
        for pdf in batches:
            bin_, off = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            order = np.argsort(lengths, kind="stable")
            cuts = np.flatnonzero(np.diff(lengths[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    s = table[int(lengths[at[0]])]
                    i = np.searchsorted(s[:, 0], ranks[at], side="right") - 1
                    bin_[at], off[at] = s[i, 1] + ranks[at] - s[i, 0], s[i, 2]
            yield pdf[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=bin_, offset=off)

    out = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "piece", "start", "length", "ids_crc32", "rank").mapInPandas(
        place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
