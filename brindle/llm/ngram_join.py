"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word shingles. Shingles have one global order: those that are
frequent in the corpus last (a bounded list of heavy hitters, merged from all partitions), the
rest by hash. If two sets are similar enough, the first |x| - ceil(t |x|) + l shingles of both
share at least l. Each document picks its own l: where the estimated cost of its candidates is
high, it lengthens its prefix, and its pairs must then share min(l) prefix shingles.

Nothing is enumerated twice: equal sets are one class; stars around a pivot of each prefix
bucket first connect what is alike; only pairs of different components are then joined, in
blocks for large buckets. Parity sketches (each differing shingle flips one bit: first of 256,
then of a number in proportion to the set) drop pairs that cannot qualify, without loss; the
rest is verified on the whole sets. Shingles are told apart by 64 bits made of BLAKE2 hashes of
their words: two different ones agree with a chance of 2**-64, so sizes and links are exact up to that.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, fits, hot_safe_join, lookup_join, materialise, ship, slices, sweep
from brindle.llm.components import components

#: Heavy hitters that move to the end of the order; a matter of speed, never of results.
HOT_SHINGLES = 200_000
BITS = 256
FINE = 8  # bits of the fine sketch for each shingle that may differ
FINEST = 1 << 15  # bits; beyond this a sketch is only coarser
LONGEST = 4  # largest l
BLOCK = 512  # larger prefix buckets are joined in blocks of about so many rows
STARS = 2
CROWD = 16  # buckets from this size on are first connected by stars
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PART = 1 << 18  # bytes split into words at once; a part ends before white space
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_WORDS = 200_000  # words whose hashes a worker keeps
_SLICE = 4 << 20  # bytes of text turned into shingles at once


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x


class _Hashes(dict):
    """The first 64 bits of BLAKE2 of a word, kept for short words."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 40:
            if len(self) >= _WORDS:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+, A-Z taken as a-z."""
    found, at = [], 0
    while at < len(data):
        gap = _GAP.search(data, at + _PART)
        end = gap.start() if gap else len(data)
        words = data[at:end].lower().split()
        found.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate([*found, np.empty(0, np.uint64)])


def shingles(text: bytes | str | None, k: int) -> np.ndarray:
    """The distinct shingles of a whole text as sorted 64-bit hashes; with fewer than k words, one for all of them."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    w = word_hashes(text or b"")
    if not len(w):
        return w
    k = min(k, len(w))
    n = len(w) - k + 1
    x = np.full(n, k, np.uint64)
    for i in range(k):
        x = _mix((x ^ w[i : i + n]) * _BASE)
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def heavy(docs: DataFrame, k: int, size: int = HOT_SHINGLES) -> tuple[np.ndarray, np.ndarray]:
    """About the `size` most frequent shingles over all documents, with counts (at most size pairs, and their number by magnitude, reach the driver)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, cnt = np.empty(0, np.uint64), np.empty(0, np.int64)
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                sets = [shingles(t, k) for t in part["text"].to_pylist()]
                t, c = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
                t, c = np.concatenate([tok, t]), np.concatenate([cnt, c])
                order = np.argsort(t, kind="stable")
                t, c = t[order], c[order]
                first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.empty(0, int)
                tok, cnt = t[first], np.add.reduceat(c, first) if len(first) else c
                if len(tok) > 2 * size:
                    keep = np.sort(np.argpartition(-cnt, size)[:size])
                    tok, cnt = tok[keep], cnt[keep]
        tok, cnt = tok[cnt > 1], cnt[cnt > 1]
        if len(tok) > size:
            keep = np.argpartition(-cnt, size)[:size]
            tok, cnt = tok[keep], cnt[keep]
        yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(cnt)], ["t", "c"])

    sums = docs.select("text").mapInArrow(count, "t long, c long").groupBy("t").agg(F.sum("c").alias("c"))
    sums = materialise(sums.withColumn("mag", F.floor(F.log2("c") * 32)), "heavy")
    # the lowest magnitude from which on there are at most `size`: no task sorts or gathers more
    total, least = 0, None
    for mag, n in sorted(map(tuple, sums.groupBy("mag").count().collect()), reverse=True):
        if (total := total + n) > size:
            break
        least = mag
    top = sums.where(F.col("mag") >= least if least is not None else F.lit(False)).select("t", "c").toPandas()
    discard(sums)
    t = top["t"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(t)
    return t[order], top["c"].to_numpy(np.int64)[order]


def prefix(s: np.ndarray, hot: np.ndarray, counts: np.ndarray, num: int, den: int) -> tuple[int, np.ndarray]:
    """(l, prefix) of one set, in the global order (estimated frequency, hash)."""
    n = len(s)
    need = -(-num * n // den)
    freq = np.ones(n, np.int64)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        hit = hot[i] == s
        freq[hit] = np.maximum(counts[i[hit]], 2)
    ordered = np.lexsort((s, freq))
    base, best, ell = n - need, None, 1
    total = np.cumsum(freq[ordered] - 1)
    for j in range(1, min(LONGEST, need) + 1):
        at = total[base + j - 1]
        cost = base + j + at + 4 * at / j  # rows to shuffle and match; by Markov at / j candidates to verify
        if best is None or cost < best:
            best, ell = cost, j
    return ell, s[ordered[: base + ell]]


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles by cell, as longs."""
    odd = (np.bincount((s >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def fine_sketch(s: np.ndarray, num: int, den: int) -> bytes:
    """As sketch(), of a power of two of bits that fits the number of shingles that may differ."""
    may = 2 * len(s) * (den - num) // (den + num)
    bits = min(FINEST, max(64, 1 << (FINE * may).bit_length()))
    odd = (np.bincount(((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).tobytes()


def fine_off(x: bytes, y: bytes) -> int:
    """The bits in which two fine sketches differ; the longer one is folded to the length of the other."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return int(np.bitwise_count(p ^ q).sum())


def set_key(s: np.ndarray) -> bytes:
    """One key for equal sets."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def features(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n, key (of the whole set; null if empty), ell, pre, sk, fine for each row."""
    hot, counts = heavy(docs, k)
    given = docs.sparkSession.sparkContext.broadcast((hot, counts))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = given.value
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                rows = []
                for text in part["text"].to_pylist():
                    s = shingles(text, k)
                    if not len(s):
                        rows.append((0, None, 0, None, None, None))
                        continue
                    ell, pre = prefix(s, hot, counts, num, den)
                    rows.append((len(s), set_key(s), ell, pre.view(np.int64), sketch(s), fine_sketch(s, num, den)))
                n, key, ell, pre, sk, fine = zip(*rows, strict=True)
                longs = pa.list_(pa.int64())
                cols = [part["doc_id"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(ell, pa.int32()), pa.array(pre, longs), pa.array(sk, longs), pa.array(fine, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "key", "ell", "pre", "sk", "fine"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, n long, key binary, ell int, pre array<long>, sk array<long>, fine binary")


def _alike(x: str, y: str, num: int, den: int):
    """Size filter and parity sketch of two structs n, sk: false only for pairs that do not qualify."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    off = sum((F.bit_count(F.col(f"{x}.sk")[i].bitwiseXOR(F.col(f"{y}.sk")[i])) for i in range(BITS // 64)), F.lit(0))
    return (n * den >= m * num) & (m * den >= n * num) & (off * (den + num) <= (n + m) * (den - num))


def _sifted(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) without those that the fine sketches rule out."""
    pairs = materialise(pairs, "pairs")
    by_b = pairs.join(nodes.select(F.col("nid").alias("b"), F.struct("n", "fine").alias("y")), "b")
    w = pairs.groupBy(F.col("a").alias("nid")).agg(F.count("*").alias("w"))
    both = hot_safe_join(by_b, nodes.select("nid", F.struct("n", "fine").alias("x")), [("a", "nid")], "w", F.col("b"), ["x"], w)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = np.fromiter(map(fine_off, batch["p"].to_pylist(), batch["q"].to_pylist()), np.int64, batch.num_rows)
            yield batch.select(["a", "b"]).filter(pa.array(off * (den + num) <= batch["nm"].to_numpy() * (den - num)))

    cols = both.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("nm"), F.col("x.fine").alias("p"), F.col("y.fine").alias("q"))
    out = materialise(cols.mapInArrow(sift, "a long, b long"), "pairs")
    discard(pairs)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets qualify. Only the texts of documents in a pair are read again."""
    sweep(docs.sparkSession)
    need = pairs.select(F.col("a").alias("nid")).union(pairs.select(F.col("b").alias("nid"))).distinct()
    need = materialise(need.join(nodes.select("nid", "rep", "key"), "nid").select("nid", "key", F.col("rep").alias("__rep")), "need")
    few = fits(need)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    src = src.join(F.broadcast(need) if few else need, F.col("doc_id").eqNullSafe(F.col("__rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = [shingles(t, k) for t in part["text"].to_pylist()]
                own = [set_key(s) == x for s, x in zip(found, part["key"].to_pylist(), strict=True)]
                arr = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part["nid"], arr], ["nid", "arr"]).filter(pa.array(own))

    # a repeated row makes a set twice, which only repeats a link
    arrays = materialise(src.select("nid", "key", "text").mapInArrow(sets, "nid long, arr array<long>"), "sets")
    sweep(docs.sparkSession)
    by_b = pairs.join(arrays.select(F.col("nid").alias("b"), F.col("arr").alias("y")), "b")
    w = pairs.groupBy(F.col("a").alias("nid")).agg(F.count("*").alias("w"))
    full = hot_safe_join(by_b, arrays.select("nid", F.col("arr").alias("x")), [("a", "nid")], "w", F.col("b"), ["x"], w)
    both = F.size(F.array_intersect("x", "y"))
    links = materialise(full.where(both * (den + num) >= (F.size("x") + F.size("y")) * num).select("a", "b"), "links")
    discard(pairs, need, arrays)
    return links


def link(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text).

    Two documents link when den * |x and y| >= num * |x or y|; component_id is the smallest
    doc_id reachable. Null or empty texts have no shingles and link with nothing; texts are read
    whole, however long; pairs just at the threshold link; repeated rows are alike and share a
    component; rows without a doc_id may link others; an empty table gives an empty result; other
    columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    f = materialise(features(docs, k, num, den), "features")
    first = {c: F.first(c).alias(c) for c in ("n", "ell", "pre", "sk", "fine")}
    nodes = f.where("n > 0").groupBy("key").agg(*first.values(), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    entries = nodes.select(F.explode("pre").alias("tok"), "nid")
    stats = materialise(entries.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1"), "stats")
    many = hot_safe_join(entries, stats.withColumnRenamed("tok", "t2"), [("tok", "t2")], "c", F.col("nid"), ["c"], how="inner")
    ent = materialise(many.join(nodes.select("nid", "n", "ell", "copies", "sk"), "nid"), "entries")
    discard(stats)

    edges = label = None
    left = crowd = materialise(ent.where(F.col("c") >= CROWD).withColumn("comp", F.col("nid")), "crowd")
    for r in range(STARS):
        order = F.struct((-F.col("copies") if r == 0 else F.xxhash64("nid", F.lit(r))).alias("o"), "nid", "n", "sk", "comp")
        pivots = left.groupBy("tok").agg(F.min(order).alias("p"), F.count("*").alias("pc")).withColumnRenamed("tok", "t2")
        star = hot_safe_join(left.select("tok", F.struct("nid", "n", "sk", "comp").alias("x")), materialise(pivots, "pivots"), [("tok", "t2")], "pc", F.col("x.nid"), ["p"], how="inner")
        star = star.where((F.col("x.comp") != F.col("p.comp")) & _alike("x", "p", num, den))
        near = _sifted(star.select(F.col("p.nid").alias("a"), F.col("x.nid").alias("b")).distinct(), nodes, num, den)
        found = _verified(near, nodes, docs, k, num, den)
        if found.isEmpty():
            break
        edges = found if edges is None else edges.union(found)
        label = components(edges)
        edges = label.select(F.col("node").alias("a"), F.col("comp").alias("b"))  # a star for each component
        left = _open(crowd, label)
    left = _with_comp(ent, label).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    x = left.select("tok", F.pmod(F.hash("nid"), F.col("blocks")).alias("blk"), F.struct("nid", "n", "sk", "comp", "ell").alias("x"))
    y = left.select("tok", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.struct("nid", "n", "sk", "comp", "ell").alias("y"))
    pairs = x.join(y, ["tok", "blk"]).where((F.col("x.nid") < F.col("y.nid")) & (F.col("x.comp") != F.col("y.comp")) & _alike("x", "y", num, den))
    pairs = pairs.groupBy(F.col("x.nid").alias("a"), F.col("y.nid").alias("b"), F.least("x.ell", "y.ell").alias("l")).agg(F.count("*").alias("m")).where("m >= l").select("a", "b")
    pairs = _sifted(pairs, nodes, num, den)
    discard(ent, crowd)
    # one partner of each first: what that connects needs no more checks
    first = pairs.groupBy("b").agg(F.min("a").alias("a"))
    for some in (first, None):
        if some is None:
            some = _with_comp(pairs.withColumnRenamed("a", "nid"), label).withColumnsRenamed({"nid": "a", "comp": "ca"})
            some = _with_comp(some.withColumnRenamed("b", "nid"), label).withColumnsRenamed({"nid": "b"}).where("ca != comp").select("a", "b")
        found = _verified(materialise(some, "pairs"), nodes, docs, k, num, den)
        if not found.isEmpty():
            label = components(found if edges is None else edges.union(found))
            edges = label.select(F.col("node").alias("a"), F.col("comp").alias("b"))

    classes = nodes.select("nid", "key", "rep", "copies")
    if label is not None:
        sizes = label.groupBy(F.col("comp").alias("c2")).agg(F.count("*").alias("w"))
        named = label.join(nodes.select(F.col("nid").alias("node"), "rep"), "node").groupBy("comp").agg(F.min("rep").alias("cid")).join(sizes, F.col("comp") == F.col("c2")).select("c2", "cid", "w")
        label = lookup_join(label, materialise(named, "named"), [("comp", "c2")], "w", F.col("node"), ["cid"])
        classes = classes.join(label.select("node", "cid"), F.col("nid") == F.col("node"), "left")
    else:
        classes = classes.withColumn("cid", F.lit(None).cast("long"))
    shared = materialise(classes.where("copies > 1 or cid is not null").select(F.col("key").alias("k2"), F.coalesce("cid", "rep").alias("cid"), "copies"), "classes")
    out = lookup_join(f.select("doc_id", "n", "key"), shared, [("key", "k2")], "copies", F.col("doc_id"), ["cid"])
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("cid", "doc_id").alias("component_id"))


def _with_comp(ent: DataFrame, label: DataFrame | None) -> DataFrame:
    """ent with the component of each node, itself where it has none."""
    ent = ent.drop("comp")
    if label is None:
        return ent.withColumn("comp", F.col("nid"))
    out = lookup_join(ent, label.withColumn("w", F.lit(1)), [("nid", "node")], "w", F.col("nid"), ["comp"])
    return out.withColumn("comp", F.coalesce("comp", "nid"))


def _open(ent: DataFrame, label: DataFrame) -> DataFrame:
    """The entries of buckets that still hold more than one component."""
    left = materialise(_with_comp(ent, label), "crowd")
    more = left.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("w")).where("lo < hi").select(F.col("tok").alias("t2"), "w", F.lit(True).alias("more"))
    return materialise(hot_safe_join(left, materialise(more, "open"), [("tok", "t2")], "w", F.col("nid"), ["more"], how="inner").drop("more"), "crowd")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, columns unchanged.

    Of rows that repeat a doc_id one stays. Rows without a doc_id always stay (they have no
    place in the order).
    """
    label = link(docs, k, num, den).where("doc_id is not null and doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    label = materialise(label, "gone")
    few = fits(label)
    kept = docs.join(F.broadcast(label) if few else label, docs["doc_id"] == label["__gone"], "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("__n")).where("__n > 1 and doc_id is not null").select(F.col("doc_id").alias("__again"))
    again = materialise(again, "again")
    if again.isEmpty():
        return kept
    once = kept.join(again, kept["doc_id"] == again["__again"], "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"] == again["__again"], "left_semi").dropDuplicates(["doc_id"]))
