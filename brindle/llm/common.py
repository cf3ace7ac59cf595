"""Shared pieces: scratch tables in the cluster's shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after a count shows at most so many (narrow) rows.
BROADCAST_ROWS = 200_000
#: ... and that they have at most so many bytes.
BROADCAST_BYTES = 64 << 20
#: Keys with at least this share of the rows count as hot; so there are at most this many.
HOT_KEYS = 1000
#: Below so many left rows no key needs to be dealt out.
HOT_ROWS = 20_000

_left_over: list[tuple[SparkSession, str]] = []


_shipped: set[str] = set()


#: Bytes that Python workers get at once, unless the session says otherwise; Spark's own 256 MB times two copies is most of a small executor.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, and batches of bounded bytes."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    top = Path(__file__).resolve().parent.parent
    to = Path(tempfile.mkdtemp(prefix="brindle-")) / "brindle_code.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(to))


def scratch_root(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; where that is unset, a folder of this machine in local mode, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.brindle.scratch", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.brindle.scratch", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; release() deletes what is there."""
    path = f"{scratch_root(spark)}/brindle/{tag}-{uuid.uuid4().hex}"
    _left_over.append((spark, path))
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a short lineage that outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._brindle_path = path
    return out


def discard(*made: DataFrame) -> None:
    """Delete what materialise() wrote for these frames, and let Spark drop shuffles that nothing refers to any more."""
    for df in made:
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._brindle_path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _left_over.remove((df.sparkSession, df._brindle_path))
    if made:
        sweep(made[0].sparkSession)


def paths(spark: SparkSession) -> set[str]:
    """The scratch paths of this session that still stand."""
    return {p for own, p in _left_over if own is spark}


def delete_paths(spark: SparkSession, gone: list[str]) -> None:
    for path in set(gone) & paths(spark):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _left_over.remove((spark, path))
    sweep(spark)


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished plans now; it finds them by garbage collection."""
    gc.collect()
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all scratch tables of this process; call it when their readers are done."""
    for own, path in list(_left_over):
        if own is spark:
            _left_over.remove((own, path))
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _left_over}.values():
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone; the files are only scratch
            return


atexit.register(_at_exit)


def _hot(weights: DataFrame, key: Column, weight: str) -> dict[int, int]:
    """For each key hash with 1/HOT_KEYS of the weight or more (so at most HOT_KEYS of them) the number of parts it is dealt into."""
    total = weights.agg(F.sum(weight)).first()[0] or 0
    rows = weights.groupBy(key.alias("k")).agg(F.sum(weight).alias("w")).where(F.col("w") * HOT_KEYS >= total).collect() if total >= HOT_ROWS else []
    return {r["k"]: -(-r["w"] * HOT_KEYS // total) for r in rows}


def hot_safe_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], weight: str, spread: Column, take: list[str], weights: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Left join (or inner) with a right side of one row per key, whatever share of the left rows a key holds.

    weights[weight] (right's own column by default) is the number of left rows with the key.
    The left rows of a hot key are dealt by `spread` into parts of at most 1/HOT_KEYS of all
    rows, and its right row is repeated for each part (so 2 * HOT_KEYS times at most); all goes
    through one shuffle join. `take` names the right columns to add (null where nothing matches).
    """
    kinds = [left.schema[c].dataType for c, _ in on]
    hashed = lambda df, side: F.xxhash64(*[df[c[side]].cast(k) for c, k in zip(on, kinds, strict=True)])
    weights = right if weights is None else weights
    hot = _hot(weights, hashed(weights, 1), weight)
    r = right.select(*[right[k].cast(t).alias(f"__k{i}") for i, ((_, k), t) in enumerate(zip(on, kinds, strict=True))], F.struct(*take).alias("__v"), hashed(right, 1).alias("__h"))
    m = None
    if hot:
        keys = ",".join(f"{k}L" if k > -(1 << 63) else f"{k + 1}L - 1L" for k in hot)
        parts = F.expr(f"element_at(map_from_arrays(array({keys}), array({','.join(map(str, hot.values()))})), __h)")
        warm = F.col("__h").isin(list(hot))
        r = r.withColumn("__s", F.explode(F.when(warm, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0)))))
        left_s = left.withColumn("__h", hashed(left, 0)).withColumn("__t", F.when(warm, F.pmod(F.hash(spread), parts)).otherwise(F.lit(0))).drop("__h")
        m = left_s["__t"] == r["__s"]
    else:
        left_s = left
    for i, (c, _) in enumerate(on):
        e = left_s[c].eqNullSafe(r[f"__k{i}"])
        m = e if m is None else m & e
    return left_s.join(r.drop("__h"), m, how).select(*[left_s[c] for c in left.columns], *[F.col("__v")[t].alias(t) for t in take])


def fits(df: DataFrame) -> bool:
    """Whether df is small enough to be broadcast: at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes."""
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    r = df.limit(BROADCAST_ROWS + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return r["n"] <= BROADCAST_ROWS and r["b"] <= BROADCAST_BYTES


def lookup_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], weight: str, spread: Column, take: list[str]) -> DataFrame:
    """As hot_safe_join, but by one broadcast where right is small enough. right is read several times, so it should be a written table."""
    if not fits(right):
        return hot_safe_join(left, right, on, weight, spread, take)
    r = right.select(*[F.col(k).alias(f"__k{i}") for i, (_, k) in enumerate(on)], F.struct(*take).alias("__v"))
    m = None
    for i, (c, _) in enumerate(on):
        e = left[c].eqNullSafe(r[f"__k{i}"])
        m = e if m is None else m & e
    return left.join(F.broadcast(r), m, "left").select(*left.columns, *[F.col("__v")[t].alias(t) for t in take])


def slices(batch: pa.RecordBatch, text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts have about `size` bytes together, or one row; the text column as bytes."""
    at = batch.schema.get_field_index(text)
    batch = batch.set_column(at, text, batch.column(at).cast(pa.binary()))
    lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).cumsum()
    first = 0
    while first < batch.num_rows:
        base = lengths[first - 1] if first else 0
        last = max(first + 1, int(lengths.searchsorted(base + size, side="right")))
        yield batch.slice(first, last - first)
        first = last


def let(value: Column, f) -> Column:
    """f(value) with value evaluated once, also where f uses it in lambdas."""
    return F.transform(F.array(value), f)[0]


def one_line(text: Column) -> Column:
    """The text with each run of white space as one space, and none at its ends."""
    flat = F.translate(text, "\t\n\x0b\f\r", "     ")
    return F.trim(F.regexp_replace(flat, " {2,}", " "))


#: Punctuation at a word's start or end; the search looks only at punctuation characters.
OUTER = r"[\p{P}\p{S}]+(?:(?!\S)|(?<=(?:^|\s)[\p{P}\p{S}]{1,8}))"
