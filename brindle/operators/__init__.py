"""Operators that Spark lacks, composed of DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_on: str, right_on: str, take: list[str], tie: list[str] | None = None) -> DataFrame:
    """For each left row the latest right row of its key with right_on <= left_on (null if there is none).

    Both sides are stacked and the last right row is carried forward within the key: one shuffle,
    no pairs. Right rows at the same time count as earlier than the left row; among themselves
    they are ordered by `tie`. A null key or time matches nothing, as in any join; such left rows
    are groups of their own, so however many there are, no task gathers them.
    """
    tie = tie or []
    right = right.where(F.col(key).isNotNull() & F.col(right_on).isNotNull())
    alone = F.when(F.col(key).isNull() | F.col(left_on).isNull(), F.monotonically_increasing_id())
    payload = F.struct(F.col(right_on).alias("__ro"), *take)
    r = right.select(F.col(key).alias("__k"), F.col(right_on).alias("__t"), F.struct(*tie).alias("__tie") if tie else F.lit(0).alias("__tie"), payload.alias("__r"), F.lit(0).alias("__side"), F.lit(None).cast("long").alias("__alone"))
    lrow = F.struct(*left.columns)
    none = F.lit(None)
    a = r.withColumn("__l", none.cast(left.select(lrow.alias("x")).schema["x"].dataType))
    b = left.select(F.col(key).alias("__k"), F.col(left_on).alias("__t"), none.cast(r.schema["__tie"].dataType).alias("__tie"), none.cast(r.schema["__r"].dataType).alias("__r"), F.lit(1).alias("__side"), alone.alias("__alone"), lrow.alias("__l"))
    w = Window.partitionBy("__k", "__alone").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("__r", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__l.*", *[F.col("__r")[c].alias(c) for c in take])


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: float) -> DataFrame:
    """points.at between spans.start and spans.end (both inclusive), by an equi-join on bins of `width`.

    A span is copied once per bin that it touches, so choose the width near the usual length.
    """
    p = points.withColumn("__bin", F.floor(F.col(at) / width))
    s = spans.withColumn("__bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, "__bin").where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("__bin")


MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def groups_window(df: DataFrame, partition: list[str], order: str, before: int, after: int, aggregates: dict[str, tuple[str, str]]) -> DataFrame:
    """GROUPS frames, which Spark lacks. aggregates: name -> (sum, count, min or max; column).

    Rows that tie are one group and are aggregated first, so the window runs over one row for each
    group, however few partitions there are; the frames' results are then joined to the rows.
    """
    keys = [*partition, order]
    per = df.groupBy(*keys).agg(*[getattr(F, kind)(c).alias(name) for name, (kind, c) in aggregates.items()])
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(-before, after)
    framed = per.select(*[F.col(k).alias(f"__{k}") for k in keys], *[MERGE[kind](name).over(w).alias(name) for name, (kind, _) in aggregates.items()])
    same = None
    for k in keys:
        e = df[k].eqNullSafe(framed[f"__{k}"])
        same = e if same is None else same & e
    return df.join(framed, same, "left").select(*[df[c] for c in df.columns], *aggregates)


def exact_freq_items(df: DataFrame, col: str, support: float) -> DataFrame:
    """item, n for the values that make up at least `support` of all rows."""
    n = df.groupBy(F.col(col).alias("item")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__all"))
    return n.crossJoin(F.broadcast(total)).where(F.col("n") >= support * F.col("__all")).drop("__all")  # one row


def salted_sum(df: DataFrame, keys: list[str], value: str, salts: int = 32) -> DataFrame:
    """A sum by keys in two steps, for keys that hold a large share of the rows and functions without partial aggregation."""
    part = df.withColumn("__s", F.pmod(F.monotonically_increasing_id(), F.lit(salts))).groupBy(*keys, "__s").agg(F.sum(value).alias("__v"))
    return part.groupBy(*keys).agg(F.sum("__v").alias(f"sum_{value}"))
