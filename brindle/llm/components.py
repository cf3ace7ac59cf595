"""Connected components of an edge table, without bringing edges or nodes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import lookup_join, materialise


def components(edges: DataFrame, jumps: int = 1, tag: str = "cc") -> DataFrame:
    """(node, comp) for every node of edges (a, b longs); comp is one node of its component.

    Each round points every node at its smallest neighbour, follows the pointers `jumps` times
    (so paths shrink by a factor of 2**jumps), and contracts the edges, until none is left.
    Hot nodes are pre-aggregated and joined by hot_safe_join. Empty edges: an empty result.
    """
    e = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), tag)
    label = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct().withColumn("comp", F.col("node"))
    label = materialise(label, tag)
    while not e.isEmpty():
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        p = materialise(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p"), F.count("*").alias("w")), tag)
        for _ in range(jumps):
            w = p.groupBy(F.col("p").alias("p0")).agg(F.count("*").alias("w2"))
            up = p.select(F.col("u").alias("p0"), F.col("p").alias("p2")).join(w, "p0")
            p = materialise(lookup_join(p, up, [("p", "p0")], "w2", F.col("u"), ["p2"]).select("u", F.coalesce("p2", "p").alias("p"), "w"), tag)
        e = lookup_join(e, p.withColumnRenamed("p", "pa"), [("a", "u")], "w", F.col("b"), ["pa"])
        e = lookup_join(e, p.withColumnRenamed("p", "pb"), [("b", "u")], "w", F.col("a"), ["pb"])
        e = materialise(e.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a < b").distinct(), tag)
        n = label.groupBy(F.col("comp").alias("c0")).agg(F.count("*").alias("w3"))
        up = p.select(F.col("u").alias("c0"), F.col("p").alias("c2")).join(n, "c0")
        label = materialise(lookup_join(label, up, [("comp", "c0")], "w3", F.col("node"), ["c2"]).select("node", F.coalesce("c2", "comp").alias("comp")), tag)
    return label
