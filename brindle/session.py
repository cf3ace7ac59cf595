"""Session factory: the settings every brindle query assumes."""

from __future__ import annotations

import os

from pyspark import SparkConf
from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; UTC keeps
#: timestamps comparable with other engines; NTZ is what Parquet holds here.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.ui.enabled": "false",
}


CLUSTER_PARTITIONS = 8000


def get_session(master: str | None = None, app: str = "brindle", **conf: str) -> SparkSession:
    """Get or make a session with DEFAULTS; keyword names use `__` for dots.

    The master is the one asked for, else spark-submit's, else this machine. On a cluster shuffles
    start with CLUSTER_PARTITIONS parts, which adaptive execution merges to a useful size; on one
    machine there are as many as cores.
    """
    given = master or SparkConf().get("spark.master", None)
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 8)
    b = SparkSession.builder.appName(app)
    if master or not given:
        b = b.master(given or f"local[{cpus}]")
    local = (given or "local").startswith("local")
    parts = {"spark.sql.shuffle.partitions": cpus} if local else {"spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(CLUSTER_PARTITIONS)}
    for k, v in (DEFAULTS | parts).items():
        b = b.config(k, v)
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
