"""Access to the Parquet tables of one scale-factor folder."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


_schemas: dict[str, tuple[int, StructType]] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; the scan is lazy, so filters and column choice reach Parquet.

    The schema is read from the files once per path, until the file or folder changes: later plans
    need no job for it.
    """
    path = f"{sf_dir}/{name}.parquet"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    changed = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).getModificationTime()
    known = _schemas.get(path)
    if known and known[0] == changed:
        return spark.read.schema(known[1]).parquet(path)
    df = spark.read.parquet(path)
    _schemas[path] = changed, df.schema
    return df


def view(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The name of a temp view over one table; it is this package's own, so it replaces no view of the user's."""
    own = f"brindle_{zlib.crc32(sf_dir.encode()):08x}_{name}"
    load(spark, sf_dir, name).createOrReplaceTempView(own)
    return own
