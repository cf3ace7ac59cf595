"""Readers: thin, with the options that matter at scale (explicit schema, partition discovery)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_parquet(spark: SparkSession, *paths: str, recursive: bool = False, base: str | None = None) -> DataFrame:
    """Files, folders or globs; `base` keeps partition columns when paths name single partitions."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    return (r.option("basePath", base) if base else r).parquet(*paths)


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV by a given schema (no inference pass). Options: header, sep, quote, escape, nullValue, compression."""
    return spark.read.schema(schema).options(**options).csv(path)


def read_json(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(**options).json(path)


def read_lakehouse(spark: SparkSession, format: str, path: str, version: str | None = None, timestamp: str | None = None) -> DataFrame:
    """Delta or Iceberg tables with time travel; needs the connector's jar on the class path."""
    r = spark.read.format(format)
    names = {"delta": ("versionAsOf", "timestampAsOf"), "iceberg": ("snapshot-id", "as-of-timestamp")}[format]
    for k, v in zip(names, (version, timestamp), strict=True):
        r = r.option(k, v) if v else r
    return r.load(path)


def write(df: DataFrame, path: str, format: str = "parquet", mode: str = "error", partition_by: list[str] | None = None, **options) -> None:
    """Parquet, CSV, JSON or ORC with the save modes error, ignore, overwrite, append."""
    w = df.write.mode(mode).format(format).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
