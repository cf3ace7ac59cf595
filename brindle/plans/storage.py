"""Sources, sinks, tables and the catalog. Files go to a scratch folder under the session's warehouse."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from brindle import sources
from brindle.registry import query
from brindle.tables import load, view


_made: list[tuple] = []


def _path(spark) -> str:
    """A new folder under the warehouse, deleted when Python ends: results are read lazily, so not before."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def _clear() -> None:
    for spark, path in _made:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; the files are only scratch
            return


atexit.register(_clear)


N = "select n_nationkey, n_name, n_regionkey from nation"


@query("parquet_roundtrip", N, "A13")
def parquet_roundtrip(spark, sf):
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, compression="zstd")
    return sources.read_parquet(spark, p)


@query("parquet_partitioned", "select n_name, n_regionkey from nation where n_regionkey in (1, 3)", "A2 A13")
def parquet_partitioned(spark, sf):
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, partition_by=["n_regionkey"])
    return sources.read_parquet(spark, f"{p}/n_regionkey=1", f"{p}/n_regionkey=3", base=p).select("n_name", "n_regionkey")


@query("csv_roundtrip", N, "A13")
def csv_roundtrip(spark, sf):
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, "csv", header="true", sep="|", compression="gzip")
    return sources.read_csv(spark, p, "n_nationkey int, n_name string, n_regionkey int", header="true", sep="|")


@query("json_roundtrip", N, "A13")
def json_roundtrip(spark, sf):
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, "json")
    return sources.read_json(spark, p, "n_nationkey int, n_name string, n_regionkey int")


@query("orc_roundtrip", N, "A13")
def orc_roundtrip(spark, sf):
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, "orc")
    return spark.read.orc(p)


@query("append_overwrite", "select r_regionkey, count(*) * 2 as n from region group by r_regionkey", "A14")
def append_overwrite(spark, sf):
    p, r = _path(spark), load(spark, sf, "region")
    sources.write(r.limit(1), p)
    sources.write(r, p, mode="overwrite")
    sources.write(r, p, mode="append")
    sources.write(r, p, mode="ignore")
    return spark.read.parquet(p).groupBy("r_regionkey").agg(F.count("*").alias("n"))


def _name() -> str:
    return f"brindle_{uuid.uuid4().hex[:12]}"


@query("external_table", "select n_regionkey, count(*) as n from nation group by n_regionkey", "A5 A8 E25 E27")
def external_table(spark, sf):
    p, t = _path(spark), _name()
    sources.write(load(spark, sf, "nation"), p)
    spark.catalog.createTable(t, path=p, source="parquet")
    return spark.table(t).groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query("external_csv_table", N, "A6 E25")
def external_csv_table(spark, sf):
    p, t, n = _path(spark), _name(), load(spark, sf, "nation")
    sources.write(n, p, "csv", header="true", sep=";")
    spark.catalog.createTable(t, path=p, source="csv", schema=n.schema, header="true", sep=";")
    return spark.table(t)


@query("external_json_table", N, "A7 E25")
def external_json_table(spark, sf):
    p, t, n = _path(spark), _name(), load(spark, sf, "nation")
    sources.write(n, p, "json")
    spark.catalog.createTable(t, path=p, source="json", schema=n.schema)
    return spark.table(t)


@query("parquet_codecs", "select c as codec, count(*) as n from nation, (values ('snappy'), ('gzip'), ('zstd'), ('lz4raw'), ('none')) t(c) group by c", "A15")
def parquet_codecs(spark, sf):
    out = None
    for codec in ("snappy", "gzip", "zstd", "lz4raw", "none"):
        p = _path(spark)
        sources.write(load(spark, sf, "nation"), p, compression="lz4_raw" if codec == "lz4raw" else codec)
        part = sources.read_parquet(spark, p).agg(F.lit(codec).alias("codec"), F.count("*").alias("n"))
        out = part if out is None else out.union(part)
    return out


@query("parquet_glob_recursive", "select n_regionkey as g, n_nationkey, n_name from nation where n_regionkey in (1, 2) union all select -1, n_nationkey, n_name from nation", "A2")
def parquet_glob_recursive(spark, sf):
    """A glob over two of the folders, and all folders without partition columns."""
    p, n = _path(spark), load(spark, sf, "nation")
    sources.write(n.withColumn("g", F.col("n_regionkey")), p, partition_by=["g"])
    some = sources.read_parquet(spark, f"{p}/g=[12]", base=p).select(F.col("g").cast("int").alias("g"), "n_nationkey", "n_name")
    every = sources.read_parquet(spark, p, recursive=True).select(F.lit(-1).alias("g"), "n_nationkey", "n_name")
    return some.union(every)


@query("parquet_filtered", "select n_nationkey, n_name from nation where n_regionkey = 2 and n_nationkey > 5", "A2")
def parquet_filtered(spark, sf):
    """The partition filter skips folders, the other one reaches the scan; files by a name pattern."""
    p = _path(spark)
    sources.write(load(spark, sf, "nation"), p, partition_by=["n_regionkey"])
    return spark.read.option("pathGlobFilter", "*.parquet").parquet(p).where("n_regionkey = 2 and n_nationkey > 5").select("n_nationkey", "n_name")


@query("ddl_dml", "select r_regionkey as k, r_name as s from region where r_regionkey < 3 union all select 9, 'nine'", "E27 E28 E30")
def ddl_dml(spark, sf):
    t, r = _name(), view(spark, sf, "region")
    spark.sql(f"create table {t} (k int, s string) using parquet")
    spark.sql(f"insert into {t} values (0, 'gone')")
    spark.sql(f"insert overwrite {t} select r_regionkey, r_name from {r} where r_regionkey < 3")
    spark.sql(f"insert into {t} values (9, 'nine')")
    return spark.table(t)


@query("ctas_alter_truncate", "select r_regionkey, r_name, cast(null as int) as extra from region", "E27 E28")
def ctas_alter_truncate(spark, sf):
    t, r = _name(), view(spark, sf, "region")
    spark.sql(f"create table {t} using parquet as select * from {r}")
    spark.sql(f"alter table {t} add columns (extra int)")
    spark.sql(f"create table {t}_b using parquet as select * from {r}")
    spark.sql(f"truncate table {t}_b")
    spark.sql(f"drop table {t}_b")
    return spark.table(t)


@query("views", "select n_name, true as gone from nation where n_regionkey = 2", "E23 E29")
def views(spark, sf):
    v, n = _name(), view(spark, sf, "nation")
    spark.sql(f"create or replace temp view {v} as select n_name from {n} where n_regionkey = 2")
    out = spark.table(v)
    spark.sql(f"create temp view {v}_2 as select 1 as one")
    spark.sql(f"drop view {v}_2")
    return out.withColumn("gone", F.lit(not spark.catalog.tableExists(f"{v}_2")))


def _facts(spark, rows):
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "k string, v string")


def _values(rows) -> str:
    return "select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") t(k, v)"


READS = [("table", True), ("columns", 3), ("databases", True), ("database", "default"), ("databaseExists", True), ("function", True), ("functions", True), ("getFunction", "upper"), ("catalog", "spark_catalog"), ("catalogs", True), ("tables", True), ("getTable", True), ("getDatabase", "default"), ("tz", "UTC"), ("getDefault", "7")]


@query("catalog_reads", _values(READS), "E24 E32")
def catalog_reads(spark, sf):
    v, c = view(spark, sf, "nation"), spark.catalog
    got = [
        c.tableExists(v), len(c.listColumns(v)), "default" in [d.name for d in c.listDatabases()], c.currentDatabase(), c.databaseExists("default"), c.functionExists("upper"),
        "upper" in [f.name for f in c.listFunctions(pattern="upper")], c.getFunction("upper").name, c.currentCatalog(), "spark_catalog" in [x.name for x in c.listCatalogs()], v in [t.name for t in c.listTables()], c.getTable(v).isTemporary,
        c.getDatabase("default").name, spark.conf.get("spark.sql.session.timeZone"), spark.conf.get("spark.brindle.none", "7"),
    ]
    return _facts(spark, zip([k for k, _ in READS], got, strict=True))


WRITES = [("created", True), ("database", True), ("dropped", True), ("global", True), ("globalDropped", True), ("catalog", "spark_catalog"), ("partitions", 5)]


@query("catalog_writes", _values(WRITES), "E25")
def catalog_writes(spark, sf):
    c, db, v = spark.catalog, _name(), _name()
    before = c.currentDatabase()
    spark.sql(f"create database {db}")
    try:
        c.setCurrentDatabase(db)
        inside = c.currentDatabase() == db
    finally:
        c.setCurrentDatabase(before)
    made = c.databaseExists(db)
    load(spark, sf, "region").createOrReplaceTempView(v)
    dropped = c.dropTempView(v)
    load(spark, sf, "region").createGlobalTempView(v)
    seen = spark.table(f"global_temp.{v}").count() > 0
    gone = c.dropGlobalTempView(v)
    c.setCurrentCatalog("spark_catalog")
    p, t = _path(spark), _name()
    sources.write(load(spark, sf, "region").withColumn("g", F.col("r_regionkey")), p, partition_by=["g"])
    spark.sql(f"create table {t} (r_regionkey int, r_name string, g int) using parquet partitioned by (g) location '{p}'")
    c.recoverPartitions(t)
    got = [made, inside, dropped, seen, gone, c.currentCatalog(), spark.sql(f"show partitions {t}").count()]
    spark.sql(f"drop database {db} cascade")
    return _facts(spark, zip([k for k, _ in WRITES], got, strict=True))


CACHED = [("before", False), ("cached", True), ("uncached", False), ("cleared", False), ("refreshed", 2), ("refreshedByPath", 3)]


@query("cache_calls", _values(CACHED), "E26")
def cache_calls(spark, sf):
    v, c = _name(), spark.catalog
    load(spark, sf, "nation").createOrReplaceTempView(v)
    got = [c.isCached(v)]
    c.cacheTable(v)
    got.append(c.isCached(v))
    c.uncacheTable(v)
    got.append(c.isCached(v))
    # clearCache drops what others cached as well, so a session of its own is asked
    own = spark.newSession()
    own.range(3).createOrReplaceTempView(v)
    got.append(own.catalog.isCached(v))
    p, t = _path(spark), _name()
    sources.write(spark.range(1), p)
    c.createTable(t, path=p, source="parquet")
    sources.write(spark.range(1), p, mode="append")
    c.refreshTable(t)
    got.append(spark.table(t).count())
    w = _name()
    spark.read.parquet(p).createOrReplaceTempView(w)
    c.cacheTable(w)
    spark.table(w).count()
    sources.write(spark.range(1), p, mode="append")
    c.refreshByPath(p)
    got.append(spark.table(w).count())
    c.uncacheTable(w)
    return _facts(spark, zip([k for k, _ in CACHED], got, strict=True))


MODES = ["simple", "extended", "codegen", "cost", "formatted"]


@query("explain_modes", _values([(m, True) for m in MODES]), "E31")
def explain_modes(spark, sf):
    v = view(spark, sf, "nation")
    words = {"simple": "Physical Plan", "extended": "Analyzed Logical Plan", "codegen": "WholeStageCodegen", "cost": "Optimized Logical Plan", "formatted": "Physical Plan"}
    text = {m: spark.sql(f"explain {'' if m == 'simple' else m} select n_name from {v} where n_regionkey = 2").first()[0] for m in MODES}
    return _facts(spark, [(m, words[m] in text[m]) for m in MODES])


@query("schema_and_local", "select 'n_nationkey' as name, 'int' as type, false as local union all select 'n_name', 'string', false union all select 'col1', 'int', true", "E33")
def schema_and_local(spark, sf):
    n, one = load(spark, sf, "nation").select("n_nationkey", "n_name"), spark.sql("values (1)")
    rows = [(f.name, f.dataType.simpleString(), d.isLocal()) for d in (n, one) for f in d.schema]
    return spark.createDataFrame(rows, "name string, type string, local boolean")
