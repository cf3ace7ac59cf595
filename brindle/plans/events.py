"""Event-time windows, sessions, streams and user-defined functions."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from brindle.plans import both, run_sql
from brindle.plans.storage import _path
from brindle.registry import query
from brindle.streaming import run_in_memory, run_once, stream_files
from brindle.tables import load


@query("tumbling_daily", "select cast(time_bucket(interval '1 day', ts, timestamp '1970-01-01') as timestamp) as day, event_type, count(*) as n from events group by all", "2.O")
def tumbling_daily(spark, sf):
    return load(spark, sf, "events").groupBy(F.window("ts", "1 day").start.alias("day"), "event_type").agg(F.count("*").alias("n")).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("sliding_hours", "select s as start, count(*) as n from (select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') - h * interval '6 hours' as s from events, (values (0), (1)) t(h)) u group by s", "2.O")
def sliding_hours(spark, sf):
    return load(spark, sf, "events").groupBy(F.window("ts", "12 hours", "6 hours").start.cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"))


@query("session_2h", "select user_id, min(ts) as start, count(*) as n from (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as sid from (select *, case when lag(ts) over (partition by user_id order by ts, event_id) >= ts - interval 2 hours then 0 else 1 end as fresh from events) a) b group by user_id, sid", "2.O")
def session_2h(spark, sf):
    return load(spark, sf, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


both("event_type_rates", "select event_type, round(avg(value), 8) as v, count(distinct user_id) as users from events group by event_type", "D1 D4")


def _stream(spark, sf):
    p = _path(spark)
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(p)
    return stream_files(spark, p, e.schema)


@query("stream_counts", "select event_type, count(*) as n from events group by event_type", "2.O")
def stream_counts(spark, sf):
    return run_in_memory(_stream(spark, sf).groupBy("event_type").agg(F.count("*").alias("n")), "complete")


@query("stream_windows", "select time_bucket(interval '1 day', ts, timestamp '1970-01-01') as day, count(*) as n from events group by 1", "2.O")
def stream_windows(spark, sf):
    d = _stream(spark, sf).withWatermark("ts", "40 days").groupBy(F.window("ts", "1 day").start.alias("day")).agg(F.count("*").alias("n"))
    return run_in_memory(d, "complete").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("stream_dedup", "select distinct user_id, event_type from events", "2.O")
def stream_dedup(spark, sf):
    out, at = _path(spark), _path(spark)
    run_once(_stream(spark, sf).withWatermark("ts", "40 days").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), out, at)
    return spark.read.parquet(out)


@query("stream_late_rows", "select user_id, count(*) as n from events where user_id <> 1 group by user_id", "2.O")
def stream_late_rows(spark, sf):
    """Files in order of time, then one file of rows older than the watermark (those of one user): they are dropped."""
    p = _path(spark)
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.where("user_id <> 1").coalesce(1).write.parquet(p)
    s = stream_files(spark, p, e.schema).withWatermark("ts", "1 hour").groupBy("user_id", F.window("ts", "100 days")).agg(F.count("*").alias("n"))
    out, at = _path(spark), _path(spark)
    late = e.where("user_id = 1").withColumn("ts", F.col("ts") - F.expr("interval 400 days"))
    run_once(s, out, at)  # the watermark is kept in the checkpoint
    late.coalesce(1).write.mode("append").parquet(p)
    run_once(s, out, at)
    e.limit(1).withColumns({"ts": F.expr("timestamp '2030-01-01'"), "user_id": F.lit(-1).cast("long")}).coalesce(1).write.mode("append").parquet(p)
    run_once(s, out, at)  # a row far ahead closes all windows
    return spark.read.parquet(out).where("user_id >= 0").groupBy("user_id").agg(F.sum("n").alias("n"))


@query("stream_dedup_watermark", "select distinct event_id from events", "2.O")
def stream_dedup_watermark(spark, sf):
    """Rows that come twice within the watermark's delay are one; state older than it is dropped."""
    p = _path(spark)
    e = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e).repartition(2).write.parquet(p)
    out, at = _path(spark), _path(spark)
    run_once(stream_files(spark, p, e.schema).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), out, at)
    return spark.read.parquet(out)


@query("stream_stream_join", "select a.event_id as view_id, b.event_id as buy_id from events a join events b on a.user_id = b.user_id and a.event_type = 'view' and b.event_type = 'purchase' and b.ts between a.ts and a.ts + interval 2 hours", "2.O")
def stream_stream_join(spark, sf):
    """Both sides have a watermark and the condition a time range, so state is bounded."""
    e = _stream(spark, sf)
    a = e.where("event_type = 'view'").selectExpr("event_id as view_id", "user_id as u1", "ts as t1").withWatermark("t1", "40 days")
    b = e.where("event_type = 'purchase'").selectExpr("event_id as buy_id", "user_id as u2", "ts as t2").withWatermark("t2", "40 days")
    out, at = _path(spark), _path(spark)
    run_once(a.join(b, F.expr("u1 = u2 and t2 between t1 and t1 + interval 2 hours")).select("view_id", "buy_id"), out, at)
    return spark.read.parquet(out)


@query("stream_state", "select user_id, count(*) as n, sum(value) as total from events group by user_id", "2.O")
def stream_state(spark, sf):
    """Arbitrary state by key: a running count and sum, kept from batch to batch."""

    def update(key, frames, state):
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f.value.sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    d = _stream(spark, sf).select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")
    name = f"s_{uuid.uuid4().hex[:12]}"
    d.writeStream.format("memory").queryName(name).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    last = spark.table(name).groupBy("user_id").agg(F.max_by(F.struct("n", "total"), "n").alias("s"))
    return last.select("user_id", "s.n", "s.total")


@query("stream_foreach_batch", "select event_type, count(*) as n from events group by event_type", "2.O")
def stream_foreach_batch(spark, sf):
    """Each micro-batch goes to an ordinary batch writer, by its number, so a repeated batch replaces itself."""
    out = _path(spark)

    def put(batch, number):
        batch.groupBy("event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _stream(spark, sf).writeStream.foreachBatch(put).option("checkpointLocation", _path(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"))


@query("stream_rate", "select true as grows", "2.O")
def stream_rate(spark, sf):
    """The rate source: numbered rows at a given speed, here in micro-batches of a fixed number of rows."""
    d = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 10).option("numPartitions", 2).load()
    name = f"s_{uuid.uuid4().hex[:12]}"
    q = d.writeStream.format("memory").queryName(name).outputMode("append").start()
    try:
        for _ in range(100):
            q.awaitTermination(0.2)
            if spark.table(name).count() >= 10:
                break
    finally:
        q.stop()
    return spark.table(name).agg((F.count("*") >= 10).alias("grows"))


@query("stream_static_join", "select n_name, count(*) as n from events join nation on user_id % 25 = n_nationkey group by n_name", "2.O")
def stream_static_join(spark, sf):
    n = load(spark, sf, "nation")
    d = _stream(spark, sf).join(n, F.expr("user_id % 25 = n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    return run_in_memory(d, "complete")


@query("pandas_udf_scalar", "select p_partkey, p_retailprice * 1.1 as up from part", "2.O")
def pandas_udf_scalar(spark, sf):
    @F.pandas_udf("double")
    def up(x: pd.Series) -> pd.Series:
        return x * 1.1

    return load(spark, sf, "part").select("p_partkey", up("p_retailprice").alias("up"))


# a Python group is one frame in one task, so the keys here are of bounded groups
@query("pandas_grouped_agg", "select o_custkey, max(o_totalprice) - min(o_totalprice) as spread from orders group by o_custkey", "2.O")
def pandas_grouped_agg(spark, sf):
    @F.pandas_udf("double")
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return load(spark, sf, "orders").groupBy("o_custkey").agg(spread("o_totalprice").alias("spread"))


@query("apply_in_pandas", "select o_custkey, o_orderkey, round(o_totalprice - avg(o_totalprice) over (partition by o_custkey), 6) as off from orders", "2.O")
def apply_in_pandas(spark, sf):
    def centre(g: pd.DataFrame) -> pd.DataFrame:
        return g.assign(off=(g.o_totalprice - g.o_totalprice.mean()).round(6))[["o_custkey", "o_orderkey", "off"]]

    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice").groupBy("o_custkey").applyInPandas(centre, "o_custkey long, o_orderkey long, off double")


@query("cogroup_in_pandas", "select c_custkey, count(o_orderkey) as n, coalesce(max(o_totalprice), 0) as top from customer left join orders on o_custkey = c_custkey group by c_custkey", "2.O")
def cogroup_in_pandas(spark, sf):
    def meet(c: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c_custkey": c.c_custkey, "n": len(o), "top": o.o_totalprice.max() if len(o) else 0.0})

    c = load(spark, sf, "customer").select("c_custkey").groupBy("c_custkey")
    return c.cogroup(load(spark, sf, "orders").select("o_custkey", "o_totalprice").groupBy("o_custkey")).applyInPandas(meet, "c_custkey long, n long, top double")


@query("python_udf_row", "select n_nationkey, n_name || '!' as u from nation", "2.O")
def python_udf_row(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.udf(lambda x: x + "!", "string")("n_name").alias("u"))


@query("arrow_udf_batch", "select p_partkey, p_size * 2 as d from part", "2.O")
def arrow_udf_batch(spark, sf):
    @F.udf("int", useArrow=True)
    def twice(x: int) -> int:
        return 2 * x

    return load(spark, sf, "part").select("p_partkey", twice("p_size").alias("d"))


@query("map_in_pandas", "select s_suppkey, upper(s_name) as u from supplier", "2.O")
def map_in_pandas(spark, sf):
    def up(batches):
        for b in batches:
            yield b.assign(u=b.s_name.str.upper())[["s_suppkey", "u"]]

    return load(spark, sf, "supplier").select("s_suppkey", "s_name").mapInPandas(up, "s_suppkey long, u string")


@query("udtf_split", "select n_nationkey, unnest(string_split(n_name, '_')) as part from nation", "2.O")
def udtf_split(spark, sf):
    @F.udtf(returnType="part: string")
    class Split:
        def eval(self, text: str):
            for p in text.split("_"):
                yield (p,)

    spark.udtf.register("brindle_split", Split)
    return run_sql(spark, sf, "select n_nationkey, part from nation, lateral brindle_split(n_name)")
