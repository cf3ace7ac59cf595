"""Joins of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import asof_join, range_join
from brindle.plans import both
from brindle.registry import query
from brindle.tables import load


def _cn(spark, sf):
    return load(spark, sf, "customer"), load(spark, sf, "nation").where("n_nationkey < 20")


CN = "select c_custkey, n_name from customer {} join (select * from nation where n_nationkey < 20) n on c_nationkey = n_nationkey"


def _join(name, how, sql, tags):
    @query(name, sql, tags)
    def run(spark, sf):
        c, n = _cn(spark, sf)
        return c.join(n, c.c_nationkey == n.n_nationkey, how).select("c_custkey", "n_name")


_join("inner_join", "inner", CN.format("inner"), "C1")
_join("left_join", "left", CN.format("left"), "C2")
_join("right_join", "right", CN.format("right"), "C2")
_join("full_join", "full", CN.format("full"), "C2")


@query("semi_join", "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)", "C3")
def semi_join(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("anti_join", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)", "C3")
def anti_join(spark, sf):
    c, o = load(spark, sf, "customer"), load(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query("cross_join", "select r_name, n_name from region cross join nation", "C4")
def cross_join(spark, sf):
    return load(spark, sf, "region").crossJoin(load(spark, sf, "nation")).select("r_name", "n_name")


@query("using_join", "select c_nationkey, c_custkey, s_suppkey from customer join (select s_nationkey as c_nationkey, s_suppkey from supplier) s using (c_nationkey)", "C5")
def using_join(spark, sf):
    s = load(spark, sf, "supplier").selectExpr("s_nationkey as c_nationkey", "s_suppkey")
    return load(spark, sf, "customer").join(s, ["c_nationkey"]).select("c_nationkey", "c_custkey", "s_suppkey")


@query("using_full_join", "select k, a, b from (select n_nationkey as k, n_name as a from nation where n_nationkey < 15) x full join (select n_nationkey as k, n_regionkey as b from nation where n_nationkey > 10) y using (k)", "C5")
def using_full_join(spark, sf):
    n = load(spark, sf, "nation")
    x, y = n.where("n_nationkey < 15").selectExpr("n_nationkey as k", "n_name as a"), n.where("n_nationkey > 10").selectExpr("n_nationkey as k", "n_regionkey as b")
    return x.join(y, ["k"], "full").select("k", "a", "b")


both("natural_join", "select k, a, b from (select r_regionkey as k, r_name as a from region) x natural join (select n_regionkey as k, n_name as b from nation) y", "C6")
both("theta_join", "select a.n_name as x, b.n_name as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey", "C7")


@query("self_join", "select a.s_suppkey as s1, b.s_suppkey as s2 from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey", "C8")
def self_join(spark, sf):
    a, b = load(spark, sf, "supplier").alias("a"), load(spark, sf, "supplier").alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("s1"), F.col("b.s_suppkey").alias("s2"))


@query("null_safe_join", "select a.c_custkey as x, count(*) as n from (select c_custkey, nullif(c_nationkey, 3) as k from customer) a join (select s_suppkey, nullif(s_nationkey, 3) as k from supplier) b on a.k is not distinct from b.k group by a.c_custkey", "B18 C1")
def null_safe_join(spark, sf):
    a = load(spark, sf, "customer").selectExpr("c_custkey as x", "nullif(c_nationkey, 3) as k")
    b = load(spark, sf, "supplier").selectExpr("nullif(s_nationkey, 3) as k2")
    return a.join(b, F.col("k").eqNullSafe(F.col("k2"))).groupBy("x").agg(F.count("*").alias("n"))


@query("asof_join_events", "select a.event_id, b.value as seen from (select * from events where event_type = 'purchase') a asof left join (select user_id, ts, max(value) as value from events where event_type = 'view' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts", "C12")
def asof_join_events(spark, sf):
    e = load(spark, sf, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("value").alias("seen"))
    return asof_join(a, b, "user_id", "ts", "vts", ["seen"]).select("event_id", "seen")


@query("asof_join_nulls", "select a.event_id, b.seen from (select event_id, nullif(user_id, 3) as user_id, case when event_id % 11 <> 0 then ts end as ts from events where event_type = 'purchase') a asof left join (select user_id, ts, max(value) as seen from events where event_type = 'view' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts", "C12")
def asof_join_nulls(spark, sf):
    e = load(spark, sf, "events")
    a = e.where("event_type = 'purchase'").selectExpr("event_id", "nullif(user_id, 3) as user_id", "case when event_id % 11 <> 0 then ts end as ts")
    view = e.where("event_type = 'view'")
    b = view.groupBy("user_id", F.col("ts").alias("vts")).agg(F.max("value").alias("seen"))
    b = b.union(b.selectExpr("cast(null as bigint)", "vts", "seen")).union(b.selectExpr("user_id", "cast(null as timestamp_ntz)", "seen"))
    return asof_join(a, b, "user_id", "ts", "vts", ["seen"]).select("event_id", "seen")


@query("shuffle_hash_join", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey", "C11 B36")
def shuffle_hash_join(spark, sf):
    c, n = load(spark, sf, "customer"), load(spark, sf, "nation")
    return c.join(n.hint("shuffle_hash"), c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")


@query("lateral_join", "select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t", "C13")
def lateral_join(spark, sf):
    # The limit stands right on the sort: with a projection between them, Spark ranks in the order rows happen to arrive.
    top = load(spark, sf, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc_nulls_last("o_totalprice"), F.asc_nulls_last("o_orderkey")).limit(2)
    return load(spark, sf, "customer").lateralJoin(top).select("c_custkey", "o_orderkey")


@query("interval_join_binned", "select p_partkey, l as band from part join (values (0, 900.0, 950.0), (1, 940.0, 1000.0), (2, 1200.0, 1300.5)) s(l, lo, hi) on p_retailprice >= lo and p_retailprice <= hi", "C14 C7")
def interval_join_binned(spark, sf):
    s = spark.createDataFrame([(0, 900.0, 950.0), (1, 940.0, 1000.0), (2, 1200.0, 1300.5)], "band int, lo double, hi double")
    return range_join(load(spark, sf, "part").select("p_partkey", "p_retailprice"), s, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "band")


@query("broadcast_join", "select r_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by r_name", "C11")
def broadcast_join(spark, sf):
    # region is a fixed list of five rows
    return load(spark, sf, "nation").join(F.broadcast(load(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.count("*").alias("n"))
