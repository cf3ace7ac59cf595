"""Window functions and frames."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.operators import groups_window
from brindle.plans import both
from brindle.registry import query
from brindle.tables import load

BY = "over (partition by c_nationkey order by c_acctbal desc, c_custkey)"


@query("rank_family", f"select c_custkey, row_number() {BY} as rn, rank() {BY} as rk, dense_rank() {BY} as dr, round(percent_rank() {BY}, 8) as pr, ntile(4) {BY} as nt, round(cume_dist() {BY}, 8) as cd from customer", "2.J D16")
def rank_family(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    fs = {"rn": F.row_number().over(w).cast("long"), "rk": F.rank().over(w).cast("long"), "dr": F.dense_rank().over(w).cast("long"), "pr": F.round(F.percent_rank().over(w), 8), "nt": F.ntile(4).over(w).cast("long"), "cd": F.round(F.cume_dist().over(w), 8)}
    return load(spark, sf, "customer").select("c_custkey", *[c.alias(k) for k, c in fs.items()])


EV = "over (partition by user_id order by ts, event_id)"


@query("lag_lead", f"select event_id, lag(value) {EV} as a, lag(value, 2, 0.0) {EV} as b, lead(event_type) {EV} as c from events", "2.J")
def lag_lead(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").select("event_id", F.lag("value").over(w).alias("a"), F.lag("value", 2, 0.0).over(w).alias("b"), F.lead("event_type").over(w).alias("c"))


FULL = "rows between unbounded preceding and unbounded following"
both("first_last_nth", f"select event_id, first_value(event_type) over w as f, last_value(event_type) over w as l, nth_value(event_type, 2) over w as n from events window w as (partition by user_id order by ts, event_id {FULL})", "2.J D19")


@query("ignore_nulls", "select event_id, last_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as l, first_value(v ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as f from (select *, case when event_type = 'purchase' then value end as v from events) t", "D20")
def ignore_nulls(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = load(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", F.last("v", True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("l"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("f"))


@query("rows_frames", "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as s3, round(avg(value) over (partition by user_id order by ts, event_id rows between 1 preceding and 1 following), 6) as m, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as before from events", "D17 D21")
def rows_frames(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return load(spark, sf, "events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 6).alias("s3"), F.round(F.avg("value").over(w.rowsBetween(-1, 1)), 6).alias("m"), F.count("*").over(w.rowsBetween(W.unboundedPreceding, -1)).alias("before"))


both("range_interval", "select event_id, count(*) over (partition by user_id order by ts range between interval 1 day preceding and current row) as n from events", "D17")
# keys of a bounded number of rows each, so windows spread over tasks at any scale
both("range_numeric", "select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice range between 20000 preceding and 20000 following) as n from orders", "D17")


@query("groups_frame", "select o_orderkey, round(sum(o_totalprice) over (partition by o_orderstatus order by o_orderpriority groups between 1 preceding and current row), 2) as s from orders", "D18")
def groups_frame(spark, sf):
    return groups_window(load(spark, sf, "orders"), ["o_orderstatus"], "o_orderpriority", 1, 0, {"s": ("sum", "o_totalprice")}).select("o_orderkey", F.round("s", 2).alias("s"))


@query("topk_per_group", "select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as rn from customer) t where rn <= 3", "D22")
def topk_per_group(spark, sf):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return load(spark, sf, "customer").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("c_nationkey", "c_custkey")


both("share_of_total", "select o_orderkey, round(o_totalprice / sum(o_totalprice) over (partition by o_custkey), 8) as share from orders", "D21")
both("window_named_two", "select o_orderkey, cast(rank() over w as bigint) as r, count(*) over p as n from orders window p as (partition by o_custkey), w as (partition by o_custkey order by o_totalprice)", "D19")
