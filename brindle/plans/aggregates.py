"""Aggregation, grouping sets, pivots, statistics aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import avg_distinct
from brindle.plans import both
from brindle.registry import query
from brindle.tables import load


@query("agg_basic", "select l_returnflag, count(*) as n, count(l_tax) as nt, round(sum(l_quantity), 2) as s, round(avg(l_tax), 8) as a, round(avg(l_discount), 8) as m, min(l_shipdate) as lo, max(l_shipdate) as hi from lineitem group by l_returnflag", "D1 2.I")
def agg_basic(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("l_tax").alias("nt"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.avg("l_tax"), 8).alias("a"), F.round(F.mean("l_discount"), 8).alias("m"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("agg_global_empty", "select count(*) as n, sum(o_totalprice) as s from orders where o_orderkey < 0", "D2")
def agg_global_empty(spark, sf):
    return load(spark, sf, "orders").where("o_orderkey < 0").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))


@query("agg_composite", "select l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 6) as unit, cast(count(distinct l_linenumber) as int) as lines from lineitem group by l_linestatus", "D3")
def agg_composite(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("unit"), F.count_distinct("l_linenumber").cast("int").alias("lines"))


@query("agg_distinct", "select l_returnflag, count(distinct l_suppkey) as a, count(distinct (l_suppkey, l_linenumber)) as b, cast(sum(distinct l_linenumber) as bigint) as c, avg(distinct l_linenumber) as d from lineitem group by l_returnflag", "D4 2.I")
def agg_distinct(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("a"), F.count_distinct("l_suppkey", "l_linenumber").alias("b"), F.sum_distinct("l_linenumber").alias("c"), avg_distinct(F.col("l_linenumber")).alias("d"))


both("agg_filter", "select l_returnflag, count(*) filter (where l_quantity > 25) as big, round(sum(l_tax) filter (where l_linenumber = 1), 4) as t from lineitem group by l_returnflag", "D5")
both("within_group", "select l_returnflag, percentile_cont(0.5) within group (order by l_quantity) as med from lineitem group by l_returnflag", "D6")
both("group_only", "select l_returnflag, l_linestatus from lineitem group by l_returnflag, l_linestatus", "D7")
both("having", "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12", "D8")


@query("rollup", "select l_returnflag, l_linestatus, count(*) as n, cast(grouping(l_returnflag) as bigint) as g, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as gid from lineitem group by rollup (l_returnflag, l_linestatus)", "D9 D12")
def rollup(spark, sf):
    return load(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.grouping("l_returnflag").cast("long").alias("g"), F.grouping_id().cast("long").alias("gid"))


@query("cube", "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q, cast(grouping_id(l_returnflag, l_linestatus) as bigint) as gid from lineitem group by cube (l_returnflag, l_linestatus)", "D10")
def cube(spark, sf):
    return load(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.grouping_id().cast("long").alias("gid"))


both("grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus, o_orderpriority), (o_orderstatus), ())", "D11")


@query("pivot_status", "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by o_orderpriority", "D13")
def pivot_status(spark, sf):
    p = load(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count()
    return p.na.fill(0)


@query("pivot_multi", "select l_linestatus, round(sum(l_quantity) filter (where l_returnflag = 'A'), 2) as \"A_q\", count(*) filter (where l_returnflag = 'A') as \"A_n\", round(sum(l_quantity) filter (where l_returnflag = 'R'), 2) as \"R_q\", count(*) filter (where l_returnflag = 'R') as \"R_n\" from lineitem group by l_linestatus", "D13")
def pivot_multi(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_linestatus").pivot("l_returnflag", ["A", "R"]).agg(F.round(F.sum("l_quantity"), 2).alias("q"), F.count(F.lit(1)).alias("n"))


@query("unpivot", "select o_orderkey, 'o_custkey' as k, o_custkey as v from orders union all select o_orderkey, 'twice', 2 * o_orderkey from orders", "D14")
def unpivot(spark, sf):
    o = load(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", "2 * o_orderkey as twice")
    return o.unpivot(["o_orderkey"], ["o_custkey", "twice"], "k", "v")


@query("crosstab", "select o_orderpriority as o_orderpriority_o_orderstatus, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by o_orderpriority", "D15")
def crosstab(spark, sf):
    return load(spark, sf, "orders").stat.crosstab("o_orderpriority", "o_orderstatus")


@query(
    "agg_statistics",
    """select l_returnflag, round(stddev(l_quantity), 8) as sd, round(stddev_samp(l_quantity), 8) as sds, round(stddev_pop(l_quantity), 8) as sdp, round(variance(l_quantity), 6) as v, round(var_samp(l_quantity), 6) as vs,
       round(var_pop(l_quantity), 6) as vp, round(kurtosis_pop(l_quantity), 6) as ku, round(covar_pop(l_quantity, l_tax), 8) as cp, round(covar_samp(l_quantity, l_tax), 8) as cs, round(corr(l_quantity, l_extendedprice), 8) as co,
       round((avg(l_quantity ** 3) - 3 * avg(l_quantity) * avg(l_quantity ** 2) + 2 * avg(l_quantity) ** 3) / stddev_pop(l_quantity) ** 3, 6) as sk from lineitem group by l_returnflag""",
    "2.I",
)
def agg_statistics(spark, sf):
    q = "l_quantity"
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev(q), 8).alias("sd"), F.round(F.stddev_samp(q), 8).alias("sds"), F.round(F.stddev_pop(q), 8).alias("sdp"), F.round(F.variance(q), 6).alias("v"), F.round(F.var_samp(q), 6).alias("vs"), F.round(F.var_pop(q), 6).alias("vp"),
        F.round(F.kurtosis(q), 6).alias("ku"), F.round(F.covar_pop(q, "l_tax"), 8).alias("cp"), F.round(F.covar_samp(q, "l_tax"), 8).alias("cs"), F.round(F.corr(q, "l_extendedprice"), 8).alias("co"), F.round(F.skewness(q), 6).alias("sk"),
    )


REGR = ["count", "avgx", "avgy", "sxx", "syy", "sxy", "slope", "intercept", "r2"]
both("agg_regression", "select l_linestatus, " + ", ".join(f"round(regr_{r}(l_extendedprice, l_quantity), {2 if r[0] == 's' and r != 'slope' else 6}) as {r}" if r != "count" else "cast(regr_count(l_extendedprice, l_quantity) as bigint) as n" for r in REGR) + " from lineitem group by l_linestatus", "2.I")
both("agg_bit_bool", "select o_orderstatus, bool_and(o_totalprice > 0) as ba, every(o_totalprice > 1000) as ev, bool_or(o_totalprice > 400000) as bo, some(o_totalprice > 1e9) as so, any(o_totalprice > 5) as an, bit_and(o_custkey) as bn, bit_or(o_custkey) as br, bit_xor(o_custkey) as bx, count_if(o_totalprice > 100000) as ci from orders group by o_orderstatus", "2.I", "select o_orderstatus, bool_and(o_totalprice > 0) as ba, bool_and(o_totalprice > 1000) as ev, bool_or(o_totalprice > 400000) as bo, bool_or(o_totalprice > 1e9) as so, bool_or(o_totalprice > 5) as an, bit_and(o_custkey) as bn, bit_or(o_custkey) as br, bit_xor(o_custkey) as bx, cast(count_if(o_totalprice > 100000) as bigint) as ci from orders group by o_orderstatus")
both("agg_ordered", "select o_orderstatus, max_by(o_orderkey, o_totalprice) as hi, min_by(o_orderkey, o_totalprice) as lo, median(o_totalprice) as med, percentile(o_totalprice, 0.9) as p90 from orders group by o_orderstatus", "2.I", "select o_orderstatus, max_by(o_orderkey, o_totalprice) as hi, min_by(o_orderkey, o_totalprice) as lo, median(o_totalprice) as med, quantile_cont(o_totalprice, 0.9) as p90 from orders group by o_orderstatus")


@query("agg_collect", "select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as l, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as s from orders group by o_custkey", "2.I")
def agg_collect(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")), ",").alias("l"), F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("s"))


@query("agg_mode", "select l_linenumber as k, mode(l_returnflag) as m from (select 1 as l_linenumber, 'A' as l_returnflag union all select 1, 'A' union all select 1, 'B' union all select 2, 'C') t group by l_linenumber", "2.I")
def agg_mode(spark, sf):
    return spark.createDataFrame([(1, "A"), (1, "A"), (1, "B"), (2, "C")], "k int, f string").groupBy("k").agg(F.mode("f").alias("m"))


@query("agg_first_last", "select o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) as f, max_by(o_orderkey, (o_orderdate, o_orderkey)) as l from orders group by o_custkey", "2.I")
def agg_first_last(spark, sf):
    at = F.struct("o_orderdate", "o_orderkey")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", at).alias("f"), F.max_by("o_orderkey", at).alias("l"))


@query("pivot_discovered", "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as \"F\", nullif(count(*) filter (where o_orderstatus = 'O'), 0) as \"O\", nullif(count(*) filter (where o_orderstatus = 'P'), 0) as \"P\" from orders group by o_orderpriority", "D13")
def pivot_discovered(spark, sf):
    """Without a list of values Spark first asks for the distinct ones (at most spark.sql.pivotMaxValues)."""
    return load(spark, sf, "orders").groupBy("o_orderpriority").pivot("o_orderstatus").count()


@query(
    "pivot_keys",
    "select l_linenumber, " + ", ".join(f"round(sum(l_quantity) filter (where l_returnflag = '{a}' and l_linestatus = '{b}'), 2) as \"{a}_{b}\"" for a in "AR" for b in "FO") + " from lineitem group by l_linenumber",
    "D13",
)
def pivot_keys(spark, sf):
    """A pivot over two keys: over their struct, with the pairs of values as given."""
    both_keys = F.concat_ws("_", "l_returnflag", "l_linestatus").alias("rs")
    d = load(spark, sf, "lineitem").select("l_linenumber", both_keys, "l_quantity").groupBy("l_linenumber")
    return d.pivot("rs", [f"{a}_{b}" for a in "AR" for b in "FO"]).agg(F.round(F.sum("l_quantity"), 2))


@query("agg_approx", "select l_returnflag, true as n, true as p, true as ap, true as hll, true as same from lineitem group by l_returnflag", "2.I 2.N")
def agg_approx(spark, sf):
    """Approximate aggregates within the error that they promise, and first, last and any_value of a column that is the same in a group."""
    near = lambda a, b, share: F.abs(a - b) <= share * b
    exact, mid = F.count_distinct("l_partkey"), F.percentile("l_extendedprice", 0.5)
    kind = F.concat("l_returnflag", F.lit("!"))
    li = load(spark, sf, "lineitem").withColumn("kind", kind)
    return li.groupBy("l_returnflag").agg(
        near(F.approx_count_distinct("l_partkey", 0.02), exact, 0.1).alias("n"),
        near(F.percentile_approx("l_extendedprice", 0.5), mid, 0.02).alias("p"),
        near(F.approx_percentile("l_extendedprice", F.lit(0.5), F.lit(5000)), mid, 0.02).alias("ap"),
        near(F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")), exact, 0.1).alias("hll"),
        ((F.any_value("kind") == F.first("kind")) & (F.last("kind") == F.max("kind"))).alias("same"),
    )


@query("agg_sketches", "select true as cms, true as union_hll, true as bitmap", "2.N")
def agg_sketches(spark, sf):
    """Sketches that are made apart and merged: sizes and estimates."""
    o = load(spark, sf, "orders")
    per = o.groupBy("o_orderstatus").agg(F.hll_sketch_agg("o_custkey").alias("s"))
    merged = per.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("u"))
    exact = o.agg(F.count_distinct("o_custkey").alias("x"), F.length(F.count_min_sketch(F.col("o_custkey"), F.lit(0.01), F.lit(0.95), F.lit(3))).alias("c"))
    bits = o.groupBy(F.bitmap_bucket_number("o_orderkey").alias("k")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("o_orderkey"))).alias("n")).agg(F.sum("n").alias("b"), F.lit(0).alias("z"))
    keys = o.agg(F.count_distinct("o_orderkey").alias("ok"))
    d = merged.crossJoin(exact).crossJoin(bits).crossJoin(keys)  # one row each
    return d.select((F.col("c") > 0).alias("cms"), (F.abs(F.col("u") - F.col("x")) <= 0.1 * F.col("x")).alias("union_hll"), (F.col("b") == F.col("ok")).alias("bitmap"))
