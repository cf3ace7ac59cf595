"""Business queries over the order tables, in the shapes of the TPC-H set."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.plans import both
from brindle.registry import query
from brindle.tables import load


@query(
    "tpch_q1",
    """
    select l_returnflag, l_linestatus, round(sum(l_quantity), 2) sum_qty, round(sum(l_extendedprice), 2) sum_base,
           round(sum(l_extendedprice * (1 - l_discount)), 2) sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) sum_charge,
           round(avg(l_quantity), 6) avg_qty, round(avg(l_extendedprice), 4) avg_price, round(avg(l_discount), 6) avg_disc, count(*) n
    from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
    "A1 B1 B2 D1 E1",
)
def q1(spark, sf):
    li = load(spark, sf, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        li.groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(net), 2).alias("sum_disc"),
            F.round(F.sum(net * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 6).alias("avg_disc"),
            F.count("*").alias("n"),
        )
        # at most as many rows as flags times states: one task sorts them, without a range exchange
        .coalesce(1)
        .sortWithinPartitions("l_returnflag", "l_linestatus")
    )


@query(
    "tpch_q3",
    """select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, o_orderdate from customer join orders on c_custkey = o_custkey
       join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15' and l_shipdate > timestamp '1998-03-15'
       group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10""",
    "C1 C9 D1 E2",
)
def q3(spark, sf):
    c = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    o = load(spark, sf, "orders").where("o_orderdate < timestamp_ntz '1998-03-15'").select("o_orderkey", "o_custkey", "o_orderdate")
    li = load(spark, sf, "lineitem").where("l_shipdate > timestamp_ntz '1998-03-15'")
    j = o.join(c, o.o_custkey == c.c_custkey).join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    rev = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")
    return j.groupBy("l_orderkey", "o_orderdate").agg(rev).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("tpch_q6", "select round(sum(l_extendedprice * l_discount), 2) revenue from lineitem where l_shipdate >= timestamp '1996-01-01' and l_shipdate < timestamp '1997-01-01' and l_discount between 0.03 and 0.07 and l_quantity < 24", "B2 B21 D2")
def q6(spark, sf):
    li = load(spark, sf, "lineitem").where("l_shipdate >= timestamp_ntz '1996-01-01' and l_shipdate < timestamp_ntz '1997-01-01'")
    li = li.where(F.col("l_discount").between(0.03, 0.07) & (F.col("l_quantity") < 24))
    return li.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


REV = "round(sum(l_extendedprice * (1 - l_discount)), 2)"
both("tpch_q2", "select s_name, s_acctbal, n_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal = (select max(s2.s_acctbal) from supplier s2 where s2.s_nationkey = supplier.s_nationkey)", "B25 C9")
both("tpch_q4", "select o_orderpriority, count(*) n from orders where o_orderdate >= '1996-01-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by o_orderpriority", "B27 C10", "select o_orderpriority, count(*) n from orders where o_orderdate >= timestamp '1996-01-01' and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45) group by o_orderpriority")
both("tpch_q5", f"select n_name, {REV} revenue from customer, orders, lineitem, supplier, nation, region where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey group by n_name", "C4 C9")
both("tpch_q7", f"select n1.n_name supp_nation, n2.n_name cust_nation, cast(year(l_shipdate) as int) y, {REV} revenue from supplier join lineitem on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join nation n1 on s_nationkey = n1.n_nationkey join nation n2 on c_nationkey = n2.n_nationkey where n1.n_regionkey = 1 and n2.n_regionkey = 2 group by n1.n_name, n2.n_name, year(l_shipdate)", "C8 C9")
both("tpch_q8", "select cast(year(o_orderdate) as int) y, round(sum(case when n_name = 'NATION_3' then l_extendedprice else 0 end) / sum(l_extendedprice), 8) share from lineitem join orders on l_orderkey = o_orderkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey group by year(o_orderdate)", "D3 B24")
both("tpch_q9", f"select n_name, cast(year(o_orderdate) as int) y, {REV} profit from lineitem join part on p_partkey = l_partkey join supplier on s_suppkey = l_suppkey join nation on s_nationkey = n_nationkey join orders on o_orderkey = l_orderkey where p_type = 'PROMO' group by n_name, year(o_orderdate)", "C9")
both("tpch_q10", f"select c_custkey, c_name, {REV} revenue, n_name from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join nation on c_nationkey = n_nationkey where l_returnflag = 'R' group by c_custkey, c_name, n_name order by revenue desc, c_custkey limit 20", "E2 C9")
both("tpch_q11", "select n_name, round(sum(s_acctbal), 2) total from supplier join nation on s_nationkey = n_nationkey group by n_name having sum(s_acctbal) > (select sum(s_acctbal) * 0.05 from supplier)", "D8 B25")
both("tpch_q12", "select o_orderpriority, count_if(l_quantity > 25) high, count_if(l_quantity <= 25) low from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= o_orderdate group by o_orderpriority", "C7 D5", "select o_orderpriority, cast(count_if(l_quantity > 25) as bigint) high, cast(count_if(l_quantity <= 25) as bigint) low from orders join lineitem on o_orderkey = l_orderkey where l_shipdate >= o_orderdate group by o_orderpriority")
both("tpch_q13", "select c_count, count(*) custdist from (select c_custkey, count(o_orderkey) c_count from customer left join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey) t group by c_count", "C2 D1")
both("tpch_q14", "select round(100.0 * sum(case when p_type = 'PROMO' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) promo from lineitem join part on l_partkey = p_partkey", "D3")
both("tpch_q15", f"with revenue as (select l_suppkey k, {REV} total from lineitem group by l_suppkey) select s_suppkey, s_name, total from supplier join revenue on s_suppkey = k where total = (select max(total) from revenue)", "B35 B25")
both("tpch_q16", "select p_brand, p_type, count(distinct l_suppkey) n from lineitem join part on p_partkey = l_partkey where p_size in (1, 5, 9, 14, 23, 36, 45, 49) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) group by p_brand, p_type", "B22 B26 D4")
both("tpch_q17", "select round(sum(l_extendedprice) / 7.0, 2) avg_yearly from lineitem join part on p_partkey = l_partkey where p_size < 10 and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)", "B25")
both("tpch_q18", "select c_name, o_orderkey, round(sum(l_quantity), 2) qty from customer join orders on c_custkey = o_custkey join lineitem on o_orderkey = l_orderkey where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 180) group by c_name, o_orderkey", "B26 D8")
both("tpch_q19", f"select {REV} revenue from lineitem join part on p_partkey = l_partkey where (p_size between 1 and 5 and l_quantity between 1 and 11) or (p_size between 6 and 10 and l_quantity between 10 and 20) or (p_type = 'PROMO' and l_quantity > 40)", "B19 B21")
both("tpch_q20", "select s_name from supplier where s_suppkey in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_size = 7) group by l_suppkey having sum(l_quantity) > 100)", "B26")
both("tpch_q21", "select s_name, count(*) numwait from supplier join lineitem l1 on s_suppkey = l1.l_suppkey where l1.l_returnflag = 'R' and exists (select 1 from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select 1 from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R') group by s_name", "B27 C10")
both("tpch_q22", "select c_nationkey, count(*) n, round(sum(c_acctbal), 2) total from customer where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select 1 from orders where o_custkey = c_custkey) group by c_nationkey", "B25 B27")
