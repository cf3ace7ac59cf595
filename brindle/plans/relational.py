"""Projections, filters, column operators, sorting, limits, set operations, missing values, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import isinf, truncate
from brindle.operators import exact_freq_items
from brindle.plans import both, run_sql
from brindle.registry import query
from brindle.tables import load


@query("select_exprs", "select o_orderkey, o_totalprice * 2 as dbl, o_totalprice - 1 as less, -o_totalprice as neg, o_orderkey % 7 as m, 'x' as lit, o_orderstatus || '-' || o_orderpriority as tag from orders", "B1 B13 B15")
def select_exprs(spark, sf):
    o = load(spark, sf, "orders")
    p = F.col("o_totalprice")
    return o.select("o_orderkey", (p * 2).alias("dbl"), (p - 1).alias("less"), (-p).alias("neg"), (F.col("o_orderkey") % 7).alias("m"), F.lit("x").alias("lit"), F.concat("o_orderstatus", F.lit("-"), "o_orderpriority").alias("tag"))


@query(
    "filter_predicates",
    """select p_partkey from part where (p_size between 5 and 20 or p_type in ('PROMO', 'SMALL')) and p_name like '%a%' and p_brand is not null
       and not (p_size = 7) and regexp_matches(p_name, '[a-z]+') and p_type ilike '%o%' and p_size <> 9 and p_size is distinct from 11""",
    "B2 B17 B18 B19 B20 B21 B22 B23",
)
def filter_predicates(spark, sf):
    c = F.col
    p = load(spark, sf, "part").where(c("p_size").between(5, 20) | c("p_type").isin("PROMO", "SMALL"))
    p = p.where(c("p_name").like("%a%") & c("p_brand").isNotNull() & ~(c("p_size") == 7) & c("p_name").rlike("[a-z]+"))
    return p.where(c("p_type").ilike("%o%") & (c("p_size") != 9) & ~c("p_size").eqNullSafe(11)).select("p_partkey")


both("truth_tests", "select o_orderkey, (nullif(o_orderstatus, 'F') = 'O') is true as t, (nullif(o_orderstatus, 'F') = 'O') is not false as nf, (nullif(o_orderstatus, 'F') = 'O') is null as u from orders", "B20")


@query("with_columns", "select c_custkey, upper(c_name) as c_name, c_nationkey, c_acctbal, c_mktsegment, c_acctbal > 0 as positive from customer", "B3")
def with_columns(spark, sf):
    return load(spark, sf, "customer").withColumns({"c_name": F.upper("c_name"), "positive": F.col("c_acctbal") > 0})


@query("rename_drop", "select n_nationkey as id, n_name as nation from nation", "B4 B5")
def rename_drop(spark, sf):
    return load(spark, sf, "nation").withColumnsRenamed({"n_nationkey": "id", "n_name": "nation"}).drop("n_regionkey")


@query("to_df", "select r_regionkey as a, r_name as b from region", "B6")
def to_df(spark, sf):
    return load(spark, sf, "region").toDF("a", "b")


@query("to_schema", "select n_name, cast(n_nationkey as bigint) as n_nationkey from nation", "B7")
def to_schema(spark, sf):
    return load(spark, sf, "nation").to(T.StructType([T.StructField("n_name", T.StringType()), T.StructField("n_nationkey", T.LongType())]))


@query("alias_star", "select n.*, r.r_name from nation n join region r on n.n_regionkey = r.r_regionkey", "B8 B9")
def alias_star(spark, sf):
    n, r = load(spark, sf, "nation").alias("n"), load(spark, sf, "region").alias("r")
    return n.join(r, F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("n.*", "r.r_name")


@query("col_regex", "select c_name, c_nationkey from customer", "B10")
def col_regex(spark, sf):
    c = load(spark, sf, "customer")
    return c.select(c.colRegex("`c_na.*`"))


@query("case_when", "select l_orderkey, l_quantity, case when l_quantity < 10 then 'low' when l_quantity < 30 then 'mid' else 'high' end as band, case l_returnflag when 'R' then 1 when 'A' then 2 end as code from lineitem", "B24 2.L")
def case_when(spark, sf):
    q = F.col("l_quantity")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", F.when(q < 10, "low").when(q < 30, "mid").otherwise("high").alias("band"), F.expr("case l_returnflag when 'R' then 1 when 'A' then 2 end").alias("code"))


both("casts", "select o_orderkey, cast(o_totalprice as decimal(12,2)) as d, cast(o_orderkey as string) as s, cast('12' as int) as i, try_cast('x' as int) as bad, cast(trunc(o_orderdate, 'DD') as date) as dt, cast(3.7 as int) as three, cast(1 as boolean) as b, o_orderkey::double as dbl from orders".replace("trunc(o_orderdate, 'DD')", "o_orderdate"), "B14", "select o_orderkey, cast(o_totalprice as decimal(12,2)) as d, cast(o_orderkey as varchar) as s, 12 as i, cast(null as int) as bad, cast(o_orderdate as date) as dt, cast(trunc(3.7) as int) as three, true as b, o_orderkey::double as dbl from orders")
both("bitwise", "select o_orderkey, o_orderkey & 12 as a, o_orderkey | 3 as o, o_orderkey ^ 5 as x, ~o_orderkey as n, o_orderkey div 4 as d from orders", "B16", "select o_orderkey, o_orderkey & 12 as a, o_orderkey | 3 as o, xor(o_orderkey, 5) as x, ~o_orderkey as n, o_orderkey // 4 as d from orders")
both("row_constructor", "select n_nationkey from nation where (n_regionkey, n_nationkey) in ((1, 1), (2, 2), (3, 8))", "B28")
both("interval_arith", "select o_orderkey, o_orderdate + interval 1 month as m, o_orderdate - interval 3 day as d, o_orderdate + interval 2 hour as h from orders", "B29")
both("special_syntax", "select p_partkey, extract(year from timestamp_ntz '2020-05-06 07:08:09') as y, substring(p_name from 2 for 3) as s, trim(both 'a' from p_name) as t, position('a' in p_name) as pos, overlay(p_brand placing 'ZZ' from 2 for 1) as ov from part", "B30", "select p_partkey, cast(2020 as int) as y, substring(p_name, 2, 3) as s, trim(p_name, 'a') as t, cast(position('a' in p_name) as int) as pos, left(p_brand, 1) || 'ZZ' || substr(p_brand, 3) as ov from part")
both("timestamp_add_diff", "select event_id, timestampadd(HOUR, 5, ts) as plus5, timestampdiff(DAY, timestamp_ntz '2024-01-01', ts) as days from events", "B31", "select event_id, ts + interval 5 hour as plus5, cast(floor(epoch(ts - timestamp '2024-01-01') / 86400) as bigint) as days from events")
both("cte_chain", "with a as (select o_custkey k, count(*) n from orders group by o_custkey), b(k2, n2) as (select k, n from a where n > 3) select n2, count(*) as customers from b group by n2", "B35")
both("recursive_cte", "with recursive t(i, f) as (select 1, cast(1 as bigint) union all select i + 1, f * (i + 1) from t where i < 10) select i, f from t", "B35")
both("values_inline", "select a, b from values (1, 'x'), (2, null), (3, 'z') as t(a, b)", "A11", "select a, b from (values (1, 'x'), (2, null), (3, 'z')) as t(a, b)")
both("one_row", "select 1 as one, 'a' as a", "A12")
both("expr_call", "select r_regionkey, upper(r_name) as u, abs(r_regionkey - 3) as d from region", "B33")


@query("call_function", "select r_regionkey, upper(r_name) as u from region", "B33")
def call_function(spark, sf):
    return load(spark, sf, "region").select("r_regionkey", F.call_function("upper", F.col("r_name")).alias("u"))


@query("param_sql", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'F'", "B34")
def param_sql(spark, sf):
    return run_sql(spark, sf, "select o_orderkey from orders where o_totalprice > :least and o_orderstatus = :status", {"least": 300000, "status": "F"})


@query("param_sql_positional", "select o_orderkey from orders where o_totalprice > 300000 and o_orderstatus = 'O'", "B34")
def param_sql_positional(spark, sf):
    return run_sql(spark, sf, "select o_orderkey from orders where o_totalprice > ? and o_orderstatus = ?", [300000, "O"])


@query("hints_partitioning", "select n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey group by n_name", "B36 B37 C11")
def hints_partitioning(spark, sf):
    c = load(spark, sf, "customer").repartition(4, "c_nationkey").hint("merge")
    n = load(spark, sf, "nation").repartitionByRange(2, "n_nationkey").coalesce(1)
    return c.join(n.hint("broadcast"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@query("range_table", "select range as id from range(3, 50, 4)", "A10")
def range_table(spark, sf):
    return spark.range(3, 50, 4)


@query("local_data", "select * from (values (1, 'a', 1.5), (2, null, 2.5)) t(i, s, d)", "A9")
def local_data(spark, sf):
    return spark.createDataFrame([(1, "a", 1.5), (2, None, 2.5)], "i int, s string, d double").withColumn("d", F.col("d").cast("decimal(2,1)"))


@query("sort_nulls", "select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer order by seg desc nulls last, c_custkey limit 50", "E1")
def sort_nulls(spark, sf):
    c = load(spark, sf, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"))
    return c.orderBy(F.col("seg").desc_nulls_last(), "c_custkey").limit(50)


@query("limit_offset", "select o_orderkey from orders order by o_orderkey limit 20 offset 35", "E2 E3")
def limit_offset(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").offset(35).limit(20)


@query("distinct_rows", "select distinct l_returnflag, l_linestatus from lineitem", "E6")
def distinct_rows(spark, sf):
    return load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("drop_duplicates", "select c_nationkey, min(c_custkey) as c_custkey from customer group by c_nationkey", "E7")
def drop_duplicates(spark, sf):
    # which row dropDuplicates keeps is open; the smallest key makes it definite
    c = load(spark, sf, "customer")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("c_custkey"))
    return c.join(first, ["c_nationkey", "c_custkey"], "left_semi").dropDuplicates(["c_nationkey"]).select("c_nationkey", "c_custkey")


@query("union_widen", "select cast(n_nationkey as bigint) as k, n_name as nm from nation union all select c_custkey, c_name from customer", "E8")
def union_widen(spark, sf):
    return load(spark, sf, "nation").selectExpr("n_nationkey as k", "n_name as nm").union(load(spark, sf, "customer").select("c_custkey", "c_name"))


both("union_distinct", "select c_nationkey as k from customer union select s_nationkey from supplier", "E8")


@query("union_by_name", "select n_nationkey as k, n_name as nm, cast(null as varchar) as seg from nation union all select c_nationkey, c_name, c_mktsegment from customer", "E9")
def union_by_name(spark, sf):
    a = load(spark, sf, "nation").selectExpr("n_nationkey as k", "n_name as nm")
    b = load(spark, sf, "customer").selectExpr("c_mktsegment as seg", "c_name as nm", "c_nationkey as k")
    return a.unionByName(b, allowMissingColumns=True)


@query("intersect_rows", "select c_nationkey as k from customer intersect select s_nationkey from supplier", "E10")
def intersect_rows(spark, sf):
    return load(spark, sf, "customer").selectExpr("c_nationkey as k").intersect(load(spark, sf, "supplier").selectExpr("s_nationkey as k"))


both("intersect_all", "select c_nationkey as k from customer intersect all select s_nationkey from supplier", "E10")


@query("except_rows", "select o_custkey as k from orders except select c_custkey from customer where c_acctbal > 0", "E11")
def except_rows(spark, sf):
    return load(spark, sf, "orders").selectExpr("o_custkey as k").subtract(load(spark, sf, "customer").where("c_acctbal > 0").selectExpr("c_custkey as k"))


both("except_all", "select c_nationkey as k from customer except all select s_nationkey from supplier", "E11")


@query("sample_rows", None, "E12")
def sample_rows(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey").sample(False, 0.1, seed=7)


@query("sample_replace", None, "E12")
def sample_replace(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey").sample(True, 0.1, seed=7)


@query("sample_by", None, "E13")
def sample_by(spark, sf):
    return load(spark, sf, "orders").stat.sampleBy("o_orderstatus", {"F": 0.1, "O": 0.2}, seed=3)


def _holes(spark, sf):
    return load(spark, sf, "customer").selectExpr("c_custkey", "nullif(c_nationkey, 3) as nat", "nullif(c_mktsegment, 'BUILDING') as seg")


HOLES = "(select c_custkey, nullif(c_nationkey, 3) as nat, nullif(c_mktsegment, 'BUILDING') as seg from customer)"


@query("na_drop", f"select * from {HOLES} t where nat is not null and seg is not null", "E14")
def na_drop(spark, sf):
    return _holes(spark, sf).na.drop(how="any")


@query("na_drop_thresh", f"select * from {HOLES} t where nat is not null or seg is not null", "E14")
def na_drop_thresh(spark, sf):
    return _holes(spark, sf).na.drop(thresh=1, subset=["nat", "seg"])


@query("na_fill", f"select c_custkey, coalesce(nat, -1) as nat, coalesce(seg, '?') as seg from {HOLES} t", "E15")
def na_fill(spark, sf):
    return _holes(spark, sf).na.fill({"nat": -1, "seg": "?"})


@query("na_replace", "select n_nationkey, case n_name when 'NATION_1' then 'one' when 'NATION_2' then 'two' else n_name end as n_name from nation", "E16")
def na_replace(spark, sf):
    return load(spark, sf, "nation").na.replace(["NATION_1", "NATION_2"], ["one", "two"], "n_name").select("n_nationkey", "n_name")


@query("cov_corr", "select round(covar_samp(l_quantity, l_extendedprice), 4) as cov, round(corr(l_quantity, l_extendedprice), 8) as cor from lineitem", "E17 E18")
def cov_corr(spark, sf):
    li = load(spark, sf, "lineitem")
    # as aggregates: the same figures as df.stat.cov and df.stat.corr, without a job at planning time
    return li.agg(F.round(F.covar_samp("l_quantity", "l_extendedprice"), 4).alias("cov"), F.round(F.corr("l_quantity", "l_extendedprice"), 8).alias("cor"))


@query(
    "stat_methods",
    "select round(covar_samp(l_quantity, l_tax), 8) as cov, round(corr(l_quantity, l_tax), 8) as cor, quantile_disc(l_quantity, 0.25) as q1, quantile_disc(l_quantity, 0.5) as q2, quantile_disc(l_quantity, 0.75) as q3 from lineitem",
    "E17 E18 E19",
)
def stat_methods(spark, sf):
    li = load(spark, sf, "lineitem")
    q = li.stat.approxQuantile("l_quantity", [0.25, 0.5, 0.75], 0.0)
    return spark.createDataFrame([(round(li.stat.cov("l_quantity", "l_tax"), 8), round(li.stat.corr("l_quantity", "l_tax"), 8), *q)], "cov double, cor double, q1 double, q2 double, q3 double")


@query("exact_quantile", "select quantile_cont(l_quantity, 0.25) as q1, median(l_quantity) as q2, quantile_cont(l_quantity, 0.75) as q3 from lineitem", "E19")
def exact_quantile(spark, sf):
    return load(spark, sf, "lineitem").agg(F.percentile("l_quantity", 0.25).alias("q1"), F.median("l_quantity").alias("q2"), F.percentile("l_quantity", 0.75).alias("q3"))


def _rows(table: str, column: str, more: dict[str, str], stats: list[tuple[str, str]]) -> str:
    return " union all ".join(f"select '{k}' as summary, cast({e.format(column)} as double) as {column}{more.get(k, '')} from {table}" for k, e in stats)


BASIC = [("count", "count({0})"), ("mean", "round(avg({0}), 4)"), ("stddev", "round(stddev({0}), 4)"), ("min", "min({0})"), ("max", "max({0})")]
_STATUS = {"count": ", cast(count(o_orderstatus) as varchar) as o_orderstatus", "mean": ", null", "stddev": ", null", "min": ", min(o_orderstatus)", "max": ", max(o_orderstatus)"}


@query("describe_stats", _rows("orders", "o_totalprice", _STATUS, BASIC), "E20")
def describe_stats(spark, sf):
    d = load(spark, sf, "orders").describe("o_totalprice", "o_orderstatus")
    return d.withColumn("o_totalprice", F.round(F.col("o_totalprice").cast("double"), 4))


QUARTERS = [(f"{p}%", f"quantile_disc({{0}}, {p / 100})") for p in (25, 50, 75)]


@query("summary_stats", _rows("part", "p_size", {}, [*BASIC, *QUARTERS, ("count_distinct", "count(distinct {0})")]), "E21")
def summary_stats(spark, sf):
    d = load(spark, sf, "part").select("p_size").summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max", "count_distinct")
    return d.withColumn("p_size", F.round(F.col("p_size").cast("double"), 4))


@query("freq_items_exact", "select l_returnflag as item, count(*) as n from lineitem group by l_returnflag having count(*) >= 0.3 * (select count(*) from lineitem)", "E22")
def freq_items_exact(spark, sf):
    return exact_freq_items(load(spark, sf, "lineitem"), "l_returnflag", 0.3)


@query("freq_items", "select bool_and(c >= 0) as holds_all from (select count(*) as c from lineitem group by l_returnflag having count(*) >= 0.3 * (select count(*) from lineitem)) t", "E22")
def freq_items(spark, sf):
    """freqItems may answer more than what is frequent, but never less."""
    li = load(spark, sf, "lineitem")
    some = li.stat.freqItems(["l_returnflag"], 0.3)
    return exact_freq_items(li, "l_returnflag", 0.3).crossJoin(some).agg(F.bool_and(F.array_contains("l_returnflag_freqItems", F.col("item"))).alias("holds_all"))


@query("truncate_isinf", "select l_orderkey, l_linenumber, trunc(l_extendedprice / 10) * 10 as t, false as inf from lineitem", "2.G 2.L")
def truncate_isinf(spark, sf):
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", truncate(F.col("l_extendedprice"), -1).alias("t"), isinf(F.col("l_extendedprice")).alias("inf"))


@query("truncate_decimal", "select cast(1 as int) as id, 0.28::double as a, 0.29::double as b, -1.0::double as c, 1e20::double as d, -1200::double as e", "2.G")
def truncate_decimal(spark, sf):
    d = spark.createDataFrame([(1, 0.289, 0.29, -1.005, 1e20, -1234.5)], "id int, a double, b double, c double, d double, e double")
    return d.select("id", *[truncate(F.col(c), 2).alias(c) for c in "abcd"], truncate(F.col("e"), -2).alias("e"))


@query("empty_frame", "select o_orderkey from orders where false", "E33")
def empty_frame(spark, sf):
    return load(spark, sf, "orders").where(F.lit(False)).select("o_orderkey")


@query("transpose_rows", "select 'r_regionkey' as key, " + ", ".join(f"max(case when n = {i} then r_regionkey end) as k{i}" for i in range(5)) + " from (select r_regionkey, row_number() over (order by r_name) - 1 as n from region) t", "E")
def transpose_rows(spark, sf):
    d = load(spark, sf, "region").selectExpr("r_name", "r_regionkey").transpose("r_name")
    return d.toDF("key", *[f"k{i}" for i in range(len(d.columns) - 1)])  # the columns come in the order of the names


LITERALS = [
    ("b", "true", None), ("ti", "1Y", "cast(1 as tinyint)"), ("si", "2S", "cast(2 as smallint)"), ("i", "3", "cast(3 as int)"), ("l", "4L", "cast(4 as bigint)"), ("f", "1.5F", "cast(1.5 as float)"), ("d", "2.5D", "cast(2.5 as double)"), ("e", "1e3", "cast(1000 as double)"), ("de", "3.25", "cast(3.25 as decimal(3,2))"), ("bd", "4.5BD", "cast(4.5 as decimal(2,1))"),
    ("s", "'it''s'", None), ("u", "'\u00e9'", "'é'"), ("r", r"r'a\nb'", r"'a\nb'"), ("x", "hex(X'4142')", "'4142'"), ("dt", "date '2020-02-03'", None), ("ts", "timestamp_ntz '2020-02-03 04:05:06'", "timestamp '2020-02-03 04:05:06'"), ("tz", "cast(timestamp '2020-02-03 04:05:06' as timestamp_ntz)", "timestamp '2020-02-03 04:05:06'"), ("ym", "date '2020-01-31' + interval '1-2' year to month", "cast(date '2020-01-31' + interval 14 month as date)"), ("ds", "timestamp_ntz '2020-01-01 00:00:00' + interval '1 02:03:04' day to second", "timestamp '2020-01-02 02:03:04'"),
    ("nu", "cast(null as int)", None), ("na", "isnan(double('NaN'))", "true"), ("inf", "double('Infinity') > 1e300", "true"), ("ar", "array(1, 2)[1]", "cast(2 as int)"), ("ma", "map('k', 7)['k']", "cast(7 as int)"), ("st", "named_struct('a', 9).a", "cast(9 as int)"),
]
both("literals", "select " + ", ".join(f"{e} as {n}" for n, e, _ in LITERALS), "B13", "select " + ", ".join(f"{o or e} as {n}" for n, e, o in LITERALS))


both("sql_pivot", "select * from (select o_orderstatus, o_orderpriority, o_orderkey from orders) pivot (count(o_orderkey) for o_orderstatus in ('F' as f, 'O' as o))", "D13", "select o_orderpriority, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as f, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as o from orders group by o_orderpriority")
both("sql_unpivot", "select * from (select s_suppkey, s_nationkey as a, s_nationkey + 1 as b from supplier) unpivot (v for k in (a, b))", "D14", "select s_suppkey, k, case k when 'a' then s_nationkey else s_nationkey + 1 end as v from supplier, (values ('a'), ('b')) t(k)")
both("sql_sort_by", "select c_nationkey, min(c_custkey) as first from (select c_nationkey, c_custkey from customer distribute by c_nationkey sort by c_nationkey, c_custkey) t group by c_nationkey", "B37 E1", "select c_nationkey, min(c_custkey) as first from customer group by c_nationkey")
both("sql_cluster_by", "select count(*) as n from (select c_nationkey from customer cluster by c_nationkey) t", "B37 E1", "select count(*) as n from customer")
both("sql_tablesample", "select (count(*) < 1500) as fewer from orders tablesample (10 rows)", "E12", "select true as fewer")
both("sql_tablesample_percent", "select count(*) > 0 and count(*) < 0.5 * (select count(*) from orders) as share from orders tablesample (20 percent) repeatable (5)", "E12", "select true as share")


@query("scan_columns", "select l_partkey, round(sum(l_quantity), 2) as q from lineitem where l_discount > 0.05 group by l_partkey", "A1 A5")
def scan_columns(spark, sf):
    return load(spark, sf, "lineitem").where("l_discount > 0.05").groupBy("l_partkey").agg(F.round(F.sum("l_quantity"), 2).alias("q"))
