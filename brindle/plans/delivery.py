"""Ways to take a result home, checks of plans, and the log of queries."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from brindle.diagnostics import PHASES, QueryLog
from brindle.registry import query
from brindle.tables import load


@query("tail_rows", "select o_orderkey from orders order by o_orderkey desc limit 7", "E4")
def tail_rows(spark, sf):
    # the last rows of an order are the first of the reverse order: no full result is gathered
    return load(spark, sf, "orders").select("o_orderkey").orderBy(F.desc("o_orderkey")).limit(7)


@query("tail_in_order", "select row_number() over (order by k) as at, k from (select o_orderkey as k from orders order by 1 desc limit 3) t union all select 0, count(*) from region", "E4")
def tail_in_order(spark, sf):
    """The last rows in their order; a tail longer than the rows gives all of them."""
    last = load(spark, sf, "orders").select("o_orderkey").orderBy("o_orderkey").tail(3)
    whole = load(spark, sf, "region").tail(1000)
    return spark.createDataFrame([(i + 1, r[0]) for i, r in enumerate(last)] + [(0, len(whole))], "at long, k long")


WAYS = "first head head2 take count isEmpty notEmpty collect toPandas toArrow toLocalIterator foreach show".split()


@query("result_delivery", "select * from (values " + ", ".join(f"('{w}', {n})" for w, n in zip(WAYS, [0, 0, 2, 3, 25, 1, 0, 25, 25, 25, 25, 25, 2], strict=True)) + ") t(way, n)", "E5 A17")
def result_delivery(spark, sf):
    """Each way to take rows home, with how many came or which row was first."""
    n = load(spark, sf, "nation").select("n_nationkey").orderBy("n_nationkey")
    seen = spark.sparkContext.accumulator(0)
    n.foreach(lambda r: seen.add(1))
    shown = n._jdf.showString(2, 20, False).count("\n| ")  # the head has no space there
    got = [n.first()[0], n.head()[0], len(n.head(2)), len(n.take(3)), n.count(), int(n.where("false").isEmpty()), int(n.isEmpty()), len(n.collect()), len(n.toPandas()), n.toArrow().num_rows, sum(1 for _ in n.toLocalIterator()), seen.value, shown]
    return spark.createDataFrame(list(zip(WAYS, got, strict=True)), "way string, n int")


WRONG = ["join", "union", "aggregate", "window", "column", "table", "function", "cast"]


@query("plan_validation", "select * from (values " + ", ".join(f"('{w}', true)" for w in WRONG) + ") t(part, refused)", "E34")
def plan_validation(spark, sf):
    """Plans that make no sense are refused before anything runs."""
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    wrong = {
        "join": lambda: n.join(r, n.n_name + 1 == r.no_such),
        "union": lambda: n.union(r.select("r_regionkey")),
        "aggregate": lambda: n.groupBy("n_regionkey").agg(F.col("n_name")),
        "window": lambda: n.select(F.row_number()),
        "column": lambda: n.select("no_such"),
        "table": lambda: spark.table("no_such_table_at_all"),
        "function": lambda: n.selectExpr("no_such_function(n_name)"),
        "cast": lambda: n.selectExpr("cast(array(1) as int)"),
    }
    rows = []
    for part in WRONG:
        try:
            wrong[part]().schema
            rows.append((part, False))
        except (AnalysisException, AttributeError):
            rows.append((part, True))
    return spark.createDataFrame(rows, "part string, refused boolean")


@query("query_log", "select 'q' as query, p as phase, true as timed, n from (values " + ", ".join(f"('{p}')" for p in PHASES) + ") t(p), (select count(*) as n from nation) c", "E35")
def query_log(spark, sf):
    """The log holds, for each query, the time of each phase and the rows that came out."""
    log = QueryLog(spark)
    log.run("q", load(spark, sf, "nation").where("n_nationkey >= 0"))
    return log.frame().select("query", "phase", (F.col("ms") >= 0).alias("timed"), F.col("rows").alias("n"))
