"""Arrays, maps, structs, lambdas and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import array_exists, array_forall, array_reverse
from brindle.plans import both, run_sql
from brindle.plans.functions_scalar import family
from brindle.registry import query
from brindle.tables import load

ARR = "select o_custkey, sort_array(collect_list(o_orderkey)) as a, sort_array(collect_list(o_orderkey % 5)) as b from orders group by o_custkey"


def arrays(name: str, items: list[tuple[str, str, str]], tags: str = "2.K") -> None:
    oracle = "select o_custkey, " + ", ".join(f"{o} as {n}" for n, _, o in items) + " from (select o_custkey, list_sort(list(o_orderkey)) as a, list_sort(list(o_orderkey % 5)) as b from orders group by o_custkey) t"

    def run(spark, sf):
        o = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("a"), F.sort_array(F.collect_list(F.expr("o_orderkey % 5"))).alias("b"))
        return o.selectExpr("o_custkey", *[f"{s} as {n}" for n, s, _ in items])

    query(name, oracle, tags)(run)


def _s(x: str) -> str:
    return f"array_join(transform({x}, v -> cast(v as string)), ',')"


def _o(x: str) -> str:
    return f"coalesce(array_to_string({x}, ','), '')"


arrays("fn_array_basic", [
    ("ac", "array_contains(b, 3)", "list_contains(b, 3)"), ("ad", _s("sort_array(array_distinct(b))"), _o("list_sort(list_distinct(b))")), ("mx", "array_max(a)", "list_max(a)"), ("mn", "array_min(a)", "list_min(a)"), ("ap", "array_position(b, 2)", "coalesce(cast(list_position(b, 2) as bigint), 0)"), ("ea", "element_at(a, 1)", "a[1]"), ("el", "element_at(a, -1)", "a[-1]"), ("sl", _s("slice(a, 1, 2)"), _o("list_slice(a, 1, 2)")),
    ("n", "size(a)", "cast(len(a) as int)"), ("ca", "cardinality(a)", "cast(len(a) as int)"), ("rv", _s("reverse(a)"), _o("list_reverse(a)")), ("aa", _s("array_append(b, 9)"), _o("list_append(b, 9)")), ("pp", _s("array_prepend(b, 9)"), _o("list_prepend(9, b)")), ("rm", _s("array_remove(b, 1)"), _o("list_filter(b, lambda x: x <> 1)")), ("jo", "array_join(array('x', null, 'y'), '-', '?')", "'x-?-y'"), ("cp", "size(array_compact(array(1, null, 3)))", "2"), ("g", "get(a, 99)", "cast(null as bigint)"), ("i0", "a[0]", "a[1]"),
])
arrays("fn_array_sets", [
    ("un", _s("sort_array(array_union(b, array(1L, 7L)))"), _o("list_sort(list_distinct(list_concat(b, [1, 7])))")), ("it", _s("sort_array(array_intersect(b, array(1L, 2L)))"), _o("list_sort(list_intersect(list_distinct(b), [1, 2]))")), ("ex", _s("sort_array(array_except(b, array(1L, 2L)))"), _o("list_sort(list_filter(list_distinct(b), lambda x: x not in (1, 2)))")), ("ov", "arrays_overlap(b, array(1L, 2L))", "list_has_any(b, [1, 2])"),
    ("fl", _s("flatten(array(a, b))"), _o("flatten([a, b])")), ("sq", _s("sequence(1, 5)"), "'1,2,3,4,5'"), ("sd", _s("sort_array(b, false)"), _o("list_reverse_sort(b)")), ("so", _s("array_sort(b, (x, y) -> case when x < y then 1 when x > y then -1 else 0 end)"), _o("list_reverse_sort(b)")), ("ar", "array(1, 2)[1]", "2"), ("az", "size(arrays_zip(a, b))", "cast(len(a) as int)"),
])
arrays("fn_hof", [
    ("tf", _s("transform(b, x -> x * 2)"), _o("list_transform(b, lambda x: x * 2)")), ("ti", _s("transform(b, (x, i) -> x + i)"), _o("list_transform(b, lambda x, i: x + i - 1)")), ("ft", _s("filter(b, x -> x > 2)"), _o("list_filter(b, lambda x: x > 2)")), ("es", "exists(b, x -> x = 4)", "len(list_filter(b, lambda x: x = 4)) > 0"), ("fa", "forall(b, x -> x >= 0)", "true"), ("ag", "aggregate(b, 0L, (s, x) -> s + x)", "cast(list_sum(b) as bigint)"), ("af", "aggregate(b, 0L, (s, x) -> s + x, s -> s * 10)", "cast(list_sum(b) * 10 as bigint)"), ("rd", "reduce(b, 0L, (s, x) -> s + x)", "cast(list_sum(b) as bigint)"), ("zw", _s("zip_with(b, b, (x, y) -> x + y)"), _o("list_transform(b, lambda x: x + x)")), ("nst", "aggregate(transform(b, x -> aggregate(b, 0L, (s, y) -> s + y) * 0 + x), 0L, (s, x) -> s + x)", "cast(list_sum(b) as bigint)"),
], "2.K B32 2.N")


@query("explode_family", "select o_orderkey, unnest([o_custkey, o_orderkey]) as v from orders", "2.K")
def explode_family(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", F.explode(F.array("o_custkey", "o_orderkey")).alias("v"))


@query("explode_outer", "select n_nationkey, case when n_regionkey > 2 then n_name end as v from nation", "2.K")
def explode_outer(spark, sf):
    n = load(spark, sf, "nation").withColumn("a", F.when(F.col("n_regionkey") > 2, F.array("n_name")))
    return n.select("n_nationkey", F.explode_outer("a").alias("v"))


@query("posexplode_rows", "select n_nationkey, i as pos, case i when 0 then n_name else 'z' end as v from nation, (values (0), (1)) t(i)", "2.N")
def posexplode_rows(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.posexplode(F.array("n_name", F.lit("z"))).alias("pos", "v"))


@query("posexplode_outer_rows", "select n_nationkey, case when n_regionkey > 2 then 0 end as pos, case when n_regionkey > 2 then n_name end as v from nation", "2.N")
def posexplode_outer_rows(spark, sf):
    n = load(spark, sf, "nation").withColumn("a", F.when(F.col("n_regionkey") > 2, F.array("n_name")))
    return n.select("n_nationkey", F.posexplode_outer("a").alias("pos", "v"))


@query("inline_rows", "select n_nationkey, case i when 0 then n_regionkey else 7 end as x, case i when 0 then n_name else 'z' end as y from nation, (values (0), (1)) t(i)", "2.N")
def inline_rows(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.expr("inline(array(struct(n_regionkey as x, n_name as y), struct(7 as x, 'z' as y)))"))


@query("inline_outer_rows", "select n_nationkey, case when n_regionkey > 2 then n_regionkey end as x from nation", "2.N")
def inline_outer_rows(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.inline_outer(F.when(F.col("n_regionkey") > 2, F.array(F.struct(F.col("n_regionkey").alias("x"))))))


both("stack_rows", "select n_nationkey, k, v from nation lateral view stack(2, 'a', n_regionkey, 'b', 9) t as k, v", "2.N", "select n_nationkey, k, case k when 'a' then n_regionkey else 9 end as v from nation, (values ('a'), ('b')) t(k)")


@query("fn_array_aliases", "select o_custkey, len(list_filter(b, lambda x: x = 4)) > 0 as some, true as each, array_to_string(list_reverse(b), ',') as back from (select o_custkey, list_sort(list(o_orderkey % 5)) as b from orders group by o_custkey) t", "2.K 2.N")
def fn_array_aliases(spark, sf):
    b = load(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.expr("o_orderkey % 5"))).alias("b"))
    return b.select("o_custkey", array_exists(F.col("b"), lambda x: x == 4).alias("some"), array_forall(F.col("b"), lambda x: x >= 0).alias("each"), F.array_join(array_reverse(F.col("b")).cast("array<string>"), ",").alias("back"))


family("fn_variant", "events", ["event_id"], [
    ("k", "variant_get(parse_json(props), '$.k', 'int')", "cast(json_extract_string(props, '$.k') as int)"), ("t", "try_variant_get(parse_json(props), '$.none', 'int')", "cast(null as int)"), ("b", "parse_json(props):k::string", "json_extract_string(props, '$.k')"), ("n", "is_variant_null(parse_json('null'))", "true"), ("bad", "try_parse_json('{') is null", "true"), ("s", "schema_of_variant(parse_json('[1]'))", "'ARRAY<BIGINT>'"),
], "2.N 2.M")
family("fn_csv_xml", "nation", ["n_nationkey"], [
    ("c", "from_csv(concat(n_name, ',', n_regionkey), 'a string, b int').b", "n_regionkey"), ("tc", "to_csv(struct(n_name, n_regionkey))", "n_name || ',' || n_regionkey"), ("sc", "schema_of_csv('1,abc')", "'STRUCT<_c0: INT, _c1: STRING>'"), ("x", "from_xml(concat('<p><a>', n_regionkey, '</a></p>'), 'a int').a", "n_regionkey"), ("xp", "xpath_string(concat('<p><a>', n_name, '</a></p>'), 'p/a')", "n_name"), ("xi", "xpath_int('<p><a>4</a><a>5</a></p>', 'sum(p/a)')", "cast(9 as int)"), ("xb", "xpath_boolean('<p><a>4</a></p>', 'p/a')", "true"), ("tx", "contains(to_xml(struct(n_regionkey as a)), concat('<a>', n_regionkey, '</a>'))", "true"),
], "2.N")


@query("lateral_view", "select n_nationkey, unnest([n_regionkey, 7]) as v from nation", "E 2.K")
def lateral_view(spark, sf):
    return run_sql(spark, sf, "select n_nationkey, v from nation lateral view explode(array(n_regionkey, 7)) x as v")


@query("explode_map", "select n_nationkey, k as key, case k when 'name' then n_name else cast(n_regionkey as varchar) end as value from nation, (values ('name'), ('region')) t(k)", "2.K 2.N")
def explode_map(spark, sf):
    return load(spark, sf, "nation").select("n_nationkey", F.explode(F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"))))


family("fn_map", "nation", ["n_nationkey"], [
    ("mk", "array_join(map_keys(map('a', n_regionkey, 'b', 2)), ',')", "'a,b'"), ("mv", _s("map_values(map('a', n_regionkey, 'b', 2))"), "n_regionkey || ',2'"), ("me", "map_entries(map('a', n_regionkey))[0].value", "n_regionkey"), ("mf", "map_from_arrays(array('x', 'y'), array(1, n_regionkey))['y']", "n_regionkey"), ("ea", "element_at(map('a', n_regionkey), 'a')", "n_regionkey"), ("sz", "size(map('a', 1, 'b', 2))", "2"), ("mi", "map('k', n_name)['k']", "n_name"), ("fi", "size(map_filter(map('a', 1, 'b', 2), (k, v) -> v > 1))", "1"), ("tk", "map_keys(transform_keys(map('a', 1), (k, v) -> upper(k)))[0]", "'A'"), ("tv", "transform_values(map('a', n_regionkey), (k, v) -> v + 1)['a']", "n_regionkey + 1"), ("mc", "map_concat(map('a', 1), map('b', n_regionkey))['b']", "n_regionkey"), ("ck", "map_contains_key(map('a', 1), 'a')", "true"),
], "2.K 2.N")
family("fn_struct", "nation", ["n_nationkey"], [("f", "struct(n_name, n_regionkey).n_name", "n_name"), ("g", "named_struct('x', n_regionkey, 'y', named_struct('z', n_name)).y.z", "n_name"), ("h", "array(named_struct('x', n_regionkey))[0].x", "n_regionkey")], "2.K B11")


@query("update_fields", "select n_nationkey, n_regionkey + 1 as b, n_name as c from nation", "B12")
def update_fields(spark, sf):
    s = F.struct(F.col("n_name").alias("c"), F.lit(0).alias("b"), F.lit(1).alias("gone"))
    d = load(spark, sf, "nation").withColumn("s", s.withField("b", F.col("n_regionkey") + 1).dropFields("gone"))
    return d.select("n_nationkey", F.col("s").getField("b").alias("b"), F.col("s")["c"].alias("c"))


family("fn_json", "events", ["event_id"], [
    ("g", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("fj", "from_json(props, 'k int').k", "cast(json_extract_string(props, '$.k') as int)"), ("tj", "to_json(named_struct('a', event_id, 'b', null))", "'{\"a\":' || event_id || '}'"), ("al", "json_array_length('[1,2,3]')", "3"), ("ok", "json_object_keys(props)[0]", "json_keys(props)[1]"), ("so", "schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"),
], "2.M")


@query("json_tuple", "select event_id, json_extract_string(props, '$.k') as k from events", "2.M")
def json_tuple(spark, sf):
    return load(spark, sf, "events").select("event_id", F.json_tuple("props", "k").alias("k"))


@query("json_key_counts", "select cast(json_extract_string(props, '$.k') as int) as k, count(*) as n from events group by 1", "2.M")
def json_key_counts(spark, sf):
    return load(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count("*").alias("n"))


@query("vector_norm", "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) as norm from embeddings", "2.K")
def vector_norm(spark, sf):
    sq = F.transform("embedding", lambda x: x.cast("double") * x.cast("double"))
    return load(spark, sf, "embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(sq, F.lit(0.0), lambda a, x: a + x)), 5).alias("norm"))


@query("ids_partitions", "select n_name, true as id, true as p, true as f from nation", "2.N")
def ids_partitions(spark, sf):
    return load(spark, sf, "nation").select("n_name", (F.monotonically_increasing_id() >= 0).alias("id"), (F.spark_partition_id() >= 0).alias("p"), (F.input_file_name() != "").alias("f"))
