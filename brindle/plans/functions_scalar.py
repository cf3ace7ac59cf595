"""Scalar functions by family: (name, Spark expression, oracle expression or None for the same text)."""

from __future__ import annotations

from brindle.plans import run_sql
from brindle.registry import query
from brindle.tables import load


def family(name: str, table: str, keys: list[str], items: list[tuple[str, str, str | None]], tags: str, where: str | None = None, source: str | None = None) -> None:
    """One query that applies every function of a family to a table (or to an inner select of it)."""
    cond = f" where {where}" if where else ""
    origin = f"({source}) t" if source else table
    sql = f"select {', '.join(keys + [f'{o or s} as {n}' for n, s, o in items])} from {origin}{cond}"

    def run(spark, sf):
        d = run_sql(spark, sf, source) if source else load(spark, sf, table)
        return (d.where(where) if where else d).selectExpr(*keys, *[f"{s} as {n}" for n, s, _ in items])

    query(name, sql, tags)(run)


family("fn_string_case", "part", ["p_partkey"], [
    ("up", "upper(p_name)", None), ("low", "lower(p_brand)", None), ("uc", "ucase(p_name)", "upper(p_name)"), ("lc", "lcase(p_name)", "lower(p_name)"),
    ("ic", "initcap(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"),
    ("t", "trim(concat('  ', p_name, ' '))", "trim('  ' || p_name || ' ')"), ("lt", "ltrim(concat('  ', p_name))", "ltrim('  ' || p_name)"), ("rt", "rtrim(concat(p_name, '  '))", "rtrim(p_name || '  ')"), ("bt", "btrim(p_name, 'pa')", "trim(p_name, 'pa')"),
    ("rev", "reverse(p_name)", None), ("rep", "repeat(p_brand, 2)", None), ("lp", "lpad(p_brand, 12, '*')", None), ("rp", "rpad(p_brand, 12, '-')", None), ("tr", "translate(p_name, 'aeo', 'AEO')", None), ("rpl", "replace(p_name, 'a', 'bb')", None),
], "2.F")
family("fn_string_parts", "part", ["p_partkey"], [
    ("ss", "substring(p_name, 2, 3)", None), ("sb", "substr(p_name, 3)", None), ("l", "left(p_name, 3)", None), ("r", "right(p_name, 3)", None), ("sp", "split_part(p_name, ' ', 1)", None),
    ("spl", "array_join(split(p_name, ' '), '|')", "array_to_string(string_split(p_name, ' '), '|')"), ("si", "substring_index(p_name, ' ', 1)", "string_split(p_name, ' ')[1]"),
    ("ov", "overlay(p_brand placing 'Q' from 3)", "left(p_brand, 2) || 'Q' || substr(p_brand, 4)"), ("cw", "concat_ws('/', p_brand, p_type)", None), ("cc", "concat(p_brand, nullif(p_type, 'PROMO'))", "p_brand || nullif(p_type, 'PROMO')"),
    ("re", "regexp_extract(p_name, '([a-z]+)', 1)", None), ("rr", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), ("rl", "regexp_like(p_name, 'a')", "regexp_matches(p_name, 'a')"), ("rk", "rlike(p_name, '^p')", "regexp_matches(p_name, '^p')"), ("lk", "p_name like '%1%'", None),
], "2.F")
family("fn_string_measure", "part", ["p_partkey"], [
    ("n", "length(p_name)", "cast(length(p_name) as int)"), ("cl", "char_length(p_name)", "cast(length(p_name) as int)"), ("chl", "character_length(p_name)", "cast(length(p_name) as int)"), ("bl", "bit_length(p_name)", "cast(bit_length(p_name) as int)"), ("ol", "octet_length(p_name)", "cast(strlen(p_name) as int)"),
    ("ins", "instr(p_name, 'a')", "cast(instr(p_name, 'a') as int)"), ("pos", "position('a', p_name)", "cast(instr(p_name, 'a') as int)"), ("loc", "locate('a', p_name)", "cast(instr(p_name, 'a') as int)"), ("asc", "ascii(p_name)", "cast(ascii(p_name) as int)"), ("ch", "chr(65 + p_size)", "chr(cast(65 + p_size as int))"),
    ("lev", "levenshtein(p_brand, p_type)", "cast(levenshtein(p_brand, p_type) as int)"), ("sw", "startswith(p_name, 'p')", "starts_with(p_name, 'p')"), ("ew", "endswith(p_name, '1')", "ends_with(p_name, '1')"), ("ct", "contains(p_name, '2')", None),
    ("m", "md5(p_name)", None), ("s1", "sha1(p_name)", None), ("s2", "sha2(p_name, 256)", "sha256(p_name)"),
], "2.F")
family("fn_string_format", "part", ["p_partkey"], [
    ("fn", "format_number(p_retailprice, 2)", "printf('%,.2f', p_retailprice)"), ("fs", "format_string('%s-%d', p_brand, p_size)", "printf('%s-%d', p_brand, p_size)"), ("pf", "printf('%05d', p_size)", None), ("b64", "base64(cast(p_brand as binary))", "base64(p_brand::blob)"), ("ub", "cast(unbase64(base64(cast(p_brand as binary))) as string)", "p_brand"),
    ("enc", "hex(encode(p_brand, 'UTF-8'))", "hex(p_brand)"), ("dec", "decode(encode(p_brand, 'UTF-8'), 'UTF-8')", "p_brand"), ("tn", "to_number('1,234.50', '9,999.99')", "cast(1234.50 as decimal(6,2))"), ("tc", "to_char(p_size, '999')", "lpad(cast(p_size as varchar), 3, ' ')"),
], "2.F 2.N")

# the codes of the six types, by the rules of soundex
SOUNDEX = {"ECONOMY": "E255", "LARGE": "L620", "MEDIUM": "M350", "PROMO": "P650", "SMALL": "S540", "STANDARD": "S353"}
query("fn_soundex", f"select p_partkey, case p_type {' '.join(f"when '{k}' then '{v}'" for k, v in SOUNDEX.items())} end as sx from part", "2.F")(lambda spark, sf: load(spark, sf, "part").selectExpr("p_partkey", "soundex(p_type) as sx"))

_X = "l_quantity"
family("fn_math", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [
    ("ab", "abs(l_tax - 0.05)", None), ("ce", "ceil(l_extendedprice)", "cast(ceil(l_extendedprice) as bigint)"), ("cg", "ceiling(l_extendedprice)", "cast(ceil(l_extendedprice) as bigint)"), ("fl", "floor(l_extendedprice)", "cast(floor(l_extendedprice) as bigint)"), ("ro", "round(l_extendedprice, 0)", None), ("br", "bround(l_quantity / 2)", "round_even(l_quantity / 2, 0)"),
    ("sq", "round(sqrt(l_quantity), 9)", None), ("po", "round(pow(l_quantity, 1.5), 4)", None), ("pw", "power(l_linenumber, 2)", None), ("ex", "round(exp(l_tax), 9)", None), ("em", "round(expm1(l_tax), 9)", "round(exp(l_tax) - 1, 9)"), ("lg", "round(log(l_quantity), 9)", "round(ln(l_quantity), 9)"), ("ln", "round(ln(l_quantity), 9)", None), ("l10", "round(log10(l_quantity), 9)", None), ("l2", "round(log2(l_quantity), 9)", None),
    ("cb", "round(cbrt(l_quantity), 8)", None), ("hy", "round(hypot(l_quantity, l_tax), 8)", "round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 8)"), ("sg", "sign(l_tax - 0.04)", "cast(sign(l_tax - 0.04) as double)"), ("su", "signum(l_tax - 0.04)", "cast(sign(l_tax - 0.04) as double)"), ("ng", "negative(l_quantity)", "-l_quantity"), ("ps", "positive(l_quantity)", "l_quantity"), ("pm", "pmod(-l_orderkey, 7)", "((-l_orderkey % 7) + 7) % 7"), ("fa", "factorial(l_linenumber)", "cast(factorial(l_linenumber) as bigint)"),
    ("gr", "greatest(l_quantity, 20.0, nullif(l_tax, 0))", None), ("le", "least(l_quantity, 20.0, nullif(l_tax, 0))", None), ("wb", "width_bucket(l_quantity, 0.0, 50.0, 5)", "cast(case when l_quantity < 0 then 0 when l_quantity >= 50 then 6 else floor(l_quantity / 10) + 1 end as bigint)"),
], "2.G")
family("fn_trig", "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"], [(f, f"round({f}(l_tax), 9)", None) for f in "sin cos tan asin acos atan sinh cosh tanh degrees radians".split()] + [("at2", "round(atan2(l_tax, l_quantity), 9)", None), ("pie", "round(pi(), 9)", None), ("eul", "round(e(), 9)", "round(exp(1), 9)")], "2.G")
family("fn_bits", "orders", ["o_orderkey"], [
    ("bi", "bin(o_orderkey)", None), ("hx", "hex(o_orderkey)", None), ("uh", "decode(unhex('41'), 'UTF-8')", "'A'"), ("bc", "bit_count(o_orderkey)", "cast(bit_count(o_orderkey) as int)"), ("bg", "bit_get(o_orderkey, 1)", "cast((o_orderkey >> 1) & 1 as tinyint)"), ("gb", "getbit(o_orderkey, 0)", "cast(o_orderkey & 1 as tinyint)"), ("sl", "shiftleft(o_orderkey, 2)", "o_orderkey * 4"), ("sr", "shiftright(o_orderkey, 2)", "o_orderkey >> 2"), ("su", "shiftrightunsigned(-o_orderkey - 1, 60)", "cast(15 as bigint)"),
], "2.G")
query("fn_random", None, "2.G")(lambda spark, sf: load(spark, sf, "region").selectExpr("r_regionkey", "rand(7) as r", "random(7) as r2", "randn(7) as g", "uuid() is not null as u"))

family("fn_date_parts", "orders", ["o_orderkey"], [(f, f"{f}(o_orderdate)", f"cast({f}(o_orderdate) as int)") for f in "year month day dayofmonth dayofyear hour minute second quarter weekofyear".split()] + [
    ("dow", "dayofweek(o_orderdate)", "cast(dayofweek(o_orderdate) + 1 as int)"), ("wd", "weekday(o_orderdate)", "cast(isodow(o_orderdate) - 1 as int)"), ("dn", "dayname(o_orderdate)", "left(dayname(o_orderdate), 3)"), ("mn", "monthname(o_orderdate)", "left(monthname(o_orderdate), 3)"),
], "2.H")
_D = "cast(o_orderdate as date)"
family("fn_date_arith", "orders", ["o_orderkey"], [
    ("da", f"date_add({_D}, 10)", f"{_D} + 10"), ("ds", f"date_sub({_D}, 10)", f"{_D} - 10"), ("dd", f"datediff({_D}, date '1995-01-01')", f"cast({_D} - date '1995-01-01' as int)"), ("am", f"add_months({_D}, 5)", f"cast({_D} + interval 5 month as date)"),
    ("mb", f"round(months_between({_D}, date '1995-01-01'), 6)", f"round(case when {_D} = last_day({_D}) and false then 0 else (year({_D}) - 1995) * 12 + month({_D}) - 1 + (day({_D}) - 1) / 31.0 end, 6)"),
    ("ld", f"last_day({_D})", None), ("nd", f"next_day({_D}, 'MON')", f"cast({_D} + cast(8 - isodow({_D}) as int) as date)"), ("tr", f"trunc({_D}, 'MM')", f"cast(date_trunc('month', {_D}) as date)"), ("dt", "cast(date_trunc('YEAR', o_orderdate) as date)", "cast(date_trunc('year', o_orderdate) as date)"),
    ("md", "make_date(2020, 2, cast(o_orderkey % 28 + 1 as int))", "make_date(2020, 2, cast(o_orderkey % 28 + 1 as int))"), ("mt", "cast(make_timestamp(2020, 2, 3, 4, 5, 6) as timestamp_ntz)", "make_timestamp(2020, 2, 3, 4, 5, 6)"),
], "2.H")
family("fn_date_text", "orders", ["o_orderkey"], [
    ("df", "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"), ("td", "to_date('2021-03-04')", "date '2021-03-04'"), ("tf", "to_date('04/03/2021', 'dd/MM/yyyy')", "date '2021-03-04'"), ("tt", "cast(to_timestamp('2021-03-04 05:06:07') as timestamp_ntz)", "timestamp '2021-03-04 05:06:07'"),
    ("ut", "unix_timestamp(o_orderdate)", "cast(epoch(o_orderdate) as bigint)"), ("fu", "from_unixtime(o_orderkey)", "strftime(make_timestamp(o_orderkey * 1000000), '%Y-%m-%d %H:%M:%S')"),
], "2.H")
query("fn_now", "select true as d, true as t, true as n", "2.H")(
    lambda spark, sf: spark.range(1).selectExpr("abs(datediff(current_date(), cast(now() as date))) <= 1 as d", "current_timestamp() >= timestamp '2024-01-01' as t", "now() = current_timestamp() as n")
)
family("fn_null", "orders", ["o_orderkey"], [
    ("co", "coalesce(nullif(o_orderstatus, 'F'), '?')", None), ("nv", "nvl(nullif(o_orderstatus, 'F'), '?')", "coalesce(nullif(o_orderstatus, 'F'), '?')"), ("ifn", "ifnull(nullif(o_orderstatus, 'F'), '?')", None), ("isn", "isnull(nullif(o_orderstatus, 'F'))", "nullif(o_orderstatus, 'F') is null"), ("inn", "isnotnull(nullif(o_orderstatus, 'F'))", "nullif(o_orderstatus, 'F') is not null"),
    ("n2", "nvl2(nullif(o_orderstatus, 'F'), 1, 0)", "case when nullif(o_orderstatus, 'F') is not null then 1 else 0 end"), ("nn", "nanvl(if(o_orderstatus = 'F', double('NaN'), 1.0D), 2.0D)", "case when o_orderstatus = 'F' then 2.0::double else 1.0::double end"), ("i", "if(o_totalprice > 100000, 'big', 'small')", "case when o_totalprice > 100000 then 'big' else 'small' end"), ("na", "isnan(o_totalprice)", None),
], "2.L")
