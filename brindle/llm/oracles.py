"""Oracle SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

from brindle.llm import quality, urlfilter

_WORD = r"[^\x20\x09-\x0D]+"


def quality_sql() -> str:
    """Quality rules and host verdicts, word by word."""
    rules = list(quality.HOST_LIMITS)
    moments = ", ".join(f"sum({k}) / sum(n_docs) as m_{k}, sum({k} * {k} / n_docs) - sum({k}) * sum({k}) / sum(n_docs) as v_{k}" for k in rules)
    moments = "count(*) - 1 as df, sum(n_docs) - sum(n_docs * n_docs) / sum(n_docs) as eff, " + moments
    rho = lambda k: f"case when m_{k} * (1 - m_{k}) * (eff - df) > 0 then (v_{k} - m_{k} * (1 - m_{k}) * df) / (m_{k} * (1 - m_{k}) * (eff - df)) else 0 end"
    strength = ", ".join(f"case when {rho(k)} > 0 then least(greatest(1 / ({rho(k)}) - 1, 1.0), 1e6) else 1e6 end as s_{k}" for k in rules)

    def over(k: str) -> str:
        a, n = f"({k} + m_{k} * s_{k})", f"(n_docs + s_{k})"
        return f"{a} / {n} - {quality.Z} * sqrt({a} * ({n} - {a}) / ({n} * {n} * ({n} + 1))) > greatest(m_{k}, {quality.HOST_LIMITS[k]})"

    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t, coalesce('h' || source, '') as host from documents),
    x as (select *, regexp_extract_all(t, '{_WORD}') as words from d),
    tok as (select rid, unnest(words) as word, generate_subscripts(words, 1) as pos from x),
    win as (select rid, pos, lead(word, 2) over w as third, word || ' ' || lead(word, 1) over w || ' ' || lead(word, 2) over w as v from tok window w as (partition by rid order by pos)),
    twice as (select rid, pos, count(*) over (partition by rid, v) as c from win where third is not null),
    rep as (select rid, count(distinct pos + k) as n from twice, (values (0), (1), (2)) s(k) where c > 1 group by rid),
    ln as (select rid, count(*) - count(distinct line) as n from (select rid, unnest(string_split(t, chr(10))) as line from d) u where regexp_matches(line, '{_WORD}') group by rid),
    m as (select x.rid, doc_id, host, cast(len(words) as bigint) as n_words, cast(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) as bigint) as word_chars,
          cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, coalesce(ln.n, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words
          from x left join rep on rep.rid = x.rid left join ln on ln.rid = x.rid),
    f as (select *, cast(n_words < {quality.MIN_WORDS} as int) as short, cast(100 * n_repeat_words > 50 * n_words as int) as repeat, cast(10 * n_symbols > n_words as int) as symbols, cast(5 * n_dup_lines > n_words as int) as dup_lines from m),
    h as (select host, count(*) as n_docs, {', '.join(f'sum({k}) as {k}' for k in rules)} from f group by host),
    p as (select {moments} from h), q as (select *, {strength} from p),
    v as (select host as hh, {' or '.join(over(k) for k in rules)} as host_rejected from h, q)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short = 1 or repeat = 1 as base_failed, host_rejected, not (short = 1 or repeat = 1) and not host_rejected as kept from f join v on f.host = v.hh"""


def url_sql() -> str:
    """Path rules, then host reputation."""

    def fit(rule) -> str:
        v, h, p = rule
        return f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then "

    ordered = sorted(urlfilter.RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "case " + " ".join(f"{fit(r)}'{r[1] + r[2]}'" for r in ordered) + " end"
    verdict = "case " + " ".join(f"{fit(r)}'{r[0]}'" for r in ordered) + " end"

    second = ", ".join(f"'{x}'" for x in urlfilter.SECOND)

    def shrunk(units: str, prior: str, k: str, n: str, name: str) -> str:
        fit_ = f"select coalesce(avg({prior} * (1 - {prior})), 0) as pq, greatest(coalesce(avg(({k} / {n} - {prior}) * ({k} / {n} - {prior}) - {prior} * (1 - {prior}) / {n}), 0), 1e-6) as v from {units} where {n} > 0"
        s = "least(greatest(pq / v - 1, 1.0), 1e6)"
        a, b = f"({k} + {prior} * {s})", f"({n} - {k} + (1 - {prior}) * {s})"
        return f"select u.*, {a} / ({a} + {b}) as {name}_mean, sqrt({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1))) as {name}_sd from {units} u, ({fit_}) z"

    return f"""
    with a as (select page_id, case when url like '%://%' then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
    b as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from a),
    p as (select *, {rule} as rule, {verdict} as said from b),
    pu as (select *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.$', '') as unit from p),
    h0 as (select unit as host, count(rule) as n, coalesce(sum(case when said = 'block' then 1 else 0 end), 0) as k, string_split(unit, '.') as cut,
           case when regexp_matches(unit, '^\\[|^[0-9]+(\\.[0-9]+){{3}}$') then 0 when len(cut) >= 2 and regexp_matches(cut[-1], '^[a-z]{{2}}$') and cut[-2] in ({second}) then 2 else 1 end as labels from pu group by unit),
    h as (select host, n, k, case labels when 0 then '[address]' else array_to_string(cut[-least(labels, len(cut)):], '.') end as suffix,
          case labels when 0 then host else array_to_string(cut[-least(labels + 1, len(cut)):], '.') end as domain from h0),
    s as (select suffix, sum(n) as n, sum(k) as k, (select (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) from h) as root from h group by suffix),
    s1 as ({shrunk('s', 'root', 'k', 'n', 'suffix')}),
    d as (select domain, h.suffix, sum(h.n) as n, sum(h.k) as k, any_value(suffix_mean) as suffix_mean from h join s1 on s1.suffix = h.suffix group by domain, h.suffix),
    d1 as ({shrunk('d', 'suffix_mean', 'k', 'n', 'domain')}),
    g as (select h.host, h.n, h.k, domain_mean from h join d1 on d1.domain = h.domain),
    g1 as ({shrunk('g', 'domain_mean', 'k', 'n', 'host')})
    select page_id, p.host, path, rule, coalesce(said, case when host_mean - {urlfilter.Z} * host_sd > {urlfilter.LIMIT} then 'block' else 'allow' end) as verdict,
           round(host_mean, 9) as block_mean, round(host_mean - {urlfilter.Z} * host_sd, 9) as block_bound from pu p join g1 on g1.host = p.unit"""
