"""Independent DuckDB SQL for every query of the catalogue (the correctness oracle).

Each entry is one standalone statement over the driver's pre-registered
tables: the role views and every intermediate dataset are CTEs. Statistics
use DuckDB's ``lgamma`` and list lambdas: the chi-square / normal tails are
Q(a, x), below a + 1 from a series in log space and above from a continued fraction, the Fisher tests
enumerate table supports. Doubles are rounded to 6 places on both sides; tails are
also compared as ln p, so that small ones are tested too.
"""

from __future__ import annotations

# ------------------------------------------------------------------ role views

ROLE_CTES = {
    "master_raw": """
  select o_orderkey as uid,
    case when o_orderkey % 17 = 0 then null else o_custkey end as sire,
    nullif(o_orderpriority, '4-NOT SPECIFIED') as dam,
    cast(year(o_orderdate) as int) as yob,
    case when n_nationkey % 2 = 0 then '  ' || lower(n_name) || ' ' else n_name end as col_area
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "gen_parent": """
  select 'UID_' || cast(event_id as varchar) as id,
    case when event_id % 19 = 0 then null else cast(user_id as varchar) end as sire,
    nullif(event_type, 'error') as dam
  from events where event_id % 10 <> 0""",
    "gen_meta": """
  select 'UID_' || cast(event_id as varchar) as uid,
    cast(null as varchar) as sire, cast(null as varchar) as dam,
    case when event_id % 23 = 0 then 'N/A' when event_id % 29 = 0 then null
         else cast(day(ts) as varchar) end as yrborn,
    case when event_id % 31 = 0 then null
         else 'nation_' || cast(user_id % 25 as varchar) end as col_area,
    case when event_id % 2 = 0 then 'F' else 'M' end as sex
  from events where event_id % 7 <> 0 or event_id % 10 = 0""",
    "places": """
  select lower(n_name) as col_area,
    case when n_regionkey in (0, 1) then 'Upper Valley' else 'Lower Valley' end as valley
  from nation where n_regionkey <> 4""",
    "places_written": """
  select case when n_nationkey % 2 = 0 then '  ' || lower(n_name) || ' ' else n_name end as col_area,
    case when n_regionkey in (0, 1) then 'Upper Valley' else 'Lower Valley' end as valley
  from nation where n_regionkey <> 4""",
    "places_small": """
  select 'nation_' || cast(n_nationkey as varchar) as col_area,
    case when n_regionkey in (0, 1) then 'Upper Valley' else 'Lower Valley' end as valley
  from nation where n_regionkey <> 4""",
}

WS = "'^[ \\t\\r\\n]+|[ \\t\\r\\n]+$'"


def trimws(x: str) -> str:
    return f"regexp_replace({x}, {WS}, '', 'g')"


def lchoose(n: str, k: str) -> str:
    return f"(lgamma(({n}) + 1) - lgamma(({k}) + 1) - lgamma(({n}) - ({k}) + 1))"


def gamma_q(a: str, x: str) -> str:
    """Q(a, x): 1 - P with P = sum_j exp(-x + (a+j) ln x - lgamma(a+j+1)) below a + 1;
    above it the upper tail itself, by Gauss' continued fraction evaluated from depth 400
    (b_i = x + 2i + 1 - a, a_i = i (a - i)), so that small tails keep their digits.

    The lambda variables have names no column uses, so they never shadow one."""
    return (f"(case when isnan({x}) then 'nan'::double when ({x}) <= 0 then 1.0 when ({x}) < ({a}) + 1 then greatest(0.0, 1.0 - list_sum(list_transform("
            f"range(0, cast(({x}) + 20 * sqrt({x}) + 60 as bigint)), "
            f"lambda q_term: exp(-({x}) + (({a}) + q_term) * ln({x}) - lgamma(({a}) + q_term + 1))))) "
            f"else exp(-({x}) + ({a}) * ln({x}) - lgamma({a})) / (({x}) + 1 - ({a}) + list_reduce(list_transform(range(400, 0, -1), "
            f"lambda q_depth: cast(q_depth as double)), lambda q_tail, q_depth: q_depth * (({a}) - q_depth) / "
            f"(({x}) + 2 * q_depth + 1 - ({a}) + q_tail), 0.0)) end)")


def ln_p(p: str) -> str:
    """ln p to 6 places: six digits of p itself, however small."""
    return f"case when ({p}) > 0 then round(ln({p}), 6) end"


def chisq_sf(stat: str, df: str) -> str:
    return gamma_q(f"(({df}) / 2.0)", f"(({stat}) / 2.0)")


def norm_two_sided(z: str) -> str:
    return gamma_q("0.5", f"(({z}) * ({z}) / 2.0)")


# ------------------------------------------------------------------ datasets

SMALL = {
    "parent_new": "select regexp_replace(id, '^(UID_){1,2}', '') as uid, sire, dam from gen_parent",
    "small_ped": ("select regexp_replace(uid, '^(UID_){1,2}', '') as uid, sire, dam, yrborn, col_area, sex "
                  "from gen_meta"),
    "merged": """
  select coalesce(p.uid, s.uid) as uid, p.sire as sire_x, p.dam as dam_x, s.sire as sire_y, s.dam as dam_y,
         s.yrborn, s.col_area, s.sex
  from parent_new p full outer join small_ped s on p.uid is not distinct from s.uid""",
    "clean": """
  select regexp_replace(uid, '^UID_', '') as uid, dam_x as dam, sire_x as sire,
         nullif(yrborn, 'N/A') as yrborn, col_area
  from merged where sire_x is not null and nullif(yrborn, 'N/A') is not null""",
    "unique_matings": "select distinct uid, sire_x, dam_x, yrborn from merged",
    "sdy": ("select distinct sire_x, dam_x, yrborn from merged "
            "where sire_x is not null and dam_x is not null and yrborn is not null"),
    "cls": """
  select sire_x, yrborn, cast(count(*) as bigint) as n_dams,
         case when count(*) > 1 then 'Polygynous' else 'Monogamous' end as strategy
  from sdy group by sire_x, yrborn""",
    "ssa": """
  select sire, yrborn, case when count(distinct dam) > 1 then 'Polygynous' else 'Monogamous' end as strategy
  from clean where sire is not null and dam is not null and yrborn is not null group by sire, yrborn""",
    "os": """
  select uid, dam, sire, yrborn, col_area, strategy from (
    select c.uid, c.dam, c.sire, c.yrborn, c.col_area, s.strategy,
           row_number() over (partition by c.uid order by c.yrborn nulls first, c.sire nulls first,
                              c.dam nulls first, c.col_area nulls first, s.strategy nulls first) as rn
    from clean c join ssa s on c.sire = s.sire and c.yrborn = s.yrborn) where rn = 1""",
    "vt_rows": "select distinct dam_x, sire_x, yrborn, col_area, sex from merged",
    "sire_flags": """
  select sire_x as s, max(case when strategy = 'Polygynous' then 1 else 0 end) as sp,
         max(case when strategy = 'Monogamous' then 1 else 0 end) as sm from cls group by sire_x""",
    "year_flags": """
  select yrborn as y, max(case when strategy = 'Polygynous' then 1 else 0 end) as yp,
         max(case when strategy = 'Monogamous' then 1 else 0 end) as ym from cls group by yrborn""",
    "vt": """
  select r.*, case when sf.sp = 1 and yf.yp = 1 then 'Polygynous'
                   when sf.sm = 1 and yf.ym = 1 then 'Monogamous' end as strategy
  from vt_rows r left join sire_flags sf on r.sire_x = sf.s left join year_flags yf on r.yrborn = yf.y""",
    "types_small": """
  select v.dam_x, v.sire_x, v.yrborn, v.col_area, v.sex, v.strategy, coalesce(p.valley, 'Other') as valley
  from vt v left join places_small p on v.col_area = p.col_area where v.strategy is not null""",
    "vt_pair": """
  select v.dam_x, v.sire_x, v.yrborn, v.col_area, v.sex, c.strategy, coalesce(p.valley, 'Other') as valley
  from vt_rows v join cls c on v.sire_x = c.sire_x and v.yrborn = c.yrborn
  left join places_small p on v.col_area = p.col_area""",
    "sl_mating": """
  select sire_x, yr as yrborn, cast(count(distinct dam_x) as bigint) as n_dams,
         case when count(distinct dam_x) > 1 then 'Polygynous' else 'Monogamous' end as strategy,
         case when count(distinct dam_x) > 1 then 1 else 0 end as strategy_bin
  from (select sire_x, dam_x, try_cast(nullif(yrborn, 'N/A') as double) as yr from unique_matings)
  where yr is not null and sire_x is not null and dam_x is not null group by sire_x, yr""",
    "pby": "select yrborn, strategy, cast(sum(n_dams) as bigint) as n_dams from cls group by yrborn, strategy",
    "yv": "select yrborn, valley, strategy, count(*) as n from types_small group by yrborn, valley, strategy",
    "yv_wide": """
  select yrborn, valley,
         cast(coalesce(sum(case when strategy = 'Monogamous' then n end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when strategy = 'Polygynous' then n end), 0) as bigint) as Polygynous
  from yv group by yrborn, valley""",
    "vs": "select valley, strategy, count(*) as n_individuals from types_small group by valley, strategy",
}

MASTER = {
    "m_known": "select * from master_raw where sire is not null and yob is not null",
    "m_groups": """
  select sire, yob, count(*) as n_rows,
         case when count(distinct dam) + max(case when dam is null then 1 else 0 end) > 1
              then 'Polygynous' else 'Monogamous' end as strategy
  from m_known group by sire, yob""",
    "combined_counts": """
  select yob, cast(sum(n_rows) as bigint) as count, strategy as type from m_groups group by yob, strategy""",
    "master_level": """
  select sire, yob, cast(count(distinct dam) as bigint) as n_dams,
         case when count(distinct dam) > 1 then 'Polygynous' else 'Monogamous' end as strategy,
         case when count(distinct dam) > 1 then 1 else 0 end as strategy_bin
  from master_raw where sire is not null and yob is not null and dam is not null group by sire, yob""",
    "fixed": f"select uid, sire, dam, yob, {trimws('lower(col_area)')} as col_area from master_raw",
    "ctm_rows": """
  select r.dam, r.sire, r.yob, r.col_area, p.valley
  from (select distinct dam, sire, yob, col_area from fixed) r join places p on r.col_area = p.col_area""",
    "m_sire_flags": """
  select sire as s, max(case when strategy = 'Polygynous' then 1 else 0 end) as sp,
         max(case when strategy = 'Monogamous' then 1 else 0 end) as sm from m_groups group by sire""",
    "m_year_flags": """
  select yob as y, max(case when strategy = 'Polygynous' then 1 else 0 end) as yp,
         max(case when strategy = 'Monogamous' then 1 else 0 end) as ym from m_groups group by yob""",
    "types_master": """
  select * from (
    select r.dam, r.sire, r.yob, r.col_area,
           case when sf.sp = 1 and yf.yp = 1 then 'Polygynous'
                when sf.sm = 1 and yf.ym = 1 then 'Monogamous' end as strategy, r.valley
    from ctm_rows r left join m_sire_flags sf on r.sire = sf.s left join m_year_flags yf on r.yob = yf.y)
  where strategy is not null""",
    "ccm": """
  select f.yob, f.col_area, g.strategy, cast(count(*) as bigint) as count
  from (select * from fixed where sire is not null and yob is not null) f
  join m_groups g on f.sire = g.sire and f.yob = g.yob group by f.yob, f.col_area, g.strategy""",
    "scm": "select col_area, strategy, count(*) as n_individuals from ccm group by col_area, strategy",
    "svm": "select valley, strategy, count(*) as n_individuals from types_master group by valley, strategy",
    "svym": "select valley, yob, strategy, count(*) as n_individuals from types_master group by valley, yob, strategy",
    "svym_wide": """
  select yob, valley,
         cast(coalesce(sum(case when strategy = 'Monogamous' then n_individuals end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when strategy = 'Polygynous' then n_individuals end), 0) as bigint) as Polygynous
  from svym group by yob, valley""",
}

# the first script's form: sire, year and dam known, colony text as written
MASTER |= {
    "fixed_a": "select * from master_raw where sire is not null and yob is not null and dam is not null",
    "groups_a": """
  select sire, yob, case when count(distinct dam) > 1 then 'Polygynous' else 'Monogamous' end as strategy
  from fixed_a group by sire, yob""",
    "ccm_a": """
  select f.yob, f.col_area, g.strategy, cast(count(*) as bigint) as count
  from fixed_a f join groups_a g on f.sire = g.sire and f.yob = g.yob group by f.yob, f.col_area, g.strategy""",
    "scm_a": "select col_area, strategy, count(*) as n_individuals from ccm_a group by col_area, strategy",
    "types_a": """
  select * from (
    select r.dam, r.sire, r.yob, r.col_area,
           case when sf.sp = 1 and yf.yp = 1 then 'Polygynous'
                when sf.sm = 1 and yf.ym = 1 then 'Monogamous' end as strategy, p.valley
    from (select distinct dam, sire, yob, col_area from fixed_a) r join places_written p on r.col_area = p.col_area
    left join m_sire_flags sf on r.sire = sf.s left join m_year_flags yf on r.yob = yf.y)
  where strategy is not null""",
    "svm_a": "select valley, strategy, count(*) as n_individuals from types_a group by valley, strategy",
    "svym_a": "select valley, yob, strategy, count(*) as n_individuals from types_a group by valley, yob, strategy",
    "svym_wide_a": """
  select yob, valley,
         cast(coalesce(sum(case when strategy = 'Monogamous' then n_individuals end), 0) as bigint) as Monogamous,
         cast(coalesce(sum(case when strategy = 'Polygynous' then n_individuals end), 0) as bigint) as Polygynous
  from svym_a group by yob, valley""",
}

_ORDER = (["master_raw", "gen_parent", "gen_meta", "places", "places_written", "places_small"]
          + list(SMALL) + list(MASTER))


def _deps(body: str, known: dict) -> set[str]:
    import re
    words = set(re.findall(r"[A-Za-z_][A-Za-z0-9_]*", body))
    return {k for k in known if k in words}


def build(select: str, extra: dict | None = None) -> str:
    """A full statement: the CTEs ``select`` needs (transitively), then ``select``."""
    allc = {**ROLE_CTES, **SMALL, **MASTER, **(extra or {})}
    order = _ORDER + [k for k in (extra or {}) if k not in _ORDER]
    need: set[str] = set()
    todo = list(_deps(select, allc))
    while todo:
        k = todo.pop()
        if k in need:
            continue
        need.add(k)
        todo.extend(_deps(allc[k], allc) - need - {k})
    ctes = [f"{k} as ({allc[k]}\n)" for k in order if k in need]
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + select


# ------------------------------------------------------------------ test blocks

def chisq_sql(cells: str, row: str, col: str, n: str, residuals: bool = False) -> str:
    """Chi-square over a long zero-filled cell CTE ``cells`` (row, col, n)."""
    base = f"""
  select {row} as r, {col} as c, cast({n} as double) as o,
         sum(cast({n} as double)) over (partition by {row}) as rt,
         sum(cast({n} as double)) over (partition by {col}) as ct,
         sum(cast({n} as double)) over () as nt,
         count(distinct {row}) over () + max(case when {row} is null then 1 else 0 end) over () as nr,
         count(distinct {col}) over () + max(case when {col} is null then 1 else 0 end) over () as nc
  from {cells}"""
    if residuals:
        return f"""
select r as {row}, c as {col}, cast(o as bigint) as observed, round(rt * ct / nt, 6) as expected,
       round((o - rt * ct / nt) / sqrt((rt * ct / nt) * (1 - rt / nt) * (1 - ct / nt)), 6) as stdres
from ({base})"""
    dev = "abs(o - rt * ct / nt)"
    term = (f"case when nr = 2 and nc = 2 then power({dev} - least(0.5, {dev}), 2) / (rt * ct / nt) "
            f"else power({dev}, 2) / (rt * ct / nt) end")
    return f"""
select round(x2, 6) as statistic, cast(df as int) as df, round({chisq_sf('x2', 'df')}, 6) as p_value,
       {ln_p(chisq_sf('x2', 'df'))} as ln_p, cast(nr as int) as n_rows, cast(nc as int) as n_cols
from (select sum({term}) as x2, any_value((nr - 1) * (nc - 1)) as df, any_value(nr) as nr,
             any_value(nc) as nc from ({base}))"""


def long_cells(wide: str, keys: str) -> str:
    return (f"select {keys}, 'Monogamous' as strategy, Monogamous as n from {wide} union all "
            f"select {keys}, 'Polygynous' as strategy, Polygynous as n from {wide}")


def fisher_2x2_sql(a: str, b: str, c: str, d: str) -> str:
    r1, r2, k = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    n = f"({r1} + {r2})"

    def lp(x):
        return f"({lchoose(r1, x)} + {lchoose(r2, f'{k} - {x}')} - {lchoose(n, k)})"

    return (f"least(1.0, list_sum(list_transform(range(greatest(0, {k} - {r2}), least({r1}, {k}) + 1), "
            f"lambda x: case when {lp('x')} <= {lp(a)} + ln(1 + 1e-7) then exp({lp('x')}) else 0 end)))")


def rank_sum_sql(cells: str, group: str, level: str, value: str) -> str:
    z = "((w - nx * ny / 2.0 - sign(w - nx * ny / 2.0) * 0.5) / sqrt(var))"
    p = norm_two_sided(z)
    return f"""
with rk as (
  select {group} as g, {level} as lvl, cast({value} as double) as v,
         rank() over (partition by {group} order by {value}) + (count(*) over (partition by {group}, {value}) - 1) / 2.0 as ar,
         count(*) over (partition by {group}, {value}) as t
  from {cells}),
agg as (
  select g, count(distinct lvl) as nl,
         cast(sum(case when lvl = 'Monogamous' then 1 else 0 end) as double) as nx,
         cast(sum(case when lvl = 'Monogamous' then 0 else 1 end) as double) as ny,
         sum(case when lvl = 'Monogamous' then ar else 0 end) as rx,
         sum(t * t - 1.0) as ties
  from rk group by g),
st as (
  select g, nl, nx, ny, rx - nx * (nx + 1) / 2.0 as w,
         nx * ny / 12.0 * ((nx + ny + 1) - ties / ((nx + ny) * (nx + ny - 1))) as var
  from agg),
pv as (select g, nl, w, case when nl > 1 then {p} end as p from st)
select g as {group}, round(p, 6) as p_value, {ln_p('p')} as ln_p, case when nl > 1 then round(w, 6) end as W,
       case when p is not null and not isnan(p) and p < 0.05 then 'Yes' else 'No' end as Significant
from pv"""


def fisher_rx3_sql(wide: str, group: str, row: str, c1: str, c2: str) -> str:
    """Exact r x 2 Fisher per group for tables of at most three rows."""
    lp = (f"({lchoose('r1', 'i')} + {lchoose('r2', 'j')} + {lchoose('r3', 'k - i - j')} - {lchoose('n', 'k')})")
    lp_obs = (f"({lchoose('r1', 'x1')} + {lchoose('r2', 'x2')} + {lchoose('r3', 'x3')} - {lchoose('n', 'k')})")
    return f"""
with rr as (
  select {group} as g, row_number() over (partition by {group} order by {row}) as rk,
         cast({c1} as bigint) as x, cast({c1} + {c2} as bigint) as r
  from {wide}),
t as (
  select g, count(*) as nrows,
         coalesce(max(case when rk = 1 then x end), 0) as x1, coalesce(max(case when rk = 1 then r end), 0) as r1,
         coalesce(max(case when rk = 2 then x end), 0) as x2, coalesce(max(case when rk = 2 then r end), 0) as r2,
         coalesce(max(case when rk = 3 then x end), 0) as x3, coalesce(max(case when rk = 3 then r end), 0) as r3
  from rr group by g),
t2 as (select *, x1 + x2 + x3 as k, r1 + r2 + r3 as n from t),
e1 as (select *, unnest(range(0, r1 + 1)) as i from t2),
e2 as (select *, unnest(range(0, r2 + 1)) as j from e1),
e3 as (select * from e2 where k - i - j between 0 and r3),
p as (
  select g, any_value(nrows) as nrows,
         least(1.0, sum(case when {lp} <= {lp_obs} + ln(1 + 1e-7) then exp({lp}) else 0 end)) as p
  from e3 group by g)
"""


def _irls_sql(src: str, x: str, y: str) -> str:
    """Logistic Newton steps on grouped (x, n, s) rows as a recursive CTE, the predictor centred and scaled, until the score per
    trial is below 1e-12; ``fin`` has the coefficients, their variances, the deviance, the counts and the steps."""
    sums = """sum(q) as s00, sum(q * z) as s01, sum(q * z * z) as s11, sum(s - n * p) as u0, sum((s - n * p) * z) as u1,
               sum(s * e - n * (greatest(e, 0) + ln(1 + exp(-abs(e))))) as ll"""
    at = """(select it.i, it.a0, it.a1, g.n, g.s, g.z, it.a0 + it.a1 * g.z as e, 1 / (1 + exp(-(it.a0 + it.a1 * g.z))) as p,
                    g.n / (1 + exp(-(it.a0 + it.a1 * g.z))) / (1 + exp(it.a0 + it.a1 * g.z)) as q from it, g)"""
    return f"""
with recursive c as (
  select cast({x} as double) as x, cast(count(*) as double) as n, cast(sum({y}) as double) as s
  from {src} where {x} is not null and {y} is not null group by {x}),
m as (select sum(n * x) / sum(n) as centre, max(x) - min(x) as scale, sum(n) as tn, sum(s) as ts from c),
g as (select (x - centre) / scale as z, n, s from c, m),
it(i, a0, a1) as (
  select 0, ln(ts / (tn - ts)), 0.0::double from m
  union all
  select i + 1, a0 + (s11 * u0 - s01 * u1) / (s00 * s11 - s01 * s01), a1 + (s00 * u1 - s01 * u0) / (s00 * s11 - s01 * s01)
  from (select i, a0, a1, {sums} from {at} group by i, a0, a1), m
  where i < 60 and greatest(abs(u0), abs(u1)) > 1e-12 * tn),
fin as (
  select a0 - a1 * centre / scale as b0, a1 / scale as b1, i as steps, -2 * ll as dev, tn as n, ts as sy,
         (s11 + 2 * s01 * centre / scale + s00 * centre * centre / (scale * scale)) / (s00 * s11 - s01 * s01) as v0,
         s00 / (s00 * s11 - s01 * s01) / (scale * scale) as v1
  from (select i, a0, a1, {sums} from {at} group by i, a0, a1 order by i desc limit 1), m)"""


def logit_sql(src: str, x: str, y: str, name: str) -> str:
    se0, se1 = "sqrt(v0)", "sqrt(v1)"
    return "select * from (" + _irls_sql(src, x, y) + f"""
select '(Intercept)' as term, round(b0, 6) as estimate, round({se0}, 6) as std_error,
       round(b0 / {se0}, 6) as z_value, round({norm_two_sided(f'(b0 / {se0})')}, 6) as p_value,
       {ln_p(norm_two_sided(f'(b0 / {se0})'))} as ln_p from fin
union all
select '{name}' as term, round(b1, 6) as estimate, round({se1}, 6) as std_error,
       round(b1 / {se1}, 6) as z_value, round({norm_two_sided(f'(b1 / {se1})')}, 6) as p_value,
       {ln_p(norm_two_sided(f'(b1 / {se1})'))} as ln_p from fin)"""


def logit_summary_sql(src: str, x: str, y: str, dataset: str) -> str:
    """Deviances, degrees of freedom and AIC of the fit (0/1 response: the saturated likelihood is 1)."""
    null_dev = "(-2 * (sy * ln(sy / n) + (n - sy) * ln(1 - sy / n)))"
    return "select * from (" + _irls_sql(src, x, y) + f"""
select '{dataset}' as dataset, round({null_dev}, 6) as null_deviance, round(n - 1, 6) as null_df, round(dev, 6) as deviance,
       round(n - 2, 6) as resid_df, round(dev + 4, 6) as aic, steps, true as converged, false as separated from fin)"""


def deviance_sql(src: str, x: str, y: str, name: str, dataset: str) -> str:
    null_dev = "(-2 * (sy * ln(sy / n) + (n - sy) * ln(1 - sy / n)))"
    return "select * from (" + _irls_sql(src, x, y) + f"""
select 'NULL' as term, cast(null as integer) as df, cast(null as double) as deviance,
       round(n - 1, 6) as resid_df, round({null_dev}, 6) as resid_dev, cast(null as double) as p_value,
       '{dataset}' as dataset from fin
union all
select '{name}' as term, 1 as df, round({null_dev} - dev, 6) as deviance, round(n - 2, 6) as resid_df,
       round(dev, 6) as resid_dev, round({chisq_sf(f'({null_dev} - dev)', '1')}, 6) as p_value,
       '{dataset}' as dataset from fin)"""


def fisher_r4_sql(wide: str, group: str, row: str, c1: str, c2: str) -> str:
    """Exact r x 2 Fisher per group for tables of at most four rows (enumeration)."""
    rows = range(1, 5)
    lp = " + ".join(lchoose(f"r{i}", v) for i, v in zip(rows, ["i", "j", "l", "k - i - j - l"])) \
        + " - " + lchoose("n", "k")
    lp_obs = " + ".join(lchoose(f"r{i}", f"x{i}") for i in rows) + " - " + lchoose("n", "k")
    picks = ",\n".join(
        f"coalesce(max(case when rk = {i} then x end), 0) as x{i}, coalesce(max(case when rk = {i} then r end), 0) as r{i}"
        for i in rows)
    return f"""
with rr as (
  select {group} as g, row_number() over (partition by {group} order by {row}) as rk,
         cast({c1} as bigint) as x, cast({c1} + {c2} as bigint) as r
  from {wide}),
t as (select g, count(*) as nrows, {picks} from rr group by g),
t2 as (select *, x1 + x2 + x3 + x4 as k, r1 + r2 + r3 + r4 as n from t),
e1 as (select *, unnest(range(0, r1 + 1)) as i from t2),
e2 as (select *, unnest(range(0, r2 + 1)) as j from e1 where i <= k),
e3 as (select *, unnest(range(0, r3 + 1)) as l from e2 where i + j <= k),
e4 as (select * from e3 where k - i - j - l between 0 and r4),
p as (
  select g, any_value(nrows) as nrows,
         least(1.0, sum(case when {lp} <= {lp_obs} + ln(1 + 1e-7) then exp({lp}) else 0 end)) as p
  from e4 group by g)
"""


def fisher_halves_sql(src: str, c1: str, c2: str, B: int = 100_000) -> str:
    """Exact r x 2 Fisher test for any number of rows: ways to reach (sum, product of binomial coefficients) in the first and in the
    second half of the rows, row after row, then both halves lined up per sum. The Monte-Carlo estimate is expected near it."""
    walk = """select {n}.i + 1, {n}.s + y, round(v + lb, 9), sum(c) from {n}, m, pm
  where pm.i = {n}.i + 1 + {skip} and {n}.i < {rows} and {n}.s + y <= m.k group by all"""
    return f"""
with recursive z as (
  select row_number() over (order by {c1} + {c2}, {c1}) as i, cast({c1} as bigint) as x, cast({c1} + {c2} as bigint) as r
  from {src} where {c1} + {c2} > 0),
m as (select count(*) as n, count(*) // 2 as h, sum(x) as k, sum(r) as total, sum({lchoose('r', 'x')}) as observed,
             sum(lgamma(x + 1) + lgamma(r - x + 1)) as statistic from z),
pm as (select z.i, y, {lchoose('r', 'y')} as lb from z, unnest(range(0, r + 1)) as u(y)),
a(i, s, v, c) as (
  select 0::bigint, 0::hugeint, 0.0::double, 1.0::double union all {walk.format(n='a', skip='0', rows='m.h')}),
b(i, s, v, c) as (
  select 0::bigint, 0::hugeint, 0.0::double, 1.0::double union all {walk.format(n='b', skip='m.h', rows='m.n - m.h')}),
met as (
  select s, observed + ln(1 + 1e-7) - v as pos, 1 as side, c * exp(v - {lchoose('total', 'k')} / 2) as w from a, m where i = h
  union all
  select k - s as s, v as pos, 0 as side, c * exp(v - {lchoose('total', 'k')} / 2) as w from b, m where i = n - h),
tails as (
  select side, w * sum(case when side = 0 then w else 0 end) over (partition by s order by pos, side rows unbounded preceding) as mass from met)
select round(least(1.0, (select sum(mass) from tails where side = 1)), 6) as exact_p, cast(n as integer) as n_rows, round(statistic, 6) as statistic,
       cast({B} as bigint) as B, true as within_four_se from m"""


def mixed_logit_sql(src: str, group: str, factor: str, failures: str, successes: str) -> str:
    """Random-intercept logistic fit (Laplace) for a factor of two levels, with nothing but likelihood values: at each outer step the
    likelihood is evaluated on a stencil around the parameters (the modes of the groups by Newton steps inside), differences give gradient and
    Hessian, and a Newton step follows. Rounded to 4 places, z to 1: differences give the standard errors six digits."""
    h = 2e-4
    points = {"c": (0, 0, 0)}
    for i in range(3):
        for name, sign in (("p", 1), ("m", -1)):
            points[f"{name}{i}"] = tuple(sign if k == i else 0 for k in range(3))
    pairs = [(0, 1), (0, 2), (1, 2)]
    for i, j in pairs:
        for name, a, b in (("pp", 1, 1), ("pm", 1, -1), ("mp", -1, 1), ("mm", -1, -1)):
            points[f"{name}{i}{j}"] = tuple(a if k == i else b if k == j else 0 for k in range(3))
    stencil = ", ".join(f"('{k}', {a * h!r}, {b * h!r}, {c * h!r})" for k, (a, b, c) in points.items())

    def p(e):
        return f"(1 / (1 + exp(-({e}))))"

    e0, e1 = "t0 + t2 * u", "t0 + t1 + t2 * u"
    weight = f"(n0 * {p(e0)} * (1 - {p(e0)}) + n1 * {p(e1)} * (1 - {p(e1)}))"
    step = f"u + (t2 * (s0 - n0 * {p(e0)} + s1 - n1 * {p(e1)}) - u) / (1 + t2 * t2 * {weight})"

    def at(source):
        """One row per iterate of ``source``: its likelihood values on the stencil, the gradient, minus the Hessian, and its cofactors."""
        values = ", ".join(f"max(case when id = '{k}' then ll end) as {k}" for k in points)
        slopes = ", ".join(f"(p{i} - m{i}) / {2 * h!r} as g{i}, (2 * c - p{i} - m{i}) / {h * h!r} as a{i}{i}" for i in range(3))
        mixed = ", ".join(f"(pm{i}{j} + mp{i}{j} - pp{i}{j} - mm{i}{j}) / {4 * h * h!r} as a{i}{j}" for i, j in pairs)
        return f"""(
  select *, a11 * a22 - a12 * a12 as c00, a02 * a12 - a01 * a22 as c01, a01 * a12 - a02 * a11 as c02, a00 * a22 - a02 * a02 as c11,
         a01 * a02 - a00 * a12 as c12, a00 * a11 - a01 * a01 as c22,
         a00 * (a11 * a22 - a12 * a12) + a01 * (a02 * a12 - a01 * a22) + a02 * (a01 * a12 - a02 * a11) as det
  from (select k, b0, b1, sg, c, {slopes}, {mixed} from (
    select k, b0, b1, sg, {values} from (
      select k, b0, b1, sg, id, sum(s0 * ({e0}) - n0 * ln(1 + exp({e0})) + s1 * ({e1}) - n1 * ln(1 + exp({e1})) - u * u / 2 - 0.5 * ln(1 + t2 * t2 * {weight})) as ll
      from (select *, list_reduce(list_concat([0.0::double], list_transform(range(40), lambda z: z::double)), lambda u, z: {step}) as u
            from (select k, b0, b1, sg, id, b0 + d0 as t0, b1 + d1 as t1, sg + d2 as t2, w.* from {source}, stencil, w))
      group by k, b0, b1, sg, id) group by k, b0, b1, sg)))"""

    z0, z1 = "(b0 / sqrt(c00 / det))", "(b1 / sqrt(c11 / det))"
    return f"""
with recursive cells as (
  select cast({group} as varchar) as g, {factor} as lvl, cast({failures} + {successes} as double) as n, cast({successes} as double) as s
  from {src} where {group} is not null and {factor} is not null and {failures} + {successes} > 0),
lv as (select min(lvl) as l0, max(lvl) as l1 from cells),
w as (select g, sum(case when lvl = l0 then n else 0 end) as n0, sum(case when lvl = l0 then s else 0 end) as s0,
             sum(case when lvl = l1 then n else 0 end) as n1, sum(case when lvl = l1 then s else 0 end) as s1 from cells, lv group by g),
tot as (select ln(sum(s0) / (sum(n0) - sum(s0))) as q0, ln(sum(s1) / (sum(n1) - sum(s1))) as q1, sum(n0 + n1) as n, count(*) as groups from w),
stencil(id, d0, d1, d2) as (values {stencil}),
it(k, b0, b1, sg) as (
  select 0, q0, q1 - q0, 0.2::double from tot
  union all
  select k + 1, b0 + x0 - y0 * ds, b1 + x1 - y1 * ds, sg + ds  -- the fixed effects are solved for, the spread's curvature is taken as positive, its step bounded
  from (select *, greatest(-0.2, least(0.2, (g2 - a02 * x0 - a12 * x1) / abs(det / c22))) as ds from (
    select *, (a11 * g0 - a01 * g1) / c22 as x0, (a00 * g1 - a01 * g0) / c22 as x1, (a11 * a02 - a01 * a12) / c22 as y0, (a00 * a12 - a01 * a02) / c22 as y1
    from {at('it')} where k < 80))),
fin as (select * from {at('(select * from it where k = 80)')}, tot),
modes as (
  select n0, s0, n1, s1, {p('b0 + sg * u')} as p0, {p('b0 + b1 + sg * u')} as p1 from (
    select *, list_reduce(list_concat([0.0::double], list_transform(range(40), lambda z: z::double)), lambda u, z: {step}) as u
    from (select fin.b0, fin.b1, fin.sg, fin.b0 as t0, fin.b1 as t1, fin.sg as t2, w.* from fin, w))),
each as (
  select sqrt((1 - p0) / p0) as r, s0 as n from modes union all select -sqrt(p0 / (1 - p0)), n0 - s0 from modes
  union all select sqrt((1 - p1) / p1), s1 from modes union all select -sqrt(p1 / (1 - p1)), n1 - s1 from modes),
rows as (select r, unnest(range(cast(n as bigint))) from each where n > 0),
five as (select quantile_cont(r, [0.0, 0.25, 0.5, 0.75, 1.0]) as q from rows)
select 'fixed' as effect, '(Intercept)' as term, round(b0, 4) as estimate, round(sqrt(c00 / det), 4) as std_error, round({z0}, 1) as z_value,
       round({norm_two_sided(z0)}, 4) as p_value from fin
union all select 'fixed', '{factor}' || l1, round(b1, 4), round(sqrt(c11 / det), 4), round({z1}, 1), round({norm_two_sided(z1)}, 4) from fin, lv
union all select 'correlation', '{factor}' || l1 || ':(Intercept)', round(c01 / sqrt(c00 * c11), 4), null, null, null from fin, lv
union all select 'ran_pars', 'sd__(Intercept)|{group}', round(abs(sg), 4), null, null, null from fin
union all select 'ran_pars', 'var__(Intercept)|{group}', round(sg * sg, 4), null, null, null from fin
union all select 'fit', unnest(['logLik', 'AIC', 'BIC', 'deviance', 'df.resid', 'observations', 'groups']),
       round(unnest([c, -2 * c + 6, -2 * c + 3 * ln(n), -2 * c, n - 3, n, groups::double]), 4), null, null, null from fin
union all select 'residuals', unnest(['Min', '1Q', 'Median', '3Q', 'Max']), round(unnest(q), 4), null, null, null from five"""
