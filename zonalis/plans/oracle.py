"""The catalogue's queries as SQL for another engine: written on their own, not derived from the plans."""

from __future__ import annotations

from zonalis.plans.catalog import BETAS, SCALES, SWEEP, SWEEP_BETAS, SWEEP_MINUTES

_CELLS = """
reg as (select n_nationkey, n_name, r_name as region, r_regionkey from nation join region on n_regionkey = r_regionkey),
cells as (select region, c_custkey as cell_id, (100.0e0 + (c_custkey * 7919) % 40000 / 100.0e0) * 1000 as x, (100.0e0 + (c_custkey * 104729) % 40000 / 100.0e0) * 1000 as y,
  greatest(c_acctbal, 0.0e0) as population, 1.0e0 + c_custkey % 3 / 4.0e0 as area_km2 from customer join reg on c_nationkey = n_nationkey),
places as (select region, s_suppkey as place_id, (100.0e0 + (s_suppkey * 15485863) % 40000 / 100.0e0) * 1000 as x, (100.0e0 + (s_suppkey * 32452843) % 40000 / 100.0e0) * 1000 as y,
  s_acctbal as population from supplier join reg on s_nationkey = n_nationkey where s_acctbal > 0),
totals as (select r_name as region, 100.0e0 + r_regionkey * 10 as x_total from region),
dist as (select c.region, cell_id, place_id, sqrt((c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)) / 1000 as d from cells c join places p on c.region = p.region),
feat as (select c.*, sqrt((c.x - 300000) * (c.x - 300000) + (c.y - 300000) * (c.y - 300000)) / 1000 as dc, n.dn from cells c join (select cell_id, min(d) as dn from dist group by cell_id) n using (cell_id))"""
_W = f"with {_CELLS}"


def _alloc(weight: str, source: str = "feat", zero: str = "null") -> str:
    return f"""{_W}, w as (select region, cell_id, {weight} as w from {source}), s as (select region, sum(w) as s, count(*) as n from w group by region)
select region, cell_id, round(case when s > 0 then x_total * w / s else {zero} end, 6) as value from w join s using (region) join totals using (region)"""


def _decay(f: str, mass: str = "power(population / top, 1.0e0)", radius: float = 30) -> str:
    return f"""{_W}, near as (select place_id from dist group by place_id having min(d) <= {radius}),
kept as (select p.* from places p join near using (place_id)), top as (select region, max(population) as top from kept group by region),
m as (select place_id, {mass} as m from kept join top using (region)),
w0 as (select d.region, cell_id, sum(m * {f}) as w from dist d join m using (place_id) group by d.region, cell_id),
w as (select c.region, c.cell_id, coalesce(w, 0.0e0) as w from cells c left join w0 using (cell_id)), s as (select region, sum(w) as s, count(*) as n from w group by region)
select region, cell_id, round(case when s > 0 then x_total * w / s else x_total / n end, 6) as value from w join s using (region) join totals using (region)"""


_METHODS = f"""{_W}, raw as (select region, cell_id, 'area' as method, area_km2 as w from cells union all select region, cell_id, 'population', population from cells
  union all select region, cell_id, 'elasticity', case when population > 0 then power(population, 2.77e0) else 0.0e0 end from cells),
sums as (select region, method, sum(w) as s from raw group by region, method),
long as (select region, cell_id, method, x_total * w / s as value from raw join sums using (region, method) join totals using (region)),
ranked as (select *, row_number() over (partition by region, method order by value, cell_id) as i, row_number() over (partition by region, method order by value desc, cell_id) as k, count(*) over (partition by region, method) as n,
  count(*) filter (where value > 0) over (partition by region, method) as np from long),
gini as (select region, method, (2 * sum(i * value) - (max(n) + 1) * sum(value)) / (max(n) * sum(value)) as gini from ranked group by region, method)"""


def _top(k: str) -> str:
    return f"{_METHODS} select region, method, round(coalesce(sum(value) filter (where k <= {k}), 0) / sum(value), 6) as top_share from ranked group by region, method"


_TOP_ROUND = "greatest(1, round_even(n * 0.1e0, 0))"
_F = {"exp": "exp(-d / {s}e0)", "gauss": "exp(-(d * d) / (2.0e0 * {s}e0 * {s}e0))", "power": "power(d + 1, -{s}e0)"}


def _rank(value: str, by: str, name: str) -> str:
    return f"rank() over (partition by {by} order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2.0e0 as {name}"


def _rho(by: str) -> str:
    return f"coalesce(covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0), 0)"


#: Sums that differ only by the order of their terms are equal: eleven digits count.
_DIGITS = "(case when w > 1e-290 then round_even(w / power(10.0e0, floor(log10(w)) - 10), 0) * power(10.0e0, floor(log10(w)) - 10) else w end)"


def _trace(kind: str, betas, scales=SCALES) -> str:
    combos = [(b, s, i, j) for i, b in enumerate(betas) for j, s in enumerate(scales)]
    each = " union all ".join(
        f"select d.region, d.cell_id, {b}e0 as beta, {s}e0 as scale, {i} as bp, {j} as sp, sum(power(share, {b}e0) * {_F[kind].format(s=s)}) as w from dist d join sh using (place_id) group by d.region, d.cell_id" for b, s, i, j in combos
    )
    return f"""{_W}, near as (select place_id from dist group by place_id having min(d) <= 30), kept as (select p.* from places p join near using (place_id)), top as (select region, max(population) as top from kept group by region),
sh as (select place_id, population / top as share from kept join top using (region)), ws as ({each}),
ranks as (select ws.region, beta, scale, bp, sp, {_rank(_DIGITS, "ws.region, beta, scale", "ra")}, {_rank("population", "ws.region, beta, scale", "rb")} from ws join cells using (cell_id)),
trace as (select region, beta, scale, bp, sp, {_rho("region")} as rho from ranks group by region, beta, scale, bp, sp)"""


_BOXES = "boxes as (select n_name as region, n_nationkey * 70123.0e0 + 250 as xmin, n_nationkey * 30011.0e0 - 400 as ymin, n_nationkey * 70123.0e0 + 250 + 8000 + n_nationkey * 100 as xmax, n_nationkey * 30011.0e0 - 400 + 9500.0e0 as ymax from nation)"


def _lattice(size: int) -> str:
    return f"""with {_BOXES}, nx as (select *, unnest(range(floor(xmin / {size})::bigint, ceil(xmax / {size})::bigint)) as ix from boxes),
lattice as (select *, unnest(range(floor(ymin / {size})::bigint, ceil(ymax / {size})::bigint)) as iy from nx)"""


def _grid(size: int) -> str:
    return f"""{_lattice(size)}, cut as (select region, ix, iy, greatest(ix * {size}.0e0, xmin) as x0, least((ix + 1) * {size}.0e0, xmax) as x1, greatest(iy * {size}.0e0, ymin) as y0, least((iy + 1) * {size}.0e0, ymax) as y1 from lattice)
select region, ix, iy, round((x0 + x1) / 2, 3) as x, round((y0 + y1) / 2, 3) as y, round((x1 - x0) * (y1 - y0) / 1e6, 6) as area_km2 from cut where x1 > x0 and y1 > y0"""


_FACTS = """with facts as (select n_name as object_name, r_name as section, o_orderpriority as code, year(o_orderdate) as yr, sum(o_totalprice) as v
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all)"""
_TRAIN = """with o as (select o_custkey as k, sum(o_totalprice) as otgr, count(*)::double as n, max(o_totalprice) as m from orders group by o_custkey),
train as (select k as object_name, otgr, c_acctbal as population, n as urban_pop, m as investments from o join customer on k = c_custkey where c_acctbal > 0 and otgr > 0 and n > 0 and m > 0),
l as (select object_name, otgr, object_name % 5 as fold, ln(1 + otgr) as y, ln(1 + population) as a, ln(1 + urban_pop) as b, ln(1 + investments) as c from train)"""
_SUMS = "avg(y) as my, avg(a) as ma, avg(b) as mb, avg(c) as mc, var_pop(a) as aa, var_pop(b) as bb, var_pop(c) as cc, covar_pop(a, b) as ab, covar_pop(a, c) as ac, covar_pop(b, c) as bc, covar_pop(a, y) as ay, covar_pop(b, y) as by_, covar_pop(c, y) as cy"
_CRAMER = """det as (select *, aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) as dd from sums),
beta0 as (select *, (ay * (bb * cc - bc * bc) - ab * (by_ * cc - bc * cy) + ac * (by_ * bc - bb * cy)) / dd as ka,
  (aa * (by_ * cc - bc * cy) - ay * (ab * cc - bc * ac) + ac * (ab * cy - by_ * ac)) / dd as kb,
  (aa * (bb * cy - by_ * bc) - ab * (ab * cy - by_ * ac) + ay * (ab * bc - bb * ac)) / dd as kc from det),
beta as (select *, my - ka * ma - kb * mb - kc * mc as k0 from beta0)"""
_OLS = f"{_TRAIN}, sums as (select {_SUMS} from l), {_CRAMER}"
_Z = f"""{_W}, raw as (select *, ln(1 + greatest(population, 0)) as f1, ln(1 + 1 / (dn + 1)) as f2, ln(1 + 1 / (dc + 1)) as f3 from feat),
z as (select region, cell_id, population, dn, dc, {", ".join(f"(f{k} - avg(f{k}) over (partition by region)) / (case when stddev_pop(f{k}) over (partition by region) < 1e-9 then 1 else stddev_pop(f{k}) over (partition by region) end) as f{k}" for k in (1, 2, 3))} from raw)"""


def _ref(e: float, p: float) -> str:
    return f"""{_Z}, w as (select *, (case when population > 0 then power(population, {e}e0) else 0 end) * power(power(1 / (dc + 1), 0.7e0) * power(1 / (dn + 1), 0.3e0), {p}e0) as w from z),
ref as (select *, w / sum(w) over (partition by region) as ref from w)"""


_ROADS = """nodes as (select n_nationkey::bigint as id, (100.0e0 + (n_nationkey * 7919) % 400) * 1000 as x, (100.0e0 + (n_nationkey * 104729) % 400) * 1000 as y from nation),
edges as (select s_nationkey::bigint as src, c_nationkey::bigint as dst, sum(l_quantity) / count(*) as tt from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey group by 1, 2),
und as materialized (select src, dst, min(tt) as tt from (select * from edges union all select dst, src, tt from edges) where src <> dst group by src, dst)"""


def _paths(seeds: str, hops: int = 24) -> str:
    out = f"p0 as materialized ({seeds})"
    for k in range(hops):
        out += f""", p{k + 1} as materialized (select place_id, node, min(sec) as sec from (select * from p{k} union all select place_id, dst, sec + tt from p{k} join und on node = src) group by place_id, node)"""
    return f"{out}, paths as (select * from p{hops})"


_MINUTES = f"""{_W}, {_ROADS},
cn as (select cell_id, region, arg_min(id, (dd, id)) as node, min(dd) as off from (select cell_id, region, id, sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)) as dd from cells c, nodes n) group by cell_id, region),
pn as (select place_id, region, arg_min(id, (dd, id)) as node, min(dd) as off from (select place_id, region, id, sqrt((c.x - n.x) * (c.x - n.x) + (c.y - n.y) * (c.y - n.y)) as dd from places c, nodes n) group by place_id, region),
{_paths("select place_id, node, 0.0e0 as sec from pn")},
mins as (select cn.region, cell_id, pn.place_id, coalesce(sec / 60 + (cn.off + pn.off) * (60.0e0 / 25000.0e0), 'inf'::double) as d from cn join pn on cn.region = pn.region left join paths on paths.place_id = pn.place_id and paths.node = cn.node)"""
_HOLE = "x >= xmin + 1000 and x < xmin + 3000 and y >= ymin + 1000 and y < ymin + 3000"



def _far(f: str) -> str:
    """Many places: all pairs."""
    return f"""{_W}, shops as (select r_name as region, p_partkey as place_id, (100.0e0 + (p_partkey * 15485863) % 40000 / 100.0e0) * 1000 as px, (100.0e0 + (p_partkey * 32452843) % 40000 / 100.0e0) * 1000 as py, p_retailprice as v from part join region on p_partkey % 5 = r_regionkey),
top as (select region, max(v) as top from shops group by region),
met as (select c.region, cell_id, v / top as m, sqrt((c.x - px) * (c.x - px) + (c.y - py) * (c.y - py)) / 1000 as d from cells c join shops s on c.region = s.region join top on top.region = s.region),
w as (select region, cell_id, sum(m * {f}) as w from met group by region, cell_id), s as (select region, sum(w) as s from w group by region)
select region, cell_id, round(x_total * w / s, 5) as value from w join s using (region) join totals using (region)"""


ORACLE: dict[str, str] = {
    "alloc_far_exp": _far("exp(-d / 5.0e0)"),
    "alloc_far_gauss": _far("exp(-(d * d) / 800.0e0)"),
    "alloc_uniform": _alloc("area_km2"),
    "alloc_proximity": _alloc("0.7e0 / (dc + 1) + 0.3e0 / (dn + 1)"),
    "alloc_by_name": _alloc("0.7e0 / (dc + 1) + 0.3e0 / (dn + 1)"),
    "alloc_agri": _alloc("dn / (dc + 1)"),
    "alloc_naive_nearest": _alloc("1 / (dn + 1)"),
    "alloc_population": _alloc("population"),
    "alloc_rescaled": _alloc("population").replace("x_total * w / s", "x_total * w / s * 1000"),
    "alloc_elasticity": _alloc("case when population > 0 then power(population, 2.77e0) else 0.0e0 end", zero="0.0e0"),
    "alloc_decay_exp": _decay("exp(-d / 10.0e0)"),
    "alloc_decay_gauss": _decay("exp(-(d * d) / 200.0e0)"),
    "alloc_decay_power": _decay("power(d + 1, -2.5e0)"),
    "alloc_decay_nopop": _decay("exp(-d / 10.0e0)", "1.0e0"),
    "alloc_decay_beta277": _decay("exp(-d / 10.0e0)", "power(population / top, 2.77e0)"),
    "alloc_zero_total_fallback": f"{_W} select region, cell_id, round(x_total / count(*) over (partition by region), 6) as value from cells join totals using (region)",
    "city_mass": f"{_W} select region, place_id, round(power(population / max(population) over (partition by region), 2.77e0), 6) as mass from places",
    "kernel_curve": f"""{_W}, d as (select k * (top / 399) as d from (select max(dc) as top from feat), range(400) r(k)) select 'exp' as kind, round(d, 6) as d, round(exp(-d / 10.0e0), 6) as f from d
union all select 'gauss', round(d, 6), round(exp(-(d * d) / 200.0e0), 6) from d union all select 'power', round(d, 6), round(power(d + 1, -2.5e0), 6) from d""",
    "mercator_roundtrip": """with p as (select c_custkey, (c_custkey * 7919) % 36000 / 100.0e0 - 180 as lon, (c_custkey * 104729) % 16000 / 100.0e0 - 80 as lat from customer)
select c_custkey, round(radians(lon) * 6378137.0e0, 3) as x, round(ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0e0, 3) as y, round(lon, 6) as lon, round(lat, 6) as lat from p""",
    "dist_matrix": f"{_W} select cell_id, place_id, round(d, 6) as d from dist",
    "nearest_city": f"{_W} select cell_id, arg_min(place_id, (d, place_id)) as place_id, round(min(d), 6) as d from dist group by cell_id",
    "cities_in_buffer": f"{_W} select region, place_id from dist group by region, place_id having min(d) <= 12",
    "dist_to_center": f"{_W} select cell_id, round(sqrt((x - 300000) * (x - 300000) + (y - 300000) * (y - 300000)) / 1000, 6) as d from cells",
    "grid_lattice_box": f"{_lattice(1000)} select region, ix, iy from lattice",
    "grid_area_centroid": _grid(1000),
    "grid_coarse": _grid(10000),
    "grid_polygon": _grid(1000),
    "border_area": f"with {_BOXES} select region, round((xmax - xmin) * (ymax - ymin) / 1e6 - 4, 6) as area_km2 from boxes",
    "border_bounds": f"with {_BOXES} select region, xmin, ymin, xmax, ymax from boxes",
    "points_in_border": f"""with {_BOXES}, p as (select region, event_id, xmin - 500 + (event_id * 7919) % 12000 as x, ymin - 500 + (event_id * 104729) % 12000 as y, xmin, ymin, xmax, ymax from events, boxes)
select region, event_id from p where x >= xmin and x < xmax and y >= ymin and y < ymax and not ({_HOLE})""",
    "zonal_sum": """with px as (select ((event_id * 7919) % 20000) // 1000 as ix, ((event_id * 104729) % 20000) // 1000 as iy, sum(value) as v from events where event_type <> 'error' and value is not null group by 1, 2)
select i.ix, j.iy, round(coalesce(v, 0), 4) as population from (select unnest(range(25)) as ix) i cross join (select unnest(range(20)) as iy) j left join px on px.ix = i.ix and px.iy = j.iy""",
    "gini_all_forms": f"{_METHODS} select region, method, round(gini, 6) as gini, round(gini, 6) as gini_nonnegative from gini",
    "top_share_round": _top(_TOP_ROUND),
    "top_share_trunc": _top("greatest(1, floor(np * 0.1e0))"),
    "top_share_inline": _top("floor(n * 0.1e0)"),
    "summary_table": f"{_METHODS} select region, method, round(max(gini), 3) as gini, round(sum(value), 2) as total, count(*) filter (where value > 0) as cells from long join gini using (region, method) group by region, method",
    "summary_pivot": f"""{_METHODS}, lab as (select region, method, 'gini ' || round(max(gini), 3)::varchar || ' / top-10% ' || round(sum(value) filter (where k <= {_TOP_ROUND}) / sum(value), 2)::varchar as s from ranked join gini using (region, method) group by region, method)
select method, {", ".join(f"max(s) filter (where region = '{r}') as {r.lower().replace(' ', '_')}" for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))} from lab group by method""",
    "mass_check": f"{_METHODS} select region, method, round(sum(value), 6) as total, max(x_total) as x_total, abs(sum(value) - max(x_total)) <= 1e-6 * max(x_total) as ok from long join totals using (region) group by region, method",
    "max_min_ratio": f"{_METHODS} select region, round(max(value) / min(value), 6) as ratio from long where method = 'area' group by region",
    "quantile_vmax": f"{_METHODS} select region, method, round(min(value) filter (where value > 0), 6) as vmin, round(max(value) filter (where value > 0), 6) as vmax, round(quantile_cont(value, 0.95), 6) as vq from long group by region, method",
    "describe_weights": f"{_W} select region, count(*) as n, round(avg(population), 4) as mean, round(stddev_samp(population), 4) as std, min(population) as low, round(quantile_cont(population, 0.25), 4) as q25, round(quantile_cont(population, 0.5), 4) as q50, round(quantile_cont(population, 0.75), 4) as q75, max(population) as high from cells group by region",
    "upsert_summary": f"{_METHODS} select region, method, round(case when method = 'area' then -1.0e0 else gini end, 6) as gini from gini union all select r_name, 'extra', -2.0e0 from region",
    "methods_dropped": f"{_METHODS} select method, count(*) as n from long where method <> 'population' group by method",
    "tune_gravity_trace": f"{_trace('exp', BETAS)} select region, beta, scale, round(rho, 4) as rho from trace",
    "tune_gravity_best": f"{_trace('exp', BETAS)} select region, beta, scale, round(rho, 4) as rho from (select *, row_number() over (partition by region order by round(rho, 9) desc, bp, sp) as k from trace) where k = 1",
    "tune_sigma": f"{_trace('gauss', (1.0,))} select region, scale, round(rho, 4) as rho from (select *, row_number() over (partition by region order by round(rho, 9) desc, bp, sp) as k from trace) where k = 1",
    "spearman_ties": f"{_W}, r as (select region, {_rank('population', 'region', 'ra')}, {_rank('floor(x / 50000)', 'region', 'rb')} from cells) select region, round({_rho('region')}, 6) as rho from r group by region",
    "indicator_filter": f"{_FACTS} select object_name, round(v, 2) as value from facts where code = '1-URGENT' and yr = 1996",
    "indicator_latest": f"{_FACTS} select object_name, code as indicator_code, max(yr)::int as year, round(arg_max(v, yr), 2) as indicator_value from facts group by object_name, code",
    "keyword_search": "select doc_id from documents where regexp_matches(text, '(?i)(ÜBER|éré)')",
    "keyword_distinct": "select distinct p_type, p_size from part where regexp_matches(p_type, '(?i)(promo|small)')",
    "section_nunique_topk": f"{_FACTS} select section, count(distinct object_name || code) as codes from facts group by section order by codes desc, section limit 3",
    "year_span": f"{_FACTS} select code as indicator_code, min(yr) as first, max(yr) as last, string_agg(distinct yr::varchar, ',' order by yr::varchar) as years, count(distinct object_name) as objects from facts group by code",
    "distinct_pairs": "select distinct p_brand, p_type from part",
    "missing_share": "select c_mktsegment, count(*) filter (where c_acctbal <= 0) as n, round(avg((c_acctbal > 0)::int::double), 6) as share from customer group by c_mktsegment",
    "train_join": f"{_TRAIN} select object_name, round(otgr, 2) as otgr, population, urban_pop, investments from train",
    "ols_coefficients": f"{_OLS} select unnest(['intercept', 'population', 'urban_pop', 'investments']) as term, unnest([round(k0, 4), round(ka, 4), round(kb, 4), round(kc, 4)]) as coefficient from beta",
    "ols_r2": f"{_OLS} select round(1 - sum(power(y - k0 - ka * a - kb * b - kc * c, 2)) / sum(power(y - my, 2)), 6) as r2 from l, beta",
    "ols_outliers_top5": f"{_OLS}, e as (select object_name, k0 + ka * a + kb * b + kc * c as p, y from l, beta) select object_name, round(exp(p) - 1, 2) as predicted, round(y - p, 6) as residual from e order by abs(y - p) desc, object_name limit 5",
    "cv_r2": f"""{_TRAIN}, sums as (select f.fold, {_SUMS} from (select distinct fold from l) f join l on l.fold <> f.fold group by f.fold), {_CRAMER},
s as (select fold, 1 - sum(power(y - k0 - ka * a - kb * b - kc * c, 2)) / (var_pop(y) * count(*)) as r2 from l join beta using (fold) group by fold)
select count(*)::int as folds, round(avg(r2), 5) as r2_mean, round(stddev_pop(r2), 5) as r2_std from s""",
    "zscore_features": f"{_Z} select cell_id, round(f1, 6) as f1, round(f2, 6) as f2, round(f3, 6) as f3 from z",
    "reference_weights": f"{_ref(2.77, 0.35)} select cell_id, round(ref, 8) as ref from ref",
    "constraint_targets": f"{_ref(2.77, 0.35)} select region, round(sum(ref * f1), 6) as t1, round(sum(ref * f2), 6) as t2, round(sum(ref * f3), 6) as t3 from ref group by region",
    "maxent_achieved": f"{_ref(1.0, 0.5)}, t as (select region, sum(ref * f1) as t1, sum(ref * f2) as t2, sum(ref * f3) as t3 from ref group by region) select region, unnest(['f1', 'f2', 'f3']) as feature, round(unnest([t1, t2, t3]), 4) as achieved from t",
    "road_undirected": f"with {_ROADS} select src, dst, round(tt, 6) as travel_time from und",
    "shortest_paths": f"with {_ROADS}, {_paths('select id as place_id, id as node, 0.0e0 as sec from nodes')} select place_id, node, round(sec, 6) as sec from paths",
    "largest_component": f"""with {_ROADS}, und2 as materialized (select src, dst from edges union select dst, src from edges),
{", ".join([("c0 as materialized (select id, id as label from nodes)")] + [f"c{k + 1} as materialized (select c.id, min(least(c.label, coalesce(n.label, c.label))) as label from c{k} c left join und2 on src = c.id left join c{k} n on n.id = dst group by c.id)" for k in range(25)])},
top as (select label from c25 group by label order by count(*) desc, label limit 1) select id from c25 join top using (label)""",
    "edge_times": """with e as (select s_suppkey as src, s_suppkey * 100.0e0 as len, case when s_nationkey % 5 <> 0 then 'h' || (s_nationkey % 3)::varchar end as hw, case when s_suppkey % 4 <> 0 then 30.0e0 + s_suppkey % 50 end as ms from supplier)
select src, round(len / (coalesce(ms, avg(ms) over (partition by hw), (select avg(ms) from e)) / 3.6e0), 6) as travel_time from e""",
    "network_minutes": f"{_MINUTES} select cell_id, place_id, round(d, 5) as d from mins",
    "alloc_network": f"""{_MINUTES}, top as (select region, max(population) as top from places group by region), m as (select place_id, population / top as m from places join top using (region)),
w as (select region, cell_id, sum(m * case when d = 'inf'::double then 0 else exp(-d / 30.0e0) end) as w from mins join m using (place_id) group by region, cell_id), s as (select region, sum(w) as s, count(*) as n from w group by region)
select region, cell_id, round(case when s > 0 then x_total * w / s else x_total / n end, 6) as value from w join s using (region) join totals using (region)""",
    "reachable_share": f"{_MINUTES}, n as (select region, cell_id, min(d) as d from mins group by region, cell_id) select region, round(avg((d < 'inf'::double)::int::double), 6) as share from n group by region",
    "json_cities": """with e as (select s_suppkey as k, case when s_suppkey % 11 <> 0 then 'N' || (s_suppkey % 60) end as name, ((s_suppkey * 37) % 360 - 180)::double as lon, ((s_suppkey * 53) % 170 - 85)::double as lat,
  case s_suppkey % 4 when 0 then (s_suppkey || '250')::double when 1 then (s_suppkey || '100')::double end as population, case when s_suppkey % 2 = 0 then 'city' else 'town' end as place from supplier)
select name, lon, lat, population, place from e where name is not null and (k % 3 <> 0 or k % 13 <> 0) qualify row_number() over (partition by name order by k) = 1""",
    "json_numbers": "select event_id, (props->>'k')::bigint as k, ((props->>'k') || '01')::bigint as n from events",
    "dedupe_first": "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1",
}

# borders that are not convex and have a hole: the box's share of a cell, less the hole's and the missing corner's
_OVER = "greatest(0, least(x1, {b}) - greatest(x0, {a})) * greatest(0, least(y1, {d}) - greatest(y0, {c}))"
_MID = "(greatest(x0, {a}) + least(x1, {b})) / 2"
_SHAPE = f"""{_lattice(1000)}, cut0 as (select region, ix, iy, xmin, ymin, xmax, ymax, xmin + (xmax - xmin) * 0.55e0 as xm, ymin + (ymax - ymin) * 0.4e0 as ym,
  greatest(ix * 1000.0e0, xmin) as x0, least((ix + 1) * 1000.0e0, xmax) as x1, greatest(iy * 1000.0e0, ymin) as y0, least((iy + 1) * 1000.0e0, ymax) as y1 from lattice),
cut1 as (select *, (x1 - x0) * (y1 - y0) as a, {_OVER.format(a="xmin + 1000", b="xmin + 3000", c="ymin + 1000", d="ymin + 3000")} as h, {_OVER.format(a="xm", b="xmax", c="ym", d="ymax")} as q,
  {_MID.format(a="xmin + 1000", b="xmin + 3000")} as hx, (greatest(y0, ymin + 1000) + least(y1, ymin + 3000)) / 2 as hy, {_MID.format(a="xm", b="xmax")} as qx, (greatest(y0, ym) + least(y1, ymax)) / 2 as qy from cut0 where x1 > x0 and y1 > y0),
shape as (select *, a - h - q as area from cut1 where a - h - q > 1e-6),
pts as (select region, xmin - 500 + (event_id * 7919) % 12000 as x, ymin - 500 + (event_id * 104729) % 12000 as y, value, event_type, xmin, ymin, xmax, ymax, xmin + (xmax - xmin) * 0.55e0 as xm, ymin + (ymax - ymin) * 0.4e0 as ym from events, boxes),
px as (select region, floor(x / 1000)::bigint as ix, floor(y / 1000)::bigint as iy, sum(value) as v from pts where event_type <> 'error' and value is not null
  and x >= xmin and x < xmax and y >= ymin and y < ymax and not ({_HOLE}) and not (x >= xm and y >= ym) group by 1, 2, 3)"""
ORACLE |= {
    "nearest_on_sphere": """with a as (select c_custkey, radians(c_custkey * 7919 % 36000 / 100.0e0 - 180) as lon, radians(c_custkey * 104729 % 17900 / 100.0e0 - 89.5e0) as lat from customer),
b as (select s_suppkey as id, radians(s_suppkey * 7919 % 36000 / 100.0e0 - 180) as lon, radians(s_suppkey * 104729 % 17900 / 100.0e0 - 89.5e0) as lat from supplier),
d as (select c_custkey, id, 2 * 6371009.0e0 * asin(sqrt(least(1, sin((a.lat - b.lat) / 2) * sin((a.lat - b.lat) / 2) + cos(a.lat) * cos(b.lat) * sin((a.lon - b.lon) / 2) * sin((a.lon - b.lon) / 2)))) as m from a, b)
select c_custkey, arg_min(id, (m, id)) as node, round(min(m), 2) as off_m from d group by c_custkey""",
    "road_chains": "select (-1 - c_nationkey)::bigint as src, max(o_orderkey) as dst, round(sum(o_totalprice / 1000), 6) as travel_time from orders join customer on o_custkey = c_custkey group by o_custkey, c_nationkey",
    "shortest_chains": """select (-100 - n_regionkey)::bigint as place_id, o_orderkey as node, round(n_nationkey + 10.0e0 + sum(o_totalprice / 1000) over (partition by o_custkey order by o_orderkey), 6) as sec
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "cell_overlay": f"{_SHAPE} select region, ix, iy, round(area / 1e6, 6) as area_km2 from shape",
    "overlay_pairs": f"""with {_BOXES}, r as (select region, s_suppkey::varchar as plot, xmin, ymin, xmax, ymax, xmin + (xmax - xmin) * 0.55e0 as xm, ymin + (ymax - ymin) * 0.4e0 as ym,
  xmin - 900 + (s_suppkey * 7919) % 8000 as x0, ymin - 700 + (s_suppkey * 104729) % 9000 as y0, 1250.37e0 + s_suppkey % 7 * 300 as w, 900.71e0 + s_suppkey % 5 * 700 as h
  from supplier join nation on s_nationkey = n_nationkey join boxes on region = n_name),
o as (select region, plot, greatest(0, least(x0 + w, xmax) - greatest(x0, xmin)) * greatest(0, least(y0 + h, ymax) - greatest(y0, ymin))
  - greatest(0, least(x0 + w, xmax) - greatest(x0, xm)) * greatest(0, least(y0 + h, ymax) - greatest(y0, ym))
  - greatest(0, least(x0 + w, xmin + 3000) - greatest(x0, xmin + 1000)) * greatest(0, least(y0 + h, ymin + 3000) - greatest(y0, ymin + 1000)) as a from r)
select region, plot, round(a / 1e6, 6) as area_km2 from o where round(a / 1e6, 6) > 0""",
    "grid_l_shape": f"{_SHAPE} select region, ix, iy, round((a * (x0 + x1) / 2 - h * hx - q * qx) / area, 3) as x, round((a * (y0 + y1) / 2 - h * hy - q * qy) / area, 3) as y, round(area / 1e6, 6) as area_km2 from shape",
    "region_outline": f"with {_BOXES} select region, 4::bigint as n, round((xmax - xmin) * (ymax - ymin) / 1e6, 6) as area_km2 from boxes",
    "inner_point": f"with {_BOXES} select region, round(xmin + (xmax - xmin) * 0.55e0 / 2, 3) as x, round(ymin + (ymax - ymin) * 0.5000173e0, 3) as y from boxes",
    "zonal_sum_border": f"{_SHAPE} select region, ix, iy, round(coalesce(v, 0), 4) as population from shape left join px using (region, ix, iy)",
    "features_grid": f"""{_SHAPE}, c as (select region, ix, iy, (a * (x0 + x1) / 2 - h * hx - q * qx) / area as x, (a * (y0 + y1) / 2 - h * hy - q * qy) / area as y, (xmin + xmax) / 2 as cx, (ymin + ymax) / 2 as cy, coalesce(v, 0) as p from shape left join px using (region, ix, iy)),
towns as (select region, xmin + (s_suppkey * 7919) % 8000 as tx, ymin + (s_suppkey * 104729) % 9000 as ty from supplier join nation on s_nationkey = n_nationkey join boxes on n_name = region),
n as (select region, ix, iy, min(sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty))) / 1000 as d from c join towns using (region) group by region, ix, iy)
select region, ix, iy, round(p, 4) as population, round(sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / 1000, 5) as dist_to_center_km, round(d, 5) as dist_to_city_km,
  case when region = 'NATION_1' then round(sqrt((x - 70000) * (x - 70000) + (y - 30000) * (y - 30000)) / 1000, 5) end as dist_to_moscow_km from c join n using (region, ix, iy)""",
    "tagged_towns": "select s_suppkey as id, ['Point', 'LineString', 'Polygon', 'MultiPolygon'][s_suppkey % 4 + 1] as geometry_type from supplier where s_suppkey % 4 <> 1 and s_nationkey % 3 <> 2 and (s_suppkey * 37) % 360 - 180 between -150 and 120 and (s_suppkey * 53) % 170 - 85 between -80 and 80",
    "attached_distances": f"""{_W} select cell_id, round(dc, 6) as dist_to_center_km, round(dn, 6) as dist_to_city_km, case when region = 'ASIA' then round(sqrt((x - 200000) * (x - 200000) + (y - 250000) * (y - 250000)) / 1000, 6) end as dist_to_moscow_km,
  'dist_to_center_km,dist_to_moscow_km,dist_to_city_km' as stand_in from feat""",
}
_MEANS = "select region, '{name}' as scenario, unnest(['f1', 'f2', 'f3']) as feature, round(unnest([t1, t2, t3]), 4) as achieved from (select region, sum(ref * f1) as t1, sum(ref * f2) as t2, sum(ref * f3) as t3 from ref group by region)"
ORACLE["maxent_scenarios"] = " union all ".join(f"select * from ({_ref(e, p)} {_MEANS.format(name=n)})" for n, (e, p) in {"strict": (2.77, 0.35), "smooth": (1.0, 0.5)}.items())

def _newton(steps: int = 14) -> str:
    """Newton's steps on the dual written out; three equations a step by Cramer's rule."""
    out = f"""{_ref(1.0, 0.5)}, goal as (select region, sum(ref * f1) as t1, sum(ref * f2) as t2, sum(ref * f3) as t3 from ref group by region),
fr as materialized (select region, cell_id, f1, f2, f3 from ref), l0 as (select region, 0.0e0 as l1, 0.0e0 as l2, 0.0e0 as l3 from goal)"""
    for k in range(steps):
        out += f""", s{k} as (select fr.*, l1 * f1 + l2 * f2 + l3 * f3 as s from fr join l{k} using (region)), e{k} as (select *, exp(s - max(s) over (partition by region)) as e from s{k}),
m{k} as (select region, sum(e * f1) / sum(e) as m1, sum(e * f2) / sum(e) as m2, sum(e * f3) / sum(e) as m3, sum(e * f1 * f1) / sum(e) as q11, sum(e * f1 * f2) / sum(e) as q12, sum(e * f1 * f3) / sum(e) as q13,
  sum(e * f2 * f2) / sum(e) as q22, sum(e * f2 * f3) / sum(e) as q23, sum(e * f3 * f3) / sum(e) as q33 from e{k} group by region),
c{k} as (select region, t1 - m1 as g1, t2 - m2 as g2, t3 - m3 as g3, q11 - m1 * m1 + 1e-10 as a, q12 - m1 * m2 as b, q13 - m1 * m3 as c, q22 - m2 * m2 + 1e-10 as d, q23 - m2 * m3 as f, q33 - m3 * m3 + 1e-10 as h from m{k} join goal using (region)),
d{k} as (select *, a * (d * h - f * f) - b * (b * h - f * c) + c * (b * f - d * c) as det from c{k}),
l{k + 1} as materialized (select region, l1 + (g1 * (d * h - f * f) - b * (g2 * h - f * g3) + c * (g2 * f - d * g3)) / det as l1, l2 + (a * (g2 * h - f * g3) - g1 * (b * h - f * c) + c * (b * g3 - g2 * c)) / det as l2,
  l3 + (a * (d * g3 - g2 * f) - b * (b * g3 - g2 * c) + g1 * (b * f - d * c)) / det as l3 from d{k} join l{k} using (region))"""
    return f"""{out}, fin as (select fr.*, l1 * f1 + l2 * f2 + l3 * f3 as s from fr join l{steps} using (region)), p as (select *, exp(s - max(s) over (partition by region)) as e from fin)
select region, cell_id, round(x_total * e / sum(e) over (partition by region), 6) as value from p join totals using (region)"""


ORACLE["maxent_alloc"] = _newton()

ORACLE |= {
    "summary_lookup": f"""{_METHODS} select region, method, round(max(gini), 3) as gini, printf('%.1f%%', 100 * coalesce(sum(value) filter (where k <= {_TOP_ROUND}), 0) / sum(value)) as top
from ranked join gini using (region, method) where method = 'elasticity' and region = 'ASIA' group by region, method""",
    "number_formats": "select c_custkey, printf('%.1f%%', (c_acctbal + 0.0013e0) / 7 / 1000 * 100) as share, format('{:,}', round((c_acctbal + 0.0013e0) / 7 * 1000)::bigint) as whole, printf('%.3f', (c_acctbal + 0.0013e0) / 7) as three from customer",
    "alloc_coarse": f"""with {_BOXES}, c as (select * from ({_grid(10000)})), pts as (select region, xmin - 500 + (event_id * 7919) % 12000 as x, ymin - 500 + (event_id * 104729) % 12000 as y, value, event_type from events, boxes),
px as (select region, floor(x / 10000)::bigint as ix, floor(y / 10000)::bigint as iy, sum(value) as v from pts where event_type <> 'error' and value is not null group by 1, 2, 3),
p as (select c.region, c.ix, c.iy, coalesce(v, 0) as p from c left join px using (region, ix, iy)), s as (select region, sum(p) as s from p group by region)
select region, ix, iy, round(p, 4) as population, round(case when s > 0 then (100.0e0 + n_nationkey) * p / s end, 6) as value from p join s using (region) join nation on n_name = region""",
}

# the surveyed sweeps
_SHOWN = "region, '{kind}' as kind, beta, scale, round(rho, 4) as rho"
ORACLE |= {f"tune_sweep_{k}": f"{_trace(k, SWEEP_BETAS, s)} select {_SHOWN.format(kind=k)} from trace" for k, s in SWEEP.items()}
ORACLE["tune_sweep_best"] = " union all ".join(
    f"select * from ({_trace(k, SWEEP_BETAS, s)} select {_SHOWN.format(kind=k)} from (select *, row_number() over (partition by region order by round(rho, 9) desc, bp, sp) as k from trace) where k = 1)" for k, s in SWEEP.items()
)
ORACLE["kernel_metrics"] = " union all ".join(
    f"""select * from ({_trace(k, SWEEP_BETAS, s)}, best as (select region, beta, scale from (select *, row_number() over (partition by region order by round(rho, 9) desc, bp, sp) as k from trace) where k = 1),
v as (select ws.region, ws.beta, ws.scale, cell_id, x_total * w / sum(w) over (partition by ws.region) as value from ws join best using (region, beta, scale) join totals on ws.region = totals.region),
rk as (select *, row_number() over (partition by region order by value, cell_id) as i, row_number() over (partition by region order by value desc, cell_id) as k, count(*) over (partition by region) as n from v)
select region, '{k}' as kind, max(beta) as beta, max(scale) as scale, round((2 * sum(i * value) - (max(n) + 1) * sum(value)) / (max(n) * sum(value)), 5) as gini, round(sum(value) filter (where k <= {_TOP_ROUND}) / sum(value), 5) as top_share from rk group by region)"""
    for k, s in SWEEP.items()
)
_BY_ROAD = _trace("exp", SWEEP_BETAS, SWEEP_MINUTES).replace(_W, _MINUTES).replace("exp(-d / ", "exp(-least(d, 1e6) / ").replace("from dist d join sh", "from mins d join sh")
ORACLE["tune_sweep_network"] = f"{_BY_ROAD} select {_SHOWN.format(kind='exp')} from trace"


def _measured(sql: str) -> str:
    return f"""with base as ({sql}), r as (select *, row_number() over (partition by region order by value, cell_id) as i, row_number() over (partition by region order by value desc, cell_id) as k, count(*) over (partition by region) as n from base)
select region, round((2 * sum(i * value) - (max(n) + 1) * sum(value)) / (max(n) * sum(value)), 4) as gini, round(coalesce(sum(value) filter (where k <= greatest(1, round_even(n * 0.1e0, 0))), 0) / sum(value), 4) as top_share from r group by region"""


ORACLE["maxent_metrics"] = _measured(ORACLE["maxent_alloc"])
ORACLE["network_metrics"] = _measured(ORACLE["alloc_network"])
