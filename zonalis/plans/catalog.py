"""One query for each operator, over the driver's tables.

The tables hold no geometry: customers stand for cells and suppliers for places, with coordinates made from
their keys by integer arithmetic; orders by nation, priority and year are the indicators, events the pixels, and
nations with the trade between them the road graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions import scalar
from zonalis.operators import allocate, chains, distance, graph, grid, maxent, metrics, overlay, region, regress, tune
from zonalis.plans import report
from zonalis.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
DIGITS = 6
SCALES, BETAS = (5.0, 10.0, 20.0), (1.0, 2.77)
SWEEP = {"exp": (3.0, 5.0, 8.0, 10.0, 15.0, 20.0, 30.0, 40.0, 60.0), "gauss": (3.0, 5.0, 8.0, 10.0, 15.0, 20.0, 30.0, 40.0, 60.0), "power": (1.0, 1.5, 2.0, 2.5, 3.0, 4.0)}
SWEEP_MINUTES, SWEEP_BETAS = (5.0, 10.0, 15.0, 20.0, 30.0, 45.0, 60.0, 90.0), (1.0, 1.5, 2.0, 2.77)
FEATURES = ("population", "urban_pop", "investments")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _regions(spark, sf) -> DataFrame:
    n, r = t(spark, sf, "nation"), t(spark, sf, "region")
    return F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", F.col("r_name").alias("region"), "r_regionkey"))


def _at(key: str, m: int):
    return (F.lit(100.0) + (F.col(key) * m) % 40000 / F.lit(100.0)) * 1000


def cells(spark, sf) -> DataFrame:
    c = t(spark, sf, "customer")
    c = c.join(_regions(spark, sf), c.c_nationkey == F.col("n_nationkey"))
    return c.select(
        "region", F.col("c_custkey").alias("cell_id"), _at("c_custkey", 7919).alias("x"), _at("c_custkey", 104729).alias("y"),
        F.greatest("c_acctbal", F.lit(0.0)).alias("population"), (F.lit(1.0) + F.col("c_custkey") % 3 / F.lit(4.0)).alias("area_km2"),
    )


def places(spark, sf) -> DataFrame:
    s = t(spark, sf, "supplier").where("s_acctbal > 0")
    s = s.join(_regions(spark, sf), s.s_nationkey == F.col("n_nationkey"))
    return s.select("region", F.col("s_suppkey").alias("place_id"), _at("s_suppkey", 15485863).alias("x"), _at("s_suppkey", 32452843).alias("y"), F.col("s_acctbal").alias("population"))


def totals(spark, sf) -> DataFrame:
    return t(spark, sf, "region").select(F.col("r_name").alias("region"), (F.lit(100.0) + F.col("r_regionkey") * 10).alias("x_total"))


def centres(spark, sf) -> DataFrame:
    return t(spark, sf, "region").select(F.col("r_name").alias("region"), F.lit(300000.0).alias("cx"), F.lit(300000.0).alias("cy"))


def featured(spark, sf) -> DataFrame:
    """Cells with their distances, written once: sums and shares read them again."""
    return graph.settle(distance.with_nearest(distance.to_point(cells(spark, sf), centres(spark, sf)), places(spark, sf)).drop("place_id"))


def _out(df: DataFrame) -> DataFrame:
    return df.select("region", "cell_id", F.round("value", DIGITS).alias("value"))


def _long(spark, sf) -> DataFrame:
    """Three methods as one long frame, from one pass over the cells."""
    return allocate.several(cells(spark, sf), totals(spark, sf), ("area", "population", "elasticity"))


# ------------------------------------------------------------------ allocation
@query
def alloc_uniform(spark, sf):
    return _out(allocate.area(cells(spark, sf), totals(spark, sf)))


@query
def alloc_proximity(spark, sf):
    return _out(allocate.proximity(featured(spark, sf), totals(spark, sf)))


@query
def alloc_agri(spark, sf):
    return _out(allocate.remoteness(featured(spark, sf), totals(spark, sf)))


@query
def alloc_naive_nearest(spark, sf):
    return _out(allocate.nearest_place(featured(spark, sf), totals(spark, sf)))


@query
def alloc_population(spark, sf):
    return _out(allocate.population(cells(spark, sf), totals(spark, sf)))


@query
def alloc_elasticity(spark, sf):
    return _out(allocate.elasticity(cells(spark, sf), totals(spark, sf)))


def _decay(spark, sf, **options):
    return _out(allocate.decay(cells(spark, sf), places(spark, sf), totals(spark, sf), **options))


@query
def alloc_decay_exp(spark, sf):
    return _decay(spark, sf, scale=10.0, kind="exp")


@query
def alloc_decay_gauss(spark, sf):
    return _decay(spark, sf, scale=10.0, kind="gauss")


@query
def alloc_decay_power(spark, sf):
    return _decay(spark, sf, scale=2.5, kind="power")


@query
def alloc_decay_nopop(spark, sf):
    return _decay(spark, sf, scale=10.0, use_population=False)


@query
def alloc_decay_beta277(spark, sf):
    return _decay(spark, sf, scale=10.0, beta=2.77)


def _shops(spark, sf):
    """Parts as many small places."""
    p, k = t(spark, sf, "part"), F.col("p_partkey")
    r = t(spark, sf, "region").select("r_regionkey", F.col("r_name").alias("region"))
    p = p.join(F.broadcast(r), (k % 5) == F.col("r_regionkey"))
    return p.select("region", k.alias("place_id"), _at("p_partkey", 15485863).alias("x"), _at("p_partkey", 32452843).alias("y"), F.col("p_retailprice").alias("population"))


def _far(spark, sf, kind, scale):
    """Places far from a cell count together, to a thousand millionth of its weight."""
    v = allocate.decay(cells(spark, sf), _shops(spark, sf), totals(spark, sf), scale, kind, buffer_km=None, far=1e-9, order=8, leaf_km=10.0)
    return v.select("region", "cell_id", F.round("value", 5).alias("value"))


@query
def alloc_far_exp(spark, sf):
    return _far(spark, sf, "exp", 5.0)


@query
def alloc_far_gauss(spark, sf):
    return _far(spark, sf, "gauss", 20.0)


@query
def alloc_zero_total_fallback(spark, sf):
    """No place is ever reached: equal shares."""
    nowhere = F.lit(float("inf"))
    return _out(allocate.decay(cells(spark, sf), places(spark, sf).withColumns({"x": nowhere, "y": nowhere}), totals(spark, sf), 10.0, buffer_km=None))


@query
def alloc_rescaled(spark, sf):
    return _out(allocate.rescale(allocate.population(cells(spark, sf), totals(spark, sf))))


@query
def alloc_by_name(spark, sf):
    return _out(allocate.run(featured(spark, sf), totals(spark, sf), "proximity"))


@query
def city_mass(spark, sf):
    return allocate.masses(places(spark, sf), 2.77).select("region", "place_id", F.round("mass", DIGITS).alias("mass"))


@query
def kernel_curve(spark, sf):
    """The kernels up to the distance of the cell that is farthest from its centre."""
    top = distance.to_point(cells(spark, sf), centres(spark, sf)).agg(F.max("dist_to_center_km")).first()[0]
    return report.kernel_curves([("exp", 10.0), ("gauss", 10.0), ("power", 2.5)], spark, top).select("kind", F.round("d", DIGITS).alias("d"), F.round("f", DIGITS).alias("f"))


@query
def mercator_roundtrip(spark, sf):
    lon, lat = (F.col("c_custkey") * 7919) % 36000 / F.lit(100.0) - 180, (F.col("c_custkey") * 104729) % 16000 / F.lit(100.0) - 80
    p = t(spark, sf, "customer").select("c_custkey", lon.alias("lon"), lat.alias("lat"))
    p = distance.project(p)
    return p.select("c_custkey", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round(scalar.merc_lon(F.col("x")), DIGITS).alias("lon"), F.round(scalar.merc_lat(F.col("y")), DIGITS).alias("lat"))


# ------------------------------------------------------------------ distances
@query
def dist_matrix(spark, sf):
    return distance.matrix(cells(spark, sf), places(spark, sf), DIGITS).select("cell_id", "place_id", "d")


@query
def nearest_city(spark, sf):
    return distance.nearest(cells(spark, sf), places(spark, sf)).select("cell_id", "place_id", F.round("dist_to_city_km", DIGITS).alias("d"))


@query
def cities_in_buffer(spark, sf):
    return distance.within_buffer(places(spark, sf), cells(spark, sf), 12.0).select("region", "place_id")


@query
def attached_distances(spark, sf):
    """Distances to the centre, the nearest place and, for one region, a capital; the columns that stand for the centre."""
    a = distance.attach(cells(spark, sf), places(spark, sf), centres(spark, sf), (200000.0, 250000.0), "ASIA")
    out = a.select("cell_id", *[F.round(c, DIGITS).alias(c) for c in ("dist_to_center_km", "dist_to_city_km", "dist_to_moscow_km")])
    chosen = [distance.centre_column(a.drop(*gone)) for gone in ((), ("dist_to_center_km",), ("dist_to_center_km", "dist_to_moscow_km"))]
    return out.withColumn("stand_in", F.lit(",".join(chosen)))


@query
def dist_to_center(spark, sf):
    return distance.to_point(cells(spark, sf), centres(spark, sf)).select("cell_id", F.round("dist_to_center_km", DIGITS).alias("d"))


# ------------------------------------------------------------------ grids
def _boxes(spark, sf):
    k = F.col("n_nationkey")
    n = t(spark, sf, "nation")
    return n.select(F.col("n_name").alias("region"), (k * 70123.0 + 250).alias("xmin"), (k * 30011.0 - 400).alias("ymin"), (k * 70123.0 + 250 + 8000 + k * 100).alias("xmax"), (k * 30011.0 - 400 + 9500.0).alias("ymax"))


@query
def grid_lattice_box(spark, sf):
    return grid.lattice(_boxes(spark, sf)).select("region", "ix", "iy")


def _grid(df: DataFrame) -> DataFrame:
    return df.select("region", "ix", "iy", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), F.round("area_km2", DIGITS).alias("area_km2"))


@query
def grid_area_centroid(spark, sf):
    return _grid(grid.box_grid(_boxes(spark, sf)))


@query
def grid_coarse(spark, sf):
    return _grid(grid.box_grid(_boxes(spark, sf), 10_000.0))


def _border(spark, sf):
    """The boxes as rings, each with a square hole of 2 km in its corner."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    b = _boxes(spark, sf)
    x0, y0, x1, y1 = (F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    ring = lambda x0, y0, x1, y1: F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    outer = b.select("region", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), ring(x0, y0, x1, y1).alias("pts"))
    hole = b.select("region", F.lit(0).alias("part"), F.lit(1).alias("ring"), F.lit(True).alias("is_hole"), ring(x0 + 1000, y0 + 1000, x0 + 3000, y0 + 3000).alias("pts"))
    return outer.union(hole)


@query
def grid_polygon(spark, sf):
    return _grid(grid.polygon_grid(grid.without_holes(_border(spark, sf))))


def _l_shape(spark, sf):
    """The boxes without their upper right part (not convex), with the hole; the corner is at 0.55 of the width, 0.4 of the height."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x0, y0, x1, y1 = (F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    xm, ym = x0 + (x1 - x0) * 0.55, y0 + (y1 - y0) * 0.4
    outer = F.array(p(x0, y0), p(x1, y0), p(x1, ym), p(xm, ym), p(xm, y1), p(x0, y1))
    return _border(spark, sf).join(_boxes(spark, sf), "region").select("region", "part", "ring", "is_hole", F.when(F.col("is_hole"), F.col("pts")).otherwise(outer).alias("pts"))


@query
def grid_l_shape(spark, sf):
    return _grid(grid.polygon_grid(_l_shape(spark, sf)))


@query
def cell_overlay(spark, sf):
    """Cells cut by a border that is not convex and has a hole: the area of each cut geometry."""
    return overlay.cut_cells(_l_shape(spark, sf)).select("region", "ix", "iy", F.round("area_km2", DIGITS).alias("area_km2"))


def _plots(spark, sf):
    """A rectangle for each supplier, near its nation's box, as (region, part, ring, is_hole, pts)."""
    k = F.col("s_suppkey")
    s = t(spark, sf, "supplier").join(_boxes(spark, sf).join(t(spark, sf, "nation"), F.col("n_name") == F.col("region")), F.col("s_nationkey") == F.col("n_nationkey"))
    x, y = F.col("xmin") - 900 + (k * 7919) % 8000, F.col("ymin") - 700 + (k * 104729) % 9000
    p = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    w, h = F.lit(1250.37) + k % 7 * 300, F.lit(900.71) + k % 5 * 700
    return s.select(k.cast("string").alias("region"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), F.array(p(0, 0), p(w, 0), p(w, h), p(0, h)).alias("pts"))


@query
def overlay_pairs(spark, sf):
    """The area that each supplier's rectangle has in common with a border that is not convex and has a hole."""
    both = overlay.intersections(_l_shape(spark, sf), _plots(spark, sf), names=("region", "plot"))
    return both.groupBy("region", "plot").agg(F.round(F.sum("area_km2"), DIGITS).alias("area_km2")).where("area_km2 > 0")


@query
def region_outline(spark, sf):
    """Each box as two halves and a hole: one outline without the hole and without points on straight sides."""
    p = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    x0, y0, x1, y1 = (F.col(k) for k in ("xmin", "ymin", "xmax", "ymax"))
    xm = (x0 + x1) / 2
    half = lambda k, a, b: _boxes(spark, sf).select("region", F.lit(k).alias("part"), F.lit(0).alias("ring"), F.lit(False).alias("is_hole"), F.array(p(a, y0), p(b, y0), p(b, y1), p(a, y1)).alias("pts"))
    halves = half(0, x0, xm).union(half(1, xm, x1)).union(_border(spark, sf).where("is_hole"))
    out = grid.region_polygon(halves, 1.0).withColumn("n", F.size("pts"))
    return out.join(grid.polygon_area(out), "region").select("region", F.col("n").cast("long").alias("n"), F.round("area_km2", DIGITS).alias("area_km2"))


@query
def inner_point(spark, sf):
    return grid.representative_point(_l_shape(spark, sf)).select("region", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _event_points(spark, sf):
    """A point of each event in each box, with the event's value; errors have none."""
    k = F.col("event_id")
    value = F.when(F.col("event_type") == "error", F.lit(-99999.0)).otherwise(F.col("value"))
    keys = t(spark, sf, "nation").agg(F.collect_list("n_name")).scalar()
    e = t(spark, sf, "events").select("event_id", value.alias("value"), F.explode(keys).alias("region")).join(_boxes(spark, sf), "region")
    return e.select("region", (F.col("xmin") - 500 + (k * 7919) % 12000).alias("x"), (F.col("ymin") - 500 + (k * 104729) % 12000).alias("y"), "value")


@query
def zonal_sum_border(spark, sf):
    """Sums over cells that the border cuts take the pixels inside it only."""
    border = _l_shape(spark, sf)
    z = grid.zonal_sum(grid.polygon_grid(border), _event_points(spark, sf), border=border)
    return z.select("region", "ix", "iy", F.round("population", 4).alias("population"))


@query
def features_grid(spark, sf):
    """Population, distances to the middle of the box, to the nearest supplier's place and, in one region, to the capital."""
    border, b = _l_shape(spark, sf), _boxes(spark, sf)
    s = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("region")).join(b, "region")
    k = F.col("s_suppkey")
    towns = s.select("region", k.alias("place_id"), (F.col("xmin") + (k * 7919) % 8000).alias("x"), (F.col("ymin") + (k * 104729) % 9000).alias("y"))
    middle = b.select("region", ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    f = region.with_features(grid.polygon_grid(border), _event_points(spark, sf), towns, middle, border, (70000.0, 30000.0), "NATION_1")
    return f.select("region", "ix", "iy", F.round("population", 4).alias("population"), *[F.round(c, 5).alias(c) for c in ("dist_to_center_km", "dist_to_city_km", "dist_to_moscow_km")])


@query
def alloc_coarse(spark, sf):
    """Population of squares of 10 km over the border's envelope, and a total spread by it."""
    b = grid.bounds(_l_shape(spark, sf))
    c = grid.zonal_sum(grid.box_grid(b, 10_000.0), _event_points(spark, sf), 10_000.0)
    x = t(spark, sf, "nation").select(F.col("n_name").alias("region"), (F.lit(100.0) + F.col("n_nationkey")).alias("x_total"))
    return allocate.run(c, x, "population").select("region", "ix", "iy", F.round("population", 4).alias("population"), F.round("value", DIGITS).alias("value"))


@query
def tagged_towns(spark, sf):
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Point", "LineString", "Polygon", "MultiPolygon")]), ((k % 4) + 1).cast("int"))
    place = F.element_at(F.array(*[F.lit(x) for x in ("city", "town", "village")]), ((F.col("s_nationkey") % 3) + 1).cast("int"))
    f = t(spark, sf, "supplier").select(k.alias("id"), ((k * 37) % 360 - 180).cast("double").alias("lon"), ((k * 53) % 170 - 85).cast("double").alias("lat"), F.create_map(F.lit("place"), place).alias("tags"), kind.alias("geometry_type"))
    return files.tagged(f, (-150.0, -80.0, 120.0, 80.0)).select("id", "geometry_type")


@query
def border_area(spark, sf):
    return grid.polygon_area(_border(spark, sf)).select("region", F.round("area_km2", DIGITS).alias("area_km2"))


@query
def border_bounds(spark, sf):
    return grid.bounds(_border(spark, sf))


@query
def points_in_border(spark, sf):
    """A point of each event in each of the regions."""
    k, boxes = F.col("event_id"), _boxes(spark, sf)
    keys = t(spark, sf, "nation").agg(F.collect_list("n_name")).scalar()
    e = t(spark, sf, "events").select("event_id", F.explode(keys).alias("region")).join(boxes, "region")
    pts = e.select("region", "event_id", (F.col("xmin") - 500 + (k * 7919) % 12000).alias("x"), (F.col("ymin") - 500 + (k * 104729) % 12000).alias("y"))
    return grid.points_inside(pts, _border(spark, sf)).select("region", "event_id")


@query
def zonal_sum(spark, sf):
    k = F.col("event_id")
    e = t(spark, sf, "events")
    value = F.when(F.col("event_type") == "error", F.lit(-99999.0)).otherwise(F.col("value"))
    pixels = e.select(F.lit("one").alias("region"), ((k * 7919) % 20000).cast("double").alias("x"), ((k * 104729) % 20000).cast("double").alias("y"), value.alias("value"))
    box = spark.range(1).select(F.lit("one").alias("region"), F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(25000.0).alias("xmax"), F.lit(20000.0).alias("ymax"))
    return grid.zonal_sum(grid.box_grid(box), pixels).select("ix", "iy", F.round("population", 4).alias("population"))


# ------------------------------------------------------------------ metrics and reports
@query
def gini_all_forms(spark, sf):
    v = _long(spark, sf)
    a, b = metrics.gini(v), metrics.gini(v, keep="nonnegative").withColumnRenamed("gini", "gini_nonnegative")
    return a.join(b, ["region", "method"]).select("region", "method", F.round("gini", DIGITS).alias("gini"), F.round("gini_nonnegative", DIGITS).alias("gini_nonnegative"))


def _top(spark, sf, mode):
    return metrics.top_share(_long(spark, sf), mode=mode).select("region", "method", F.round("top_share", DIGITS).alias("top_share"))


@query
def top_share_round(spark, sf):
    return _top(spark, sf, "all_round")


@query
def top_share_trunc(spark, sf):
    return _top(spark, sf, "positive_trunc")


@query
def top_share_inline(spark, sf):
    return _top(spark, sf, "all_trunc")


@query
def summary_table(spark, sf):
    return report.summary(metrics.table(_long(spark, sf))).drop("top")


@query
def summary_lookup(spark, sf):
    """One row of the summary by its labels, as it is printed."""
    row = report.lookup(report.summary(metrics.table(_long(spark, sf))), method="elasticity", region="ASIA")
    return row.select("region", "method", "gini", "top")


@query
def number_formats(spark, sf):
    x = (F.col("c_acctbal") + 0.0013) / 7  # no ties: engines round them either way
    return t(spark, sf, "customer").select("c_custkey", report.percent(x / 1000).alias("share"), report.thousands(x * 1000).alias("whole"), F.format_string("%.3f", x).alias("three"))


@query
def summary_pivot(spark, sf):
    s = metrics.table(_long(spark, sf)).select("region", "method", F.round("gini", 3).alias("gini"), F.round("top_share", 2).cast("string").alias("top"))
    p = report.pivot(s, ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])
    return p.select("method", *[F.col(f"`{r}`").alias(r.lower().replace(" ", "_")) for r in p.columns[1:]])


@query
def mass_check(spark, sf):
    return metrics.mass_check(_long(spark, sf), totals(spark, sf)).select("region", "method", F.round("total", DIGITS).alias("total"), "x_total", "ok")


@query
def max_min_ratio(spark, sf):
    return metrics.max_min_ratio(_long(spark, sf).where("method = 'area'")).select("region", F.round("ratio", DIGITS).alias("ratio"))


@query
def quantile_vmax(spark, sf):
    c = metrics.colour_limits(_long(spark, sf))
    return c.select("region", "method", *[F.round(k, DIGITS).alias(k) for k in ("vmin", "vmax", "vq")])


@query
def describe_weights(spark, sf):
    d = metrics.describe(cells(spark, sf), "population")
    return d.select("region", "n", *[F.round(k, 4).alias(k) for k in ("mean", "std")], "low", *[F.round(k, 4).alias(k) for k in ("q25", "q50", "q75")], "high")


@query
def upsert_summary(spark, sf):
    old = metrics.gini(_long(spark, sf))
    new = old.where("method = 'area'").withColumn("gini", F.lit(-1.0)).unionByName(old.where("method = 'area'").withColumns({"gini": F.lit(-2.0), "method": F.lit("extra")}))
    return report.upsert(old, new, "region", "method").select("region", "method", F.round("gini", DIGITS).alias("gini"))


@query
def methods_dropped(spark, sf):
    return report.drop_methods(_long(spark, sf), "popul.tion").groupBy("method").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ tuning
def _trace(spark, sf):
    return tune.gravity(cells(spark, sf), places(spark, sf), "exp", SCALES, BETAS)


@query
def tune_gravity_trace(spark, sf):
    return _trace(spark, sf).select("region", "beta", "scale", F.round("rho", 4).alias("rho"))


@query
def tune_gravity_best(spark, sf):
    return tune.best(_trace(spark, sf)).select("region", "beta", "scale", F.round("rho", 4).alias("rho"))


@query
def tune_sigma(spark, sf):
    return tune.best(tune.gravity(cells(spark, sf), places(spark, sf), "gauss", SCALES)).select("region", "scale", F.round("rho", 4).alias("rho"))


def _sweep(spark, sf, kind):
    return tune.gravity(cells(spark, sf), places(spark, sf), kind, SWEEP[kind], SWEEP_BETAS)


def _swept(trace: DataFrame) -> DataFrame:
    return trace.select("region", "kind", "beta", "scale", F.round("rho", 4).alias("rho"))


@query
def tune_sweep_exp(spark, sf):
    return _swept(_sweep(spark, sf, "exp"))


@query
def tune_sweep_gauss(spark, sf):
    return _swept(_sweep(spark, sf, "gauss"))


@query
def tune_sweep_power(spark, sf):
    return _swept(_sweep(spark, sf, "power"))


@query
def tune_sweep_network(spark, sf):
    """The sweep over travel minutes on the whole road graph."""
    c, p = cells(spark, sf), places(spark, sf)
    near = allocate.masses(distance.within_buffer(p, c, 30.0), 1.0).select("place_id", F.col("mass").alias("share"))
    return _swept(tune.by_road(_legs(spark, sf), near, c.select("region", "cell_id", F.col("population").alias("target")), "exp", SWEEP_MINUTES, SWEEP_BETAS))


@query
def tune_sweep_best(spark, sf):
    """The best of each kernel's grid."""
    return _swept(tune.best(tune.kernels(cells(spark, sf), places(spark, sf), SWEEP, SWEEP_BETAS)))


@query
def kernel_metrics(spark, sf):
    """Of each region and kernel the best parameters and how concentrated the allocation by them is."""
    c, p = cells(spark, sf), places(spark, sf)
    chosen = graph.settle(tune.best(tune.kernels(c, p, SWEEP, SWEEP_BETAS)))
    m = metrics.table(tune.allocated(c, p, totals(spark, sf), chosen), by=("region", "kind"))
    return m.join(chosen, ["region", "kind"]).select("region", "kind", "beta", "scale", F.round("gini", 5).alias("gini"), F.round("top_share", 5).alias("top_share"))


@query
def spearman_ties(spark, sf):
    return tune.spearman(cells(spark, sf).withColumn("b", F.floor(F.col("x") / 50000)), "population", "b", ("region",)).select("region", F.round("rho", DIGITS).alias("rho"))


# ------------------------------------------------------------------ indicators
def facts(spark, sf) -> DataFrame:
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey).join(_regions(spark, sf), c.c_nationkey == F.col("n_nationkey"))
    return j.groupBy("n_name", "region", "o_orderpriority", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("v")).select(
        F.col("n_name").alias("object_name"), F.lit("nation").alias("object_level"), F.col("o_orderpriority").alias("indicator_code"), F.col("o_orderpriority").alias("indicator_name"), F.col("region").alias("section"), "year", F.col("v").alias("indicator_value"))


@query
def indicator_filter(spark, sf):
    return report.region_values(facts(spark, sf), "1-URGENT", 1996, "nation").select("object_name", F.round("value", 2).alias("value"))


@query
def indicator_latest(spark, sf):
    return report.latest(facts(spark, sf), "object_name", "indicator_code").select("object_name", "indicator_code", "year", F.round("indicator_value", 2).alias("indicator_value"))


@query
def keyword_search(spark, sf):
    return t(spark, sf, "documents").where(scalar.contains(F.col("text"), "ÜBER|éré")).select("doc_id")


@query
def keyword_distinct(spark, sf):
    return report.search(t(spark, sf, "part"), "p_type", "promo|SMALL", "p_type", "p_size")


@query
def section_nunique_topk(spark, sf):
    return report.sections(facts(spark, sf).withColumn("indicator_code", F.concat("object_name", "indicator_code")), 3)


@query
def year_span(spark, sf):
    return facts(spark, sf).groupBy("indicator_code").agg(F.min("year").cast("long").alias("first"), F.max("year").cast("long").alias("last"), F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"), F.countDistinct("object_name").alias("objects"))


@query
def distinct_pairs(spark, sf):
    return t(spark, sf, "part").select("p_brand", "p_type").distinct()


@query
def missing_share(spark, sf):
    c = t(spark, sf, "customer")
    return c.groupBy("c_mktsegment").agg(F.count_if(F.col("c_acctbal") <= 0).alias("n"), F.round(F.avg((F.col("c_acctbal") > 0).cast("double")), DIGITS).alias("share"))


# ------------------------------------------------------------------ regression
def training(spark, sf) -> DataFrame:
    o = t(spark, sf, "orders")
    by = o.groupBy(F.col("o_custkey").alias("object_name"))
    name = lambda df, v: df.select("object_name", F.col(v).alias("value"))
    sums = by.agg(F.sum("o_totalprice").alias("s"), F.count("*").cast("double").alias("n"), F.max("o_totalprice").alias("m"))
    people = t(spark, sf, "customer").select(F.col("c_custkey").alias("object_name"), F.col("c_acctbal").alias("value"))
    j = report.joined(sums.select("object_name", F.col("s").alias("otgr")), ("population", people), ("urban_pop", name(sums, "n")), ("investments", name(sums, "m")))
    return regress.positive(j, ("otgr", *FEATURES))


@query
def train_join(spark, sf):
    return training(spark, sf).select("object_name", F.round("otgr", 2).alias("otgr"), "population", "urban_pop", "investments")


@query
def ols_coefficients(spark, sf):
    return regress.fit(training(spark, sf), "otgr", FEATURES).table(spark).select("term", F.round("coefficient", 4).alias("coefficient"))


@query
def ols_r2(spark, sf):
    d = training(spark, sf)
    return regress.r2(d, "otgr", regress.fit(d, "otgr", FEATURES)).select(F.round("r2", DIGITS).alias("r2"))


@query
def ols_outliers_top5(spark, sf):
    d = training(spark, sf)
    return regress.outliers(d, "otgr", regress.fit(d, "otgr", FEATURES), "object_name").select("object_name", F.round("predicted", 2).alias("predicted"), F.round("residual", DIGITS).alias("residual"))


@query
def cv_r2(spark, sf):
    return regress.cross_validate(training(spark, sf), "otgr", FEATURES, F.col("object_name") % 5).select("folds", F.round("r2_mean", 5).alias("r2_mean"), F.round("r2_std", 5).alias("r2_std"))


# ------------------------------------------------------------------ maximum entropy
@query
def zscore_features(spark, sf):
    return maxent.features(featured(spark, sf)).select("cell_id", *[F.round(f, DIGITS).alias(f) for f in maxent.FEATURES])


@query
def reference_weights(spark, sf):
    return maxent.reference(featured(spark, sf)).select("cell_id", F.round("ref", 8).alias("ref"))


@query
def constraint_targets(spark, sf):
    return maxent.targets(maxent.prepared(featured(spark, sf))).select("region", *[F.round(f"t{k}", DIGITS).alias(f"t{k}") for k in (1, 2, 3)])


@query
def maxent_achieved(spark, sf):
    frame = maxent.prepared(featured(spark, sf), 1.0, 0.5)
    done, _ = maxent.allocate_frame(frame, totals(spark, sf))
    d = maxent.diagnostics(done, maxent.targets(frame))
    return d.select("region", "feature", F.round("achieved", 4).alias("achieved"))


@query
def maxent_scenarios(spark, sf):
    """The strict and the smooth scenario in one frame: means that were asked for and reached."""
    cells_ = featured(spark, sf)
    frame = maxent.features(cells_)
    done, _ = maxent.scenarios(cells_, totals(spark, sf))
    goals = None
    for name, (elasticity, power) in maxent.SCENARIOS.items():
        one = maxent.diagnostics(done.where(F.col("scenario") == name), maxent.targets(maxent.reference(frame, elasticity, power))).withColumn("scenario", F.lit(name))
        goals = one if goals is None else goals.unionByName(one)
    return goals.select("region", "scenario", "feature", F.round("achieved", 4).alias("achieved"))


@query
def maxent_alloc(spark, sf):
    return _out(maxent.allocate(featured(spark, sf), totals(spark, sf), 1.0, 0.5, tolerance=1e-11))


def _measured(values: DataFrame) -> DataFrame:
    return metrics.table(values, by=("region",)).select("region", F.round("gini", 4).alias("gini"), F.round("top_share", 4).alias("top_share"))


@query
def maxent_metrics(spark, sf):
    """How concentrated the allocation by maximum entropy is."""
    return _measured(maxent_alloc(spark, sf))


# ------------------------------------------------------------------ roads
def roads(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nations as nodes, and their trade with each other as edges."""
    n = t(spark, sf, "nation")
    k = F.col("n_nationkey")
    nodes = n.select(k.cast("long").alias("id"), ((F.lit(100.0) + (k * 7919) % 400) * 1000).alias("x"), ((F.lit(100.0) + (k * 104729) % 400) * 1000).alias("y"))
    li, o, c, s = (t(spark, sf, x) for x in ("lineitem", "orders", "customer", "supplier"))
    buyer = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey")
    j = li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", "l_quantity", "s_nationkey").join(buyer, F.col("l_orderkey") == F.col("o_orderkey"))
    e = j.groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).agg((F.sum("l_quantity") / F.count("*")).alias("travel_time"))
    return nodes, e


@query
def road_undirected(spark, sf):
    return graph.undirected(roads(spark, sf)[1]).select("src", "dst", F.round("travel_time", DIGITS).alias("travel_time"))


@query
def shortest_paths(spark, sf):
    nodes, edges = roads(spark, sf)
    seeds = nodes.select(F.col("id").alias("place_id"), F.col("id").alias("node"))
    return graph.shortest(seeds, graph.undirected(edges)).select("place_id", "node", F.round("sec", DIGITS).alias("sec"))


@query
def largest_component(spark, sf):
    return graph.largest_component(*roads(spark, sf)).select("id")


def _lanes(spark, sf) -> DataFrame:
    """Each customer's orders as a lane that leaves its nation, and nations on the way to their region; both directions."""
    from pyspark.sql import Window as W

    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    o = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_custkey", "c_nationkey", "o_totalprice")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    lane = o.select(F.coalesce(before, (-1 - F.col("c_nationkey")).cast("long")).alias("src"), F.col("o_orderkey").alias("dst"), (F.col("o_totalprice") / 1000).alias("travel_time"))
    n = t(spark, sf, "nation").select((-100 - F.col("n_regionkey")).cast("long").alias("src"), (-1 - F.col("n_nationkey")).cast("long").alias("dst"), (F.col("n_nationkey") + 10.0).alias("travel_time"))
    return graph.undirected(lane.union(n))


@query
def road_chains(spark, sf):
    """One edge for each customer's lane, from the nation to the last order."""
    hubs = t(spark, sf, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("node"))
    short, _ = chains.contract(_lanes(spark, sf), hubs)
    return short.where("src < 0 and dst >= 0").select("src", "dst", F.round("travel_time", DIGITS).alias("travel_time"))


@query
def shortest_chains(spark, sf):
    """Times from the regions to all orders, without a round for each order on the way."""
    seeds = t(spark, sf, "region").select((-100 - F.col("r_regionkey")).cast("long").alias("place_id"), (-100 - F.col("r_regionkey")).cast("long").alias("node"))
    return chains.shortest(seeds, _lanes(spark, sf)).where("node >= 0").select("place_id", "node", F.round("sec", DIGITS).alias("sec"))


@query
def nearest_on_sphere(spark, sf):
    """The supplier nearest to each customer along great circles, over the whole globe."""
    at = lambda k: ((F.col(k) * 7919 % 36000 / F.lit(100.0) - 180).alias("lon"), (F.col(k) * 104729 % 17900 / F.lit(100.0) - 89.5).alias("lat"))
    points, nodes = t(spark, sf, "customer").select("c_custkey", *at("c_custkey")), t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), *at("s_suppkey"))
    return graph.nearest_on_sphere(points, nodes, "c_custkey").select("c_custkey", "node", F.round("off_m", 2).alias("off_m"))


@query
def edge_times(spark, sf):
    s = t(spark, sf, "supplier")
    e = s.select(F.col("s_suppkey").alias("src"), (F.col("s_suppkey") + 1).alias("dst"), (F.col("s_suppkey") * 100.0).alias("length"), F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("h"), (F.col("s_nationkey") % 3).cast("string"))).alias("highway"), F.when(F.col("s_suppkey") % 4 != 0, 30.0 + F.col("s_suppkey") % 50).alias("maxspeed"))
    return graph.edge_times(e).select("src", F.round("travel_time", DIGITS).alias("travel_time"))


def _legs(spark, sf):
    return graph.legs(cells(spark, sf), places(spark, sf), *roads(spark, sf))


@query
def network_minutes(spark, sf):
    return graph.travel_minutes(cells(spark, sf), places(spark, sf), *roads(spark, sf), digits=5).select("cell_id", "place_id", "d")


@query
def alloc_network(spark, sf):
    return _out(allocate.run(cells(spark, sf), totals(spark, sf), "network", places=places(spark, sf), minutes=_legs(spark, sf), scale=30.0, buffer_km=None))


@query
def network_metrics(spark, sf):
    """How concentrated the allocation over the road graph is."""
    return _measured(alloc_network(spark, sf))


@query
def reachable_share(spark, sf):
    return graph.reachable_share(_legs(spark, sf)).select("region", F.round("share", DIGITS).alias("share"))


# ------------------------------------------------------------------ documents from the web
@query
def json_cities(spark, sf):
    """Suppliers as elements of map answers, fifty in one: nodes and ways with a centre, some without a name or a place, names that come
    again, and populations as people write them."""
    k = F.col("s_suppkey")
    lon, lat = ((k * 37) % 360 - 180).cast("double"), ((k * 53) % 170 - 85).cast("double")
    node = k % 3 != 0
    people = F.when(k % 4 == 0, F.concat(k.cast("string"), F.lit(",250"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit(" 100"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".5")))
    name, kind = F.when(k % 11 != 0, F.concat(F.lit("N"), (k % 60).cast("string"))), F.when(k % 2 == 0, "city").otherwise("town")
    centre = F.when(~node & (k % 13 != 0), F.struct(lat.alias("lat"), lon.alias("lon")))
    row = F.struct(k.alias("id"), F.when(node, "node").otherwise("way").alias("type"), F.when(node, lat).alias("lat"), F.when(node, lon).alias("lon"), centre.alias("center"), name.alias("name"), people.alias("people"), kind.alias("kind"))
    rows = t(spark, sf, "supplier").groupBy(F.floor(k / 50).alias("answer")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    tagged = lambda e: F.struct(*[e[c].alias(c) for c in ("id", "type", "lat", "lon", "center")], F.create_map(F.lit("name"), e["name"], F.lit("population"), e["people"], F.lit("place"), e["kind"]).alias("tags"))
    answers = rows.select("answer", F.transform("rows", tagged).alias("elements"))
    return files.overpass_places(answers.select("answer", F.to_json(F.struct("elements")).alias("json")), order="answer")


@query
def json_numbers(spark, sf):
    e = t(spark, sf, "events")
    k = F.from_json("props", "struct<k: bigint>")["k"]
    return e.select("event_id", k.alias("k"), scalar.whole_number(F.concat(k.cast("string"), F.lit(" 0,1"))).alias("n"))


@query
def dedupe_first(spark, sf):
    """The first event of each user and type."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id")
