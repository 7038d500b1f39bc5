"""Sums over spots: against a row for each pair, in small blocks, and on tables whose pairs would not end."""

import time

import numpy as np
from pyspark.sql import functions as F

from zonalis.operators import allocate, distance, graph, spots, tune

INF = float("inf")


def test_sums_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(spots, "CELLS", 3)
    monkeypatch.setattr(spots, "PLACES", 4)
    monkeypatch.setattr(spots, "SLICE", 5)
    rng = np.random.default_rng(3)
    cells = [("a" if k % 3 else "b", float(x), float(y)) for k, (x, y) in enumerate(rng.integers(0, 9000, (25, 2)))] + [("none", 1.0, 1.0)]
    places = [("a" if k % 2 else "b", float(x), float(y), 2.0, None if k % 5 == 0 else k / 20, None) for k, (x, y) in enumerate(rng.integers(0, 9000, (21, 2)))] + [("a", INF, 0.0, 2.0, 1.0, None)]
    p = spark.createDataFrame(places, "region string, x double, y double, s double, m double, gone double")
    terms = [("exp", 2.0, "m"), ("gauss", "s", "m"), ("power", 2.0, "m"), ("exp", 2.0, "gone")]
    got = spots.sums(spark.createDataFrame(cells, "region string, x double, y double"), p, ["region"], ["x", "y"], terms)
    rows = {(r.region, r.x, r.y): tuple(r)[3:] for r in got.collect()}
    assert set(rows) == {c for c in cells if c[0] != "none"}
    for (region, x, y), (e, g, w, gone) in rows.items():
        near = [(np.hypot(x - q[1], y - q[2]) / 1000, q[4]) for q in places if q[0] == region and q[4] is not None]
        want = [sum(m * f(d) for d, m in near if d < INF) for f in (lambda d: np.exp(-d / 2), lambda d: np.exp(-d * d / 8), lambda d: (d + 1) ** -2.0)]
        assert np.allclose((e, g, w), want, rtol=1e-12) and gone is None


def test_many_cells_and_places_at_few_spots(spark):
    """1.6 thousand million pairs, sixteen pairs of spots."""
    n = 40_000
    at = lambda k: ((k % 2) * 3000.0, (F.floor(k % 4 / 2) * 4000).cast("double"))
    x, y = at(F.col("id"))
    rows = spark.range(n).select(F.lit("r").alias("region"), "id", x.alias("x"), y.alias("y"))
    cells = rows.withColumnRenamed("id", "cell_id").withColumn("population", 1.0 + F.col("cell_id") % 4)
    places = rows.withColumnRenamed("id", "place_id").withColumn("population", F.lit(1.0))
    totals = spark.createDataFrame([("r", 100.0)], "region string, x_total double")
    start = time.monotonic()
    got = allocate.decay(cells, places, totals, 2.0).groupBy("cell_id").agg(F.round(F.max("value"), 12).alias("v"))
    assert got.agg(F.count("*"), F.min("v"), F.max("v")).first()[:] == (n, 100 / n, 100 / n)  # the rectangle is the same from all corners
    trace = tune.gravity(cells, places, "exp", (1.0, 2.0)).collect()
    assert [r.rho for r in trace] == [0.0, 0.0]
    near = distance.with_nearest(cells, places).groupBy("dist_to_city_km").agg(F.count("*"), F.max("place_id")).collect()
    assert [tuple(r) for r in near] == [(0.0, n, 3)]
    assert time.monotonic() - start < 120


def test_ranks_of_spots_are_those_of_cells(spark):
    rng = np.random.default_rng(5)
    cells = spark.createDataFrame([("r", k, float(a), float(b), float(v)) for k, (a, b, v) in enumerate(rng.integers(0, 6, (300, 3)))], "region string, cell_id long, x double, y double, population double")
    places = spark.createDataFrame([("r", k, float(a) * 1000, float(b) * 1000, float(v)) for k, (a, b, v) in enumerate(rng.integers(1, 9, (30, 3)))], "region string, place_id long, x double, y double, population double")
    one = cells.withColumns({"x": F.col("x") * 1000, "y": F.col("y") * 1000})
    got = {r.scale: r.rho for r in tune.gravity(one, places, "exp", (1.0, 3.0), buffer_km=None).collect()}
    pairs = distance.pairs(one, allocate.masses(places), "mass")
    for scale, rho in got.items():
        w = allocate.potential(pairs, scale).withColumn("weight", F.round("weight", 11)).join(one.select("cell_id", "population"), "cell_id")
        (want,) = tune.spearman(w, "weight", "population", ("region",)).collect()
        assert abs(rho - want.rho) < 1e-9


def test_legs_add_up_to_minutes(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 9000.0, 0.0), (3, 90000.0, 0.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 600.0)], "src long, dst long, travel_time double")
    cells = spark.createDataFrame([("r", k, 100.0 * k, 50.0) for k in range(9)] + [("r", 9, 90000.0, 1.0)], "region string, cell_id long, x double, y double")
    places = spark.createDataFrame([("r", k, 9000.0 + k, 20.0, 1.0 + k) for k in range(4)], "region string, place_id long, x double, y double, population double")
    totals = spark.createDataFrame([("r", 100.0)], "region string, x_total double")
    parts, whole = graph.legs(cells, places, nodes, edges), graph.settle(graph.travel_minutes(cells, places, nodes, edges))
    assert graph.reachable_share(parts).first().share == graph.reachable_share(whole).first().share == 0.9
    a, b = ({r.cell_id: r.value for r in allocate.decay_network(cells, places, m, totals, 30.0, buffer_km=None).collect()} for m in (parts, whole))
    assert len(a) == 10 and all(abs(a[k] - b[k]) < 1e-9 for k in b)


def test_exponential_sums_over_two_parts_meet_no_pairs(spark):
    """3.6e11 pairs; two groups, one with places only out of reach, and a scale of its group."""
    n = 600_000
    at = lambda a: (F.col("id") * a % 600_011 / F.lit(7000.0)).alias("at")
    cells = spark.range(n).select(F.lit("r").alias("region"), at(7919)).union(spark.createDataFrame([("s", 1.0), ("none", 1.0)], "region string, at double"))
    ways = spark.range(n).select(F.lit("r").alias("region"), at(104729), (1.0 + F.col("id") % 3).alias("m"), F.lit(4.0).alias("own"))
    ways = ways.union(spark.createDataFrame([("s", INF, 2.0, 4.0), ("s", None, 2.0, 4.0)], ways.schema))
    start = time.monotonic()
    got = spots.sums(cells, ways, ["region"], ["at"], [("exp", 5.0, "m"), ("exp", "own", "m")])
    assert got.count() == n + 1 and got.where("region = 's'").first()[2:] == (0.0, 0.0)
    w = ways.where("region = 'r'").toPandas()
    some = got.where("region = 'r'").orderBy("at").limit(3).collect() + got.where("region = 'r'").orderBy(F.desc("at")).limit(3).collect()
    assert time.monotonic() - start < 60
    for r in some:
        assert np.allclose((r.w0, r.w1), [(w.m * np.exp(-(r["at"] + w["at"]) / s)).sum() for s in (5.0, 4.0)], rtol=1e-11)


def test_all_pairs_are_those_of_rows(spark, monkeypatch):
    """Spots with several cells and places, lists of about two, a null coordinate, regions that one side lacks."""
    monkeypatch.setattr(spots, "LIST", 2)
    rng = np.random.default_rng(9)
    rows = lambda names, n: [(names[k % len(names)], k, float(a) * 700, float(b) * 700) for k, (a, b) in enumerate(rng.integers(0, 4, (n, 2)))]
    cells = spark.createDataFrame([*rows("abc", 60), ("a", 90, None, 1.0)], "region string, cell_id long, x double, y double")
    places = spark.createDataFrame([*rows("abd", 40), ("b", 90, 1.0, None)], "region string, place_id long, x double, y double")
    want = distance.pairs(cells, places).withColumn("d", F.round("d", 6))
    got = distance.matrix(cells, places, 6)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_distances_of_a_thousand_million_pairs_are_made_by_spot(spark):
    rows = spark.range(30_000).select(F.lit("r").alias("region"), "id", (F.col("id") % 5 * 300.0).alias("x"), F.lit(0.0).alias("y"))
    start = time.monotonic()
    got = distance.matrix(rows.withColumnRenamed("id", "cell_id"), rows.withColumnRenamed("id", "place_id"), 6).agg(F.count("*"), F.min("d"), F.max("d")).first()
    assert got[:] == (900_000_000, 0.0, 1.2) and time.monotonic() - start < 40
