"""Published results of the central Yakutia grid, edge cases of every operator, sources."""

import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from zonalis.functions import scalar
from zonalis.operators import allocate, distance, graph, grid, maxent, metrics, regress, tune
from zonalis.plans import report
from zonalis.sources import files, literals, spatial

# Name, longitude, latitude, population (OpenStreetMap, ODbL).
YAKUTIA = [
    ("Якутск", 129.7319787, 62.0274078, 361154.0),
    ("Нижний Бестях", 129.911346, 61.957066, 4152.0),
    ("Покровск", 129.1540617, 61.48327, 9256.0),
    ("Намцы", 129.664246, 62.718227, 10044.0),
    ("Жатай", 129.843109, 62.164104, 10089.0),
    ("Мохсоголлох", 128.9417777, 61.394697, 6159.0),
    ("Борогонцы", 131.166061, 62.670792, 5222.0),
]


@pytest.fixture(scope="module")
def yakutia(spark):
    cells = grid.box_grid(grid.square(spark, "yakutia", 129.7322, 62.0355, 200_000)).persist()
    places = distance.project(spark.createDataFrame([("yakutia", k, *p) for k, p in enumerate(YAKUTIA)], "region string, place_id int, name string, lon double, lat double, population double"))
    return cells, places, literals.totals(spark)


def scores(df):
    m = metrics.table(df.withColumn("method", F.lit("x"))).first()
    assert m.total == pytest.approx(11.2)
    return round(m.gini, 5), round(m.top_share, 4)


def test_yakutia_grid_and_proximity(spark, yakutia):
    cells, places, totals = yakutia
    assert cells.count() == 160_801 and cells.agg(F.sum("area_km2")).first()[0] == pytest.approx(160_000)
    assert cells.select("cell_id").distinct().count() == 160_801
    g, t = scores(allocate.area(cells, totals))
    assert (g, t) == (pytest.approx(0.00497, abs=1e-5), pytest.approx(0.1005, abs=1e-4))
    towns = distance.project(literals.towns(spark, "yakutia"))
    centre = towns.where("place_id = 0").select("region", F.col("x").alias("cx"), F.col("y").alias("cy"))
    near = distance.nearest(cells, towns).select("region", "cell_id", "dist_to_city_km")
    assert scores(allocate.proximity(distance.to_point(cells, centre).join(near, ["region", "cell_id"]), totals)) == (0.33131, 0.2972)
    near = distance.nearest(cells, places).select("region", "cell_id", "dist_to_city_km")
    assert scores(allocate.nearest_place(cells.join(near, ["region", "cell_id"]), totals)) == (0.42974, 0.3561)


@pytest.mark.parametrize("kind,scale,beta,gini,top", [("exp", 5.0, 1.0, 0.98772, 0.9971), ("exp", 5.0, 2.77, 0.99412, None), ("gauss", 3.0, 2.77, 0.99929, 1.0), ("power", 4.0, 1.0, 0.99834, 0.9990)])
def test_yakutia_gravity(yakutia, kind, scale, beta, gini, top):
    cells, places, totals = yakutia
    assert distance.within_buffer(places, cells).count() == 7
    g, t = scores(allocate.decay(cells, places, totals, scale, kind, beta))
    assert g == gini and (top is None or t == top)


def frame(spark, values, method="m"):
    return spark.createDataFrame([("r", method, i, float(v)) for i, v in enumerate(values)], "region string, method string, cell_id int, value double")


def test_gini_and_top_shares(spark):
    for v, want in (([0, 0, 0, 1], 0.75), ([5], 0.0), ([0, 0, 0], 0.0), ([1, 2, 3, 4], 0.25)):
        assert metrics.gini(frame(spark, v)).first().gini == pytest.approx(want)
    assert metrics.gini(frame(spark, [])).count() == 0
    v = [0] * 15 + list(range(1, 13))
    s = sum(v)
    for mode, k in (("all_round", 3), ("positive_trunc", 1), ("all_trunc", 2)):
        assert metrics.top_share(frame(spark, v), mode=mode).first().top_share == pytest.approx(sum(sorted(v)[-k:]) / s)
    assert metrics.top_share(frame(spark, range(1, 26))).first().top_share == pytest.approx((25 + 24) / 325)


def test_decay_edges(spark):
    cells = spark.createDataFrame([("r", i, 0.0, 0.0) for i in range(3)], "region string, cell_id int, x double, y double")
    totals = spark.createDataFrame([("r", 6.0)], "region string, x_total double")
    inf = float("inf")
    p = spark.createDataFrame([("r", c, d, 1.0) for c in range(3) for d in ([1.0, inf] if c else [inf, inf])], "region string, cell_id int, d double, mass double")
    for kind in scalar.KERNELS:
        w = {r.cell_id: r.weight for r in allocate.potential(p, 2.0, kind).collect()}
        assert w[0] == 0 and w[1] == w[2] > 0
    none = allocate.potential(p.withColumn("d", F.lit(inf)), 2.0)
    assert [r.value for r in allocate.on_weights(cells, none, totals).collect()] == [2.0, 2.0, 2.0]
    empty = cells.withColumn("population", F.lit(0.0))
    assert [r.value for r in allocate.elasticity(empty, totals).collect()] == [0.0, 0.0, 0.0]
    assert [r.value for r in allocate.population(empty, totals).collect()] == [None, None, None]
    m = allocate.masses(spark.createDataFrame([("r", 1, 0.0)], "region string, place_id int, population double"))
    assert m.first().mass == 0
    with pytest.raises(ValueError):
        scalar.kernel(F.col("d"), 1.0, "linear")
    scalar.register(spark)
    assert spark.sql("select decay_kernel(double('Infinity'), 3, 'power')").first()[0] == 0
    with pytest.raises(PySparkException):
        spark.sql("select decay_kernel(1.0, 3, concat('lin', id)) from range(1)").collect()
    places = spark.createDataFrame([("r", 1, 30_000.0, 0.0), ("r", 2, 30_000.1, 0.0), ("s", 3, 0.0, 0.0)], "region string, place_id int, x double, y double")
    assert [r.place_id for r in distance.within_buffer(places, cells, 30.0).collect()] == [1]


def test_sweep_ties_and_constants(spark):
    pairs = spark.createDataFrame([("r", c, 10.0, 1.0) for c in range(4)], "region string, cell_id int, d double, share double")
    target = spark.createDataFrame([("r", c, float(c)) for c in range(4)], "region string, cell_id int, target double")
    trace = tune.sweep(pairs, target, "exp", [3.0, 5.0], [1.0, 2.0])
    assert {r.rho for r in trace.collect()} == {0.0}
    assert tuple(tune.best(trace).select("beta", "scale").first()) == (1.0, 3.0)
    v = spark.createDataFrame([("r", float(a), float(b)) for a, b in ((1, 1), (1, 2), (2, 2), (3, 5))], "region string, a double, b double")
    assert tune.spearman(v, "a", "b", ("region",)).first().rho == pytest.approx(0.8333333)


def test_maxent_meets_its_targets(spark):
    r = np.random.default_rng(3)
    rows = [("a" if i % 3 else "b", i, float(r.lognormal() * (r.random() < 0.4)), float(r.uniform(0, 200)), float(r.uniform(0, 60))) for i in range(900)]
    cells = spark.createDataFrame(rows, "region string, cell_id int, population double, dist_to_center_km double, dist_to_city_km double")
    totals = spark.createDataFrame([("a", 5.0), ("b", 7.0)], "region string, x_total double")
    prepared = maxent.prepared(cells, 1.0, 0.5).persist()
    done, solution = maxent.allocate_frame(prepared, totals)
    assert all(s.converged for s in solution.collect())
    assert max(d.error for d in maxent.diagnostics(done, maxent.targets(prepared)).collect()) < 1e-6
    assert {x.region: round(x.s, 9) for x in done.groupBy("region").agg(F.sum("value").alias("s")).collect()} == {"a": 5.0, "b": 7.0}
    zero = maxent.reference(cells.withColumn("population", F.lit(0.0)))
    assert zero.where("region = 'b'").agg(F.max("ref") - F.min("ref")).first()[0] == 0
    assert maxent.features(cells.withColumn("dist_to_city_km", F.lit(1.0))).agg(F.max("f2")).first()[0] == pytest.approx(0, abs=1e-9)


def test_roads(spark):
    nodes = spark.createDataFrame([(k, float(k * 1000), 0.0) for k in range(6)] + [(9, 1e6, 1e6)], "id long, x double, y double")
    edges = spark.createDataFrame([(0, 1, 60.0), (0, 1, 30.0), (2, 1, 60.0), (2, 3, 60.0), (5, 4, 1.0)], "src long, dst long, travel_time double")
    und = {(r.src, r.dst): r.travel_time for r in graph.undirected(edges).collect()}
    assert und[0, 1] == und[1, 0] == 30.0 and len(und) == 8
    got = {(r.place_id, r.node): r.sec for r in graph.shortest(spark.createDataFrame([(1, 0), (2, 0), (3, 5)], "place_id int, node long"), graph.undirected(edges)).collect()}
    assert got[1, 3] == got[2, 3] == 150.0 and (1, 4) not in got and got[3, 4] == 1.0
    assert sorted(r.id for r in graph.largest_component(nodes, edges).collect()) == [0, 1, 2, 3]
    near = {r.k: (r.node, r.off_m) for r in graph.nearest_node(spark.createDataFrame([(1, 1400.0, 0.0), (2, 500.0, 0.0), (3, 9e5, 1e6), (4, -9e6, 0.0)], "k int, x double, y double"), nodes, "k").collect()}
    assert near == {1: (1, 400.0), 2: (0, 500.0), 3: (9, 1e5), 4: (0, 9e6)}
    cells = spark.createDataFrame([("r", 1, 3000.0, 0.0), ("r", 2, 4000.0, 500.0)], "region string, cell_id int, x double, y double")
    places = spark.createDataFrame([("r", 7, 0.0, 1000.0)], "region string, place_id int, x double, y double")
    m = {r.cell_id: r.d for r in graph.travel_minutes(cells, places, nodes, edges).collect()}
    assert m[1] == pytest.approx(2.5 + 2.4) and math.isinf(m[2])


def test_regression_recovers_a_law(spark):
    r = np.random.default_rng(1)
    rows = []
    for k in range(60):
        a, b, c = r.uniform(1, 1e5, 3)
        rows.append((k, float(np.expm1(0.5 + 2 * np.log1p(a) - np.log1p(b) + 0.3 * np.log1p(c))), float(a), float(b), float(c)))
    df = spark.createDataFrame([*rows, (99, -1.0, 1.0, 1.0, 1.0)], "object_name int, y double, a double, b double, c double")
    df = regress.positive(df, ("y", "a", "b", "c"))
    m = regress.fit(df, "y", ("a", "b", "c"))
    assert (m.intercept, *m.coefficients) == pytest.approx((0.5, 2, -1, 0.3), abs=1e-6)
    assert regress.r2(df, "y", m).first().r2 == pytest.approx(1)
    cv = regress.cross_validate(df, "y", ("a", "b", "c"), F.col("object_name") % 5).first()
    assert cv.folds == 5 and cv.r2_mean == pytest.approx(1) and cv.r2_std == pytest.approx(0, abs=1e-6)
    folds = regress.shuffled_folds(13)
    assert sorted(np.bincount(folds)) == [2, 2, 3, 3, 3]


def test_polygons():
    tri = np.array([[0, 0], [10, 0], [0, 10]], float)
    assert grid.moments(tri)[0] == 50
    cut = grid.clip_ring(tri, 0, 0, 4, 4)
    assert grid.moments(cut)[0] == 16 and grid.moments(grid.clip_ring(tri, 4, 4, 8, 8))[0] == pytest.approx(2)
    assert grid.inside(tri, np.array([1.0, 9, 4.9]), np.array([1.0, 9, 4.9])).tolist() == [True, False, True]
    line = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0]], float)
    assert len(grid.simplify(line, 0.1)) == 4 and len(grid.simplify(line, 10)) == 2


def test_reports(spark):
    s = spark.createDataFrame([("A", "m", 0.5, "1.0%"), ("A", "m", 0.4, "2.0%")], "region string, method string, gini double, top string")
    with pytest.raises(ValueError):
        report.pivot(s, ["A"])
    assert report.pivot(s.limit(1), ["A"]).first()["A"].startswith("gini 0.5 / top-10% ")
    once = report.upsert(s.limit(1), s.limit(1), "region", "method")
    assert once.count() == 1
    assert report.drop_methods(s.withColumn("method", F.lit(None).cast("string")), "m").count() == 2
    f = spark.createDataFrame([("a", "Отгрузка товаров"), ("b", None), ("c", "other")], "code string, indicator_name string")
    assert [r.code for r in report.search(f, "indicator_name", "ОТГРУЗ", "code").collect()] == ["a"]
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "object_name string, value double")
    assert report.joined(a.withColumnRenamed("value", "p"), ("q", a)).count() == 4
    pop = spark.createDataFrame([("12 345",), ("1,234",), ("10.5",), ("",), (None,)], "p string")
    assert [r[0] for r in pop.select(scalar.whole_number(F.col("p"))).collect()] == [12345, 1234, None, None, None]


def test_sources(spark, tmp_path):
    path = str(tmp_path / "layer.gpkg")
    con = sqlite3.connect(path)
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_geometry_columns values ('b', 'geom')")
    con.execute("create table b (fid integer primary key, geom blob, name text)")
    ring = lambda pts: struct.pack("<I", len(pts)) + b"".join(struct.pack("<2d", *p) for p in pts)
    poly = b"\x01" + struct.pack("<II", 3, 2) + ring([(0, 0), (3000, 0), (3000, 2000), (0, 2000)]) + ring([(500, 500), (1500, 500), (1500, 1500), (500, 1500)])
    multi = b"\x01" + struct.pack("<II", 6, 2) + poly + poly
    con.executemany("insert into b values (?, ?, ?)", [(1, b"GP\x00\x01" + struct.pack("<i", 3857) + poly, "one"), (5, b"GP\x00\x03" + struct.pack("<i", 3857) + struct.pack("<4d", 0, 1, 0, 1) + multi, "two"), (6, None, "none")])
    con.commit()
    con.close()
    border = spatial.read_layer(spark, path, region="name")
    assert border.count() == 6
    one = border.where("region = 'one'")
    assert grid.polygon_area(one).first().area_km2 == 5.0
    g = {(r.ix, r.iy): r.area_km2 for r in grid.polygon_grid(one).collect()}
    assert len(g) == 6 and g[0, 0] == 0.75 and sum(g.values()) == pytest.approx(5)
    assert grid.polygon_grid(grid.without_holes(one)).agg(F.sum("area_km2")).first()[0] == pytest.approx(6)
    (tmp_path / "r.asc").write_text("ncols 2\nnrows 3\nxllcorner 10\nyllcorner 20\ncellsize 1\nNODATA_value -99999\n1 2\n3 -99999\n5 6\n")
    px = spatial.read_raster(spark, str(tmp_path / "r.asc")).collect()
    assert sorted(map(tuple, px)) == [(10.5, 20.5, 5.0), (10.5, 21.5, 3.0), (10.5, 22.5, 1.0), (11.5, 20.5, 6.0), (11.5, 22.5, 2.0)]
    (tmp_path / "g.graphml").write_text(
        '<?xml version="1.0"?><graphml><graph edgedefault="directed"><node id="1"><data key="d0">1.5</data><data key="d1">2.5</data></node><node id="2"><data key="d0">3</data><data key="d1">4</data></node>'
        '<edge source="1" target="2"><data key="d2">7.25</data></edge></graph></graphml>'
    )
    nodes, edges = files.read_graphml(spark, str(tmp_path / "g.graphml"), {"x": "d0", "y": "d1", "travel_time": "d2"})
    assert sorted(map(tuple, nodes.collect())) == [(1, 1.5, 2.5), (2, 3.0, 4.0)] and list(map(tuple, edges.collect())) == [(1, 2, 7.25)]
    missing = files.read_places(spark, str(tmp_path / "none.csv"), [("A", 1.0, 2.0, 3.0, "city"), ("B", 1.0, 2.0, None, "town")])
    assert [r.name for r in missing.collect()] == ["A"]
    files.write_csv(missing, str(tmp_path / "p.csv"))
    assert files.read_places(spark, str(tmp_path / "p.csv")).count() == 1
    with pytest.raises(FileNotFoundError):
        files.require(spark, str(tmp_path / "none"), "grid")
    built = []
    build = lambda: built.append(1) or spark.range(3).toDF("v")
    for force, times in ((False, 1), (False, 1), (True, 2)):
        assert files.materialize(spark, str(tmp_path / "t"), build, force).count() == 3 and len(built) == times
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError
        return "done"

    assert files.retry(flaky, wait_s=0) == "done" and len(tries) == 3
    cells = spark.createDataFrame([("r", 1, 0, 0, 9.0), ("r", 2, 1, 0, 9.0)], "region string, cell_id int, ix long, iy long, other double")
    pixels = spark.createDataFrame([("r", 1000.0, 0.0, 5.0), ("r", 999.9, 0.0, 2.0), ("r", 10.0, 10.0, -99999.0), ("r", 10.0, 10.0, None)], "region string, x double, y double, value double")
    assert [r.population for r in grid.zonal_sum(cells, pixels).orderBy("cell_id").collect()] == [2.0, 5.0]
    files.write_grid(cells, str(tmp_path / "grid"), "other", "missing")
    assert set(spark.read.parquet(str(tmp_path / "grid")).columns) == {"region", "cell_id", "ix", "iy", "other"}


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70
