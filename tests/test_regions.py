"""Regions: outlines, features, sources and sinks that the catalogue's tables do not have."""

import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import allocate, distance, grid, maxent, ranks, region, regress
from zonalis.plans import report
from zonalis.sources import files, literals, spatial

RING = "region string, part int, ring int, is_hole boolean, pts array<struct<x: double, y: double>>"


def border(spark, *rings):
    return spark.createDataFrame([(r, p, k, h, [{"x": float(x), "y": float(y)} for x, y in pts]) for r, p, k, h, pts in rings], RING)


def test_ranks_and_quantiles_against_plain_python(spark):
    r = np.random.default_rng(4)
    rows = [(g, float(v)) for g in "ab" for v in [*r.normal(size=300) * 10.0 ** r.integers(-12, 12, 300), *[0.0] * 40, -0.0, 5.0, 5.0, 1e300, -1e300]] + [("c", 7.0), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {}
    for x in ranks.average_rank(df.where("g is not null"), "v", ("g",), "rank").collect():
        got.setdefault(x.g, []).append((x.v, x["rank"]))
    for g in "abc":
        v = sorted(x for k, x in rows if k == g)
        assert all(rank == (v.index(x) + len(v) - 1 - v[::-1].index(x)) / 2 + 1 for x, rank in got[g]) and len(got[g]) == len(v)
    q = {x.g: x for x in ranks.quantiles(df, "v", ("g",), {"a": 0.25, "b": 0.95, "c": 1.0}).collect()}
    for g in ("a", "b", "c", None):
        v = [x for k, x in rows if k == g]
        assert [q[g][k] for k in "abc"] == pytest.approx([np.quantile(v, p) for p in (0.25, 0.95, 1.0)], rel=1e-12)
    run = {(x.g, x._v): x.b for x in ranks.running(df.groupBy("g", F.col("v").alias("_v")).agg(F.count("*").alias("n")), ("g",), "_v", "n", "b", descending=True).collect()}
    for g in ("a", None):
        v = [x for k, x in rows if k == g]
        assert all(run[g, x] == sum(y > x for y in v) for x in v)


def test_nearest_place_against_all_pairs(spark):
    r = np.random.default_rng(1)
    cells = [(f"r{i % 2}", i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(-90_000, 90_000, (400, 2)))]
    places = [(f"r{i % 2}", i, float(x), float(y)) for i, (x, y) in enumerate([*r.uniform(-300_000, 300_000, (30, 2)), (0.0, 0.0), (0.0, 0.0), (0.0, 0.0)])]
    c, p = (spark.createDataFrame(x, f"region string, {k} int, x double, y double") for x, k in ((cells, "cell_id"), (places, "place_id")))
    want = {i: min((math.sqrt((x - a) ** 2 + (y - b) ** 2) / 1000, k) for s, k, a, b in places if s == g) for g, i, x, y in cells}
    for square in (3.0, 25.0, 500.0):
        got = {x.cell_id: (x.dist_to_city_km, x.place_id) for x in distance.nearest(c, p, square).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_outline_of_touching_polygons(spark):
    sq = lambda x, y, n=1: [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]
    ring = [("r", k, 0, False, sq(i, j)) for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1))]
    b = border(spark, *ring, ("s", 0, 0, False, sq(0, 0)), ("s", 1, 0, False, sq(1, 1)), ("t", 0, 0, False, sq(0, 0, 4)))
    got = grid.dissolve(b).collect()
    parts = {(x.region, x.is_hole, len(x.pts)) for x in got}
    assert ("r", True, 4) in parts and ("r", False, 12) in parts and ("t", False, 4) in parts
    assert sorted(len(x.pts) for x in got if x.region == "s") == [4, 4]  # two squares that meet in a corner
    assert {x.region: x.area_km2 * 1e6 for x in grid.polygon_area(grid.dissolve(b)).collect()} == pytest.approx({"r": 8, "s": 2, "t": 16})
    outer = {x.region: len(x.pts) for x in grid.region_polygon(b.where("region <> 's'"), 0.01).collect()}
    assert outer == {"r": 4, "t": 4}


def test_polygon_cells_against_clipping_each(spark):
    r = np.random.default_rng(2)
    for k in range(4):
        a = np.sort(r.uniform(0, 2 * np.pi, 40))
        rad = r.uniform(3, 30, 40)  # a star, far from convex
        pts = np.stack([rad * np.cos(a), rad * np.sin(a)], axis=1)
        got = {(x.ix, x.iy): x.area_km2 * 1e6 for x in grid.polygon_grid(border(spark, ("r", 0, 0, False, pts)), 1.0).collect()}
        want = {(i, j): m for i in range(-31, 31) for j in range(-31, 31) if (m := grid.moments(grid.clip_ring(pts, i, j, i + 1, j + 1))[0]) > 1e-6}
        assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-6)


def test_inner_points(spark):
    b = border(spark, ("u", 0, 0, False, [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)]), ("dot", 0, 0, False, [(3, 4)]))
    got = {x.region: (x.x, x.y) for x in grid.representative_point(b).collect()}
    assert got["dot"] == (3, 4) and got["u"][0] in (1, 9) and 0 < got["u"][1] < 10


def test_region_is_built_once_and_has_its_distances(spark, tmp_path):
    box = [(0, 0), (3000, 0), (3000, 2000), (0, 2000)]
    b = border(spark, ("mo", 0, 0, False, box))
    built = []

    def cells():
        built.append(1)
        return grid.polygon_grid(b)

    pixels = spark.createDataFrame([("mo", 500.0, 500.0, 4.0), ("mo", 600.0, 500.0, -99999.0), ("mo", 5000.0, 500.0, 9.0)], "region string, x double, y double, value double")
    towns = spark.createDataFrame([("mo", 1, 500.0, 500.0)], "region string, place_id int, x double, y double")
    one = region.Region("mo", (37.0, 55.0), str(tmp_path / "f"), cells, lambda: pixels, lambda: towns, lambda: b)
    for force, times in ((False, 1), (False, 1), (True, 2)):
        got, conf = region.load(spark, {"mo": one}, "mo", force)
        assert len(built) == times and conf is one
    rows = {(x.ix, x.iy): x for x in got.collect()}
    assert len(rows) == 6 and rows[0, 0].population == 4 and rows[0, 0].dist_to_city_km == 0 and rows[1, 0].dist_to_city_km == 1
    assert rows[0, 0].dist_to_moscow_km is not None and distance.centre_column(got) == "dist_to_center_km"
    assert distance.centre_column(got.drop("dist_to_center_km")) == "dist_to_moscow_km"
    made = region.border_of(spark, str(tmp_path / "b"), "mo", lambda: b, 1000.0, 0.0, 0.0)
    assert grid.polygon_area(made).first().area_km2 == pytest.approx(1.0)
    out, skipped = region.each_with_roads(["a", "b"], {"b": 1}, lambda k, g: spark.createDataFrame([(k,)], "region string"))
    assert [x.region for x in out.collect()] == ["b"] and skipped == ["a"]
    with pytest.raises(ValueError):
        distance.centre_column(pixels)


def test_scenarios_and_named_network(spark):
    rows = [("r", i, float(i), 0.0, float(i % 5) * 50, 1.0 + i % 7, 2.0 + i % 11) for i in range(60)]
    cells = spark.createDataFrame(rows, "region string, cell_id int, x double, y double, population double, dist_to_city_km double, dist_to_center_km double")
    totals = spark.createDataFrame([("r", 100.0)], "region string, x_total double")
    done, found = maxent.scenarios(cells, totals)
    assert {x.scenario: x.s for x in done.groupBy("scenario").agg(F.sum("value").alias("s")).collect()} == pytest.approx({"strict": 100, "smooth": 100})
    assert {(x.scenario, x.converged) for x in found.collect()} == {("strict", True), ("smooth", True)}
    places = spark.createDataFrame([("r", 1, 0.0, 0.0, 10.0)], "region string, place_id int, x double, y double, population double")
    minutes = cells.select("region", "cell_id", F.lit(1).alias("place_id"), F.when(F.col("cell_id") < 30, 10.0).otherwise(float("inf")).alias("d"))
    got = {x.cell_id: x.value for x in allocate.run(cells, totals, "network", places=places, minutes=minutes, scale=10.0).collect()}
    assert got[0] == pytest.approx(100 / 30) and got[59] == 0
    folds = regress.shuffled_folds(60)
    table = spark.createDataFrame(list(enumerate(folds)), "cell_id int, fold int")
    lin = cells.join(table, "cell_id").withColumn("y", F.expm1(2 * F.log1p("population") + 1))
    cv = regress.cross_validate(lin, "y", ("population", "dist_to_city_km", "dist_to_center_km"), F.col("fold")).first()
    assert cv.folds == 5 and cv.r2_mean == pytest.approx(1, abs=1e-6)


def tiff(values, order="<", method=1, predictor=1, tile=None, nodata=b"-99999"):
    """A GeoTIFF of one band, written by hand."""
    h, w = values.shape
    bw, bh = tile or (w, 2)
    blocks = []
    for y in range(0, h, bh):
        for x in range(0, w, bw):
            part = np.zeros((bh if tile else min(bh, h - y), bw), values.dtype)
            cut = values[y : y + bh, x : x + bw]
            part[: cut.shape[0], : cut.shape[1]] = cut
            if predictor == 3:
                raw = part.astype(values.dtype.newbyteorder(">")).view(np.uint8).reshape(len(part), bw, -1).transpose(0, 2, 1).reshape(len(part), -1)
                raw = np.diff(raw, axis=1, prepend=np.zeros((len(raw), 1), np.uint8)).astype(np.uint8).tobytes()
            else:
                raw = (np.diff(part, axis=1, prepend=np.zeros((len(part), 1), part.dtype)) if predictor == 2 else part).astype(values.dtype.newbyteorder(order)).tobytes()
            blocks.append(zlib.compress(raw) if method == 8 else lzw(raw) if method == 5 else raw)
    tags = [(256, "I", (w,)), (257, "I", (h,)), (258, "H", (values.dtype.itemsize * 8,)), (259, "H", (method,)), (277, "H", (1,)), (317, "H", (predictor,)), (339, "H", ({"u": 1, "i": 2, "f": 3}[values.dtype.kind],))]
    tags += [(322, "I", (bw,)), (323, "I", (bh,)), (324, "I", None), (325, "I", tuple(map(len, blocks)))] if tile else [(273, "I", None), (278, "I", (bh,)), (279, "I", tuple(map(len, blocks)))]
    tags += [(33550, "d", (0.5, 0.25, 0.0)), (33922, "d", (0.0, 0.0, 0.0, 100.0, 60.0, 0.0)), (42113, "s", nodata + b"\0")]
    tags.sort()
    size = lambda f, v: struct.calcsize(f) * len(v) if f != "s" else len(v)
    tags = [(t, f, v if v is not None else tuple([0] * len(blocks))) for t, f, v in tags]
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for t, f, v in tags:
        if size(f, v) > 4:
            places[t] = at
            at += size(f, v) + size(f, v) % 2
    offsets = tuple(at + sum(map(len, blocks[:k])) for k in range(len(blocks)))
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", len(tags)))
    tail = bytearray()
    for t, f, v in tags:
        v = offsets if t in (273, 324) else v
        body = v if f == "s" else struct.pack(f"{order}{len(v)}{f}", *v)
        out += struct.pack(order + "HHI", t, {"H": 3, "I": 4, "d": 12, "s": 2}[f], len(v)) + (struct.pack(order + "I", places[t]) if t in places else body.ljust(4, b"\0"))
        tail += body + b"\0" * (len(body) % 2) if t in places else b""
    return bytes(out) + b"\0\0\0\0" + bytes(tail) + b"".join(blocks)


def lzw(raw):
    bits, table, width, word = "", {}, 9, b""

    def put(code):
        nonlocal bits
        bits += format(code, f"0{width}b")

    put(256)
    table = {bytes([k]): k for k in range(256)}
    nxt = 258
    for b in raw:
        c = bytes([b])
        if word + c in table:
            word += c
            continue
        put(table[word])
        table[word + c] = nxt
        nxt += 1
        if nxt >= 1 << width and width < 12:
            width += 1
        if nxt >= 4094:
            put(256)
            table, nxt, width = {bytes([k]): k for k in range(256)}, 258, 9
        word = c
    if word:
        put(table[word])
    put(257)
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))


def test_geotiff(spark, tmp_path):
    r = np.random.default_rng(3)
    for k, (kind, options) in enumerate([("f4", {}), ("f8", {"order": ">"}), ("i4", {"method": 8, "predictor": 2}), ("f4", {"method": 8, "predictor": 3}), ("f4", {"tile": (16, 16), "method": 8}), ("u2", {"method": 5}), ("f4", {"method": 5, "tile": (16, 16), "order": ">"})]):
        v = (r.uniform(0, 300, (37, 41))).astype(kind)
        v[5, 7] = v[0, 0] + 1
        if kind[0] == "f":
            v[3, 4], v[8, 8] = -99999, np.nan
        path = tmp_path / f"{k}.tif"
        path.write_bytes(tiff(v, **options))
        got = {(x.lon, x.lat): x.value for x in spatial.read_raster(spark, str(path)).collect()}
        want = {(100 + (i + 0.5) * 0.5, 60 - (j + 0.5) * 0.25): float(v[j, i]) for j in range(37) for i in range(41) if v[j, i] == v[j, i] and v[j, i] != -99999}
        assert got == want, (kind, options)


def test_layers_by_parts_and_by_file(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "l.gpkg")
    con = sqlite3.connect(path)
    con.execute("pragma journal_mode = wal")
    con.execute("create table gpkg_geometry_columns (table_name text, column_name text)")
    con.execute("insert into gpkg_geometry_columns values ('b', 'geom')")
    con.execute("create table b (fid integer primary key, geom blob, name text)")
    shape = b"GP\x00\x01" + struct.pack("<i", 3857) + spatial.wkb([[[(0, 0), (2, 0), (0, 2), (0, 0)]]])
    con.executemany("insert into b values (?, ?, ?)", [(k, shape, f"n{k}") for k in range(1200)])
    con.commit()
    con.execute("pragma wal_checkpoint(truncate)")
    con.close()
    whole = spatial.read_layer(spark, path, region="name")
    spark.dataSource.register(spatial.GeoPackage)
    parts = spark.read.format("gpkg").option("path", path).option("rows", "500").load()
    assert parts.rdd.getNumPartitions() == 3
    assert {x.region for x in whole.collect()} == {x.attributes["name"] for x in parts.collect()} == {f"n{k}" for k in range(1200)}


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1.5, 2.5), (2, 3.0, 4.0)], "id long, x double, y double")
    edges = spark.createDataFrame([(1, 2, 7.25)], "src long, dst long, travel_time double")
    built = []
    build = lambda: built.append(1) or (nodes, edges)
    for force, times in ((False, 1), (False, 1), (True, 2)):
        n, e = files.load_roads(spark, str(tmp_path / "g"), build, force)
        assert n.count() == 2 and e.first().travel_time == 7.25 and len(built) == times
    files.write_graphml(nodes, edges, str(tmp_path / "x.graphml"))
    n, e = files.read_graphml(spark, str(tmp_path / "x.graphml"), {"x": "d0", "y": "d1", "travel_time": "d2"})
    assert sorted(map(tuple, n.collect())) == [(1, 1.5, 2.5), (2, 3.0, 4.0)] and list(map(tuple, e.collect())) == [(1, 2, 7.25)]
    cells = spark.createDataFrame([("r", 1, -1, 2)], "region string, cell_id int, ix long, iy long")
    files.write_grid(cells, str(tmp_path / "cells"), geometry=True)
    (row,) = spark.read.parquet(str(tmp_path / "cells")).collect()
    (ring,) = spatial.rings(bytes(row.geometry))
    assert [(p["x"], p["y"]) for p in ring[3]] == [(-1000, 2000), (0, 2000), (0, 3000), (-1000, 3000), (-1000, 2000)]
    two = spatial.rings(spatial.wkb([[[(0, 0), (1, 0), (0, 1), (0, 0)]], [[(5, 5), (6, 5), (5, 6), (5, 5)], [(5, 5), (5, 5), (5, 5), (5, 5)]]]))
    assert [(p, k, h) for p, k, h, _ in two] == [(0, 0, False), (1, 0, False), (1, 1, True)]
    s = spark.createDataFrame([("A", "m", 0.5, "1.0%"), ("B", "m", 0.25, "2.0%")], "region string, method string, gini double, top string")
    files.write_csv(report.pivot(s, ["A", "B"]), str(tmp_path / "p.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "p.csv")).first().asDict() == {"method": "m", "A": "gini 0.5 / top-10% 1.0%", "B": "gini 0.25 / top-10% 2.0%"}
    assert [x.line for x in report.markdown(s).orderBy("region").collect()] == ["| A | m | 0.500 | 1.0% |", "| B | m | 0.250 | 2.0% |"]
    assert {x.path.rsplit("/", 1)[1] for x in files.listing(spark, str(tmp_path / "g"), "part-*").collect()} and files.listing(spark, str(tmp_path / "g"), "none*").count() == 0


def test_towns_from_the_table_the_list_or_the_map(spark, tmp_path):
    feats = lambda: spark.createDataFrame([(1.0, 2.0, {"place": "town"}, "Polygon"), (1.0, 2.0, {"place": "town"}, "LineString"), (50.0, 2.0, {"place": "city"}, "Point"), (1.5, 2.0, {}, "Point"), (1.6, 2.0, None, "Point")], "lon double, lat double, tags map<string, string>, geometry_type string")
    got = files.places_of(spark, str(tmp_path / "x"), "elsewhere", feats, (0.0, 0.0, 10.0, 10.0))
    assert [(x.lon, x.lat) for x in got.collect()] == [(1.0, 2.0)]
    assert files.places_of(spark, str(tmp_path / "x"), "elsewhere", lambda: 1 / 0).count() == 1  # kept
    assert files.places_of(spark, str(tmp_path / "y"), "mo", lambda: 1 / 0).count() == len(literals.TOWNS["moscow"])


def test_rows_found_by_label(spark):
    s = spark.createDataFrame([("A", "m", 0.5), ("A", "k", 0.25)], "region string, method string, gini double")
    assert s.where((F.col("method") == "k") & (F.col("region") == "A")).select("gini").first().gini == 0.25
