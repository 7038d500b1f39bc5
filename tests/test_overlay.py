"""Polygons cut to cells and to each other."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import grid, overlay
from zonalis.sources import files


def star(rng, x, y, r, n=40):
    """A ring that is not convex."""
    t = np.sort(rng.random(n)) * 2 * np.pi
    far = r * rng.uniform(0.4, 1, n)
    return np.stack([x + far * np.cos(t), y + far * np.sin(t)], axis=1)


def layer(spark, rings):
    return spark.createDataFrame([(r, p, k, h, [(float(x), float(y)) for x, y in pts]) for r, p, k, h, pts in rings], grid.BORDER)


def total(parts):
    return sum(overlay.signed(r) for p in parts for r in p)


def test_concave_rings_fall_apart_in_a_box():
    comb = np.array([(0, 0), (9, 0), (9, 9), (7, 9), (7, 2), (5, 2), (5, 9), (3, 9), (3, 2), (1, 2), (1, 9), (0, 9)], float)
    got = overlay.in_box([grid.clip_ring(comb, 0, 4, 9, 8)], 0, 4, 9, 8)
    assert len(got) == 3 and all(len(p) == 1 for p in got) and total(got) == pytest.approx(4 * (1 + 2 + 2))
    # a hole that crosses the box's side is no hole of the piece, one inside it is
    outer, hole = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(2, 2), (2, 4), (4, 4), (4, 2)], float)
    for box, rings, want in (((0, 0, 3, 10), 1, 30 - 2), ((0, 0, 10, 10), 2, 96), ((2, 2, 4, 4), 0, 0), ((0, 0, 4, 4), 1, 12)):
        got = overlay.in_box([grid.clip_ring(r, *box) for r in (outer, hole)], *box)
        assert sum(len(p) for p in got) == rings and total(got) == pytest.approx(want)


def test_meet_of_random_polygons():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, hole = star(rng, 0, 0, 10), star(rng, 0, 0, 3)
        a, hole = overlay.turned(a, False), overlay.turned(hole, True)
        x = rng.uniform(-6, 6)
        left, right = (np.array([(l, -20), (r, -20), (r, 20), (l, 20)], float) for l, r in ((-20, x), (x, 20)))
        halves = [overlay.meet([[a, hole]], [[h]]) for h in (left, right)]
        assert sum(map(total, halves)) == pytest.approx(overlay.signed(a) + overlay.signed(hole), rel=1e-6)
        b = overlay.turned(star(rng, 4, 1, 9), False)
        one, two = overlay.meet([[a, hole]], [[b]]), overlay.meet([[b]], [[a, hole]])
        assert total(one) == pytest.approx(total(two), rel=1e-6)
        p = rng.uniform(-12, 12, (4000, 2))
        within = lambda parts, p=p: np.logical_xor.reduce([grid.inside(r, p[:, 0], p[:, 1]) for part in parts for r in part] or [np.zeros(len(p), bool)])
        assert (within(one) == (within([[a, hole]]) & within([[b]]))).mean() > 0.9995


def test_meet_of_polygons_that_share_sides():
    sq = lambda x, y, s: [[np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float)]]
    for other, want in ((sq(0, 0, 4), 16), (sq(0, 0, 2), 4), (sq(2, 0, 4), 8), (sq(4, 0, 4), 0), (sq(4, 4, 1), 0), (sq(1, 1, 2), 4), (sq(-1, -1, 9), 16)):
        assert total(overlay.meet(sq(0, 0, 4), other)) == pytest.approx(want)
        assert total(overlay.meet(other, sq(0, 0, 4))) == pytest.approx(want)


def test_cut_cells_of_random_layers(spark, tmp_path):
    rng = np.random.default_rng(8)
    rings = []
    for k in range(4):
        rings += [(f"f{k}", 0, 0, False, star(rng, 3000 * k, 500, 4200, 60)), (f"f{k}", 0, 1, True, star(rng, 3000 * k, 500, 1500, 30)), (f"f{k}", 1, 0, False, star(rng, 3000 * k + 500, 9500, 900)), (f"f{k}", 1, 1, True, star(rng, 3000 * k + 500, 9500, 200))]
    border = layer(spark, rings)
    cells = overlay.cut_cells(border).persist()
    want = {(r.region, r.cell_id): r.area_km2 for r in grid.polygon_grid(border).collect()}
    got = {(r.region, r.cell_id): r for r in cells.collect()}
    assert len(got) == cells.count()
    for key in want.keys() | got.keys():  # slivers may be in one only
        assert (got[key].area_km2 if key in got else 0) == pytest.approx(want.get(key, 0), abs=1e-8)
    assert any(len(r.parts) > 1 for r in got.values()) and any(len(p) > 1 for r in got.values() for p in r.parts) and any(r.whole for r in got.values())
    for r in got.values():
        for part in r.parts:
            signs = [overlay.signed(np.array(ring)) > 0 for ring in part]
            assert signs[0] and not any(signs[1:])
            x, y = np.array(part[0]).T
            assert r.ix * 1000 <= x.min() and x.max() <= (r.ix + 1) * 1000 and r.iy * 1000 <= y.min() and y.max() <= (r.iy + 1) * 1000
    # the sink writes what is left of a cell
    files.write_grid(cells, str(tmp_path / "grid"), geometry=True)
    back = spark.read.parquet(str(tmp_path / "grid")).collect()
    assert len(back) == len(got)
    for r in back:
        kind = struct.unpack_from("<BI", r.geometry)[1]
        n = len(got[r.region, r.cell_id].parts)
        assert kind == (3 if n == 1 else 6) and (n == 1 or struct.unpack_from("<I", r.geometry, 5)[0] == n)


def test_two_layers(spark):
    rng = np.random.default_rng(9)
    a = [("a", 0, 0, False, star(rng, 0, 0, 5000, 50)), ("a", 0, 1, True, star(rng, 0, 0, 1600, 20)), ("none", 0, 0, False, star(rng, 9e5, 0, 900))]
    b = [(f"b{k}", 0, 0, False, star(rng, 1500 * k, 700 * k, 2500, 30)) for k in range(3)]
    got = {(r.a, r.b): r.s for r in overlay.intersections(layer(spark, a), layer(spark, b)).groupBy("a", "b").agg(F.sum("area_km2").alias("s")).collect()}
    whole = [[overlay.turned(a[0][4], False), overlay.turned(a[1][4], True)]]
    want = {("a", r[0]): total(overlay.meet(whole, [[overlay.turned(r[4], False)]])) / 1e6 for r in b}
    assert got.keys() == {k for k, v in want.items() if v > 0} and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


def test_odd_layers(spark):
    border = layer(spark, [("empty", 0, 0, False, []), ("line", 0, 0, False, [(0, 0), (500, 500), (900, 900)]), ("ok", 0, 0, False, [(0, 0), (0, 1000), (1000, 1000), (1000, 0), (0, 0)])])
    got = overlay.cut_cells(border).collect()
    assert [(r.region, r.ix, r.iy, r.area_km2) for r in got] == [("ok", 0, 0, 1.0)]
    assert overlay.cut_cells(border.limit(0)).count() == 0
