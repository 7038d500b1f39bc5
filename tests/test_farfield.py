"""Gravity weights without all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.functions.scalar import kernel
from zonalis.operators import distance, farfield


def tables(spark, n, each=16):
    """n x n cells of a square kilometre, and ``each`` places in each, the heaviest in a corner."""
    rng = np.random.default_rng(n)
    x, y = rng.random((2, n * n * each)) * n * 1000
    share = rng.random(n * n * each)
    cells = spark.range(n * n).selectExpr("'r' as region", "id as cell_id", f"(id % {n}) * 1000D + 500 as x", f"floor(id / {n}) * 1000D + 500 as y")
    places = spark.createDataFrame([("r", k, *map(float, v)) for k, v in enumerate(zip(x, y, share))], "region string, place_id long, x double, y double, share double")
    return cells, places


def exact(cells, places, kind, scale, beta=1.0):
    p = distance.pairs(cells, places, "share")
    return p.groupBy("region", "cell_id").agg(F.sum(F.pow("share", F.lit(beta)) * kernel(F.col("d"), scale, kind)).alias("e"))


@pytest.mark.parametrize("kind,scales", [("exp", (2.0, 40.0))])
def test_weights_are_within_the_tolerance(spark, kind, scales):
    cells, places = tables(spark, 12)
    betas = (1.0, 2.77)
    got = farfield.potentials(cells, places, kind, scales, betas, 1e-3, order=4, leaf_km=0.5, square_km=1.0)
    for k, (b, s) in enumerate((b, s) for b in betas for s in scales):
        both = exact(cells, places, kind, s, b).join(got, ["region", "cell_id"], "left").select("e", F.coalesce(f"w{k}", F.lit(0.0)).alias("w")).collect()
        e, w = np.array([r.e for r in both]), np.array([r.w for r in both])
        assert len(e) == 144 and (np.abs(e - w) <= 1e-3 * (e + e.mean())).all()


def test_pairs_grow_with_the_cells_not_with_their_square(spark):
    met = {}
    for n in (16, 32):
        cells, places = tables(spark, n)
        met[n] = farfield.sources(cells, places, "power", (2.0,), (1.0,), 1e-2, 5, 1.0, 1.0).count()  # a square is a cell here
    # four times the cells and places are sixteen times the pairs
    assert met[32] < 8 * met[16] and met[32] < 0.25 * 16 * 32**4


def test_the_bound_holds(spark):
    """Interpolation over a square against the kernel at random places in it."""
    rng = np.random.default_rng(4)
    order, half = 5, 1.0
    t = np.array(farfield._points(order))
    basis = lambda u: np.array([np.prod([(u - t[j]) / (t[k] - t[j]) for j in range(order) if j != k], axis=0) for k in range(order)])
    for kind, scale, f in (("exp", 0.8, lambda d: np.exp(-d / 0.8)), ("gauss", 2.0, lambda d: np.exp(-d * d / 8)), ("power", 2.5, lambda d: (d + 1) ** -2.5)):
        for gap in (1.0, 2.5, 5.0, 9.0):
            x = 1 + gap  # a target to the right of the square
            u, v = rng.uniform(-1, 1, (2, 400))
            approx = np.einsum("in,jn,ij->n", basis(u), basis(v), f(np.hypot(x - t[:, None], t[None, :])))
            worst = np.abs(approx - f(np.hypot(x - u, v))).max()
            bound = spark.range(1).select(F.expr(farfield.error_bound(f"{gap}D", f"{half}D", scale, kind, order))).first()[0]
            assert worst <= bound and (gap < 9 or bound < 1e-2)


def test_odd_tables(spark):
    cells, places = tables(spark, 3, 2)
    options = {"order": 3, "leaf_km": 0.5, "square_km": 1.0}
    # one spot with a third of all places, a region without places, a place far from all cells, shares of 0
    many = places.unionByName(spark.range(300).selectExpr("'r' as region", "1000 + id as place_id", "777D as x", "-777D as y", "1D as share"))
    many = many.unionByName(spark.createDataFrame([("r", -1, 9e6, -9e6, 1.0), ("s", 5, 0.0, 0.0, 0.0)], places.schema))
    more = cells.unionByName(spark.createDataFrame([("s", 900, 10.0, 10.0), ("t", 901, 0.0, 0.0)], "region string, cell_id long, x double, y double"))
    want = {r.cell_id: r.e for r in exact(more, many, "power", 2.0).collect()}
    got = {r.cell_id: r.w0 for r in farfield.potentials(more, many, "power", (2.0,), **options).collect()}
    mean = sum(v for k, v in want.items() if k < 900) / 9
    assert all(math.isclose(got[k], want[k], rel_tol=1e-3, abs_tol=1e-3 * mean) for k in range(9))
    assert got.get(900, 0.0) == want[900] == 0.0 and 901 not in got
    assert farfield.potentials(cells.limit(0), places, "exp", (2.0,), **options).count() == 0
    assert farfield.potentials(cells, places.limit(0), "exp", (2.0,), **options).count() == 0
