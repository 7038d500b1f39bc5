"""Gravity weights without all pairs: places far from a square of cells count together.

Places are the leaves of a quadtree of squares. Cells are gathered in squares too, and each of these goes down the tree: a node
whose greatest possible part is below the tolerance is left out, one that is far enough for its size is met as ``order`` x
``order`` points, small ones are met place by place, and the others are opened.

The points are the Chebyshev points of the node's square, with the masses that interpolation gives them, so that every kernel
can be summed over them as if they were places. The error for a unit of mass has a bound: on the ellipse with parameter r
around the square's side, none of the kernels exceeds its value at sqrt(d^2 - b^2), b being a point's imaginary part and d the
least distance at its real part; the interpolation error of a side is at most 4 r^(1 - order) / (r - 1) times that, and that of
both sides (1 + L) times as much, L being the Lebesgue constant of the points. A node is met as points where the bound is at most
``tolerance`` times the least kernel of its places, or times a lower bound of the mean weight of the region's cells for a unit of
the region's mass, and left out where the kernel itself is at most the latter; so no cell's weight is off by more than
``tolerance`` times the sum of itself and that mean. The lower bound comes from cells and places that share a square.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.functions.scalar import kernel
from zonalis.operators import graph, spots

ORDER, LEAF_KM, SQUARE_KM, TOLERANCE = 6, 5.0, 25.0, 1e-3
ELLIPSES = (2.0, 3.5, 6.0, 10.0)
_NODE = ["region", "level", "bx", "by"]


def _points(order: int) -> list[float]:
    return [math.cos((2 * k + 1) * math.pi / (2 * order)) for k in range(order)]


def _up(leaves: DataFrame, levels: int) -> DataFrame:
    """Rows of leaf squares (bx, by), repeated for all squares above them."""
    up = leaves.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return up.withColumns({"bx": F.expr("shiftright(bx, level)"), "by": F.expr("shiftright(by, level)")})


def _nodes(places: DataFrame, levels: int, betas: Sequence[float]) -> DataFrame:
    """The tree: (region, level, bx, by, places, m0, m1, ...), a mass for each beta."""
    mass = [F.sum(f"m{k}").alias(f"m{k}") for k in range(len(betas))]
    leaves = places.groupBy("region", "bx", "by").agg(F.count("*").alias("places"), *mass)
    return _up(leaves, levels).groupBy(*_NODE).agg(F.sum("places").alias("places"), *[F.sum(f"m{k}").alias(f"m{k}") for k in range(len(betas))])


def _allowed(cells: DataFrame, nodes: DataFrame, levels: int, leaf: float, kind: str, scales: Sequence[float], betas: Sequence[float], tolerance: float) -> DataFrame:
    """(region, t0, t1, ...): for each scale what a unit of mass may be off."""
    met = _up(cells.groupBy("region", "bx", "by").agg(F.count("*").alias("cells")), levels).groupBy(*_NODE).agg(F.sum("cells").alias("cells")).join(nodes, _NODE)
    across = F.pow(F.lit(2.0), F.col("level")) * (leaf / 1000 * math.sqrt(2))
    sums = [F.sum(F.col("cells") * F.col(f"m{j}") * kernel(across, s, kind)).alias(f"w{i}_{j}") for i, s in enumerate(scales) for j in range(len(betas))]
    low = met.groupBy("region", "level").agg(*sums)
    low = low.groupBy("region").agg(*[F.max(f"w{i}_{j}").alias(f"w{i}_{j}") for i in range(len(scales)) for j in range(len(betas))])
    n = cells.groupBy("region").agg(F.count("*").alias("n"))
    total = nodes.where(F.col("level") == levels).groupBy("region").agg(*[F.sum(f"m{j}").alias(f"total{j}") for j in range(len(betas))])
    each = lambda i: [F.col(f"w{i}_{j}") / F.col("n") / F.nullif(F.col(f"total{j}"), F.lit(0.0)) * tolerance for j in range(len(betas))]
    # greatest() and least() pass over nulls: the sum does not
    least = lambda xs: F.when(reduce(lambda a, b: a + b, xs).isNotNull(), F.least(*xs) if len(xs) > 1 else xs[0]).otherwise(0.0)
    return n.join(total, "region").join(low, "region", "left").select("region", *[least(each(i)).alias(f"t{i}") for i in range(len(scales))])


def _kernel(d: str, scale: float, kind: str) -> str:
    """``kernel`` of a finite distance in SQL: a node's verdict has dozens of them."""
    return {"exp": f"exp(-({d}) / {scale!r}D)", "gauss": f"exp(-({d}) * ({d}) / {2 * scale * scale!r}D)", "power": f"power({d} + 1, -{scale!r}D)"}[kind]


def error_bound(gap: str, half: str, scale: float, kind: str, order: int) -> str:
    """In SQL, what interpolation over a square with sides 2 ``half`` may be off for a unit of mass at a distance of ``gap`` or more (km)."""
    lebesgue = 2 / math.pi * math.log(order) + 1
    bounds = []
    for r in ELLIPSES:
        long, high = (r + 1 / r) / 2, (r - 1 / r) / 2  # in units of the half side
        # the least of (g - long * c)^2 - high^2 * (1 - c^2) over the ellipse, c being the cosine of a point's angle
        g, both = f"({gap} / {half} + 1)", long * long + high * high
        low = f"if({g} * {long / both!r}D >= 1, ({g} - {long!r}D) * ({g} - {long!r}D), {g} * {g} * {1 - long * long / both!r}D - {high * high!r}D)"
        factor = (1 + lebesgue) * 4 * r ** (1 - order) / (r - 1)
        bounds.append(f"if({g} > {long!r}D and {low} > 0, {_kernel(f'{half} * sqrt({low})', scale, kind)} * {factor!r}D, double('inf'))")
    return f"least({', '.join(bounds)})"


def sources(cells: DataFrame, places: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,), tolerance: float = TOLERANCE, order: int = ORDER, leaf_km: float = LEAF_KM, square_km: float = SQUARE_KM) -> DataFrame:
    """(region, tx, ty, sx, sy, m0, m1, ...): what each square of cells meets, places and points, with a mass for each beta.

    ``places`` is (region, place_id, x, y, share).
    """
    leaf, side = leaf_km * 1000.0, square_km * 1000.0
    far = places.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0]
    levels = max(0, math.ceil(math.log2(max(far or 0.0, leaf) / leaf)))
    square = {"bx": F.floor(F.col("x") / leaf), "by": F.floor(F.col("y") / leaf)}
    # places at one spot are one
    mass = [F.sum(F.pow("share", F.lit(float(b)))).alias(f"m{k}") for k, b in enumerate(betas)]
    p = graph.settle(places.groupBy("region", "x", "y").agg(*mass).withColumns(square))
    nodes = graph.settle(_nodes(p, levels, betas))
    limits = _allowed(cells.select("region", "x", "y").withColumns(square), nodes, levels, leaf, kind, scales, betas, tolerance)
    at = {"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)}
    tiles = cells.select("region", "x", "y").withColumns(at).groupBy("region", "tx", "ty").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    tiles = graph.settle(tiles.join(limits, "region"))

    tile = tiles.columns
    slim = nodes.select(*_NODE, "places")
    # nodes below are met place by place, so the way down ends there
    deep = nodes.where(F.col("places") > order * order).agg(F.min("level")).first()[0]
    front = tiles.join(slim.where(F.col("level") == levels), "region")
    met, level = None, levels
    measured = {
        "gap": F.expr("hypot(greatest(bx * size - x1, x0 - (bx + 1) * size, 0D), greatest(by * size - y1, y0 - (by + 1) * size, 0D)) / 1000"),
        "reach": F.expr("hypot(greatest((bx + 1) * size, x1) - least(x0, bx * size), greatest((by + 1) * size, y1) - least(y0, by * size)) / 1000"),
        "half": F.expr("size / 2000"),
    }
    nothing = " and ".join(f"{_kernel('gap', s, kind)} <= t{i}" for i, s in enumerate(scales))
    points = " and ".join(f"{error_bound('gap', 'half', s, kind, order)} <= greatest({_kernel('reach', s, kind)} * {tolerance!r}D, t{i})" for i, s in enumerate(scales))
    # the same for all levels, so that Spark compiles it once
    verdict = F.expr(f"case when {nothing} then 'none' when level = 0 or places <= {order * order} then 'places' when {points} then 'points' else 'open' end")
    while True:
        front = graph.settle(front.withColumn("size", F.expr(f"power(2D, level) * {leaf!r}D")).withColumns(measured).withColumn("verdict", verdict).where("verdict <> 'none'").drop("size", *measured))
        kept = front.where("verdict <> 'open'").select("region", "tx", "ty", "level", "bx", "by", "verdict")
        met = kept if met is None else met.unionByName(kept)
        opened = front.where("verdict = 'open'")
        if level == 0 or deep is None or level < deep:
            break
        level -= 1
        below = slim.where(F.col("level") == level).withColumns({"_px": F.shiftright("bx", 1), "_py": F.shiftright("by", 1)})
        up = opened.select(*tile, F.col("bx").alias("_px"), F.col("by").alias("_py"))
        front = up.join(below, ["region", "_px", "_py"]).drop("_px", "_py")

    held = _up(p, levels)
    names = ["region", "tx", "ty", "sx", "sy", *[f"m{k}" for k in range(len(betas))]]
    near = met.where("verdict = 'places'").join(held, _NODE).select("region", "tx", "ty", F.col("x").alias("sx"), F.col("y").alias("sy"), *[f"m{k}" for k in range(len(betas))])
    wide = met.where("verdict = 'points'")
    weights = _weights(held.join(wide.select(*_NODE).distinct(), _NODE, "left_semi"), leaf, order, betas)
    return near.select(*names).unionByName(wide.join(weights, _NODE).select(*names))


def _weights(held: DataFrame, leaf: float, order: int, betas: Sequence[float]) -> DataFrame:
    """(region, level, bx, by, sx, sy, m0, ...): each node's masses at its Chebyshev points."""
    t = _points(order)
    size = F.pow(F.lit(2.0), F.col("level")) * leaf
    basis = lambda u: F.array(*[reduce(lambda a, b: a * b, [(u - t[j]) / (t[k] - t[j]) for j in range(order) if j != k], F.lit(1.0)) for k in range(order)])
    inside = lambda axis, b: (F.col(axis) / size - F.col(b)) * 2 - 1
    masses = [f"m{k}" for k in range(len(betas))]
    rows = held.select(*_NODE, *masses, basis(inside("x", "bx")).alias("_a"), basis(inside("y", "by")).alias("_b"))
    rows = rows.select(*_NODE, *masses, "_a", F.posexplode("_b").alias("_j", "_v")).select(*_NODE, *masses, "_j", "_v", F.posexplode("_a").alias("_i", "_u"))
    out = rows.groupBy(*_NODE, "_i", "_j").agg(*[F.sum(F.col(m) * F.col("_u") * F.col("_v")).alias(m) for m in masses])
    point = F.array(*[F.lit(v) for v in t])
    place = lambda b, k: (F.col(b) + (F.element_at(point, F.col(k) + 1) + 1) / 2) * size
    return out.select(*_NODE, place("bx", "_i").alias("sx"), place("by", "_j").alias("sy"), *[f"m{k}" for k in range(len(betas))])


def fields(cells: DataFrame, places: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,), tolerance: float = TOLERANCE, **options) -> DataFrame:
    """(region, x, y, w0, w1, ...): for each spot of cells the sums of share^beta * kernel(d) for all betas and scales, beta by beta.

    ``places`` is (region, place_id, x, y, share) with shares of 0 or more. Spots that meet nothing have no row.
    """
    side = options.get("square_km", SQUARE_KM) * 1000.0
    found = sources(cells, places, kind, scales, betas, tolerance, **options).withColumnsRenamed({"sx": "x", "sy": "y"})
    at = spots.spots(cells, "region", "x", "y").withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)})
    out = spots.sums(at, found, ["region", "tx", "ty"], ["x", "y"], [(kind, float(s), f"m{j}") for j in range(len(betas)) for s in scales])
    return out.select("region", "x", "y", *[F.greatest(f"w{k}", F.lit(0.0)).alias(f"w{k}") for k in range(len(betas) * len(scales))])


def potentials(cells: DataFrame, places: DataFrame, kind: str, scales: Sequence[float], betas: Sequence[float] = (1.0,), tolerance: float = TOLERANCE, **options) -> DataFrame:
    """(region, cell_id, w0, w1, ...): ``fields`` at the cells. Cells that meet nothing have no row."""
    found = fields(cells, places, kind, scales, betas, tolerance, **options)
    return cells.select("region", "cell_id", "x", "y").join(found, ["region", "x", "y"]).drop("x", "y")
