"""Grids over boxes and polygons, clipping, zonal sums. Coordinates are Web Mercator metres.

A border is (region, part, ring, is_hole, pts array<struct<x, y>>), rings closed or not. A cell is cut in Python only
where an edge of the border may cross it; the cells between are made from ranges by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lattice(boxes: DataFrame, size: float = 1000.0) -> DataFrame:
    """(region, ix, iy) of all squares that boxes (region, xmin, ymin, xmax, ymax) touch, snapped outward."""
    s = F.lit(float(size))
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / s), F.ceil(F.col(hi) / s) - 1)
    # the columns of squares are dealt out before each is filled, so that a large box is not one task
    columns = boxes.withColumn("ix", F.explode(span("xmin", "xmax"))).repartition("region", "ix")
    return columns.withColumn("iy", F.explode(span("ymin", "ymax")))


def box_grid(boxes: DataFrame, size: float = 1000.0) -> DataFrame:
    """Cells clipped to their box: (region, cell_id, ix, iy, x, y of the centroid, area_km2). Squares that only touch go."""
    s = F.lit(float(size))
    g = lattice(boxes, size)
    lo = lambda i, edge: F.greatest(F.col(i) * s, F.col(edge))
    hi = lambda i, edge: F.least((F.col(i) + 1) * s, F.col(edge))
    g = g.select("region", "ix", "iy", lo("ix", "xmin").alias("x0"), hi("ix", "xmax").alias("x1"), lo("iy", "ymin").alias("y0"), hi("iy", "ymax").alias("y1")).where("x1 > x0 and y1 > y0")
    return g.select("region", cell_id().alias("cell_id"), "ix", "iy", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / 1e6).alias("area_km2"))


def cell_id():
    """A key from the lattice position, the same in every run and at every cluster size."""
    return F.shiftleft(F.col("ix") + F.lit(1 << 30), 31) + F.col("iy") + F.lit(1 << 30)


def bounds(border: DataFrame) -> DataFrame:
    """(region, xmin, ymin, xmax, ymax) of all vertices."""
    p = border.select("region", F.explode("pts").alias("p"))
    return p.groupBy("region").agg(F.min("p.x").alias("xmin"), F.min("p.y").alias("ymin"), F.max("p.x").alias("xmax"), F.max("p.y").alias("ymax"))


def without_holes(border: DataFrame) -> DataFrame:
    return border.where(~F.col("is_hole"))


def clip_ring(pts: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> np.ndarray:
    """A ring cut to a box, edge of the box by edge (Sutherland and Hodgman 1974)."""
    for axis, sign, at in ((0, 1, x0), (0, -1, x1), (1, 1, y0), (1, -1, y1)):
        if len(pts) == 0:
            return pts
        nxt = np.roll(pts, -1, axis=0)
        a, b = sign * (pts[:, axis] - at), sign * (nxt[:, axis] - at)
        cross = (a >= 0) != (b >= 0)
        t = np.where(cross, a / np.where(cross, a - b, 1), 0)[:, None]
        meet = pts + t * (nxt - pts)
        out = np.empty((2 * len(pts), 2))
        out[0::2], out[1::2] = pts, meet
        keep = np.empty(2 * len(pts), bool)
        keep[0::2], keep[1::2] = a >= 0, cross
        pts = out[keep]
    return pts


def moments(pts: np.ndarray) -> tuple[float, float, float]:
    """(area, area * centroid x, area * centroid y) of a ring, area without sign."""
    if len(pts) < 3:
        return 0.0, 0.0, 0.0
    o = pts[0]
    p = pts - o
    q = np.roll(p, -1, axis=0)
    c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
    a = c.sum() / 2
    mx, my = ((p[:, 0] + q[:, 0]) * c).sum() / 6, ((p[:, 1] + q[:, 1]) * c).sum() / 6
    s = -1.0 if a < 0 else 1.0
    return s * a, s * (mx + a * o[0]), s * (my + a * o[1])


def inside(pts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points are inside a ring (even-odd)."""
    out = np.zeros(len(x), bool)
    q = np.roll(pts, -1, axis=0)
    for (ax, ay), (bx, by) in zip(pts, q):
        if ay != by:
            over = (ay > y) != (by > y)
            out ^= over & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return out


def simplify(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """A line with fewer points, none of the others farther than the tolerance (Douglas and Peucker 1973)."""
    keep = np.zeros(len(pts), bool)
    keep[[0, -1]] = True
    todo = [(0, len(pts) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        p, d = pts[a + 1 : b], pts[b] - pts[a]
        n = np.hypot(*d)
        far = np.abs(d[0] * (p[:, 1] - pts[a][1]) - d[1] * (p[:, 0] - pts[a][0])) / n if n else np.hypot(*(p - pts[a]).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, b)]
    return pts[keep]


CHUNK = 64  # columns of cells in one task's share of a ring


def column_pieces(ring: np.ndarray, ix: int, size: float, big: float) -> Iterator[tuple[int, int, np.ndarray | None]]:
    """The cells of one column of a ring: (first iy, iy after the last, the ring clipped to the cell); whole cells as ranges with None."""
    x0, x1 = ix * size, (ix + 1) * size
    column = clip_ring(ring, x0, -big, x1, big)
    if len(column) < 3:
        return
    nxt = np.roll(column, -1, axis=0)
    along = ((column[:, 0] == nxt[:, 0]) & ((column[:, 0] == x0) | (column[:, 0] == x1))) | (column == nxt).all(axis=1)
    a, b = column[~along], nxt[~along]
    low, high = int(np.floor(column[:, 1].min() / size)), int(np.ceil(column[:, 1].max() / size))
    cut = np.zeros(high - low + 1, int)  # cells that an edge may touch
    np.add.at(cut, np.floor(np.minimum(a[:, 1], b[:, 1]) / size).astype(int) - low, 1)
    np.add.at(cut, np.minimum(np.floor(np.maximum(a[:, 1], b[:, 1]) / size).astype(int) - low + 1, high - low), -1)
    touched = np.cumsum(cut)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.concatenate([[True], touched, [True]]).astype(int)))
    for lo, hi in edge.reshape(-1, 2):  # runs of untouched cells are inside or outside as a whole
        mid = np.array([(low + lo + 0.5) * size])
        if inside(column, np.array([(x0 + x1) / 2]), mid)[0]:
            yield low + int(lo), low + int(hi), None
    for k in np.flatnonzero(touched):
        iy = low + int(k)
        yield iy, iy + 1, clip_ring(column, x0, iy * size, x1, (iy + 1) * size)


def _column(ring: np.ndarray, ix: int, size: float, big: float) -> Iterator[tuple[int, int, float, float, float]]:
    """The cells of one column of a ring: (first iy, iy after the last, area, mx, my); whole cells as ranges with area 0."""
    for lo, hi, piece in column_pieces(ring, ix, size, big):
        if piece is None:
            yield lo, hi, 0.0, 0.0, 0.0
        elif (m := moments(piece))[0] > 0:
            yield lo, hi, *m


def _ring_cells(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """Shares of rings (region, is_hole, pts, first) to (region, ix, lo, hi, area, mx, my) of the cells they cover."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
    names = ["region", "ix", "lo", "hi", "a", "mx", "my"]
    for b in batches:
        for region, hole, pts, first in zip(*(b.column(k).to_pylist() for k in range(4))):
            ring = np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2)
            if len(ring) < 3:
                continue
            sign = -1.0 if hole else 1.0
            big = 4 * (np.abs(ring).max() + size)
            end = min(first + CHUNK, int(np.ceil(ring[:, 0].max() / size)))
            for ix in range(first, end):
                rows = [(region, ix, lo, hi, sign * a if a else sign, sign * mx, sign * my) for lo, hi, a, mx, my in _column(ring, ix, size, big)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def polygon_grid(border: DataFrame, size: float = 1000.0) -> DataFrame:
    """Cells of polygons: (region, cell_id, ix, iy, x, y of the clipped cell's centroid, area_km2).

    A ring's columns of cells are dealt out in shares; in a share, cells that no edge touches come as ranges.
    """
    s = F.lit(float(size))
    xs = F.transform("pts", lambda p: p["x"])
    first = F.explode(F.sequence(F.floor(F.array_min(xs) / s), F.greatest(F.floor(F.array_min(xs) / s), F.ceil(F.array_max(xs) / s) - 1), F.lit(CHUNK).cast("long")))
    shares = border.where(F.size("pts") >= 3).select(F.col("region").cast("string"), "is_hole", "pts", first.alias("first"))
    shares = shares.repartition("region", "is_hole", "first")
    parts = shares.mapInArrow(lambda it: _ring_cells(it, size), "region string, ix long, lo long, hi long, a double, mx double, my double")
    cells = parts.withColumn("iy", F.explode(F.sequence("lo", F.col("hi") - 1)))
    whole, sign = F.abs(F.col("mx")) + F.abs(F.col("my")) == 0, F.signum("a")
    full = lambda i: sign * (F.col(i) + 0.5) * s * s * s
    cells = cells.select("region", "ix", "iy", F.when(whole, sign * s * s).otherwise(F.col("a")).alias("a"), F.when(whole, full("ix")).otherwise(F.col("mx")).alias("mx"), F.when(whole, full("iy")).otherwise(F.col("my")).alias("my"))
    t = cells.groupBy("region", "ix", "iy").agg(F.sum("a").alias("a"), F.sum("mx").alias("mx"), F.sum("my").alias("my")).where("a > 1e-6")
    return t.select("region", cell_id().alias("cell_id"), "ix", "iy", (F.col("mx") / F.col("a")).alias("x"), (F.col("my") / F.col("a")).alias("y"), (F.col("a") / 1e6).alias("area_km2"))


def polygon_area(border: DataFrame) -> DataFrame:
    """(region, area_km2), holes taken off: the shoelace formula over array functions."""
    p = F.col("pts")
    cross = F.aggregate(
        F.transform(p, lambda q, i: q["x"] * F.element_at(p, (F.pmod(i + 1, F.size(p)) + 1).cast("int"))["y"] - F.element_at(p, (F.pmod(i + 1, F.size(p)) + 1).cast("int"))["x"] * q["y"]),
        F.lit(0.0), lambda a, b: a + b,
    )
    each = F.abs(cross) / 2 * F.when(F.col("is_hole"), -1).otherwise(1)
    return border.groupBy("region").agg((F.sum(each) / 1e6).alias("area_km2"))


def points_inside(points: DataFrame, border: DataFrame, size: float = 1000.0) -> DataFrame:
    """Points (region, x, y, ...) inside their region's polygons. A point meets its square only: where the polygons cover the whole
    square it is inside, where an edge cuts the square it is tested against what is left of it (even-odd)."""
    from zonalis.operators import overlay

    cut = overlay.cut_cells(border, size).select(F.col("region").alias("_r"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("whole").alias("_whole"), F.when(~F.col("whole"), F.flatten("parts")).alias("_rings"))
    keyed = points.withColumns({"_px": F.floor(F.col("x") / size), "_py": F.floor(F.col("y") / size)})
    j = keyed.join(cut, (keyed.region == cut._r) & (keyed._px == cut._ix) & (keyed._py == cut._iy))
    return j.where(F.col("_whole") | _odd(F.col("_rings"), F.col("x"), F.col("y"))).drop("_r", "_ix", "_iy", "_px", "_py", "_whole", "_rings")


def _odd(rings: Column, x: Column, y: Column) -> Column:
    """Whether a line to the right of a point crosses an odd number of the rings' edges."""

    def crossings(ring: Column) -> Column:
        after = lambda i: F.element_at(ring, (F.pmod(i + 1, F.size(ring)) + 1).cast("int"))

        def crosses(p: Column, i: Column) -> Column:
            q = after(i)
            over = (p["y"] > y) != (q["y"] > y)
            return F.when(over & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.nullif(q["y"] - p["y"], F.lit(0.0)) + p["x"]), 1).otherwise(0)

        return F.aggregate(F.transform(ring, crosses), F.lit(0), lambda s, v: s + v)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda s, v: s + v) % 2 == 1


def zonal_sum(cells: DataFrame, pixels: DataFrame, size: float = 1000.0, nodata: float = -99999.0, value: str = "value", border: DataFrame | None = None) -> DataFrame:
    """Cells with ``population``, the sum of the pixels (region, x, y, value) whose centre is in their square
    (left and lower edge included) and, where a border is given, inside it; no pixel: 0."""
    s = F.lit(float(size))
    pixels = points_inside(pixels, border, size) if border is not None else pixels
    p = pixels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.col(value) != nodata))
    p = p.groupBy("region", F.floor(F.col("x") / s).alias("ix"), F.floor(F.col("y") / s).alias("iy")).agg(F.sum(value).alias("_p"))
    return cells.join(p, ["region", "ix", "iy"], "left").withColumn("population", F.coalesce("_p", F.lit(0.0))).drop("_p")


def square(spark: SparkSession, region: str, lon: float, lat: float, half: float) -> DataFrame:
    """The box around a point, ``half`` metres each way."""
    from zonalis.functions.scalar import merc_x, merc_y

    p = spark.range(1).select(F.lit(region).alias("region"), merc_x(F.lit(float(lon))).alias("x"), merc_y(F.lit(float(lat))).alias("y"))
    return p.select("region", (F.col("x") - half).alias("xmin"), (F.col("y") - half).alias("ymin"), (F.col("x") + half).alias("xmax"), (F.col("y") + half).alias("ymax"))


# ------------------------------------------------------------------ outlines
def edges_of(border: DataFrame) -> DataFrame:
    """(region, ax, ay, bx, by) of all rings' edges."""
    n = F.size("pts")
    each = F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at("pts", i).alias("p"), F.element_at("pts", (F.pmod(i, n) + 1).cast("int")).alias("q"))))
    e = border.where(n >= 3).select("region", each.alias("e"))
    return e.select("region", F.col("e.p.x").alias("ax"), F.col("e.p.y").alias("ay"), F.col("e.q.x").alias("bx"), F.col("e.q.y").alias("by")).where("ax <> bx or ay <> by")


def _chain(key: tuple, edges) -> "pd.DataFrame":  # noqa: F821
    """Rings of one region from its outline's edges; at a vertex of several rings the sharpest turn to the left is taken, so that they only touch."""
    import pandas as pd

    left: dict[tuple[float, float], list[tuple[float, float]]] = {}
    for ax, ay, bx, by in edges[["ax", "ay", "bx", "by"]].itertuples(index=False):
        left.setdefault((ax, ay), []).append((bx, by))
        left.setdefault((bx, by), []).append((ax, ay))
    out = []
    for start in sorted(left):
        while left[start]:
            ring, before, at = [start], None, start
            while True:
                turn = lambda w, at=at: np.arctan2(w[1] - at[1], w[0] - at[0])
                if before is None:  # at a leftmost vertex: counter-clockwise
                    to = min(left[at], key=turn)
                else:
                    back = turn(before)
                    to = max(left[at], key=lambda w: (turn(w) - back) % (2 * np.pi))
                left[at].remove(to)
                left[to].remove(at)
                before, at = at, to
                if at == start:
                    break
                ring.append(at)
            out.append((key[0], len(out), np.array(ring)))
    area = [abs(moments(r)[0]) for *_, r in out]
    rows = []
    for (region, k, ring), a in zip(out, area):
        x, y = (ring[0] + ring[1]) / 2
        within = sum(bool(inside(o, np.array([x]), np.array([y]))[0]) for (_, j, o), oa in zip(out, area) if j != k and oa > a)
        rows.append((region, k, 0, bool(within % 2), [{"x": float(px), "y": float(py)} for px, py in ring]))
    return pd.DataFrame(rows, columns=["region", "part", "ring", "is_hole", "pts"])


BORDER = "region string, part int, ring int, is_hole boolean, pts array<struct<x: double, y: double>>"


def dissolve(border: DataFrame) -> DataFrame:
    """One outline for each region: edges that two of its polygons share go, the others are chained to rings anew.

    Polygons that touch have to share vertices, as in a layer of adjoining areas; only a region's outline, not its
    area, is gathered in one task.
    """
    e = edges_of(border)
    back = (F.col("ax") > F.col("bx")) | ((F.col("ax") == F.col("bx")) & (F.col("ay") > F.col("by")))
    pick = lambda a, b: F.when(back, F.col(b)).otherwise(F.col(a))
    one = e.select("region", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"))
    outline = one.groupBy("region", "ax", "ay", "bx", "by").agg((F.count("*") % 2).alias("odd")).where("odd = 1").drop("odd")
    return outline.withColumn("region", F.col("region").cast("string")).groupBy("region").applyInPandas(_chain, BORDER)


def simplified(border: DataFrame, tolerance: float) -> DataFrame:
    """The rings with fewer points, none of the others farther than the tolerance; a ring keeps its first point and the
    one farthest from it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for pts in b.column(b.schema.get_field_index("pts")).to_pylist():
                ring = np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2)
                if len(ring) > 3:
                    far = int(np.hypot(*(ring - ring[0]).T).argmax())
                    closed = np.vstack([ring, ring[:1]])
                    ring = np.vstack([simplify(closed[: far + 1], tolerance)[:-1], simplify(closed[far:], tolerance)[:-1]])
                out.append([{"x": float(x), "y": float(y)} for x, y in ring])
            at = b.schema.get_field_index("pts")
            yield pa.record_batch([*b.columns[:at], pa.array(out, pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))), *b.columns[at + 1 :]], b.schema.names)

    return border.mapInArrow(work, border.schema)


def region_polygon(border: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """A region's outline without holes, simplified (the tolerance is in the border's unit; 0: as it is)."""
    outer = without_holes(dissolve(border))
    return simplified(outer, tolerance) if tolerance else outer


def representative_point(border: DataFrame, by: str = "region") -> DataFrame:
    """(by, x, y): a point inside each polygon: the middle of the longest stretch inside it on the line through the
    middle of its height; of a point its own place."""
    n = F.size("pts")
    dots = border.where(n == 1).groupBy(by).agg(F.min(F.struct(F.element_at("pts", 1)["x"].alias("x"), F.element_at("pts", 1)["y"].alias("y"))).alias("p")).select(by, "p.x", "p.y")
    rings = border.where(n >= 3)
    box = rings.select(by, F.explode("pts").alias("p")).groupBy(by).agg(F.min("p.y").alias("lo"), F.max("p.y").alias("hi"))
    # not through a vertex: a fixed part of the height that vertices seldom have
    line = box.select(by, (F.col("lo") + (F.col("hi") - F.col("lo")) * 0.5000173).alias("y"))
    e = edges_of(rings.withColumn("region", F.col(by))).join(line.withColumnRenamed(by, "region"), "region")
    cross = e.where((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))).select("region", "y", ((F.col("bx") - F.col("ax")) * (F.col("y") - F.col("ay")) / (F.col("by") - F.col("ay")) + F.col("ax")).alias("x"))
    xs = cross.groupBy("region", "y").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    spans = F.transform(F.sequence(F.lit(1), F.size("xs") - 1, F.lit(2)), lambda k: F.struct((F.element_at("xs", k + 1) - F.element_at("xs", k)).alias("w"), ((F.element_at("xs", k + 1) + F.element_at("xs", k)) / 2).alias("x")))
    return xs.select(F.col("region").alias(by), F.array_max(spans)["x"].alias("x"), "y").union(dots)
