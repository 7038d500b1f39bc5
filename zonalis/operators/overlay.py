"""Polygons cut to cells and to each other, with their geometry: concave rings, holes and several parts.

A geometry is ``parts``: an array of polygons, each an array of rings, each an array of points (x, y) without the first one
again at the end; the first ring is the outer one, counter-clockwise, the others are its holes, clockwise.

A ring is clipped to a cell edge of the box by edge of the box, which leaves bridges along the box's sides; all rings of a
feature in a cell come together there, what runs along a side in both directions cancels, and the rest is chained to rings
anew. Two polygons are met by cutting their edges where they cross, keeping those of each that are inside the other (and
common ones that run the same way once), and chaining again. Cells that no edge touches stay ranges until Spark fills them.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.operators import grid

SNAP = 2.0**20  # points are told apart to a millionth of a metre
LEAST = 1e-6  # square metres of a ring
PARTS = "array<array<array<struct<x: double, y: double>>>>"
_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_PARTS = pa.list_(pa.list_(pa.list_(_POINT)))

Ring = np.ndarray
Edge = tuple[tuple[float, float], tuple[float, float]]


def signed(ring: Ring) -> float:
    p = ring - ring[0]
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def turned(ring: Ring, hole: bool) -> Ring:
    """Outer rings counter-clockwise, holes clockwise."""
    return ring[::-1] if (signed(ring) > 0) == hole else ring


def edges_of(rings: list[Ring]) -> list[Edge]:
    out: list[Edge] = []
    for ring in rings:
        p = [tuple(v) for v in (np.round(ring * SNAP) / SNAP).tolist()]
        out += [(a, b) for a, b in zip(p, p[1:] + p[:1]) if a != b]
    return out


def chained(edges: list[Edge]) -> list[Ring]:
    """Rings of directed edges with their inside on the left; at a point of several rings the sharpest turn to the left is
    taken, so that rings only touch."""
    after: dict[tuple, list[tuple]] = defaultdict(list)
    for a, b in edges:
        after[a].append(b)
    out = []
    for start in list(after):
        while after[start]:
            ring, at = [start], after[start].pop()
            while at != start:
                if not after[at]:  # a loose end, from rounding
                    ring = []
                    break
                if len(after[at]) > 1:
                    back = np.arctan2(ring[-1][1] - at[1], ring[-1][0] - at[0])
                    to = max(after[at], key=lambda w: (np.arctan2(w[1] - at[1], w[0] - at[0]) - back) % (2 * np.pi))
                else:
                    to = after[at][0]
                after[at].remove(to)
                ring.append(at)
                at = to
            if len(ring) > 2:
                out.append(np.array(_straight(ring)))
    return [r for r in out if len(r) > 2 and abs(signed(r)) > LEAST]


def _straight(ring: list[tuple]) -> list[tuple]:
    """The ring without points in the middle of level or upright sides."""
    n = len(ring)
    keep = []
    for k, (x, y) in enumerate(ring):
        (ax, ay), (bx, by) = ring[k - 1], ring[(k + 1) % n]
        if not (ax == x == bx or ay == y == by):
            keep.append((x, y))
    return keep


def nested(rings: list[Ring]) -> list[list[Ring]]:
    """Polygons of rings: each hole goes to the smallest outer ring around it."""
    outer = sorted((r for r in rings if signed(r) > 0), key=signed)
    parts = [[r] for r in outer]
    for hole in (r for r in rings if signed(r) < 0):
        (ax, ay), (bx, by) = hole[0], hole[1]
        n = np.hypot(bx - ax, by - ay)
        x, y = (ax + bx) / 2 + (by - ay) / n * 1e-5, (ay + by) / 2 - (bx - ax) / n * 1e-5  # just inside the hole
        home = next((k for k, r in enumerate(outer) if grid.inside(r, np.array([x]), np.array([y]))[0]), None)
        if home is not None:
            parts[home].append(hole)
    return parts


def in_box(chains: list[Ring], x0: float, y0: float, x1: float, y1: float) -> list[list[Ring]]:
    """Polygons of rings that were clipped to a box, bridges along its sides included."""
    free: list[Edge] = []
    sides: dict[tuple[int, float], list[tuple[float, float, int]]] = defaultdict(list)
    for a, b in edges_of(chains):
        for axis, at in ((0, x0), (0, x1), (1, y0), (1, y1)):
            if a[axis] == at == b[axis]:
                lo, hi = sorted((a[1 - axis], b[1 - axis]))
                sides[axis, at].append((lo, hi, 1 if b[1 - axis] > a[1 - axis] else -1))
                break
        else:
            free.append((a, b))
    for (axis, at), runs in sides.items():
        change: dict[float, int] = defaultdict(int)
        for lo, hi, way in runs:
            change[lo] += way
            change[hi] -= way
        net, places = 0, sorted(change)
        for lo, hi in zip(places, places[1:]):
            net += change[lo]
            if net:
                a, b = ((at, lo), (at, hi)) if axis == 0 else ((lo, at), (hi, at))
                free.append((a, b) if net > 0 else (b, a))
    return nested(chained(free))


def _cut(a: np.ndarray, b: np.ndarray) -> list[Edge]:
    """The edges a (n, 4), cut where edges b meet them."""
    d, e = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    w = b[None, :, :2] - a[:, None, :2]
    cross = lambda p, q: p[..., 0] * q[..., 1] - p[..., 1] * q[..., 0]
    det, size = cross(d, e), (d * d).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = cross(w, e) / det, cross(w, d) / det
        near = 1e-9
        t = np.where((np.abs(det) > 1e-12 * size) & (u >= -near) & (u <= 1 + near), t, np.nan)
        # ends of b that lie on a, parallel edges included
        ends = []
        for p in (w, w + e):
            along, off = (p * d).sum(axis=2) / size, cross(d, p) ** 2 / size
            ends.append(np.where(off < SNAP**-2, along, np.nan))
    out: list[Edge] = []
    for k, row in enumerate(np.concatenate([t, *ends], axis=1)):
        cuts = np.unique(np.concatenate([[0.0, 1.0], row[(row > 0) & (row < 1)]]))
        p = np.round((a[k, :2] + cuts[:, None] * (a[k, 2:] - a[k, :2])) * SNAP) / SNAP
        p[0], p[-1] = a[k, :2], a[k, 2:]
        q = [tuple(v) for v in p.tolist()]
        out += [(v, w) for v, w in zip(q, q[1:]) if v != w]
    return out


def _within(edges: list[Edge], rings: list[Ring]) -> np.ndarray:
    """Whether the middles of edges are inside polygons (even-odd)."""
    p = np.array([((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in edges]).reshape(-1, 2)
    out = np.zeros(len(p), bool)
    for r in rings:
        out ^= grid.inside(r, p[:, 0], p[:, 1])
    return out


def meet(a: list[list[Ring]], b: list[list[Ring]]) -> list[list[Ring]]:
    """Polygons of what two sets of polygons have in common; where they only touch, nothing."""
    ra, rb = [r for part in a for r in part], [r for part in b for r in part]
    ea, eb = edges_of(ra), edges_of(rb)
    if not ea or not eb:
        return []
    fa, fb = (np.array([(*p, *q) for p, q in e]) for e in (ea, eb))
    ca, cb = _cut(fa, fb), _cut(fb, fa)
    sa, sb = set(ca), set(cb)
    keep = [e for e, k in zip(ca, _within(ca, rb)) if e in sb or (k and e[::-1] not in sb)]
    keep += [e for e, k in zip(cb, _within(cb, ra)) if k and e not in sa and e[::-1] not in sa]
    return nested(chained(keep))


# --------------------------------------------------------------------------- on tables
def _rings(pts) -> Ring:
    return np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2)


def _plain(parts: list[list[Ring]]) -> list:
    return [[[{"x": x, "y": y} for x, y in r.tolist()] for r in part] for part in parts]


def _shares(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """Shares of rings (feature, is_hole, pts, first) as (feature, ix, lo, hi, whole, chain) of the cells they cover."""
    names, kinds = ["feature", "ix", "lo", "hi", "whole", "chain"], [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(_POINT)]
    for b in batches:
        for feature, hole, pts, first in zip(*(b.column(k).to_pylist() for k in range(4))):
            ring = _rings(pts)
            if len(ring) < 3 or not signed(ring):
                continue
            ring = turned(ring, hole)
            big = 4 * (np.abs(ring).max() + size)
            for ix in range(first, min(first + grid.CHUNK, int(np.ceil(ring[:, 0].max() / size)))):
                rows = [(feature, ix, lo, hi, 0 if chain is not None else -1 if hole else 1, None if chain is None else [{"x": x, "y": y} for x, y in chain.tolist()]) for lo, hi, chain in grid.column_pieces(ring, ix, size, big)]
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def _stitched(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for ix, iy, whole, chains in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
            x0, y0, x1, y1 = ix * size, iy * size, (ix + 1) * size, (iy + 1) * size
            rings = [_rings(c) for c in chains]
            if whole:
                square = np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])
                rings.append(square if whole > 0 else square[::-1])
            parts.append(_plain(in_box(rings, *(round(v * SNAP) / SNAP for v in (x0, y0, x1, y1)))))
        yield pa.record_batch([*b.columns[:3], pa.array(parts, _PARTS)], ["feature", "ix", "iy", "parts"])


def area(parts: Column | str) -> Column:
    """Square metres of a geometry, by the shoelace formula."""

    def shoelace(ring: Column) -> Column:
        n, first = F.size(ring), F.element_at(ring, 1)
        x = lambda p: p["x"] - first["x"]  # noqa: E731  (near the first point, for the digits)
        y = lambda p: p["y"] - first["y"]
        after = lambda i: F.element_at(ring, (F.pmod(i + 1, n) + 1).cast("int"))
        return F.aggregate(F.transform(ring, lambda p, i: x(p) * y(after(i)) - x(after(i)) * y(p)), F.lit(0.0), lambda s, v: s + v) / 2

    rings = F.flatten(parts)
    return F.aggregate(F.transform(rings, shoelace), F.lit(0.0), lambda s, v: s + v)


def cut_cells(border: DataFrame, size: float = 1000.0, by: str = "region") -> DataFrame:
    """(by, cell_id, ix, iy, whole, area_km2, parts): a row for each cell and feature that meet, with what they have in common;
    ``whole`` tells that it is the square itself.

    ``border`` is (by, part, ring, is_hole, pts). Cells that a feature only touches have no row.
    """
    s = F.lit(float(size))
    xs = F.transform("pts", lambda p: p["x"])
    low = F.floor(F.array_min(xs) / s)
    first = F.explode(F.sequence(low, F.greatest(low, F.ceil(F.array_max(xs) / s) - 1), F.lit(grid.CHUNK).cast("long")))
    shares = border.where(F.size("pts") >= 3).select(F.col(by).cast("string").alias("feature"), "is_hole", "pts", first.alias("first")).repartition("feature", "is_hole", "first")
    pieces = shares.mapInArrow(lambda it: _shares(it, size), "feature string, ix long, lo long, hi long, whole int, chain array<struct<x: double, y: double>>")
    each = pieces.withColumn("iy", F.explode(F.sequence("lo", F.col("hi") - 1)))
    cells = each.groupBy("feature", "ix", "iy").agg(F.sum("whole").cast("int").alias("whole"), F.collect_list("chain").alias("chains"))
    touched = cells.where(F.size("chains") > 0).mapInArrow(lambda it: _stitched(it, size), f"feature string, ix long, iy long, parts {PARTS}")
    corner = lambda dx, dy: F.struct(((F.col("ix") + dx) * s).alias("x"), ((F.col("iy") + dy) * s).alias("y"))
    square = F.array(F.array(F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))))
    full = cells.where((F.size("chains") == 0) & (F.col("whole") > 0)).select("feature", "ix", "iy", F.lit(True).alias("whole"), square.alias("parts"))
    both = full.unionByName(touched.where(F.size("parts") > 0).withColumn("whole", F.lit(False)))
    return both.select(F.col("feature").alias(by), grid.cell_id().alias("cell_id"), "ix", "iy", "whole", F.when(F.col("whole"), s * s).otherwise(area("parts")).alias("_a"), "parts").select(by, "cell_id", "ix", "iy", "whole", (F.col("_a") / 1e6).alias("area_km2"), "parts")


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = b.num_columns
        pairs = zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist())
        both = [_plain(meet(*([[_rings(r) for r in part] for part in g] for g in pair))) for pair in pairs]
        yield pa.record_batch([*b.columns[: n - 2], pa.array(both, _PARTS)], [*b.schema.names[: n - 2], "parts"])


def intersections(a: DataFrame, b: DataFrame, size: float = 1000.0, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(a, b, ix, iy, area_km2, parts): what each two features of two layers (region, part, ring, is_hole, pts) have in common, cell
    by cell. Features meet in the cells that both cover, not each with each."""
    x = cut_cells(a, size).select(F.col("region").alias(names[0]), "ix", "iy", F.col("whole").alias("_wa"), F.col("parts").alias("_pa"))
    y = cut_cells(b, size).select(F.col("region").alias(names[1]), "ix", "iy", F.col("whole").alias("_wb"), F.col("parts").alias("_pb"))
    j = x.join(y, ["ix", "iy"])
    keys = [*names, "ix", "iy"]
    easy = j.where("_wa or _wb").select(*keys, F.when(F.col("_wa"), F.col("_pb")).otherwise(F.col("_pa")).alias("parts"))
    rest = j.where("not (_wa or _wb)").select(*keys, "_pa", "_pb")
    kinds = ", ".join(f"{k} {t}" for k, t in rest.dtypes[:4])
    hard = rest.mapInArrow(_met, f"{kinds}, parts {PARTS}").where(F.size("parts") > 0)
    return easy.unionByName(hard).select(*keys, (area("parts") / 1e6).alias("area_km2"), "parts")
