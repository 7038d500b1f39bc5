"""From a region's grid, raster and towns to its grid of features, kept as a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zonalis.functions.scalar import merc_x, merc_y
from zonalis.operators import distance, grid
from zonalis.sources import files, literals

#: Fixed value: the capital's longitude and latitude; only cells of this region have a distance to it.
CAPITAL, CAPITAL_OF = (37.6173, 55.7558), "moscow"


@dataclass(frozen=True)
class Region:
    """Where a region's tables are; ``pixels`` and ``places`` make theirs (pixels: region, x, y, value)."""

    key: str
    centre: tuple[float, float]
    features: str
    cells: Callable[[], DataFrame]
    pixels: Callable[[], DataFrame]
    places: Callable[[], DataFrame]
    border: Callable[[], DataFrame] | None = None
    size: float = 1000.0


def centre_of(spark: SparkSession, key: str, lon: float, lat: float) -> DataFrame:
    return spark.range(1).select(F.lit(key).alias("region"), merc_x(F.lit(float(lon))).alias("cx"), merc_y(F.lit(float(lat))).alias("cy"))


def with_features(cells: DataFrame, pixels: DataFrame, places: DataFrame, centres: DataFrame, border: DataFrame | None = None, capital: tuple[float, float] | None = None, capital_of: str | None = None, size: float = 1000.0) -> DataFrame:
    """Cells with population and distances to the centre, the nearest town and, in one region, the capital."""
    return distance.attach(grid.zonal_sum(cells, pixels, size, border=border), places, centres, capital, capital_of)


def build(spark: SparkSession, region: Region, force: bool = False) -> DataFrame:
    """The region's grid of features; made and written if it is missing or ``force`` is set."""

    def made() -> DataFrame:
        x, y = spark.range(1).select(merc_x(F.lit(CAPITAL[0])), merc_y(F.lit(CAPITAL[1]))).first()
        key = literals.ALIASES.get(region.key, region.key)
        capital = (x, y) if key == CAPITAL_OF else None
        border = region.border() if region.border else None
        return with_features(region.cells(), region.pixels(), region.places(), centre_of(spark, region.key, *region.centre), border, capital, region.key, region.size)

    return files.materialize(spark, region.features, made, force)


def load(spark: SparkSession, regions: dict[str, Region], key: str, force: bool = False) -> tuple[DataFrame, Region]:
    return build(spark, regions[key], force), regions[key]


def border_of(spark: SparkSession, path: str, key: str, whole: Callable[[], DataFrame], half: float | None = None, lon: float = 0.0, lat: float = 0.0) -> DataFrame:
    """A region's border: the table at ``path``, or made: all of ``whole``, or, with ``half``, its part in the square of
    that half side around a point."""

    def made() -> DataFrame:
        if half is None:
            return whole()
        return clip_to_boxes(whole(), grid.square(spark, key, lon, lat, half))

    return files.materialize(spark, path, made)


def clip_to_boxes(border: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rings cut to their region's box."""
    import numpy as np
    import pyarrow as pa

    def work(batches):
        for b in batches:
            rows = []
            for region, part, ring, hole, pts, x0, y0, x1, y1 in zip(*(c.to_pylist() for c in b.columns)):
                cut = grid.clip_ring(np.array([(p["x"], p["y"]) for p in pts], float).reshape(-1, 2), x0, y0, x1, y1)
                if grid.moments(cut)[0] > 0:
                    rows.append({"region": region, "part": part, "ring": ring, "is_hole": hole, "pts": [{"x": float(x), "y": float(y)} for x, y in cut]})
            point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
            kinds = {"region": pa.string(), "part": pa.int32(), "ring": pa.int32(), "is_hole": pa.bool_(), "pts": pa.list_(point)}
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))

    joined = border.join(boxes, "region").select(F.col("region").cast("string"), F.col("part").cast("int"), F.col("ring").cast("int"), "is_hole", "pts", "xmin", "ymin", "xmax", "ymax")
    return joined.mapInArrow(work, grid.BORDER)


def each_with_roads(keys: list[str], graphs: dict[str, object], work: Callable[[str, object], DataFrame]) -> tuple[DataFrame | None, list[str]]:
    """(rows of all regions that have a road graph, the regions left out)."""
    out, skipped = None, []
    for key in keys:
        if graphs.get(key) is None:
            skipped.append(key)
            continue
        rows = work(key, graphs[key])
        out = rows if out is None else out.unionByName(rows)
    return out, skipped
