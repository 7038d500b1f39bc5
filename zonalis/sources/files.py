"""Tables in and out: indicators, places, grids, GraphML, Overpass JSON, CSV; caching of what was built."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.functions.scalar import whole_number

INDICATORS = "object_name string, object_level string, indicator_code string, indicator_name string, indicator_unit string, section string, year int, indicator_value double"
PLACES = "name string, lon double, lat double, population double, place string"
OVERPASS = "elements array<struct<type: string, id: bigint, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
GRAPHML = "_id string, _source string, _target string, data array<struct<_key: string, _VALUE: string>>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def require(spark: SparkSession, path: str, label: str) -> str:
    if not exists(spark, path):
        raise FileNotFoundError(f"{label} is missing: {path}")
    return path


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``; built and written first if it is missing or ``force`` is set."""
    if force or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def retry(work: Callable[[], DataFrame], attempts: int = 3, wait_s: float = 8.0):
    """The work's result; an OSError is tried again after a wait."""
    for k in range(attempts):
        with contextlib.suppress(OSError) if k + 1 < attempts else contextlib.nullcontext():
            return work()
        time.sleep(wait_s)
    raise AssertionError


def read_indicators(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDICATORS).parquet(path)


def read_places(spark: SparkSession, path: str, literal: list[tuple] = (), known_population: bool = True) -> DataFrame:
    """(name, lon, lat, population, place) from a CSV file, or from literal rows if it is missing."""
    df = spark.read.schema(PLACES).option("header", True).csv(path) if exists(spark, path) else spark.createDataFrame(list(literal), PLACES)
    return df.where(F.col("population").isNotNull()) if known_population else df


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header: for reports of a few rows."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_grid(df: DataFrame, path: str, *optional: str, geometry: bool = False, size: float = 1000.0) -> None:
    """Cells as Parquet by region; ``optional`` columns are kept where there are any. With ``geometry`` the cells go with
    their shape as WKB: cut by the border where they have ``parts``, else their square."""
    if geometry:
        from zonalis.sources.spatial import with_wkb

        df = with_wkb(df, size)
    keep = [c for c in ("region", "cell_id", "ix", "iy", "x", "y", "area_km2", "population", "geometry") if c in df.columns] + [c for c in optional if c in df.columns]
    df.select(keep).write.mode("overwrite").partitionBy("region").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A road graph as two Parquet tables."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def load_roads(spark: SparkSession, path: str, build: Callable[[], tuple[DataFrame, DataFrame]], force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) at ``path``; built and written first if they are missing or ``force`` is set."""
    if force or not exists(spark, f"{path}/edges"):
        write_graph(*build(), path)
    return read_graph(spark, path)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A road graph as GraphML text, for a graph that one program is to read: one file, written by one task."""
    q = lambda c: F.col(c).cast("string")
    data = lambda k, c: F.concat(F.lit(f'<data key="{k}">'), q(c), F.lit("</data>"))
    n = nodes.select(F.lit(1).alias("o"), q("id").alias("k"), F.concat(F.lit('<node id="'), q("id"), F.lit('">'), data("d0", "x"), data("d1", "y"), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("o"), q("src").alias("k"), F.concat(F.lit('<edge source="'), q("src"), F.lit('" target="'), q("dst"), F.lit('">'), data("d2", "travel_time"), F.lit("</edge>")).alias("value"))
    keys = "".join(f'<key id="d{i}" for="{f}" attr.name="{a}" attr.type="double"/>' for i, (f, a) in enumerate((("node", "x"), ("node", "y"), ("edge", "travel_time"))))
    spark = nodes.sparkSession
    frame = spark.createDataFrame([(0, "", f'<?xml version="1.0" encoding="utf-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "", "</graph></graphml>")], "o int, k string, value string")
    frame.union(n).union(e).coalesce(1).sortWithinPartitions("o", "k").select("value").write.mode("overwrite").text(path)


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modified) of the files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


#: Geometry types that a town may have.
TOWN_SHAPES = ("Point", "Polygon", "MultiPolygon")


def tagged(features: DataFrame, bbox: tuple[float, float, float, float] | None = None, tags: dict[str, list[str]] | None = None, shapes: tuple[str, ...] = TOWN_SHAPES) -> DataFrame:
    """Map features (lon, lat, tags map, geometry_type, ...) with one of the wanted values of any tag, of the wanted shapes, in a
    box (west, south, east, north)."""
    wanted = F.lit(False)
    for key, values in (tags or {"place": ["city", "town"]}).items():
        wanted = wanted | F.coalesce(F.col("tags")[key].isin(values), F.lit(False))
    out = features.where(wanted & F.col("geometry_type").isin(*shapes))
    if bbox is None:
        return out
    w, s, e, n = bbox
    return out.where(F.col("lon").between(w, e) & F.col("lat").between(s, n))


def places_of(spark: SparkSession, path: str, region: str, features: Callable[[], DataFrame], bbox: tuple[float, float, float, float] | None = None, force: bool = False) -> DataFrame:
    """(region, place_id, lon, lat) of a region's towns: the table at ``path``, else the known towns, else map features; kept."""
    from zonalis.sources import literals

    def made() -> DataFrame:
        known = literals.towns(spark, region)
        if not known.isEmpty():
            return known.select(F.lit(region).alias("region"), F.col("place_id").cast("long").alias("place_id"), "lon", "lat")
        found = tagged(features(), bbox)
        return found.select(F.lit(region).alias("region"), F.xxhash64("lon", "lat").alias("place_id"), "lon", "lat")

    return materialize(spark, path, made, force)


def overpass_places(json_text: DataFrame, column: str = "json", order: str | None = None) -> DataFrame:
    """(name, lon, lat, population, place) from Overpass answers, the first element of each name."""
    e = json_text.select(*([F.col(order).alias("_o")] if order else [F.lit(0).alias("_o")]), F.posexplode(F.from_json(column, OVERPASS)["elements"]).alias("pos", "e"))
    node = F.col("e.type") == "node"
    t = F.col("e.tags")
    p = e.select(
        "_o", "pos", t["name"].alias("name"), F.when(node, F.col("e.lon")).otherwise(F.col("e.center.lon")).alias("lon"), F.when(node, F.col("e.lat")).otherwise(F.col("e.center.lat")).alias("lat"),
        whole_number(t["population"]).cast("double").alias("population"), t["place"].alias("place"),
    ).where("name is not null and name <> '' and lat is not null")
    return p.withColumn("_k", F.row_number().over(W.partitionBy("name").orderBy("_o", "pos"))).where("_k = 1").drop("_k", "_o", "pos")


def read_graphml(spark: SparkSession, path: str, keys: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, x, y), edges(src, dst, travel_time)); ``keys`` names the file's keys of x, y and travel_time."""
    value = lambda k: F.filter("data", lambda d: d["_key"] == keys[k])[0]["_VALUE"].cast("double").alias(k)
    read = lambda tag: spark.read.format("xml").schema(GRAPHML).option("rowTag", tag).load(path)
    nodes = read("node").select(F.col("_id").cast("long").alias("id"), value("x"), value("y"))
    return nodes, read("edge").select(F.col("_source").cast("long").alias("src"), F.col("_target").cast("long").alias("dst"), value("travel_time"))
