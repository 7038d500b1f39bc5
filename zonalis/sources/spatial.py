"""GeoPackage layers, rasters (ASCII grids, GeoTIFF) and WKB.

The data sources ``gpkg`` and ``asciigrid`` open a path that all executors share; GeoTIFF files come through Spark's own
reader, from wherever that can read."""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType

RING = "array<struct<x: double, y: double>>"


def rings(wkb: bytes) -> list[tuple[int, int, bool, list[dict]]]:
    """(part, ring, is_hole, points) of a WKB point, line, polygon or a collection of them."""
    out: list[tuple[int, int, bool, list[dict]]] = []

    def points(at: int, n: int, order: str, dims: int):
        flat = struct.unpack_from(f"{order}{n * dims}d", wkb, at)
        return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, n * dims, dims)], at + 8 * n * dims

    def geometry(at: int) -> int:
        order = "<" if wkb[at] else ">"
        (kind,) = struct.unpack_from(order + "I", wkb, at + 1)
        dims = 2 + bool(kind & 0x80000000) + bool(kind & 0x40000000) + {0: 0, 1: 1, 2: 1, 3: 2}[kind % 0x10000000 // 1000]
        at, kind = at + 5 + 4 * bool(kind & 0x20000000), kind % 0x10000000 % 1000
        part = 1 + max((p for p, *_ in out), default=-1)
        if kind == 1:
            pts, at = points(at, 1, order, dims)
            out.append((part, 0, False, pts))
            return at
        (n,) = struct.unpack_from(order + "I", wkb, at)
        at += 4
        if kind == 2:
            pts, at = points(at, n, order, dims)
            out.append((part, 0, False, pts))
        elif kind == 3:
            for k in range(n):
                (m,) = struct.unpack_from(order + "I", wkb, at)
                pts, at = points(at + 4, m, order, dims)
                out.append((part, k, k > 0, pts))
        elif kind in (4, 5, 6, 7):
            for _ in range(n):
                at = geometry(at)
        else:
            raise ValueError(f"geometry type {kind} is not read")
        return at

    if wkb:
        geometry(0)
    return out


def gpkg_body(blob: bytes) -> bytes:
    """The WKB after a GeoPackage header."""
    if blob[:2] != b"GP":
        raise ValueError("not a GeoPackage geometry")
    return blob[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[blob[3] >> 1 & 7] :]


class _Rows(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class GeoPackage(DataSource):
    """Format ``gpkg``: options path, table (the first layer if not given), rows (features in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return f"fid long, attributes map<string, string>, part int, ring int, is_hole boolean, pts {RING}"

    def reader(self, schema) -> DataSourceReader:
        return _GeoPackageReader(dict(self.options))


def _layer(con: sqlite3.Connection, table: str | None) -> tuple[str, str]:
    """(table, geometry column) of a layer; the first if none is named."""
    where, args = ("WHERE table_name = ?", (table,)) if table else ("", ())
    return con.execute(f"SELECT table_name, column_name FROM gpkg_geometry_columns {where} ORDER BY 1", args).fetchone()


def _ring_batches(cur: sqlite3.Cursor, column: str, size: int = 500) -> Iterator[pa.RecordBatch]:
    """The rings of a layer's features (the cursor's first column is the key), some hundred at a time."""
    names = [c[0] for c in cur.description]
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    kinds = {"fid": pa.int64(), "attributes": pa.map_(pa.string(), pa.string()), "part": pa.int32(), "ring": pa.int32(), "is_hole": pa.bool_(), "pts": pa.list_(point)}
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

    for row in cur:
        named = dict(zip(names[1:], row[1:]))
        blob = named.pop(column)
        told = [(n, None if v is None else str(v)) for n, v in named.items()]
        rows += [(row[0], told, p, k, hole, pts) for p, k, hole, pts in (rings(gpkg_body(blob)) if blob else [])]
        if len(rows) >= size:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


class _GeoPackageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table, self.rows = options["path"].removeprefix("file://"), options.get("table"), int(options.get("rows", 10_000))

    def _open(self) -> tuple[sqlite3.Connection, str, str]:
        con = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        return con, *_layer(con, self.table)

    def partitions(self) -> list[InputPartition]:
        con, table, _ = self._open()
        lo, hi = con.execute(f'SELECT min(rowid), max(rowid) FROM "{table}"').fetchone()
        con.close()
        return [_Rows(a, a + self.rows) for a in range(lo, hi + 1, self.rows)] if lo is not None else [_Rows(0, 0)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        con, table, column = self._open()
        yield from _ring_batches(con.execute(f'SELECT rowid AS _id, * FROM "{table}" WHERE rowid >= ? AND rowid < ?', (part.lo, part.hi)), column)
        con.close()


class AsciiGrid(DataSource):
    """Format ``asciigrid``: pixel centres (lon, lat, value) of an ESRI ASCII grid; options path, rows (in a partition)."""

    @classmethod
    def name(cls) -> str:
        return "asciigrid"

    def schema(self) -> str:
        return "lon double, lat double, value double"

    def reader(self, schema) -> DataSourceReader:
        return _AsciiGridReader(dict(self.options))


class _Lines(InputPartition):
    def __init__(self, at: int, lo: int, hi: int):
        self.at, self.lo, self.hi = at, lo, hi


class _AsciiGridReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rows", 500))

    def _head(self, f) -> dict[str, float]:
        head = {}
        while True:
            at = f.tell()
            parts = f.readline().split()
            if len(parts) != 2 or not parts[0][:1].isalpha():
                f.seek(at)
                return head
            head[parts[0].decode().lower()] = float(parts[1])

    def partitions(self) -> list[InputPartition]:
        """Ranges of lines with the byte at which each begins: the file is read through once here, and by part elsewhere."""
        out = []
        with open(self.path, "rb") as f:
            n = int(self._head(f)["nrows"])
            for k in range(n):
                if k % self.rows == 0:
                    out.append(_Lines(f.tell(), k, min(n, k + self.rows)))
                f.readline()
        return out

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            h = self._head(f)
            size, nodata = h["cellsize"], h.get("nodata_value")
            x0 = h["xllcorner"] + size / 2 if "xllcorner" in h else h["xllcenter"]
            y0 = h["yllcorner"] + size / 2 if "yllcorner" in h else h["yllcenter"]
            f.seek(part.at)
            for k in range(part.lo, part.hi):
                v = np.array(f.readline().split(), float)
                x = x0 + np.arange(len(v)) * size
                keep = v != nodata
                yield _pixels(x[keep], np.full(int(keep.sum()), y0 + (h["nrows"] - 1 - k) * size), v[keep])


def _pixels(lon: np.ndarray, lat: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(lon.astype(float)), pa.array(lat.astype(float)), pa.array(value.astype(float))], ["lon", "lat", "value"])


# ------------------------------------------------------------------ GeoTIFF
_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def _tags(raw: bytes) -> tuple[str, dict[int, tuple]]:
    """(byte order, tags of the first image) of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}[raw[:2]]
    big = struct.unpack_from(order + "H", raw, 2)[0] == 43
    at = struct.unpack_from(order + ("Q" if big else "I"), raw, 8 if big else 4)[0]
    n = struct.unpack_from(order + ("Q" if big else "H"), raw, at)[0]
    at, step, word = at + (8 if big else 2), 20 if big else 12, "Q" if big else "I"
    out = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(order + "HH" + word, raw, at + k * step)
        if kind not in _KINDS:
            continue
        form = _KINDS[kind] * count if kind != 2 else f"{count}s"
        where = at + k * step + 4 + struct.calcsize("=" + word)
        if struct.calcsize("=" + form) > struct.calcsize("=" + word):
            where = struct.unpack_from(order + word, raw, where)[0]
        out[tag] = struct.unpack_from(order + form, raw, where)
    return order, out


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant first; 256 clears the table, 257 ends."""
    out, table, width, bits, have, last = bytearray(), [], 9, 0, 0, b""
    for byte in raw:
        bits, have = bits << 8 | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


def tiff_blocks(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(lon, lat, value) of the first band, one strip or tile after the other; pixels without data are left out."""
    order, tag = _tags(raw)
    width, height = tag[256][0], tag[257][0]
    bands, planar = tag.get(277, (1,))[0], tag.get(284, (1,))[0]
    depth, form, method, predictor = tag[258][0], tag.get(339, (1,))[0], tag.get(259, (1,))[0], tag.get(317, (1,))[0]
    kind = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{depth // 8}")
    unpack = {1: lambda b: b, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress}.get(method)
    if unpack is None or predictor not in (1, 2, 3) or 33550 not in tag or 33922 not in tag:
        raise ValueError(f"compression {method}, predictor {predictor}, or a raster that is not north-up, is not read")
    (dx, dy), (pi, pj, _, px, py) = tag[33550][:2], tag[33922][:5]
    nodata = float(tag[42113][0].rstrip(b"\0 ")) if 42113 in tag else None
    tiled = 322 in tag
    bw, bh = (tag[322][0], tag[323][0]) if tiled else (width, tag.get(278, (height,))[0])
    offsets, counts = (tag[324], tag[325]) if tiled else (tag[273], tag[279])
    across = -(-width // bw)
    each = bands if planar == 1 else 1
    for k in range(across * -(-height // bh)):
        y, x = k // across * bh, k % across * bw
        rows = bh if tiled else min(bh, height - y)
        flat = unpack(raw[offsets[k] : offsets[k] + counts[k]])
        if predictor == 3:  # bytes of equal weight lie together, each as a difference from the one before
            line = np.frombuffer(flat, np.uint8)[: rows * bw * each * kind.itemsize].reshape(rows, -1, each)
            line = np.cumsum(line, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, bw * each)
            v = np.ascontiguousarray(line.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, bw, each)
        else:
            v = np.frombuffer(flat, kind, rows * bw * each).reshape(rows, bw, each)
            if predictor == 2:
                v = np.cumsum(v, axis=1, dtype=kind.newbyteorder("="))
        v = v[: height - y, : width - x, 0].astype(float)
        keep = ~np.isnan(v) if nodata is None else ~np.isnan(v) & (v != nodata)
        j, i = np.nonzero(keep)
        yield px + (x + i + 0.5 - pi) * dx, py - (y + j + 0.5 - pj) * dy, v[keep]


def read_geotiff(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, value): the pixel centres of GeoTIFF files, a file for each task, its strips or tiles one after the other."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                for lon, lat, value in tiff_blocks(raw.as_py()):
                    yield _pixels(lon, lat, value)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, "lon double, lat double, value double")


# ------------------------------------------------------------------ WKB
def wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    """A polygon, or several as a multipolygon, of closed rings: the first of each is its outer one."""
    one = [struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack(f"<I{2 * len(r)}d", len(r), *(v for p in r for v in p)) for r in rings) for rings in parts]
    return one[0] if len(one) == 1 else struct.pack("<BII", 1, 6, len(one)) + b"".join(one)


_BOX_HEAD = struct.pack("<BIII", 1, 3, 1, 5)


@F.pandas_udf(BinaryType())
def box_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    """Boxes as WKB polygons of five points."""
    xy = np.stack([x0, y0, x1, y0, x1, y1, x0, y1, x0, y0], axis=1).astype("<f8")
    return pd.Series([_BOX_HEAD + row.tobytes() for row in xy])


@F.pandas_udf(BinaryType())
def parts_wkb(parts: pd.Series) -> pd.Series:
    """Polygons of rings of numbers (x, y, x, y, ...) as WKB, rings closed."""
    closed = lambda ring: list(zip((*ring[0::2], ring[0]), (*ring[1::2], ring[1])))
    return pd.Series([wkb([[closed(r) for r in part] for part in g]) if g is not None and len(g) else None for g in parts])


def with_wkb(cells: DataFrame, size: float = 1000.0) -> DataFrame:
    """Cells with ``geometry`` as WKB: what a border leaves of them where there are ``parts`` (``overlay.cut_cells``), else their square."""
    if "parts" in cells.columns:
        flat = F.transform("parts", lambda part: F.transform(part, lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"])))))
        return cells.withColumn("geometry", parts_wkb(flat))
    s = F.lit(float(size))
    return cells.withColumn("geometry", box_wkb(F.col("ix") * s, F.col("iy") * s, (F.col("ix") + 1) * s, (F.col("iy") + 1) * s))


def read_layer(spark: SparkSession, path: str, table: str | None = None, region: str | None = None) -> DataFrame:
    """A GeoPackage layer as rings (region, part, ring, is_hole, pts): the region is an attribute, or else the feature.

    The file comes through Spark's reader, from wherever that can read; large layers on a shared path are read in parts by
    the format ``gpkg``.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0):
                data = bytearray(raw.as_py())
                data[18:20] = b"\x01\x01"  # without a write-ahead log
                con = sqlite3.connect(":memory:")
                con.deserialize(bytes(data))
                name, column = _layer(con, table)
                yield from _ring_batches(con.execute(f'SELECT rowid AS _id, * FROM "{name}"'), column)
                con.close()

    df = spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, f"fid long, attributes map<string, string>, part int, ring int, is_hole boolean, pts {RING}")
    return df.withColumn("region", F.col("attributes")[region] if region else F.col("fid").cast("string")).select("region", "part", "ring", "is_hole", "pts")


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, value) of a raster: GeoTIFF by the name's end, else an ASCII grid."""
    if path.lower().endswith((".tif", ".tiff")):
        return read_geotiff(spark, path)
    spark.dataSource.register(AsciiGrid)
    return spark.read.format("asciigrid").option("path", path).load()
