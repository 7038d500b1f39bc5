"""Media columns: texts as 8-bit grey images in archives, and a Spark data source over the archives.

An archive directory holds shards (plain ustar files), for each shard an Arrow file with the members'
offsets, and one manifest for each committed write; shards of failed attempts are in no manifest and
are never read. The source plans partitions as byte ranges of shards, an executor reads the members
that begin in its range, yields them as Arrow batches of bounded size, and retries each member alone,
by its offset.

An image is 192 samples wide; the payload is the text's UTF-8 with spaces up to a positive multiple of
192, stored as an 8-bit grey PNG without row filters.

Defined cases: a null text counts as empty (192 spaces); repeated rows and ids are kept; a null id
stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from zonalis.llm import common

WIDTH = 192
SHARD_BYTES, SPLIT_BYTES, BATCH_BYTES, RETRIES = 64 << 20, 16 << 20, 4 << 20, 3
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


# ------------------------------------------------------------------ images
def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    n = max(1, -(-len(data) // WIDTH)) * WIDTH
    return data.ljust(n, b" ")


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG whose samples are the payload, row by row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """Samples (height, width) of an unfiltered 8-bit grey PNG; checks every chunk's sum."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            w, h, depth, colour, *rest = struct.unpack(">IIBBBBB", body)
            if (depth, colour, rest[2]) != (8, 0, 0):
                raise ValueError("not an 8-bit grey image")
            shape = (h, w)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[0], shape[1] + 1)
    if rows[:, 0].any():
        raise ValueError("row filters are not used here")
    return rows[:, 1:]


def feature(image: np.ndarray) -> str:
    """Difference hash over 8 bands of rows and 9 of columns (16 hex digits), mean and spread of the samples."""
    h, w = image.shape
    sums = np.concatenate([[0], np.cumsum(image.sum(axis=1, dtype=np.int64))])
    cols = np.array([j * w // 9 for j in range(9)])
    by_col = np.add.reduceat(image, cols, axis=1, dtype=np.int64) / np.diff(np.append(cols, w))
    lo = np.arange(8) * h // 8
    hi = np.maximum(lo + 1, (np.arange(8) + 1) * h // 8)
    run = np.concatenate([np.zeros((1, 9)), np.cumsum(by_col, axis=0)])
    band = (run[hi] - run[lo]) / (hi - lo)[:, None]
    bits = (band[:, 1:] > band[:, :-1] + 1e-9).ravel()
    mean = sums[-1] / image.size
    spread = float(np.sqrt(max(0.0, np.square(image, dtype=np.float64).mean() - mean * mean)))
    return f"{int.from_bytes(np.packbits(bits).tobytes(), 'big'):016x}:{mean:.3f}:{spread:.3f}"


# ------------------------------------------------------------------ archives
def _fs(path: str):
    fs, base = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if not path.startswith("file:") else "file://" + path[5:])
    return fs, base.rstrip("/")


def _tar_header(name: str, size: int) -> bytes:
    head = bytearray(512)
    head[0 : len(name)] = name.encode()
    head[100:108], head[108:116], head[116:124] = b"0000644\0", b"0000000\0", b"0000000\0"
    head[124:136] = f"{size:011o}\0".encode() if size < 8**11 else b"\x80" + size.to_bytes(11, "big")
    head[136:148], head[148:156], head[156:157] = b"00000000000\0", b" " * 8, b"0"
    head[257:265] = b"ustar\x0000"
    head[148:156] = f"{sum(head):06o}\0 ".encode()
    return bytes(head)


class _Commit(WriterCommitMessage):
    def __init__(self, shards: list):
        self.shards = shards


class ArchiveWriter(DataSourceArrowWriter):
    """Writes rows (id, n_bytes, media) as shards of about ``shard_bytes``."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.shard_bytes = int(options.get("shard_bytes", SHARD_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Commit:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        shards, out, at, rows, name = [], None, 0, [], ""

        def close():
            nonlocal out, at, rows
            if out is None:
                return
            out.write(b"\0" * 1024)
            out.close()
            cols = list(zip(*rows))
            t = pa.table({k: pa.array(list(c), pa.int64()) for k, c in zip(("id", "n_bytes", "offset", "size"), cols)})
            with fs.open_output_stream(f"{base}/{name}.idx") as f, pa.ipc.new_file(f, t.schema) as w:
                w.write_table(t)
            shards.append([name, at])
            out, at, rows = None, 0, []

        for batch in iterator:
            ids, sizes, media = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, n, m in zip(ids, sizes, media):
                m = m.as_py()
                if out is None:
                    name = f"shard-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{base}/{name}.tar")
                out.write(_tar_header(f"{len(rows):09d}.png", len(m)))
                rows.append((i, n, at + 512, len(m)))
                out.write(m)
                out.write(b"\0" * (-len(m) % 512))
                at += 512 + len(m) + -len(m) % 512
                if at >= self.shard_bytes:
                    close()
        close()
        return _Commit(shards)

    def commit(self, messages: list) -> None:
        fs, base = _fs(self.path)
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for info in fs.get_file_info(pafs.FileSelector(base)):
                if info.base_name.startswith("manifest-"):
                    fs.delete_file(info.path)
        with fs.open_output_stream(f"{base}/manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([s for m in messages if m is not None for s in m.shards]).encode())

    def abort(self, messages: list) -> None:
        fs, base = _fs(self.path)
        for m in messages:
            for name, _ in m.shards if m is not None else []:
                for end in ("tar", "idx"):
                    fs.delete_file(f"{base}/{name}.{end}")


class _Range(InputPartition):
    def __init__(self, shard: str, lo: int, hi: int):
        self.shard, self.lo, self.hi = shard, lo, hi


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[_Range]:
        fs, base = _fs(self.path)
        found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        out = []
        for info in sorted(found, key=lambda x: x.path):
            if info.base_name.startswith("manifest-"):
                with fs.open_input_stream(info.path) as f:
                    for name, size in json.loads(f.readall()):
                        out += [_Range(name, lo, min(size, lo + self.split)) for lo in range(0, size, self.split)]
        return out

    def member(self, fs, path: str, offset: int, size: int) -> bytes:
        """One member's bytes; opened and read anew, by offset, as often as ``retries`` says."""
        for attempt in range(self.retries + 1):
            try:
                with fs.open_input_file(path) as f:
                    data = f.read_at(size, offset)
                if len(data) != size:
                    raise OSError(f"{path}: {len(data)} of {size} bytes at {offset}")
                return data
            except OSError:
                if attempt == self.retries:
                    raise
                time.sleep(0.1 * 2**attempt)
        raise AssertionError

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # an archive without shards
            return
        fs, base = _fs(self.path)
        path = f"{base}/{part.shard}.tar"
        with fs.open_input_file(f"{base}/{part.shard}.idx") as f:
            index = pa.ipc.open_file(f).read_all()
        at = index["offset"].to_numpy()
        lo, hi = np.searchsorted(at - 512, [part.lo, part.hi])
        index = index.slice(lo, hi - lo)
        schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        rows, held = [], 0
        source = None
        for i, n, offset, size in zip(*(index[k].to_pylist() for k in ("id", "n_bytes", "offset", "size"))):
            try:
                source = source or fs.open_input_file(path)
                data = source.read_at(size, offset)
                if len(data) != size:
                    raise OSError("short read")
            except OSError:
                source, data = None, self.member(fs, path, offset, size)
            rows.append((i, n, data))
            held += size
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


class MediaArchive(DataSource):
    """Format ``media_archive``: option ``path``; ``shard_bytes`` to write, ``split_bytes`` and ``retries`` to read."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "id long, n_bytes long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options), overwrite)


# ------------------------------------------------------------------ DataFrames
def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            sizes, media = [], []
            for t in b.column(1):
                data = (t.as_py() or "").encode()
                sizes.append(len(data))
                media.append(to_png(pad(data)))
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256
    for b in batches:
        out: list[list] = [[] for _ in range(6)]
        for m in b.column(2):
            m = m.as_py()
            image = from_png(m)
            payload = image.tobytes()
            for column, v in zip(out, (len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), sha(m).hexdigest(), feature(image))):
                column.append(v)
        n, s = pa.int64(), pa.string()
        yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(out, (n, s, n, n, s, s)))], ["i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def write_archive(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Store every text as an image in the archive directory ``path``."""
    common.ship(docs.sparkSession)
    docs.sparkSession.dataSource.register(MediaArchive)
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    one.mapInArrow(_encode, "id long, n_bytes long, media binary").write.format("media_archive").option("shard_bytes", shard_bytes).mode("append").save(path)


def read_archive(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(id, n_bytes, media): the members of all committed shards."""
    common.ship(spark)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("split_bytes", split_bytes).load(path)


def media_columns(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the archive, read it back and compute the features of each member."""
    write_archive(docs, path, id_col, text_col)
    out = read_archive(docs.sparkSession, path).mapInArrow(_features, "i long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("i", id_col)


def op10_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(common.table(spark, sf_dir, "documents"), common.scratch(spark))
