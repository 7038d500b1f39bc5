"""What the training-data operators share: tables, shared scratch space, a vectorised word
reader, and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: dict[str, str] = {}
_local: dict[str, str] = {}
_written: set[str] = set()
_LIMIT, _BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and let Arrow batches hold ``_BATCH`` bytes, so
    that rows with long texts do not fill a worker's memory (a limit that the user has set stays)."""
    if spark.conf.get(_LIMIT) == "67108864b":
        spark.conf.set(_LIMIT, str(_BATCH))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="zonalis-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "zonalis_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(target)
    _shipped[app] = target


def scratch(spark: SparkSession) -> str:
    """A new folder that the driver and all executors share: below ``spark.checkpoint.dir``, or, where that is
    unset and the session is a local one (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and the executors share")
        base = _local.get(spark.sparkContext.applicationId)
        if not base:
            folder = tempfile.mkdtemp(prefix="zonalis-shared-")
            atexit.register(shutil.rmtree, folder, True)
            base = _local[spark.sparkContext.applicationId] = f"file://{folder}"
    return f"{base.rstrip('/')}/zonalis/{uuid.uuid4().hex}"


#: Spark deletes a write's shuffle files at its end.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, survives lost executors.

    The plan's shuffle files go as soon as the table is there. They would be made anew if another action ran
    the same plan, so ``df`` is not for further use.
    """
    spark = df.sparkSession
    path = scratch(spark)
    _written.add(path.rpartition("/")[2])
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote here and that nothing reads any more; others stay."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            name = folder.rpartition("/")[2]
            if name in _written:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
                _written.discard(name)


def trimmed(work: Callable) -> Callable:
    """A generator over batches that gives free memory back when it ends: Python workers live on into the next stages."""

    @functools.wraps(work)
    def run(*args, **options):
        try:
            yield from work(*args, **options)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


# --------------------------------------------------------------------------- words
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MAX_POW = 4096
_POW = np.cumprod(np.full(_MAX_POW, _BASE, np.uint64), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def words(off: np.ndarray, raw: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts at once: (start, end, 64-bit symbol, first word of each text).

    A symbol is a polynomial hash of the word's bytes; equal words have equal symbols.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    ink = ~_SPACE[raw]
    edge = np.empty(n + 1, bool)
    edge[0], edge[n] = ink[0], ink[-1]
    np.not_equal(ink[1:], ink[:-1], out=edge[1:n])
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    cut = cut[ink[cut] & ink[cut - 1]]  # two texts meet without a space
    begin = np.zeros(n + 1, bool)
    begin[:n] = edge[:n] & ink
    begin[cut] = True
    start = np.flatnonzero(begin)
    stop = edge
    stop[:n] &= ~ink
    stop[cut] = True
    end = np.flatnonzero(stop)
    sym = np.empty(len(start), np.uint64)
    step = 1 << 16
    for a in range(0, len(start), step):
        s, e = start[a : a + step], end[a : a + step]
        lens = e - s
        lo, hi = s[0], e[-1]
        part = raw[lo:hi]
        if fold:
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        heads = s - lo
        pos = np.arange(hi - lo) - np.repeat(heads, np.diff(np.append(heads, hi - lo)))
        big = lens.max() > _MAX_POW
        val = _BYTE[part] * (_POW[pos % _MAX_POW] + (pos // _MAX_POW).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) if big else _POW[np.minimum(pos, _MAX_POW - 1)])
        val[~ink[lo:hi]] = 0
        sym[a : a + step] = mix64(np.add.reduceat(val, heads) + lens.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    return start, end, sym, np.searchsorted(start, off)


def rolling(sym: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``width`` symbols (runs may cross texts; the caller masks those)."""
    n = len(sym) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    coef = np.random.default_rng(7919 + salt).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += sym[j : j + n] * coef[j]
    return mix64(h)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Parts of a batch with about ``limit`` bytes of text each (a longer text is a part of its own)."""
    col = batch.column(batch.schema.get_field_index(column))
    off, _ = buffers(col)
    at, n = 0, len(col)
    while at < n:
        to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield batch.slice(at, to - at)
        at = to


# --------------------------------------------------------------------------- graphs
SALTS = 16


def salted(many: DataFrame, one: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """Join on a key that ``one`` has once and ``many`` may have in a third of its rows: those are dealt to ``SALTS`` tasks by a
    hash of the column ``spread``, and ``one`` is repeated for each. Both sides are shuffled at every size: neither has a bound."""
    left = many.withColumn("_s", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = one.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right.hint("merge"), [key, "_s"], how).drop("_s")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of an undirected graph (a, b): root is the least node that can be reached.

    Alternates large-star and small-star steps; each round is a written table. Degrees are reduced
    by aggregation, never by gathering a node's neighbours.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    for _ in range(rounds):
        before = cur
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = salted(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted(large, low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        cur = materialize(small)
        discard(before)
        now = cur.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
