"""Benchmark decontamination by greedy string tiling.

Words are ASCII-lower-cased ``[^\\x20\\x09-\\x0D]+``. Every run of ``least`` words of the benchmark is a seed;
documents are joined with the seeds as they are read, against an index of at most ``block_bytes`` of
benchmark text (a larger benchmark goes in several blocks, one after the other, each against all documents). Where the seeds
that a document shares with an item could cover ``threshold`` of the item, tiles are laid: running
Karp-Rabin finds matches of at least the search length, the longest are marked first, none overlap, and
the search length falls to ``least``. An item is contaminated where its tiles cover ``threshold`` of it, in
any order of passages.

Defined cases: null or empty texts, and items of fewer than ``least`` words, match nothing; repeated item
rows count once; repeated document rows each have their own result; null ids stay null; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

LEAST, THRESHOLD, BLOCK_BYTES = 5, 0.8, 32 << 20
_MOD, _RADIX = (1 << 61) - 1, 911382323
SCHEMA = "d long, item_id long, n_words long, n_tiles long, n_covered long, coverage double"


class _Side:
    """One of two sequences: its symbols, which of them are not marked yet, and Karp-Rabin hashes of its prefixes."""

    def __init__(self, x: Sequence[int], power: list[int]):
        self.x, self.free, self.power = x, bytearray(v >= 0 for v in x), power
        self.prefix = [0]
        h = 0
        for v in x:
            h = (h * _RADIX + v + 1) % _MOD
            self.prefix.append(h)

    def hash(self, i: int, s: int) -> int:
        return (self.prefix[i + s] - self.prefix[i] * self.power[s]) % _MOD

    def end(self, i: int, byte: int = 0) -> int:
        """The next marked place (or, with 1, the next free one) from i on."""
        at = self.free.find(byte, i)
        return at if at >= 0 else len(self.x)

    def runs(self, s: int) -> Iterator[tuple[int, int | None, int]]:
        """(position, unmarked symbol before it, hash) of each unmarked run of s symbols."""
        lo = self.end(0, 1)
        while lo < len(self.x):
            hi = self.end(lo)
            top, prefix, before = self.power[s] if s < len(self.power) else 0, self.prefix, None
            for i in range(lo, hi - s + 1):
                yield i, before, (prefix[i + s] - prefix[i] * top) % _MOD
                before = self.x[i]
            lo = self.end(hi, 1)


def _common(a: _Side, b: _Side, q: int, p: int, least: int) -> int:
    """Length of the unmarked match from q and p, which is ``least`` at least: by halving, over hashes."""
    low, high = least, min(a.end(q) - q, b.end(p) - p)
    if a.hash(q, high) == b.hash(p, high):
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a.hash(q, mid) == b.hash(p, mid):
            low = mid
        else:
            high = mid
    return low


def tiles(a: Sequence[int], b: Sequence[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of a by b: (position in a, position in b, length), by running Karp-Rabin.

    Only matches that no equal pair of symbols goes before are met, so that repeated words do not meet each with each; runs
    of symbols are equal where their 61-bit hashes are.
    """
    power = [1]
    for _ in range(max(len(a), len(b))):
        power.append(power[-1] * _RADIX % _MOD)
    x, y = _Side(a, power), _Side(b, power)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(20, len(a)))
    while True:
        table: dict[int, dict[int | None, list[int]]] = {}
        for p, before, h in y.runs(s):
            table.setdefault(h, {}).setdefault(before, []).append(p)
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        longest = 0
        for q, before, h in x.runs(s):
            for other, places in table.get(h, {}).items():
                if other is not None and other == before:
                    continue  # parts of matches that begin one earlier
                for p in places:
                    k = _common(x, y, q, p, s)
                    found[k].append((q, p))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        k = longest
        while k >= s:
            for q, p in sorted(found.pop(k, ())):
                i = 0
                while i < k:  # the parts of it that are still free
                    i = max(x.end(q + i, 1) - q, y.end(p + i, 1) - p)
                    if not (i < k and x.free[q + i] and y.free[p + i]):
                        continue
                    n = min(x.end(q + i) - q, y.end(p + i) - p, k) - i
                    if n == k:
                        out.append((q, p, k))
                        x.free[q : q + k] = y.free[p : p + k] = bytes(k)
                    elif n >= s:
                        found[n].append((q + i, p + i))
                    i += n
            k = max((n for n in found if n <= k and found[n]), default=0)
        if s == least:
            return sorted(out)
        s = max(least, s // 2)


class Index:
    """Seeds of a block of benchmark items."""

    def __init__(self, items: list[tuple[int | None, str]], least: int):
        self.least, self.ids = least, [i for i, _ in items]
        off, raw = common.buffers(pa.array([t for _, t in items], pa.large_string()))
        _, _, sym, first = common.words(off, raw, fold=True)
        self.sym = [sym[first[k] : first[k + 1]] for k in range(len(items))]
        seed, item, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, s in enumerate(self.sym):
            h = common.rolling(s, least, 5)
            seed.append(h)
            item.append(np.full(len(h), k))
            pos.append(np.arange(len(h)))
        seed, self.item, self.pos = (np.concatenate(x) for x in (seed, item, pos))
        order = np.argsort(seed, kind="stable")
        self.item, self.pos = self.item[order], self.pos[order]
        self.seed, at = np.unique(seed[order], return_index=True)
        self.at = np.append(at, len(order))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.seed))))) + 5)
        self.door = np.zeros(1 << self.bits, bool)
        self.door[self.seed >> np.uint64(64 - self.bits)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in h, index of the seed) of those that are seeds."""
        if not len(self.seed):
            z = np.zeros(0, np.int64)
            return z, z
        at = np.flatnonzero(self.door[h >> np.uint64(64 - self.bits)])
        k = np.searchsorted(self.seed, h[at])
        ok = (k < len(self.seed)) & (self.seed[np.minimum(k, len(self.seed) - 1)] == h[at])
        return at[ok], k[ok]


def _match(doc: np.ndarray, p: np.ndarray, k: np.ndarray, ix: Index, threshold: float) -> Iterator[tuple]:
    """Rows of one document: symbols, and where (p) it has which seeds (k).

    A seed counts once for an item's bound, however often the document or the item has it.
    """
    seed, which = np.unique(k, return_inverse=True)
    size = ix.at[seed + 1] - ix.at[seed]
    at = np.repeat(ix.at[seed] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    item, pos, of = ix.item[at], ix.pos[at], np.repeat(np.arange(len(seed)), size)
    order = np.lexsort((pos, item))
    item, pos, of = item[order], pos[order], of[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    last = np.append(first[1:], len(item)) - 1
    step = np.append(np.diff(pos), ix.least)
    step[last] = ix.least
    bound = np.add.reduceat(np.minimum(step, ix.least), first)
    done: dict[bytes, tuple | None] = {}
    for f, l, n in zip(first.tolist(), last.tolist(), bound.tolist()):
        a = ix.sym[item[f]]
        need = threshold * len(a) - 1e-9
        if n < need:
            continue
        key = a.tobytes()  # items with equal words have equal tiles
        if key not in done:
            mine = np.zeros(len(seed), bool)
            mine[of[f : l + 1]] = True
            done[key] = _tiled(a, doc, np.unique(p[mine[which]]), ix.least, need)
        if done[key]:
            yield int(item[f]), *done[key]


def _tiled(a: np.ndarray, doc: np.ndarray, starts: np.ndarray, least: int, need: float) -> tuple | None:
    """(words, tiles, words in tiles, coverage) of an item by the parts of a document from which seeds start."""
    cut = np.flatnonzero(np.diff(starts) > least) + 1
    part: list[int] = []
    copies: dict[bytes, int] = defaultdict(int)
    for lo, hi in zip(np.append(0, cut).tolist(), np.append(cut, len(starts)).tolist()):
        stretch = doc[starts[lo] : starts[hi - 1] + least]
        key = stretch.tobytes()
        copies[key] += 1
        if copies[key] <= len(a) // least:  # no tiling has use for more
            part += [*([-1] if part else []), *stretch.tolist()]
    got = tiles([int(v) for v in a], part, least)
    n = sum(t[2] for t in got)
    return (len(a), len(got), n, n / len(a)) if n >= need else None


def _scan(batches: Iterator[pa.RecordBatch], ix: Index, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            off, raw = common.buffers(b.column(1))
            _, _, sym, first = common.words(off, raw, fold=True)
            at, k = ix.hits(common.rolling(sym, ix.least, 5))
            row = np.searchsorted(first, at, side="right") - 1
            inside = at + ix.least <= first[row + 1] if len(at) else np.zeros(0, bool)
            at, k, row = at[inside], k[inside], row[inside]
            ids = b.column(0)
            out: list[tuple] = []
            for r in np.unique(row):
                mine = slice(*np.searchsorted(row, [r, r + 1]))
                lo = first[r]
                for item, *rest in _match(sym[lo : first[r + 1]], at[mine] - lo, k[mine], ix, threshold):
                    out.append((ids[int(r)].as_py(), ix.ids[item], *rest))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64()] * 5 + [pa.float64()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds)], ["d", "item_id", "n_words", "n_tiles", "n_covered", "coverage"])


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, block_bytes: int):
    """(list of (item, text) as a broadcast of about ``block_bytes``, whether another one comes)."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null").distinct()
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    for n in range(blocks):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == n).collect()
        part = sorted(((r.i, r.t) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        yield benchmark.sparkSession.sparkContext.broadcast(part), n + 1 < blocks


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, item_id, n_words, n_tiles, n_covered, coverage): documents and the items they give away."""
    common.ship(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    out = None
    for shared, more in _blocks(benchmark, item_col, item_text, block_bytes):

        def scan(it, shared=shared):
            return _scan(it, Index(shared.value, least), threshold)

        found = one.mapInArrow(scan, SCHEMA)
        if more:  # one block at a time is in memory
            found = common.materialize(found)
            shared.destroy()
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("d", id_col)


@common.trimmed
def _clean(batches: Iterator[pa.RecordBatch], column: int, ix: Index, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, whole.schema.names[column]):
            plain = pa.record_batch([pa.array(range(b.num_rows), pa.int64()), b.column(column)], ["d", "t"])
            keep = np.ones(b.num_rows, bool)
            for got in _scan(iter([plain]), ix, threshold):
                keep[np.asarray(got.column(0))] = False
            yield b.filter(pa.array(keep))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All columns of the rows that give no item of the benchmark away."""
    common.ship(docs.sparkSession)
    at, out = docs.columns.index(text_col), docs
    for shared, more in _blocks(benchmark, item_col, item_text, block_bytes):

        def scan(it, shared=shared):
            return _clean(it, at, Index(shared.value, least), threshold)

        out = out.mapInArrow(scan, docs.schema)
        if more:
            out = common.materialize(out)
            shared.destroy()
    return out


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
