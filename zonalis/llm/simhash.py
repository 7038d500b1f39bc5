"""SimHash near-duplicates by bit-sliced comparison.

``near_duplicates`` links fingerprints within a few bits. Fingerprints are made in one pass over the texts. Equal
fingerprints are one node. Two nodes within ``radius`` bits agree on at least two of ``radius + 2`` blocks
of bits, so each node goes to one bucket for every two blocks; a bucket's fingerprints are compared by bit
planes. Buckets over ``cap`` are cut into parts and every two parts meet in a group of their own: no pair is
left out. A bucket sends on a spanning forest of its links, and connected components are found by star contraction.

``one_of_each`` links texts whose sets of ``WIDTH`` words have a Jaccard similarity of ``SIMILARITY`` or more. Such
fingerprints differ in up to a third of their bits, too many for buckets of equal blocks: nodes (equal sets) share a
bucket where ``ROWS`` least hashes of their runs agree, in one of ``BANDS`` ways. A bucket's ``BITS``-bit fingerprints
over sets are compared by the same bit planes, and only groups of nodes within ``WIDE_RADIUS`` bits have their whole sets
sent on; the similarity of those is counted exactly, so no link is a guess. A pair of similarity 0.8 shares no bucket with
a chance of (1 - 0.8^3)^18 = 2.5e-6; its fingerprints differ in 128 * acos(8/9) / pi = 19.4 bits with a deviation of 4.1
(24 and 4.4 for sets of four and five runs, the worst), so the radius of 44 misses less than 1e-5 of them.

Defined cases: a null or empty text has fingerprint 0 and links like any other; repeated rows and
repeated ids are kept; a null id is never a component's id unless all its ids are null; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from zonalis.llm import common

SHINGLE, SEED, RADIUS, CAP = 4, 42, 4, 2048
WIDTH, SIMILARITY, BANDS, ROWS, BITS, WIDE_RADIUS, CAP_RUNS = 5, (4, 5), 18, 3, 128, 44, 2_000_000


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """64-bit SimHash over shingles of ``width`` ASCII-lower-cased words, repeats included."""
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    join, h = b" ".join, xxhash.xxh64_intdigest
    if len(w) < width:
        return h(join(w), SEED)
    n = len(w) - width + 1
    count = np.zeros(64, np.int64)
    step = 8192
    for a in range(0, n, step):
        part = w[a : a + step + width - 1]
        got = np.fromiter([h(x, SEED) for x in map(join, zip(*(part[j:] for j in range(width))))], np.uint64)
        count += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0])


@common.trimmed
def _fingerprints(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        last: dict[str | None, int] = {}
        out = np.empty(b.num_rows, np.uint64)
        for i, t in enumerate(b.column(1)):
            t = t.as_py()
            f = last.get(t)
            if f is None:
                f = last[t] = fingerprint(t, width)
            out[i] = f
        yield pa.record_batch([b.column(0), pa.array(out.view(np.int64))], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """(id, fp): one row for each document; fp holds the 64 bits as a long."""
    common.ship(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return one.mapInArrow(lambda it: _fingerprints(it, width), "id long, fp long")


# ------------------------------------------------------------------ bit planes
def bits_of(x: np.ndarray) -> np.ndarray:
    """(n, bits) of fingerprints of one or more 64-bit words, shape (n,) or (n, words)."""
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")


def planes(x: np.ndarray) -> np.ndarray:
    """(bits, lanes / 64) bit planes of fingerprints: bit i of plane b is bit b of fingerprint i."""
    bits = bits_of(x)
    if pad := -len(x) % 64:
        bits = np.concatenate([bits, np.zeros((pad, bits.shape[1]), np.uint8)])
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def within(differ, shape: tuple, radius: int, bits: int = 64) -> np.ndarray:
    """Bits of the lanes whose distance is at most ``radius``; differ(b) has the lanes that differ in bit b.

    Carry-save counters hold all lanes' distances as bits; a lane past the radius is marked dead,
    and the block is given up when no lane is alive.
    """
    depth = (radius + 1).bit_length()
    acc = [np.zeros(shape, np.uint64) for _ in range(depth)]
    dead = np.zeros(shape, np.uint64)
    for b in range(bits):
        carry = differ(b)
        for k in range(depth):
            acc[k], carry = acc[k] ^ carry, acc[k] & carry
        dead |= carry
        if b % 4 == 3 and b >= radius:
            more = np.zeros(shape, np.uint64)
            equal = np.full(shape, ~np.uint64(0))
            for k in reversed(range(depth)):
                if radius >> k & 1:
                    equal &= acc[k]
                else:
                    more |= equal & acc[k]
                    equal &= ~acc[k]
            dead |= more
            if (~dead == 0).all():
                break
    return ~dead


def pairs_within(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For lists of pairs (a[i], b[i]): which are within the radius."""
    if not len(a):
        return np.zeros(0, bool)
    pa_, pb = planes(a), planes(b)
    got = within(lambda k: pa_[k] ^ pb[k], pa_.shape[1:], radius, len(pa_))
    return np.unpackbits(got.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def near(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, near[row - first, column]) for blocks of 64 rows of left: which of right are within the radius."""
    cand = planes(right)
    full = ~np.uint64(0)
    for a in range(0, len(left), 64):
        bits = bits_of(left[a : a + 64]).astype(np.uint64) * full
        got = within(lambda k: cand[k][None, :] ^ bits[:, k][:, None], (len(bits), cand.shape[1]), radius, len(cand))
        yield a, np.unpackbits(np.ascontiguousarray(got).view(np.uint8), axis=1, bitorder="little")[:, : len(right)]


def forest(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among left, or between left and right, as places in left + right."""
    base, other = (0, left) if right is None else (len(left), right)
    label = np.arange(base + len(other))
    ea: list[int] = []
    eb: list[int] = []
    for a, hits in near(left, other, radius):
        for i in range(len(hits)):
            to = np.flatnonzero(hits[i]) + base
            me = a + i
            to = to[label[to] != label[me]]
            if len(to):
                lab, first = np.unique(label[to], return_index=True)
                ea += [me] * len(first)
                eb += to[first].tolist()
                label[np.isin(label, np.append(lab, label[me]))] = min(lab[0], label[me])
    return np.array(ea, np.int64), np.array(eb, np.int64)


def linked(group: list[np.ndarray], part: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links in all groups of rows sorted by ``group`` (key..., i, j), as places of rows.

    In a group i = j all rows meet, in others those of part i meet those of part j.
    """
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in group], axis=0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    gi, gj = group[-2][first], group[-1][first]
    a_out, b_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = (size > 1) & (size <= 16) & (gi == gj)
    gid = np.repeat(np.where(small, np.arange(len(first)), -1), size)
    for s in range(1, int(size[small].max()) if small.any() else 1):
        at = np.flatnonzero((gid[s:] == gid[:-s]) & (gid[s:] >= 0))
        for p in range(0, len(at), 1 << 17):
            q = at[p : p + (1 << 17)]
            q = q[pairs_within(fp[q], fp[q + s], radius)]
            a_out.append(q)
            b_out.append(q + s)
    for g in np.flatnonzero((size > 1) & ~small):
        at = np.arange(first[g], first[g] + size[g])
        if gi[g] == gj[g]:
            x, (ia, ib) = at, forest(fp[at], None, radius)
        else:
            left, right = at[part[at] == gi[g]], at[part[at] == gj[g]]
            if not len(left) or not len(right):
                continue
            x, (ia, ib) = np.append(left, right), forest(fp[left], fp[right], radius)
        a_out.append(x[ia])
        b_out.append(x[ib])
    return np.concatenate(a_out), np.concatenate(b_out)


def whole_groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Batches sorted by ``names`` as tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [np.asarray(batch.column(x)) for x in names]
        last = [c[-1:] for c in cols]  # arrays: NumPy takes the last zeros off bytes that it compares on their own
        same = np.all([c == x for c, x in zip(cols, last)], axis=0)
        cut = 0 if same.all() else n - int(np.argmin(same[::-1]))
        if held and any(np.asarray(held[-1].column(x))[-1] != c[0] for x, c in zip(names, cols)):
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


@common.trimmed
def _bucket_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows (c, k, i, j, part, fp) sorted by group; links of each group."""
    group = ["c", "k", "i", "j"]
    for t in whole_groups(batches, group):
        fp = np.asarray(t["fp"]).view(np.uint64)
        a, b = linked([np.asarray(t[x]) for x in group], np.asarray(t["part"]), fp, radius)
        yield pa.record_batch([pa.array(fp[a].view(np.int64)), pa.array(fp[b].view(np.int64))], ["a", "b"])


def _dealt(rows: DataFrame, key: list[str], ident: str, weight, cap: int) -> DataFrame:
    """rows with (i, j, part): 0 in groups of a weight up to cap; others are cut into parts that meet in pairs."""
    hot = common.materialize(rows.groupBy(*key).agg(F.sum(weight).alias("w")).where(F.col("w") > cap).select(*key, F.ceil(F.col("w") / F.lit(cap)).cast("int").alias("parts")))
    both = rows.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    both = both.withColumn("part", F.pmod(F.xxhash64(ident), F.col("parts")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return both.withColumns({"i": F.least("part", "o"), "j": F.greatest("part", "o")}).drop("parts", "o")


def _meet(rows: DataFrame, group: list[str]) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *group).sortWithinPartitions(*group)


def links(nodes: DataFrame, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(a, b): links among distinct fingerprints ``nodes(fp)`` that connect all that are within the radius."""
    edges = [round(64 * i / (radius + 2)) for i in range(radius + 3)]
    blocks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(radius + 2)]
    masks = [x | y for x, y in combinations(blocks, 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = nodes.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("k")) for i, m in enumerate(signed)])).alias("b"),
    ).select("b.c", "b.k", "fp")
    dealt = _meet(_dealt(keyed, ["c", "k"], "fp", F.lit(1), cap).select("c", "k", "i", "j", "part", "fp"), ["c", "k", "i", "j"])
    return dealt.mapInArrow(lambda it: _bucket_links(it, radius), "a long, b long").distinct()


def _classes(fps: DataFrame, rep, radius: int, cap: int) -> DataFrame:
    """(fp, rep): the least rep of all rows whose fingerprints can be reached from fp."""
    nodes = common.materialize(fps.groupBy("fp").agg(F.min(rep).alias("rep")))
    found = common.components(links(nodes.select("fp"), radius, cap))
    joined = nodes.join(found, nodes.fp == found.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("least"))
    return common.materialize(common.salted(joined, least, "root", "fp").select("fp", F.col("least").alias("rep")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, cap: int = CAP) -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id = least id that links reach)."""
    fps = common.materialize(fingerprints(docs, id_col, text_col, width))
    named = _classes(fps, F.col("id"), radius, cap)
    return common.salted(fps, named, "fp", "id").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("rep").alias("component_id")
    )


# ------------------------------------------------------------------ a threshold of similarity
_rng = np.random.default_rng(80)
_XOR, _MUL = _rng.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64), _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _rng.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: A byte's bits as eight counters of one byte each.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def _sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``width`` words."""
    off, raw = common.buffers(column)
    _, _, sym, first = common.words(off, raw, fold=True)
    runs = common.rolling(sym, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        if n >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(common.rolling(sym[a:b], n, salt=n) if n else np.zeros(0, np.uint64))
    return out


def _starts(size: np.ndarray) -> np.ndarray:
    return np.append(0, np.cumsum(size)[:-1]) if len(size) else np.zeros(0, np.int64)


def wide_prints(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets, BITS / 64) SimHash fingerprints of sets of hashes that lie one after the other; no set is empty."""
    parts = -(-size // 255)  # a counter of one byte holds no more
    at = np.repeat(_starts(size), parts) + 255 * (np.arange(parts.sum()) - np.repeat(_starts(parts), parts))
    lanes = [np.add.reduceat(_LANES[byte], at) for w in range(BITS // 64) for byte in common.mix64(h ^ _XOR[w]).view(np.uint8).reshape(-1, 8).T]
    count = np.add.reduceat(np.stack(lanes, axis=1).view(np.uint8).astype(np.int64), _starts(parts), axis=0)
    return np.packbits(2 * count > size[:, None], axis=1, bitorder="little").view(np.uint64)


def _binary(x: np.ndarray) -> pa.Array:
    """Rows of an array as a binary column."""
    x = np.ascontiguousarray(x)
    off = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.nbytes // max(1, len(x)))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(x.tobytes())])


def _rows_of(column: pa.ChunkedArray, words: int) -> np.ndarray:
    """A column of ``_binary`` as (n, words) 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, words)


def _signed(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each set: node (128 bits), size, fingerprint and bucket keys (one for each band)."""
    size = np.array([len(s) for s in sets], np.int64)
    node, fp, keys = np.zeros((len(sets), 2), np.uint64), np.zeros((len(sets), BITS // 64), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        h = np.concatenate([sets[i] for i in full])
        at = _starts(size[full])
        for k in range(2):
            node[full, k] = common.mix64(np.add.reduceat(common.mix64(h ^ _XOR[7 + k]), at) + size[full].astype(np.uint64))
        fp[full] = wide_prints(h, size[full])
        for c in range(BANDS):
            key = np.full(len(full), _XOR[c], np.uint64)
            for k in range(c * ROWS, (c + 1) * ROWS):
                key += np.minimum.reduceat((h ^ _XOR[k]) * _MUL[k], at) * _FOLD[k % ROWS]
            keys[full, c] = common.mix64(key)
    return node, size, fp, keys


@common.trimmed
def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in common.slices(batch, "t", 1 << 20):
            node, size, fp, keys = _signed(_sets(b.column(2), width))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(node) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), _binary(node), pa.array(size), _binary(fp), lists], ["a", "r", "node", "n", "fp", "keys"])


@common.trimmed
def _wide_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, j, part, node, fp) sorted by group; links of each bucket."""
    group = ["k", "i", "j"]
    for t in whole_groups(batches, group):
        a, b = linked([np.asarray(t[x]) for x in group], np.asarray(t["part"]), _rows_of(t["fp"], BITS // 64), WIDE_RADIUS)
        node = t["node"].combine_chunks()
        yield pa.record_batch([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])


@common.trimmed
def _whole(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, j, node, fp, t) to (k, i, j, node, fp, runs): texts become their sets."""
    for batch in batches:
        for b in common.slices(batch, "t", 1 << 20):
            runs = pa.array([s.tobytes() for s in _sets(b.column(5), width)], pa.binary())
            yield pa.record_batch([*b.columns[:5], runs], ["k", "i", "j", "node", "fp", "runs"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of at least ``SIMILARITY``."""
    least, of = SIMILARITY
    if of * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return of * both >= least * (len(a) + len(b) - both)


def _reach(fp: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Spanning forest of the similar ones among sets; those already reached are not compared again."""
    left = np.arange(len(sets))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            _, close = next(near(fp[i : i + 1], fp[left], WIDE_RADIUS))
            hit = np.array([bool(c) and similar(sets[i], sets[j]) for c, j in zip(close[0].tolist(), left.tolist())], bool)
            for j in left[hit].tolist():
                yield i, j
                todo.append(j)
            left = left[~hit]


@common.trimmed
def _exact_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, i, j, node, fp, runs) sorted by group; links of each group, by whole sets."""
    group = ["k", "i", "j"]
    for t in whole_groups(batches, group):
        root, cols = np.array(t["k"].to_pylist(), object), [np.asarray(t[x]) for x in group[1:]]
        new = np.ones(len(root), bool)
        new[1:] = (root[1:] != root[:-1]) | np.any([c[1:] != c[:-1] for c in cols], axis=0)
        first = np.append(np.flatnonzero(new), len(root))
        node, a, b = t["node"].combine_chunks(), [], []
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
            if hi - lo > 1:
                part = t.slice(lo, hi - lo)
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in part["runs"]]
                for x, y in _reach(_rows_of(part["fp"], BITS // 64), sets):
                    a.append(lo + x)
                    b.append(lo + y)
        yield pa.record_batch([node.take(pa.array(a, pa.int64())), node.take(pa.array(b, pa.int64()))], ["a", "b"])


def _similar(rows: DataFrame, signed: DataFrame, width: int, cap: int, cap_runs: int) -> DataFrame:
    """(node, root) of all nodes with a similar other one, from rows (a, r, t) and their signatures."""
    nodes = common.materialize(signed.where("n > 0").dropDuplicates(["node"]))
    keyed = nodes.select(F.explode("keys").alias("k"), "node", "fp")
    met = _meet(_dealt(keyed, ["k"], "node", F.lit(1), cap).select("k", "i", "j", "part", "node", "fp"), ["k", "i", "j"])
    groups = common.components(met.mapInArrow(_wide_links, "a binary, b binary").distinct())
    member = common.materialize(nodes.join(groups, "node").select(F.col("root").alias("k"), "a", "r", "node", "n", "fp"))
    # rows that share a and r are alike: one of them is enough
    texts = member.join(rows.dropDuplicates(["a", "r"]), ["a", "r"])
    sets = _dealt(member, ["k"], "node", F.col("n"), cap_runs).select("a", "r", "k", "i", "j")
    sets = texts.select("a", "r", "node", "fp", "t").join(sets, ["a", "r"]).select("k", "i", "j", "node", "fp", "t")
    sets = _meet(sets.mapInArrow(lambda it: _whole(it, width), "k binary, i int, j int, node binary, fp binary, runs binary"), ["k", "i", "j"])
    out = common.components(sets.mapInArrow(_exact_links, "a binary, b binary").distinct())
    common.discard(nodes, member)
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, cap: int = CAP, cap_runs: int = CAP_RUNS) -> DataFrame:
    """All columns of one row of each group that links of similarity ``SIMILARITY`` connect: the one with the least id.

    Defined cases: words are ASCII-lower-cased; a text of fewer than ``width`` words has one run, all its words; null and
    empty texts are one node; null ids come last; of rows that share id and text one stays; an empty table gives an
    empty result; further columns stay as they are, whatever their names.
    """
    spark = docs.sparkSession
    common.ship(spark)
    i = F.col(id_col).cast("long")
    a, r = F.coalesce(i, F.lit(-(1 << 63))), F.xxhash64(i, F.col(text_col))  # a null id is in the hash
    rows = docs.select(a.alias("a"), r.alias("r"), F.col(text_col).alias("t"))
    signed = common.materialize(rows.mapInArrow(lambda it: _signatures(it, width), "a long, r long, node binary, n long, fp binary, keys array<long>"))
    found = common.materialize(_similar(rows, signed, width, cap, cap_runs))
    first = F.min(F.struct((F.col("a") == -(1 << 63)).alias("last"), "a", "r")).alias("rep")
    least = signed.groupBy("node").agg(first).join(found, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("rep").alias("rep"))
    keep = common.materialize(least.select("rep.a", "rep.r"))
    common.discard(signed, found)
    whole = docs.select(a.alias("a"), r.alias("r"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    # the texts are dealt out by key at every size, so that the plan does not change as the decisions grow
    kept = whole.join(keep.hint("merge"), ["a", "r"])
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("a", "r").orderBy("a"))).where("k = 1").select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
