"""Substring dedup by prefix-partitioned suffix trees over words.

Only runs of words that two documents share can be repeats, so suffixes are first reduced to those: each run
of ``width`` words has an anchor, the run of ``PREFIX`` words in it with the least hash, and equal runs have equal
anchors. Anchors that occur in one document only are dropped.

A suffix's prefix ends where its anchor ends, so it has ``PREFIX`` to ``width`` words, and suffixes with equal first ``width``
words have equal prefixes. Suffixes are dealt out by prefix: the prefixes that end in one anchor go to one task, as
stretches of neighbouring suffixes that share their words. Where a group's stretches would take more than ``cap`` bytes its
prefixes are lengthened to ``width`` words. Such a prefix is itself a deep node: its least document is an aggregate, reduced
before the shuffle, and nothing of it is gathered.

In each group the suffix tree is built (``subtree``): suffixes are sorted, neighbours' common prefixes give the internal
nodes, and the highest ones of a depth of ``width`` words or more are kept. A node's depth is the length of the repeat that all
its suffixes share; a suffix in a node with a smaller document begins a repeat that is to go.

Defined cases: a null or empty text has no words; a null id is neither smaller than another nor has smaller ones,
so nothing is removed from it or because of it; rows that repeat an id are judged on their own, and none is
smaller than the other; an empty table gives an empty result; further columns are ignored. Words are compared by 64-bit
symbols, lengthened prefixes by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

WIDTH, PREFIX, STRETCH, CAP, SALTS = 13, 5, 16, 4 << 20, 16
_COEF = np.random.default_rng(99).integers(0, 2**63, STRETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anchors(sym: np.ndarray, width: int, prefix: int) -> np.ndarray:
    """The least hash of ``prefix`` words in each run of ``width`` words."""
    low, have, need = common.rolling(sym, prefix, 11), 1, width - prefix + 1
    while have < need:
        step = min(have, need - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    return low


def _runs(column: pa.Array, width: int, prefix: int):
    """(words' symbols, first word of each text, starts of runs inside one text, their texts, their anchors)."""
    off, raw = common.buffers(column)
    _, _, sym, first = common.words(off, raw)
    if len(sym) < width:
        z = np.zeros(0, np.int64)
        return sym, first, z, z, np.zeros(0, np.uint64)
    low = _anchors(sym, width, prefix)
    doc = np.searchsorted(first, np.arange(len(low)), side="right") - 1
    at = np.flatnonzero(np.arange(len(low)) + width <= first[doc + 1])
    return sym, first, at, doc[at], low[at]


@common.trimmed
def _anchor_rows(batches: Iterator[pa.RecordBatch], width: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows (r, d, t) to rows (r, d, m, n): a document's distinct anchors and the bytes of their stretches."""
    for whole in batches:
        for b in common.slices(whole, "t"):
            _, _, _, doc, low = _runs(b.column(2), width, prefix)
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            size = np.diff(np.append(np.flatnonzero(new), len(low)))
            doc, low = doc[new], low[new]
            order = np.lexsort((low, doc))
            doc, low, size = doc[order], low[order], 8 * (size[order] + width) + 32
            new = np.ones(len(low), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            total = np.add.reduceat(size, np.flatnonzero(new)) if len(size) else size
            r, d = np.asarray(b.column(0)), np.asarray(b.column(1))
            cols = [pa.array(r[doc[new]], pa.int64()), pa.array(d[doc[new]], pa.int64()), pa.array(low[new].view(np.int64)), pa.array(total, pa.int64())]
            yield pa.record_batch(cols, ["r", "d", "m", "n"])


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of start[i] ... start[i] + size[i] - 1, one after the other."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def _shared(b: pa.RecordBatch, width: int, prefix: int):
    """Rows (r, d, t, anchors) of a batch: (symbols, first words, runs with one of the row's anchors, their rows, anchors)."""
    sym, first, at, doc, low = _runs(b.column(2), width, prefix)
    lists = b.column(3)
    size = np.diff(np.asarray(lists.offsets))
    anchors = np.asarray(lists.flatten()).view(np.uint64)
    salt = lambda x, k: common.mix64(x ^ (k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    hit = np.isin(salt(low, doc), salt(anchors, np.repeat(np.arange(len(size)), size)))
    return sym, first, at[hit], doc[hit], low[hit]


@common.trimmed
def _stretch_rows(batches: Iterator[pa.RecordBatch], width: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows (r, d, t, anchors) to stretches (r, d, starts, n, m, words); equal ones of a document are one row."""
    for whole in batches:
        for b in common.slices(whole, "t"):
            sym, first, at, doc, low = _shared(b, width, prefix)
            if not len(at):
                continue
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) != 1) | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            head = np.flatnonzero(new)
            place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
            head = np.flatnonzero(place % STRETCH == 0)
            n = np.diff(np.append(head, len(at)))
            fp = common.mix64(np.add.reduceat(common.rolling(sym, width)[at] * _COEF[place % STRETCH], head) + n.astype(np.uint64))
            order = np.lexsort((at[head], fp, doc[head]))
            head, n, fp = head[order], n[order], fp[order]
            new = np.append(True, (fp[1:] != fp[:-1]) | (doc[head][1:] != doc[head][:-1]))
            rep = np.flatnonzero(new)
            starts = pa.ListArray.from_arrays(pa.array(np.append(rep, len(head)), pa.int32()), pa.array(at[head] - first[doc[head]], pa.int32()))
            head, n = head[rep], n[rep]
            length = n + width - 1
            words = sym[_ranges(at[head], length)]
            data = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(np.append(0, np.cumsum(length * 8)).astype(np.int32).tobytes()), pa.py_buffer(words.tobytes())])
            r, d = np.asarray(b.column(0))[doc[head]], np.asarray(b.column(1))[doc[head]]
            yield pa.record_batch([pa.array(r), pa.array(d), starts, pa.array(n.astype(np.int32)), pa.array(low[head].view(np.int64)), data], ["r", "d", "starts", "n", "m", "words"])


@common.trimmed
def _window_rows(batches: Iterator[pa.RecordBatch], width: int, prefix: int) -> Iterator[pa.RecordBatch]:
    """Rows (r, d, t, anchors) to (r, d, start, p, q): each suffix with its prefix of ``width`` words, as 128 bits."""
    for whole in batches:
        for b in common.slices(whole, "t"):
            sym, first, at, doc, _ = _shared(b, width, prefix)
            if len(at):
                p, q = (common.rolling(sym, width, salt)[at].view(np.int64) for salt in (0, 77))
                r, d = np.asarray(b.column(0))[doc], np.asarray(b.column(1))[doc]
                yield pa.record_batch([pa.array(r), pa.array(d), pa.array((at - first[doc]).astype(np.int32)), pa.array(p), pa.array(q)], ["r", "d", "start", "p", "q"])


class Nodes(NamedTuple):
    """Internal nodes of suffix trees: node k has the suffixes order[first[k] : first[k + 1]]."""

    order: np.ndarray
    first: np.ndarray
    depth: np.ndarray
    least: np.ndarray


def subtree(group: np.ndarray, words: np.ndarray, begin: np.ndarray, have: np.ndarray, doc: np.ndarray, width: int) -> Nodes:
    """The highest nodes of ``width`` words or more of the suffix tree of each group, and their least documents.

    A suffix is words[begin : begin + have], and has at least ``width`` words. A node is where a path of that many words
    ends: its suffixes lie beside each other in their sorted order, and its depth is the length of what all of them share.
    """
    column = [words[begin + k] for k in range(width)]
    order = np.lexsort((*reversed(column), group))
    same = group[order][1:] == group[order][:-1]
    for c in column:
        same &= c[order][1:] == c[order][:-1]
    inside = np.append(False, same) | np.append(same, False)  # a leaf on its own is no internal node
    at = np.flatnonzero(inside)
    order, head = order[at], np.append(True, ~same)[at]
    first = np.flatnonzero(head)
    node = np.cumsum(head) - 1
    depth = np.full(len(at), width, np.int64)
    root = order[first[node]] if len(at) else order
    more = np.flatnonzero(have[order] > width)
    while len(more):  # how far each suffix goes with its node's first one
        i, j, k = order[more], root[more], depth[more]
        on = (k < have[i]) & (k < have[j])
        on[on] = words[begin[i[on]] + k[on]] == words[begin[j[on]] + k[on]]
        more = more[on]
        depth[more] += 1
    if not len(at):
        return Nodes(order, np.zeros(1, np.int64), depth, doc[order])
    return Nodes(order, np.append(first, len(at)), np.minimum.reduceat(depth, first), np.minimum.reduceat(doc[order], first))


@common.trimmed
def _lowest(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by m: (r, d, starts, bits) where a suffix's node has a smaller document."""
    held: dict | None = None

    def read(b: pa.RecordBatch) -> dict:
        out = {k: np.asarray(b.column(k)) for k in ("m", "d", "n", "r")}
        col = b.column("words")
        off = np.frombuffer(col.buffers()[1], np.int32 if pa.types.is_binary(col.type) else np.int64)[col.offset : col.offset + len(col) + 1]
        out["words"] = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.uint64)
        out["starts"] = b.column("starts")
        return out

    def join(x: dict, y: dict) -> dict:
        return {k: pa.concat_arrays([x[k], y[k]]) if k == "starts" else np.concatenate([x[k], y[k]]) for k in x}

    def part(c: dict, a: int, b: int) -> dict:
        at = np.append(0, np.cumsum(c["n"].astype(np.int64) + width - 1))
        return {k: c[k][at[a] : at[b]] if k == "words" else c[k].slice(a, b - a) if k == "starts" else c[k][a:b] for k in c}

    def solve(c: dict) -> pa.RecordBatch:
        n = c["n"].astype(np.int64)
        begin = np.cumsum(n + width - 1) - (n + width - 1)
        which, at = np.repeat(np.arange(len(n)), n), _ranges(begin, n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        tree = subtree(c["m"][which], c["words"], at, n[which] - place + width - 1, c["d"][which], width)
        low = np.repeat(tree.least, np.diff(tree.first))
        hit = tree.order[low < c["d"][which[tree.order]]]
        bits = np.zeros(len(n), np.int32)
        np.bitwise_or.at(bits, which[hit], np.left_shift(1, place[hit]).astype(np.int32))
        hit = np.flatnonzero(bits)
        return pa.record_batch([pa.array(c["r"][hit]), pa.array(c["d"][hit]), c["starts"].take(pa.array(hit)), pa.array(bits[hit])], ["r", "d", "starts", "bits"])

    for batch in batches:
        if not batch.num_rows:
            continue
        c = read(batch)
        if held is not None:
            c = join(held, c)
        total = len(c["m"])
        cut = int(np.searchsorted(c["m"], c["m"][-1]))
        if cut:
            yield solve(part(c, 0, cut))
        held = part(c, cut, total)
    if held is not None and len(held["m"]):
        yield solve(held)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(r, d, t): id and text with a hash of both; rows that share r and d are alike."""
    d, t = F.col(id_col).cast("long"), F.col(text_col)
    return docs.select(F.xxhash64(d, t).alias("r"), d.alias("d"), t.alias("t"))


def marks(rows: DataFrame, width: int = WIDTH, prefix: int = PREFIX, cap: int = CAP) -> DataFrame:
    """(r, d, marks array<struct<start, bits>>) for rows (r, d, t): bit i of bits says that the run of ``width`` words
    that begins at word start + i also begins in a document with a smaller id."""
    usable = rows.where("d is not null and t is not null")
    anchors = common.materialize(usable.mapInArrow(lambda it: _anchor_rows(it, width, prefix), "r long, d long, m long, n long"))
    shared = anchors.groupBy("m").agg(F.min("d").alias("a"), F.max("d").alias("b"), F.sum("n").alias("bytes")).where("a < b").select("m", (F.col("bytes") > cap).alias("hot"))
    lists = anchors.join(shared, "m").groupBy("r", "d").agg(F.collect_set(F.expr("if(hot, null, m)")).alias("few"), F.collect_set(F.expr("if(hot, m, null)")).alias("many"))
    lists = common.materialize(lists)
    common.discard(anchors)
    joined = usable.join(lists, ["r", "d"])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    few = joined.select("r", "d", "t", "few").mapInArrow(lambda it: _stretch_rows(it, width, prefix), "r long, d long, starts array<int>, n int, m long, words binary")
    found = few.repartition(parts, "m").sortWithinPartitions("m").mapInArrow(lambda it: _lowest(it, width), "r long, d long, starts array<int>, bits int")
    found = found.select("r", "d", F.explode("starts").alias("start"), "bits")
    long, each = lists.where(F.size("many") > 0), None
    if not long.isEmpty():
        each = usable.join(long, ["r", "d"]).select("r", "d", "t", "many")
        each = common.materialize(each.mapInArrow(lambda it: _window_rows(it, width, prefix), "r long, d long, start int, p long, q long"))
        node = each.groupBy("p", "q").agg(F.min("d").alias("low"), F.max("d").alias("top")).where("low < top").select("p", "q", "low")
        # a node may have a third of all rows: both sides are dealt by a salt too
        salted = each.withColumn("s", F.pmod(F.xxhash64("r", "start"), F.lit(SALTS)).cast("int"))
        node = node.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.union(salted.join(node, ["p", "q", "s"]).where("low < d").select("r", "d", "start", F.lit(1).alias("bits")))
    out = common.materialize(found.groupBy("r", "d").agg(F.collect_set(F.struct("start", "bits")).alias("marks")))
    common.discard(lists, *([each] if each is not None else []))
    return out


def covered(n: int, marks: list | None, width: int = WIDTH) -> np.ndarray:
    """Which of n words the marked runs cover."""
    step = np.zeros(n + 1, np.int64)
    for m in marks or ():
        start, bits = m["start"], m["bits"] & 0xFFFFFFFF
        while bits:
            k = (bits & -bits).bit_length() - 1
            bits &= bits - 1
            step[start + k] += 1
            step[min(n, start + k + width)] -= 1
    return np.cumsum(step)[:n] > 0


@common.trimmed
def _kept(batches: Iterator[pa.RecordBatch], width: int, text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            out: list[list] = [[], [], []]
            for t, m in zip(b.column(1), b.column(2)):
                w = (t.as_py() or "").encode().split()
                total = len(w)
                if m.is_valid:
                    gone = covered(total, m.as_py(), width)
                    w = [x for x, g in zip(w, gone.tolist()) if not g]
                kept = b" ".join(w)
                for column, v in zip(out, (total, total - len(w), kept.decode() if text else hashlib.sha256(kept).hexdigest())):
                    column.append(v)
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string())))], ["d", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, prefix: int = PREFIX, cap: int = CAP, text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept): each document without the words that such runs cover; ``kept`` is the
    text that is left, its words joined by one space, or with ``text=False`` its SHA-256."""
    common.ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    joined = rows.join(marks(rows, width, prefix, cap), ["r", "d"], "left").select("d", "t", "marks")
    return joined.mapInArrow(lambda it: _kept(it, width, text), "d long, n_words long, n_removed long, kept string").withColumnRenamed("d", id_col)


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    return dedup(common.table(spark, sf_dir, "documents"), text=False).withColumnRenamed("kept", "kept_sha256")
