"""Spelling variants: words of a corpus that differ by one code point, and the form that each is likely a variant of.

Words that differ by one insertion, deletion or replacement at a position agree on all before it and on all after it. In a
dictionary sorted forwards the words that share a prefix are an interval, in the one sorted by reversed words those that
share a suffix are one, and every word is a point with a rank in either order. So the near words at one edit position are the
points in a rectangle, and a wavelet tree over the points reports them. This is done for each edit position of each word.

A tree covers groups, not the whole dictionary: for each pair of lengths (equal, or one apart) the edit positions are halved,
and words go to the groups of words that agree on all outside one half. A group of more than ``LIMIT`` words has its half
halved again, until it is small enough or one position is left; then it has at most as many words as the alphabet has code
points, and one. Groups are dealt out by hash, sorted, and read in chunks of whole groups, each with its own tree.

Runs have code points up to U+00FF only, so a word is a string of Latin-1 bytes in the trees.

Defined cases: null and empty texts have no words; rows of documents count each for itself, repeated ones too; where the id is
null, no code point is deleted; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

LEAST, TIMES, FACTOR, EVERY = 7, 2, 10, 31
LIMIT, CELLS, HELD, BUCKETS = 100_000, 4 << 20, 200_000, 1 << 16
_RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
_FOLD = {c: c + 32 for c in range(65, 91)}
_ROOT_ROUNDS = 8  # a chain of forms grows tenfold at each step, and a round doubles what is followed


# --------------------------------------------------------------------------- the dictionary
@common.trimmed
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of many texts; a word may come several times."""
    held: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["w", "n"])
        held.clear()
        return out

    for whole in batches:
        for b in common.slices(whole, "t"):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                head = zlib.crc32(b"%d:" % doc) if doc is not None else 0
                for run, n in Counter(_RUN.findall(text)).items():
                    run = run.lower() if run.isascii() else run.translate(_FOLD)
                    if doc is not None:
                        h = zlib.crc32(run.encode(), head)
                        if h % EVERY == 0:
                            k = h % len(run)
                            run = run[:k] + run[k + 1 :]
                            if len(run) < LEAST:
                                continue
                    held[run] += n
            if len(held) >= HELD:
                yield flush()
    yield flush()


def dictionary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """(w, n): words of at least ``LEAST`` code points that occur at least ``times`` times."""
    common.ship(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return one.mapInArrow(_counted, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


# --------------------------------------------------------------------------- rectangles
class Wavelet:
    """A permutation as a wavelet tree whose levels are stored one after the other, zeros first: it reports the places in an
    interval whose values are in another interval."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 0
        self.zeros, self.split = [], []
        v = values.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            zero = (v >> b) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            self.split.append(int(zero.sum()))
            v = np.concatenate([v[zero], v[~zero]])

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of all places in [lo, hi) with a value in [low, high), for many queries at once."""
        query, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            z, n = self.zeros[level], self.split[level]
            left, right = z[lo], z[hi]
            query = np.concatenate([query, query])
            lo, hi = np.concatenate([left, n + lo - left]), np.concatenate([right, n + hi - right])
            value = np.concatenate([value, value + (1 << b)])
            keep = (hi > lo) & (value < high[query]) & (value + (1 << b) > low[query])
            query, value, lo, hi = query[keep], value[keep], lo[keep], hi[keep]
        return query, value


def _intervals(common_part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each sorted row the interval of rows around it that share at least so much with their neighbours."""
    n = len(common_part)
    cut = common_part < least
    at = np.arange(n)
    lo = np.maximum.accumulate(np.where(cut, at, 0))
    end = np.append(np.where(cut, at, n)[1:], n)
    return lo, np.minimum.accumulate(end[::-1])[::-1]


def _shared(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row shares with the one before in its group; -1 for a group's first."""
    out = np.full(len(rows), -1)
    same = rows[1:] == rows[:-1]
    full = same.all(axis=1)
    out[1:] = np.where(full, rows.shape[1], same.argmin(axis=1))
    out[np.flatnonzero(np.append(True, group[1:] != group[:-1]))] = -1
    return out


def near(words: np.ndarray, size: np.ndarray, group: np.ndarray, longer: bool, length: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) in both directions of words that differ by one edit at a position from ``first`` to ``last``.

    ``words`` are rows of bytes of ``length`` (or, with ``longer``, one more: those with it inserted), zeros behind the
    shorter ones, sorted by group and word; pairs are within a group.
    """
    n, width = words.shape
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    back = np.zeros_like(words)
    for s in np.unique(size):
        mine = size == s
        back[mine, :s] = words[mine, :s][:, ::-1]
    order = np.lexsort((np.ascontiguousarray(back).view(f"S{width}").ravel(), group))
    ahead, behind = _shared(words, group), _shared(back[order], group[order])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    tree = Wavelet(rank)
    whole = length if longer else length - 1  # what prefix and suffix have together
    asks = size == length
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(max(first, whole - int(behind.max())), min(last, int(ahead.max())) + 1):
        lo, hi = _intervals(ahead, i)
        low, high = (x[rank] for x in _intervals(behind, whole - i))
        ask = np.flatnonzero((hi - lo > 1) & (high - low > 1) & asks)
        if not len(ask):
            continue
        query, value = tree.report(lo[ask], hi[ask], low[ask], high[ask])
        a, b = ask[query], order[value]
        keep = a != b
        if longer:
            keep &= size[b] == length + 1
            if i:  # of equal neighbours the first is the one that was inserted
                keep &= words[a, i - 1] != words[b, i]
        a, b = a[keep], b[keep]
        out += [(a, b), (b, a)] if longer else [(a, b)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


# --------------------------------------------------------------------------- groups
_CLASS = ["longer", "length", "first", "last"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``key``, equal for words that agree on all outside the positions first to last."""
    suffix = F.col("length") - F.col("last") - F.when(F.col("longer"), 0).otherwise(1)
    parts = F.substring("w", F.lit(1), F.col("first")), F.substring("w", F.length("w") - suffix + 1, suffix)
    return rows.withColumn("key", F.xxhash64(*_CLASS, *parts))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice, with the first and the second half of its positions."""
    mid = ((F.col("first") + F.col("last") + 1) / 2).cast("int")
    ends = F.array(F.struct(F.col("first").alias("a"), (mid - 1).alias("b")), F.struct(mid.alias("a"), F.col("last").alias("b")))
    return rows.withColumn("_h", F.explode(ends)).withColumns({"first": F.col("_h.a"), "last": F.col("_h.b")}).drop("_h")


def grouped(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(w, n, longer, length, first, last, key): words in groups of at most ``limit`` where more positions than one are left."""
    size = F.length("w")
    kind = lambda longer, length: F.struct(F.lit(longer).alias("longer"), length.alias("length"), F.lit(0).alias("first"), (length - (0 if longer else 1)).alias("last"))
    pairs = F.filter(F.array(kind(False, size), kind(True, size), kind(True, size - 1)), lambda k: k["length"] >= LEAST)
    rows = words.select("w", "n", F.explode(pairs).alias("k")).select("w", "n", "k.*")
    rows = _keyed(_halved(rows))
    done = None
    while True:
        bucket = F.pmod("key", F.lit(BUCKETS))
        full = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("c")).where(F.col("c") > limit)
        full = [r.bucket for r in full.collect()]  # at most BUCKETS numbers
        if not full:
            break
        some = rows.where(bucket.isin(full))
        hot = common.materialize(some.where("last > first").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key", F.lit(True).alias("hot")))
        if hot.isEmpty():
            break
        marked = common.materialize(common.salted(rows, hot, "key", "w", "left"))
        calm = marked.where("hot is null").drop("hot")
        done = calm if done is None else done.unionByName(calm)
        rows = common.materialize(_keyed(_halved(marked.where("hot").drop("hot", "key"))))
    return rows if done is None else done.unionByName(rows.select(done.columns))


def _chunks(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[tuple[tuple, pa.Table]]:
    """(class, rows) of a sorted partition: whole groups of one class, of about so many bytes of words."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool) -> tuple[list[tuple[tuple, pa.Table]], pa.Table]:
        table = table.combine_chunks()
        cols = [np.asarray(table.column(c)) for c in (*_CLASS, "key")]
        new = np.zeros(len(table), bool)
        kind = np.zeros(len(table), bool)
        for c in cols:
            kind[1:] |= c[1:] != c[:-1] if c is not cols[-1] else False
            new[1:] |= c[1:] != c[:-1]
        new[:1] = True
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(table))
        out, a = [], 0
        for k, (h, e) in enumerate(zip(heads.tolist(), ends.tolist())):
            closed = e < len(table) or last
            if not closed:
                break
            full = (e - a) * (int(cols[1][h]) + 1) >= cells
            if full or e == len(table) or kind[e]:
                out.append((tuple(c[a].item() for c in cols[:4]), table.slice(a, e - a)))
                a = e
        return out, table.slice(a)

    size = 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= 50_000:
            out, rest = cut(pa.Table.from_batches(held), False)
            yield from out
            held, size = rest.to_batches(), 0
    if held:
        yield from cut(pa.Table.from_batches(held), True)[0]


@common.trimmed
def _pairs(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """(word, near word, its n) of all pairs of a partition's groups."""
    for (longer, length, first, last), t in _chunks(batches, cells):
        key = np.asarray(t.column("key"))
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        if not many.any():
            continue
        t, group = t.filter(pa.array(many)).combine_chunks(), group[many]
        off, raw = _bytes(t.column("v"))
        size = np.diff(off)
        rows = np.zeros((len(size), length + int(longer)), np.uint8)
        rows[np.arange(rows.shape[1]) < size[:, None]] = raw
        a, b = near(rows, size, group, longer, length, first, last)
        for lo in range(0, len(a), 100_000):
            w, n = t.column("w"), t.column("n")
            x, y = pa.array(a[lo : lo + 100_000]), pa.array(b[lo : lo + 100_000])
            yield from pa.table([w.take(x), w.take(y), n.take(y)], ["w", "near", "near_n"]).combine_chunks().to_batches()


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column."""
    c = pa.concat_arrays([x.cast(pa.large_binary()) for x in column.chunks])
    _, offsets, data = c.buffers()
    off = np.frombuffer(offsets, np.int64)[c.offset : c.offset + len(c) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def near_words(words: DataFrame, limit: int = LIMIT, cells: int = CELLS) -> DataFrame:
    """(w, near, near_n): every pair of words one edit apart, in both directions, once."""
    common.ship(words.sparkSession)
    rows = grouped(words, limit).withColumn("v", F.encode("w", "ISO-8859-1"))
    dealt = rows.repartition("key").sortWithinPartitions(*_CLASS, "key", "w")
    return dealt.mapInArrow(lambda it: _pairs(it, cells), "w string, near string, near_n long")


# --------------------------------------------------------------------------- forms
def roots(forms: DataFrame) -> DataFrame:
    """(w, root): where the chain of forms (w, form) from each word ends; each round doubles what has been followed."""
    cur = common.materialize(forms.select("w", F.col("form").alias("root")))
    for _ in range(_ROOT_ROUNDS):
        on = cur.select(F.col("w").alias("root"), F.col("root").alias("_on"))
        step = common.materialize(cur.join(on, "root", "left").select("w", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("moved")))
        moved = not step.where("moved").isEmpty()
        common.discard(cur)
        cur = step.drop("moved")
        if not moved:
            return cur
    raise RuntimeError("chains of forms are longer than counts allow")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES, factor: int = FACTOR, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the dictionary."""
    words = common.materialize(dictionary(docs, id_col, text_col, times))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b")
    top = near_words(words, limit).groupBy("w").agg(F.count("*").alias("n_near"), best).select("w", "n_near", F.col("b.w").alias("near"), (-F.col("b.m")).alias("near_n"))
    likely = F.col("near_n") >= F.col("n") * factor
    known = common.materialize(words.join(top, "w", "left").select("w", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(likely, F.col("near")).alias("form"), F.when(likely, F.col("near_n")).alias("form_n")))
    common.discard(words)
    ends = roots(known.where("form is not null").select("w", "form"))
    return known.join(ends, "w", "left").select(F.col("w").alias("word"), "form", F.coalesce("root", "w").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words and forms; the defined cases are those of the module."""
    return variants(common.table(spark, sf_dir, "documents"))


#: the same in SQL; the table of crc32 comes from its polynomial
OP13_SQL = r"""
with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run from documents),
many as (select doc_id, run, count(*) as c, cast(doc_id as varchar) || ':' || run as s from runs where length(run) >= 7 group by all),
crc as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as t from range(256) r(i)),
hashed as (select run, c, xor(list_reduce([4294967295::bigint] || list_transform(range(octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), cast(2 * i + 1 as bigint), 2))::bigint),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) as h from many, crc),
words as (select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as w, c from hashed),
dict as (select w, cast(sum(c) as bigint) as n, length(w) as l from words where length(w) >= 7 group by w having sum(c) >= 2),
cut as (select w, n, l, i, substr(w, 1, i) || '|' || substr(w, i + 2) as k, substr(w, 1, i) || substr(w, i + 2) as shorter from (select *, unnest(range(l)) as i from dict)),
near as (select a.w, b.w as near, b.n as near_n from cut a join cut b on a.k = b.k and a.w <> b.w
  union select a.w, b.w, b.n from dict a join cut b on a.w = b.shorter union select b.w, a.w, a.n from dict a join cut b on a.w = b.shorter),
best as (select w, count(*) as n_near, first(near order by near_n desc, near) as near, max(near_n) as near_n from near group by w),
known as (select w, n, coalesce(n_near, 0) as n_near, case when near_n >= 10 * n then near end as form, case when near_n >= 10 * n then near_n end as form_n from dict left join best using (w)),
chain as (select w, coalesce(form, w) as at from known union select c.w, k.form from chain c join known k on c.at = k.w where k.form is not null),
ends as (select c.w, c.at from chain c join known k on c.at = k.w where k.form is null)
select k.w as word, form, e.at as root, n, n_near, form_n from known k join ends e on k.w = e.w
"""
