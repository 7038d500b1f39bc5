"""Ranked lexical search with a tiered index.

Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A document's score for an item
is the sum of ``weight(term) * impact(term, document)`` over the item's terms, repeats included (whole numbers throughout).

The index has one row for each document, with the postings of the terms that the items of a block use, in ``TIERS`` tiers:
a term's postings of highest impact are in the first tier (all of them where the term is in at most one of ``RARE``
documents, else the best ``SHARES[0]``), the next best in the second, the others in the last. What a tier leaves out of a term
has a residual bound, the greatest impact below the tier. A tier is two columns, so a search of the first tier reads no others.

A search level uses the tiers up to its own. It sums what they have of each document; an item's 20th largest sum is a floor
of its final 20th score, and a document that no tier so far has seen can score at most the sum of the residual bounds. Where
that is below the floor the item is proven: its results are among the documents whose sum and remaining residual bounds reach
the floor, and those are scored exactly. Items without that proof fall through to the next level; the last one leaves
nothing out. All passes are maps over the index with the items' matrix as a broadcast; only each task's best few are shuffled.

Items are searched in blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES`` of text, so that broadcasts have a bound, and each
block has an index of its own terms. Words are compared by 64-bit hashes.

Defined cases: null and empty texts have no terms and are in no result; an item without terms, or whose terms no document
has, has no rows; rows of documents are documents of their own even where id or text repeat, and repeated items each have
their rows; of equal scores the least id comes first, null ids last; empty tables give an empty result; further columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from zonalis.llm import common

TOP, TIERS, RARE, SHARES = 20, 3, 32, (1 / 8, 1 / 2)
BLOCK, BLOCK_BYTES, CELLS, STEPS = 4096, 4 << 20, 1 << 21, 16

#: bytes of terms as they are, A-Z in lower case, all others a space
_FOLD = np.full(256, 32, np.uint8)
for _a, _b, _by in ((48, 57, 0), (65, 90, 32), (97, 122, 0), (128, 255, 0)):
    _FOLD[_a : _b + 1] = np.arange(_a, _b + 1) + _by


def symbols(off: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit symbols of all terms, first term of each text)."""
    _, _, sym, first = common.words(off, _FOLD[raw])
    return sym, first


def _impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """A block of items as a sparse matrix: for each of its terms the items that have it, and how often."""

    def __init__(self, rows: list[tuple[int | None, str]]):
        self.ids = [i for i, _ in rows]
        sym, first = symbols(*common.buffers(pa.array([t for _, t in rows], pa.string())))
        item = np.repeat(np.arange(len(rows)), np.diff(first))
        self.sym, of = np.unique(sym, return_inverse=True)
        pair, times = np.unique(of * max(1, len(rows)) + item, return_counts=True)
        self.item, self.times = pair % max(1, len(rows)), times
        self.at = np.searchsorted(pair // max(1, len(rows)), np.arange(len(self.sym) + 1))
        self.exact = bool(not len(rows) or int(np.bincount(self.item, self.times, len(rows)).max(initial=0)) < 2**53 // 10**11)  # of float sums

    def some(self, keep: np.ndarray) -> "Items":
        """The same terms, for the chosen items only."""
        out = object.__new__(Items)
        out.ids, out.sym, out.exact = [i for i, k in zip(self.ids, keep) if k], self.sym, self.exact
        mine = keep[self.item]
        out.item, out.times = (np.cumsum(keep) - 1)[self.item[mine]], self.times[mine]
        out.at = np.concatenate([[0], np.cumsum(mine)])[self.at]
        return out

    def sums(self, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """(docs, items): sums of value * times over postings (doc, term, value)."""
        size = self.at[term + 1] - self.at[term]
        at = np.repeat(self.at[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(doc, size) * len(self.ids) + self.item[at]
        each = np.repeat(value, size) * self.times[at]
        if self.exact:
            out = np.bincount(cell, each, docs * len(self.ids)).astype(np.int64)
        else:
            out = np.zeros(docs * len(self.ids), np.int64)
            np.add.at(out, cell, each)
        return out.reshape(docs, len(self.ids))


# --------------------------------------------------------------------------- the index
@common.trimmed
def _terms(batches: Iterator[pa.RecordBatch], sym: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(id, n, terms of the block, their frequencies) of each text that has a term at all."""
    for whole in batches:
        for b in common.slices(whole, "t"):
            got, first = symbols(*common.buffers(b.column(1)))
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(sym, got), max(len(sym) - 1, 0))
            hit = sym[at] == got if len(sym) else np.zeros(len(got), bool)
            key, tf = np.unique(doc[hit] * max(len(sym), 1) + at[hit], return_counts=True)
            off = np.searchsorted(key // max(len(sym), 1), np.arange(len(n) + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(off), pa.array(v.astype(np.int32))) for v in (key % max(len(sym), 1), tf)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), *lists], ["d", "n", "terms", "tfs"]).filter(pa.array(n > 0))


def _lists(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a list column."""
    c = b.column(column)
    off = c.offsets.to_numpy()
    return off - off[0], c.values.to_numpy()[off[0] : off[-1]]


class Tiers:
    """Numbers of a block's terms: weights, the least impact in each tier, and the greatest below it."""

    def __init__(self, docs: int, words: int, size: int):
        self.docs, self.words = docs, words
        self.weight = np.zeros(size, np.int64)
        self.least = np.zeros((TIERS, size), np.int64)  # of the last tier 0: all
        self.below = np.zeros((TIERS, size), np.int64)

    def scale(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.docs) // max(self.words, 1)

    def residual(self, items: Items, level: int) -> np.ndarray:
        """What an item's documents can have at most beyond the tiers of a level."""
        term = np.repeat(np.arange(len(self.weight)), np.diff(items.at))
        out = np.zeros(len(items.ids), np.int64)
        np.add.at(out, items.item, items.times * (self.weight * self.below[level])[term])
        return out


def _tiered(forward: DataFrame, size: int) -> Tiers:
    """Document frequencies and the bounds of the tiers, from counts of postings by term and class of impact."""
    docs, words = forward.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    out = Tiers(docs, words, size)
    m = 75 + F.expr(f"(25 * n * {docs}L) div {max(words, 1)}L")
    each = forward.select(m.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(F.col("p.terms").alias("term"), F.expr("(1000000000L * p.tfs) div (1000L * p.tfs + 12L * m)").alias("impact"))
    step = F.floor(F.log2(F.col("impact") + 1) * STEPS)
    classes = each.groupBy("term", step.alias("step")).agg(F.count("*").alias("c"), F.min("impact").alias("low"), F.max("impact").alias("high"))
    inside = W.partitionBy("term").orderBy(F.desc("step"))
    ranked = classes.withColumns({"df": F.sum("c").over(W.partitionBy("term")), "upto": F.sum("c").over(inside)})
    spans = []
    for share in SHARES:
        taken = (F.col("upto") - F.col("c") == 0) | (F.col("upto") <= F.col("df") * share) | (F.col("df") * RARE <= docs)
        spans += [F.min(F.when(taken, F.col("low"))), F.coalesce(F.max(F.when(~taken, F.col("high"))), F.lit(0))]
    # a row for each term of the block
    rows = ranked.groupBy("term").agg(F.first("df"), *spans).collect()
    for term, df, *cuts in rows:
        out.weight[term] = math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))
        for k in range(TIERS - 1):
            out.least[k, term], out.below[k, term] = cuts[2 * k], cuts[2 * k + 1]
    return out


def _split(batches: Iterator[pa.RecordBatch], tiers: Tiers) -> Iterator[pa.RecordBatch]:
    """Rows of the index: each tier's terms and impacts."""
    for b in batches:
        off, term = _lists(b, 2)
        tf = _lists(b, 3)[1].astype(np.int64)
        n = b.column(1).to_numpy()
        doc = np.repeat(np.arange(len(n)), np.diff(off))
        impact = _impact(tf, tiers.scale(n)[doc])
        tier = (impact < tiers.least[:, term]).sum(axis=0)
        out = [b.column(0)]
        for k in range(TIERS):
            mine = tier == k
            at = pa.array(np.searchsorted(doc[mine], np.arange(len(n) + 1)).astype(np.int32))
            out += [pa.ListArray.from_arrays(at, pa.array(v[mine].astype(np.int32))) for v in (term, impact)]
        yield pa.record_batch(out, ["d", *[f"{c}{k}" for k in range(TIERS) for c in ("terms", "impacts")]])


_ROW = ", ".join(f"terms{k} array<int>, impacts{k} array<int>" for k in range(TIERS))


def index(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Tiers]:
    """The block's index, written to the shared folder, and its tiers."""
    spark = docs.sparkSession
    common.ship(spark)
    one = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    shared = spark.sparkContext.broadcast(items.sym)
    forward = common.materialize(one.mapInArrow(lambda it: _terms(it, shared.value), "d long, n long, terms array<int>, tfs array<int>"))
    tiers = _tiered(forward, len(items.sym))
    numbers = spark.sparkContext.broadcast(tiers)
    out = common.materialize(forward.mapInArrow(lambda it: _split(it, numbers.value), f"d long, {_ROW}"))
    common.discard(forward)
    return out, tiers


# --------------------------------------------------------------------------- search
def _postings(b: pa.RecordBatch, tiers: range, a: int, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, impact) of the rows a to z; column 0 is the id, then each tier's two columns."""
    out = []
    for k in tiers:
        off, term = _lists(b, 1 + 2 * k)
        impact = _lists(b, 2 + 2 * k)[1]
        part = slice(off[a], off[z])
        out.append((np.repeat(np.arange(z - a), np.diff(off[a : z + 1])), term[part], impact[part].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _parts(b: pa.RecordBatch, items: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELLS // max(items, 1))
    for a in range(0, b.num_rows, step):
        yield a, min(a + step, b.num_rows)


@common.trimmed
def _floors(batches: Iterator[pa.RecordBatch], items: Items, tiers: Tiers, level: int) -> Iterator[pa.RecordBatch]:
    """A task's greatest sums of each item over the tiers up to ``level``."""
    best = np.zeros((len(items.ids), 0), np.int64)
    for b in batches:
        for a, z in _parts(b, len(items.ids)):
            doc, term, impact = _postings(b, range(level + 1), a, z)
            both = np.concatenate([best, items.sums(z - a, doc, term, impact * tiers.weight[term]).T], axis=1)
            best = -np.partition(-both, TOP - 1, axis=1)[:, :TOP] if both.shape[1] > TOP else both
    item, k = np.nonzero(best)
    yield pa.record_batch([pa.array(item.astype(np.int32)), pa.array(best[item, k])], ["item", "s"])


@common.trimmed
def _scores(batches: Iterator[pa.RecordBatch], items: Items, tiers: Tiers, level: int, floor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's best documents of each item: exact scores of those that may reach the item's floor."""
    n = len(items.ids)
    held = [np.zeros(0, np.int64)] * 4  # item, score, id, whether the id is null
    floor = floor.copy()
    for b in batches:
        ids, none = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
        for a, z in _parts(b, n):
            doc, term, impact = _postings(b, range(level + 1), a, z)
            # the residual bounds of what was seen are taken off, so that only those of the missing terms count
            most = items.sums(z - a, doc, term, tiers.weight[term] * (impact - tiers.below[level, term])) + tiers.residual(items, level)
            which, item = np.nonzero((most >= floor) & (most > 0))
            score = most[which, item]
            if level < TIERS - 1:
                score = _exact(items, tiers, which, item, *_postings(b, range(TIERS), a, z), z - a)
            good = (score >= floor[item]) & (score > 0)
            got = item[good], score[good], ids[a:z][which[good]], none[a:z][which[good]].astype(np.int64)
            held = [np.concatenate(x) for x in zip(held, got)]
            if len(held[0]) > 4 * TOP * max(n, 50):
                held, floor = _best(held, floor)
    held, _ = _best(held, floor)
    yield pa.record_batch([pa.array(held[0].astype(np.int32)), pa.array(held[1]), pa.array(held[2], mask=held[3] == 1)], ["item", "score", "d"])


def _exact(items: Items, tiers: Tiers, which: np.ndarray, item: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, docs: int) -> np.ndarray:
    """Scores of pairs (document, item) from all postings; only documents of some pair are met."""
    mine = np.zeros(docs, bool)
    mine[which] = True
    keep = mine[doc]
    full = items.sums(docs, doc[keep], term[keep], impact[keep] * tiers.weight[term[keep]])
    return full[which, item]


def _best(held: list[np.ndarray], floor: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The best ``TOP`` of each item, and floors that they raise."""
    item, score, ids, none = held
    order = np.lexsort((ids, none, -score, item))
    item = item[order]
    first = np.searchsorted(item, item, side="left")
    nth = np.arange(len(item)) - first
    keep = order[nth < TOP]
    floor = floor.copy()
    last = nth == TOP - 1
    np.maximum.at(floor, item[last], score[order][last])
    return [x[keep] for x in held], floor


def search(table: DataFrame, tiers: Tiers, items: Items) -> tuple[DataFrame, list[int]]:
    """(item, rank, doc_id, score) by numbers of the block's items, and how many of them each level proved."""
    spark = table.sparkSession
    left = np.arange(len(items.ids))
    out, proven = None, []
    for level in range(TIERS):
        part = items.some(np.isin(np.arange(len(items.ids)), left))
        shared = spark.sparkContext.broadcast((part, tiers))
        floor = np.zeros(len(left), np.int64)
        read = table.select("d", *[f"{c}{k}" for k in range(level + 1) for c in ("terms", "impacts")])
        sums = read.mapInArrow(lambda it, shared=shared, level=level: _floors(it, *shared.value, level), "item int, s long")
        nth = F.row_number().over(W.partitionBy("item").orderBy(F.desc("s")))
        # one row for each item of the block
        for item, s in sums.withColumn("k", nth).where(F.col("k") == TOP).select("item", "s").collect():
            floor[item] = s
        rest = tiers.residual(part, level)
        sure = (rest < floor) | (rest == 0)
        proven.append(int(sure.sum()))
        if sure.any():
            done = spark.sparkContext.broadcast((part.some(sure), tiers, floor[sure], left[sure].astype(np.int32)))

            def scores(it, done=done, level=level):
                mine, tiers, floor, number = done.value
                for b in _scores(it, mine, tiers, level, floor):
                    yield b.set_column(0, "item", pa.array(number[b.column(0).to_numpy()]))

            found = table.mapInArrow(scores, "item int, score long, d long")
            out = found if out is None else out.union(found)
        left = left[~sure]
        if not len(left):
            break
    if out is None:
        out = spark.createDataFrame([], "item int, score long, d long")
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("d").asc_nulls_last()))
    return out.withColumn("rank", rank).where(F.col("rank") <= TOP), proven


def _blocks(queries: DataFrame, item_col: str, text_col: str, rows: int, size: int) -> Iterator[list[tuple[int | None, str, int]]]:
    """Different items (id, text, copies) in blocks of about ``rows`` rows and ``size`` bytes."""
    q = queries.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t")).where("t is not null").groupBy("i", "t").agg(F.count("*").alias("c"))
    n, total = q.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(-(-n // rows), -(-total // size))
    for k in range(blocks):
        got = q.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()
        if got:
            yield sorted(((r.i, r.t, r.c) for r in got), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def ranked(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``TOP`` documents of each item."""
    spark = docs.sparkSession
    out = None
    for rows in _blocks(queries, item_col, item_text, block, block_bytes):
        items = Items([(i, t) for i, t, _ in rows])
        table, tiers = index(docs, items, id_col, text_col)
        found, _ = search(table, tiers, items)
        ids = F.broadcast(spark.createDataFrame([(k, i, c) for k, (i, _, c) in enumerate(rows)], "item int, i long, copies long"))  # a block's
        each = found.join(ids, "item").withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        one = each.select(F.col("i").alias("item_id"), F.col("rank").cast("int").alias("rank"), F.col("d").alias("doc_id"), "score")
        one = common.materialize(one)
        common.discard(table)
        out = one if out is None else out.union(one)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op12_search(spark, sf_dir: str) -> DataFrame:
    """The best 20 documents of every benchmark item; the defined cases are those of the module."""
    return ranked(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


#: the same in SQL
OP12_SQL = r"""
with w as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select doc_id, term, count(*) as tf from w group by all),
d as (select doc_id, cast(sum(tf) as bigint) as n from p group by all),
c as (select count(*) as nn, cast(sum(n) as bigint) as ll from d),
s as (select term, cast(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) as bigint) as w from p, c group by term, nn),
q as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
r as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nn) // ll)))) as bigint) as score
  from q join s using (term) join p using (term) join d using (doc_id), c group by all)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from r where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20
"""
