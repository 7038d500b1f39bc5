"""Quality scores by a generalised additive model with pairwise interactions.

Every text has ``FEATURES``, numbers that come from its bytes and words in one vectorised pass. A feature is cut into
bins at quantiles, and the model is a lookup table for each feature and for some pairs of features; a score is the
logistic function of the sum of the bins' entries. The tables are learned by boosting that goes round the features: each
step fits a tree of at most four leaves to the gradient over one feature's bins (or over a pair's) and adds a part of it to
that feature's table. The pairs are those whose four quarters best explain what the single features leave. Several such
fits, each of which is stopped by other rows that it does not learn from, are averaged table by table.

The model is fitted on the driver on the features of at most ``SAMPLE`` labelled rows (a documented bound; they are those
of least hash among all rows outside the held-out part). Scoring covers all rows.

Defined cases: null and empty texts have all features 0 and a score like any other; without two kinds of labels to learn
from every score is their share (0.5 without any); a document with contradicting labels is not learned from, repeated labels
count once; repeated rows and ids are kept; a null id stays null, is not held out and is not learned from; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

SAMPLE, BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, BAGS = 20_000, 48, 12, 10, 240, 0.08, 5
LEAST_GAIN = 1.0  # of a pair, in units of log-likelihood
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "spaces", "lower", "upper", "digits", "beyond_ascii", "stops", "symbols", "entropy",
    "capital_words", "symbol_words", "digit_words", "bare_words", "one_byte_words", "distinct_words", "top_word", "echoes", "distinct_pairs",
    "log_lines", "words_a_line", "distinct_lines", "ended_lines",
)
_STOPS = b".,;:!?'\"()-"


def _class(*parts: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(b"".join(parts))] = True
    return out


_LOWER, _UPPER, _DIGIT = (_class(bytes(range(a, b + 1))) for a, b in ((97, 122), (65, 90), (48, 57)))
_SPACES, _BEYOND, _STOP = _class(b"\t\n\v\f\r "), _class(bytes(range(128, 256))), _class(_STOPS)
_SYMBOL = ~(_LOWER | _UPPER | _DIGIT | _SPACES | _BEYOND | _STOP)
_END = _class(b".?!:;\"'")


def _of(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weight, n).astype(float)


def _distinct(doc: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, occurrences of the most frequent key) of each document."""
    if not len(doc):
        return np.zeros(n), np.zeros(n)
    mixed = common.mix64(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(mixed)
    mixed = mixed[order]
    first = np.flatnonzero(np.append(True, mixed[1:] != mixed[:-1]))
    owner = doc[order[first]]
    top = np.zeros(n, np.int64)
    np.maximum.at(top, owner, np.diff(np.append(first, len(mixed))))
    return _of(owner, n), top.astype(float)


def features(off: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """(texts, len(FEATURES)): the features of many texts at once; whole texts."""
    n, size = len(off) - 1, np.diff(off)
    out = np.zeros((n, len(FEATURES)))
    if not len(raw):
        return out
    byte_doc = np.repeat(np.arange(n), size)
    hist = np.bincount(byte_doc * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
    total = np.maximum(size, 1)
    ink = np.maximum(size - hist @ _SPACES, 1)
    share = hist / total[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.where(share > 0, share * np.log2(share), 0).sum(axis=1)

    start, end, sym, first = common.words(off, raw)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    doc = np.repeat(np.arange(n), np.diff(first))
    length = end - start

    def having(kind: np.ndarray) -> np.ndarray:
        count = np.concatenate([[0], np.cumsum(kind[raw])])
        return count[end] > count[start]

    letter = having(_LOWER | _UPPER | _BEYOND)
    distinct, top = _distinct(doc, sym, n)
    next_same = np.zeros(len(doc), bool)
    if len(doc) > 1:
        next_same[1:] = doc[1:] == doc[:-1]
    echo = next_same.copy()
    echo[1:] &= sym[1:] == sym[:-1]
    pair = np.flatnonzero(next_same)
    pair_kinds, _ = _distinct(doc[pair], sym[pair - 1] * np.uint64(3) + sym[pair], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)

    # lines with ink: (document, hash of the words between two line feeds, last byte of ink)
    feed = np.concatenate([[0], np.cumsum(raw == 10)])[start] if len(start) else np.zeros(0, np.int64)
    new = np.append(True, (feed[1:] != feed[:-1]) | (doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    line_doc = doc[heads]
    lines = _of(line_doc, n)
    if len(heads):
        nth = np.arange(len(doc)) - np.repeat(heads, np.diff(np.append(heads, len(doc))))
        line_key = np.add.reduceat(common.mix64(sym + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), heads)
        last = end[np.append(heads[1:], len(doc)) - 1] - 1
        line_kinds, _ = _distinct(line_doc, line_key, n)
        ended = _of(line_doc, n, _END[raw[last]])
    else:
        line_kinds = ended = np.zeros(n)
    few = np.maximum(lines, 1)
    columns = (
        np.log1p(size), np.log1p(words), _of(doc, n, length) / some, np.log1p(longest), hist @ _SPACES / total,
        *(hist @ k / ink for k in (_LOWER, _UPPER, _DIGIT, _BEYOND, _STOP, _SYMBOL)), entropy,
        _of(doc, n, _UPPER[raw[start]]) / some, _of(doc, n, having(_SYMBOL)) / some, _of(doc, n, having(_DIGIT)) / some, _of(doc, n, ~letter) / some, _of(doc, n, length == 1) / some,
        distinct / some, top / some, _of(doc, n, echo) / some, pair_kinds / np.maximum(words - 1, 1),
        np.log1p(lines), np.log1p(words / few), line_kinds / few, ended / few,
    )
    return np.stack(columns, axis=1)


# --------------------------------------------------------------------------- the model
def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of bins with gradients and weights; gain 0: none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl * _leaf(gl, hl) + gr * _leaf(gr, hr) - g.sum() * _leaf(g.sum(), h.sum())
    gain = np.where((hl >= least) & (hr >= least), gain, 0)
    if not len(gain) or gain.max() <= 1e-9:
        return 0.0, 0
    return float(gain.max()), int(gain.argmax()) + 1


def shallow(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> np.ndarray:
    """A tree of depth two over ordered bins, as an entry for each bin."""
    out = np.full(len(g), _leaf(g.sum(), h.sum()))
    gain, at = _cut(g, h, least)
    if gain:
        for part in (slice(0, at), slice(at, len(g))):
            more, mid = _cut(g[part], h[part], least)
            lo = part.start
            for leaf in (slice(lo, lo + mid), slice(lo + mid, part.stop)) if more else (part,):
                out[leaf] = _leaf(g[leaf].sum(), h[leaf].sum())
    return out


def crossed(g: np.ndarray, h: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
    """(gain, table): the best tree of depth two over a grid of bins that cuts one feature, then the other on each side."""
    best, table = 0.0, np.full(g.shape, _leaf(g.sum(), h.sum()))
    whole = g.sum() * _leaf(g.sum(), h.sum())
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            gain, leaves = -whole, []
            for part in (slice(0, at), slice(at, len(a))):
                gs, hs = a[part].sum(axis=0), b[part].sum(axis=0)
                if hs.sum() < least:
                    break
                more, mid = _cut(gs, hs, least)
                gain += more + gs.sum() * _leaf(gs.sum(), hs.sum())
                leaves += [(part, slice(0, mid)), (part, slice(mid, None))] if more else [(part, slice(None))]
            else:
                if gain > best + 1e-9:
                    best, out = gain, np.zeros(a.shape)
                    for p, q in leaves:
                        out[p, q] = _leaf(a[p, q].sum(), b[p, q].sum())
                    table = out.T if turn else out
    return best, table


class Additive:
    """Lookup tables of single features and pairs: the sum of their entries is the log odds."""

    def __init__(self, base: float, edges: list[np.ndarray] | None = None):
        self.base, self.edges = base, edges or []
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.coarse: list[np.ndarray] = []
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]

    def odds(self, b: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(b[0]) if b else 0, self.base)
        for table, k in zip(self.tables, b):
            out += table[k]
        for (i, j), table in self.pairs.items():
            out += table[self.coarse[i][b[i]], self.coarse[j][b[j]]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.edges:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        return 1 / (1 + np.exp(-self.odds(self.bins(x))))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, rounds: int = ROUNDS, rate: float = RATE, bags: int = BAGS) -> "Additive":
        """The mean of ``bags`` fits, each of which keeps another seventh of the rows apart; the first one finds the pairs."""
        out = cls._fit(x, y, pairs, rounds, rate, 0)
        if len(y) >= 70 and y.min() < y.max():
            each = [out, *(cls._fit(x, y, list(out.pairs), rounds, rate, seed) for seed in range(1, bags))]
            out.tables = [sum(t) / bags for t in zip(*(m.tables for m in each))]
            out.pairs = {k: sum(m.pairs[k] for m in each) / bags for k in out.pairs}
        return out

    @classmethod
    def _fit(cls, x: np.ndarray, y: np.ndarray, pairs: int | list[tuple[int, int]], rounds: int, rate: float, seed: int) -> "Additive":
        """Cyclic boosting; a seventh of the rows says when to stop."""
        n = len(y)
        share = (y.sum() + 0.5) / (n + 1) if n else 0.5
        base = float(np.log(share / (1 - share)))
        if n < 2 or y.min() == y.max():
            return cls(base)
        edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="higher")) for k in range(x.shape[1])]
        model = cls(base, edges)
        b = model.bins(x)
        test = np.random.default_rng(seed).random(n) < 1 / 7 if n >= 70 else np.zeros(n, bool)
        learn = ~test
        odds = np.full(n, base)
        rows = [k[learn] for k in b]
        y_learn = y[learn].astype(float)

        def state() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-odds[learn]))
            return y_learn - p, p * (1 - p)

        def loss() -> float:
            part = test if test.any() else learn
            z = np.where(y[part] == 1, odds[part], -odds[part])
            return float(np.logaddexp(0, -z).mean())

        def boost(steps, keep) -> None:
            """Goes round the steps until the other rows have not gained for 30 rounds; the best round stays."""
            nonlocal odds
            best, since, saved = loss(), 0, ([t.copy() for t in keep], odds.copy())
            for _ in range(rounds):
                for step in steps:
                    step()
                now = loss()
                since += 1
                if now < best - 1e-6:
                    best, since, saved = now, 0, ([t.copy() for t in keep], odds.copy())
                elif since >= 30:
                    break
            for t, s in zip(keep, saved[0]):
                t[...] = s
            odds = saved[1]

        def single(k: int):
            def step() -> None:
                g, h = state()
                m = len(model.tables[k])
                add = rate * shallow(np.bincount(rows[k], g, m), np.bincount(rows[k], h, m))
                model.tables[k] += add
                odds[:] += add[b[k]]

            return step

        boost([single(k) for k in range(len(edges)) if len(edges[k])], model.tables)

        # coarser bins for pairs: neighbouring bins together, in parts of about equal numbers of rows
        for k, e in enumerate(edges):
            before = np.cumsum(np.bincount(b[k], minlength=len(e) + 1)) - np.bincount(b[k], minlength=len(e) + 1)
            model.coarse.append(np.unique(before * PAIR_BINS // n, return_inverse=True)[1])
        many = [int(c.max()) + 1 for c in model.coarse]
        g, h = state()

        def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
            at = model.coarse[i][rows[i]] * many[j] + model.coarse[j][rows[j]]
            return np.bincount(at, v, many[i] * many[j]).reshape(many[i], many[j])

        if isinstance(pairs, int):
            gains = sorted((-crossed(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(len(edges)) for j in range(i) if many[i] > 1 and many[j] > 1)
            pairs = [(i, j) for gain, i, j in gains[:pairs] if gain < -LEAST_GAIN]
        model.pairs = {(i, j): np.zeros((many[i], many[j])) for i, j in pairs}

        def both(i: int, j: int):
            def step() -> None:
                g, h = state()
                add = rate * crossed(grid(i, j, g), grid(i, j, h))[1]
                model.pairs[i, j] += add
                odds[:] += add[model.coarse[i][b[i]], model.coarse[j][b[j]]]

            return step

        rounds = max(1, rounds // 4)
        boost([both(i, j) for i, j in model.pairs], list(model.pairs.values()))
        return model


# --------------------------------------------------------------------------- on tables
def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


@common.trimmed
def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            x = features(*common.buffers(b.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch([b.column(0), flat], ["q", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", sample: int = SAMPLE) -> Additive:
    """The model, from at most ``sample`` labelled rows that are not held out."""
    common.ship(docs.sparkSession)
    i = F.col(label_id).cast("long")
    marks = labels.where(~held_out(i) & i.isNotNull() & F.col(label_col).isin(0, 1)).groupBy(i.alias("i")).agg(F.min(label_col).alias("q"), F.max(label_col).alias("_other")).where("q = _other")
    chosen = marks.select("i", "q").orderBy(F.xxhash64("i", F.lit(11)), "i").limit(sample)  # so few that they may be sent to all tasks
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = one.join(F.broadcast(chosen), "i").select(F.col("q").cast("int").alias("q"), "t")
    rows = rows.mapInArrow(_featured, "q int, x array<double>")
    got = rows.orderBy(F.xxhash64("x", "q", F.lit(12)), "q").limit(sample).collect()
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return Additive.fit(x, np.array([r.q for r in got], int))


@common.trimmed
def _scored(batches: Iterator[pa.RecordBatch], model: Additive, threshold: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            score = model.score(features(*common.buffers(b.column(1))))
            yield pa.record_batch([b.column(0), b.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["i", "held_out", "score", "predicted"])


def scored(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    i = F.col(id_col).cast("long")
    one = docs.select(i.alias("i"), F.col(text_col).alias("t"), held_out(i).alias("held_out"))
    return one.mapInArrow(lambda it: _scored(it, shared.value, threshold), "i long, held_out boolean, score double, predicted int").withColumnRenamed("i", id_col)


def op11_quality(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; the defined cases are those of the module."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, learn(docs, common.table(spark, sf_dir, "labels")))
