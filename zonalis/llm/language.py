"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 in stretches of ``STEP`` bytes, forwards and backwards, labels every byte
with probabilities of languages, and a document's probabilities are their mean over all its bytes. It is
trained in numpy by backpropagation through time, on stretches of at most ``PER_LANG`` documents of each
language (a documented bound; they are chosen by a hash of the id, from all documents of the learning part).

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if there is
nothing to learn from; repeated rows and ids are kept; a null id stays null and is not learned from; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

STEP, HIDDEN, PER_LANG, STRETCHES, ROUNDS, BATCH = 48, 8, 300, 6, 8, 192
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Network:
    """One gated recurrent layer in each direction, and a softmax over both."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1):
        g = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        f = lambda *s, k: (g.normal(size=s) * k).astype(np.float32)
        # per direction: inputs to gates z, r and candidate n for each byte; recurrent weights; output weights
        self.p = {"x": f(2, 256, 3 * hidden, k=0.3), "u": f(2, hidden, 3 * hidden, k=hidden**-0.5), "o": f(2, hidden, len(langs), k=0.3), "b": np.zeros(len(langs), np.float32)}

    # ---------------------------------------------------------------- training
    def _gradient(self, text: np.ndarray, lang: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean log-likelihood of all labelled bytes: text (n, steps), lang (n)."""
        p, h = self.p, self.hidden
        n, steps = text.shape
        seq = np.stack([text, text[:, ::-1]])
        states = [np.zeros((2, n, h), np.float32)]
        gates = []
        side = np.arange(2)[:, None]
        for t in range(steps):
            x, rec = p["x"][side, seq[:, :, t]], states[-1] @ p["u"]
            zr = _sigmoid(x[..., : 2 * h] + rec[..., : 2 * h])
            z, r, un = zr[..., :h], zr[..., h:], rec[..., 2 * h :]
            c = np.tanh(x[..., 2 * h :] + r * un)
            states.append(c + z * (states[-1] - c))
            gates.append((z, r, un, c))
        front = np.stack([s[0] for s in states[1:]], axis=1)
        back = np.stack([s[1] for s in states[1:]], axis=1)[:, ::-1]
        logit = front @ p["o"][0] + back @ p["o"][1] + p["b"]
        e = np.exp(logit - logit.max(axis=2, keepdims=True))
        d = -e / e.sum(axis=2, keepdims=True)
        d[np.arange(n), :, lang] += 1
        d *= (mask / mask.sum())[..., None]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        flat = d.reshape(-1, d.shape[2])
        grad["b"] = flat.sum(axis=0)
        grad["o"] = np.stack([front.reshape(-1, h).T @ flat, back.reshape(-1, h).T @ flat])
        down = np.stack([d @ p["o"][0].T, (d @ p["o"][1].T)[:, ::-1]])
        dh = np.zeros((2, n, h), np.float32)
        for t in range(steps - 1, -1, -1):
            z, r, un, c = gates[t]
            dh = dh + down[:, :, t]
            dc = dh * (1 - z) * (1 - c * c)
            dz = dh * (states[t] - c) * z * (1 - z)
            dr = dc * un * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=2)
            drec = np.concatenate([dz, dr, dc * r], axis=2)
            grad["u"] += states[t].transpose(0, 2, 1) @ drec
            for k in range(2):
                order = np.argsort(seq[k, :, t], kind="stable")
                byte, first = np.unique(seq[k, order, t], return_index=True)
                grad["x"][k, byte] += np.add.reduceat(dx[k, order], first, axis=0)
            dh = dh * z + drec @ p["u"].transpose(0, 2, 1)
        return grad

    def fit(self, text: np.ndarray, lang: np.ndarray, mask: np.ndarray, rounds: int = ROUNDS, rate: float = 0.02, seed: int = 2) -> "Network":
        g = np.random.default_rng(seed)
        m = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, total = 0, rounds * -(-len(text) // BATCH)
        for _ in range(rounds):
            order = g.permutation(len(text))
            for a in range(0, len(text), BATCH):
                part = order[a : a + BATCH]
                step += 1
                lr = rate * (1 - step / (total + 1)) + 1e-4
                for k, d in self._gradient(text[part], lang[part], mask[part]).items():
                    m1, m2 = m[k]
                    m1 += 0.1 * (d - m1)
                    m2 += 0.01 * (d * d - m2)
                    self.p[k] += lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-7)
        return self

    # ---------------------------------------------------------------- labelling
    def label(self, text: np.ndarray) -> np.ndarray:
        """Probabilities (n, steps, languages) of every byte of stretches (n, steps)."""
        p, h = self.p, self.hidden
        n, steps = text.shape
        out = np.empty((steps, n, len(self.langs)), np.float32)
        columns = np.ascontiguousarray(text.T)
        for k in range(2):
            # gates apart, so that all rows are contiguous; signs and factors of the sigmoids are in the weights
            scale = (-1, -1, -2)
            tables = [np.ascontiguousarray(p["x"][k][:, g * h : (g + 1) * h]) * np.float32(scale[g]) for g in range(3)]
            us = [np.ascontiguousarray(p["u"][k][:, g * h : (g + 1) * h]) * np.float32(scale[g]) for g in range(3)]
            o, state = p["o"][k], np.zeros((n, h), np.float32)
            z, r, c, x = (np.empty((n, h), np.float32) for _ in range(4))
            y = np.empty((n, len(self.langs)), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                byte = columns[t]
                for gate, table, u in ((z, tables[0], us[0]), (r, tables[1], us[1])):
                    np.take(table, byte, axis=0, out=x, mode="clip")
                    np.matmul(state, u, out=gate)
                    gate += x
                    np.exp(gate, out=gate)
                    gate += 1
                np.take(tables[2], byte, axis=0, out=x, mode="clip")
                np.matmul(state, us[2], out=c)
                c /= r
                c += x
                np.exp(c, out=c)  # tanh(v) = 2 / (1 + exp(-2v)) - 1
                c += 1
                np.divide(2, c, out=c)
                c -= 1
                state -= c
                state /= z
                state += c
                if k == 0:
                    np.matmul(state, o, out=out[t])
                else:
                    out[t] += np.matmul(state, o, out=y)
        out += p["b"]
        out -= out.max(axis=2, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=2, keepdims=True)
        return out.transpose(1, 0, 2)

    def stretches(self, off: np.ndarray, raw: np.ndarray, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each, real bytes, probabilities) of all stretches of many texts, whole texts end to end."""
        size = np.diff(off)
        count = -(-size // STEP)
        doc = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        begin, left = off[doc] + nth * STEP, size[doc] - nth * STEP
        for a in range(0, len(doc), at_once):
            b, n = begin[a : a + at_once], np.minimum(left[a : a + at_once], STEP)
            real = np.arange(STEP) < n[:, None]
            text = np.where(real, raw[np.minimum(b[:, None] + np.arange(STEP), len(raw) - 1)], 0).astype(np.uint8)
            yield doc[a : a + at_once], real, self.label(text)

    def pooled(self, off: np.ndarray, raw: np.ndarray) -> np.ndarray:
        """Mean probabilities (texts, languages) over all bytes."""
        total = np.zeros((len(off) - 1, len(self.langs)))
        for doc, real, prob in self.stretches(off, raw):
            np.add.at(total, doc, np.einsum("ntk,nt->nk", prob, real.astype(np.float32), dtype=np.float64))
        return total / np.maximum(np.diff(off), 1)[:, None]

    def runs(self, text: str) -> list[tuple[int, int, str]]:
        """(first byte, end, language) of the runs of equally labelled bytes of a text."""
        raw = np.frombuffer(text.encode(), np.uint8)
        if not len(raw):
            return []
        best = np.concatenate([prob.argmax(axis=2)[real] for _, real, prob in self.stretches(np.array([0, len(raw)]), raw)])
        cut = np.flatnonzero(np.diff(best, prepend=-1))
        return [(int(a), int(b), self.langs[best[a]]) for a, b in zip(cut, np.append(cut[1:], len(best)))]


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@common.trimmed
def _predict(batches: Iterator[pa.RecordBatch], net: Network | None) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            off, raw = common.buffers(b.column(1))
            n = len(off) - 1
            lang, score = ["und"] * n, np.zeros(n)
            if net is not None and len(raw):
                prob = net.pooled(off, raw)
                best = prob.argmax(axis=1)
                ascii_letters = np.concatenate([[0], np.cumsum(_LETTER[raw])])
                plain = ascii_letters[off[1:]] > ascii_letters[off[:-1]]
                for i in range(n):
                    if plain[i] or _has_letter(b.column(1)[i].as_py() or ""):
                        lang[i], score[i] = net.langs[best[i]], min(1.0, prob[i, best[i]])
            yield pa.record_batch([b.column(0), b.column(2), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["i", "held_out", "lang_pred", "score"])


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """The network, from the text and language of documents that are not held out; None if there are none."""
    i, t = F.col(id_col).cast("long"), F.col(text_col)
    part = docs.where(~held_out(i) & i.isNotNull() & F.col(lang_col).isNotNull() & t.isNotNull()).select(i.alias("i"), t.alias("t"), F.col(lang_col).alias("lang"), F.xxhash64(i, F.lit(3)).alias("h"))
    counts = {r.lang: r.n for r in part.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # so small a share of the hash's range that about 1.5 times the bound is chosen; the bound is kept below
    share = F.lit(False)
    for lang, n in counts.items():
        top = int(min(1.0, 1.5 * per_lang / n) * (2**63 - 1))
        share = share | ((F.col("lang") == lang) & (F.abs(F.shiftright("h", 1)) <= top // 2))
    size = F.length("t")
    some = [F.substring("t", F.pmod(F.xxhash64("i", F.lit(100 + k)), F.greatest(size - STEP + 1, F.lit(1)).cast("long")).cast("int") + 1, F.lit(STEP)) for k in range(STRETCHES)]
    rows = sorted((r.lang, r.h, r.i, r.s) for r in part.where(share).select("lang", "h", "i", F.array(*some).alias("s")).collect())
    langs = sorted(counts)
    taken = dict.fromkeys(langs, 0)
    text, label = [], []
    for lang, _, _, parts in rows:
        if taken[lang] < per_lang:
            taken[lang] += 1
            text += [s.encode()[:STEP] for s in parts]
            label += [langs.index(lang)] * len(parts)
    if not text:
        return None
    raw = np.frombuffer(b"".join(s.ljust(STEP, b"\0") for s in text), np.uint8).reshape(-1, STEP)
    mask = (np.arange(STEP) < np.array([max(1, len(s)) for s in text])[:, None]).astype(np.float32)
    return Network(langs).fit(raw, np.array(label), mask)


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    i = F.col(id_col).cast("long")
    one = docs.select(i.alias("i"), F.col(text_col).alias("t"), held_out(i).alias("held_out"))
    return one.mapInArrow(lambda it: _predict(it, shared.value), "i long, held_out boolean, lang_pred string, score double").withColumnRenamed("i", id_col)


@common.trimmed
def _confident(batches: Iterator[pa.RecordBatch], column: int, net: Network | None, least: float) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, whole.schema.names[column]):
            plain = pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column(column), pa.nulls(b.num_rows, pa.bool_())], ["i", "t", "h"])
            for got in _predict(iter([plain]), net):
                keep = (np.asarray(got.column(3)) >= least) & (np.array(got.column(2).to_pylist()) != "und")
                yield b.filter(pa.array(keep))


def confident(docs: DataFrame, net: Network | None, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """All columns of the rows whose language is found with a score of ``least`` or more."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _confident(it, at, shared.value, least), docs.schema)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, learn(docs))
