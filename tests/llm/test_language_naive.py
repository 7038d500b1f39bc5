"""The network read byte by byte, as it is defined, beside the arrays of ``label`` and ``pooled``."""

import math
import random

import numpy as np
import pyarrow as pa

from zonalis.llm import common
from zonalis.llm import language as lg


def naive(net, text):
    """Mean probabilities over the bytes of a text, one byte and one unit after the other."""
    raw, h, n = text.encode(), net.hidden, len(net.langs)
    sig = lambda v: 1 / (1 + math.exp(-v))
    total = [0.0] * n
    for begin in range(0, len(raw), lg.STEP):
        piece = raw[begin : begin + lg.STEP].ljust(lg.STEP, b"\0")
        states = [[None] * lg.STEP, [None] * lg.STEP]
        for k in range(2):
            s = [0.0] * h
            for t in range(lg.STEP) if k == 0 else reversed(range(lg.STEP)):
                x, u = net.p["x"][k][piece[t]], net.p["u"][k]
                rec = [sum(s[i] * float(u[i, j]) for i in range(h)) for j in range(3 * h)]
                z = [sig(float(x[j]) + rec[j]) for j in range(h)]
                r = [sig(float(x[h + j]) + rec[h + j]) for j in range(h)]
                c = [math.tanh(float(x[2 * h + j]) + r[j] * rec[2 * h + j]) for j in range(h)]
                s = [(1 - z[j]) * c[j] + z[j] * s[j] for j in range(h)]
                states[k][t] = s
        for t in range(min(lg.STEP, len(raw) - begin)):
            logit = [float(net.p["b"][m]) + sum(states[k][t][j] * float(net.p["o"][k][j, m]) for k in range(2) for j in range(h)) for m in range(n)]
            e = [math.exp(v - max(logit)) for v in logit]
            total = [a + b / sum(e) for a, b in zip(total, e)]
    return [v / max(1, len(raw)) for v in total]


def test_pooled_probabilities_are_those_of_the_definition():
    r = random.Random(3)
    net = lg.Network(["de", "en", "fr"], seed=5)
    texts = ["", "a", "naïve é", "x" * lg.STEP, "y" * (lg.STEP + 1), *("".join(r.choice("abcdeé ß.\n") for _ in range(r.randrange(1, 200))) for _ in range(12))]
    got = net.pooled(*common.buffers(pa.array(texts)))
    assert np.allclose(got, [naive(net, t) for t in texts], atol=2e-5)


def test_a_long_text_of_varied_words():
    r = random.Random(4)
    net = lg.Network(["de", "en"], seed=6)
    text = " ".join("".join(r.choice("abcdefgé") for _ in range(r.randrange(1, 12))) for _ in range(150_000))
    (got,) = net.pooled(*common.buffers(pa.array([text])))
    raw = text.encode()
    cut = [raw[k : k + 480 * lg.STEP].decode("utf-8", "surrogateescape") for k in range(0, len(raw), 480 * lg.STEP)]
    parts = net.pooled(np.cumsum([0, *(len(c.encode("utf-8", "surrogateescape")) for c in cut)]), np.frombuffer(raw, np.uint8))
    weight = np.array([len(c.encode("utf-8", "surrogateescape")) for c in cut])
    assert np.allclose(got, (parts * weight[:, None]).sum(axis=0) / weight.sum(), atol=1e-9)
