import zlib

import duckdb
import numpy as np

from zonalis.llm import language as lg


def loss(net, text, lang, mask):
    prob = net.label(text)
    return float((np.log(prob[np.arange(len(text)), :, lang]) * mask).sum() / mask.sum())


def test_backpropagation_is_the_gradient():
    g = np.random.default_rng(4)
    net = lg.Network(["a", "b", "c"], hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, lang = g.integers(0, 6, (5, 7)).astype(np.uint8), g.integers(0, 3, 5)
    mask = (np.arange(7) < g.integers(2, 8, 5)[:, None]).astype(float)
    grad = net._gradient(text, lang, mask)
    for k, v in net.p.items():
        for _ in range(12):
            at = tuple(g.integers(0, s) for s in v.shape)
            if k == "x":
                at = (at[0], int(g.integers(0, 6)), at[2])
            keep, eps = v[at], 1e-2
            v[at] = keep + eps
            up = loss(net, text, lang, mask)
            v[at] = keep - eps
            down = loss(net, text, lang, mask)
            v[at] = keep
            assert abs((up - down) / (2 * eps) - grad[k][at]) < 2e-3, (k, at)


def test_held_out_accuracy_on_the_whole_table(spark):
    path = "/root/testdata/sf0.01"
    want = dict(duckdb.sql(f"select doc_id, lang from '{path}/documents.parquet'").fetchall())
    got = lg.op4_language(spark, path).collect()
    assert len(got) == len(want)
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) and 0 <= x.score <= 1 for x in got)
    right = [x.lang_pred == want[x.doc_id] for x in got if x.held_out]
    assert len(right) > 200 and np.mean(right) > 0.97


def test_defined_cases(spark):
    sample = duckdb.sql("select doc_id, text, lang from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    df = spark.createDataFrame([(i, t, x, 1, "s") for i, t, x in sample], "doc_id long, text string, lang string, score int, lang_pred string")
    net = lg.learn(df)
    odd = [None, "", "12 34 !?", "\n", "é", "x", "the " * 50_000]
    more = spark.createDataFrame([(9000 + i, t, None, 1, "s") for i, t in enumerate(odd)] + [(None, "the of and", None, 1, "s"), (1, "the of and", "de", 1, "s")], df.schema)
    got = {x.doc_id: x for x in lg.identify(more, net).collect()}
    assert [(got[9000 + i].lang_pred, got[9000 + i].score) for i in range(4)] == [("und", 0.0)] * 4
    assert all(got[9000 + i].lang_pred in net.langs for i in (4, 5, 6)) and got[None].held_out is False
    assert got[9006].lang_pred == "en"
    assert lg.identify(more.limit(0), net).count() == 0
    assert lg.learn(df.limit(0)) is None and {x.lang_pred for x in lg.identify(more, None).collect()} == {"und"}
    runs = net.runs(sample[0][1])
    assert runs[0][0] == 0 and runs[-1][1] == len(sample[0][1].encode()) and all(a[1] == b[0] for a, b in zip(runs, runs[1:]))
