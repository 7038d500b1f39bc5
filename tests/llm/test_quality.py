import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from zonalis.llm import common
from zonalis.llm import quality as ql


def of(texts):
    return ql.features(*common.buffers(pa.array(texts, pa.string())))


def test_features_are_what_their_names_say():
    texts = ["Ab ab ab. c1 $$\nAb ab ab. c1 $$\n\nÉtat", None, "", "   \n", "a" * 9000 + " b", "x x x x"]
    x = of(texts)
    assert x.shape == (6, len(ql.FEATURES)) and np.isfinite(x).all() and not x[1:3].any()
    f = lambda k, name: x[k][ql.FEATURES.index(name)]
    words = texts[0].split()
    assert np.isclose(f(0, "log_words"), np.log1p(len(words))) and np.isclose(f(0, "log_lines"), np.log1p(3))
    assert np.isclose(f(0, "distinct_words"), len(set(words)) / len(words)) and np.isclose(f(0, "top_word"), 2 / len(words))
    pairs = list(zip(words, words[1:]))
    assert np.isclose(f(0, "distinct_pairs"), len(set(pairs)) / len(pairs)) and np.isclose(f(0, "distinct_lines"), 2 / 3)
    assert np.isclose(f(0, "symbol_words"), 2 / len(words)) and np.isclose(f(0, "bare_words"), 2 / len(words)) and np.isclose(f(0, "ended_lines"), 0)
    assert np.isclose(f(5, "echoes"), 3 / 4) and np.isclose(f(4, "longest_word"), np.log1p(9000))
    # a text's features do not depend on its neighbours
    assert np.allclose(x, np.vstack([of([t]) for t in texts]))


def test_trees_are_the_best_of_depth_two():
    g = np.random.default_rng(5)
    leaf = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
    for _ in range(20):
        a, b = g.normal(size=9), g.random(9) + 1
        gain, at = ql._cut(a, b, 0.5)
        want = max(leaf(a[:k], b[:k]) + leaf(a[k:], b[k:]) - leaf(a, b) for k in range(1, 9))
        assert np.isclose(gain, max(want, 0)) and (gain == 0 or np.isclose(leaf(a[:at], b[:at]) + leaf(a[at:], b[at:]) - leaf(a, b), want))
        assert len(np.unique(ql.shallow(a, b, 0.5))) <= 4
    a, b = np.array([[3.0, -3.0], [-3.0, 3.0]]), np.full((2, 2), 2.0)
    assert np.allclose(ql.crossed(a, b)[1], a / 3)


def test_pairs_learn_what_single_features_cannot():
    g = np.random.default_rng(1)
    x = g.normal(size=(3000, 4))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(int)
    model = ql.Additive.fit(x[:2000], y[:2000], pairs=2)
    assert (3, 1) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95


def test_tables_add_up():
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 3))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(int)
    m = ql.Additive.fit(x, y)
    for row in range(20):
        b = [int(np.sum(e <= x[row, k])) for k, e in enumerate(m.edges)]
        z = m.base + sum(t[k] for t, k in zip(m.tables, b)) + sum(t[m.coarse[i][b[i]], m.coarse[j][b[j]]] for (i, j), t in m.pairs.items())
        assert np.isclose(m.score(x[row : row + 1])[0], 1 / (1 + np.exp(-z)))


def test_held_out_documents_of_the_whole_table(spark):
    path = "/root/testdata/sf0.1"
    want = dict(duckdb.sql(f"select doc_id, quality from '{path}/labels.parquet'").fetchall())
    got = ql.op11_quality(spark, path).collect()
    assert len(got) == duckdb.sql(f"select count(*) from '{path}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    judged = [(r.predicted, want[r.doc_id]) for r in got if r.held_out and r.doc_id in want]
    assert len(judged) > 600 and np.mean([a == b for a, b in judged]) > 0.95
    for mark in (0, 1):
        assert np.mean([a == b for a, b in judged if b == mark]) >= 0.97


def test_defined_cases(spark):
    rows = [(k, f"Words of a plain text, number {k}, go on and on. They end." if k % 2 else "$$$ %%% " * (k % 7 + 1), 1, "x") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, q string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(1, 1), (3, 0), (None, 0), (5, None), (7, 9)], "doc_id long, quality int")
    m = ql.learn(docs, marks)
    odd = spark.createDataFrame([(900, None, 1, "x"), (901, "", 1, "x"), (None, "a", 1, "x"), (902, "word " * 300_000, 1, "x"), (1, rows[1][1], 1, "x"), (1, rows[1][1], 1, "x")], docs.schema)
    got = ql.scored(docs.unionByName(odd), m).collect()
    assert len(got) == 406 and len([r for r in got if r.doc_id == 1]) == 3
    by = {r.doc_id: r for r in got}
    assert by[900].score == by[901].score and by[None].held_out is False
    assert by[1].predicted == 1 and by[2].predicted == 0
    assert ql.scored(docs.limit(0), m).count() == 0
    none = ql.learn(docs, marks.limit(0))
    assert {r.score for r in ql.scored(odd, none).collect()} == {0.5}
    assert ql.scored(odd, ql.learn(docs, marks.where("quality = 1"))).first().score > 0.5


@pytest.mark.parametrize("sample", [50])
def test_the_sample_is_bounded_and_repeatable(spark, sample, monkeypatch):
    seen = []
    fit = ql.Additive.fit.__func__
    monkeypatch.setattr(ql.Additive, "fit", classmethod(lambda cls, x, y: seen.append(x) or fit(cls, x, y)))
    path = "/root/testdata/sf0.001"
    docs, marks = common.table(spark, path, "documents"), common.table(spark, path, "labels")
    for part in (docs, docs.repartition(7)):
        ql.learn(part, marks, sample=sample)
    assert len(seen[0]) == sample and np.array_equal(seen[0], seen[1])
