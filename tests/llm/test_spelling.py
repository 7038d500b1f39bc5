import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from zonalis.llm import spelling as sp

COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_apart(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, compare=one_apart):
    """Rows by the definition, all pairs of words."""
    words = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if compare(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items())


def rows(df):
    assert df.columns == COLUMNS
    return sorted(tuple(r) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, w string")


def test_whole_table_is_what_its_sql_gives(spark):
    path = "/root/testdata/sf0.01"
    duckdb.sql(f"create or replace view documents as select * from '{path}/documents.parquet'")
    want = duckdb.sql(sp.OP13_SQL)
    at = [want.columns.index(c) for c in COLUMNS]
    want = sorted(tuple(r[k] for k in at) for r in want.fetchall())
    got = rows(sp.op13_spelling(spark, path))
    assert got == want and len(got) > 1000 and sum(r[4] > 0 for r in got) > 100


@pytest.mark.parametrize("limit", [sp.LIMIT, 4])
def test_random_words_are_what_all_pairs_give(spark, limit):
    """Few letters, so that near words, runs of one letter and large groups are many; with a low limit groups are halved."""
    g = random.Random(limit)
    word = lambda: "".join(g.choice("aabÿ") for _ in range(g.randrange(6, 11)))
    words = [word() for _ in range(350)]
    docs = [(k, " ".join(g.choice(words) if g.random() < 0.7 else words[0] for _ in range(120))) for k in range(60)]
    want = brute(docs)
    assert sum(r[4] for r in want) > 200
    assert rows(sp.variants(frame(spark, docs).repartition(3), limit=limit)) == want


def test_chains_of_forms(spark):
    """Three steps of ten times the count each, a tie of forms, and a count that just is not ten times."""
    words = {"aaaaaaa": 1, "aaaaaab": 1, "ccccccc": 3, "cccccccd": 29, "eeeeeee": 3, "eeeeeef": 30, "eeeeegf": 300, "eeeehgf": 3000}
    docs = [(None, " ".join(" ".join([w] * n * 2) for w, n in words.items()))]
    got = {r[0]: r for r in rows(sp.variants(frame(spark, docs)))}
    assert sorted(got.values()) == brute(docs)
    assert got["eeeeeee"][2] == "eeeehgf" and got["ccccccc"][1] is None
    tied = [(None, " ".join(["zzzzzzz"] * 2 + ["zzzzzza"] * 40 + ["zzzzzzÿ"] * 40))]
    assert next(r for r in rows(sp.variants(frame(spark, tied))) if r[0] == "zzzzzzz")[1] == "zzzzzza"


def test_rectangles():
    g = np.random.default_rng(3)
    for n in (1, 2, 3, 8, 37):
        p = g.permutation(n)
        tree = sp.Wavelet(p)
        lo, hi = np.sort(g.integers(0, n + 1, (2, 40)), axis=0)
        low, high = np.sort(g.integers(0, n + 1, (2, 40)), axis=0)
        q, v = tree.report(lo, hi, low, high)
        want = sorted((k, x) for k in range(40) for x in p[lo[k] : hi[k]].tolist() if low[k] <= x < high[k])
        assert sorted(zip(q.tolist(), v.tolist())) == want


def test_groups_of_any_size_have_each_pair_once(spark):
    """All words of seven letters from two, and their neighbours: a third of the pairs would meet in one half."""
    words = ["".join("ab"[k >> b & 1] for b in range(7)) for k in range(128)] + ["aaaaaaaa", "abababab", "a" * 40, "a" * 41]
    df = spark.createDataFrame([(w, 5) for w in words], "w string, n long")
    want = sorted((a, b, 5) for a in words for b in words if one_apart(a, b))
    for limit, cells in ((1000, sp.CELLS), (3, 64), (1, 1)):
        assert sorted(tuple(r) for r in sp.near_words(df, limit, cells).collect()) == want, limit
        sizes = sp.grouped(df, limit).where("first < last").groupBy("key").count().agg({"count": "max"}).first()[0] or 0
        assert sizes <= limit


def test_defined_cases(spark):
    long = "ab" * 30_000
    docs = [(1, None), (2, ""), (3, "short words only"), (4, "Words WORDSÉ wordsé wordsÉ"), (4, "wordsand wordsand"), (4, "wordsand wordsand"), (None, "wordsand wordsend wordsend"), (5, f"{long} {long}"), (6, f"{long}c {long}c"), (7, "a×÷bcdefg " * 3), (8, "x" * 7 + "1" + "x" * 7), (9, "naïveté́ naïveté " * 2)]
    # the plain comparison is quadratic in the length: long words are compared by their ends here
    apart = lambda a, b: one_apart(a, b) if len(a) < 100 or len(b) < 100 else {a, b} == {long, long + "c"}
    got = rows(sp.variants(frame(spark, docs)))
    want = brute(docs, apart)
    assert got == want and any(r[0] == long and r[4] == 1 for r in got)
    assert rows(sp.variants(frame(spark, docs).limit(0))) == []
