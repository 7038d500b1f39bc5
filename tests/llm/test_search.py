import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from zonalis.llm import common
from zonalis.llm import search as sr

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items):
    """(item, rank, doc, score) by the definition, all pairs."""
    read = [(i, Counter(TERM.findall((t or "").translate(FOLD)))) for i, t in docs]
    read = [(i, c, sum(c.values())) for i, c in read if c]
    n_docs, n_words = len(read), sum(n for *_, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item, text in items:
        want = Counter(TERM.findall((text or "").translate(FOLD)))
        scores = []
        for i, c, n in read:
            m = 75 + (25 * n * n_docs) // n_words
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in want.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:20])]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_whole_table_is_what_its_sql_gives(spark):
    path = "/root/testdata/sf0.01"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"create or replace view {name} as select * from '{path}/{name}.parquet'")
    want = duckdb.sql(sr.OP12_SQL).fetchall()
    got = sr.op12_search(spark, path)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert rows(got) == sorted(want, key=str) and len(want) == 800


@pytest.mark.parametrize("block", [4096, 7])
def test_random_tables_are_what_all_pairs_give(spark, monkeypatch, block):
    monkeypatch.setattr(sr, "CELLS", 300)
    g = random.Random(block)
    word = lambda: g.choice("abcdefghij") * g.choice((1, 1, 1, 2)) if g.random() < 0.8 else f"rare{g.randrange(60)}É"
    docs = [(g.randrange(500), " ".join(word() for _ in range(g.choice((0, 1, 5, 40, 300))))) for _ in range(700)]
    items = [(k, ", ".join(word() for _ in range(g.choice((0, 1, 3, 25))))) for k in range(30)]
    got = sr.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), block=block)
    assert rows(got) == brute(docs, items)


def test_items_fall_through_to_lower_tiers_and_stay_exact(spark, monkeypatch):
    g = random.Random(3)
    docs = [(k, " ".join(g.choice("abcdefghijklmnop") for _ in range(g.randrange(4, 60)))) for k in range(900)]
    items = [(0, "a b c d e f g h i j k l m n o p"), (1, "a"), (2, "b nothing"), (3, "nothing")]
    # one long document holds a word far more often than others: high impact, proven at once
    docs += [(1000 + k, "q " * (40 + k)) for k in range(300)]
    items.append((4, "q"))
    block = sr.Items(items)
    monkeypatch.setattr(sr, "RARE", 10**9)
    table, tiers = sr.index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block)
    found, proven = sr.search(table, tiers, block)
    assert sum(proven) == len(items) and proven[0] >= 2 and sum(proven[1:]) >= 1
    got = sorted(((r.item, r["rank"], r.d, r.score) for r in found.collect()), key=str)
    assert got == brute(docs, items)


def test_tiers_partition_postings_and_bounds_hold(spark):
    path = "/root/testdata/sf0.01"
    items = sr.Items([(r.item_id, r.text) for r in common.table(spark, path, "benchmark").collect()])
    table, tiers = sr.index(common.table(spark, path, "documents"), items)
    docs = duckdb.sql(f"select doc_id, text from '{path}/documents.parquet'").fetchall()
    sym = {int(s): k for k, s in enumerate(items.sym)}
    seen = 0
    for r in table.collect():
        terms = [t for k in range(sr.TIERS) for t in r[f"terms{k}"]]
        assert len(terms) == len(set(terms))
        seen += len(terms)
        for k in range(sr.TIERS):
            for t, impact in zip(r[f"terms{k}"], r[f"impacts{k}"]):
                assert all(impact <= tiers.below[j, t] for j in range(k)) and impact >= tiers.least[k, t]
    words = 0
    for _, text in docs:
        for t in set(TERM.findall(text.translate(FOLD))):
            raw = np.frombuffer(t.encode(), np.uint8)
            words += int(sr.symbols(np.array([0, len(raw)]), raw)[0][0]) in sym
    assert seen == words


def test_defined_cases(spark):
    docs = [(1, "alpha Beta gamma"), (1, "alpha beta gamma"), (1, "alpha beta gamma"), (None, "alpha beta gamma"), (0, None), (2, ""), (3, "... !"), (4, "alpha " * 200_000), (-5, "ALPHA beta gamma"), (6, "x y z")]
    items = [(7, "alpha ALPHA"), (7, "alpha ALPHA"), (None, "beta"), (8, None), (9, ""), (10, "unseen"), (11, "alpha" * 4)]
    d = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, score int, item_id int")
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    assert rows(sr.ranked(d, q)) == brute(docs, items)
    assert sr.ranked(d.limit(0), q).count() == 0 and sr.ranked(d, q.limit(0)).count() == 0
    # sums beyond what floats hold exactly take whole numbers
    many = [(1, "alpha " * 100_000 + "beta")]
    assert not sr.Items(many).exact
    assert rows(sr.ranked(d, spark.createDataFrame(many, "item_id long, text string"))) == brute(docs, many)
