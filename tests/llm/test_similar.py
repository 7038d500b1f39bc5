import random

import duckdb

import corpus_pipeline
from zonalis.llm import common, simhash

SF = "/root/testdata/sf0.001"


def runs(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept(rows):
    """Ids of the first of each group, by comparing all pairs."""
    sets = [runs(t) for _, t in rows]
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                comp[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = find(i)
        least[r] = k if r not in least else min(k, least[r])
    return sorted(least.values())


def fixture():
    r = random.Random(8)
    rows = [(900, None), (901, ""), (902, "one two"), (903, "ONE\x0ctwo"), (904, "two one")]
    for i in range(40):
        base = ["w%d" % r.randrange(900) for _ in range(r.randrange(20, 500))]
        rows.append((1000 + i * 10, " ".join(base)))
        for k in range(1, r.randrange(2, 6)):
            x = list(base)
            for _ in range(r.randrange(1, 2 + len(base) // 30)):
                x[r.randrange(len(x))] = "new%d" % r.randrange(900)
            rows.append((1000 + i * 10 + k, "  ".join(x)))
    r.shuffle(rows)
    return rows


def test_groups_against_all_pairs(spark):
    rows = fixture()
    want = kept(rows)
    assert 45 < len(want) < len(rows) - 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for caps in ({}, {"cap": 2, "cap_runs": 300}):
        assert sorted(x.doc_id for x in simhash.one_of_each(df, **caps).collect()) == want
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_the_stage_keeps_one_of_texts_that_share_four_fifths(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, common.table(spark, SF, "documents"), SF).collect())
    assert got == kept(rows)


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, "one two three four five six", 1, 2, 3, "k", 5), (2, "one two three four five six", 1, 2, 3, "k", 5), (None, None, 1, 2, 3, "x", 5), (2, "other", 1, 2, 3, "k", 5), (2, "other", 1, 2, 3, "k", 5)], "doc_id long, text string, a int, r int, row int, k string, n int")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "one two three four five six", 1, 2, 3, "k", 5), (None, None, 1, 2, 3, "x", 5), (2, "other", 1, 2, 3, "k", 5)]))


def test_wide_fingerprints_against_plain_counts():
    import numpy as np

    g = np.random.default_rng(6)
    sets = [np.unique(g.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 2, 3, 254, 255, 256, 511, 3000)]
    got = simhash.wide_prints(np.concatenate(sets), np.array([len(s) for s in sets]))
    for s, fp in zip(sets, got):
        for w in range(2):
            h = [int(common.mix64(np.array([x ^ simhash._XOR[w]]))[0]) for x in s]
            want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))
            assert int(fp[w]) == want


def test_a_long_text_links_with_its_copy(spark):
    r = random.Random(5)
    base = ["w%d" % r.randrange(10**6) for _ in range(120_000)]
    near = list(base)
    for k in range(0, 120_000, 400):
        near[k] = "other"
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(base[60_000:]))], "doc_id long, text string")
    assert sorted(x.doc_id for x in simhash.one_of_each(df).collect()) == [1, 3]
    got = {x.doc_id: x.fingerprint for x in simhash.near_duplicates(df).collect()}
    assert len(got) == 3 and int(got[1], 16) == simhash.fingerprint(" ".join(base))
