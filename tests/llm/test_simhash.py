import random

import numpy as np
import xxhash

from zonalis.llm import simhash


def brute(texts):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\x09\x0a\x0b\x0c\x0d":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    return out


def classes(ids, fps, radius=4):
    comp = list(range(len(ids)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                comp[find(i)] = find(j)
    roots = [find(i) for i in range(len(ids))]
    return [min((ids[j] for j in range(len(ids)) if roots[j] == r and ids[j] is not None), default=None) for r in roots]


def fixture():
    r = random.Random(5)
    voc = ["w%d" % i for i in range(300)] + ["É", "Straße", "a b", "X\x0b"]
    rows = [(1000, None), (3, ""), (2, " \n"), (7, "one"), (8, "ONE"), (9, "one two three"), (10, "one\x0ctwo\rthree"), (None, "one")]
    for i in range(20, 60):
        base = [r.choice(voc) for _ in range(r.randrange(30, 400))]
        rows.append((i, " ".join(base)))
        for _ in range(r.randrange(4)):
            x = list(base)
            for _ in range(r.randrange(3)):
                x[r.randrange(len(x))] = r.choice(voc)
            rows.append((r.randrange(10**6), "  ".join(x)))
    rows += rows[10:14]
    return rows


def test_fingerprints_and_components_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, id string")
    got = [tuple(x) for x in simhash.near_duplicates(df).collect()]
    fps = brute([t for _, t in rows])
    want = [(i, f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, classes([i for i, _ in rows], fps))]
    assert sorted(got, key=str) == sorted(want, key=str)
    small = [tuple(x) for x in simhash.near_duplicates(df, cap=2).collect()]
    assert sorted(small, key=str) == sorted(got, key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_bit_planes_find_exactly_the_near_pairs():
    g = np.random.default_rng(3)
    a = g.integers(0, 2**63, 300, dtype=np.uint64)
    b = a.copy()
    for i in range(300):
        for bit in g.choice(64, i % 9, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    for radius in (0, 1, 3, 4, 7):
        want = np.array([bin(int(x ^ y)).count("1") <= radius for x, y in zip(a, b)])
        assert (simhash.pairs_within(a, b, radius) == want).all()
