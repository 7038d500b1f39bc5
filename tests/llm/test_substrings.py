import hashlib
import random

import numpy as np
import pytest

from zonalis.llm import common, substrings


def split(t):
    out, word = [], ""
    for c in (t or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def brute(rows, width):
    first = {}
    for d, t in rows:
        w = split(t)
        for i in range(len(w) - width + 1 if d is not None else 0):
            k = tuple(w[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return out


def fixture(seed=1):
    r = random.Random(seed)
    word = lambda: r.choice("the of and to".split()) if r.random() < 0.3 else "".join(r.choice("abcdeéß") for _ in range(r.randrange(1, 6)))
    text = lambda n: [word() for _ in range(n)]
    passages = [text(r.randrange(10, 60)) for _ in range(8)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(r.randrange(0, 5)):
            parts += text(r.randrange(0, 80))
            if r.random() < 0.5:
                parts += r.choice(passages)
            if r.random() < 0.3:
                parts += passages[0]  # in a third of all
        rows.append((r.randrange(10_000), r.choice([" ", "\n", "  \t"]).join(parts)))
    rows += [(5, "a " * 400), (7, "a " * 300), (9, "a b " * 100), (8, None), (11, ""), (12, " "), (None, rows[3][1]), (None, None)]
    rows += rows[:6] + [(rows[0][0], rows[1][1]), (77_777, rows[0][1]), (1, " ".join(passages[1] + passages[2]))]
    return rows


@pytest.mark.parametrize("cap", [20_000, 3])
def test_kept_words_against_brute_force(spark, cap):
    rows = fixture()
    df = spark.createDataFrame([(d, t, 1, "m") for d, t in rows], "doc_id long, text string, r int, m string")
    got = [tuple(x) for x in substrings.dedup(df, cap=cap).collect()]
    assert sorted(got, key=str) == sorted(brute(rows, 13), key=str)


def test_digest_and_empty(spark):
    df = spark.createDataFrame([(1, "x y"), (2, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in substrings.dedup(df, text=False).collect()}
    assert got[1].kept == hashlib.sha256(b"x y").hexdigest() and got[2].kept == hashlib.sha256(b"").hexdigest()
    assert substrings.dedup(df.limit(0)).count() == 0


def test_words_of_many_texts_at_once():
    import pyarrow as pa

    r = random.Random(2)
    for _ in range(200):
        texts = ["".join(r.choice(["a", "b", " ", "\n", "é", "\x0b", "A"]) for _ in range(r.randrange(0, 12))) for _ in range(r.randrange(0, 9))] + [None] * r.randrange(2)
        off, raw = common.buffers(pa.array(texts, pa.string()))
        start, end, sym, first = common.words(off, raw)
        want = [split(t) for t in texts]
        got = [[bytes(raw[start[k] : end[k]]).decode() for k in range(first[i], first[i + 1])] for i in range(len(texts))]
        assert got == want
        flat = [w for ws in want for w in ws]
        assert len(set(flat)) == len(set(sym.tolist())) and all((sym[i] == sym[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_long_words_differ():
    import pyarrow as pa

    texts = ["a" * 5000 + "b" + "c" * 5000, "a" * 5000 + "c" + "b" + "c" * 4999, "b" * 10_001]
    _, _, sym, _ = common.words(*common.buffers(pa.array(texts)))
    assert len(np.unique(sym)) == 3


def test_nodes_of_a_subtree_are_the_longest_common_repeats():
    r = random.Random(7)
    for _ in range(60):
        docs = [[r.randrange(3) for _ in range(r.randrange(4, 40))] for _ in range(r.randrange(1, 8))]
        docs += [docs[0][2:] + [9], docs[-1]]
        words = np.array([w for d in docs for w in d], np.uint64)
        start = np.cumsum([0, *map(len, docs)])
        suffixes = [(k, i) for k, d in enumerate(docs) for i in range(len(d) - 3)]
        doc = np.array([k for k, _ in suffixes])
        begin, have = np.array([start[k] + i for k, i in suffixes]), np.array([len(docs[k]) - i for k, i in suffixes])
        group = words[begin]  # by a prefix of one word
        tree = substrings.subtree(group, words, begin, have, doc, 4)
        want = {}
        for s, (k, i) in enumerate(suffixes):
            want.setdefault(tuple(docs[k][i : i + 4]), []).append(s)
        got = {}
        for n, (a, b) in enumerate(zip(tree.first[:-1], tree.first[1:])):
            members = sorted(tree.order[a:b].tolist())
            tails = [docs[suffixes[s][0]][suffixes[s][1] :] for s in members]
            depth = next((d for d in range(min(map(len, tails))) if len({t[d] for t in tails}) > 1), min(map(len, tails)))
            assert tree.depth[n] == depth >= 4 and tree.least[n] == doc[members].min()
            got[tuple(tails[0][:4])] = members
        assert got == {k: v for k, v in want.items() if len(v) > 1}
