import random

from zonalis.llm import decontaminate as dc


def brute_tiles(a, b, least):
    """Greedy string tiling as defined: again and again the longest free matches."""
    fa, fb, out = [True] * len(a), [v >= 0 for v in b], []
    while True:
        best, at = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and fa[i + k] and fb[j + k]:
                    k += 1
                if k > best:
                    best, at = k, [(i, j)]
                elif k == best and k >= least:
                    at.append((i, j))
        if not at:
            return sorted(out)
        for i, j in at:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                out.append((i, j, best))
                fa[i : i + best] = [False] * best
                fb[j : j + best] = [False] * best


def test_tiles_cover_as_the_definition_says():
    r = random.Random(1)
    for _ in range(300):
        a = [r.randrange(4) for _ in range(r.randrange(1, 40))]
        b = [r.randrange(-1, 4) for _ in range(r.randrange(1, 60))]
        for least in (2, 3, 5):
            got, want = dc.tiles(a, b, least), brute_tiles(a, b, least)
            assert sorted(t[2] for t in got)[-1:] == sorted(t[2] for t in want)[-1:]
            for q, p, k in got:
                assert a[q : q + k] == b[p : p + k] and k >= least
            for side in (0, 1):
                cells = [c for t in got for c in range(t[side], t[side] + t[2])]
                assert len(cells) == len(set(cells))
    for _ in range(100):  # no ties: every word occurs once in each, in another order
        a = list(range(60))
        cuts = sorted(r.sample(range(1, 60), 5))
        parts = [a[i:j] for i, j in zip([0, *cuts], [*cuts, 60])]
        r.shuffle(parts)
        b = [x for part in parts for x in part]
        assert dc.tiles(a, b, 5) == brute_tiles(a, b, 5)


def test_contaminated_documents(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randrange(8, 60)))) for i in range(12)]
    text = lambda n: " ".join(word() for _ in range(n))
    docs, want = [], set()
    for d in range(150):
        t = text(r.randrange(5, 300))
        if d % 3 == 0:
            i, x = items[d % 12]
            w = x.upper().split()
            kind = d % 9
            if kind == 0:
                t = f"{text(40)}\n{x}\n{text(30)}"
            elif kind == 3:  # in two parts, the other way round
                h = len(w) // 2
                if min(h, len(w) - h) < 5:
                    h = 0
                t = f"{text(20)} {' '.join(w[h:])} {text(9)} {' '.join(w[:h])}"
            else:  # too little of it
                t = f"{text(20)} {' '.join(w[: int(0.7 * len(w))])} {text(9)}"
            if kind != 6:
                want.add((d, i))
        docs.append((d, t, 1))
    docs += [(900, None, 1), (901, "", 1), (None, items[3][1], 1), (5, items[4][1], 1), (902, (text(30_000) + " " + items[5][1]) * 2, 1)]
    want |= {(None, 3), (5, 4), (902, 5)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([*items, items[0], (77, None), (78, "too short"), (79, "")], "item_id long, text string")
    got = dc.contaminated(df, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want and len(got) == len(want)
    assert all(x.coverage >= 0.8 and x.n_covered <= x.n_words for x in got)
    blocks = dc.contaminated(df, bench, block_bytes=900).collect()
    assert sorted(map(str, blocks)) == sorted(map(str, got))
    assert dc.contaminated(df.limit(0), bench).count() == 0
    assert dc.contaminated(df, bench.limit(0)).count() == 0


def test_a_phrase_that_many_items_share_and_a_document_repeats():
    import time

    import pyarrow as pa

    phrase = "one two three four five"
    items = [(i, f"{phrase} " + " ".join(f"x{i}y{k}" for k in range(20))) for i in range(2000)] + [(9000 + i, phrase) for i in range(2000)]
    docs = pa.record_batch([pa.array([1, 2]), pa.array([f"{phrase} . " * 2000 + items[3][1], "nothing here"])], ["d", "t"])
    ix = dc.Index(items, 5)
    began = time.process_time()
    (got,) = list(dc._scan(iter([docs]), ix, 0.8))
    assert time.process_time() - began < 5
    assert set(got["item_id"].to_pylist()) == {3, *range(9000, 11000)} and set(got["d"].to_pylist()) == {1}
    assert all(r["coverage"] == 1 and r["n_tiles"] == 1 for r in got.to_pylist())


def test_repeated_stretches_tile_an_item_as_often_as_it_has_them():
    import pyarrow as pa

    part = "a b c d e"
    docs = pa.record_batch([pa.array([1, 2, 3]), pa.array([f"{part} x " * n for n in (1, 3, 7)])], ["d", "t"])
    (got,) = list(dc._scan(iter([docs]), dc.Index([(5, f"{part} y " * 3)], 5), 0.8))
    assert [(r["d"], r["n_tiles"], r["n_covered"]) for r in got.to_pylist()] == [(2, 3, 15), (3, 3, 15)]


def test_repeated_words_do_not_meet_each_with_each():
    import time

    import pyarrow as pa

    for unit in ("ha", "ha ho", "a b c d e f g"):
        words = (unit + " ") * (4000 // len(unit.split()))
        n = len(words.split())
        began = time.process_time()
        got = dc.tiles([ord(w[0]) * 7 + len(w) + ord(w[-1]) for w in words.split()], [ord(w[0]) * 7 + len(w) + ord(w[-1]) for w in words.split()], 5)
        assert got == [(0, 0, n)] and time.process_time() - began < 1.5
        docs = pa.record_batch([pa.array([1, 2]), pa.array([words, words * 3])], ["d", "t"])
        began = time.process_time()
        (found,) = list(dc._scan(iter([docs]), dc.Index([(5, words)], 5), 0.8))
        assert [(r["d"], r["n_covered"]) for r in found.to_pylist()] == [(1, n), (2, n)] and time.process_time() - began < 6


def plain_tiles(a, b, least):
    """The same search over all pairs of places with equal runs, symbol by symbol."""
    fa, fb, out = [True] * len(a), [v >= 0 for v in b], []
    s = max(least, min(20, len(a)))

    def match(q, p):
        k = 0
        while q + k < len(a) and p + k < len(b) and fa[q + k] and fb[p + k] and a[q + k] == b[p + k]:
            k += 1
        return k

    while True:
        found, longest = {}, 0
        for q in range(len(a)):
            for p in range(len(b)):
                before = q and p and fa[q - 1] and fb[p - 1] and a[q - 1] == b[p - 1]
                k = match(q, p)
                if k >= s and not before:
                    found.setdefault(k, []).append((q, p))
                    longest = max(longest, k)
        if longest > 2 * s:
            s = longest
            continue
        k = longest
        while k >= s:
            for q, p in sorted(found.pop(k, ())):
                i = 0
                while i < k:
                    n = 0
                    while i + n < k and fa[q + i + n] and fb[p + i + n]:
                        n += 1
                    if n == k:
                        out.append((q, p, k))
                        fa[q : q + k] = [False] * k
                        fb[p : p + k] = [False] * k
                    elif n >= s:
                        found.setdefault(n, []).append((q + i, p + i))
                    i += max(n, 1)
            k = max((n for n in found if n <= k and found[n]), default=0)
        if s == least:
            return sorted(out)
        s = max(least, s // 2)


def test_tiles_of_tied_and_repeated_words_are_those_of_the_plain_search():
    r = random.Random(7)
    for _ in range(250):
        a = [r.randrange(3) for _ in range(r.randrange(1, 50))]
        b = [r.randrange(-1, 3) for _ in range(r.randrange(0, 70))]
        if r.random() < 0.4:
            a, b = a[:3] * 12, (a[:3] * 9 + [-1] + b)[:70]
        for least in (2, 5):
            assert dc.tiles(a, b, least) == plain_tiles(a, b, least), (a, b)
