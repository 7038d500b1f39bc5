import hashlib
import itertools
import random
import re

import numpy as np

from zonalis.llm import pii

FIELD = pii.train()


def definition(t):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 8 <= len(d) <= 15
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_patterns():
    r = random.Random(3)
    bits = ["a", "b.c", "@", "@x", ".", "..", "1", "255", "256.", "0001", "+", "+1", " ", "-", "(", ")", "é", "4111 1111 1111 1111", "4111111111111111", "10.0.0.1", "a@b.c", "\n", "٣", "+49 (30) 123-4567", "a@b.c@d.e", "1" * 30]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 14)))
        assert pii.base_spans(t) == definition(t), t


def test_best_segmentation_is_the_best():
    g = np.random.default_rng(2)
    win = next(pii.windows("call 12 345 6789 or 1.2.3.4 now"))
    f = pii.Field()
    f.trans = g.normal(size=f.trans.shape)
    score = {s: g.normal(size=4) * 2 for s in win.spans}
    f.scores = lambda w: score

    def total(ents):
        s, prev, at = 0.0, 4, 0
        for y, i, j in [*ents, (4, len(win.tokens), None)]:
            while at < i:
                s, prev, at = s + f.trans[prev, 4], 4, at + 1
            if y != 4:
                s, prev, at = s + f.trans[prev, y] + score[i, j][y], y, j
        return s

    options = [[]] + [[(y, *s)] for s in win.spans for y in range(4)]
    for a, b in itertools.combinations(win.spans, 2):
        if a[1] <= b[0]:
            options += [[(x, *a), (y, *b)] for x in range(4) for y in range(4)]
    best = max(options, key=total)
    got = f.decode(win)
    assert total(got) >= total(best) - 1e-9


def test_held_out_sentences():
    hit = found = there = 0
    for text, spans in pii.training_sentences(300, seed=77):
        got = set(pii.find(text, FIELD)[1])
        hit += len(got & set(spans))
        found += len(got)
        there += len(spans)
    assert there > 300 and hit / there > 0.9 and hit / found > 0.9


def test_whole_rows(spark):
    texts = [None, "", "no data at all.", "Mail a.b@c.de now", "IP 10.1.2.3, card 4111 1111 1111 1111.", "Licensed under the Apache License, Version 2.0.", "write to jane.doe at mail dot example dot com today", "x" * 50_000 + " a@b.co", "call (555) 123-4567 at noon", "9" * 100_000, "+" * 20_000, "a" * 100_000 + "@", "1.1." * 30_000]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)] + [(None, texts[3], "q"), (3, texts[3], "q")], "doc_id long, text string, spans string")
    got = pii.digests(df, field=FIELD).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        if x.doc_id is not None:
            t = texts[x.doc_id]
            base = pii.base_spans(t)
            if len(t or "") < 60_000:
                assert base == definition(t)
            assert x.base_sha256 == hashlib.sha256(pii._said(base).encode()).hexdigest()
            assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
            assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(x.spans.split(","))
    by = {x.doc_id: x.spans for x in got}
    assert by[0] == by[1] == by[2] == by[5] == ""
    assert by[6].startswith("email:9:") and by[8] == "phone:5:19"
    out = {r.doc_id: r.text for r in pii.masked(df, field=FIELD).collect()}
    assert out[3] == "Mail [EMAIL] now" and out[4] == "IP [IP], card [CARD]." and out[2] == texts[2] and out[0] is None
    assert pii.digests(df.limit(0), field=FIELD).count() == 0
