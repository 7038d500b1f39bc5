import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from zonalis.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts():
    r = random.Random(2)
    words = ["the", "Über", "naïve", "don't", "I'll", "x1y22", "ΣΑΣ", "é", "日本語", "!!!", "'", "''s", "½", "a_b", "<|endoftext|>", "<|EndOfText|>", "ǅ", "İ", "…", "“q”", "\x1c", " ", "straße", "antidisestablish", "€5", "'ll'", "٣"]
    out = [None, "", " ", "\n\t", "<|endoftext|>", "a" * 5000, "'", "é"]
    for n in (1, 3, 10, 60, 400):
        for _ in range(30):
            out.append(r.choice([" ", "", "\n", "  "]).join(r.choice(words) for _ in range(n)))
    out += [" ".join(r.choice(words[:6]) for _ in range(n)) for n in (5, 5000, 20000)]
    return out


def test_counts_equal_the_library(spark):
    lib = Tokenizer.from_file(PATH)
    ts = texts()
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in ts]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(ts)] + [(None, "one two", 2), (3, "one two", 2)], "doc_id long, text string, i int")
    got = {x.doc_id: x for x in tc.token_counts(df.where("i = 1"), PATH).collect()}
    assert [got[i].n_tokens for i in range(len(ts))] == want
    assert [got[i].n_bytes for i in range(len(ts))] == [len((t or "").encode()) for t in ts]
    assert all(x.over_limit == (x.n_tokens > 2048) for x in got.values())
    odd = tc.token_counts(df.where("i = 2"), PATH).collect()
    assert sorted([(x.doc_id, x.n_tokens) for x in odd], key=str) == [(3, 2), (None, 2)]
    assert tc.token_counts(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("chunk,overlap", [(16, 2), (40, 8), (100, 1), (1000, 100)])
def test_resync_equals_one_encoding(chunk, overlap):
    enc, lib = tc.Encoder(PATH), Tokenizer.from_file(PATH)
    for t in texts():
        t = (t or "")[:4000]
        assert tc.resync_count(t, enc.offsets, chunk, overlap) == len(lib.encode(t, add_special_tokens=False).ids), t[:80]


def test_alignment_widens_over_a_text_without_spaces():
    enc = tc.Encoder(PATH)
    t = "abc" * 700 + " def " + "xyz" * 300
    calls = []
    n = tc.resync_count(t, lambda s: calls.append(len(s)) or enc.offsets(s), 64, 8)
    assert n == enc.count(t) and max(calls) > 64
