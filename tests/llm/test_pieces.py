import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import sentencepiece

from zonalis.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts():
    r = random.Random(6)
    words = ["the", "Straße", "été", "naïve", "  ", "   ", "\n", "\t", "12345", "3.14", "日本語", "😀", "ab", "xyzzy", "ing", "tion", "--", "....", "'s", "<0x41>", "<s>", "<unk>", "A" * 20, "\x00", "é", "ñ", "quejadoí"]
    out = [None, "", " ", "  ", " " * 40, "a", "\n", " a", "a ", "<0x0A>", "</s>x"]
    for n in (1, 2, 4, 12, 60):
        for sep in ("", " ", "  "):
            out += [sep.join(r.choice(words) for _ in range(n)) for _ in range(25)]
    alphabet = "abcdeinorst"
    out += [" ".join("".join(r.choice(alphabet) for _ in range(r.randrange(1, 30))) for _ in range(50)) for _ in range(60)]
    return out


def test_ids_equal_the_library_and_decode_back(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ts = texts()
    rows = [(i, t, [7]) for i, t in enumerate(ts)] + [(None, "two words", [7]), (5, "two words", [7])]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>")
    got = pieces.encode(df, PATH).collect()
    want = {(i, t): lib.encode(t or "") for i, t, _ in rows}
    assert sorted(((x.doc_id, x.ids) for x in got), key=str) == sorted(((i, w) for (i, _), w in want.items()), key=str)
    back = pieces.decode(spark.createDataFrame([(x.doc_id, x.ids) for x in got], "doc_id long, ids array<int>"), PATH).collect()
    assert sorted(((x.doc_id, x.text) for x in back), key=str) == sorted(((i, t or "") for i, t, _ in rows), key=str)
    dig = pieces.digests(df, PATH).collect()
    assert all(x.round_trip for x in dig)
    by = {hashlib.sha256(struct.pack(f"<{len(w)}i", *w)).hexdigest() for w in want.values()}
    assert {x.ids_sha256 for x in dig} == by
    assert pieces.digests(df.limit(0), PATH).count() == 0
    bar = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    (row,) = pieces.digests(bar, PATH).collect()
    assert not row.round_trip and row.n_pieces == len(lib.encode("a▁b"))


def test_library_decoding_is_the_same():
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = pieces.machine(PATH)
    import numpy as np

    r = random.Random(8)
    for _ in range(300):
        ids = [r.randrange(259, 32000) if r.random() < 0.8 else r.randrange(3, 259) for _ in range(r.randrange(1, 12))]
        if not any(3 <= i < 259 for i in ids):
            assert t.decode(np.array(ids)) == lib.decode(ids)


def unigram(path, seed):
    """A small unigram model made by hand: pieces and weights are drawn, nothing is trained."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    r = random.Random(seed)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback, m.trainer_spec.unk_surface = 1, True, " "
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = "identity", True, False, True
    for p, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3)] + [(f"<0x{b:02X}>", 6) for b in range(256)]:
        m.pieces.add(piece=p, score=0, type=kind)
    made = {pieces.BAR, *"abcdeé"} | {r.choice(["", pieces.BAR]) + "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 5))) for _ in range(150)}
    for p in sorted(made):
        m.pieces.add(piece=p, score=-r.randrange(64, 576) / 64, type=1)  # sums without rounding
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_weights_decide_among_the_paths_of_a_unigram_model(tmp_path):
    r = random.Random(4)
    for seed in range(3):
        path = unigram(tmp_path / f"{seed}.model", seed)
        lib, t = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Transducer(path)
        changed = 0
        for _ in range(300):
            s = "".join(r.choice("aaabbcdeé  x日") for _ in range(r.randrange(0, 30)))
            got = list(struct.unpack(f"<{len(t.encode(s)) // 4}i", t.encode(s)))
            assert got == lib.encode(s), s
            greedy, at, whole = [], 0, (pieces.BAR + s.replace(" ", pieces.BAR)) if s else ""
            while at < len(whole):  # longest match first is another path
                ways = t.lexicon_paths(whole, at)
                j, piece, _ = ways[-1] if ways else (at + 1, None, 0)
                greedy += [piece] if piece is not None else [t.byte[b] for b in whole[at].encode()]
                at = j
            changed += greedy != got
        assert changed > 100


def test_composition_has_one_state_for_each_place_and_last_piece():
    t = pieces.machine(PATH)
    s = pieces.BAR + "reconsideration"
    live = t.compose(s)
    assert sum(map(len, filter(None, live))) > 3 and len(live) == len(s) + 1
    assert sum(len(t.lexicon_paths(s, i)) for i in range(len(s))) > 25  # arcs before the grammar
    r = random.Random(2)
    for _ in range(400):
        w = pieces.BAR + "".join(r.choice("aeinorstdl'é日x") for _ in range(r.randrange(0, 25)))
        assert t.solve(w) == t.shortest(w) and all(len(x) == 1 for x in t.compose(w) if x)
    assert t.solve(s) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode("reconsideration")


def test_the_grammar_lets_pieces_meet_where_merging_leaves_both():
    t = pieces.machine(PATH)
    score = t.grammar.score
    ids, r = [i for i in range(259, 32000)], random.Random(9)
    some = [(r.choice(ids), r.choice(ids)) for _ in range(4000)]
    some += [(x, y) for x in r.sample(ids, 60) for y in r.sample(ids, 60) if t.text[x][-1] + t.text[y][0] in t.grammar.joint]
    seen = set()
    for x, y in some:
        if pieces.merges(t.text[x], score)[1] == [t.text[x]] and pieces.merges(t.text[y], score)[1] == [t.text[y]]:
            want = pieces.merges(t.text[x] + t.text[y], score)[1] == [t.text[x], t.text[y]]
            assert t.grammar.arc(x, y) == want, (t.text[x], t.text[y])
            seen.add(want)
    assert seen == {True, False}


def test_new_columns_replace_those_of_their_names(spark):
    df = spark.createDataFrame([(1, "a b", "old", 5)], "doc_id long, text string, pieces string, n_pieces int")
    (row,) = pieces.with_pieces(df, PATH).collect()
    assert row.asDict().keys() == {"doc_id", "text", "n_pieces", "pieces"} and row.n_pieces == len(row.pieces)


def test_every_id_comes_from_a_composition(monkeypatch):
    t = pieces.Transducer(PATH)
    met = []
    compose = t.compose
    monkeypatch.setattr(t, "compose", lambda s: met.append(s) or compose(s))
    text = "A composition for each new segment, naïve 日本 \n once."
    got = struct.unpack(f"<{len(t.encode(text)) // 4}i", t.encode(text))
    assert list(got) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text)
    assert len(met) == len(set(met)) and set(met) == set(t.segments(" " + text))  # the second time from the memo


def test_the_lexicon_reads_what_the_normaliser_reads():
    t = pieces.machine(PATH)
    todo, arcs, met = [t.lexicon.root], 0, 0
    while todo:
        at = todo.pop()
        assert (" " in at) == (pieces.BAR in at) and at.get(" ") is at.get(pieces.BAR)
        met += " " in at
        arcs += len(at)
        todo += [to for c, (to, _, _) in at.items() if c != " "]
    assert met > 1 and arcs > 20_000
    m = pieces.Machine()
    m.add("ab", 1, 1.0)
    m.add("b", 2, 1.0)
    m.behind({"a": "b"})  # an a reads as a b, and nothing writes an a
    assert m.root.keys() == {"a", "b"} and m.root["a"][1] == 2


def test_a_segment_of_two_million_characters_takes_seconds():
    import time

    t = pieces.machine(PATH)
    text = "abcdefghij" * 200_000
    began = time.process_time()
    ids = t.encode(text)
    assert time.process_time() - began < 30
    assert len(t.segments(" " + text)) == 1 and t.decode(np.frombuffer(ids, "<i4")) == text
    short = "abcdefghij" * 2000
    assert t.shortest(" " + short) == sentencepiece.SentencePieceProcessor(model_file=PATH).encode(short)


def test_a_place_may_have_several_states():
    """Grammar states that differ meet at one place when weights decide; each keeps its own way back."""
    live = pieces.Composition(3)
    t = pieces.machine(PATH)
    for new in ((5, 2.0, 0, 0, 5), (6, 1.0, 0, 0, 6), (5, 1.5, 1, 0, 5), (6, 3.0, 1, 0, 6)):
        t._reach(live, 2, new)
    assert live[2] == [(5, 1.5, 1, 0, 5), (6, 1.0, 0, 0, 6)] and live[1] is None and [len(x) for x in live if x] == [1, 2]
