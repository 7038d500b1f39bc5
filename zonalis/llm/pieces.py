"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model is compiled into three machines (``Machine``: states with arcs from a label to an output, a weight and a state):

* the normaliser has one state and an arc that writes U+2581 for a space; all other characters are copied (only identity
  normalisation is taken). The dummy prefix is an arc before the input that reads as a space does;
* the lexicon is a trie of characters whose ends write a piece and go back to the root at the piece's weight; a
  character that no piece has is written as its bytes. It is composed with the normaliser when the model is compiled
  (``Machine.behind``): wherever it reads what an arc of the normaliser writes, it reads that arc's label;
* the grammar reads pieces. For a unigram model it has one state, and a piece weighs minus its score. A merge model's
  pieces come from merges by score, and a sequence of pieces is its encoding if and only if no merge across any
  two neighbours comes before those inside them; the grammar's state is the last piece, an arc is there for
  each piece that may follow it, and each piece weighs 1.

Each input is composed with the machines (``Transducer.compose``): the composition's states are (place in the input, lexicon
state, grammar state), expanded from left to right as paths reach them, and the encoding is its shortest path in the
tropical semiring (``Transducer.shortest``: weights add along a path, the least wins). Paths never lead over two characters that no
piece has beside each other: segments between are composed on their own, and the paths of short ones are kept in a bounded
memo. A composition takes time and memory in proportion to its segment, as a way through the trie is no longer than a piece.

Defined cases: a null or empty text has no pieces and decodes to an empty text; a literal U+2581 in a text
decodes to a space (``round_trip`` is false); repeated rows and ids are kept; a null id stays null; an empty
table gives an empty result; further columns are ignored; columns that have the names of ``with_pieces``'s new ones are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zonalis.llm import common

BAR = "▁"
MEMO, PAIRS = 300_000, 1_000_000
UNIGRAM, MERGES = 1, 2


class Machine:
    """A transducer as a trie. A state is the dict of its arcs: label to (next state, output of the arc without a label that leads
    from there back to the root, its weight); an output of -1 means that there is no such arc."""

    def __init__(self):
        self.root: dict = {}
        self.states = 1

    def add(self, labels: str, out: int, weight: float) -> None:
        at = self.root
        for k, label in enumerate(labels):
            to, old, w = at.get(label) or ({}, -1, 0.0)
            self.states += label not in at
            at[label] = (to, out, weight) if k == len(labels) - 1 else (to, old, w)
            at = to

    def behind(self, before: dict[str, str]) -> None:
        """This machine composed with one of one state before it, which writes ``before[label]`` for a label and copies others."""
        todo = [self.root]
        while todo:
            arcs = todo.pop()
            todo += [to for to, _, _ in arcs.values()]
            new = {label: arcs[written] for label, written in before.items() if written in arcs}
            for label in before:
                arcs.pop(label, None)
            arcs.update(new)


def merges(s: str, score: dict[str, float]) -> tuple[list[tuple[float, str, str]], list[str]]:
    """A merge model's rule on one string: join the neighbours with the best score, leftmost first, while there are any.

    Gives each merge's score with the last and the first part after it, and the parts that are left.
    """
    part = list(s)
    nxt, prv = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
    heap: list[tuple[float, int, int, str]] = []
    events, tail = [], len(part) - 1

    def offer(i):
        j = nxt[i]
        if j < len(part):
            both = part[i] + part[j]
            if both in score:
                heapq.heappush(heap, (-score[both], i, j, both))

    for i in range(len(part)):
        offer(i)
    while heap:
        at, i, j, both = heapq.heappop(heap)
        if not part[i] or not part[j] or part[i] + part[j] != both or nxt[i] != j:
            continue
        part[i], part[j] = both, ""
        nxt[i] = nxt[j]
        if nxt[j] < len(part):
            prv[nxt[j]] = i
        if tail == j:
            tail = i
        events.append((-at, part[tail], part[0]))
        offer(i)
        if prv[i] >= 0:
            offer(prv[i])
    return events, [p for p in part if p]


class Free:
    """The grammar of a unigram model: one state, and an arc for each piece."""

    known: dict[int, dict[int, bool]] = {}

    @staticmethod
    def to(piece: int) -> int:
        return -1

    @staticmethod
    def arc(state: int, piece: int) -> bool:
        return True


class Grammar:
    """The grammar of a merge model. A state is the last piece, or -1 at the start and after bytes, beside which nothing merges."""

    def __init__(self, events: dict[int, list[tuple[float, str, str]]], text: list[str], score: dict[str, float]):
        self.events, self.text, self.score = events, text, score
        #: Neighbouring characters inside pieces; between others nothing merges.
        self.joint = {p[k : k + 2] for p in score for k in range(len(p) - 1)}
        #: Arcs that were asked for: of each state, label to whether there is one.
        self.known: dict[int, dict[int, bool]] = {}
        self.count = 0

    @staticmethod
    def to(piece: int) -> int:
        return piece

    def arc(self, a: int, b: int) -> bool:
        """Whether there is an arc from state a with the label b (to state b)."""
        known = self.known.setdefault(a, {})
        ok = known.get(b)
        if ok is None:
            ok = a < 0 or self._arc(a, b)
            if self.count < PAIRS:
                self.count += 1
                known[b] = ok
        return ok

    def _arc(self, a: int, b: int) -> bool:
        """The merges inside a and those inside b in the order of their scores: none across may come before one of them.

        Of equal scores the merge further left comes first.
        """
        x, y, score = self.text[a], self.text[b], self.score
        if x[-1] + y[0] not in self.joint:
            return True
        left, right, i, j, last, first = self.events[a], self.events[b], 0, 0, x[-1], y[0]
        while True:
            in_a = left[i][0] if i < len(left) else None
            in_b = right[j][0] if j < len(right) else None
            across = score.get(last + first)
            if across is not None and (in_a is None or across > in_a) and (in_b is None or across >= in_b):
                return False
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a >= in_b:
                last = left[i][1]
                i += 1
            else:
                first = right[j][2]
                j += 1


NONE = -2


class Composition:
    """An input composed with the machines. Of each place one state as a row of columns (grammar state, or NONE; least weight; place
    and index of the state before; piece of the last arc, -1 for bytes), further ones in ``more``."""

    __slots__ = ("state", "cost", "back", "piece", "index", "more")

    def __init__(self, n: int):
        if n > 4096:  # compact
            self.state, self.cost, self.back, self.piece = (array(kind, [v]) * (n + 1) for kind, v in (("i", NONE), ("d", 0.0), ("i", 0), ("i", -1)))
        else:
            self.state, self.cost, self.back, self.piece = [NONE] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        self.index: dict[int, int] = {}  # of the states before that are not the first of their place
        self.more: dict[int, list[tuple[int, float, int, int, int]]] = {}
        self.state[0] = -1

    def __len__(self) -> int:
        return len(self.state)

    def __getitem__(self, j: int) -> list[tuple[int, float, int, int, int]] | None:
        if self.state[j] == NONE:
            return None
        return [(self.state[j], self.cost[j], self.back[j], self.index.get(j, 0), self.piece[j]), *self.more.get(j, ())]

    def __iter__(self):
        return (self[j] for j in range(len(self)))

    def relax(self, j: int, new: tuple[int, float, int, int, int]) -> None:
        """A way to a place that has a state: of equal grammar states the one of less weight stays."""
        state, cost, back, index, piece = new
        if self.state[j] == state:
            if cost < self.cost[j]:
                self.cost[j], self.back[j], self.piece[j] = cost, back, piece
                self.index[j] = index
            return
        there = self.more.setdefault(j, [])
        for k, old in enumerate(there):
            if old[0] == state:
                if cost < old[1]:
                    there[k] = new
                return
        there.append(new)


class Transducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        n, kind = m.normalizer_spec, m.trainer_spec.model_type
        if kind not in (UNIGRAM, MERGES) or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces or not m.trainer_spec.byte_fallback or any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("a unigram or merge model with byte fallback and identity normalisation is needed")
        self.prefix = n.add_dummy_prefix
        self.text = [p.piece for p in m.pieces]
        score = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.first_byte, self.last_byte = min(self.of_byte), max(self.of_byte)
        self.normaliser = {" ": BAR}
        self.lexicon, events = Machine(), {}
        for i, p in enumerate(m.pieces):
            if p.type == 1:
                if kind == UNIGRAM:
                    self.lexicon.add(p.piece, i, -p.score)
                else:
                    events[i], parts = merges(p.piece, score)
                    if parts == [p.piece]:  # others are never written
                        self.lexicon.add(p.piece, i, 1.0)
        self.lexicon.behind(self.normaliser)
        self.longest = max(map(len, score))  # of a way through the trie
        self.grammar = Free() if kind == UNIGRAM else Grammar(events, self.text, score)
        self.single = {p for p in score if len(p) == 1}
        self.single |= {label for label, out in self.normaliser.items() if out in self.single}
        if kind == MERGES and any(c not in self.single for p in score for c in p):
            raise ValueError("a character of a piece is no piece")
        #: The weight of a character that no piece has, written as bytes.
        self.fallback = 10.0 - min(score.values()) if kind == UNIGRAM else 1.0
        #: Which characters are neighbours inside a piece, by the characters' codes (0: in no piece); between others every path
        #: has a cut.
        letters = sorted({c for p in score for c in p})
        self.code = np.zeros(0x110000, np.uint16 if len(letters) < 65_000 else np.uint32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        for label, out in self.normaliser.items():
            self.code[ord(label)] = self.code[ord(out)]
        number = {c: k + 1 for k, c in enumerate(letters)}
        self.meets = np.zeros((len(letters) + 1,) * 2, bool)
        for p in score:
            for x, y in zip(p, p[1:]):
                self.meets[number[x], number[y]] = True
        self.memo: tuple[dict[str, bytes], dict[str, bytes]] = ({}, {})

    def lexicon_paths(self, s: str, at: int) -> list[tuple[int, int, float]]:
        """(place, piece, weight) of the ways through the lexicon that begin at a place of s, shortest first."""
        arcs, found = self.lexicon.root, []
        for j in range(at, len(s)):
            got = arcs.get(s[j])
            if got is None:
                break
            arcs, piece, w = got
            if piece >= 0:
                found.append((j + 1, piece, w))
        return found

    def compose(self, s: str) -> Composition:
        """The composition of a segment with the machines, as far as paths reach."""
        n, root, single, arc, free, longest = len(s), self.lexicon.root, self.single, self.grammar.arc, isinstance(self.grammar, Free), self.longest
        known, none = self.grammar.known, {}
        live = Composition(n)
        states, costs, backs, pieces, more = live.state, live.cost, live.back, live.piece, live.more
        for i in range(n):
            state = states[i]
            if state == NONE:
                continue
            cost, index, rest = costs[i], 0, iter(more.get(i, ()))
            while True:
                arcs, j, follow = root, i, known.get(state, none)
                for label in s[i : i + longest]:
                    got = arcs.get(label)
                    if got is None:
                        break
                    j += 1
                    arcs, piece, w = got
                    if piece >= 0:
                        ok = follow.get(piece)
                        if ok or ok is None and arc(state, piece):
                            if states[j] == NONE and not index:
                                states[j], costs[j], backs[j], pieces[j] = -1 if free else piece, cost + w, i, piece
                            else:
                                self._reach(live, j, (-1 if free else piece, cost + w, i, index, piece))
                if s[i] not in single:
                    self._reach(live, i + 1, (-1, cost + self.fallback, i, index, -1))
                if not more:
                    break
                further = next(rest, None)
                if further is None:
                    break
                state, cost = further[:2]
                index += 1
        return live

    @staticmethod
    def _reach(live: Composition, j: int, new: tuple[int, float, int, int, int]) -> None:
        if live.state[j] == NONE:
            live.state[j], live.cost[j], live.back[j], index, live.piece[j] = new
            if index:
                live.index[j] = index
        else:
            live.relax(j, new)

    def shortest(self, s: str) -> list[int]:
        """Shortest path through the composition of a segment with the machines."""
        live, out, j = self.compose(s), [], len(s)
        _, _, i, index, piece = live[j][0] if j not in live.more else min(live[j], key=lambda x: x[1])
        while True:
            if piece >= 0:
                out.append(piece)
            else:
                out += [self.byte[b] for b in reversed(s[i:j].encode())]
            if not i:
                return out[::-1]
            j = i
            if index or j in live.index:
                _, _, i, index, piece = live[j][index]
            else:
                i, piece = live.back[j], live.piece[j]

    solve = shortest

    def _remember(self, s: str, ids: bytes) -> None:
        young, old = self.memo
        if len(young) >= MEMO // 2:
            self.memo = ({}, young)
            young = self.memo[0]
        young[s] = ids

    def _segment(self, s: str) -> bytes:
        """Ids of one segment, from the memo or the composition."""
        found = self.memo[1].get(s)
        if found is None:
            ids = self.shortest(s)
            found = struct.pack(f"<{len(ids)}i", *ids)
        if len(s) <= 48:
            self._remember(s, found)
        return found

    def segments(self, text: str) -> list[str]:
        """A text cut wherever no piece leads over."""
        code = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
        cut = np.flatnonzero(~self.meets[code[:-1], code[1:]]) + 1
        at = [0, *cut.tolist(), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:])]

    def encode(self, text: str) -> bytes:
        """Piece ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        if self.prefix:
            text = " " + text
        segments = self.segments(text)
        got = list(map(self.memo[0].get, segments))
        if None in got:
            got = [self.memo[0].get(s) or self._segment(s) if g is None else g for g, s in zip(got, segments)]
        return b"".join(got)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; runs of bytes are read as UTF-8."""
        if not len(ids):
            return ""
        low, high, text = self.first_byte, self.last_byte, self.text
        if ((ids >= low) & (ids <= high)).any():
            out, run = [], bytearray()
            for i in ids.tolist():
                if low <= i <= high:
                    run.append(self.of_byte[i])
                    continue
                if run:
                    out.append(run.decode("utf-8", "replace"))
                    run.clear()
                out.append(text[i])
            out.append(run.decode("utf-8", "replace"))
            s = "".join(out)
        else:
            s = "".join(map(text.__getitem__, ids.tolist()))
        s = s.replace(BAR, " ")
        return s[1:] if self.prefix and s[:1] == " " else s


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    return _machines.get(path) or _machines.setdefault(path, Transducer(path))


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = machine(path)
    for whole in batches:
        for b in common.slices(whole, "t"):
            ids = [np.frombuffer(t.encode(x.as_py() or ""), "<i4") for x in b.column(1)]
            at = np.cumsum([0, *map(len, ids)])
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))], ["i", "ids"])


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = machine(path)
    for b in batches:
        yield pa.record_batch([b.column(0), pa.array([t.decode(np.asarray(x.values)) if x.is_valid else None for x in b.column(1)], pa.string())], ["i", "text"])


@common.trimmed
def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = machine(path)
    for b in batches:
        out: list[list] = [[] for _ in range(4)]
        for x in b.column(1):
            x = x.as_py() or ""
            raw = t.encode(x)
            ids = np.frombuffer(raw, "<i4")
            row = (len(ids), int(((ids >= t.first_byte) & (ids <= t.last_byte)).sum()), hashlib.sha256(raw).hexdigest(), t.decode(ids) == x)
            for column, v in zip(out, row):
                column.append(v)
        yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.bool_())))], ["i", "n_pieces", "n_byte_pieces", "ids_sha256", "round_trip"])


def _run(docs: DataFrame, id_col: str, col: str, work, schema: str, path: str) -> DataFrame:
    common.ship(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(col).alias("t"))
    return one.mapInArrow(lambda it: work(it, path), schema).withColumnRenamed("i", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    return _run(docs, id_col, text_col, _encode, "i long, ids array<int>", path)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of piece ids."""
    return _run(rows, id_col, ids_col, _decode, "i long, text string", path)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, n_byte_pieces, ids_sha256 over little-endian 32-bit ids, round_trip: decoding gives the text)."""
    return _run(docs, id_col, text_col, _digest, "i long, n_pieces long, n_byte_pieces long, ids_sha256 string, round_trip boolean", path)


@common.trimmed
def _append(batches: Iterator[pa.RecordBatch], column: int, path: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, whole.schema.names[column]):
            plain = pa.record_batch([pa.nulls(b.num_rows, pa.int64()), b.column(column)], ["i", "t"])
            for got in _encode(iter([plain]), path):
                ids = got.column(1)
                yield pa.record_batch([*b.columns, pa.array(np.diff(np.asarray(ids.offsets)), pa.int64()), ids], [*b.schema.names, "n_pieces", "pieces"])


def with_pieces(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns, with n_pieces and pieces array<int> (in the place of any that had these names)."""
    common.ship(docs.sparkSession)
    docs = docs.drop("n_pieces", "pieces") if text_col not in ("n_pieces", "pieces") else docs
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_pieces", T.LongType()), T.StructField("pieces", T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(lambda it: _append(it, at, path), schema)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
