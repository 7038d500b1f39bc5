"""Token counts with overlap resynchronisation.

A document over ``chunk`` characters is encoded as overlapping chunks with offsets. Two neighbouring
encodings are spliced at a common boundary in their overlap: a token start just after ASCII white
space. No token, normalisation or special string of this tokenizer reaches over white space, so what
follows such a boundary cannot depend on what precedes it; that both encodings have the boundary is
checked all the same. If the overlap has none, it is doubled, up to the whole document.

The chunk encoder is the library's model behind a memo of pieces: for texts of characters on which
its normaliser and splitter were compared with the ones used here, character by character, pieces
come from one regular expression and each unseen piece from the library's model. All other texts,
and those that may hold special strings, go to the library as they are.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are kept; a null
id stays null; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

CHUNK, OVERLAP, MEMO = 32_768, 256, 300_000


def _byte_letters() -> list[str]:
    """The printable stand-ins of byte-level tokenizers: printable bytes stand for themselves."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Encoder:
    """(starts, counts): where the pieces of a text start, and how many tokens each has."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.memo: dict[str, int] = {}
        self.letters = _byte_letters()
        safe = self._safe()
        letters = "".join(c for c in safe if c.isalpha())
        self.unsafe = re.compile("[^" + re.escape("".join(safe)) + "]")
        self.piece = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{re.escape(letters)}]+|[0-9]|[^\s0-9{re.escape(letters)}]+")

    def _safe(self) -> list[str]:
        """Characters on which the library's normaliser and splitter do what this class does."""
        out = ["\t", "\n", "\r"]
        for c in map(chr, [*range(32, 127), *range(0xA1, 0x180), *range(0x2010, 0x2028), 0x20AC]):
            low = c.lower()
            if unicodedata.normalize("NFC", c) != c or unicodedata.combining(c) or len(low) != 1 or low.isspace() != c.isspace():
                continue
            if c.isnumeric() and not c.isascii():
                continue
            if self.lib.normalizer.normalize_str(c) != low or low.isalpha() != c.isalpha():
                continue
            got = [p for p, _ in self.lib.pre_tokenizer.pre_tokenize_str(f"a{low}a{low}{low}")]
            as_letters = "".join(self.letters[b] for b in low.encode())
            want = ["a", "a"] if c.isspace() else ["a" + as_letters + "a" + as_letters * 2] if c.isalpha() else ["a", as_letters, "a", *([as_letters] * 2 if c.isdigit() else [as_letters * 2])]
            if got == want:
                out.append(c)
        return out

    def _miss(self, piece: str) -> int:
        if len(self.memo) >= MEMO:
            self.memo.clear()
        s = piece if piece.isascii() else "".join([self.letters[b] for b in piece.encode()])
        n = self.memo[piece] = len(self.lib.model.tokenize(s))
        return n

    def plain(self, text: str) -> bool:
        return "<|" not in text and self.unsafe.search(text) is None

    def count(self, text: str) -> int:
        if not self.plain(text):
            return len(self.lib.encode(text, add_special_tokens=False).ids)
        get, pieces = self.memo.get, self.piece.findall(text.lower())
        got = list(map(get, pieces))
        if None in got:
            miss = self._miss
            return sum([n if n is not None else (get(p) or miss(p)) for n, p in zip(got, pieces)])
        return sum(got)

    def offsets(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        if not self.plain(text):
            at = np.array([a for a, _ in self.lib.encode(text, add_special_tokens=False).offsets], np.int64)
            return at, np.ones(len(at), np.int64)
        low = text.lower()
        at = np.array([m.start() for m in self.piece.finditer(low)], np.int64)
        get, miss = self.memo.get, self._miss
        return at, np.array([get(p) or miss(p) for p in self.piece.findall(low)], np.int64)


def resync_count(text: str, offsets, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text from overlapping chunks; ``offsets(part)`` gives starts and token counts."""
    total, begin = 0, 0  # begin: a proven boundary up to which all is counted
    at, num = offsets(text[:chunk])
    end = min(chunk, len(text))
    width = overlap
    while end < len(text):
        low = max(begin, end - width)
        to = min(len(text), low + max(chunk, 2 * width))
        nat, nnum = offsets(text[low:to])
        here = at + begin
        # starts that both have, just after white space: the last of them that is well inside
        both = np.intersect1d(here[(here > low) & (here < end)], nat + low)
        cut = next((int(p) for p in both[::-1] if text[p - 1] in " \t\n\r"), None)
        if cut is None or cut == begin:
            if low == begin:  # the overlap is the whole of what was encoded: take more at once
                end = min(len(text), end + max(chunk, end - begin))
                at, num = offsets(text[begin:end])
            width *= 2
            continue
        total += int(num[here < cut].sum())
        keep = nat + low >= cut
        at, num, begin, end, width = nat[keep] + low - cut, nnum[keep], cut, to, overlap
    return total + int(num.sum())


_encoders: dict[str, Encoder] = {}


def _count(batches: Iterator[pa.RecordBatch], path: str, chunk: int, overlap: int, limit: int) -> Iterator[pa.RecordBatch]:
    enc = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    for b in batches:
        size, tokens, last = [], [], {}
        for t in b.column(1):
            t = t.as_py() or ""
            n = last.get(t)
            if n is None:
                n = last[t] = enc.count(t) if len(t) <= chunk else resync_count(t, enc.offsets, chunk, overlap)
            tokens.append(n)
            size.append(len(t) if t.isascii() else len(t.encode()))
        yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["i", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = 2048) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row."""
    common.ship(docs.sparkSession)
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return one.mapInArrow(lambda it: _count(it, path, chunk, overlap, limit), "i long, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("i", id_col)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
