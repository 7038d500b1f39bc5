"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds to them.

Base spans come from the four patterns below. Around what may hold personal data (digits, @, "at" and "dot"
written out) tokens are cut into segments by the field: features look at whole candidate spans (their shape,
digits, checksums, separators, the words and signs beside them), a dynamic programme over entities of at most
``LONGEST`` tokens chooses boundaries and types together, and spans that do not touch a base span are added.
The field is trained in numpy on sentences that are made here with labels.

What is a candidate is part of the model, not a limit on the text, which is read to its end. A candidate has at most
``LONGEST`` tokens, one space between two of them at most and one at sign; without an at sign, ``MOST_DIGITS`` digits (the longest
card number) in ``MOST_GROUPS`` groups. Its features look no further than ``AROUND`` words, ``REACH`` characters or a line's end.

Defined cases: a null or empty text has no spans; repeated rows and ids are kept; a null id stays null; an
empty table gives an empty result; further columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

KINDS = ("email", "ip", "card", "phone")
LONGEST, AROUND, MOST_DIGITS, MOST_GROUPS, REACH = 24, 6, 19, 6, 160
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: From the first digit of a run only: another start in it ends alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(t: str) -> Iterator[Span]:
    at, free = t.find("@"), 0
    while at >= 0:
        s = at
        while s > free and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, at + 1) if s < at else None
        if m:
            yield "email", s, m.end()
            free = m.end()
        at = t.find("@", max(at + 1, free))


def _base(t: str) -> list[Span]:
    out = list(_emails(t)) if "@" in t else []
    if _DIGIT.search(t) is None:
        return out
    for m in _IP.finditer(t):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            d = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def base_spans(text: str | None) -> list[Span]:
    """Spans of the four patterns, by kind and then by start."""
    return _base(text) if text else []


# ------------------------------------------------------------------ candidates
_TOKEN = re.compile(r"[0-9]+|[^\W0-9_]+|[^\w\s]|_")
_TRIGGER = re.compile(r"[0-9]+|@|\b[Aa][Tt]\b(?=[^\n]{0,60}\b[Dd][Oo][Tt]\b)|[\[({] ?at ?[\])}]", re.A)
_CUES = frozenset("phone tel telephone call fax mobile cell text sms mail email e contact write reach card visa credit pay paid account number no ip host address server login from at version v release license isbn order id page year section port on in dated copyright c".split())
_AT = frozenset(["at"])


class Window:
    """A stretch of tokens with its candidate spans."""

    def __init__(self, text: str, lo: int, hi: int):
        self.text = text
        self.tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(text, lo, hi)]
        self.words = [text[a:b] for a, b in self.tokens]
        self.spans = list(self._candidates())

    def _glued(self, at: int, step: int) -> bool:
        """Whether the text goes on at this place, so that no entity begins or ends there."""
        t = self.text
        if not 0 <= at < len(t):
            return False
        if t[at] in ".-/:@":
            at += step
            return 0 <= at < len(t) and t[at].isalnum()
        return t[at].isalnum()

    def _candidates(self) -> Iterator[tuple[int, int]]:
        w, tok, n = self.words, self.tokens, len(self.words)
        digit = [x[0] in "0123456789" for x in w]
        for i in range(n):
            first = w[i]
            if not (digit[i] or first in "+(" or first[0].isalpha()) or self._glued(tok[i][0] - 1, -1):
                continue
            digits = groups = at = dots = 0
            for j in range(i, min(n, i + LONGEST)):
                if j > i and tok[j][0] - tok[j - 1][1] > 1:
                    break
                x = w[j]
                if digit[j]:
                    digits, groups = digits + len(x), groups + 1
                    if not at and (digits > MOST_DIGITS or groups > MOST_GROUPS):
                        break
                elif x == "." and tok[j][0] == tok[j - 1][1] and self.text[tok[j][1] : tok[j][1] + 1].isspace():
                    break  # the end of a sentence
                at += x == "@" or x.lower() in _AT
                if at > 1:
                    break
                dots += x == "." or x.lower() == "dot"
                if not digit[j] and x not in ")" and not x[0].isalpha() or self._glued(tok[j][1], 1):
                    continue
                if first[0].isalpha() and not (at and dots) and digits < 7:
                    if not at and j - i >= 8:
                        break
                    continue
                if at and dots or digits >= 7 and (x == ")" or digit[j] or ":" in w[i:j]) or digits >= 4 and dots >= 3:
                    yield i, j + 1

    def features(self, i: int, j: int) -> tuple[str, ...]:
        t, a, b = self.text, self.tokens[i][0], self.tokens[j - 1][1]
        cue = tuple(c for x in self.words[max(0, i - 3) : i] if (c := x.lower()) in _CUES)
        nxt = self.words[j].lower() if j < len(self.words) else ""
        if nxt and nxt[0].isalnum() and nxt not in _CUES:
            nxt = "word" if nxt[0].isalpha() else "digit"
        return _features(t[a:b], t[a - 1 : a], t[b : b + 2], cue, nxt)


def _side(c: str) -> str:
    return "none" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


@lru_cache(maxsize=4_096)
def _features(s: str, before: str, after: str, cue: tuple, nxt: str) -> tuple[str, ...]:
    """Features of a whole span, of the signs at its sides and of the words near it."""
    low = s.lower()
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    shape = re.sub(r"[^\W0-9_]+", "a", re.sub(r"[0-9]+", lambda m: str(min(9, len(m[0]))), s))
    rough = re.sub(r"[0-9]+", "d", shape)
    ats = s.count("@") + len(re.findall(r"\bat\b", low))
    quad = len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    out = [
        "bias", f"shape:{shape[:40]}", f"rough:{rough[:24]}", f"digits:{len(digits)}", f"groups:{min(9, len(groups))}", f"long:{len(s).bit_length()}",
        f"luhn:{13 <= len(digits) <= 19 and luhn(digits)}", f"quad:{quad}:{rough}"[:30], f"at:{min(2, ats)}", f"dot:{min(3, len(re.findall(r'[.]|[^a-z]dot[^a-z]', low)))}",
        f"letters:{any(c.isalpha() for c in s)}", f"first:{_side(s[0])}", f"last:{_side(s[-1])}", f"before:{_side(before)}", f"after:{_side(after[:1])}",
        f"after2:{_side(after[:1])}{_side(after[1:])}", f"hex:{bool(re.search(r'[0-9][a-f]|[a-f][0-9]', s))}", f"spaces:{min(4, s.count(' '))}:{ats > 0}",
        f"words:{min(4, len(re.findall(r'[^\W0-9_]+', s)))}:{ats > 0}", f"next:{nxt}",
    ]
    return (*out, *(f"cue:{c}" for c in cue))


def windows(text: str) -> Iterator[Window]:
    """Stretches around triggers; neighbouring ones are one stretch."""
    lo = hi = end = -1
    for m in _TRIGGER.finditer(text):
        a = m.start()
        if 0 <= end and a >= hi:
            hi = _reach(text, end, 1)
        if a >= hi:
            if end >= 0:
                yield Window(text, lo, hi)
            lo = max(hi, _reach(text, a, -1))
            hi = m.end()
        end = m.end()
    if end >= 0:
        yield Window(text, lo, _reach(text, end, 1))


def _reach(text: str, at: int, step: int, limit: int = REACH) -> int:
    """Some words further on, not over a line's end."""
    gaps, end = 0, at
    while 0 <= (end - 1 if step < 0 else end) < len(text) and abs(end - at) < limit:
        c = text[end - 1 if step < 0 else end]
        if c == "\n":
            break
        gaps += c == " "
        if gaps > AROUND:
            break
        end += step
    return end


# ------------------------------------------------------------------ the field
_OUT = len(KINDS)


class Field:
    """Weights of span features for each kind, and of neighbouring segments' labels."""

    def __init__(self):
        self.w: dict[str, np.ndarray] = {}
        self.trans = np.zeros((_OUT + 1, _OUT + 1))
        self.memo: dict[tuple[str, ...], np.ndarray] = {}

    def score(self, f: tuple[str, ...]) -> np.ndarray:
        return sum((v for x in f if (v := self.w.get(x)) is not None), np.zeros(_OUT))

    def scores(self, win: Window) -> dict[tuple[int, int], np.ndarray]:
        """Of each candidate its score for each kind, from a bounded memo."""
        memo, out = self.memo, {}
        for i, j in win.spans:
            f = win.features(i, j)
            s = memo.get(f)
            if s is None:
                if len(memo) >= 4_096:
                    memo.clear()
                s = memo[f] = self.score(f)
            out[i, j] = s
        return out

    def decode(self, win: Window) -> list[tuple[int, int, int]]:
        """The best segmentation's entities: (kind, first token, token after the last)."""
        n = len(win.tokens)
        ends: dict[int, tuple[list[int], list[np.ndarray]]] = {}
        for (i, j), s in self.scores(win).items():
            starts, rows = ends.setdefault(j, ([], []))
            starts.append(i)
            rows.append(s)
        best = np.full((n + 1, _OUT + 1), -math.inf)
        best[0, _OUT] = 0
        into, stop = self.trans[:, :_OUT], self.trans[:, _OUT]
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, n + 1):
            c = best[j - 1] + stop
            p = int(c.argmax())
            best[j, _OUT], back[j, _OUT] = c[p], (j - 1, p)
            if j in ends:
                starts, rows = ends[j]
                c = (best[starts][:, :, None] + into + np.stack(rows)[:, None, :]).reshape(-1, _OUT)
                at = c.argmax(axis=0)
                for k in range(_OUT):
                    best[j, k], back[j, k] = c[at[k], k], (starts[at[k] // (_OUT + 1)], int(at[k]) % (_OUT + 1))
        out, j, y = [], n, int(best[n].argmax())
        while j:
            i, p = back[j, y]
            if y != _OUT:
                out.append((y, i, j))
            j, y = i, p
        return out[::-1]

    def learn(self, win: Window, gold: list[tuple[int, int, int]], rate: float, decay: float, square: dict[str, np.ndarray]) -> None:
        """One step up the exact log-likelihood of one labelled stretch (Adagrad)."""
        n, score = len(win.tokens), {(i, j): self.score(win.features(i, j)) for i, j in win.spans}
        self.memo.clear()
        ends: dict[int, list[int]] = {}
        for i, j in score:
            ends.setdefault(j, []).append(i)
        lse = np.logaddexp.reduce
        alpha = np.full((n + 1, _OUT + 1), -1e30)
        alpha[0, _OUT] = 0
        for j in range(1, n + 1):
            alpha[j, _OUT] = lse(alpha[j - 1] + self.trans[:, _OUT])
            if j in ends:
                alpha[j, :_OUT] = lse(np.stack([lse(alpha[i][:, None] + self.trans[:, :_OUT], axis=0) + score[i, j] for i in ends[j]]), axis=0)
        logz = lse(alpha[n])
        beta = np.full((n + 1, _OUT + 1), -1e30)
        beta[n] = 0
        starts: dict[int, list[int]] = {}
        for i, j in score:
            starts.setdefault(i, []).append(j)
        g_trans = np.zeros_like(self.trans)
        grad: dict[str, np.ndarray] = {}
        for i in range(n - 1, -1, -1):
            nxt = [self.trans[:, _OUT] + beta[i + 1, _OUT]]
            g_trans[:, _OUT] -= np.exp(alpha[i] + nxt[0] - logz)
            for j in starts.get(i, ()):
                step = self.trans[:, :_OUT] + score[i, j] + beta[j, :_OUT]
                nxt.append(lse(step, axis=1))
                p = np.exp(alpha[i][:, None] + step - logz)
                g_trans[:, :_OUT] -= p
                p = p.sum(axis=0)
                if p.max() > 1e-4:
                    for f in win.features(i, j):
                        grad[f] = grad.get(f, 0) - p
            beta[i] = lse(np.stack(nxt), axis=0)
        at, prev = 0, _OUT
        for y, i, j in [*gold, (_OUT, n, n)]:
            while at < i:
                g_trans[prev, _OUT] += 1
                prev, at = _OUT, at + 1
            if y != _OUT:
                g_trans[prev, y] += 1
                one = np.eye(_OUT)[y]
                for f in win.features(i, j):
                    grad[f] = grad.get(f, 0) + one
                prev, at = y, j
        self.trans += 0.02 * rate * g_trans
        for f, g in grad.items():
            v = self.w.get(f)
            if v is None:
                v = self.w[f] = np.zeros(_OUT)
                square[f] = np.full(_OUT, 1e-2)
            g = g - decay * v
            square[f] += g * g
            v += rate * g / np.sqrt(square[f])


# ------------------------------------------------------------------ labelled sentences
def _with_luhn(r: random.Random, n: int) -> str:
    d = "".join(str(r.randrange(10)) for _ in range(n - 1))
    return next(d + c for c in "0123456789" if luhn(d + c))


def training_sentences(count: int = 1000, seed: int = 5) -> Iterator[tuple[str, list[Span]]]:
    """Sentences with the spans of personal data in them."""
    r = random.Random(seed)
    syllables = "ra ti on el mu ver che lo an is or de ku pa sin th er nd".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))
    num = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    digits = lambda lo, hi: num(r.randrange(lo, hi))
    octet = lambda: str(r.randrange(256))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    dom = lambda: r.choice(["com", "org", "net", "io", "de", "fr"])

    def email():
        user = r.choice([word(), f"{word()}.{word()}", f"{word()}{digits(1, 4)}", f"{word()}_{word()}"])
        host = r.choice([word(), f"mail{digits(1, 3)}.{word()}", f"{word()}.{word()}"])
        return r.choice([
            f"{user}@{host}.{dom()}", f"{user} at {host.replace('.', ' dot ')} dot {dom()}", f"{user} (at) {host} (dot) {dom()}", f"{user}[at]{host}[dot]{dom()}",
            f"{user} [at] {host} [dot] {dom()}", f"{user} @ {host} . {dom()}", f"{user} AT {host} DOT {dom()}", f"{user}(at){host}.{dom()}",
        ])

    def ip():
        o = [octet() for _ in range(4)]
        return r.choice([".".join(o), ".".join(o), "[.]".join(o), " . ".join(o), "(.)".join(o)])

    def card():
        d = _with_luhn(r, r.choice([16, 16, 16, 15]))
        g = [d[k : k + 4] for k in range(0, len(d), 4)]
        return r.choice([d if len(d) == 16 else "-".join(g), " ".join(g), "-".join(g), ".".join(g), "/".join(g), " - ".join(g)])

    def phone():
        a, b, c = num(3), num(3), num(4)
        return r.choice([
            f"+{digits(1, 3)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{digits(1, 3)} {a} {b} {c}", f"+{digits(1, 3)} {a} {b} {c}",
            f"0{num(3)} {num(6)}", f"0{num(2)}/{num(7)}", f"+{digits(2, 3)}/{a}/{num(6)}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}",
            f"(0{num(2)}) {num(7)}", f"0{num(3)}-{num(7)}", f"1 {a} {b} {c}", f"0{num(4)} {b} {b}",
        ])

    def told():
        """Numbers that only the word before them tells to be a phone's."""
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"{a} {b} {c}", f"{b}-{c}", f"{a}{b}{c}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(4)} {num(4)}", f"{num(5)} {num(6)}"])

    make = {"email": email, "ip": ip, "card": card, "phone": phone}

    def wrong():
        """Sixteen digits that are no card number."""
        d = _with_luhn(r, 16)
        d = d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)
        return r.choice([d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4))])

    def other():
        return r.choice([
            f"Version {digits(1, 2)}.{digits(1, 2)}.", f"version {digits(1, 2)}.{digits(1, 3)}.{digits(1, 3)}", f"{r.randrange(1900, 2030)}", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1900, 2030)}",
            f"{r.randrange(1900, 2030)}-0{r.randrange(1, 10)}-{r.randrange(10, 29)}", f"password={hexa(18)}", f'token = "{hexa(40)}"', f"AKIA{''.join(r.choice('ABCDEFGHJKMNPQRSTUVWXYZ0123456789') for _ in range(16))}",
            f"{digits(1, 4)},{num(3)},{num(3)}", f"{digits(1, 4)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"order {digits(5, 13)}", f"page {digits(1, 4)}", f"isbn 978-{digits(1, 2)}-{num(3)}-{num(5)}-{num(1)}",
            f"{word()} at {word()}", f"at the {word()}. {word()}", f"{word()} dot {word()}", f"@{word()}", f"(c) {r.randrange(1990, 2030)}", f"{digits(1, 4)} {digits(1, 4)}", f"v{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{num(3)}{digits(1, 3)}",
            f"{digits(6, 16)}", f"{digits(6, 16)}", wrong(), f"{num(3)} {num(3)} {num(4)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"no. {num(4)} {num(4)}", f"id {hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"section {digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}.{digits(1, 3)}", f"{digits(20, 40)}", f"{num(4)} {num(4)} {num(4)}",
        ])

    cues = {"email": ["mail", "email:", "write to", "contact"], "ip": ["from", "host", "ip", "server"], "card": ["card", "visa", "credit card number"], "phone": ["call", "tel.", "tel:", "phone:", "phone", "fax", "telephone", "mobile", "text", "sms", "cell:", "call me on", "phone number"]}
    for _ in range(count):
        text, spans = "", []
        for _ in range(r.randrange(1, 4)):
            text += " ".join(word() for _ in range(r.randrange(0, 6))) + r.choice([" ", " ", ", ", ". "])
            if r.random() < 0.62:
                kind = r.choice(KINDS)
                bare = kind == "phone" and r.random() < 0.25
                if bare or r.random() < 0.35:
                    text += r.choice(cues[kind]) + " "
                s = told() if bare else make[kind]()
                spans.append((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += other()
            text += r.choice([" ", " ", " ", ". ", ", ", "; "])
        text += " ".join(word() for _ in range(r.randrange(0, 5)))
        yield text, spans


def train(count: int = 1000, seed: int = 5, rounds: int = 3) -> Field:
    """The field, trained on ``count`` made sentences."""
    field, square, data = Field(), {}, []
    for text, spans in training_sentences(count, seed):
        for win in windows(text):
            begin, end = {a: k for k, (a, _) in enumerate(win.tokens)}, {b: k + 1 for k, (_, b) in enumerate(win.tokens)}
            gold = [(KINDS.index(k), begin[a], end[b]) for k, a, b in spans if a in begin and b in end]
            if all((i, j) in set(win.spans) for _, i, j in gold):
                data.append((win, gold))
    for step in range(rounds):
        random.Random(seed + step).shuffle(data)
        for win, gold in data:
            field.learn(win, gold, 0.3 / (1 + 0.5 * step), 1e-3, square)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """The field's spans that touch no base span and no other."""
    taken = [(a, b) for _, a, b in base]
    out = []
    for win in windows(text):
        if not win.spans:
            continue
        for k, i, j in field.decode(win):
            a, b = win.tokens[i][0], win.tokens[j - 1][1]
            if all(b <= x or a >= y for x, y in taken):
                out.append((KINDS[k], a, b))
                taken.append((a, b))
    return out


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, by kind and then by start."""
    base = base_spans(text)
    more = added_spans(text, base, field) if text and (base or _TRIGGER.search(text)) else []
    return base, _ordered(base + more) if more else base


def mask(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; spans that overlap are one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@common.trimmed
def _digest(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "t"):
            out: list[list] = [[] for _ in range(6)]
            for t in b.column(1):
                base, full = find(t.as_py(), field)
                row = [sum(s[0] == k for s in base) for k in KINDS] + [hashlib.sha256(_said(base).encode()).hexdigest(), _said(full)]
                for column, v in zip(out, row):
                    column.append(v)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.record_batch([b.column(0), *(pa.array(c, k) for c, k in zip(out, kinds))], ["i", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of base spans, base_sha256, spans) of every row."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    one = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    schema = "i long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return one.mapInArrow(lambda it: _digest(it, shared.value), schema).withColumnRenamed("i", id_col)


@common.trimmed
def _masked(batches: Iterator[pa.RecordBatch], column: int, field: Field) -> Iterator[pa.RecordBatch]:
    for b in batches:
        text = []
        for t in b.column(column):
            t = t.as_py()
            spans = find(t, field)[1]
            text.append(mask(t, spans) if spans else t)
        cols = list(b.columns)
        cols[column] = pa.array(text, pa.string())
        yield pa.record_batch(cols, b.schema.names)


def masked(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """All columns, with every span in the text replaced by its kind in brackets."""
    common.ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda it: _masked(it, at, shared.value), docs.schema)


def op7_pii(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"))
