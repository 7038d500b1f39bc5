"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks (text between two block-level tags) with their ancestors. Features of a block
are its ancestors' tags and class words and what its text looks like; labels are main text or not. The field
is trained in numpy, by gradient ascent on the exact log-likelihood, on labelled pages that are made here from
layouts (``training_pages``); Viterbi decoding labels each page's blocks as one chain.

Reader comments are told by more than class words: by the heading over them, by bylines, and by named boxes that
stand beside others of the same name.

A block's character references are decoded, its white space (as ``str.split`` has it, so with no-break spaces) becomes one
space, blocks are joined in page order by a line feed. Scripts, styles, templates, comments, the head and titles are never
text; what other elements hold (formulas, fallbacks) is, and the field labels it. Reading takes time and memory in
proportion to the page: open elements are linked to their parents and found by tag.

Defined cases: null, empty or text-free html has the text "" and 0 characters; html without any tag is one
block; broken markup is read as far as it goes; repeated rows and ids are kept; null ids and urls stay null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html as charrefs
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zonalis.llm import common

BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noframes object ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul video audio canvas button label textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROP = frozenset("script style template head".split())
RAW = frozenset("script style textarea title xmp".split())
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    **{f"h{k}": frozenset(f"h{j}" for j in range(1, 7)) for k in range(1, 7)},
    "head": frozenset(["head", "body", "article", "div", "p", "nav", "header", "main", "section", "footer", "ul", "h1", "table"]),
}
_SCOPE = frozenset("ul ol table div section article main aside nav header footer form blockquote td body".split())
_MARK = re.compile(r"<(?:!--(?:.*?-->|.*)|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*)|[^>]*)(?:>|\Z))", re.S)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """An open element; ``feats`` are the features of all elements from the page's root to it."""

    __slots__ = ("tag", "names", "parent", "feats", "twins")

    def __init__(self, tag: str, names: str, parent: "Node | None", known):
        self.tag, self.names, self.parent = tag, names, parent
        feats = parent.feats if parent else _BIAS
        if tag not in ("html", "body"):
            new = [f"in:{tag}", *(f"is:{n}" for n in names.split()), *(f"like:{n[k : k + 4]}" for n in names.split() for k in range(len(n) - 3))]
            if known is not None:
                new = [f for f in new if f in known]
            if not feats.issuperset(new):
                feats = feats.union(new)
        self.feats: frozenset[str] = feats
        self.twins: dict[tuple[str, str], int] = {}


_BIAS = frozenset(["bias"])


class Block:
    __slots__ = ("node", "text", "linked", "seen", "twin")

    def __init__(self, node: Node, text: str, linked: int, seen: bool, twin: tuple[Node, tuple[str, str]] | None):
        self.node, self.text, self.linked, self.seen, self.twin = node, text, linked, seen, twin


def blocks(page: str | None, known=None) -> list[Block]:
    """Leaf blocks in page order: innermost element, text, characters inside links, whether an article has ended before, and the
    innermost named box as (its parent, its tag and names). Of the elements' features only ``known`` ones are kept."""
    out: list[Block] = []
    root = Node("", "", None, known)
    stack: list[Node] = []
    where: dict[str, list[int]] = {}  # places on the stack by tag
    blocky: list[int] = []  # of block elements
    marks: list[int] = []  # of elements that an opening tag may close or stops at
    boxes: list[tuple[int, tuple[Node, tuple[str, str]]]] = []  # of boxes with a name
    held: list[str] = []
    linked = drop = 0
    seen = False
    if not page:
        return out

    def flush():
        nonlocal linked
        if held:
            text = " ".join(charrefs.unescape("".join(held)).split())
            if text:
                out.append(Block(stack[-1] if stack else root, text, min(linked, len(text)), seen, boxes[-1][1] if boxes else None))
            held.clear()
        linked = 0

    def push(tag, names):
        nonlocal drop
        at, parent = len(stack), stack[-1] if stack else root
        stack.append(Node(tag, names, parent, known))
        where.setdefault(tag, []).append(at)
        if tag in BLOCK:
            blocky.append(at)
            if names and tag in _BOX:
                key = (tag, names)
                parent.twins[key] = parent.twins.get(key, 0) + 1
                boxes.append((at, (parent, key)))
        if tag in CLOSES or tag in _SCOPE:
            marks.append(at)
        drop += tag in DROP

    def pop():
        nonlocal drop, seen
        at = len(stack) - 1
        tag = stack.pop().tag
        where[tag].pop()
        for places in (blocky, marks):
            if places and places[-1] == at:
                places.pop()
        if boxes and boxes[-1][0] == at:
            boxes.pop()
        drop -= tag in DROP
        seen = seen or tag in ("article", "main")

    def add(text):
        nonlocal linked
        if text and not drop:
            held.append(text)
            if where.get("a"):
                linked += len(text)

    at = 0
    while True:
        m = _MARK.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if where.get(tag):
                last = where[tag][-1]
                if tag in BLOCK or tag in DROP:
                    flush()
                elif blocky and blocky[-1] > last:
                    continue  # an inline end tag does not close blocks
                while len(stack) > last:
                    pop()
            elif tag in ("p", "br"):
                held.append(" ")
            continue
        if tag in BLOCK or tag in DROP:
            flush()
            k = len(marks) - 1
            while k >= 0:
                i = marks[k]
                open_tag = stack[i].tag
                if tag in CLOSES.get(open_tag, ()):
                    while len(stack) > i:
                        pop()
                    if open_tag != "p":
                        break
                elif open_tag in _SCOPE:
                    break
                k = min(k, len(marks)) - 1
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        names = " ".join(_WORD.findall(" ".join(a or b or c for a, b, c in _NAMED.findall(m[3])).lower())) if m[3] else ""
        if not m[3].endswith("/") or tag in BLOCK:
            push(tag, names)
        if tag in RAW and stack and stack[-1].tag == tag:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "xmp":  # its text is no markup
                add(charrefs.escape(page[at:stop], quote=False))
            else:
                add(page[at:stop] if end and tag == "textarea" else "")
            at = stop
    flush()
    return out


_HEADS = frozenset("h1 h2 h3 h4 h5 h6 legend summary dt".split())
_BOX = frozenset("div li section article aside ul ol dl dd blockquote table tr td fieldset figure".split())
_TALK = re.compile(r"\b(?:comments?|repl(?:y|ies)|responses?|discussions?|leave a|join the|kommentare?|commentaires?|comentarios?|said|talk ?back)\b", re.I)
_SAYS = re.compile(r"\b(?:says?|said|wrote|writes|replied|commented|schrieb|dit|dijo)\s*:?$|\bago\b|^(?:reply|report|like|permalink|antworten|répondre|responder)$|^(?:posted|by)\b", re.I)


def features(b: Block, head: str = "") -> tuple[str, ...]:
    """Features of a block: its elements, its text, and the heading that it stands under."""
    n = len(b.text)
    words = b.text.count(" ") + 1
    linked = b.linked / n
    inside = b.node.feats
    return (
        *inside,
        f"own:{b.node.tag}",
        f"words:{min(7, words.bit_length())}",
        f"linked:{0 if linked == 0 else 1 if linked < 0.4 else 2 if linked < 0.9 else 3}",
        f"stop:{b.text[-1] in '.!?…:;\"'}",
        f"bars:{'|' in b.text or '»' in b.text}",
        f"rights:{'©' in b.text or '&copy' in b.text or 'copyright' in b.text[:80].lower()}",
        f"after:{b.seen and 'in:article' not in inside and 'in:main' not in inside}",
        f"twins:{min(3, b.twin[0].twins[b.twin[1]]) if b.twin else 0}",
        f"says:{words <= 12 and bool(_SAYS.search(b.text))}",
        f"talk:{bool(head) and bool(_TALK.search(head))}",
    )


def chain(got: list[Block]) -> list[tuple[str, ...]]:
    """Features of a page's blocks."""
    out, head = [], ""
    for b in got:
        if b.node.tag in _HEADS:
            head = b.text[:80] if b.text.count(" ") < 8 else ""
        out.append(features(b, head))
    return out


class Field:
    """Linear-chain CRF with two labels (0 other, 1 main text)."""

    def __init__(self, names: dict[str, int], w: np.ndarray, trans: np.ndarray, start: np.ndarray):
        self.w = {k: (float(w[i, 0]), float(w[i, 1])) for k, i in names.items()}
        self.trans, self.start = trans.tolist(), start.tolist()

    @classmethod
    def train(cls, chains: list[tuple[list[tuple[str, ...]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> "Field":
        names = {f: i for i, f in enumerate(sorted({f for fs, _ in chains for b in fs for f in b}))}
        n, steps = len(chains), max(len(y) for _, y in chains)
        y, mask = np.zeros((n, steps), int), np.zeros((n, steps), bool)
        for i, (_, labels) in enumerate(chains):
            y[i, : len(labels)], mask[i, : len(labels)] = labels, True
        # the features of all blocks, one block after the other in the order of the mask
        at = np.array([names[f] for fs, _ in chains for b in fs for f in b])
        size = np.array([len(b) for fs, _ in chains for b in fs])
        first = np.cumsum(size) - size
        gold = np.eye(2)[y] * mask[..., None]
        pairs, total = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:]), mask.sum()
        theta = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)]
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in theta]
        for step in range(1, rounds + 1):
            w, trans, start = theta
            score = np.zeros((n, steps, 2))
            score[mask] = np.add.reduceat(w[at], first)
            alpha, beta = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
            alpha[:, 0] = start + score[:, 0]
            for t in range(1, steps):
                new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + trans, axis=1) + score[:, t]
                alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
            for t in range(steps - 2, -1, -1):
                new = np.logaddexp.reduce(trans + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
            logz = np.logaddexp.reduce(alpha[:, -1], axis=1)
            node = np.exp(alpha + beta - logz[:, None, None]) * mask[..., None]
            edge = alpha[:, :-1, :, None] + trans + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None]
            edge = (np.exp(np.minimum(edge, 0)) * mask[:, 1:, None, None]).sum(axis=(0, 1))
            off = np.repeat((gold - node)[mask], size, axis=0)
            slope = np.stack([np.bincount(at, off[:, k], len(names)) for k in range(2)], axis=1)
            grads = [slope, pairs - edge, (gold - node)[:, 0].sum(axis=0)]
            for p, g, (m1, m2) in zip(theta, grads, moments):
                g = g / total - decay * p
                m1 += 0.1 * (g - m1)
                m2 += 0.01 * (g * g - m2)
                p += rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        return cls(names, *theta)

    def decode(self, chain: list[tuple[str, ...]]) -> list[int]:
        """Viterbi labels of one chain."""
        if not chain:
            return []
        (t00, t01), (t10, t11) = self.trans
        get, zero = self.w.get, (0.0, 0.0)
        back = []
        a, b = self.start
        for t, fs in enumerate(chain):
            s0 = s1 = 0.0
            for f in fs:
                u, v = get(f, zero)
                s0 += u
                s1 += v
            if t:
                f0, f1 = b + t10 > a + t00, b + t11 > a + t01
                back.append((f0, f1))
                a, b = (b + t10 if f0 else a + t00) + s0, (b + t11 if f1 else a + t01) + s1
            else:
                a, b = a + s0, b + s1
        out = [int(b > a)]
        for step in reversed(back):
            out.append(int(step[out[-1]]))
        return out[::-1]


# ------------------------------------------------------------------ labelled pages
def training_pages(count: int = 400, seed: int = 11) -> Iterator[tuple[str, list[int]]]:
    """Pages made from layouts, with the label of each of their blocks."""
    r = random.Random(seed)
    syllables = "ra ti on el mu ver che lo an is or de ku pa sin".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randrange(1, 4)))

    def words(lo, hi):
        return " ".join(word() for _ in range(r.randrange(lo, hi)))

    def sentences(lo, hi):
        return " ".join(words(4, 14).capitalize() + r.choice(".....?!") for _ in range(r.randrange(lo, hi)))

    for _ in range(count):
        out: list[str] = []
        labels: list[int] = []

        def leaf(tag, text, label, attr="", out=out, labels=labels):
            out.append(f"<{tag}{attr}>{text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.8 else ""))
            labels.append(label)

        def menu(box, attr="", out=out, labels=labels):
            out.append(f"<{box}{attr}><ul>")
            for _ in range(r.randrange(2, 9)):
                out.append("<li>")
                leaf("a", words(1, 3), 0, f' href="/{word()}"')
                out.append("</li>")
            out.append(f"</ul></{box}>")

        def name(*options):
            return f' {r.choice(["class", "class", "id"])}="{r.choice(options)}"'

        def notice():
            kind = r.randrange(6)
            if kind == 0:
                out.append(f"<div{name('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'banner ad')}>")
                leaf(r.choice(["p", "span", "div"]), r.choice([words(2, 8), sentences(1, 3)]), 0)
                out.append("</div>")
            elif kind == 1:
                leaf("div", sentences(1, 3), 0, name("cookie", "cookie-notice", "consent", "notice", "alert", "newsletter", "popup"))
            elif kind == 2:
                out.append(f"<aside{name('sidebar', 'related', 'widget')}>")
                leaf("h3", words(1, 4), 0)
                for _ in range(r.randrange(1, 5)):
                    leaf("p", r.choice([words(3, 9), sentences(1, 3)]), 0)
                out.append("</aside>")
            elif kind == 3:
                out.append("<form>")
                leaf("label", words(1, 4), 0)
                out.append('<input type="text">')
                leaf("button", words(1, 2), 0)
                out.append("</form>")
            elif kind == 4:
                leaf("div", r.choice([words(2, 8), sentences(1, 3)]), 0, name("ad", "advertisement", "sponsor", "promo"))
            else:
                out.append(f"<div{name('sidebar', 'share', 'social', 'breadcrumb', 'breadcrumbs', 'related', 'tags', 'pagination')}>")
                leaf(r.choice(["p", "a", "span"]), words(1, 6), 0)
                out.append("</div>")

        def talk():
            """Reader comments; their boxes have all kinds of names, or none."""
            box = r.choice(["section", "div", "div", "ol", "ul", "aside"])
            whole = name(*"comments comment-list commentlist comments-area reader-comments replies responses respond disqus_thread discussion thread feedback conversation talkback".split())
            out.append(f"<{box}{whole if r.random() < 0.7 else name(word())}>")
            if r.random() < 0.75:
                cue = r.choice([f"{r.randrange(1, 90)} comments", "Comments", "Responses", "Leave a reply", "Join the discussion", "Reader replies", f"{r.randrange(2, 20)} responses to {words(1, 4)}", "What readers said", words(1, 3)])
                leaf(r.choice(["h2", "h3", "h4", "div", "p"]), cue, 0)
            item, attr = ("li" if box in ("ol", "ul") else r.choice(["div", "article", "section"])), r.choice([name("comment", "reply", "comment-body", "post-reply", "response", "message"), name(word())])
            for _ in range(r.randrange(1, 6)):
                out.append(f"<{item}{attr}>")
                if r.random() < 0.6:
                    leaf(r.choice(["div", "p", "cite", "header", "h5"]) if item != "li" else r.choice(["div", "p"]), r.choice([f"{word()} says:", f"{word()} wrote:", f"{word()} {word()} said", f"{r.randrange(2, 20)} hours ago", f"Posted by {word()}", word()]), 0) if r.random() < 0.9 else None
                for _ in range(r.randrange(1, 3)):
                    leaf("p", r.choice([sentences(1, 4), words(2, 9)]), 0)
                if r.random() < 0.4:
                    leaf(r.choice(["div", "button"]), r.choice(["Reply", "Report", "Like", "Permalink", words(1, 2)]), 0)
                out.append(f"</{item}>")
            out.append(f"</{box}>")

        def main():
            box = r.choice(["article", "article", "article", "main", "div", "section"])
            attr = name("content", "main", "post", "article", "entry", "article-body", "post-content") if box in ("div", "section") or r.random() < 0.3 else ""
            out.append(f"<{box}{attr}>")
            if r.random() < 0.85:
                leaf("h1", words(1, 10) + r.choice(["", ".", ""]), 1)
            for _ in range(r.randrange(0, 12)):
                kind = r.randrange(16)
                if kind < 10:
                    text = r.choice([sentences(1, 6), sentences(1, 6), words(1, 5), " | ".join(words(1, 2) for _ in range(8)), words(1, 2) + "."])
                    if r.random() < 0.2:
                        text = f"<b>{text}<br>"
                    if r.random() < 0.2:
                        text += f' <a href="/x">{words(1, 4)}</a> {words(1, 4)}.'
                    leaf("p", text, 1)
                elif kind == 10:
                    leaf(f"h{r.randrange(2, 5)}", words(1, 8), 1)
                elif kind == 11:
                    out.append("<ul>")
                    for _ in range(r.randrange(1, 5)):
                        leaf("li", r.choice([words(1, 9), sentences(1, 2)]), 1)
                    out.append("</ul>")
                elif kind == 12:
                    leaf(r.choice(["blockquote", "pre", "figcaption"]), sentences(1, 3), 1)
                elif kind == 13:
                    out.append("<table><tr>")
                    leaf("td", words(1, 4), 1)
                    leaf("td", words(1, 4), 1)
                    out.append("</tr></table>")
                elif kind == 14 and r.random() < 0.5:
                    notice()
                elif kind == 15 and r.random() < 0.5:  # named boxes that repeat are not always comments
                    part = name("section", "paragraph", "chapter", "block", "text", word())
                    for _ in range(r.randrange(2, 4)):
                        out.append(f"<div{part}>")
                        if r.random() < 0.4:
                            leaf("h3", r.choice([words(1, 5), "Discussion", "Response of the board"]), 1)
                        leaf("p", sentences(1, 5), 1)
                        out.append("</div>")
                else:
                    out.append(f"<script>var {word()}='<p>';</script>")
            if r.random() < 0.15:
                talk()
            out.append(f"</{box}>")

        out.append(f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>")
        bare = r.random() < 0.05
        if not bare:
            if r.random() < 0.4:
                out.append("<header>")
                leaf(r.choice(["div", "p", "h2"]), words(1, 5), 0)
                if r.random() < 0.5:
                    menu("nav")
                out.append("</header>")
            if r.random() < 0.8:
                menu(r.choice(["nav", "nav", "div"]), r.choice(["", name("menu", "nav", "navbar", "top-menu")]))
            for _ in range(r.randrange(3)):
                notice()
        main()
        if not bare:
            if r.random() < 0.4:
                talk()
            for _ in range(r.randrange(2)):
                notice()
            if r.random() < 0.85:
                out.append("<footer>")
                if r.random() < 0.3:
                    leaf("p", words(1, 5), 0)
                leaf(r.choice(["p", "div", "span"]), f"&copy; {word()}.org {words(1, 12)}.", 0)
                out.append("</footer>")
        out.append("</body></html>")
        yield "".join(out), labels


def train(count: int = 400, seed: int = 11) -> Field:
    """The field, trained on ``count`` made pages (those whose blocks read as they were made)."""
    chains = []
    for page, labels in training_pages(count, seed):
        got = blocks(page)
        if len(got) == len(labels) and got:
            chains.append((chain(got), labels))
    return Field.train(chains)


def main_text(page: str | None, field: Field) -> str:
    got = blocks(page, field.w)
    return "\n".join(b.text for b, y in zip(got, field.decode(chain(got))) if y)


def _extract(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for b in common.slices(whole, "h"):
            text = [main_text(h.as_py(), field) for h in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], ["i", "u", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    common.ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or train())
    one = pages.select(F.col(id_col).cast("long").alias("i"), F.col(url_col).alias("u"), F.col(html_col).alias("h"))
    out = one.mapInArrow(lambda it: _extract(it, shared.value), "i long, u string, text string, n_chars long")
    return out.withColumnsRenamed({"i": id_col, "u": url_col})


def op2_html(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
