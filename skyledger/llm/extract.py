"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page."""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyledger.llm.common import over_batches

# A quote opens a value only after an equals sign; any other one is a character like the rest.
VALUE = r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?"
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|{VALUE})*+)>")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"[ \t\n\r\f\v]+")
# Elements whose content is no text, those that stay within a block, and those that never hold any.
RAW = {"script", "style", "template", "textarea", "iframe"}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby "
    "s samp small span strike strong sub sup time tt u var wbr noscript object svg g defs use path rect circle "
    "ellipse line polyline polygon text tspan math semantics "
    "mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle annotation".split()
)
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
# A start tag that ends an open element of the same family.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th",
          "th": "td th", "option": "option"}
ENDS_P = set(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split()
)


# Elements past which a start tag ends nothing.
BARRIERS = {"table", "ul", "ol", "dl", "article", "section", "main", "body"}


class Block:
    """Text between two block boundaries, and where it stands: the innermost element that isn't inline, and
    the tags and names of all elements around it."""

    __slots__ = ("inner", "around", "parts", "linked", "_text")

    def __init__(self, inner: str, around: frozenset):
        self.inner, self.around = inner, around
        self.parts: list[str] = []
        self.linked, self._text = 0, None

    def text(self) -> str:
        if self._text is None:
            self._text = SPACE.sub(" ", "".join(self.parts)).strip(" ")
        return self._text


class Elements:
    """The open elements of a page. Every step costs the elements that it closes, however many are open.

    ``known`` limits what is remembered of their tags and names; what an element adds to those of the
    elements around it is kept with it, and one that adds nothing shares their set.
    """

    def __init__(self, known: set | dict | None):
        self.known = known
        self.stack: list[tuple[str, str, frozenset]] = []  # name, innermost that isn't inline, around
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]  # open names since the last barrier
        self.links = 0

    def where(self) -> tuple[str, frozenset]:
        return self.stack[-1][1:] if self.stack else ("", frozenset())

    def push(self, name: str, marks: str) -> None:
        inner, around = self.where()
        if name not in INLINE:
            inner = name
            new = {"tag:" + name}
            if marks:
                new.update("name:" + w for _, v in NAMED.findall(marks) for w in WORDS.findall(v.lower()))
            if self.known is not None:
                new = {x for x in new if x in self.known}
            if not new <= around:
                around = around | new
        self.stack.append((name, inner, around))
        self.count[name] = self.count.get(name, 0) + 1
        if name in BARRIERS:
            self.scopes.append({})
        else:
            scope = self.scopes[-1]
            scope[name] = scope.get(name, 0) + 1
        self.links += name == "a"

    def pop(self) -> str:
        name = self.stack.pop()[0]
        self.count[name] -= 1
        if name in BARRIERS:
            self.scopes.pop()
        else:
            self.scopes[-1][name] -= 1
        self.links -= name == "a"
        return name

    def close(self, name: str) -> None:
        """An end tag closes the elements down to the last one of its name, if there is one."""
        if self.count.get(name):
            while self.pop() != name:
                pass

    def make_way(self, closing: set[str]) -> None:
        """Closes the elements down to the last one of these names, if there is one before a barrier."""
        scope = self.scopes[-1]
        if any(scope.get(c) for c in closing):
            while self.pop() not in closing:
                pass


def blocks(page: str, known: set | dict | None = None) -> list[Block]:
    """The leaf blocks of a page in order, in time linear in the page, whatever it holds; never fails.

    Unclosed elements end with their parent, stray end tags are ignored, comments and raw elements
    have no text; an unclosed comment or raw element lasts to the end of the page. Of the tags and names
    around a block those in ``known`` are kept, all if it isn't given.
    """
    found: list[Block] = []
    open_ = Elements(known)
    current, at, n = None, 0, len(page)

    def add(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if not piece.strip(" \t\n\r\f\v"):
                return
            current = Block(*open_.where())
            found.append(current)
        if "&" in piece:
            piece = entities.unescape(piece)
        current.parts.append(piece)
        if open_.links:
            current.linked += len(piece.strip())

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        add(page[at:begin])
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
            continue
        if page[begin + 1 : begin + 2] in ("!", "?"):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
            continue
        m = TAG.match(page, begin)
        if m is None:
            end = page.find(">", begin) if page[begin + 1 : begin + 2].isalpha() else -1
            if end < 0 and page[begin + 1 : begin + 2].isalpha():
                break  # a tag that the page cuts off
            if end < 0:
                add("<")
                at = begin + 1
            else:
                at = end + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name not in INLINE:
                current = None
            open_.close(name)
            continue
        if name == "br":
            add(" ")
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = RAW_END[name].search(page, at)
                at = n if end is None else end.end()
            continue
        if name not in INLINE:
            current = None
            closing = set(CLOSES.get(name, "").split()) | ({"p"} if name in ENDS_P else set())
            if closing:
                open_.make_way(closing)
        if name in EMPTY or m[3].endswith("/"):
            continue
        open_.push(name, m[3])
    return [b for b in found if b.text()]


def own_shape(block: Block) -> tuple[str, int, int, bool, bool]:
    """What a block's own features tell: its element, the logarithm of its words, its share of links,
    whether it ends like a sentence, and whether it speaks of rights."""
    text = block.text()
    return (
        block.inner, min((text.count(" ") + 2).bit_length() - 1, 8), min(4 * block.linked // len(text), 4),
        text[-1] in ".!?:;\"'", "©" in text or "copyright" in text.lower(),
    )


def own_features(shape: tuple[str, int, int, bool, bool]) -> list[str]:
    inner, words, linked, stop, rights = shape
    out = ["bias", "in:" + inner, f"words:{words}", f"linked:{linked}", "stop" if stop else "no-stop"]
    return [*out, "rights"] if rights else out


def describe(block: Block) -> list[str]:
    """All features of a block: its own, and the tags and names of the elements around it."""
    return own_features(own_shape(block)) + sorted(block.around)


@dataclass
class Field:
    """Weights of features per label, of the first label and of label pairs; label 1 is main text."""

    index: dict[str, int]
    unary: np.ndarray
    start: np.ndarray
    pair: np.ndarray

    def scores(self, found: list[Block]) -> np.ndarray:
        """Per block and label the sum of its features' weights; that of what is around is shared."""
        if not hasattr(self, "weights"):
            self.weights = {f: tuple(self.unary[k].tolist()) for f, k in self.index.items()}
        weights, shared, out = self.weights, {}, []

        def total(features) -> tuple[float, float]:
            known = [weights[f] for f in features if f in weights]
            return sum(x for x, _ in known), sum(y for _, y in known)

        for b in found:
            shape = own_shape(b)
            around, own = shared.get(b.around), shared.get(shape)
            if around is None:
                around = shared[b.around] = total(sorted(b.around))
            if own is None:
                own = shared[shape] = total(own_features(shape))
            out.append((around[0] + own[0], around[1] + own[1]))
        return np.array(out)

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        scores = self.scores(found)
        (p00, p01), (p10, p11) = self.pair.tolist()
        x, y = (scores[0] + self.start).tolist()
        back = []
        for s, t in scores[1:].tolist():
            a, b, c, d = x + p00, y + p10, x + p01, y + p11
            back.append((b > a, d > c))
            x, y = max(a, b) + s, max(c, d) + t
        labels = [int(y > x)]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


# Fixed names for training pages: where main text stands, and what is around it.
MAIN = [("article", ""), ("main", ""), ("div", "content"), ("div", "post body"), ("section", "story"),
        ("div", "article text"), ("article", "entry"), ("div", "main content")]
AROUND = [
    ("nav", "", "menu"), ("div", "menu", "menu"), ("header", "", "line"), ("header", "site", "menu"),
    ("div", "header top", "line"), ("aside", "", "box"), ("div", "sidebar", "box"), ("div", "related", "menu"),
    ("div", "ad", "line"), ("div", "ads banner", "line"), ("div", "advert sponsored", "box"),
    ("section", "promo", "box"), ("div", "cookie notice", "line"), ("div", "consent banner", "box"),
    ("div", "breadcrumb", "menu"), ("form", "", "form"), ("form", "search newsletter", "form"),
    ("div", "share social", "menu"), ("div", "popup modal subscribe", "box"), ("div", "notice alert", "line"),
]
AFTER = [
    ("footer", "", "line"), ("footer", "site", "menu"), ("div", "footer", "line"),
    ("section", "comments", "talk"), ("div", "comments", "talk"), ("div", "comment list", "talk"),
    ("div", "disqus replies", "talk"),
]
TEXT = """the river rose again in spring and old people of the town said that water remembers every house it
has been in ; nobody wrote down what they meant but many of us still move our books upstairs when snow melts
early while children count boats from a window and ask how long a flood can last this year or next""".split()


def _sentence(draw, low: int, high: int, stop: str = ".") -> str:
    return " ".join(draw.choice(TEXT, int(draw.integers(low, high)))).capitalize() + stop


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page by rule from the fixed names, and the label of each of its blocks."""
    draw = np.random.default_rng(seed)
    out, labels = [], []

    def put(markup: str, label: int | None = None) -> None:
        out.append(markup)
        if label is not None:
            labels.append(label)

    def around(kind: tuple[str, str, str], label: int = 0) -> None:
        tag, names, what = kind
        put(f'<{tag} {"class" if draw.random() < 0.7 else "id"}="{names}">' if names else f"<{tag}>")
        if what == "menu":
            put("<ul>")
            for _ in range(int(draw.integers(2, 7))):
                put(f'<li><a href="/x">{_sentence(draw, 1, 3, "")}</a></li>', label)
            put("</ul>")
        elif what == "form":
            put(f"<label>{_sentence(draw, 1, 3, '')}</label><input>", label)
            put(f"<button>{_sentence(draw, 1, 2, '')}</button>", label)
        elif what == "talk":
            put(f"<h3>{_sentence(draw, 1, 3, '')}</h3>", label)
            for _ in range(int(draw.integers(1, 4))):
                put(f"<p>{_sentence(draw, 3, 40)}</p>", label)
        elif what == "box":
            put(f"<h4>{_sentence(draw, 1, 4, '')}</h4>", label)
            put(f"<p>{_sentence(draw, 4, 25)}</p>", label)
        else:
            sign = "&copy; " if "foot" in tag + names and draw.random() < 0.6 else ""
            put(sign + _sentence(draw, 2, 18, "." if draw.random() < 0.7 else ""), label)
        put(f"</{tag}>")

    put(f"<html><head><title>{_sentence(draw, 2, 8, '')}</title></head><body>", 0)
    for k in draw.permutation(len(AROUND))[: int(draw.integers(0, 6))]:
        around(AROUND[k])
    tag, names = MAIN[int(draw.integers(len(MAIN)))]
    put(f'<{tag} class="{names}">' if names else f"<{tag}>")
    if draw.random() < 0.8:
        put(f"<h1>{_sentence(draw, 1, 9, '')}</h1>", 1)
    if draw.random() < 0.2:
        around(AROUND[int(draw.integers(len(AROUND)))])
    for _ in range(int(draw.integers(1, 9))):
        kind = draw.random()
        if kind < 0.7:
            stop = "." if draw.random() < 0.8 else ""
            put(f"<p>{_sentence(draw, 1, int(draw.integers(3, 80)), stop)}</p>", 1)
        elif kind < 0.8:
            put(f"<h2>{_sentence(draw, 1, 6, '')}</h2>", 1)
        elif kind < 0.9:
            put(f"<blockquote>{_sentence(draw, 3, 30)}</blockquote>", 1)
        else:
            put("<ul>")
            for _ in range(int(draw.integers(1, 4))):
                put(f"<li>{_sentence(draw, 1, 12)}</li>", 1)
            put("</ul>")
        if draw.random() < 0.08:
            around(AROUND[int(draw.integers(len(AROUND)))])
    inside = draw.random() < 0.2
    if not inside:
        put(f"</{tag}>")
    for k in draw.permutation(len(AFTER))[: int(draw.integers(0, 4))]:
        around(AFTER[k])
    return "".join(out) + (f"</{tag}>" if inside else "") + "</body></html>", labels


def train(pages: int = 240, steps: int = 120, rate: float = 0.15, decay: float = 1e-3) -> Field:
    """The field that makes the labels of the training pages likeliest, by Adam on the log-likelihood.

    Expected counts come from forward and backward sums over all pages at once.
    """
    data = []
    for seed in range(pages):
        page, labels = labelled_page(seed)
        found = blocks(page)
        if len(found) != len(labels):
            raise ValueError(f"training page {seed} has {len(found)} blocks for {len(labels)} labels")
        data.append(([describe(b) for b in found], labels))
    seen = sorted({f for rows, _ in data for r in rows for f in r})
    index = {f: k for k, f in enumerate(seen)}
    count, longest = len(data), max(len(y) for _, y in data)
    x = np.zeros((count, longest, len(seen)), dtype=np.float32)
    y, mask = np.zeros((count, longest), dtype=int), np.zeros((count, longest), dtype=bool)
    for i, (rows, labels) in enumerate(data):
        for k, r in enumerate(rows):
            x[i, k, [index[f] for f in r]] = 1
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    truth = np.eye(2)[y] * mask[..., None]
    p = [np.zeros((len(seen), 2)), np.zeros(2), np.zeros((2, 2))]
    goal = [
        np.einsum("ikf,ikl->fl", x, truth), truth[:, 0].sum(axis=0),
        np.einsum("ika,ikb->ab", truth[:, :-1], truth[:, 1:]),
    ]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]

    def together(a, axis):
        top = a.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))

    last = mask.sum(axis=1) - 1
    for step in range(1, steps + 1):
        s = x @ p[0]
        ahead, behind = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        ahead[:, 0] = s[:, 0] + p[1]
        for k in range(1, longest):
            ahead[:, k] = s[:, k] + together(ahead[:, k - 1, :, None] + p[2], 1)
        for k in range(longest - 2, -1, -1):
            go = together((s[:, k + 1] + behind[:, k + 1])[:, None, :] + p[2], 2)
            behind[:, k] = np.where((k < last)[:, None], go, 0)
        whole = together(ahead[np.arange(count), last], 1)
        mine = np.exp(ahead + behind - whole[:, None, None]) * mask[..., None]
        joint = (
            ahead[:, :-1, :, None] + p[2] + (s[:, 1:] + behind[:, 1:])[:, :, None, :]
            - whole[:, None, None, None]
        )
        both = np.exp(np.minimum(joint, 0)) * mask[:, 1:, None, None]
        hoped = [np.einsum("ikf,ikl->fl", x, mine), mine[:, 0].sum(axis=0), both.sum(axis=(0, 1))]
        for k in range(3):
            g = (hoped[k] - goal[k]) / count + decay * p[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (
                np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            )
    return Field(index, *p)


def main_text(page: str | None, model: Field) -> str:
    """Blocks that the field calls main text, joined by one space."""
    found = blocks(page or "", model.index)
    if not found:
        return ""
    return " ".join(b.text() for b, y in zip(found, model.decode(found), strict=True) if y)


def _extract(shared):
    def build():
        model = shared.value

        def work(batch: pa.RecordBatch) -> list:
            texts = [main_text(h.as_py(), model) for h in batch.column("html")]
            return [batch.column("page_id"), batch.column("url"), texts, [len(t) for t in texts]]

        return work

    return build


def extract(pages: DataFrame, model: Field | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points); null html counts as empty.

    The field is trained on labelled pages made by rule (``labelled_page``), unless one is given.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train())
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return over_batches(rows, _extract(shared), "page_id long, url string, text string, n_chars long")
