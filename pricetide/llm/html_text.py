"""Main text of web pages: a recurrent block labeller.

A page is cut into leaf blocks. Each block has two vectors: its tag path (element names, class and id words, hashed)
and its words (hashed), with its length, link share, place, and the share of the page's unlinked text that its nearest two
containers hold. A bidirectional LSTM in numpy reads the blocks of a page
in both directions and decides for each, with the whole page as context, whether it is main text.

Training: at most ``SAMPLE_PAGES`` pages, picked by the hash of page_id. Blocks inside article or main elements, but
not inside menus, forms and the like, are labelled main text, and all others not; on a page without such elements,
blocks of eight words or more with few links. Each page is also seen in other
layouts: its containers are renamed, its text is partly laid out as lists, tables, quotes and short paragraphs, and blocks are
added from other pages as side bars, notices, comments and so on, so that the paths and not one site's template are learned. Pages are labelled by the model alone.

Defined results: a null or empty page has an empty text. Scripts, styles, templates, titles, text areas, comments and
what stands in the head are no blocks; without an end tag a template is none, and the other elements reach to the end of the page. Drawings,
formulas and fallbacks are text like any other. Character references are decoded; white space within a block becomes one space; blocks are joined
by one line feed; nothing is capped. Unclosed elements end with their container. Tags end as quotes in their attributes say; from a tag on
whose quotes never close, quotes do not count, and what follows the page's last > is text. Reading a page takes time in proportion to its length. Repeated rows are labelled alike;
extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepared

SAMPLE_PAGES = 240
PATH, WORDS, PLAIN = 128, 32, 8
HIDDEN = 16
EPOCHS = 12
LAYOUTS = 3

# What a tag begins with; where it ends is found by hand, as a pattern would search to the end of the page at every <.
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9-]*)|[!?/])")
_PLAIN = re.compile("[^>\"']*")
# Elements whose content is no markup: to their end tag, or to the end of the page.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "title", "textarea")}
# Drawings and formulas stand in a line of text; an HTML element among their own ends them.
_FOREIGN = frozenset(("svg", "math"))
_BREAKS_OUT = frozenset(
    "article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr li main menu nav ol p pre section table ul".split()
)
# Elements with a fallback, which may also stand in a line.
_EMBEDDED = frozenset("noscript object iframe select".split())
# What may follow an element's name: custom elements such as title-bar and prefixed names are others.
_SPACE = frozenset(("", " ", "\t", "\n", "\r", "\f", "/"))
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strong sub sup time tt u var wbr br img input label ins del big".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that end an open element of the same kind.
_SELF_CLOSING = frozenset("p li dt dd tr td th option h1 h2 h3 h4 h5 h6".split())


_MAIN = {"article", "main"}
_OTHER = {"nav", "aside", "footer", "header", "form", "menu", "button"}


_codes: dict[str, int] = {}
_bits: dict[str, int] = {}


def _code(word: str) -> int:
    if word not in _codes:
        if len(_codes) > 300_000:
            _codes.clear()
        _codes[word] = zlib.crc32(word.encode("utf-8", "replace"))
    return _codes[word]


def _name_bits(name: str) -> int:
    if name not in _bits:
        if len(_bits) > 100_000:
            _bits.clear()
        _bits[name] = sum({1 << _code(word) % PATH for word in re.split(r"[^a-z0-9]+", name) if word})
    return _bits[name]


class Place:
    """An open element: what its path says, and its container. Only the path below the root element counts."""

    __slots__ = ("bits", "depth", "element", "main", "name", "other", "text", "up")

    def __init__(self, up: Place | None, name: str):
        self.up, self.name, self.element = up, name, name.split(" ")[0]
        self.depth, self.text = (up.depth if up else 0) + 1, 0
        self.bits = up.bits if up else 0
        if up:
            self.bits |= _name_bits(name)
        self.main = bool(up and up.main) or self.element in _MAIN
        self.other = bool(up and up.other) or self.element in _OTHER


def place_of(*names: str) -> Place | None:
    """The place of a path from the root element down."""
    at = None
    for name in names:
        at = Place(at, name)
    return at


@dataclass
class Block:
    place: Place | None
    text: str
    linked: int


class Tags:
    """The tags of a page, in one pass: ``next(at)`` is (start, end, ends, name, rest), comments and the like without a name."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def _end(self, at: int) -> int:
        """Behind the > that ends a tag whose attributes begin here."""
        start = at
        while self.quotes:
            at = _PLAIN.match(self.page, at).end()
            if self.page[at:at + 1] == ">":
                return at + 1
            # An opening quote, or the end of the page.
            at = self.page.find(self.page[at], at + 1) + 1 if at < len(self.page) else 0
            if not at:
                self.quotes = False
        return self.page.index(">", start) + 1

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        found = _START.search(self.page, at)
        if not found:
            return None
        start, behind = found.span()
        if found[1]:
            end = self.page.find("-->", behind)
            return start, end + 3 if end >= 0 else len(self.page), False, "", ""
        if behind > self.last:
            return None
        end = self._end(behind) if found[3] else self.page.index(">", behind) + 1
        return start, end, bool(found[2]), (found[3] or "").lower(), self.page[behind:end - 1]


def _raw_end(page: str, name: str, at: int) -> int:
    """Behind the end tag of an element without markup whose content begins here; without one, the end of the page."""
    found = _RAW[name].search(page, at)
    end = page.find(">", found.end()) if found else -1
    return end + 1 if end >= 0 else len(page)


def template_ends(page: str) -> dict[int, int]:
    """Where the content of each closed template begins -> behind its end tag."""
    out: dict[int, int] = {}
    if not re.search("<template", page, re.I):
        return out
    tags, at, open_ = Tags(page), 0, []
    while token := tags.next(at):
        _, at, ends, name, rest = token
        if name == "template" and rest[:1] in _SPACE:
            if not ends:
                open_.append(at)
            elif open_:
                out[open_.pop()] = at
    return out


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks in page order, with decoded text."""
    out: list[Block] = []
    page = page or ""
    tags, templates = Tags(page), template_ends(page)
    here: Place | None = None
    open_: Counter[str] = Counter()  # open elements by name
    texts: list[str] = []
    links, linked, at, foreign, inked = 0, 0, 0, "", False

    def close():
        nonlocal linked, inked
        text = " ".join(html.unescape("".join(texts)).split())
        if text and not open_["head"]:
            out.append(Block(here, text, min(linked, len(text))))
        texts.clear()
        linked, inked = 0, False

    def add(piece: str):
        nonlocal linked, inked
        texts.append(piece)
        inked = inked or bool(piece.strip())
        if links:
            linked += len(piece)

    def leave(name: str):
        """Close elements up to the nearest one of this name."""
        nonlocal here
        while open_[name]:
            open_[here.element] -= 1
            here, done = here.up, here.element == name
            if done:
                return

    while token := tags.next(at):
        start, end, ends, name, rest = token
        if start > at:
            add(page[at:start])
        at = end
        if not name:
            continue
        empty, named = rest.endswith("/"), rest[:1] in _SPACE
        if name in _RAW and named:
            if not ends and not (foreign and empty):
                at = _raw_end(page, name, at)
            continue
        if name == "template" and named:
            at = at if ends else templates.get(at, at)
            continue
        if name in _FOREIGN and named:
            foreign = "" if ends and name == foreign else foreign if ends or foreign or empty else name
            continue
        if foreign:
            if name not in _BREAKS_OUT and not (ends and open_[name]):
                if name in ("text", "desc", "mtext"):
                    texts.append(" ")
                continue
            foreign = ""
        if name in _INLINE:
            if name == "a":
                links = 0 if ends else 1
            elif name == "br":
                texts.append(" ")
            continue
        last = here.element if here else ""
        if name in _EMBEDDED and (not open_[name] if ends else last == "p" or inked):
            continue
        close()
        links = 0
        if ends:
            leave(name)
        elif name not in _VOID:
            if name == "body" and open_["head"]:
                while open_["head"]:
                    leave("head")
            elif (name in _SELF_CLOSING and last == name) or (last == "p" and name not in _SELF_CLOSING):
                leave(last)
            words = " ".join(m.strip("\"'").lower() for m in _NAMES.findall(rest))
            here = Place(here, f"{name} {words}".strip())
            open_[name] += 1
    if at < len(page):
        add(page[at:])
    close()
    return out


def vectors(page: list[Block]) -> np.ndarray:
    """One row per block: path, words, and plain features."""
    out = np.zeros((len(page), PATH + WORDS + PLAIN), np.float32)
    above = [[p for p in (b.place, b.place and b.place.up, b.place and b.place.up and b.place.up.up) if p][1:] for b in page]
    for places in above:
        for p in places:
            p.text = 0
    total = 1
    for block, places in zip(page, above, strict=True):
        own = len(block.text) - block.linked
        total += own
        for p in places:
            p.text += own
    for i, (block, places) in enumerate(zip(page, above, strict=True)):
        bits = block.place.bits if block.place else 0
        out[i, :PATH] = np.unpackbits(np.frombuffer(bits.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little")
        codes = np.fromiter(map(_code, block.text.split()), np.int64)
        n = len(codes)
        counts = np.bincount(codes % WORDS, np.where(codes >> 8 & 1, 1.0, -1.0), WORDS)
        out[i, PATH:PATH + WORDS] = counts / max(1.0, np.sqrt(counts @ counts))
        held = [p.text / total for p in places] + [0.0, 0.0]
        out[i, -PLAIN:] = (
            np.log1p(n) / 5, block.linked / len(block.text), n < 4, block.text[-1] in ".!?…", i / len(page),
            min(block.place.depth if block.place else 0, 50) / 10, held[0], held[1],
        )
    return out


def _gates(x: np.ndarray, w: np.ndarray, keep: bool):
    """LSTM states over time for x (time, rows, inputs); w holds input, recurrent and bias weights in its rows."""
    time, rows, size = x.shape
    pre = x.reshape(-1, size) @ w[:size] + w[-1]
    pre = pre.reshape(time, rows, -1)
    h, c = np.zeros((rows, HIDDEN), x.dtype), np.zeros((rows, HIDDEN), x.dtype)
    states, trace = np.zeros((time, rows, HIDDEN), x.dtype), []
    inner = w[size:-1]
    for t in range(time):
        z = pre[t] + h @ inner
        gates = 1 / (1 + np.exp(-z[:, :3 * HIDDEN]))
        i, f, o = np.split(gates, 3, axis=1)
        g = np.tanh(z[:, 3 * HIDDEN:])
        before = (h, c)
        c = f * c + i * g
        h = o * np.tanh(c)
        states[t] = h
        if keep:
            trace.append((before, i, f, o, g, c))
    return states, trace


def _backward(x: np.ndarray, w: np.ndarray, trace: list, up: np.ndarray) -> np.ndarray:
    """Gradient of w for upstream gradients ``up`` of the states."""
    size = x.shape[2]
    grad = np.zeros_like(w)
    dh, dc = np.zeros_like(up[0]), np.zeros_like(up[0])
    for t in reversed(range(len(trace))):
        (h, c0), i, f, o, g, c = trace[t]
        d = up[t] + dh
        th = np.tanh(c)
        dc = dc + d * o * (1 - th * th)
        dz = np.hstack([dc * g * i * (1 - i), dc * c0 * f * (1 - f), d * th * o * (1 - o), dc * i * (1 - g * g)])
        grad[:size] += x[t].T @ dz
        grad[size:-1] += h.T @ dz
        grad[-1] += dz.sum(axis=0)
        dh, dc = dz @ w[size:-1].T, dc * f
    return grad


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence backwards in time, padding left behind it."""
    time = np.arange(len(x))[:, None]
    at = np.where(time < lengths, lengths - 1 - time, time)
    return np.take_along_axis(x, at[:, :, None], axis=0)


class Labeller:
    def __init__(self, seed: int = 11):
        random = np.random.default_rng(seed)
        size = PATH + WORDS + PLAIN

        def start(*shape):
            return (random.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

        self.w = [start(size + HIDDEN + 1, 4 * HIDDEN), start(size + HIDDEN + 1, 4 * HIDDEN), start(2 * HIDDEN + 1, 1)]
        for w in self.w[:2]:
            w[-1, HIDDEN:2 * HIDDEN] = 1  # remember by default
        self.random = random

    def _forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool):
        back = _reverse(x, lengths)
        one, trace = _gates(x, self.w[0], keep)
        two, trace_back = _gates(back, self.w[1], keep)
        both = np.concatenate([one, _reverse(two, lengths)], axis=2)
        score = (both @ self.w[2][:-1] + self.w[2][-1])[:, :, 0]
        return 1 / (1 + np.exp(-score)), both, back, trace, trace_back

    @staticmethod
    def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((lengths.max(), len(pages), PATH + WORDS + PLAIN), np.float32)
        for i, p in enumerate(pages):
            x[:len(p), i] = p
        return x, lengths

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int) -> None:
        first, second, turn = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        order = sorted(range(len(pages)), key=lambda i: len(pages[i]))
        groups = [order[i:i + 16] for i in range(0, len(order), 16)]
        for epoch in range(epochs):
            for g in self.random.permutation(len(groups)):
                x, lengths = self._batch([pages[i] for i in groups[g]])
                y = np.zeros(x.shape[:2], np.float32)
                for j, i in enumerate(groups[g]):
                    y[:len(labels[i]), j] = labels[i]
                p, both, back, trace, trace_back = self._forward(x, lengths, True)
                real = np.arange(len(x))[:, None] < lengths
                d = ((p - y) * real / real.sum())[:, :, None].astype(np.float32)
                up = d * self.w[2][:-1, 0]
                grads = [
                    _backward(x, self.w[0], trace, up[:, :, :HIDDEN]),
                    _backward(back, self.w[1], trace_back, _reverse(up[:, :, HIDDEN:], lengths)),
                    np.vstack([np.einsum("tbh,tbo->ho", both, d), d.sum(axis=(0, 1))[None]]),
                ]
                norm = np.sqrt(sum(float((q * q).sum()) for q in grads))
                turn += 1
                rate = 0.01 * (1 - 0.8 * epoch / epochs)
                for k, q in enumerate(grads):
                    q = q * min(1.0, 1.0 / max(norm, 1e-9))
                    first[k] = 0.9 * first[k] + 0.1 * q
                    second[k] = 0.99 * second[k] + 0.01 * q * q
                    self.w[k] -= rate * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-8)

    def main(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages of like length are labelled together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and end - at < 64 and len(pages[order[end]]) * (end - at) < 20_000:
                end += 1
            x, lengths = self._batch([pages[i] for i in order[at:end]])
            p = self._forward(x, lengths, False)[0]
            for j, i in enumerate(order[at:end]):
                out[i] = p[:lengths[j], j] >= 0.5
            at = end
        return out


_MAIN_LAYOUTS = [
    ("article",), ("main",), ("main", "article"), ("div content", "article post"), ("div container", "main main"), ("section story", "article entry"),
    ("div main content", "div article body"), ("div post content",), ("div page", "div entry content"), ("div story body",), ("td content",), ("div",), ("div", "div"), ("div text",), ("section",), ("table", "tr", "td"),
]
_LEAVES = [("ul", "li"), ("ol", "li"), ("h2",), ("h3",), ("blockquote", "p"), ("table", "tr", "td"), ("pre",), ("figure", "figcaption"), ("div", "p"), ("dl", "dd")]
_OTHER_LAYOUTS = {
    "nav": [("nav", "ul", "li"), ("div menu", "ul", "li"), ("header", "nav", "ul", "li"), ("div navbar navigation", "li"), ("div breadcrumb breadcrumbs",), ("ul nav menu", "li")],
    "top": [("header",), ("header site header", "h1"), ("div header", "p"), ("div masthead banner",), ("div topbar top",)],
    "foot": [("footer",), ("footer", "p"), ("div footer", "p"), ("div site footer copyright",), ("div bottom legal", "p")],
    "side": [("aside",), ("aside", "p"), ("div sidebar", "p"), ("aside sidebar widget", "h3"), ("div related", "li"), ("div recommended more", "p"), ("section related", "h2")],
    "ad": [("div ad",), ("div ads advert",), ("div advertisement sponsored", "p"), ("div promo banner", "p"), ("aside ad", "p"), ("div sponsor",)],
    "note": [("div notice",), ("div cookie consent banner", "p"), ("div alert warning", "p"), ("div popup modal overlay", "p"), ("div newsletter subscribe", "p"), ("div cookies gdpr notice",)],
    "form": [("form",), ("form", "p"), ("form search", "div"), ("div login", "form", "label"), ("form", "button"), ("form subscribe newsletter", "fieldset")],
    "comment": [("div comments", "div comment", "p"), ("section comments", "li comment", "p"), ("div discussion replies", "p"), ("ol commentlist", "li comment", "p"), ("div comments area", "h3"), ("div responses", "article comment", "p")],
}
_BEFORE = ["nav", "top", "ad", "note", "form", "side"]
_AFTER = ["side", "comment", "comment", "foot", "ad", "form", "note", "nav", "foot"]


def weak_labels(page: list[Block]) -> np.ndarray:
    """Labels from markup that names the main part, or else from the amount of text outside links."""
    marked = any(b.place and b.place.main for b in page)
    good = [bool(b.place and b.place.main) if marked else len(b.text.split()) >= 8 and b.linked < 0.3 * len(b.text) for b in page]
    return np.array([g and not (b.place and b.place.other) for g, b in zip(good, page, strict=True)], np.float32)


def varied(page: list[Block], labels: np.ndarray, others: list[str], random: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """The page in another layout: main blocks in a renamed container, other blocks and foreign ones around and between."""
    container = _MAIN_LAYOUTS[random.integers(len(_MAIN_LAYOUTS))]
    shell = ("html", "body", *(("div wrapper",) if random.random() < 0.5 else ()))
    base = place_of(*shell)

    def under(at: Place, path: tuple[str, ...]) -> Place:
        for name in path:
            at = Place(at, name)
        return at

    def short(text: str) -> str:
        words = text.split()
        cut = random.integers(0, len(words))
        return " ".join(words[cut:cut + random.integers(1, 7)])

    def extra(kinds: list[str], most: int, at: Place) -> list[Block]:
        made = []
        for _ in range(random.integers(0, most + 1)):
            kind = kinds[random.integers(len(kinds))]
            path = _OTHER_LAYOUTS[kind][random.integers(len(_OTHER_LAYOUTS[kind]))]
            group = under(at, path[:-1])
            for _ in range(random.integers(1, 9 if kind in ("nav", "comment") else 4)):
                text = others[random.integers(len(others))]
                if kind in ("nav", "form", "note") or random.random() < 0.3:
                    text = short(text)
                made.append(Block(Place(group, path[-1]), text, len(text) if kind == "nav" else 0))
        return made

    top = under(base, container)
    main: list[Block] = []
    for b in (b for b, y in zip(page, labels, strict=True) if y):
        if random.random() < 0.25:
            path = _LEAVES[random.integers(len(_LEAVES))]
            main.append(Block(under(top, path), b.text, b.linked))
        else:
            main.append(Block(Place(top, b.place.element if b.place else "p"), b.text, b.linked))
        # Lists, tables, quotes and lines between the paragraphs belong to the text, short as they are.
        if random.random() < 0.3:
            path = _LEAVES[random.integers(len(_LEAVES))] if random.random() < 0.8 else ("p",)
            group = under(top, path[:-1])
            for _ in range(random.integers(1, 6)):
                text = others[random.integers(len(others))]
                main.append(Block(Place(group, path[-1]), short(text) if random.random() < 0.7 else text, 0))
    before, after = extra(_BEFORE, 4, base), extra(_AFTER, 5, base)
    if len(main) > 2 and random.random() < 0.4:
        cut = int(random.integers(1, len(main)))
        between = extra(["ad", "side", "note", "form"], 2, top)
        body = main[:cut] + between + main[cut:]
        marks = [1] * cut + [0] * len(between) + [1] * (len(main) - cut)
    else:
        body, marks = main, [1] * len(main)
    return before + body + after, np.array([0] * len(before) + marks + [0] * len(after), np.float32)


def train(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Labeller:
    """A labeller fitted on at most ``sample_pages`` pages."""
    n = pages.count()
    place = F.pmod(F.xxhash64("page_id", F.lit("pages")), F.lit(1 << 30))
    near = pages.select("page_id", "html", place.alias("place")).where("html IS NOT NULL")
    near = near.where(F.col("place") < float(1 << 30) * min(1.0, (1.3 * sample_pages + 20) / max(1, n)))
    rows = near.orderBy("place", "page_id", "html").limit(sample_pages).select("html").collect()
    random = np.random.default_rng(5)
    real = [(page, weak_labels(page)) for row in rows if (page := blocks(row.html))]
    others = [b.text for page, _ in real for b in page] or ["more"]
    seen = [(p, y) for page, y in real for p, y in ((page, y), *(varied(page, y, others, random) for _ in range(LAYOUTS))) if p]
    labeller = Labeller()
    if seen:
        labeller.fit([vectors(p) for p, _ in seen], [y for _, y in seen], EPOCHS)
    return labeller


def extracted(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """page_id, url, text of every page."""
    shared = prepared(pages.sparkSession).sparkContext.broadcast(labeller)

    def extract(batches):
        for batch in batches:
            found = [blocks(page) for page in batch.column("html").to_pylist()]
            chosen = shared.value.main([vectors(page) for page in found])
            texts = ["\n".join([b.text for b, y in zip(page, own, strict=True) if y]) for page, own in zip(found, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(extract, "page_id long, url string, text string")


def op5_html_text(pages: DataFrame) -> DataFrame:
    """Contract columns for every page."""
    prepared(pages.sparkSession)
    return extracted(pages, train(pages)).withColumn("n_chars", F.length("text").cast("long"))
