"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element of a page is a binary variable: main content or not. A
log-linear potential of its features (tag, class and id words, link density,
text, paragraphs) stands on every node, and a two-by-two potential on every
edge from parent to child, one table for children of the page's root and one
for all others. Sum-product messages, upward from the leaves and downward from
the root, give each node's exact content marginal; text of nodes over one half
is kept. The weights maximise the likelihood of labelled pages, whose gradient
needs the same marginals.

Labelled pages are pages in which ``data-main="1"`` marks the roots of main
content and ``data-main="0"`` what is not, until a deeper mark. ``labelled_pages``
composes such pages from the usual parts in the usual wrappings; others can be
given. Training sees ``TRAINING_PAGES`` of them, so the model is small and goes
to the executors with the function. Extraction is one pass without a shuffle.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package

TRAINING_PAGES = 500
EPOCHS = 12

# Element groups of HTML.
RAW_TEXT = ("script", "style", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "noscript")
MUTED = ("head", "template", "svg", "math", "select", "button", "object", "canvas", "audio", "video", "datalist")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEAD_PARTS = ("meta", "link", "base", "title", "style", "script", "noscript", "template")
INLINE = (
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "nobr", "picture", "q", "ruby", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
)
#: An open element that a new one of the given kinds closes, where it is the innermost.
CLOSED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",),
    "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody"),
}

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|data-main)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true""", re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Page:
    """Block elements in page order, parents first, and the runs of text between their boundaries."""

    tags: list[str] = field(default_factory=list)
    attributes: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def parse(source: str) -> Page:
    """A forgiving parse: unclosed and stray tags never fail; comments, scripts and other raw text leave no text."""
    page = Page()
    stack: list[int] = []
    open_count: dict[str, int] = {}
    run: list[str] = []
    state = {"muted": 0, "links": 0}

    def push(tag: str, attributes: str) -> None:
        page.tags.append(tag)
        page.attributes.append(attributes)
        page.parents.append(stack[-1] if stack else -1)
        page.own.append(0)
        page.linked.append(0)
        stack.append(len(page.tags) - 1)
        open_count[tag] = open_count.get(tag, 0) + 1
        state["muted"] += tag in MUTED

    def pop() -> str:
        tag = page.tags[stack.pop()]
        open_count[tag] -= 1
        state["muted"] -= tag in MUTED
        return tag

    def text(piece: str) -> None:
        if state["muted"] or not piece:
            return
        run.append(piece)
        size = len(piece) - piece.count(" ")
        page.own[stack[-1]] += size
        if state["links"]:
            page.linked[stack[-1]] += size

    def end_block() -> None:
        if run:
            joined = " ".join(html.unescape("".join(run)).split())
            if joined:
                page.blocks.append((stack[-1], joined))
            run.clear()

    push("html", "")
    at = 0
    while True:
        found = _TAG.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        closing, name, attributes = found[1], found[2], found[3]
        if name is None:
            closing, name, attributes = found[4], found[5], found[6]
        if name is None:
            continue
        tag = name.lower()
        if closing:
            if tag in INLINE:
                state["links"] = 0 if tag == "a" else state["links"]
            elif open_count.get(tag) and tag not in ("html", "body"):
                end_block()
                while pop() != tag:
                    pass
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in RAW_TEXT:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            if tag in ("script", "style"):
                continue
            end_block()
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            continue
        if tag in INLINE:
            state["links"] = 1 if tag == "a" else state["links"]
            continue
        end_block()
        if tag in ("html", "body"):
            while page.tags[stack[-1]] != "html" and tag == "body":
                pop()
            if tag == "body" and "body" not in open_count:
                push(tag, attributes)
            continue
        if open_count.get("head") and tag not in HEAD_PARTS and tag != "head":
            while pop() != "head":
                pass
        if page.tags[stack[-1]] == "p":
            pop()
        while len(stack) > 1 and page.tags[stack[-1]] in CLOSED_BY.get(tag, ()):
            pop()
        push(tag, attributes)
        state["links"] = 0
    end_block()
    return page


def _size(n: float, cuts: tuple[float, ...]) -> int:
    return sum(n >= c for c in cuts)


def features(page: Page) -> list[list[str]]:
    """Names of the features that hold, for each node."""
    n = len(page.tags)
    whole, linked, paragraphs, marks = list(page.own), list(page.linked), [0] * n, [0] * n
    for node, block in page.blocks:
        marks[node] += block.count(".") + block.count(",") + block.count(";")
    for i in range(n - 1, 0, -1):
        parent = page.parents[i]
        whole[parent] += whole[i]
        linked[parent] += linked[i]
        marks[parent] += marks[i]
        paragraphs[parent] += page.tags[i] == "p"
    out = []
    for i, tag in enumerate(page.tags):
        names = ["any", f"tag={tag}", f"text={_size(whole[i], (1, 25, 100, 400, 1600))}", f"own={_size(page.own[i], (1, 25, 100, 400))}"]
        names.append(f"links={_size(linked[i] / whole[i], (0.05, 0.3, 0.6))}" if whole[i] else "links=none")
        names.append(f"paragraphs={_size(paragraphs[i], (1, 2, 5))}")
        names.append(f"marks={_size(100 * marks[i] / whole[i], (0.3, 1, 2))}" if whole[i] else "marks=none")
        attributes = page.attributes[i]
        if attributes:
            if _HIDDEN.search(attributes):
                names.append("hidden")
            for kind, *values in _ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if kind.lower() == "style":
                    if "none" in value and "display" in value:
                        names.append("hidden")
                elif kind.lower() != "data-main":
                    names += [f"word={w.lower()}" for w in _NAME_WORD.findall(value)]
        out.append(list(dict.fromkeys(names)))
    return out


class Model:
    """Weights of node features and edge tables ``edges[under root][parent label][child label]``."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.edges = [[[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]

    def potentials(self, names: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum(get(f, 0.0) for f in row) for row in names]

    def marginals(self, page: Page, scores: list[float]) -> tuple[list[float], list[list[list[float]]]]:
        """Content marginal of every node, and of every node the joint table with its parent."""
        n = len(scores)
        zero, one = [0.0] * n, list(scores)
        up: list[tuple[float, float]] = [(0.0, 0.0)] * n
        tables = [self.edges[page.tags[p] in ("html", "body") if p >= 0 else 0] for p in page.parents]
        for i in range(n - 1, 0, -1):
            table = tables[i]
            up[i] = (_log_sum(table[0][0] + zero[i], table[0][1] + one[i]), _log_sum(table[1][0] + zero[i], table[1][1] + one[i]))
            parent = page.parents[i]
            zero[parent] += up[i][0]
            one[parent] += up[i][1]
        marginal, joint = [0.0] * n, [[[0.0, 0.0], [0.0, 0.0]] for _ in range(n)]
        marginal[0] = _logistic(one[0] - zero[0])
        for i in range(1, n):
            table, parent = tables[i], page.parents[i]
            above = (zero[parent] - up[i][0], one[parent] - up[i][1])
            cells = [[above[a] + table[a][b] + (one[i] if b else zero[i]) for b in (0, 1)] for a in (0, 1)]
            whole = _log_sum(_log_sum(*cells[0]), _log_sum(*cells[1]))
            joint[i] = [[math.exp(c - whole) for c in row] for row in cells]
            down = (_log_sum(above[0] + table[0][0], above[1] + table[1][0]), _log_sum(above[0] + table[0][1], above[1] + table[1][1]))
            zero[i] += down[0]
            one[i] += down[1]
            marginal[i] = _logistic(one[i] - zero[i])
        return marginal, joint

    def extract(self, source: str | None) -> str:
        if not source:
            return ""
        page = parse(source)
        marginal, _ = self.marginals(page, self.potentials(features(page)))
        return "\n".join(block for node, block in page.blocks if marginal[node] > 0.5)


def _log_sum(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x > 0 else math.exp(max(x, -700.0)) / (1 + math.exp(max(x, -700.0)))


def labels_of(page: Page) -> list[int]:
    """Labels of a labelled page: the nearest mark at or above a node; nothing is content without a mark."""
    out = []
    for i, attributes in enumerate(page.attributes):
        mark = re.search(r'data-main="([01])"', attributes)
        out.append(int(mark[1]) if mark else out[page.parents[i]] if i else 0)
    return out


def train(pages: Iterable[str], epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Weights by adaptive gradient ascent on the pages' log-likelihood."""
    model = Model()
    data = []
    for source in pages:
        page = parse(source)
        data.append((page, features(page), labels_of(page)))
    squares: dict[object, float] = {}
    order = random.Random(3)

    def move(key: object, old: float, gradient: float) -> float:
        gradient -= decay * old
        squares[key] = squares.get(key, 1e-6) + gradient * gradient
        return old + rate * gradient / math.sqrt(squares[key])

    for _ in range(epochs):
        order.shuffle(data)
        for page, names, labels in data:
            marginal, joint = model.marginals(page, model.potentials(names))
            change: dict[str, float] = {}
            for row, p, y in zip(names, marginal, labels, strict=True):
                for f in row:
                    change[f] = change.get(f, 0.0) + y - p
            for f, g in change.items():
                model.weights[f] = move(f, model.weights.get(f, 0.0), g)
            edge = [[[0.0, 0.0], [0.0, 0.0]], [[0.0, 0.0], [0.0, 0.0]]]
            for i in range(1, len(labels)):
                table = edge[page.tags[page.parents[i]] in ("html", "body")]
                table[labels[page.parents[i]]][labels[i]] += 1
                for a in (0, 1):
                    for b in (0, 1):
                        table[a][b] -= joint[i][a][b]
            for k in (0, 1):
                for a in (0, 1):
                    for b in (0, 1):
                        model.edges[k][a][b] = move((k, a, b), model.edges[k][a][b], edge[k][a][b])
    return model


def labelled_pages(count: int = TRAINING_PAGES, seed: int = 1) -> list[str]:
    """Pages composed of the usual parts, with their marks; the same for the same seed."""
    draw = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgkq"

    def word() -> str:
        return "".join(draw.choice(letters) for _ in range(draw.randint(1, 9)))

    def sentence() -> str:
        return " ".join(word() for _ in range(draw.randint(1, 22))).capitalize() + draw.choice([".", ".", ".", "", "!", ", " + word() + "."])

    def sentences(least: int, most: int) -> str:
        return " ".join(sentence() for _ in range(draw.randint(least, most)))

    def links(least: int, most: int) -> list[str]:
        return [f'<a href="/{word()}">{" ".join(word() for _ in range(draw.randint(1, 3)))}</a>' for _ in range(draw.randint(least, most))]

    def paragraph() -> str:
        inner = sentences(1, draw.choice([1, 3, 8, 20]))
        kind = draw.random()
        if kind < 0.15:
            inner = f"<b>{inner}</b>" if kind < 0.08 else f"<b>{inner}<br>"
        elif kind < 0.3:
            inner += f' {links(1, 1)[0]} {sentence()}'
        return f"<p>{inner}" + draw.choice(["</p>", "</p>", "</p>", ""])

    def body_part() -> str:
        kind = draw.random()
        if kind < 0.75:
            return paragraph()
        if kind < 0.8:
            return f"<h2>{sentence()}</h2>{paragraph()}"
        if kind < 0.85:
            return "<ul>" + "".join(f"<li>{sentences(1, 2)}</li>" for _ in range(draw.randint(2, 6))) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{draw.choice(['', '<p>'])}{sentences(1, 3)}</blockquote>"
        if kind < 0.93:
            return f"<table><tr><th>{word()}</th><th>{word()}</th></tr><tr><td>{sentence()}</td><td>{word()}</td></tr></table>"
        if kind < 0.96:
            return f'<figure><img src="x.png"><figcaption>{sentence()}</figcaption></figure>'
        return f"<pre>{sentence()}</pre>"

    def wrapped(options: list[str], inner: str, mark: str = "") -> str:
        """``inner`` in one of the openings, each written as tag and attributes."""
        opening = draw.choice(options)
        return f"<{opening}{mark}>{inner}</{opening.split()[0]}>"

    def listed(items: list[str]) -> str:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if draw.random() < 0.7 else " | ".join(items)

    def comment() -> str:
        return wrapped(['div class="comment"', "li", 'div class="comment-body"', 'article class="comment"'], f"<p>{sentences(1, 4)}</p>")

    def menu() -> str:
        return wrapped(["nav", "nav", 'div class="menu"', 'div id="navigation"', 'ul class="nav"', 'div class="navbar"', 'nav class="breadcrumb"'], listed(links(3, 9)))

    def advert() -> str:
        names = ["ad", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"]
        return wrapped([f'div class="{draw.choice(names)}"', f'aside class="{draw.choice(names)}"', f'div id="{draw.choice(names)}"', f'section class="{draw.choice(names)}"'],
                       draw.choice([sentences(1, 4), f"<p>{sentences(1, 4)}</p>", links(1, 2)[0]]))

    def notice() -> str:
        names = ["cookie-notice", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "modal", "paywall", "subscribe", "newsletter", "cookies"]
        return wrapped([f'div class="{draw.choice(names)}"', f'div id="{draw.choice(names)}"', 'div role="dialog"', 'div role="alert"', "dialog"],
                       draw.choice([sentences(1, 3), f"<p>{sentences(1, 3)}</p><button>{word()}</button>"]))

    def form() -> str:
        return wrapped(["form", 'form class="search"', 'form id="signup"'], draw.choice([f"<label>{sentence()}</label><input>", f"<p>{sentence()}</p><input><button>{word()}</button>"]))

    def sidebar() -> str:
        inner = f"<h3>{sentence()}</h3>" + draw.choice([listed(links(2, 6)), f"<p>{sentences(1, 6)}</p>"])
        return wrapped(["aside", "aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="related"', 'div class="related"', 'div class="widget"', 'section class="recommended"'], inner)

    def comments() -> str:
        inner = draw.choice(["", f"<h3>{sentence()}</h3>"]) + "".join(comment() for _ in range(draw.randint(1, 6))) + draw.choice(["", form()])
        return wrapped(['section class="comments"', 'div id="comments"', 'ol class="comment-list"', 'div class="comments"', 'section id="responses"', 'div class="discussion"', 'ul class="replies"'], inner)

    def share() -> str:
        return wrapped(['div class="share"', 'div class="social"', 'ul class="share-links"', 'div class="tags"'], " ".join(links(2, 5)))

    def header() -> str:
        return wrapped(["header", "header", 'div class="header"', 'div id="masthead"', 'header class="site-header"'], draw.choice([f"<h1>{sentence()}</h1>", f"<p>{sentence()}</p>", links(1, 1)[0]]) + draw.choice(["", menu()]))

    def footer() -> str:
        return wrapped(["footer", "footer", 'div class="footer"', 'div id="footer"', 'footer class="site-footer"'], draw.choice([f"&copy; {sentence()}", f"<p>&copy; {sentences(1, 3)}</p>", listed(links(2, 6))]))

    def article() -> str:
        parts = [body_part() for _ in range(draw.choice([1, 1, 2, 4, 8, 14]))]
        title = draw.choice([f"<h1>{sentence()}</h1>", f"<h1>{sentence()}</h1>", "", f"<header><h1>{sentence()}</h1></header>"])
        inner = [title, *parts]
        for extra in (advert, share, sidebar, notice, form, menu):
            if draw.random() < 0.1:
                inner.insert(draw.randint(1, len(inner)), extra().replace(">", ' data-main="0">', 1))
        if draw.random() < 0.12:
            inner.append(comments().replace(">", ' data-main="0">', 1))
        if draw.random() < 0.1:
            inner.append(footer().replace(">", ' data-main="0">', 1))
        options = ["article", "article", "article", "main", 'div class="article"', 'div id="content"', 'div class="post-content"', 'div class="entry"', 'section class="story"', 'div class="main"', 'div id="main"', "div", 'article class="post"', 'div class="body text"']
        made = wrapped(options, "".join(inner), ' data-main="1"')
        if draw.random() < 0.2:
            made = wrapped(["main", 'div class="container"', 'div id="page"', 'div class="wrapper"', "div"], made + draw.choice(["", sidebar(), comments()]))
        return made

    pages = []
    for _ in range(count):
        before = [part() for part, chance in ((header, 0.5), (menu, 0.7), (notice, 0.3), (advert, 0.5), (form, 0.1), (sidebar, 0.15)) if draw.random() < chance]
        after = [part() for part, chance in ((share, 0.15), (comments, 0.3), (sidebar, 0.3), (advert, 0.2), (form, 0.15), (notice, 0.1), (footer, 0.8)) if draw.random() < chance]
        draw.shuffle(before)
        if draw.random() < 0.08:
            main = "".join(f'<p data-main="1">{sentences(1, 9)}</p>' for _ in range(draw.randint(1, 9)))
        else:
            main = article()
        pages.append(f"<!DOCTYPE html><html><head><title>{sentence()}</title></head><body>{''.join(before)}{main}{''.join(after)}" + draw.choice(["</body></html>", ""]))
    return pages


def extract(pages: DataFrame, model: Model, keep: tuple[str, ...] = ("page_id", "url"), source: str = "html") -> DataFrame:
    """Rows (``keep``…, text, n_chars): the main text of each page, blocks joined by a line break; empty for a null page."""
    ship_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [model.extract(s) for s in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keep, "text", "n_chars"],
            )

    kinds = dict(pages.dtypes)
    columns = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{source}`").cast("string").alias("_html"))
    return columns.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string, n_chars long")
