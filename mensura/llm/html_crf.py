"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page is a sequence of leaf blocks (``dom_blocks``); each is main text or not. A block's score comes from its ancestors'
tags and names and from its text (length, links, sentence end, likeness to the title); two matrices score
neighbouring labels, one for blocks under the same parent and one for others. The weights maximise the
likelihood of labelled pages (forward-backward, Adam); a page is decoded by Viterbi. Main blocks are joined in page order.

Labelled pages come from two places. Pages of the table whose markup says what is the article
(an article or main element) are labelled by it; their paragraphs then fill pages in many
other layouts, where the label is known because the page was built around it. Both come from a bounded
sample (``SAMPLE`` pages of at most ``SAMPLE_CHARS`` characters, those of the smallest hash), fitted on the driver in a
fixed order, so equal tables give equal models. Without any such page the layouts are filled with a few fixed words.

What counts as main: headings, paragraphs, lists, tables and quotes of the article. Not main: menus, headers and
footers of the page, sidebars, notices, adverts, forms, reader comments. Scripts, styles and the head are no blocks at all.

Defined cases: null, empty and text-free pages give an empty text; ties of Viterbi go to "not main"; repeated rows and
ids are each judged on their own; an empty table gives an empty result. A page is read whole, whatever its length, and in
time linear in it. Of the input only the id, url and html columns are read, so others may have any name.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample
from .dom_blocks import Block, Element, parse

SAMPLE = 300
SAMPLE_CHARS = 1 << 16
BUILT = 1600
SEEN = 3                     # labelled pages that a feature must occur in
ROUNDS = 150
RATE = 0.1
DECAY = 1e-4

# How page authors name what is and what isn't the article.
MAIN = """article content post entry story text body main page-content article-body post-content entry-content story-body markdown prose
copy blog-post single hentry articleBody post-body content-body rich-text document detail reader news-text""".split()
WRAP = "wrapper container page site layout row col grid inner outer center columns box section group app root block".split()
ASIDE = {
    "menu": "nav navbar menu navigation main-menu breadcrumb breadcrumbs topnav site-nav links pagination pager toc skip tabs".split(),
    "head": "header masthead topbar site-header branding logo banner hero-bar page-header tagline".split(),
    "foot": "footer bottom copyright site-footer legal colophon imprint credits foot disclaimer".split(),
    "side": "sidebar aside side rail widget widgets related recommended more-stories popular trending tags archive teaser read-next".split(),
    "note": "cookie cookies consent notice gdpr alert popup modal overlay notification cookie-banner privacy paywall message warning".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adslot ad-box banner-ad partner commercial dfp".split(),
    "form": "form newsletter subscribe signup login search contact-form register poll subscription search-box".split(),
    "talk": "comments comment discussion replies disqus respond reader-comments comment-list thread responses feedback user-comment".split(),
    "share": "share social social-links sharing follow buttons tools toolbar".split(),
}
SEMANTIC = {"menu": "nav", "head": "header", "foot": "footer", "side": "aside", "note": "div", "ad": "aside", "form": "form", "talk": "section", "share": "div"}
SHORT = """Home|About|Contact|News|Next|Previous|Share|Reply|Log in|Sign up|Search|Read more|Menu|Subscribe|Accept|Close|Terms|Privacy
|Help|Archive|Tweet|Print|Back to top|Follow us|Like|Report|Cookies|Imprint|Skip to content""".replace("\n", "").split("|")
FILLER = "the of a river stone under light and were many it made along north with winter house from".split()


@dataclass
class Model:
    """Weights of block features, and of label pairs (other parent or the same; from; to)."""

    weights: dict[str, float]
    edges: list[list[list[float]]]


def text_features(block: Block, title: str, flags: frozenset) -> list[str]:
    """Features of the block's own text and of its place among the page's landmarks."""
    text, element = block.text, block.element
    words = text.split(" ", 41)
    n = len(words)
    out = ["bias", f"b={element.tag}", f"len={min(n, 41).bit_length()}", f"ld={min(4, 4 * block.linked // max(1, len(text) - text.count(' ')))}"]
    if text[-1] in ".!?…\"”":
        out.append(f"end={n > 3}")
    if "©" in text:
        out.append("copyright")
    if n <= 4:
        out += [f"w={w.lower()}" for w in words]
    if title and (text == title or (n > 2 and (title.startswith(text) or text.startswith(title)))):
        out.append("title")
    for mark in flags:
        out.append(f"in:{mark}" if mark in element.marks else f"out:{mark}")
    return out


def element_features(element: Element) -> list[str]:
    """Features of the element that holds a block and of all above it."""
    return [*element.marks, *(f"n:{m}" for m in element.near if m[0] != "t")]


def _landmarks(blocks: Sequence[Block]) -> frozenset:
    """Which of the elements that may hold the article the page has."""
    found: set = set()
    for block in blocks:
        found |= {"t=article", "t=main"} & block.element.marks
    return frozenset(found)


# ---- labelled pages -------------------------------------------------------------------------------------------------

_AWAY = frozenset("t=nav t=aside t=footer t=form t=button t=select c=comment c=ad c=nav c=sidebar c=related c=share".split())


def by_markup(page: str) -> list[int] | None:
    """Labels of the page's blocks where an article or main element tells them; None for other pages."""
    blocks, _ = parse(page)
    if not blocks or not _landmarks(blocks):
        return None
    return [int(bool({"t=article", "t=main"} & b.element.marks) and not _AWAY & b.element.marks) for b in blocks]


class _Page:
    """A page under construction: markup and the labels of its blocks."""

    def __init__(self, rng: random.Random, texts: Sequence[str]):
        self.rng, self.texts, self.out, self.labels = rng, texts, [], []

    def prose(self) -> str:
        return self.rng.choice(self.texts)

    def brief(self) -> str:
        """A few words: of a fixed list, or the start of some prose."""
        if self.rng.random() < 0.5:
            return self.rng.choice(SHORT)
        return " ".join(self.prose().split()[:self.rng.randint(1, 5)]) or "Home"

    def block(self, tag: str, text: str, label: int, link: bool = False) -> None:
        shown = text.replace("&", "&amp;").replace("<", "&lt;")
        if link:
            shown = f'<a href="/{len(self.out)}">{shown}</a>'
        elif label and tag == "p" and self.rng.random() < 0.1:
            shown = f"<b>{shown}<br>"                            # left open
        elif self.rng.random() < 0.1:
            shown = f"<span>{shown}</span>"
        end = "" if tag in ("p", "li", "td") and self.rng.random() < 0.1 else f"</{tag}>"
        self.out.append(f"<{tag}>{shown}{end}")
        self.labels.append(label)

    def open(self, tag: str, names: Sequence[str] = (), always: bool = False) -> None:
        attrs = ""
        if names and (always or self.rng.random() < 0.8):
            chosen = self.rng.sample(list(names), min(len(names), self.rng.choice([1, 1, 2])))
            attrs = f' {self.rng.choice(["class", "class", "id"])}="{" ".join(chosen)}"'
        self.out.append(f"<{tag}{attrs}>")

    def close(self, tag: str) -> None:
        self.out.append(f"</{tag}>")

    def aside(self, kind: str, semantic: bool) -> None:
        """A part that is not the article."""
        rng = self.rng
        tag = SEMANTIC[kind] if semantic and rng.random() < 0.8 else "form" if kind == "form" else rng.choice(["div", "div", "section", "ul" if kind == "menu" else "div"])
        self.open(tag, ASIDE[kind], always=tag in ("div", "section", "ul", "aside"))
        if tag != "ul" and rng.random() < 0.35:                  # its text stands directly in it
            self.out.append((self.prose() if kind not in ("menu", "share") else self.brief()).replace("&", "&amp;").replace("<", "&lt;"))
            self.labels.append(0)
            self.close(tag)
            return
        if kind in ("menu", "share") or (kind in ("foot", "side") and rng.random() < 0.5):
            inner = tag if tag == "ul" else "ul"
            if tag != "ul":
                self.open("ul")
            many = rng.randint(1, 9)
            if rng.random() < 0.2:                               # links in one block
                gap = rng.choice([" ", " | ", "<br>"])
                self.out.append("<li>" + gap.join(f"<a href='/{i}'>{rng.choice(SHORT)}</a>" for i in range(many)) + "</li>")
                self.labels.append(0)
                many = 0
            for _ in range(many):
                self.block("li", self.brief(), 0, link=rng.random() < 0.9)
            if tag != "ul":
                self.close(inner)
        if kind in ("head", "foot", "side", "note", "ad"):
            if rng.random() < 0.3:
                self.block(rng.choice(["h1", "h1", "h2", "div"] if kind == "head" else ["h2", "h3", "div"]), self.brief(), 0)
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(["p", "div", "p"]), ("© " if kind == "foot" and rng.random() < 0.6 else "") + self.prose(), 0, link=rng.random() < 0.2)
        if kind == "form":
            self.block("label", self.brief(), 0)
            if rng.random() < 0.5:
                self.block("p", self.prose(), 0)
            self.block("button", self.brief(), 0)
        if kind == "note" and rng.random() < 0.6:
            self.block("button", self.brief(), 0)
        if kind == "talk":
            if rng.random() < 0.6:
                self.block(rng.choice(["h2", "h3"]), self.brief(), 0)
            for _ in range(rng.randint(1, 6)):
                one = rng.choice(["div", "li", "article"])
                self.open(one, ["comment", "reply", "comment-body", "user-comment", "message"], always=one == "article")
                if rng.random() < 0.6:
                    self.block(rng.choice(["div", "h4"]), self.brief(), 0)
                for _ in range(rng.randint(1, 2)):
                    self.block("p", self.prose(), 0)
                self.close(one)
        self.close(tag)

    def story(self, semantic: bool) -> None:
        """The article, in one of the ways that pages hold it."""
        rng = self.rng
        tag = rng.choice(["article", "article", "main", "section"]) if semantic else rng.choice(["div", "div", "div", "td", "section"])
        if tag == "td":
            self.out.append("<table><tr>")
            if rng.random() < 0.5:
                self.open("td", ASIDE[kind := rng.choice(["menu", "side", "ad"])], always=True)
                for _ in range(rng.randint(1, 4)):
                    self.block("p", self.brief() if kind == "menu" else self.prose(), 0, link=kind == "menu" or rng.random() < 0.3)
                self.close("td")
        self.open(tag, MAIN, always=tag not in ("article", "main") and rng.random() < 0.9)
        inner = rng.random() < 0.4
        head = rng.random() < 0.3
        if head:
            self.open("header", ["entry-header", "article-header", "post-header"])
        if rng.random() < 0.9:
            self.block("h1", self.heading, 1)
        if head:
            self.close("header")
        if inner:
            self.open("div", MAIN)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9, 14])):
            kind = rng.random()
            if kind < 0.65:
                self.block("p", self.prose() if rng.random() < 0.9 else self.brief(), 1)
            elif kind < 0.7:
                self.block(rng.choice(["h2", "h3"]), self.brief(), 1)
            elif kind < 0.75:
                self.open("ul")
                for _ in range(rng.randint(2, 5)):
                    self.block("li", self.prose() if rng.random() < 0.5 else self.brief(), 1, link=rng.random() < 0.1)
                self.close("ul")
            elif kind < 0.78:
                self.open("blockquote")
                self.block("p", self.prose(), 1)
                self.close("blockquote")
            elif kind < 0.8:
                self.out.append("<table><tr>")
                for _ in range(rng.randint(2, 6)):
                    self.block("td", self.brief(), 1)
                self.out.append("</tr></table>")
            else:
                self.aside(rng.choice(["ad", "ad", "side", "form", "share", "note", "talk"]), semantic)
        if rng.random() < 0.3:
            self.aside(rng.choice(["share", "talk", "side", "form"]), semantic)
        if inner:
            self.close("div")
        if rng.random() < 0.25:
            self.aside(rng.choice(["talk", "share", "foot"]), semantic)
        self.close(tag)
        if tag == "td":
            self.out.append("</tr></table>")

    def build(self) -> tuple[str, list[int]]:
        rng = self.rng
        semantic = rng.random() < 0.6
        self.heading = " ".join(self.prose().split()[:rng.randint(3, 12)]) or "Heading"
        title = self.heading[:60] if rng.random() < 0.8 else self.brief()
        self.out.append(f"<!DOCTYPE html><html><head><title>{title.replace('&', '&amp;').replace('<', '&lt;')}</title></head><body>")
        outer = rng.random() < 0.6
        if outer:
            self.open("div", WRAP)
        for kind in rng.sample(["menu", "head", "note", "ad", "form", "menu"], rng.randint(0, 4)):
            self.aside(kind, semantic)
        middle = rng.random() < 0.4
        if middle:
            self.open("main" if semantic and rng.random() < 0.5 else "div", [*WRAP, "main", "content"])
        if rng.random() < 0.2:
            self.aside("side", semantic)
        self.story(semantic)
        for kind in rng.sample(["talk", "side", "ad", "share", "form", "talk"], rng.randint(0, 3)):
            self.aside(kind, semantic)
        if middle:
            self.out.append("</main>" if any(x.startswith("<main") for x in self.out) else "</div>")
        for kind in rng.sample(["foot", "foot", "menu", "note", "side"], rng.randint(0, 3)):
            self.aside(kind, semantic)
        if outer:
            self.close("div")
        if rng.random() < 0.9:
            self.out.append("</body></html>")
        return "".join(self.out), self.labels


def built_pages(texts: Sequence[str], pages: int = BUILT, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Pages in many layouts around given paragraphs, with the labels of their blocks."""
    rng = random.Random(seed)
    texts = [t for t in texts if t.strip()] or [" ".join(rng.choices(FILLER, k=rng.randint(4, 60))) + "." for _ in range(200)]
    made = [_Page(rng, texts).build() for _ in range(pages)]
    return [(page, labels) for page, labels in made if len(parse(page)[0]) == len(labels)]


# ---- fitting and decoding -------------------------------------------------------------------------------------------

def fit(pages: Iterable[tuple[str, Sequence[int]]], rounds: int = ROUNDS) -> Model:
    """Weights of greatest penalised likelihood of the labelled pages, by Adam on the exact gradient."""
    rows, labels, kinds, lengths = [], [], [], []
    number: Counter = Counter()
    for page, given in pages:
        blocks, title = parse(page)
        if not blocks:
            continue
        flags = _landmarks(blocks)
        found = [text_features(b, title, flags) + element_features(b.element) for b in blocks]
        number.update(set().union(*found))
        rows += found
        labels += given
        kinds += [0, *(int(a.element.up == b.element.up) for a, b in zip(blocks, blocks[1:]))]
        lengths.append(len(blocks))
    place = {f: i for i, f in enumerate(sorted(f for f, n in number.items() if n >= SEEN))}
    if not lengths:
        return Model({}, [[[0.0, 0.0], [0.0, 0.0]]] * 2)
    flat = [[place[f] for f in row if f in place] for row in rows]
    owner = np.repeat(np.arange(len(flat)), [len(r) for r in flat])
    feature = np.array([f for r in flat for f in r])
    y, kind, length = np.array(labels), np.array(kinds), np.array(lengths)
    n, most = len(length), int(length.max())
    first = np.cumsum(length) - length
    at = np.repeat(np.arange(n), length), np.arange(len(y)) - np.repeat(first, length)
    inside = np.zeros((n, most), bool)
    inside[at] = True
    same = np.zeros((n, most), np.int64)
    same[at] = kind
    gold = np.zeros((n, most), np.int64)
    gold[at] = y
    weights = np.zeros(len(place) + 8)
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    true_edges = np.zeros((2, 2, 2))
    pair = inside[:, 1:]
    np.add.at(true_edges, (same[:, 1:][pair], gold[:, :-1][pair], gold[:, 1:][pair]), 1)
    for step in range(1, rounds + 1):
        w, edges = weights[:-8], weights[-8:].reshape(2, 2, 2)
        node = np.zeros((n, most, 2))
        node[at + (1,)] = np.bincount(owner, w[feature], len(y))
        top = node.max(axis=2)
        here, moves = np.exp(node - top[..., None]), np.exp(edges)[same]
        ahead, behind, scale = np.zeros((n, most, 2)), np.ones((n, most, 2)), np.ones((n, most))
        for t in range(most):                       # sums of weights of all labellings so far, scaled to 1
            into = np.einsum("ni,nij->nj", ahead[:, t - 1], moves[:, t]) * here[:, t] if t else here[:, 0].copy()
            scale[:, t] = into.sum(axis=1)
            into /= scale[:, t, None]
            ahead[:, t] = np.where(inside[:, t, None], into, ahead[:, t - 1]) if t else into
        for t in range(most - 2, -1, -1):
            back = np.einsum("nij,nj->ni", moves[:, t + 1], here[:, t + 1] * behind[:, t + 1]) / scale[:, t + 1, None]
            behind[:, t] = np.where(inside[:, t + 1, None], back, 1.0)
        sure = ahead[..., 1] * behind[..., 1]
        grad = np.zeros_like(weights)
        grad[:-8] = np.bincount(feature, (y - sure[at])[owner], len(place))
        both = ahead[:, :-1, :, None] * moves[:, 1:] * (here[:, 1:] * behind[:, 1:] / scale[:, 1:, None])[:, :, None, :]
        expected = np.zeros((2, 2, 2))
        np.add.at(expected, same[:, 1:][pair], both[pair])
        grad[-8:] = (true_edges - expected).ravel()
        grad = grad / n - DECAY * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        weights = weights + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model({f: float(weights[i]) for f, i in place.items()}, weights[-8:].reshape(2, 2, 2).tolist())


def viterbi(scores: Sequence[float], kinds: Sequence[int], edges: Sequence) -> list[int]:
    """The best labels for blocks that score ``scores`` as main (0 otherwise); ties go to 0."""
    if not scores:
        return []
    off, on, back = 0.0, scores[0], []
    for score, kind in zip(scores[1:], kinds[1:]):
        (a, b), (c, d) = edges[kind]
        to_off, to_on = (off + a, on + c), (off + b, on + d)
        back.append((int(to_off[1] > to_off[0]), int(to_on[1] > to_on[0])))
        off, on = max(to_off), max(to_on) + score
    label = int(on > off)
    out = [label]
    for step in reversed(back):
        label = step[label]
        out.append(label)
    return out[::-1]


def decide(page: str | None, model: Model) -> list[tuple[Block, int]]:
    """The page's blocks with their labels."""
    blocks, title = parse(page)
    flags, weights, known = _landmarks(blocks), model.weights, {}
    scores = []
    for block in blocks:
        element = block.element
        if element.key not in known:
            known[element.key] = sum(weights.get(f, 0.0) for f in element_features(element))
        scores.append(known[element.key] + sum(weights.get(f, 0.0) for f in text_features(block, title, flags)))
    kinds = [0, *(int(a.element.up == b.element.up) for a, b in zip(blocks, blocks[1:]))]
    return list(zip(blocks, viterbi(scores, kinds, model.edges)))


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> Model:
    """A model fitted on the sample of ``pages`` whose markup tells the article, and on pages built from their paragraphs."""
    chosen = pages.select(F.struct(F.col(id_col), F.col(html_col).alias("html")).alias("row")).where(F.length("row.html").between(1, SAMPLE_CHARS))
    rows = sorted(r.row.html for r in hashed_sample(chosen, F.col("row"), sample, pages.count()).collect())
    told = [(page, labels) for page in rows if (labels := by_markup(page)) is not None]
    texts = [b.text for page, labels in told for b, label in zip(parse(page)[0], labels) if label and len(b.text) > 20]
    return fit([*told, *built_pages(texts)])


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars, n_blocks (leaf blocks of the page) and n_main (those that are main text)."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    names = [id_col, url_col, "text", "n_chars", "n_blocks", "n_main"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, blocks, main = [], [], []
            for page in batch.column(2):
                found = decide(page.as_py(), sent.value)
                kept = [b.text for b, label in found if label]
                texts.append("\n\n".join(kept))
                blocks.append(len(found))
                main.append(len(kept))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array(blocks, pa.int64()), pa.array(main, pa.int64())], names=names)

    kind = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}
    return pages.select(id_col, url_col, html_col).mapInArrow(
        run, f"`{id_col}` {kind[id_col]}, `{url_col}` {kind[url_col]}, text string, n_chars long, n_blocks long, n_main long")
