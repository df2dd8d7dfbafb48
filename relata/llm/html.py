"""Main text of web pages from flat text blocks.

A page is read once into flat blocks: runs of text between block-level tags, whatever their nesting. Blocks
inside a menu, header, footer, advert, form, comment section or the like go by that place. Each of the others
has its word count, its link density and its relation to the page's article element, and those of its
neighbours; a decision tree says whether it is main text. The tree is grown here, from the labelled table below.

Tags are read as HTML's tokenizer reads them, in one pass that never goes back: what isn't closed (a comment, a
quoted value, a tag, a script) reaches to the end of the page.

Defined results: null and empty pages, and pages without main text, give the empty string; ``<`` before
anything but a letter, ``/``, ``!`` or ``?`` is text; repeated rows give equal results; an empty table gives an
empty result; extra columns stay, but for text and n_chars, which are replaced.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from relata.llm.arrow import add_columns, strings

#: Elements of HTML by what they do to text.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split())
RAW = "script style template noscript iframe textarea title svg object".split()
#: Raw only if closed: otherwise HTML goes on inside them.
RAW_IF_CLOSED = {"svg", "object"}
CHROME = set("nav footer aside form button select dialog menu search".split())
CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
MAIN_ROLES = {"main", "article"}
#: Words that, first or last in a class or id name, mark what isn't the article.
CHROME_NAMES = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split())
#: First words of names that tell about a wrapper, not its content; and of names of the article's own parts.
WRAPPERS = set("has with no is not page layout".split())
ARTICLE_NAMES = set("article body content entry main post story text".split())
#: Of CHROME_NAMES, those that hold for an article element too.
CHROME_ARTICLES = set("ad ads advert comment comments promo promoted related reply replies sponsored".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: Attributes up to the end of the tag or of the page; a quote opens a value only after "=".
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z))?+)*+)>?+""")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]*+)))?+""")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

#: place of a block: left out; on a page without an article of weight; in the article; outside of it
CHROME_PLACE, OPEN_PLACE, ARTICLE_PLACE, OUTSIDE_PLACE = -2, 0, 1, -1

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "heading", "place")
MAX_DEPTH, MIN_LEAF = 8, 2
#: FEATURES (but place) of hand-labelled blocks on pages without an article, and 1 for main text. Neighbours are the
#: nearest blocks not left out (0 0 at an end). The same blocks in an article are main text, and outside of one aren't.
LABELLED = """
1 1.00 0 0.00 1 1.00 0 0
1 1.00 1 1.00 1 1.00 0 0
2 1.00 1 1.00 120 0.00 0 0
3 1.00 2 1.00 4 1.00 0 0
5 0.80 4 1.00 60 0.00 0 0
4 1.00 80 0.00 3 1.00 0 0
3 1.00 110 0.00 90 0.00 0 0
4 1.00 90 0.00 0 0.00 0 0
12 0.75 10 0.90 14 0.80 0 0
14 0.90 100 0.00 75 0.00 0 0
30 0.60 5 1.00 4 1.00 0 0
45 0.95 0 0.00 100 0.00 0 0
80 0.90 4 1.00 60 0.00 0 0
60 0.70 5 1.00 90 0.05 0 0
120 0.80 100 0.00 0 0.00 0 0
200 0.95 20 1.00 150 0.00 0 0
6 0.50 90 0.00 3 1.00 0 0
8 0.50 3 1.00 80 0.00 0 0
10 0.45 5 1.00 5 1.00 0 0
4 0.00 2 1.00 1 1.00 0 0
7 0.30 4 1.00 6 0.90 0 0
12 0.00 3 1.00 4 1.00 0 0
6 0.00 5 0.50 7 0.40 0 0
10 0.10 8 0.80 3 1.00 0 0
5 0.00 0 0.00 2 1.00 0 0
3 0.00 0 0.00 3 1.00 0 0
2 0.00 0 0.00 3 0.00 0 0
3 0.00 2 0.00 4 0.00 0 0
4 0.00 3 0.00 3 0.00 0 0
2 0.00 4 0.00 0 0.00 0 0
7 0.00 3 0.00 0 0.00 0 0
5 0.00 2 1.00 0 0.00 0 0
8 0.00 4 0.00 3 0.00 0 0
9 0.00 2 1.00 0 0.00 0 0
4 0.00 1 1.00 3 1.00 1 0
3 0.00 4 1.00 2 1.00 1 0
5 0.00 90 0.00 3 1.00 1 0
2 0.00 70 0.00 4 1.00 1 0
6 0.00 80 0.00 5 1.00 1 0
80 0.00 5 0.00 70 0.00 0 1
45 0.05 80 0.00 6 0.00 0 1
200 0.02 3 1.00 4 1.00 0 1
25 0.10 90 0.00 70 0.00 0 1
20 0.20 40 0.00 5 0.50 0 1
35 0.00 2 1.00 0 0.00 0 1
100 0.00 0 0.00 100 0.00 0 1
100 0.00 100 0.00 100 0.00 0 1
100 0.00 100 0.00 0 0.00 0 1
70 0.00 0 0.00 0 0.00 0 1
30 0.00 0 0.00 0 0.00 0 1
64 0.00 1 1.00 64 0.00 0 1
300 0.10 1 1.00 1 1.00 0 1
500 0.25 0 0.00 300 0.20 0 1
60 0.30 80 0.05 70 0.10 0 1
90 0.35 100 0.20 60 0.10 0 1
40 0.30 1 1.00 50 0.10 0 1
22 0.00 15 0.00 18 0.00 0 1
18 0.00 20 0.00 16 0.00 0 1
28 0.00 3 1.00 30 0.00 0 1
24 0.00 40 0.00 2 1.00 0 1
20 0.00 8 0.00 10 0.00 0 1
17 0.05 60 0.00 0 0.00 0 1
6 0.00 80 0.00 90 0.00 0 1
3 0.00 60 0.00 75 0.00 0 1
1 0.00 90 0.00 85 0.00 0 1
12 0.00 70 0.00 40 0.00 0 1
10 0.00 25 0.00 30 0.00 0 1
14 0.15 60 0.00 20 0.00 0 1
2 0.00 30 0.00 120 0.00 0 1
5 0.00 100 0.00 0 0.00 0 1
9 0.00 60 0.00 0 0.00 0 1
12 0.00 80 0.00 3 1.00 0 1
4 0.00 70 0.00 6 0.00 0 1
6 0.00 50 0.00 5 0.00 0 1
11 0.00 30 0.00 9 0.00 0 1
8 0.00 0 0.00 60 0.00 0 1
10 0.00 6 0.00 80 0.00 0 1
12 0.20 0 0.00 100 0.00 0 1
8 0.00 2 1.00 85 0.00 1 1
7 0.00 90 0.00 65 0.00 1 1
4 0.00 0 0.00 60 0.00 1 1
3 0.00 8 0.00 40 0.00 1 1
5 0.00 7 0.00 100 0.00 1 1
2 0.00 1 1.00 150 0.00 1 1
6 1.00 2 1.00 90 0.00 1 1
5 1.00 0 0.00 80 0.00 1 1
7 1.00 100 0.00 120 0.00 1 1
9 0.50 60 0.00 70 0.00 1 1
"""


@dataclass
class Block:
    place: int
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""
    words: int = 0

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _marked(name: str, tag: str, in_article: bool) -> bool:
    """Does one class or id name mark an element that isn't the article?"""
    parts = [p.lower() for p in _PARTS.split(name) if p]
    if not parts or parts[0] in WRAPPERS:
        return False
    if tag in ("article", "main"):
        return parts[0] in CHROME_ARTICLES
    hit = {parts[0], parts[-1]} & CHROME_NAMES
    own = in_article or parts[0] in ARTICLE_NAMES
    return bool(hit) and not (hit == {"header"} and own)


def _place(tag: str, attrs: str, place: int) -> int:
    """Place inside an element, given the place around it."""
    if tag in CHROME or tag == "header" and place != ARTICLE_PLACE:
        return CHROME_PLACE
    found = ARTICLE_PLACE if tag in ("article", "main") else place
    if attrs:
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return CHROME_PLACE
            if name == "role" and value.lower() in CHROME_ROLES:
                return CHROME_PLACE
            if name == "role" and value.lower() in MAIN_ROLES or name == "itemprop" and value == "articleBody":
                found = ARTICLE_PLACE
            if name in ("class", "id") and tag not in ("html", "body") and any(_marked(v, tag, place == ARTICLE_PLACE) for v in value.split()):
                return CHROME_PLACE
    return found


class _Reader:
    """Cuts a page into blocks."""

    def __init__(self) -> None:
        self.out: list[Block] = []
        self.stack: list[tuple[str, int]] = []
        self.open = Counter()
        self.now = Block(OPEN_PLACE, False)
        self.link = -1  # depth at which a link was opened

    def text(self, piece: str) -> None:
        if piece:
            piece = html.unescape(piece)
            self.now.parts.append(piece)
            if self.link >= 0:
                self.now.linked += len(piece.split())

    def cut(self, heading: bool = False) -> None:
        now = self.now
        if now.parts:
            words = "".join(now.parts).split()
            if words:
                now.text, now.words = " ".join(words), len(words)
                now.linked = min(now.linked, now.words)
                self.out.append(now)
        self.now = Block(self.stack[-1][1] if self.stack else OPEN_PLACE, heading)

    def pop(self) -> str:
        tag, _ = self.stack.pop()
        self.open[tag] -= 1
        if len(self.stack) < self.link:
            self.link = -1
        return tag

    def tag(self, name: str, attrs: str, end: bool) -> None:
        if name == "a":
            self.link = len(self.stack) if not end and re.search(r"\bhref\b", attrs, re.I) else -1
        elif name == "br":
            self.now.parts.append(" ")
        elif name == "hr":
            self.cut()
        elif name not in BLOCKS:
            pass
        elif end:
            if self.open[name]:
                while self.pop() != name:
                    pass
            self.cut()
        else:
            if self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in _SELF_CLOSING.get(name, ())):
                self.pop()
            around = self.stack[-1][1] if self.stack else OPEN_PLACE
            if around != CHROME_PLACE:
                place = _place(name, attrs, around)
            elif name in ("article", "main") and self.open["form"] and not any(self.open[t] for t in CHROME - {"form"}):
                place = ARTICLE_PLACE  # a form around the whole page
            else:
                place = CHROME_PLACE
            self.stack.append((name, place))
            self.open[name] += 1
            self.cut(name in HEADINGS)


def flat_blocks(page: str) -> list[Block]:
    """Blocks of a page, in order; text decoded, white space made one space."""
    reader, at, size, unclosed = _Reader(), 0, len(page), set()
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            lt = size
        reader.text(page[at:lt])
        if lt == size:
            break
        kind = page[lt + 1 : lt + 2]
        if page.startswith("<!--", lt):
            if page.startswith((">", "->"), lt + 4):  # empty
                end = page.index(">", lt + 4) + 1
            else:
                m = _COMMENT_END.search(page, lt + 4)
                end = m.end() if m else size
            at = end
        elif kind and (m := _TAG.match(page, lt)):
            name, at = m[2].lower(), m.end()
            if page[at - 1] != ">":  # the page ends within the tag
                break
            if not m[1] and name in _RAW_END and name not in unclosed:
                close = _RAW_END[name].search(page, at)
                if close:
                    at = close.start()
                elif name in RAW_IF_CLOSED:
                    unclosed.add(name)
                else:
                    break
            else:
                reader.tag(name, m[3], bool(m[1]))
        elif kind and kind in "!?/":
            end = page.find(">", lt + 2)
            at = end + 1 if end >= 0 else size
        else:
            reader.text("<")
            at = lt + 1
    reader.cut()
    return reader.out


@dataclass
class Node:
    label: int
    feature: int = 0
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def says(self, x: tuple[float, ...]) -> int:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.limit else node.high
        return node.label


def grow(x: np.ndarray, y: np.ndarray, depth: int = MAX_DEPTH) -> Node:
    """A decision tree by Gini impurity, of bounded depth and with leaves of ``MIN_LEAF`` rows at least."""
    gini = lambda p: 2 * p * (1 - p)
    best = None
    if depth and 0 < y.mean() < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[:-1] + values[1:]) / 2:
                low = x[:, f] <= limit
                if min(low.sum(), (~low).sum()) < MIN_LEAF:
                    continue
                cost = low.mean() * gini(y[low].mean()) + (~low).mean() * gini(y[~low].mean())
                if best is None or cost < best[0] - 1e-12:
                    best = (cost, f, limit)
    if best is None:
        return Node(int(y.mean() > 0.5))
    low = x[:, best[1]] <= best[2]
    return Node(int(y.mean() > 0.5), best[1], float(best[2]), grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def labelled_table() -> np.ndarray:
    """FEATURES and label of each labelled block, at each place."""
    rows = [list(map(float, line.split())) for line in LABELLED.strip().splitlines()]
    return np.array([[*r[:-1], place, label] for r in rows for place, label in ((OPEN_PLACE, r[-1]), (ARTICLE_PLACE, 1), (OUTSIDE_PLACE, 0))])


@cache
def default_tree() -> Node:
    table = labelled_table()
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str, tree: Node | None = None) -> str:
    """The blocks that the tree keeps, and those without links between two of them (short items of lists and tables)."""
    tree = tree or default_tree()
    blocks = [b for b in flat_blocks(page) if b.place != CHROME_PLACE]
    own = sum(b.words for b in blocks if b.place == ARTICLE_PLACE)
    outside = OUTSIDE_PLACE if own and 2 * own >= sum(b.words for b in blocks) else OPEN_PLACE
    edge = Block(OPEN_PLACE, False)
    kept: list[str] = []
    between: list[str] | None = None  # blocks without links since the last kept one
    for before, b, after in zip([edge, *blocks], blocks, [*blocks[1:], edge]):
        place = b.place if b.place == ARTICLE_PLACE else outside
        if tree.says((b.words, b.density, before.words, before.density, after.words, after.density, b.heading, place)):
            kept += [*(between or ()), b.text]
            between = []
        elif place == OPEN_PLACE and not b.linked and between is not None:
            between.append(b.text)
        else:
            between = None
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages without their HTML, with text and n_chars."""

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = [main_text(p) for p in strings(batch.column(batch.schema.get_field_index(html_column)))]
        return {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    return add_columns(pages, make, "text string, n_chars long", [c for c in pages.columns if c != html_column])
