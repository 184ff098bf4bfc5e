"""Main text of web pages by minimum-cut labelling.

A page is read into text blocks (runs of text between block-level tags). A
linear classifier turns each block's shape (length, share of link text, whether
it ends like a sentence) and place (enclosing elements, words of their class, id
and role) into a log-odds of being content; the odds become capacities to the
two terminals, neighbouring blocks and blocks close in the element tree are tied
by smoothness edges, and a maximum flow separates content from the rest. The
blocks on the content side are joined by line feeds.

The weights of shape are learned from the pages themselves (``train_weights``):
in a bounded sample of pages with one article or main element its blocks stand
for content and all others for the rest. What elements and class words say are
fixed values, so that pages without such an element are read by the conventions
of markup. Words that name boilerplate don't count in compounds that only
qualify (has-sidebar, category-social), never make an article or main element
negative, and don't count on an element that holds most of the page's text with
all of its article and main elements.

Defined cases: a null or empty page has an empty text; broken markup is read as
far as it goes (an open tag at the end is dropped, an unknown one is inline);
character references are decoded once; pages are read whole, in time in
proportion to their length; of equally good cuts the one with the fewest content
blocks counts; rows that repeat get equal results; an empty table gives an empty
one; without pages to learn from the weights are START_WEIGHTS.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from toolweave.llm.common import map_batches, texts_of

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/!?a-zA-Z][^>]*+(?:>|\Z)|[^<]++|<""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Fixed values of HTML: block-level elements, elements without content, elements whose content is not shown as text.
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption head option".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg math iframe object canvas audio video title textarea select button datalist head noframes".split())
RAW = set("script style title textarea iframe noframes noscript template".split())
CLOSES_P = BLOCKS - {"html", "body", "head", "option"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table body html div article section main".split())

# Fixed values of the classifier: log-odds by enclosing element and by words of class, id and role.
ELEMENT = {"article": 3.0, "main": 2.5, "p": 0.8, "blockquote": 0.8, "pre": 0.8, "h1": 1.0, "h2": 0.6, "h3": 0.5, "nav": -7.0, "footer": -7.0, "aside": -7.0, "form": -7.0, "header": -2.5, "menu": -7.0, "dialog": -7.0, "fieldset": -7.0, "search": -7.0, "address": -2.0, "figure": -0.3, "li": -0.2}
GOOD_WORDS = {w: 1.5 for w in "article content entry post story body main text prose".split()}
BAD_WORDS = {w: -8.0 for w in "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus respond reply replies discussion form search toolbar copyright disclaimer masthead topbar contentinfo complementary alert paywall teaser".split()} | {"header": -3.0}
#: Words after which the rest of a class name says what goes with an element or what it is about, not what it is.
QUALIFIERS = set("has have with without no not non hide hidden show supports category cat tag topic format type status".split())
WRAPPERS, MOST_TEXT = ("article", "main"), 0.7
FULL_LENGTH = 40
SENTENCE_END = tuple(".!?\u2026:;\"\u201d\u00bb\u3002\uff01\uff1f")


class Weights(NamedTuple):
    """Log-odds by a block's shape: constant, per full length, per share of link text, for a sentence's end."""

    start: float
    length: float
    links: float
    sentence: float


#: What learning starts from, and how far (standard deviation) it goes against little evidence.
START_WEIGHTS, WEIGHT_SPREAD = Weights(-1.0, 2.5, -5.0, 0.0), 0.5
#: Content and the rest count as so many blocks each, however many there are: one source's habits adjust the conventions, they don't replace them.
EVIDENCE = 50
#: Pages that weights are learned from, at most about.
SAMPLE_PAGES = 2000
ADJACENT, SAME_PARENT, CLOSE = 0.4, 1.5, 0.8


@dataclass
class Element:
    tag: str
    depth: int
    parent: int
    number: int
    odds: float
    bad: float
    hidden: bool
    wrapped: bool = False


@dataclass
class Block:
    element: int
    pieces: list[str] = field(default_factory=list)
    linked: int = 0

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())

    def shape(self) -> tuple[float, float, float, float]:
        """What the learned weights multiply."""
        text = self.text
        words = text.count(" ") + 1
        return 1.0, min(words, FULL_LENGTH) / FULL_LENGTH, self.linked / (sum(map(len, self.pieces)) or 1), float(text.endswith(SENTENCE_END))


def _names(rest: str) -> set[str]:
    """The words of class, id and role; of a compound those before a qualifier."""
    words: set[str] = set()
    for m in ATTRIBUTE.finditer(rest):
        for token in (m[1] or m[2] or m[3] or "").split():
            for w in map(str.lower, NAME.findall(token)):
                if w in QUALIFIERS:
                    break
                words.add(w)
    return words


def _own_odds(tag: str, rest: str) -> tuple[float, float]:
    """(odds, odds by words that name boilerplate) of an element without those around it."""
    odds, bad = ELEMENT.get(tag, 0.0), 0.0
    if tag == "form":  # server-rendered pages are one form: one that holds most of the text is only around it
        odds, bad = 0.0, odds
    if rest and "=" in rest:
        words = _names(rest)
        if tag not in ("body", "html"):
            bad = min((BAD_WORDS[w] for w in words if w in BAD_WORDS), default=bad)
        if not words.isdisjoint(GOOD_WORDS) and words.isdisjoint(BAD_WORDS):
            odds += 1.5
        if tag in WRAPPERS:
            bad = max(bad, -odds)
    return odds, bad


def _weigh(blocks: list[Block], elements: list[Element]) -> None:
    """Add up each element's odds with those around it."""
    if any(e.bad for e in elements):
        held, wraps = [0] * len(elements), [int(e.tag in WRAPPERS) for e in elements]
        for b in blocks:
            held[b.element] += max(0, len(b.text) - b.linked)
        for e in reversed(elements[1:]):
            held[e.parent] += held[e.number]
            wraps[e.parent] += wraps[e.number]
        for e in elements:
            if e.bad and held[0] and held[e.number] >= MOST_TEXT * held[0] and wraps[e.number] == wraps[0]:
                e.bad = 0.0
    for e in elements[1:]:
        e.odds += e.bad + elements[e.parent].odds


class Places(dict):
    """Where names stand in a list that only grows and shrinks at its end."""

    def push(self, name: str, at: int) -> None:
        self.setdefault(name, []).append(at)

    def cut(self, names: list[str], at: int) -> None:
        """Forget and drop what stands from ``at`` on."""
        while len(names) > at:
            self[names.pop()].pop()

    def last(self, names: set[str]) -> int:
        return max((p[-1] for n in names if (p := self.get(n))), default=-1)


def read_blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The page's shown text blocks in order, and its block-level elements."""
    elements = [Element("", 0, -1, 0, 0.0, 0.0, False)]
    open_, tags, places = [0], [""], Places({"": [0]})
    blocks: list[Block] = []
    current: Block | None = None
    link = False
    at, n = 0, len(page)
    hidden_depth: list[str] = []
    hidden_places = Places()
    inside: Counter[str] = Counter()  # block elements that were opened within the hidden ones
    ends: dict[str, int] = {}

    def flush() -> None:
        nonlocal current
        if current is not None and current.text:
            blocks.append(current)
        current = None

    def close(ending: set[str], until: set[str]) -> None:
        """Close the innermost of these elements, with all inside it, unless one of ``until`` stands between."""
        k = places.last(ending)
        if k > 0 and k >= places.last(until):
            places.cut(tags, k)
            del open_[k:]

    def unclosed(tag: str) -> bool:
        """Whether no end tag of a hidden element follows: such an element hides nothing."""
        if tag in RAW:
            return False
        if tag not in ends:
            ends[tag] = max((m.start() for m in re.finditer(rf"</{re.escape(tag)}(?=[\s/>])", page, re.IGNORECASE)), default=-1)
        return ends[tag] < at

    def hide(tag: str) -> None:
        if not hidden_depth:
            inside.clear()
        hidden_places.push(tag, len(hidden_depth))
        hidden_depth.append(tag)

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if (page[m.start()] != "<" or m[0] == "<") and not hidden_depth and not elements[open_[-1]].hidden:
                if current is None:
                    if m[0].isspace():
                        continue
                    current = Block(open_[-1])
                piece = html.unescape(m[0]) if "&" in m[0] else m[0]
                current.pieces.append(piece)
                if link:
                    current.linked += len(piece)
            continue
        tag = tag.lower()
        if m["end"]:
            if hidden_depth and tag in BLOCKS and tag != "p" and not hidden_places.get(tag):
                if inside[tag]:
                    inside[tag] -= 1
                    continue
                if places.last({tag}) > 0:  # the end of an element around the hidden ones ends them too
                    hidden_places.cut(hidden_depth, 0)
            if hidden_places.get(tag):
                hidden_places.cut(hidden_depth, hidden_places[tag][0])
                if tag == "head":
                    flush()
            elif tag == "a":
                link = False
            elif tag in BLOCKS:
                flush()
                link = False
                close({tag}, set())
            continue
        if tag == "body":
            hidden_places.cut(hidden_depth, 0)
        if hidden_depth:
            if tag in BLOCKS and tag not in VOID:
                inside[tag] += 1
            if tag in HIDDEN and tag not in VOID and not m["rest"].endswith("/") and not unclosed(tag):
                hide(tag)
                if tag in RAW:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.IGNORECASE).search(page, at)
                    at = end.start()
            continue
        if tag in HIDDEN:
            if m["rest"].endswith("/") and tag not in RAW or unclosed(tag):
                continue
            hide(tag)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])|\Z", re.IGNORECASE).search(page, at)
                at = end.start()
            continue
        if tag == "a":
            link = True
        elif tag == "br":
            if current is not None:
                current.pieces.append(" ")
        elif tag in BLOCKS:
            flush()
            link = False
            if tag in CLOSES_P:
                close({"p"}, SCOPES - {"body"})
            if tag in SIBLINGS:
                close(SIBLINGS[tag], SCOPES)
            if tag not in VOID:
                parent = elements[open_[-1]]
                elements.append(Element(tag, parent.depth + 1, open_[-1], len(elements), *_own_odds(tag, m["rest"]), parent.hidden or bool(re.search(r"""\bhidden\b(?!\s*=\s*["']?false)|display\s*:\s*none""", m["rest"]))))
                elements[-1].wrapped = parent.wrapped or tag in WRAPPERS
                places.push(tag, len(tags))
                tags.append(tag)
                open_.append(len(elements) - 1)
    flush()
    _weigh(blocks, elements)
    return blocks, elements


def log_odds(block: Block, element: Element, weights: Weights = START_WEIGHTS) -> float:
    """The classifier: log-odds that a block is content."""
    return element.odds + sum(w * x for w, x in zip(weights, block.shape(), strict=True))


class Flow:
    """Maximum flow by blocking flows in level graphs; nodes n and n + 1 are the terminals."""

    def __init__(self, n: int):
        self.n, self.to, self.room = n, [], []
        self.out: list[list[int]] = [[] for _ in range(n + 2)]

    def edge(self, a: int, b: int, forth: float, back: float = 0.0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def levels(self) -> list[int]:
        level = [-1] * (self.n + 2)
        level[self.n] = 0
        queue = deque([self.n])
        while queue:
            a = queue.popleft()
            for e in self.out[a]:
                if self.room[e] > 1e-9 and level[b := self.to[e]] < 0:
                    level[b] = level[a] + 1
                    queue.append(b)
        return level

    def source_side(self) -> list[bool]:
        """Run the flow; which nodes remain reachable from the source."""
        source, sink = self.n, self.n + 1
        while (level := self.levels())[sink] >= 0:
            nxt = [0] * (self.n + 2)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    push = min(self.room[e] for e in path)
                    cut = 0
                    for k in range(len(path) - 1, -1, -1):
                        e = path[k]
                        self.room[e] -= push
                        self.room[e ^ 1] += push
                        if self.room[e] <= 1e-9:
                            cut = k
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                    continue
                edges = self.out[a]
                while nxt[a] < len(edges):
                    e = edges[nxt[a]]
                    if self.room[e] > 1e-9 and level[self.to[e]] == level[a] + 1:
                        break
                    nxt[a] += 1
                if nxt[a] < len(edges):
                    path.append(e)
                    a = self.to[e]
                elif path:
                    e = path.pop()
                    a = self.to[e ^ 1]
                    nxt[a] += 1
                else:
                    break
        return [x >= 0 for x in level[: self.n]]


def cut_costs(blocks: list[Block], elements: list[Element], weights: Weights = START_WEIGHTS) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(log-odds per block, smoothness edges): what a labelling costs is the odds it goes against and the edges it cuts."""
    odds = [log_odds(b, elements[b.element], weights) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    last_of: dict[int, int] = {}
    for i, b in enumerate(blocks):
        own = elements[b.element]
        if i:
            edges.append((i - 1, i, ADJACENT))
        for parent, weight in ((own.parent, SAME_PARENT), (elements[own.parent].parent if own.parent >= 0 else -1, CLOSE)):
            if parent >= 0:
                if (j := last_of.get(parent)) is not None and j != i:
                    edges.append((j, i, weight))
                last_of[parent] = i
    return odds, edges


def label_blocks(blocks: list[Block], elements: list[Element], weights: Weights = START_WEIGHTS) -> list[bool]:
    """Which blocks are content: the source side of a minimum cut."""
    odds, edges = cut_costs(blocks, elements, weights)
    n = len(blocks)
    flow = Flow(n)
    for i, z in enumerate(odds):
        if z > 0:
            flow.edge(n, i, z)
        elif z < 0:
            flow.edge(i, n + 1, -z)
    for i, j, weight in edges:
        flow.edge(i, j, weight, weight)
    return flow.source_side()


def main_text(page: str, weights: Weights = START_WEIGHTS) -> str:
    """The content blocks of a page, joined by line feeds."""
    if not page:
        return ""
    blocks, elements = read_blocks(page)
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, elements, weights), strict=True) if keep)


def fit_weights(shapes: np.ndarray, content: np.ndarray, n: np.ndarray, start: Weights = START_WEIGHTS, spread: float = WEIGHT_SPREAD) -> Weights:
    """Logistic regression by Newton steps, drawn towards ``start``; row k of ``shapes`` stands for ``n[k]`` blocks.

    Both classes count as EVIDENCE blocks, or as many as there are.
    """
    prior, n = np.array(start), n.astype(np.float64)
    for label in (0, 1):
        mine = content == label
        n[mine] *= min(1.0, EVIDENCE / max(1.0, n[mine].sum()))
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(shapes @ w, -500, 500)))
        gradient = shapes.T @ (n * (content - p)) - (w - prior) / spread**2
        curvature = (shapes * (n * p * (1 - p))[:, None]).T @ shapes + np.eye(len(w)) / spread**2
        step = np.linalg.solve(curvature, gradient)
        w = w + step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return Weights(*map(float, w))


def train_weights(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights of shape from about ``sample`` pages, drawn by a hash of the id, that have one article or main element.

    Its blocks are content, all others are not; where they lie is not looked at.
    Blocks are counted by their shape, so what reaches the driver has a bound:
    41 lengths, 21 shares of link text, sentence or not, content or not.
    """
    n = pages.count()
    share = int(min(1.0, sample / max(1, n)) * (1 << 20))
    drawn = pages.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share).select(F.col(html_col).alias("html"))

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            rows = []
            for page in texts_of(batch, 0):
                blocks, elements = read_blocks(page)
                if sum(e.tag in WRAPPERS for e in elements) == 1:
                    rows += [(*b.shape()[1:], float(elements[b.element].wrapped)) for b in blocks]
            if not rows:
                return None
            length, links, sentence, content = map(np.array, zip(*rows, strict=True))
            cells = np.stack([np.rint(length * FULL_LENGTH), np.rint(np.minimum(links, 1) * 20), sentence, content], 1).astype(np.int64)
            cells, count = np.unique(cells, axis=0, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*cells.T, count)], ["length", "links", "sentence", "content", "n"])

        return work

    kinds = "length bigint, links bigint, sentence bigint, content bigint, n bigint"
    cells = map_batches(drawn, start, kinds).groupBy("length", "links", "sentence", "content").agg(F.sum("n").alias("n")).collect()
    if not cells:
        return START_WEIGHTS
    rows = np.array(sorted(map(tuple, cells)), np.float64)
    shapes = np.stack([np.ones(len(rows)), rows[:, 0] / FULL_LENGTH, rows[:, 1] / 20, rows[:, 2]], 1)
    return fit_weights(shapes, rows[:, 3], rows[:, 4])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), weights: Weights = START_WEIGHTS) -> DataFrame:
    """Per row: the id, the columns ``keep``, ``text`` and ``n_chars``."""
    names = [id_col, *keep]
    fields = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))
    slim = pages.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col(html_col).alias("html"))
    k = len(names)

    def start():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(t, weights) for t in texts_of(batch, k)]
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*(f"c{i}" for i in range(k)), "text", "n_chars"])

        return work

    out = map_batches(slim, start, f"{fields}, text string, n_chars bigint")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "text", "n_chars")
