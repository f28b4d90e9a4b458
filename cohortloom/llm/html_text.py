"""Main text of web pages: flat text blocks, classified by a decision tree over their neighbours.

A page becomes a flat list of text blocks. Each has its number of words and its link density (share
of characters inside links), those of the blocks before and after it, and what its tags say: whether
it stands in an element for the main text, in one for something else (menus, headers, footers,
sidebars, forms, or named like an advert, a notice, comments ...), outside of the main text that the
page has elsewhere, and whether it is a heading. A decision tree learned from the small
labelled table in ``html_examples`` keeps or drops each block.

One pass, no shuffle; the tree is a few numbers. Scripts, styles, comments, form controls and markup
never become text. Character references are decoded, white space inside a block becomes one space, and
the kept blocks are joined by one space in page order.

Cases: a null page is an empty page, whose text is empty; pages that break off or do not close their
elements are read as far as they go; repeated rows are read alike. A name such as ``related`` on a
container marks all inside as something else, but if that leaves a page without any main text, an
article or main element inside is the main text, unless the container is a nav, footer, aside or holds comments.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.html_examples import PAGES

# Elements whose content is not text of the page; these run on to their end tag, whatever stands between.
RAW = "script|style|title|textarea"
# These end with their end tag, or with the element that they stand in.
SILENT = frozenset("noscript template svg math select datalist button option optgroup iframe object canvas audio video".split())
# Of these, those that a new paragraph does not end.
SCOPES = frozenset("noscript template svg math select datalist button iframe object".split())
MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>"
    rf"|<(?P<raw>{RAW})(?=[\s/>])[^>]*(?:/>|>(?:.*?</(?P=raw)\s*>|.*$))"
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<more>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<more2>[^>]*)>",
    re.DOTALL | re.IGNORECASE,
)
BLOCKS = frozenset(
    "address article aside blockquote body center caption dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 hr".split())  # hold no other block
# An element of these ends when another of them begins in the same list or table.
ITEMS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
HOLDERS = frozenset("ul ol dl table menu div section article main body".split())
MAIN = frozenset("article main".split())
OTHER = frozenset("nav footer aside form menu dialog search".split())
# Of these even an article inside is not the main text.
HARD = frozenset("nav footer aside".split())
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
# Words in the names of elements that hold something else than the main text.
OTHER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr "
    "notice alert popup modal overlay newsletter subscribe signup login share sharing social comment comments disqus reply "
    "replies respond discussion sidebar widget related recommended menu nav navbar navigation navi breadcrumb breadcrumbs "
    "pagination pager footer foot header masthead topbar toolbar search copyright legal toc tags hidden".split()
)
# Of these neither: comments, and teasers on a page that has its main text elsewhere.
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond discussion".split())
HARD_NAMES = COMMENT_NAMES | frozenset("sidebar widget related recommended footer".split())
# A name with one of these first or last tells the state of an element, not what it is.
STATES_FIRST = frozenset("has no with without".split())
STATES_LAST = frozenset("open opened closed enabled disabled".split())
# Parts of an article, if named inside one.
INNER_NAMES = frozenset("header masthead".split())
MAIN_NAMES = frozenset("article articlebody main content post story entry".split())

FEATURES = ("main", "other", "outside", "heading", "words", "links", "words_before", "words_after", "links_before", "links_after")


@dataclass
class Block:
    text: str
    words: int
    links: float
    main: bool
    other: bool
    heading: bool
    lenient: bool = False  # as ``other``, where a main element opens anew what is no comment


def _kinds(more: str) -> list[str]:
    """The words in the names of an element."""
    out: list[str] = []
    for m in NAMES.finditer(more):
        for name in "".join(x or "" for x in m.groups()).split():
            words = [w.lower() for w in WORDS.findall(name)]
            if len(words) > 1 and (words[0] in STATES_FIRST or words[-1] in STATES_LAST):
                continue
            out += words
    return out


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, bool, bool, bool]] = field(default_factory=list)  # tag, main, other, hard, firm
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    anchors: int = 0
    leaf: tuple[str, bool] = ("", False)  # tag and other of the open leaf
    has_main: bool = False
    quiet: int = -1  # place of the first silent element on the stack
    base: int = 0  # elements on the stack when the leaf began; above it are silent ones

    def add(self, text: str) -> None:
        if text and self.quiet < 0:
            self.parts.append(text)
            if self.anchors:
                self.linked += len(text.strip())

    def cut(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(html.unescape(raw).split())
            if text:
                main = other = hard = lenient = firm = False
                for tag, m, o, h, f in self.stack:
                    main, hard, firm = main or m, hard or h, firm or f
                    other = hard or o or (other and not m)
                    lenient = firm or (not m and tag not in MAIN and (o or lenient))
                links = min(1.0, self.linked / len(text))
                named = self.leaf[1]
                self.blocks.append(Block(text, text.count(" ") + 1, links, main, other or named, self.leaf[0] in HEADINGS, lenient or named))
            self.parts.clear()
        self.linked = 0

    def drop(self, place: int) -> None:
        """End the elements from a place of the stack on."""
        del self.stack[place:]
        if self.quiet >= place:
            self.quiet = -1

    def find(self, *tags: str) -> int:
        return next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] in tags), -1)

    def hush(self, tag: str) -> None:
        """Open a silent element, or any element inside of one."""
        if tag == "option" and self.stack and self.stack[-1][0] == "option":
            self.drop(len(self.stack) - 1)
        if self.quiet < 0:
            self.quiet = len(self.stack)
        self.stack.append((tag, False, False, False, False))

    def speak(self, tag: str) -> None:
        """Close a silent element."""
        if 0 <= self.quiet <= (i := self.find(tag)):
            self.drop(i)

    def ends_quiet(self, tag: str, closing: bool) -> bool:
        """Whether a block's tag also ends the silent elements that are open."""
        if self.leaf[0] and (closing and self.leaf[0] == tag and self.find(tag) < self.quiet):
            return True
        if closing:
            return 0 <= self.find(tag) < self.quiet
        return self.leaf[0] == "p" and all(x[0] in SILENT and x[0] not in SCOPES for x in self.stack[self.base :])

    def open(self, tag: str, more: str) -> None:
        names = _kinds(more) if "=" in more else []
        inside = any(x[1] for x in self.stack)
        if inside:
            names = [w for w in names if w not in INNER_NAMES]
        other = tag in OTHER or any(w in OTHER_NAMES for w in names)
        hard = tag in HARD or any(w in HARD_NAMES for w in names)
        firm = tag in HARD or any(w in COMMENT_NAMES for w in names)
        main = tag in MAIN or (not other and tag in ("div", "section") and any(w in MAIN_NAMES for w in names))
        if tag == "header" and not inside:
            other = True  # of the page; that of an article holds its heading
        if tag in ("body", "html"):
            main = other = hard = firm = False
        self.has_main |= main
        if tag in LEAVES:
            self.leaf, self.base = (tag, other), len(self.stack)
            return
        self.leaf = ("", False)
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in HOLDERS:
                break
            if self.stack[i][0] in ITEMS.get(tag, ()):
                self.drop(i)
                break
        self.stack.append((tag, main, other, hard, firm))

    def close(self, tag: str) -> None:
        self.leaf = ("", False)
        if (i := self.find(tag)) >= 0:
            self.drop(i)


def read(page: str | None) -> tuple[list[Block], bool]:
    """The text blocks of a page, and whether an element for the main text was opened."""
    page = page or ""
    r, at = _Reader(), 0
    for m in MARKUP.finditer(page):
        r.add(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"] or m["close2"])
        if tag in SILENT:
            if closing:
                r.speak(tag)
            elif not (m["more"] or m["more2"] or "").endswith("/"):
                r.hush(tag)
            continue
        if r.quiet >= 0:
            if tag not in BLOCKS:
                continue
            if not r.ends_quiet(tag, closing):
                if closing:
                    r.speak(tag)
                elif tag != "hr":
                    r.hush(tag)
                continue
            if r.leaf[0]:
                r.drop(max(r.base, r.quiet))
        if tag in BLOCKS:
            r.cut()
            if closing:
                r.close(tag)
            else:
                r.open(tag, m["more"] or m["more2"] or "")
            if tag not in LEAVES:
                r.anchors = 0
        elif tag == "a":
            r.anchors = 0 if closing else 1
        elif tag in ("br", "img", "input"):
            r.add(" ")
    r.add(page[at:])
    r.cut()
    if not any(b.main and not b.other for b in r.blocks):
        for b in r.blocks:
            b.other = b.other and (not b.main or b.lenient)
    return r.blocks, r.has_main


def features(blocks: list[Block], has_main: bool) -> np.ndarray:
    words = np.array([0, *(b.words for b in blocks), 0], dtype=np.float64)
    links = np.array([0, *(b.links for b in blocks), 0], dtype=np.float64)
    tags = [(b.main, b.other, has_main and not b.main, b.heading) for b in blocks]
    return np.column_stack(
        [
            np.array(tags, dtype=np.float64).reshape(-1, 4),
            *(words[1:-1], links[1:-1], words[:-2], words[2:], links[:-2], links[2:]),
        ]
    )


@dataclass(frozen=True)
class Tree:
    """A leaf has ``keep``; a node sends values up to ``cut`` of a feature to ``low``."""

    keep: bool = False
    feature: int = -1
    cut: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.keep)
        below = x[:, self.feature] <= self.cut
        out = np.empty(len(x), dtype=bool)
        out[below], out[~below] = self.low.decide(x[below]), self.high.decide(x[~below])
        return out


def learn(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Tree:
    """A tree by the Gini impurity; ties go to the first feature and the smallest cut."""
    share = y.mean() if len(y) else 0.0
    leaf = Tree(keep=bool(share >= 0.5))
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return leaf
    best = (len(y) * share * (1 - share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= cut
            a, b = y[low], y[~low]
            if min(len(a), len(b)) < least:
                continue
            impure = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if impure < best[0]:
                best = (impure, f, float(cut))
    if best[1] < 0:
        return leaf
    low = x[:, best[1]] <= best[2]
    return Tree(False, best[1], best[2], learn(x[low], y[low], depth - 1, least), learn(x[~low], y[~low], depth - 1, least))


def labelled(pages: tuple[tuple[str, str], ...] = PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the example blocks; a block is kept if the page's main text has it."""
    xs, ys = [], []
    for page, main in pages:
        blocks, has_main = read(page)
        xs.append(features(blocks, has_main))
        ys.append([b.text in main for b in blocks])
    return np.concatenate(xs), np.concatenate(ys).astype(np.float64)


def main_text(page: str | None, tree: Tree) -> str:
    blocks, has_main = read(page)
    if not blocks:
        return ""
    keep = tree.decide(features(blocks, has_main))
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(df: DataFrame, page: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all others than ``out``) and ``out``, the main text."""
    tree = learn(*labelled())
    names = [c for c in df.columns if c != out] if keep is None else keep
    rows = df.select(F.struct(*names).alias("row"), F.col(page).alias("page"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, tree) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("text").alias(out))
