"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read as a sequence of text blocks, without a document tree. A block knows its words, the share of them inside
links, the same of the blocks before and after it, and how far its enclosing elements name it as content (article, main,
a class or id such as ``content``) or as something else (navigation, footers, adverts, comments and so on). A decision
tree over these numbers, trained on the small table of labelled pages below, says which blocks are main text; they are
joined in page order. The table has a fixed size and does not come from the data, so the tree is the same everywhere.

Null or empty html: empty text. Pages are judged one by one, so repeated rows repeat their result, ties cannot arise
and an empty table gives no rows. Unclosed elements, comments and quotes are read as browsers read them: to the end of
the page. Ids may be null; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that do not end a block, that have no content, whose content is no text, and whose text is no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style head title noscript template iframe object svg math canvas audio video select option button textarea datalist noembed noframes xmp map dialog".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())

# How an element places its text; a page's main text is where the highest place is. Below 0 it is never main text.
OTHER, WEAK, PLAIN, NAMED, MAIN, ARTICLE = -2, -1, 0, 1, 2, 3
ELEMENTS = {"nav": OTHER, "footer": OTHER, "aside": OTHER, "menu": OTHER, "form": WEAK, "main": MAIN, "article": ARTICLE}
ROLE_NAMES = {"main": MAIN, "article": ARTICLE} | dict.fromkeys("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split(), OTHER)
OTHER_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup"
    " modal overlay nav navbar navigation menu menus topbar breadcrumb breadcrumbs sidebar side rail widget widgets footer header masthead copyright legal"
    " comment comments commentlist respond replies disqus discussion share sharing social related recommended newsletter subscribe signup login search"
    " pagination pager skip toolbar teaser teasers".split()
)
CONTENT_NAMES = frozenset("article articlebody content maincontent post postbody entry story storybody articletext bodytext".split())

TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"""[\s/]*(?:([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?|(["'=]))""")
NAME_PART = re.compile(r"[a-z0-9]+")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block(NamedTuple):
    text: str
    words: int
    linked: int
    place: int


#: Labelled pages, block by block: place, words, words in links, is it main text. Made up for this purpose.
LABELLED: list[list[tuple[int, int, int, int]]] = [
    # a news page with an article element
    [(-2, 1, 1, 0), (-2, 1, 1, 0), (-2, 2, 2, 0), (-2, 8, 0, 0), (3, 9, 0, 1), (3, 60, 2, 1), (3, 1, 0, 1), (3, 110, 0, 1), (3, 4, 4, 1), (3, 33, 1, 1), (-2, 14, 0, 0)],
    # short paragraphs in an article, an advert between them, comments after them
    [(-2, 3, 3, 0), (3, 4, 0, 1), (3, 2, 0, 1), (3, 1, 1, 1), (-2, 25, 3, 0), (3, 3, 0, 1), (3, 7, 0, 1), (-2, 40, 0, 0), (-2, 55, 0, 0), (-2, 9, 2, 0)],
    # long texts outside the article: notices, author boxes, link lists
    [(0, 45, 2, 0), (0, 1, 1, 0), (0, 1, 1, 0), (3, 8, 0, 1), (3, 80, 0, 1), (3, 5, 0, 1), (0, 60, 0, 0), (0, 30, 0, 0), (-2, 20, 5, 0)],
    # main element around an article
    [(-2, 2, 2, 0), (2, 12, 0, 0), (3, 10, 0, 1), (3, 2, 0, 1), (3, 90, 9, 1), (2, 35, 0, 0), (2, 3, 3, 0), (1, 40, 0, 0), (0, 30, 0, 0)],
    # main element without an article
    [(-2, 1, 1, 0), (0, 6, 0, 0), (2, 6, 0, 1), (2, 70, 3, 1), (2, 1, 0, 1), (2, 15, 0, 1), (2, 50, 0, 1), (0, 40, 0, 0), (1, 18, 0, 0), (-2, 9, 3, 0)],
    # content by class or id
    [(0, 2, 2, 0), (0, 30, 0, 0), (1, 7, 0, 1), (1, 66, 0, 1), (1, 2, 0, 1), (1, 3, 0, 1), (1, 120, 4, 1), (0, 25, 0, 0), (0, 55, 1, 0), (-2, 70, 0, 0)],
    [(-2, 2, 2, 0), (1, 1, 0, 1), (1, 40, 0, 1), (1, 5, 5, 1), (1, 28, 0, 1), (-1, 30, 0, 0), (0, 12, 0, 0)],
    # no telling element at all: a menu, a heading, text, a link list, a footer
    [(0, 1, 1, 0), (0, 1, 1, 0), (0, 2, 2, 0), (0, 1, 1, 0), (0, 6, 0, 1), (0, 45, 2, 1), (0, 70, 0, 1), (0, 4, 0, 1), (0, 52, 1, 1), (0, 38, 0, 1), (0, 3, 3, 0), (0, 4, 4, 0), (0, 2, 2, 0), (0, 8, 3, 0)],
    [(0, 5, 5, 0), (0, 3, 3, 0), (0, 2, 0, 0), (0, 3, 3, 0), (0, 7, 0, 1), (0, 120, 6, 1), (0, 2, 0, 1), (0, 95, 0, 1), (0, 5, 2, 0), (0, 6, 6, 0), (0, 4, 0, 0)],
    [(0, 8, 0, 1), (0, 24, 0, 1), (0, 31, 0, 1), (0, 5, 0, 1), (0, 29, 3, 1), (0, 18, 0, 1), (0, 40, 0, 1)],
    [(0, 4, 4, 0), (0, 20, 18, 0), (0, 33, 30, 0), (0, 9, 0, 1), (0, 64, 5, 1), (0, 77, 10, 1), (0, 22, 2, 1), (0, 25, 22, 0), (0, 3, 0, 0), (0, 2, 2, 0)],
    [(0, 200, 0, 1)],
    [(0, 3, 0, 0), (0, 1, 1, 0), (0, 2, 2, 0)],
    [(-2, 2, 2, 0), (-2, 1, 1, 0), (0, 50, 0, 1), (0, 3, 0, 1), (0, 60, 4, 1), (-2, 30, 0, 0)],
    # nothing but frame
    [(-2, 30, 1, 0), (-2, 4, 4, 0), (-1, 12, 0, 0), (-1, 40, 0, 0), (-2, 100, 0, 0)],
    [(-2, 45, 2, 0), (-2, 5, 5, 0), (-1, 22, 0, 0), (-1, 3, 3, 0), (-2, 60, 0, 0), (-2, 9, 9, 0), (-2, 14, 1, 0), (-2, 2, 2, 0)],
    [(-1, 18, 0, 0), (-1, 3, 3, 0), (-1, 70, 0, 0), (-1, 8, 8, 0)],
    # one block in an article, and an article of short verses
    [(-2, 40, 0, 0), (3, 1, 0, 1), (-2, 10, 0, 0)],
    [(-2, 1, 1, 0), (3, 2, 0, 1), (3, 3, 0, 1), (3, 2, 0, 1), (3, 4, 0, 1), (3, 1, 0, 1), (0, 3, 0, 0), (0, 90, 0, 0)],
    [(2, 1, 0, 1), (2, 2, 2, 1), (2, 4, 0, 1), (-2, 3, 3, 0)],
    [(1, 2, 0, 1), (1, 1, 1, 1), (-2, 6, 0, 0)],
    # content that ends the page
    [(-2, 3, 3, 0), (3, 40, 0, 1), (3, 1, 0, 1)],
    [(-2, 9, 0, 0), (2, 21, 0, 1), (2, 2, 0, 1)],
    [(0, 12, 0, 0), (1, 35, 4, 1), (1, 3, 0, 1)],
    [(3, 2, 0, 1)],
    [(3, 30, 9, 1), (3, 12, 0, 1)],
    [(2, 8, 8, 1), (2, 9, 0, 1)],
    [(1, 10, 5, 1), (1, 30, 0, 1)],
    [(3, 5, 2, 1), (3, 3, 1, 1)],
    # lists of links inside the content
    [(3, 20, 20, 1), (3, 14, 0, 1), (3, 12, 12, 1), (3, 1, 0, 1), (3, 9, 9, 1), (3, 40, 1, 1)],
    [(2, 25, 24, 1), (2, 11, 0, 1), (2, 7, 7, 1), (2, 2, 0, 1), (2, 8, 8, 1), (2, 3, 0, 1)],
    [(1, 18, 18, 1), (1, 13, 0, 1), (1, 9, 9, 1), (1, 2, 0, 1), (1, 30, 30, 1), (1, 1, 0, 1)],
    [(2, 1, 0, 1)],
    [(1, 4, 0, 1)],
    # texts full of links
    [(0, 1, 1, 0), (0, 1, 1, 0), (0, 5, 0, 1), (0, 40, 10, 1), (0, 52, 13, 1), (0, 31, 8, 1), (0, 6, 5, 0), (0, 2, 2, 0)],
]
FEATURES = ["place", "below", "words", "linked", "words_before", "linked_before", "words_after", "linked_after"]
DEPTH = 6


class _Reader:
    """Collects the text blocks of one page. The open elements carry the place of their text, so that each step is short."""

    def __init__(self) -> None:
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int, bool, bool]] = []  # name, place, inside a link, no text
        self.count: dict[str, int] = {}
        self.parts: list[tuple[str, bool]] = []

    def here(self) -> tuple[int, bool, bool]:
        return self.open[-1][1:] if self.open else (PLAIN, False, False)

    def text(self, text: str) -> None:
        _, linked, silent = self.here()
        if text and not silent:
            self.parts.append((entities.unescape(text), linked))

    def end_block(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(t for t, _ in self.parts).split())
        if text:
            linked = sum(len(t.split()) for t, link in self.parts if link)
            words = text.count(" ") + 1
            self.blocks.append(Block(text, words, min(linked, words), self.here()[0]))
        self.parts = []

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> None:
        if name == "br":
            self.parts.append((" ", False))
            return
        if name not in INLINE:
            self.end_block()
        if name in EMPTY:
            return
        # an item, paragraph or link ends the one before it
        if name in ("li", "p", "a", "option", "dt", "dd", "td", "th", "tr") and self.open and self.open[-1][0] == name:
            self.end(name)
        elif name not in INLINE and self.count.get("p") and name != "p":
            self.end_paragraph()
        elif name == "p" and self.count.get("p"):
            self.end_paragraph()
        place, linked, silent = self.here()
        self.open.append((name, placed(name, attributes, place), linked or name == "a", silent or name in SILENT or hidden(attributes)))
        self.count[name] = self.count.get(name, 0) + 1
        if closed and name in ("svg", "math"):
            self.end(name)

    def end_paragraph(self) -> None:
        """A block ends an open paragraph, if only inline elements were opened in it."""
        for name, *_ in reversed(self.open):
            if name == "p":
                self.end("p")
                return
            if name not in INLINE:
                return

    def end(self, name: str) -> None:
        if name not in INLINE:
            self.end_block()
        if not self.count.get(name):
            return
        if name in INLINE and any(x[0] not in INLINE for x in self._after(name)):
            return
        while True:
            last = self.open.pop()[0]
            self.count[last] -= 1
            if last == name:
                return

    def _after(self, name: str) -> Iterator[tuple]:
        """Open elements inside the last one of that name; stops at the first that is no inline element."""
        for x in reversed(self.open):
            if x[0] == name:
                return
            yield x
            if x[0] not in INLINE:
                return


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(HIDDEN_STYLE.search(attributes.get("style", "")))


def placed(name: str, attributes: dict[str, str], outer: int) -> int:
    """The place of an element's text, from its name, role, class and id and the place around it."""
    if outer == OTHER:
        return OTHER
    own = ROLE_NAMES.get(attributes.get("role", "").strip().lower(), ELEMENTS.get(name, PLAIN))
    if name == "header" and outer < MAIN:
        own = OTHER
    if name not in ("html", "body", "main"):
        words = {w for a in ("class", "id") for part in attributes.get(a, "").lower().split() for w in (part, *NAME_PART.findall(part))}
        if words & OTHER_NAMES and not (name in ("h1", "h2", "header") and outer >= MAIN):
            return OTHER
        if own == PLAIN and (words & CONTENT_NAMES or attributes.get("itemprop", "").lower() == "articlebody"):
            own = NAMED
    if own == PLAIN or (outer == WEAK and own == NAMED):
        return outer
    return max(own, outer) if own > PLAIN else own


@lru_cache(maxsize=64)
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def text_blocks(page: str | None) -> list[Block]:
    """The text blocks of a page in order."""
    page = page or ""
    reader = _Reader()
    at, size = 0, len(page)
    while at < size:
        sign = page.find("<", at)
        if sign < 0:
            reader.text(page[at:])
            break
        reader.text(page[at:sign])
        name = TAG_NAME.match(page, sign + 2 if page.startswith("</", sign) else sign + 1)
        if page.startswith("<!--", sign):
            end = sign + 4 if page.startswith((">", "->"), sign + 4) else page.find("-->", sign + 4)
            at = size if end < 0 else page.find(">", end) + 1
        elif name and page.startswith("</", sign):
            end = page.find(">", name.end())
            reader.end(name.group().lower())
            at = size if end < 0 else end + 1
        elif page.startswith(("<!", "<?", "</"), sign):
            end = page.find(">", sign)
            at = size if end < 0 else end + 1
        elif name:
            attributes, at = start_tag(page, name.end())
            tag = name.group().lower()
            if at > size:
                break
            reader.start(tag, attributes, page.startswith("/>", at - 2))
            if tag in RAW:
                found = raw_end(tag).search(page, at)
                if not found:
                    break
                at = found.start()
        else:
            reader.text("<")
            at = sign + 1
    reader.end_block()
    return reader.blocks


def start_tag(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of a start tag and the place after it; beyond the page if the tag does not end."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if not m:
            end = page.find(">", at)
            return found, len(page) + 1 if end < 0 else end + 1
        at = m.end()
        if m.group(1) is None:
            continue
        if m.group(2) is m.group(3) is m.group(4) is None and page[at : at + 1] in ('"', "'"):
            return found, len(page) + 1
        value = next((v for v in m.groups()[1:4] if v is not None), "")
        found.setdefault(m.group(1).lower(), entities.unescape(value))


def numbers_of(blocks: list[tuple[int, int, int]]) -> list[list[float]]:
    """The features of each block from (place, words, words in links) of all blocks of its page."""
    share = lambda b: b[2] / max(b[1], 1)
    best = max((b[0] for b in blocks), default=0)
    edge = (0, 0, 0)
    out = []
    for before, b, after in zip([edge, *blocks], blocks, [*blocks[1:], edge]):
        out.append([float(x) for x in (b[0], best - b[0], b[1], share(b), before[1], share(before), after[1], share(after))])
    return out


Tree = tuple | float


def trained_tree(spark: SparkSession, pages: list[list[tuple[int, int, int, int]]] = LABELLED) -> Tree:
    """A decision tree over the labelled pages: ``(feature, threshold, at most, above)`` or the label."""
    rows = [(Vectors.dense(x), float(b[3])) for page in pages for x, b in zip(numbers_of([b[:3] for b in page]), page)]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=DEPTH, maxBins=256, seed=1).fit(table)
    lines = [x.strip() for x in model.toDebugString.splitlines() if "If (" in x or "Else (" in x or "Predict:" in x]

    def read() -> Tree:
        line = lines.pop(0)
        if line.startswith("Predict:"):
            return float(line.split(":")[1])
        feature, threshold = re.match(r"If \(feature (\d+) <= (\S+)\)", line).groups()
        low = read()
        lines.pop(0)
        return int(feature), float(threshold), low, read()

    return read()


def label_of(tree: Tree, numbers: list[float]) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, low, high = tree
        tree = low if numbers[feature] <= threshold else high
    return tree > 0.5


def page_text(tree: Tree, page: str | None) -> str:
    blocks = text_blocks(page)
    numbers = numbers_of([(b.place, b.words, b.linked) for b in blocks])
    return " ".join(b.text for b, x in zip(blocks, numbers) if label_of(tree, x))


def main_text(pages: DataFrame, labelled: list[list[tuple[int, int, int, int]]] = LABELLED) -> DataFrame:
    """``page_id, url, text, n_chars`` of each page."""
    tree = trained_tree(pages.sparkSession, labelled)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["page_id", "url"]].assign(text=[page_text(tree, h) for h in batch["html"]])

    kind = pages.schema["page_id"].dataType
    rows = pages.select(F.col("page_id").cast("string"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInPandas(work, "page_id string, url string, text string")
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
