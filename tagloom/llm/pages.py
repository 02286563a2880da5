"""Main text of web pages by two passes of rules over their blocks.

A page is cut into blocks (paragraphs, headings, list entries, ...) without its scripts, styles, forms' controls and
hidden parts. In the first pass a block is decided by where it stands (a menu is none of the text), by the part of
its characters that are links, by its length and by the density of stop words. Short blocks stay open. In the second
pass they take the label of the nearest decided blocks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.shared import small_batches

#: Languages whose stop words Spark has.
LANGUAGES = (
    "danish dutch english finnish french german hungarian italian norwegian portuguese russian spanish swedish turkish"
).split()
#: Characters from which a block is decided by its words, and from which few stop words are enough.
SHORT, LARGE = 70, 200
#: Densities of stop words: text, and text if the block is large.
DENSE, SPARSE = 0.30, 0.15
#: Part of a block's characters that may be links: in the article, and elsewhere.
LINKS_INSIDE, LINKS = 0.5, 0.25

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>"
    r"|<(?:[!?/][^>]*+(?:>|\Z)|[a-zA-Z][^>]*+\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(
    r"(?:^|[\s\"'/])(class|id|role|style|hidden|aria-hidden|itemprop)(?![\w-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I
)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Elements whose content is no mark-up; it ends at their own end tag.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset(
    "head svg math object template noscript select button audio video canvas datalist map applet frameset".split()
)
#: Elements around blocks.
BOXES = frozenset(
    "html body div section article main nav aside header footer form fieldset table ul ol dl menu figure details dialog "
    "blockquote address center search hgroup".split()
) | DROPPED
#: Elements that are blocks, or end the one before.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr pre hr caption figcaption legend summary option optgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
#: Elements and roles that hold what is none of the article wherever they stand.
APART = frozenset("nav aside footer menu dialog search".split())
APART_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tablist form".split()
)
#: Pieces of class names and ids: readers' comments, other things around an article, and the article itself.
COMMENT_NAMES = frozenset("comment comments commentlist disqus respond reply replies discussion pingback trackback".split())
AROUND_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification newsletter subscribe subscription signup popup modal overlay lightbox sidebar side widget "
    "widgets nav navbar navigation menu breadcrumb breadcrumbs crumbs header masthead topbar footer copyright legal share sharing "
    "social related recommended recommendations popular trending tags tagcloud pager pagination login search toolbar skip alert "
    "disclaimer paywall teaser feedback rating".split()
)
ARTICLE_NAMES = frozenset(
    "articlebody article-body article-content post-content post-body entry-content story-body main-content page-content "
    "mw-content-text content main article post entry story".split()
)
_COMMENTS_HEADING = re.compile(r"(?:\d+\s+)?(?:comments?|responses|replies|kommentare?|commentaires?|comentarios?)\b.{0,30}", re.I)
_NOTICE = re.compile(r"©|\(c\)\s*\d{4}|all rights reserved|\bcookies?\b.*\b(?:accept|agree|consent|policy|use)\b|^advertisement$", re.I)
_EDGE = ".,;:!?()[]{}\"'«»„“”‘’…"


@dataclass(slots=True)
class State:
    """What holds inside an element."""

    dropped: bool = False  # none of its text is text of the page
    apart: bool = False  # it is none of the article
    around: int = 0  # number of the element whose name or tag says that it is none of the article, 0 for none
    article: int = 0  # 2 inside an element that marks the article, 1 if only its name does
    box: int = 0  # number of the innermost box


@dataclass(slots=True)
class Block:
    text: str
    links: int
    heading: bool
    state: State
    own_around: bool  # the block itself is named like things around an article


def _inside(tag: str, attributes: str, outer: State, number: int) -> tuple[State, bool]:
    """The state inside an element, and whether its names say that it is none of the article."""
    state = State(outer.dropped or tag in DROPPED, outer.apart or tag in APART, outer.around, outer.article, number)
    if tag in ("article", "main"):
        state.article = 2
        state.around = 0
    elif tag == "form" or (tag == "header" and outer.article < 2):
        state.around = state.around or number
    named = False
    if attributes and not attributes.isspace():
        for match in _ATTRIBUTE.finditer(attributes):
            key, value = match[1].lower(), html.unescape(match[2] or match[3] or match[4] or "")
            if key == "style":
                state.dropped |= bool(_HIDDEN.search(value))
            elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                state.dropped = True
            elif key == "role":
                state.apart |= value.lower() in APART_ROLES
                if value.lower() in ("main", "article"):
                    state.article, state.around = 2, 0
            elif key == "itemprop":
                if value.lower() == "articlebody":
                    state.article, state.around = 2, 0
            elif tag not in ("html", "body", "main"):
                names = value.lower().split()
                pieces = {p.lower() for p in _PIECE.findall(value)}
                if tag == "article":
                    state.apart |= any(n.split("-")[0].split("_")[0] in COMMENT_NAMES for n in names)
                    continue
                state.apart |= bool(pieces & COMMENT_NAMES)
                named |= bool(pieces & AROUND_NAMES)
                if not named and outer.article == 0 and ARTICLE_NAMES.intersection(names):
                    state.article = 1
    if named and tag not in ("article", "main"):
        state.around = state.around or number
    return state, named


class _Blocks:
    """Gathers the text of a page into blocks."""

    def __init__(self):
        self.found: list[Block] = []
        self.stack: list[tuple[str, State]] = [("", State())]
        self.open: Counter = Counter()
        self.parts: list[str] = []
        self.links = self.link_depth = self.breaks = self.number = 0
        self.heading = self.named = self.hidden = False

    def text(self, raw: str, decode: bool = True) -> None:
        state = self.stack[-1][1]
        if not raw or state.dropped or self.hidden:
            return
        text = html.unescape(raw) if decode and "&" in raw else raw
        if not text.isspace():
            self.breaks = 0
            if self.link_depth:
                self.links += len("".join(text.split()))
        self.parts.append(text)

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.found.append(Block(text, self.links, self.heading, self.stack[-1][1], self.named))
        self.parts, self.links, self.breaks = [], 0, 0
        self.named = self.heading = self.hidden = False

    def start(self, tag: str, attributes: str) -> None:
        if tag in BOXES:
            self.flush()
            self.link_depth = 0
            if tag == "body" and self.open["head"]:
                self.end("head")
            self.number += 1
            self.stack.append((tag, _inside(tag, attributes, self.stack[-1][1], self.number)[0]))
            self.open[tag] += 1
        elif tag in BLOCKS:
            self.flush()
            self.link_depth = 0
            self.heading = tag in HEADINGS
            inner, self.named = _inside(tag, attributes, self.stack[-1][1], 0)
            self.hidden = inner.dropped
            self.named |= inner.apart
        elif tag == "a":
            self.link_depth = 1
        elif tag == "br":
            self.breaks += 1
            if self.breaks > 1:
                self.flush()
            else:
                self.parts.append(" ")
        elif tag in CELLS:
            self.parts.append(" ")

    def end(self, tag: str) -> None:
        if tag in BOXES:
            self.flush()
            if self.open[tag]:
                while True:
                    closed, _ = self.stack.pop()
                    self.open[closed] -= 1
                    if closed == tag:
                        break
        elif tag in BLOCKS:
            self.flush()
        elif tag == "a":
            self.link_depth = 0


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page that hold text, in order."""
    out, at = _Blocks(), 0
    while True:
        match = _TAG.search(page, at)
        if match is None:
            out.text(page[at:])
            break
        out.text(page[at : match.start()])
        at = match.end()
        if match["cdata"]:
            out.text(match["cdata"], decode=False)
        if not match["tag"]:
            continue
        tag = match["tag"].lower()
        if match["end"]:
            out.end(tag)
        elif tag in RAW:
            # The content of these is dropped as it stands, up to the end tag or the end of the page.
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            if end is None:
                break
            at = end.start()
        else:
            out.start(tag, match["attributes"])
    out.flush()
    return out.found


class _Words:
    """Stop words on a page; its language is the one with most of them, found when it is first needed."""

    def __init__(self, found: list[Block], stops: dict[str, int]):
        self.found, self.stops, self.bit = found, stops, None

    def language(self) -> int:
        """The bit of the language, 0 if no word is a stop word."""
        if self.bit is None:
            totals: Counter = Counter()
            for word, n in Counter(" ".join(b.text for b in self.found).lower().split()).items():
                if mask := self.stops.get(word) or self.stops.get(word.strip(_EDGE)):
                    totals[mask] += n
            bits = range(max(totals, default=0).bit_length())
            self.bit = 1 << max(bits, key=lambda b: (sum(n for m, n in totals.items() if m >> b & 1), -b)) if totals else 0
        return self.bit

    def density(self, block: Block) -> float:
        """The part of a block's words that are stop words of the language."""
        words, bit = block.text.lower().split(), self.language()
        return sum(1 for w in words if (self.stops.get(w) or self.stops.get(w.strip(_EDGE), 0)) & bit) / max(1, len(words))


def _solid(block: Block) -> int:
    """Characters without white space."""
    return len(block.text) - block.text.count(" ")


def _outside(found: list[Block]) -> list[bool]:
    """Which blocks stand in, or are, something that is none of the article."""
    marked = any(b.state.article == 2 and not b.state.apart and not b.own_around for b in found)
    size = Counter()
    total = 0
    for block in found:
        if not block.state.apart and not block.own_around:
            size[block.state.around] += _solid(block) - block.links
            total += _solid(block) - block.links
    # Names are no more than hints: what holds most of the page's text is not beside it.
    kept = set() if marked else {a for a, n in size.items() if a and n >= 500 and 2 * n > total}
    return [b.state.apart or b.own_around or (b.state.around > 0 and b.state.around not in kept) for b in found]


def _article(found: list[Block], outside: list[bool]) -> int:
    """How the article is marked: 2 by its element, 1 by a name, 0 not at all."""
    size = Counter()
    for block, out in zip(found, outside, strict=True):
        if not out:
            size[block.state.article] += _solid(block) - block.links
    if size[2] and 10 * size[2] > size[0] + size[1] - 1000:
        return 2
    return 1 if size[1] and 2 * size[1] > size[0] else 0


def labels(found: list[Block], stops: dict[str, int]) -> list[bool]:
    """For each block of a page whether it is main text."""
    words = _Words(found, stops)
    outside = _outside(found)
    article = _article(found, outside)
    first: list[bool | None] = []
    over = -1  # box in which the comments have begun
    for block, out in zip(found, outside, strict=True):
        if block.state.box != over:
            over = -1
        if block.heading and not article and _COMMENTS_HEADING.fullmatch(block.text):
            over = block.state.box
        inside = article > 0 and block.state.article >= article
        if out or over >= 0 or (article and not inside):
            first.append(False)
        else:
            first.append(_decide(block, inside, words))
    return _settled(found, first, article > 0)


def _decide(block: Block, inside: bool, words: _Words) -> bool | None:
    """What a block's links, length and words say, None if they leave it open. ``inside`` is the marked article."""
    size = len(block.text)
    links = block.links / max(1, _solid(block))
    if links > (LINKS_INSIDE if inside else LINKS):
        return False
    if not inside and size < LARGE and _NOTICE.search(block.text):
        return False
    if block.heading or size < SHORT:
        return None
    # Where the article is marked, only text with links in it must look like sentences; so must a language without a list.
    if (inside and not links) or not words.language():
        return True
    density = words.density(block)
    if density >= (SPARSE if inside or size >= LARGE else DENSE):
        return True
    return False if links or density < SPARSE / 2 else None


def _settled(found: list[Block], first: list[bool | None], article: bool) -> list[bool]:
    """Open blocks take the label of the nearest decided ones, those in the same box before others.

    Between unlike neighbours the nearer counts, of equally near ones the next for a heading and the one before for
    other blocks. Where the article is marked, only its own blocks are neighbours.
    """
    decided = [i for i, label in enumerate(first) if label is not None and (label or not article)]
    if not any(first):
        # No text of any length: what is left without being a menu or the like is all there is.
        return [label is None for label in first]
    out, k = [], 0
    for i, label in enumerate(first):
        while k < len(decided) and decided[k] <= i:
            k += 1
        if label is not None:
            out.append(label)
            continue
        near = []
        for side, at in ((1, k - 1), (0, k)):
            if 0 <= at < len(decided):
                j = decided[at]
                other = found[j].state.box != found[i].state.box
                near.append((other, abs(j - i), side if found[i].heading else 1 - side, first[j]))
        out.append(bool(min(near)[3]))
    return out


def extract(page: str | None, stops: dict[str, int]) -> str:
    """The main text of one page: its blocks in order, a line each."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, main in zip(found, labels(found, stops), strict=True) if main)


def stop_words(spark: SparkSession) -> dict[str, int]:
    """For each stop word of Spark's lists the bits of its languages."""
    out: dict[str, int] = {}
    for bit, language in enumerate(LANGUAGES):
        for word in StopWordsRemover.loadDefaultStopWords(language):
            out[word.lower()] = out.get(word.lower(), 0) | 1 << bit
    return out


def main_text(pages: DataFrame, column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The main text of every page: the ``keep`` columns, text and n_chars, its number of characters.

    Menus, page headers, footers, sidebars, notices, adverts, forms, readers' comments, scripts, styles and hidden parts go.
    Character references are decoded, white space within a block (also a line break) becomes one space, blocks are joined
    by line feeds. Null, empty and textless pages give an empty text. A page cut off anywhere is read up
    to there. Repeated rows are extracted each, other columns are left out, a table of no rows gives none.
    """
    stops = stop_words(small_batches(pages.sparkSession))
    names = [f"k{i}" for i in range(len(keep))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(column).cast("string").alias("page"))
    schema = rows.drop("page").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page.as_py(), stops) for page in batch.column("page")]
            found = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *found], schema.names)

    return rows.mapInArrow(run, schema).select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "text", "n_chars")
