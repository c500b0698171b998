"""Main-text extraction: parser events, text-to-tag ratio, Gaussian smoothing and threshold clustering.

The standard library's streaming parser turns a page into *blocks*, the
stretches of text between block-level tags, each with the path of containers
it lies in. A block's text-to-tag ratio is its number of characters outside
links over its number of tags. The ratios are smoothed over neighbouring
blocks with a Gaussian kernel and clustered by a threshold into content and
the rest. The content blocks decide on every page: the article elements, or else
main elements, that hold most of them, weighted by smoothed ratio and length, are
the region, those with little of it left out; without such, it is the smallest
sectioning container that holds all of them, never a paragraph, list, table part
or heading. Every block of the region is kept, however short, so that smoothing
only selects regions and never drops a line inside one. Containers that are
menus, headers, footers, sidebars, notices, adverts, forms, reader comments,
scripts or styles, by tag, role, or the words of their class or id, never belong
to a region; but inside an article, words alone silence a container only if the
clusters reject its text, too.

Defined cases: null or empty html gives an empty text; unclosed, misnested and
unknown tags are tolerated; a tag that the page's end cuts off is dropped with
what follows in it, as browsers do, so that pages of unclosed tags take linear
time; very long pages are read whole; a page without blocks gives an empty text;
repeated pages give equal texts; an empty table gives no rows; extra columns are
ignored, whatever their names. Memory follows the longest page. No shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from perkflow.llm.common import utf8

# Fixed values, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr img".split())
#: Containers whose text is never part of an article.
SILENT = frozenset("script style noscript template head title svg math iframe object canvas select option textarea "
                   "button datalist nav footer aside form menu dialog noframes audio video".split())
#: Of these, frames that some pages put around their article; their text is kept with a mark.
_FRAMES = frozenset("nav footer aside form".split())
#: Containers that can be a page's region, besides custom elements.
_SECTIONING = frozenset("html body main article section div center form".split())
#: Elements that end an open paragraph, list item, cell or heading.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CLOSED_BY = {"p": _ENDS_P, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
              "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
              "option": frozenset(["option"])}
_SILENT_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert "
                          "alertdialog toolbar".split())
#: Words of a class or id that name boilerplate.
_SILENT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs byline comment comments consent "
    "cookie cookies disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice "
    "notification outbrain overlay pager pagination popup promo promoted promotion recommended related responses "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola teaser toc toolbar "
    "widget widgets".split())
#: Of these, words of frames around readers' comments, which are often articles by tag.
_COMMENT_WORDS = frozenset("comment comments disqus responses".split())
#: Words that inside an article name the frame of its title.
_TITLE_WORDS = frozenset("banner header masthead".split())
_BEFORE_ARTICLE = ("head", "nav", "header", "menu", "title")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tags: int
    link_chars: int
    container: int                 # number of the innermost container, -1: none
    frame: int = -1                # number of the innermost container around it that looks like boilerplate


@dataclass
class _Open:
    tag: str
    number: int
    silent: bool
    frame: bool


@dataclass(frozen=True)
class Smoothing:
    """``sigma``: blocks; ``share``: the threshold, as a share of the ratios' mean.

    ``beside``: an article's weight, as a share of the heaviest one's, from
    which it belongs to the region with that one.
    """
    sigma: float = 1.5
    share: float = 0.5
    beside: float = 0.25


class Blocks(HTMLParser):
    """Collects the blocks of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[_Open] = []
        self.kinds: list[str] = []      # tag of each container number
        self.parents: list[int] = []    # number of the container around it, always smaller
        self.depth_of: Counter[str] = Counter()  # open containers by tag
        self.pieces: list[str] = []
        self.frame = -1                    # the innermost open container that looks like boilerplate
        self.frames: dict[int, int] = {}   # all of these, with the one around each
        self.comments: set[int] = set()    # numbers of frames around readers' comments
        self.in_article: set[int] = set()  # numbers of frames that lie in an article
        self.named: set[int] = set()       # of these, those that only the words of their class or id make frames
        self.tags = self.link_chars = self.links = self.n_silent = 0

    def _flush(self) -> None:
        if self.pieces:
            text = _SPACE.sub(" ", "".join(self.pieces)).strip()
            if text:
                self.blocks.append(Block(text, max(1, self.tags), self.link_chars, self._around(), self.frame))
            self.pieces = []
        self.tags = self.link_chars = 0

    def _around(self) -> int:
        return self.open[-1].number if self.open else -1

    def _pop_to(self, depth: int) -> None:
        while len(self.open) > depth:
            gone = self.open.pop()
            self.n_silent -= gone.silent
            if gone.frame:
                self.frame = self.frames[gone.number]
            self.depth_of[gone.tag] -= 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.pieces.append(" ")
            return
        self._flush()
        self.links = 0
        if tag in ("article", "main"):  # an unclosed menu or header does not swallow the article
            if any(self.depth_of[t] for t in _BEFORE_ARTICLE):
                self._pop_to(next(i for i, o in enumerate(self.open) if o.tag in _BEFORE_ARTICLE))
        for depth in range(len(self.open) - 1, max(-1, len(self.open) - 4), -1):
            if tag in _CLOSED_BY.get(self.open[depth].tag, ()):
                self._pop_to(depth)
                break
            if self.open[depth].tag in ("ul", "ol", "table", "div", "article", "section"):
                break
        if tag == "body" and self.depth_of["head"]:
            self._pop_to(next(i for i, o in enumerate(self.open) if o.tag == "head"))
        if tag not in VOID:
            number, reason = len(self.kinds), self._is_silent(tag, attrs)
            looks_silent = bool(reason)
            silent = looks_silent and tag in SILENT - _FRAMES
            frame = looks_silent and not silent
            if frame:
                self.frames[number] = self.frame
                self.frame = number
                if any(k in ("class", "id") and _words(v) & _COMMENT_WORDS for k, v in attrs):
                    self.comments.add(number)
                if self.depth_of["article"] or self.depth_of["main"]:
                    self.in_article.add(number)
                    if reason == "words" and number not in self.comments:
                        self.named.add(number)
            self.parents.append(self._around())
            self.open.append(_Open(tag, number, silent, frame))
            self.kinds.append(tag)
            self.depth_of[tag] += 1
            self.n_silent += silent

    def _is_silent(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """What makes the container look like boilerplate: its "tag", a "mark" or its "words"; else empty."""
        if tag in SILENT:
            return "tag"
        inside = self.depth_of["article"] or self.depth_of["main"]
        if tag == "header":             # an article's own header holds its title
            return "" if inside else "tag"
        if tag in ("html", "body", "main", "article"):
            return "mark" if any(k == "class" and "comment" in _words(v) for k, v in attrs) else ""
        found = ""
        for key, value in attrs:
            if key == "role" and (value or "").strip().lower() in _SILENT_ROLES:
                return "mark"
            if key == "hidden" or key == "aria-hidden" and (value or "").strip().lower() == "true":
                return "mark"
            if key in ("class", "id") and value:
                named = _words(value) & _SILENT_WORDS
                if named - _TITLE_WORDS if inside else named:
                    found = "words"
        return found

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in INLINE:
            if tag == "a":
                self.links = max(0, self.links - 1)
            elif tag == "br":
                self.pieces.append(" ")
            return
        self._flush()
        self.links = 0
        if self.depth_of[tag]:
            self._pop_to(next(i for i in range(len(self.open) - 1, -1, -1) if self.open[i].tag == tag))

    def handle_data(self, data: str) -> None:
        if self.n_silent:
            return
        self.pieces.append(data)
        if self.links:
            self.link_chars += len(data)

    def close(self) -> None:
        super().close()
        self._flush()


def _words(value: str | None) -> set[str]:
    return set(_WORDS.findall(_CAMEL.sub(" ", value or "").lower()))


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing with weights renormalised at the borders."""
    reach = int(3 * sigma) + 1
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return (np.convolve(ratios, kernel, "full")[reach:reach + len(ratios)]
            / np.convolve(np.ones(len(ratios)), kernel, "full")[reach:reach + len(ratios)])


_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")


def _whole_tags(html: str) -> str:
    """The page without a tag that its end cuts off."""
    found = _UNFINISHED.search(html, html.rfind(">") + 1)
    return html[:found.start()] if found else html


def _ratios(blocks: list[Block]) -> np.ndarray:
    return np.array([(len(b.text) - min(b.link_chars, len(b.text))) / b.tags for b in blocks])


def _linked(blocks: list[Block]) -> np.ndarray:
    """Blocks that are mostly links: smoothing makes no content of them."""
    return np.array([2 * b.link_chars >= len(b.text) for b in blocks])


def _like_the_story(parser: Blocks, how: Smoothing = Smoothing()) -> set[int]:
    """Frames in an article, by their words alone, most of whose text the clusters count as content.

    A block of such a frame must reach the threshold by its own ratio, as its
    neighbours' say little about it; what is in no frame sets the threshold.
    """
    blocks = parser.blocks
    ratios, free = _ratios(blocks), np.array([b.frame < 0 for b in blocks])
    if not free.any():
        return set()
    threshold = how.share * smoothed(ratios[free], how.sigma).mean()
    content = (ratios >= threshold) & ~_linked(blocks)
    total: Counter[int] = Counter()
    good: Counter[int] = Counter()
    for b, c in zip(blocks, content):
        if b.frame in parser.named:
            total[b.frame] += len(b.text)
            good[b.frame] += len(b.text) * bool(c)
    return {f for f in total if 2 * good[f] > total[f]}


def _heard(parser: Blocks) -> list[Block]:
    """The blocks that lie in no frame, or only in frames that hold the page's article.

    A frame is pardoned when it holds nearly all text of the page, or an article
    or main element with more text than those outside it; frames inside an
    article, and those of readers' comments, only for the former.
    """
    blocks, kinds, parents, frames = parser.blocks, parser.kinds, parser.parents, parser.frames
    if all(b.frame < 0 for b in blocks):
        return blocks
    around = [-1] * (len(kinds) + 1)    # outermost article or main around each container; the last one: none
    for n, parent in enumerate(parents):
        outer = around[parent] if parent >= 0 else -1
        around[n] = outer if outer >= 0 else n if kinds[n] in ("article", "main") else -1
    text: Counter[int] = Counter()      # characters in each frame, at -1 on the page
    told: Counter[int] = Counter()      # of these, in articles and in no frame within them
    for b in blocks:
        text[b.frame] += len(b.text)
        if b.frame < around[b.container]:
            told[b.frame] += len(b.text)
    for f in reversed(frames):          # the frame around another one has a smaller number
        text[frames[f]] += text[f]
        told[frames[f]] += told[f]
    heard, apart = {-1: True}, parser.comments | parser.in_article
    taken = _like_the_story(parser) if parser.named else set()
    for f, outer in frames.items():
        if f in taken:
            heard[f] = heard[outer]
            continue
        holds = f not in apart and 2 * told[f] > told[-1]
        heard[f] = heard[outer] and (holds or text[f] >= 0.9 * text[-1])
    return [b for b in blocks if heard[b.frame]] or blocks


def main_text(html: str, how: Smoothing = Smoothing()) -> str:
    parser = Blocks()
    parser.feed(_whole_tags(html))
    parser.close()
    parser.blocks = blocks = _heard(parser)
    if not blocks:
        return ""
    ratios = _ratios(blocks)
    smooth = smoothed(ratios, how.sigma)
    content = (smooth >= how.share * smooth.mean()) & (ratios > 0) & ~_linked(blocks)
    if not content.any():
        content[:] = True
    chosen = _region(parser, smooth, content, how.beside)
    inside = np.zeros(len(parser.kinds) + 1, bool)  # the last one: text outside all containers
    inside[-1] = not chosen
    for number, parent in enumerate(parser.parents):
        inside[number] = not chosen or number in chosen or (parent >= 0 and inside[parent])
    return "\n".join(b.text for b in blocks if inside[b.container])


def _region(parser: Blocks, smooth: np.ndarray, content: np.ndarray, beside: float) -> set[int]:
    """The containers that hold the article; none: the whole page."""
    kinds, parents = parser.kinds, parser.parents
    weight = np.zeros(len(kinds))
    for b, s, is_content in zip(parser.blocks, smooth, content):
        if is_content and b.container >= 0:
            weight[b.container] += s * len(b.text)
    for number in range(len(kinds) - 1, 0, -1):
        if parents[number] >= 0:
            weight[parents[number]] += weight[number]
    total = sum(s * len(b.text) for b, s, c in zip(parser.blocks, smooth, content) if c)
    for kind in ("article", "main"):
        within = np.zeros(len(kinds) + 1, bool)     # in an element of this kind; the last one: no container
        outer = []
        for n, parent in enumerate(parents):
            within[n] = within[parent] or kinds[n] == kind
            if kinds[n] == kind and not within[parent]:
                outer.append(n)
        most = max((weight[n] for n in outer), default=0)
        own = {n for n in outer if weight[n] >= beside * most}
        if 2 * sum(weight[n] for n in own) > total:
            return own
    # none of these holds most of the content: the smallest sectioning container with all of it
    held = np.zeros(len(kinds) + 1, np.int64)   # content blocks; the last one: text outside all containers
    for b, is_content in zip(parser.blocks, content):
        held[b.container] += is_content
    for number in range(len(kinds) - 1, 0, -1):
        held[parents[number]] += held[number]
    whole = np.flatnonzero(held[:-1] == content.sum())
    return set([n for n in whole.tolist() if kinds[n] in _SECTIONING or "-" in kinds[n]][-1:])


def text_column(html: str | Column, how: Smoothing = Smoothing()) -> Column:
    """The pages' main texts."""
    @F.arrow_udf("string")
    def main_texts(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py().decode("utf-8", "replace"), how) for p in pages], pa.string())

    return main_texts(utf8(html))
