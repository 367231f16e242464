"""Main text of HTML pages by tag-path ratios."""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")
_WORDS = re.compile(r"[a-z]+")
#: Marks of an element: none, one by its name or role, one by words of its class or id or by being a form.
_NONE, _HARD, _SOFT = 0, 1, 2
#: A soft mark is void where it would leave less than this part of what it takes away.
_LEAST_LEFT = 1 / 20

#: Fixed values of HTML: elements whose content is raw text, elements without content, and elements that don't break a line.
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes svg math".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr ruby rb rt rp".split())
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body".split())

#: What is no article: by element, by role, and by the words of class and id.
_AWAY = frozenset("nav header footer aside button select dialog menu head object canvas audio video".split())
_AWAY_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_AWAY_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer header masthead comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations pagination pager toolbar widget "
    "widgets form search skip".split()
)
#: What a word of class or id may be joined to and still mean the part itself, and what before it means anything but that part.
_PART_WORDS = frozenset("list box block wrap wrapper container area section bar button buttons link links slot unit left right top bottom inner outer item items panel group row column thread form icons holder content text".split())
_NOT_WORDS = frozenset("no not non without with has have is hide".split())
_MAIN = frozenset("article main".split())
#: Words of class and id by which even an article is none.
_MAIN_AWAY_WORDS = frozenset("comment comments reply ad ads advert related".split())


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    parent: int
    mark: int
    link: bool
    away: bool = False


@dataclass
class Page:
    """Elements in page order, text pieces as (element, block, text), and tag paths by number as (path around, tag).

    What is marked as menu, form, advert or the like has paths of its own.
    """

    elements: list[Element] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)
    paths: list[tuple[int, str]] = field(default_factory=list)


def _names(value: str, words: frozenset[str]) -> bool:
    """Whether a class or id names one of ``words``: as a whole, as the last word of a compound that says what it is, or as the first of one that says which part of it."""
    for token in value.split():
        parts = _WORDS.findall(token)
        if parts and parts[-1] in words and _NOT_WORDS.isdisjoint(parts[:-1]):
            return True
        if len(parts) > 1 and parts[0] in words and _PART_WORDS.issuperset(parts[1:]):
            return True
    return False


def _mark(tag: str, attributes: str) -> int:
    if tag in _AWAY:
        return _HARD
    found = _SOFT if tag == "form" else _NONE
    if not attributes.strip():
        return found
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "role" and value.strip() in _AWAY_ROLES:
            return _HARD
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return _HARD
        if name in ("class", "id") and tag not in ("body", "html") and _names(value, _MAIN_AWAY_WORDS if tag in _MAIN else _AWAY_WORDS):
            found = _SOFT
    return found


class Stack:
    """Open elements, with the places of those that a later start tag may close, by scope; no step looks at more than it takes off."""

    def __init__(self) -> None:
        self.open: list[tuple[int, str]] = [(0, "")]
        self.count: dict[str, int] = {}
        self.scopes: list[tuple[int, dict[str, int]]] = [(0, {})]

    def push(self, element: int, tag: str) -> None:
        place = len(self.open)
        self.open.append((element, tag))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag == "p" or tag in _CLOSED_BY:
            self.scopes[-1][1].setdefault(tag, place)
        if tag in _SCOPES:
            self.scopes.append((place, {}))

    def cut(self, place: int) -> None:
        """Closes all from ``place`` on."""
        for _, tag in self.open[place:]:
            self.count[tag] -= 1
        del self.open[place:]
        while self.scopes[-1][0] >= place:
            self.scopes.pop()
        own = self.scopes[-1][1]
        for tag in [t for t, k in own.items() if k >= place]:
            del own[tag]

    def end(self, tag: str) -> None:
        if self.count.get(tag):
            place = len(self.open) - 1
            while self.open[place][1] != tag:
                place -= 1
            self.cut(place)

    def start(self, tag: str) -> None:
        """Closes what the start of a block ``tag`` implies to be over."""
        own = self.scopes[-1][1]
        places = [own[t] for t in ("p", *_CLOSED_BY.get(tag, ())) if t in own]
        if places:
            self.cut(min(places))


def _tag_end(source: str, at: int, quotes: dict[str, bool]) -> int:
    """The place of the ``>`` that ends a tag, beyond its quoted values; -1 if the page ends in it. ``quotes`` knows of quotes that have no other one after them."""
    while True:
        end = source.find(">", at)
        if end < 0:
            return -1
        first = min((k for q in quotes if quotes[q] and (k := source.find(q, at, end)) >= 0), default=-1)
        if first < 0:
            return end
        close = source.find(source[first], first + 1)
        if close < 0:
            quotes[source[first]] = False
        else:
            at = close + 1


def parse(source: str) -> Page:
    """Elements and text of a page, in time that grows with its length.

    Tags left open are closed as HTML has it for paragraphs, list items and table cells. A tag or comment that the
    page ends in is no text; a quote without a second one is ignored.
    """
    page = Page([Element("", 0, -1, _NONE, False)], [], [(-1, "")])
    stack, block, at, quotes = Stack(), 0, 0, {'"': True, "'": True}

    def text(raw: str) -> None:
        if raw:
            page.pieces.append((stack.open[-1][0], block, html.unescape(raw)))

    begin = 0
    while True:
        at = source.find("<", at)
        if at < 0:
            text(source[begin:])
            return page
        if source.startswith(("<!", "<?"), at):
            text(source[begin:at])
            end = "-->" if source.startswith("<!--", at) else "]]>" if source.startswith("<![CDATA[", at) else ">"
            close = source.find(end, at + 2)
            if close < 0:
                return page
            begin = at = close + len(end)
            continue
        m = _NAME.match(source, at + 1)
        if not m:
            at += 1
            continue
        text(source[begin:at])
        close = _tag_end(source, m.end(), quotes)
        if close < 0:
            return page
        tag, attributes = m[0].lower(), source[m.end() : close]
        begin = at = close + 1
        if tag[0] == "/":
            if tag[1:] not in _INLINE:
                block += 1
            stack.end(tag[1:])
        elif tag == "br":
            page.pieces.append((stack.open[-1][0], block, " "))
        elif tag in _VOID:
            block += tag not in _INLINE
        elif tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            begin = at = end.end() if end else len(source)
            block += 1
        else:
            if tag not in _INLINE:
                block += 1
                stack.start(tag)
            up = stack.open[-1][0]
            e = page.elements[up]
            page.elements.append(Element(tag, 0, up, _mark(tag, attributes), e.link or tag == "a"))
            if not attributes.endswith("/"):
                stack.push(len(page.elements) - 1, tag)


def settle(page: Page) -> None:
    """Tells for each element whether it is away, and numbers the paths.

    A name or role always counts, and so does a soft mark, unless next to nothing would be left of the page without
    what it marks: then it is the wrapper of the article, and the marks within it are judged in its place. The largest
    go first, until one is found to leave enough.
    """
    elements = page.elements
    own, hard = [0] * len(elements), [False] * len(elements)
    #: The nearest soft mark around each element, or the root; what each soft mark has within it next.
    soft, within = [0] * len(elements), {0: []}
    for k, e in enumerate(elements):
        if k:
            hard[k] = hard[e.parent] or e.mark == _HARD
            soft[k] = e.parent if elements[e.parent].mark == _SOFT else soft[e.parent]
            if e.mark == _SOFT and not hard[k]:
                within[k] = []
                within[soft[k]].append(k)
    for element, _, text in page.pieces:
        if not hard[element] and not elements[element].link:
            own[element] += len(text.strip())
    free = {k: 0 for k in within}
    for k, size in enumerate(own):
        if not hard[k]:
            free[k if k in within else soft[k]] += size
    _up(page, own)
    left, void, ahead = free[0], {0}, [(-own[k], k) for k in within[0]]
    heapq.heapify(ahead)
    while ahead and left < -ahead[0][0] * _LEAST_LEFT:
        _, k = heapq.heappop(ahead)
        void.add(k)
        left += free[k]
        for x in within[k]:
            heapq.heappush(ahead, (-own[x], x))
    numbers: dict[tuple[int, str, bool], int] = {}
    for k, e in enumerate(elements[1:], 1):
        up = elements[e.parent]
        e.away = up.away or e.mark == _HARD or (e.mark == _SOFT and k not in void)
        e.path = numbers.setdefault((up.path, e.tag, e.away), len(page.paths))
        if e.path == len(page.paths):
            page.paths.append((up.path, e.tag))


def path_ratios(page: Page) -> dict[int, float]:
    """A score for each path from the root to a text.

    Length per text times marks per text, the less the more of it is links, is smoothed over the paths that stand next
    to it in the page and fused with what it was before smoothing. What is marked as menu, form, advert or the like
    counts nothing.
    """
    length: dict[int, float] = {}
    marks: dict[int, float] = {}
    links: dict[int, float] = {}
    nodes: dict[int, set[tuple[int, int]]] = {}
    for element, block, text in page.pieces:
        e = page.elements[element]
        size = len(text.strip())
        if size:
            weight = 0.0 if e.away else 1.0
            length[e.path] = length.get(e.path, 0) + size * weight
            marks[e.path] = marks.get(e.path, 0) + len(_PUNCTUATION.findall(text)) * weight
            links[e.path] = links.get(e.path, 0) + size * weight * e.link
            nodes.setdefault(e.path, set()).add((element, block))
    paths = list(length)
    if not paths:
        return {}
    raw = np.array([length[p] / len(nodes[p]) * (1 + marks[p] / len(nodes[p])) * (1 - 0.9 * links[p] / (length[p] or 1)) for p in paths])
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(raw)), kernel)[2:-2]
    smooth = np.convolve(raw, kernel)[2:-2] / weight
    return dict(zip(paths, np.sqrt(raw * smooth), strict=True))


def _up(page: Page, *sums: list) -> None:
    """Adds each element's numbers to those of the elements around it."""
    for k in range(len(page.elements) - 1, 0, -1):
        for own in sums:
            own[page.elements[k].parent] += own[k]


def _menus(page: Page) -> set[int]:
    """Lists of three texts or more that consist of links alone."""
    texts, linked = [0] * len(page.elements), [0] * len(page.elements)
    for element, _, text in page.pieces:
        if text.strip():
            texts[element] += 1
            linked[element] += page.elements[element].link
    _up(page, texts, linked)
    return {k for k, e in enumerate(page.elements) if e.tag in ("ul", "ol") and texts[k] >= 3 and texts[k] == linked[k]}


def main_text(source: str | None) -> str:
    """The article of a page: its blocks in page order, white space collapsed, joined by a space.

    Paths score by ``path_ratios``; the texts on those at or above half a standard deviation (or the best one) are
    content. The article is the lowest element that covers all content, and what stands around it (``_around``). If
    elements named article or main hold half of the content or more, it is those of them that hold any. All its
    content belongs to it, and its other texts but for those marked as menus, forms, adverts and the like, lists of
    links, and, where no element is named, blocks that consist of links alone.
    """
    if not source:
        return ""
    page = parse(source)
    settle(page)
    scores = path_ratios(page)
    values = np.array(list(scores.values()))
    if not len(values) or values.max() <= 0:
        return ""
    limit = min(values.max(), 0.5 * values.std() or values.max())
    best, menus = {p for p, x in scores.items() if x >= limit}, _menus(page)
    marked = [e.away for e in page.elements]
    for k, e in enumerate(page.elements):
        marked[k] = marked[k] or k in menus or (e.parent >= 0 and marked[e.parent])
    dropped = [own and e.path not in best for own, e in zip(marked, page.elements, strict=True)]
    held = [0] * len(page.elements)
    for element, _, text in page.pieces:
        if page.elements[element].path in best:
            held[element] += len(text.strip())
    _up(page, held)
    named = {k for k, e in enumerate(page.elements) if e.tag in _MAIN and not e.away and held[k]}
    nested = _inside(page, named, below=True)
    linked: set[int] = set()
    if named and 2 * sum(held[k] for k in named if not nested[k]) >= held[0]:
        inside = _inside(page, named)
    else:
        inside = _inside(page, {_around(page, _lowest(page, held), dropped)})
        words = {block for element, block, text in page.pieces if text.strip() and not (page.elements[element].link and page.elements[element].path not in best)}
        linked = {block for _, block, _ in page.pieces} - words
    blocks: dict[int, list[str]] = {}
    for element, block, text in page.pieces:
        if inside[element] and not dropped[element] and block not in linked:
            blocks.setdefault(block, []).append(text)
    joined = (" ".join("".join(own).split()) for own in blocks.values())
    return " ".join(x for x in joined if x)


def _lowest(page: Page, held: list[int]) -> int:
    """The lowest element that holds all of ``held``; of those around each other the last."""
    return max(k for k, x in enumerate(held) if x == held[0])


def _inside(page: Page, tops: set[int], below: bool = False) -> list[bool]:
    """Which elements are in one of ``tops``, itself counted unless ``below``."""
    inside = [False] * len(page.elements)
    for k, e in enumerate(page.elements):
        inside[k] = (k in tops and not below) or (e.parent >= 0 and (inside[e.parent] or (below and e.parent in tops)))
    return inside


def _around(page: Page, top: int, dropped: list[bool]) -> int:
    """The element around ``top`` that holds the leads, headings, lists and captions beside it.

    It goes up as long as what an element adds isn't mostly links; up to the body only for a heading beside it.
    """
    words, links, heads = ([0] * len(page.elements) for _ in range(3))
    headed = [False] * len(page.paths)
    for k, (up, tag) in enumerate(page.paths):
        headed[k] = tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (up >= 0 and headed[up])
    for element, _, text in page.pieces:
        e = page.elements[element]
        if not dropped[element] and (size := len(text.strip())):
            words[element] += size
            links[element] += size * e.link
            heads[element] += size * headed[e.path]
    _up(page, words, links, heads)
    while (up := page.elements[top].parent) > 0 and page.elements[up].tag != "html":
        added = words[up] - words[top]
        if 2 * (links[up] - links[top]) > added or (page.elements[up].tag == "body" and added and heads[up] == heads[top]):
            break
        top = up
    return top


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html; other columns are ignored).

    A null or empty html, and a page without any text outside menus, forms and the like, gives an empty text.
    Repeated rows each get their text. Rows are independent: nothing is shuffled, and pages are never cut.
    """
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return slim.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
