"""Main text of web pages by text-to-tag ratio over streaming parser events."""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.markup import VOID, Open, TotalParser

#: Elements that end a line of text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Elements whose text is never part of an article.
NEVER = frozenset("script style noscript template head title nav footer aside form button select textarea iframe object svg canvas dialog menu option label".split())
#: Roles whose elements are never part of an article.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: Words of class or id that mark page furniture, and among them those of reader comments.
REMARKS = frozenset("comment comments commentlist discussion disqus replies reply respond".split())
FURNITURE = REMARKS | frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs complementary consent contentinfo cookie cookies footer gdpr hidden masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager paginate pagination paywall popup promo promotion related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words before or after a furniture word that make a class name speak of the layout around it.
LAYOUT_BEFORE = frozenset("has have no not with without is js overflow hide show enable disable".split())
LAYOUT_AFTER = frozenset("open closed enabled disabled on off left right none visible".split())
HEADERS = frozenset(["header", "topbar"])
ARTICLES = frozenset(["article", "main"])
#: A new one of these ends an open one of the same name.
REPEATS = frozenset("li dt dd td th tr option".split())
#: Open elements beyond which nothing is ended by a new block.
BARRIERS = ("ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td")
#: Words of a line that tells prose from captions, buttons and bylines.
WORDS = 10
#: Elements that are no region of their own.
SMALL = frozenset("p li b h1 h2 h3 h4 h5 h6 td tr span blockquote pre".split())


def marks(value: str) -> set[str]:
    """Furniture and header words of a class or id attribute.

    Each name is split at hyphens and changes of case. A name with a word of LAYOUT_BEFORE
    before or of LAYOUT_AFTER behind it (has-sidebar, comments-open) says nothing.
    """
    found = set()
    for name in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        if len(words) > 1 and (words[0] in LAYOUT_BEFORE or words[-1] in LAYOUT_AFTER):
            continue
        found.update(w for w in words if w in FURNITURE or w in HEADERS)
    return found


@dataclass
class Line:
    text: str
    tags: int
    inside: int
    heading: bool
    links: int
    linked: int


@dataclass
class Box:
    """An element that may hold lines; its descendants' numbers run up to ``last``."""

    tag: str
    parent: int
    hard: bool
    article: bool
    mark: str = ""
    last: int = 0
    titled: bool = False
    name: str = ""


class _Events(TotalParser):
    """Parser events to lines of text with their tag counts and innermost box."""

    def __init__(self):
        super().__init__()
        self.open = Open()
        self.numbers: list[int] = []
        self.boxes = [Box("", 0, False, False)]
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags = self.links = self.linked = self.hard = self.inline = self.articles = 0
        self.in_link = False

    def _end_line(self):
        text = " ".join("".join(self.parts).split())
        if text and not self.hard:
            inside = self.numbers[-1] if self.numbers else 0
            self.lines.append(Line(text, max(1, self.tags), inside, self.boxes[inside].tag in ("h1", "h2", "h3"), self.links, self.linked))
        self.parts, self.tags, self.links, self.linked, self.in_link = [], 0, 0, 0, False

    def _forget(self, number: int):
        box = self.boxes[number]
        box.last = len(self.boxes) - 1
        self.hard -= box.hard
        self.inline -= box.hard and box.tag not in BLOCKS
        self.articles -= box.article

    def _cut(self, depth: int):
        """Close every element from a depth on."""
        while len(self.numbers) > depth:
            if self.open.names[-1] is not None:
                self._forget(self.numbers[-1])
            self.open.pop()
            self.numbers.pop()

    def _kind(self, tag: str, attrs) -> tuple[bool, str, str]:
        """Whether an element is never content, the kind of its mark (remark, furniture or none) and its name."""
        if tag in NEVER or tag == "header" and not self.articles:
            return True, "", ""
        mark = name_of = ""
        for name, value in attrs:
            value = value or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
                return True, "", ""
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return True, "", ""
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                found = marks(value)
                if tag == "article":
                    found &= {"comment", "ad", "advert", "advertisement", "related", "promo"}
                if found & REMARKS:
                    mark = "remark"
                elif found & FURNITURE or found & HEADERS and not self.articles:
                    mark, name_of = mark or "furniture", value
        return False, mark, name_of

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag == "a":
            self.in_link = True
            self.links += 1
        if tag in BLOCKS:
            self._end_line()
            ended = []
            if self.open.at.get("p") or tag in REPEATS and self.open.at.get(tag):
                barrier = max(self.open.last(b) for b in BARRIERS if b != tag or tag not in REPEATS)
                ended = [d for name in ({"p", tag} if tag in REPEATS else {"p"}) if (d := self.open.first_after(name, barrier)) is not None]
            if ended:
                self._cut(min(ended))
            if tag in ARTICLES:  # a menu or page header that was not closed ends here
                ended = [d for name in ("nav", "header", "head") if (d := self.open.first_after(name, -1)) is not None]
                if ended:
                    self._cut(min(ended))
            if tag == "hr":
                return
        elif tag not in NEVER and not any(n in ("class", "id", "role", "hidden", "style", "aria-hidden") for n, _ in attrs):
            return
        hard, mark, name = self._kind(tag, attrs)
        if hard and tag not in BLOCKS:
            self.parts.append(" ")
        parent = self.numbers[-1] if self.numbers else 0
        box = Box(tag, parent, hard, tag in ARTICLES and not hard and not mark, mark, name=name)
        self.numbers.append(len(self.boxes))
        self.boxes.append(box)
        self.open.push(tag)
        self.hard += hard
        self.inline += hard and tag not in BLOCKS
        self.articles += box.article

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "a":
            self.in_link = False
        depth = self.open.last(tag)
        if tag in BLOCKS:
            self._end_line()
            if depth >= 0:
                self._cut(depth)
        elif depth >= 0:
            self.open.blank(tag)
            self._forget(self.numbers[depth])
            while self.numbers and self.open.names[-1] is None:
                self.open.pop()
                self.numbers.pop()

    def handle_data(self, data):
        if not self.inline:
            self.parts.append(data)
            if self.in_link:
                self.linked += len(data.strip())

    def finish(self) -> tuple[list[Line], list[Box]]:
        self._end_line()
        self._cut(0)
        self.boxes[0].last = len(self.boxes) - 1
        return self.lines, self.boxes


def smoothed(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing over neighbouring lines; the kernel is renormalised at the ends."""
    radius = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        pairs = [(k, values[j]) for k, j in zip(kernel, range(i - radius, i + radius + 1), strict=True) if 0 <= j < len(values)]
        out.append(sum(k * v for k, v in pairs) / sum(k for k, _ in pairs))
    return out


def threshold(values: list[float]) -> float:
    """Border of two clusters on the line (two-means, one centre starting at 0)."""
    low, high = 0.0, max(values, default=0.0)
    for _ in range(50):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        new = (sum(below) / len(below) if below else low, sum(above) / len(above) if above else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def _within(boxes: list[Box], box: int, number: int) -> bool:
    return box <= number <= boxes[box].last


def _weights(boxes: list[Box], lines: list[Line], values: list[int]) -> list[int]:
    """Sums of the lines' values in every box, those of its descendants included."""
    weight = [0] * len(boxes)
    for line, value in zip(lines, values, strict=True):
        weight[line.inside] += value
    for number in range(len(boxes) - 1, 0, -1):  # a box comes after its parent
        weight[boxes[number].parent] += weight[number]
    return weight


def _prose(line: Line) -> int:
    """Characters of a line that are neither a heading's nor a link's."""
    return 0 if line.heading else max(0, len(line.text) - line.linked)


def _marked_off(boxes: list[Box], marks_of: Callable[[int, Box], bool]) -> list[bool]:
    """Boxes that marks_of picks, with all that lies in them."""
    out = [False] * len(boxes)
    for number, box in enumerate(boxes):
        out[number] = out[box.parent] or marks_of(number, box)
    return out


def unmarked(lines: list[Line], boxes: list[Box]) -> list[Line]:
    """Lines outside boxes whose mark counts; words of a class never outweigh the text itself.

    A box counts if an article or main element beside it, in no marked box itself, has text
    other than headings and links. Else one of reader comments counts if there is a line of
    prose (WORDS words, no heading, less than half of it links) outside of all such boxes, and
    one of furniture unless it, or a box of the same name, holds half of the page's prose
    (comments apart) or more. No mark
    counts on a box with a first heading or a main element in it, nor furniture's where no
    prose would be left.
    """
    prose = [_prose(x) for x in lines]
    for line in lines:
        if boxes[line.inside].tag == "h1":
            boxes[line.inside].titled = True
    for number in range(len(boxes) - 1, 0, -1):
        box = boxes[number]
        boxes[box.parent].titled |= box.titled or box.tag == "main" and not box.hard

    marked = _marked_off(boxes, lambda _, box: bool(box.mark))
    own = _weights(boxes, lines, [p * (not marked[x.inside]) for x, p in zip(lines, prose, strict=True)])
    articles = [n for n, box in enumerate(boxes) if box.article and own[n]]
    beside = lambda number: any(not _within(boxes, n, number) for n in articles[:1] + articles[-1:])

    remarks = _marked_off(boxes, lambda _, box: box.mark == "remark" and not box.titled)
    if not any(2 * p > len(x.text) and len(x.text.split()) >= WORDS and not remarks[x.inside] for x, p in zip(lines, prose, strict=True)):
        remarks = _marked_off(boxes, lambda n, box: box.mark == "remark" and not box.titled and beside(n))
    weight = _weights(boxes, lines, [p * (not remarks[x.inside]) for x, p in zip(lines, prose, strict=True)])
    main = {box.name for n, box in enumerate(boxes) if box.mark == "furniture" and weight[n] and 2 * weight[n] >= weight[0]}
    out = _marked_off(boxes, lambda n, box: remarks[n] or box.mark == "furniture" and not box.titled and (box.name not in main or beside(n)))
    left = [x for x in lines if not out[x.inside]]
    return left if any(map(_prose, left)) or not any(prose) else [x for x in lines if not remarks[x.inside]]


def without_link_lists(lines: list[Line], content: list[bool]) -> list[Line]:
    """Lines but for lists of links: lines below the threshold of which half or more is
    links, if there are two links in the line or such a line next to it."""
    is_link = [2 * x.linked >= len(x.text) and not c and not x.heading for x, c in zip(lines, content, strict=True)]
    near = lambda i: 0 < i and is_link[i - 1] or i + 1 < len(lines) and is_link[i + 1]
    return [x for i, x in enumerate(lines) if not (is_link[i] and (x.links > 1 or near(i)))]


def extract_text(html: str | None) -> str:
    """Main text of one page; see extract_pages."""
    events = _Events()
    events.read(html)
    found, boxes = events.finish()
    lines = unmarked(found, boxes)
    if not lines:
        return ""
    ratio = smoothed([len(x.text) / x.tags for x in lines])
    cut = threshold(ratio)
    content = [r >= cut for r in ratio]
    weight = _weights(boxes, lines, [len(x.text) * c for x, c in zip(lines, content, strict=True)])
    total = weight[0]
    region = max((n for n in range(1, len(boxes)) if weight[n] >= 0.8 * total and boxes[n].tag not in SMALL), default=0)
    article = max((n for n in range(1, len(boxes)) if boxes[n].article and 2 * weight[n] >= total), key=lambda n: (weight[n], -n), default=0)
    if article:  # its own first and last lines are the borders, however short
        region, chosen = article, [i for i, x in enumerate(lines) if _within(boxes, article, x.inside)]
    else:
        inside = [i for i, x in enumerate(lines) if content[i] and _within(boxes, region, x.inside)]
        first, last = min(inside), max(inside)
        while first and lines[first - 1].heading:
            first -= 1
        chosen = [i for i in range(first, last + 1) if _within(boxes, region, lines[i].inside) or lines[i].heading]
    return "\n\n".join(x.text for x in without_link_lists([lines[i] for i in chosen], [content[i] for i in chosen]))


def extract_pages(pages: DataFrame, row_id: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page, from its whole html.

    Parser events of the standard library become lines (block elements) with their
    count of tags. Text-to-tag ratios are smoothed by a Gaussian and split by a
    two-means threshold; lines above it are content, and the box that holds them (an
    article or main element with half of their text, else the deepest one with four
    fifths) is the region. It runs from its first to its last content line (an article
    to its own borders), and lists of links among the lines below the threshold go.
    Furniture elements never give lines, nor do boxes of furniture classes (see
    unmarked). Null or empty html gives an empty text; broken markup is read as far as it
    goes, in time that grows with its length; a line break inside a block is white space.
    """
    schema = "page_id long, url string, text string, n_chars long"

    def extract(batches):
        for batch in batches:
            texts = [extract_text(v.as_py()) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(row_id).cast("long"), F.col("url").cast("string"), F.col(html).cast("string")).mapInArrow(extract, schema)
