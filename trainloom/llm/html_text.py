"""Main text of web pages: parser events make lines, text-to-tag ratios find where the content is.

The standard library's parser streams events. Block-level tags end a line (a block of text); each line has its
ratio of text to tags, where text in links and in what is no article by its tag, role, id or class counts
nothing. The ratios are smoothed by a Gaussian, and lines above the ratios' standard deviation cluster into
content regions. If article and main elements hold half of the regions' text or more, each that holds a region is
content, else the smallest element that holds all regions' lines; the lines of what is content are the text, short
ones too, without excluded elements.

Null, empty and textless pages give an empty text. Unclosed and stray tags are taken as browsers do, roughly: an
end tag closes what is open inside its element, one without a start is ignored, and of a tag or comment that never
ends nothing is text. Time grows with a page's length, however deep its elements are. Pages with equal or null ids are
read as they stand; other columns are ignored; an empty table gives no rows. One page is in memory at a time.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from statistics import pstdev

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without article text, and words of class or id that mark such (fixed values).
DROPPED = frozenset("aside button canvas datalist dialog footer form head header iframe input label map menu nav noscript object optgroup option script select style svg template textarea title video audio".split())
MARKS = frozenset("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promoted promotion related respond replies reply search share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toc toolbar topbar widget".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WHOLE = frozenset(["article", "main"])
#: Standard deviation of the smoothing, in lines.
SIGMA = 1.0


class Element:
    """article and main: the outermost ones that the element is or stands in. weight: of the content inside. inside: whether its lines are text."""

    __slots__ = ("article", "dropped", "inside", "main", "parent", "tag", "weight")

    def __init__(self, tag: str, parent: Element | None, dropped: bool):
        self.tag, self.parent, self.dropped, self.weight, self.inside = tag, parent, dropped, 0, False
        self.article = (parent and parent.article) or (self if tag == "article" else None)
        self.main = (parent and parent.main) or (self if tag == "main" else None)


class Line:
    __slots__ = ("element", "heading", "linked", "parts", "tags")

    def __init__(self, element: Element):
        self.element, self.parts, self.tags, self.linked, self.heading = element, [], 1, 0, False


class Reader(HTMLParser):
    """Lines of a page, in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [Element("html", None, False)]
        self.elements = list(self.open)  # in page order, so parents come first
        self.counts: Counter[str] = Counter()  # of open elements by tag
        self.lines, self.links, self.junk = [Line(self.open[0])], 0, False

    def cut(self) -> None:
        line = self.lines[-1]
        if line.parts:
            self.lines.append(Line(self.open[-1]))
        else:
            line.element, line.heading = self.open[-1], False

    def parse_html_declaration(self, i: int) -> int:
        try:
            return self.whole(super().parse_html_declaration(i))
        except AssertionError:  # of the parser, at a marked section of no known name: a comment up to the next >, as in browsers
            return self.whole(self.parse_bogus_comment(i))

    def whole(self, end: int) -> int:
        """What has no end is no text, up to the end of the page, as in browsers."""
        return len(self.rawdata) if end < 0 else end

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self.whole(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self.whole(super().parse_pi(i))

    def parse_endtag(self, i: int) -> int:
        return self.whole(super().parse_endtag(i))

    def parse_starttag(self, i: int) -> int:
        self.junk = True  # the parser gives a broken tag as data
        end = super().parse_starttag(i)
        self.junk = False
        return self.whole(end)

    def unwanted(self, tag: str, attrs: list) -> bool:
        if tag in DROPPED:
            # An article's own header has its headings; they are no page header.
            return not (tag == "header" and self.whole_open())
        marks = " ".join(v for k, v in attrs if k in ("class", "id") and v).lower()
        if marks and tag not in ("html", "body", "main"):
            found = MARKS.intersection(re.split(r"[^a-z0-9]+", marks))
            if found and not (found == {"header"} and self.whole_open()):
                return True
        return any((k == "role" and (v or "").lower() in ROLES) or k == "hidden" for k, v in attrs)

    def whole_open(self) -> bool:
        return bool(self.counts["article"] or self.counts["main"])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            self.lines[-1].tags += 1
            self.links += tag == "a"
            if tag in VOID or not attrs or not self.unwanted(tag, attrs):
                return
        if tag in VOID:
            self.cut()
            self.lines[-1].tags += 1
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th") and self.open[-1].tag == tag:
            self.counts[self.open.pop().tag] -= 1
        if tag in WHOLE and (self.counts["nav"] or self.counts["menu"]) and not self.unwanted(tag, attrs):
            self.close_to(next(i for i, x in enumerate(self.open) if x.tag in ("nav", "menu")))
        self.links = 0 if tag not in INLINE else self.links
        self.open.append(Element(tag, self.open[-1], self.open[-1].dropped or self.unwanted(tag, attrs)))
        self.elements.append(self.open[-1])
        self.counts[tag] += 1
        self.cut()
        self.lines[-1].tags += 1
        self.lines[-1].heading = tag in HEADINGS

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag in VOID or tag in INLINE:
            self.handle_starttag(tag, attrs)
            self.links -= tag == "a" and self.links > 0

    def close_to(self, depth: int) -> None:
        self.counts.subtract(x.tag for x in self.open[depth:])
        del self.open[depth:]
        self.links = 0
        self.cut()

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if not self.counts[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.close_to(i)
                return
            if tag in INLINE and self.open[i].tag not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if self.junk:
            return
        line = self.lines[-1]
        if not line.parts:
            if data.isspace():
                return
            line.element = self.open[-1]
        line.parts.append(data)
        if self.links:
            line.linked += len(data.strip())


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    whole = sum(kernel)
    padded = [0.0] * reach + values + [0.0] * reach
    return [sum(w * x for w, x in zip(kernel, padded[i : i + 2 * reach + 1], strict=True)) / whole for i in range(len(values))]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    reader = Reader()
    reader.feed(html)
    reader.close()
    lines = [(x, text) for x in reader.lines if (text := " ".join("".join(x.parts).split())) and not x.element.dropped]
    if not lines:
        return ""
    ratios = smooth([max(0, len(text) - x.linked) / x.tags for x, text in lines])
    limit = pstdev(ratios)
    content = [i for i, r in enumerate(ratios) if r > limit] or list(range(len(lines)))
    held, marked, whole = set(), 0, 0
    for i in content:
        element, size = lines[i][0].element, len(lines[i][1])
        element.weight += size
        whole += size
        # Every article with content is held, and a main element that has content beside articles.
        if best := element.article or element.main:
            held.add(best)
            marked += size
    for x in reversed(reader.elements[1:]):
        x.parent.weight += x.weight
    top = None
    if 2 * marked < whole:
        # Most content stands in no such element, so the tag does not tell where it is.
        top = lines[content[0]][0].element
        while top.weight < whole:
            top = top.parent
        held = {top}
    for x in reader.elements:
        x.inside = x in held or (x.parent is not None and x.parent.inside)
    inside = [line.element.inside for line, _ in lines]
    first = inside.index(True)
    while top and first and lines[first - 1][0].heading:
        first -= 1
        inside[first] = True
    return " ".join(text for (_, text), take in zip(lines, inside, strict=True) if take)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.slice(at, 256)
                texts = [main_text(x) for x in b.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(of, "page_id long, url string, text string, n_chars long")
