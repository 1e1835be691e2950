"""Main text of web pages from a stream of parser events.

The standard library's parser feeds events. A line is the text of one block element. Its text-to-tag
ratio is smoothed with its neighbours' by a Gaussian, and lines are clustered by a threshold on the
smoothed ratio. The region of the content is found from the cluster's lines: an article or main element
that holds the better part of their text, else the least element that holds them all. The region is taken
whole, short lines and headings too; lines in navigation, notices, adverts, reader comments and the like
are never content, nor those of forms that do not wrap the page, and outside articles neither are lists
and runs of links.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorenet.llm.text_units import rows_of

# Element names by their part in a page.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
LEFT_OUT = frozenset("head nav header footer aside script style template noscript iframe object embed canvas svg math button select textarea option dialog menu audio video map title input label fieldset".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SEMANTIC = frozenset(("article", "main"))
#: Elements whose class names say nothing about the article in them.
WHOLE = frozenset(("html", "body", "article", "main"))
#: Words that name what is not the article, as the last word of a class name, id or role that bears on
#: meaning: the last word says what a thing is, those before it of which kind.
NOTICE = frozenset("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist contentinfo complementary consent cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter notice notices pagination popup promo promos promotion recommendations recommended related replies reply search share sharing sidebar signup social sponsor sponsored sponsors subscribe toolbar widget widgets".split())
#: Words for a thing's shape or place, which may follow.
SHAPE = frozenset("area bar block box bottom button buttons center container content fixed group holder inline inner item items left links list main modal module mobile outer overlay panel posts right row section slot top unit wrap wrapper".split())
#: Class names of a page's layout, not of the part that they stand at.
LAYOUT = re.compile(r"(?:^|[_-])(?:has|no|non|not|with|without|is|hide|show)[_-]|[_-](?:layout|page|enabled|active|open|closed)$", re.I)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that a start tag ends, though their own end tags are missing, unless one of the second kind
#: stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tr": (("tr", "caption"), ("table",)), "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)), "thead": (("caption",), ("table",)), "tfoot": (("thead", "tbody", "caption"), ("table",)),
    "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
}
#: Elements whose lines are prose even where a line is one link.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote figcaption pre".split())
SIGMA = 1.0
THRESHOLD = 1.0  # in standard deviations of the smoothed ratio, as a share of it
#: Share of the content's text that an article or main must hold to be the region, and its share among
#: that of all of its kind. Share of a line's text in links from which it is one of links.
ARTICLE, ARTICLES, LINKS = 0.3, 0.5, 0.7
#: Share of a page's text from which a form wraps the page.
WRAPS = 0.5


def names_notice(name: str) -> bool:
    """Whether a class name, id or role is that of a notice: its last word, but for words of shape."""
    words = [w.lower() for w in WORDS.findall(name)]
    while len(words) > 1 and words[-1] in SHAPE:
        words.pop()
    return bool(words) and words[-1] in NOTICE and not LAYOUT.search(name)


def is_notice(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Whether class, id or role mark an element as no part of the article."""
    for k, v in attrs:
        if k == "hidden" or (k == "aria-hidden" and v == "true"):
            return True
        if k in ("class", "id", "role") and v and tag not in WHOLE and any(map(names_notice, v.split())):
            return True
    return False


class _Lines(HTMLParser):
    """Collects (element, text, tags, characters in links) of each line, in page order, and the elements'
    parents and names; element 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[int, str, int, int]] = []
        self.parent, self.name = [0], [""]
        self.stack: list[tuple[str, bool, int, bool]] = []  # name, and the state outside
        self.now: list[str] = []
        self.kept: list[str] = []
        self.tags = self.linked = 0
        self.state = (False, 0, False)  # left out, element, in a link

    def end_line(self) -> None:
        text = " ".join("".join(self.now).split())
        if text and not self.state[0]:
            self.lines.append((self.state[1], text, self.tags, self.linked))
        self.now, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.end_line()
            self.end_open(("p",), BLOCKS)
        if tag in ENDS:
            self.end_line()
            self.end_open(*ENDS[tag])
        self.tags += 1
        if tag == "br":
            self.now.append(" ")
        if tag in EMPTY:
            return
        out, element, link = self.state
        if not out:
            out = tag in LEFT_OUT or is_notice(tag, attrs)
            if out and tag not in BLOCKS:
                self.inline_out()
        self.stack.append((tag, *self.state))
        if tag in BLOCKS:
            self.parent.append(element)
            self.name.append(tag)
            element = len(self.parent) - 1
        self.state = (out, element, link or tag == "a")

    def inline_out(self) -> None:
        """An element inside a line is left out: its text must not join the line."""
        self.kept = self.now
        self.now = []

    def end_open(self, tags, until) -> None:
        """Close the innermost open element of ``tags``, and all in it, that no element of ``until`` lies in."""
        for name, *_ in reversed(self.stack):
            if name in tags:
                self.pop(name)
                return
            if name in until:
                return

    def pop(self, tag: str) -> None:
        """Close the innermost open ``tag`` and all in it, if there is one."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                was = self.state
                self.state = self.stack[k][1:]
                del self.stack[k:]
                if was[0] and not self.state[0] and tag not in BLOCKS:
                    self.now = self.kept
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in BLOCKS:
            self.end_line()
        self.pop(tag)

    def handle_data(self, data):
        self.now.append(data)
        if self.state[2]:
            self.linked += len(data.strip())

    def parse_marked_section(self, i, report=1):
        """A section that the parser has no name for is a comment up to the next >, as browsers read it."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)

    def finish(self) -> None:
        """End of input: an incomplete tag is dropped, an incomplete reference is text."""
        rest = self.rawdata
        at = rest.rfind("<")
        if at >= 0 and ">" not in rest[at:] and re.match(r"</?[A-Za-z!?]|<$|</$", rest[at:]):
            self.rawdata = rest[:at]
        self.close()
        self.end_line()


def smoothed(ratio: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """The ratios after convolution with a Gaussian, whose weights are renewed at either end."""
    r = max(1, int(np.ceil(3 * sigma)))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    full = np.convolve(ratio, w)[r : r + len(ratio)]
    return full / np.convolve(np.ones(len(ratio)), w)[r : r + len(ratio)]


def content_region(page: _Lines, weight: np.ndarray) -> int:
    """The element that holds the content, given each line's weight as content (zero: none)."""
    held = [0.0] * len(page.parent)
    for (element, *_), w in zip(page.lines, weight, strict=True):
        held[element] += w
    for e in range(len(held) - 1, 0, -1):  # a parent comes before its children
        held[page.parent[e]] += held[e]
    best = 0
    for name in ("main", "article"):
        below = _below(page.parent, best)
        nested = [False] * len(held)  # in another of the name
        tops = []
        for e in range(1, len(held)):
            nested[e] = below[e] and e != best and (nested[page.parent[e]] or page.name[page.parent[e]] == name)
            if below[e] and e != best and page.name[e] == name and not nested[e]:
                tops.append(e)
        if not tops or (best and len(tops) == 1):
            continue  # what stands in a main beside its only article belongs to it
        top = max(tops, key=lambda e: (held[e], -e))
        if held[top] > 0 and held[top] >= ARTICLE * held[best] and held[top] >= ARTICLES * sum(held[e] for e in tops):
            best = top
    if page.name[best] in SEMANTIC:
        return best
    children: list[list[int]] = [[] for _ in held]
    for e in range(1, len(held)):
        children[page.parent[e]].append(e)
    while children[best]:
        top = max(children[best], key=lambda e: held[e])
        if held[top] < held[0]:
            break
        best = top
    return page.parent[best] if not children[best] and page.name[best] not in ("div", "section", "td", "body") else best


def lines_of_content(page: _Lines) -> list[tuple[int, str, int, int]]:
    """The lines but for those of forms, unless a form holds the better part of the page's text: then it
    wraps the page, and is none of its parts."""
    forms = [e for e, name in enumerate(page.name) if name == "form"]
    lines = page.lines
    for form in forms:
        below = _below(page.parent, form)
        mine = sum(len(text) for e, text, *_ in lines if below[e])
        if mine <= WRAPS * sum(len(text) for _, text, *_ in page.lines):
            lines = [line for line in lines if not below[line[0]]]
    return lines


def _below(parent: list[int], top: int) -> list[bool]:
    """Of each element, whether it is ``top`` or in it."""
    out = [e == top for e in range(len(parent))]
    for e in range(top + 1, len(parent)):
        out[e] = out[parent[e]]
    return out


def main_text(html: str | None) -> str:
    """The article's blocks joined by line feeds; empty if there are none, or if html is null."""
    if not html:
        return ""
    page = _Lines()
    page.feed(html)
    page.finish()
    lines = lines_of_content(page)
    if not lines:
        return ""
    page.lines = lines
    size = np.array([len(text) for _, text, _, _ in lines], float)
    links = np.array([n for _, _, _, n in lines]) >= LINKS * size
    ratio = size / np.maximum(1, [tags for _, _, tags, _ in lines])
    smooth = smoothed(ratio)
    content = (smooth >= min(smooth.max(), THRESHOLD * smooth.std())) & ~links
    if not content.any():
        content[:] = True
    region = content_region(page, np.where(content, size, 0.0))
    article = region and any(page.name[e] in SEMANTIC for e in _up(page.parent, region))
    below = _below(page.parent, region)
    inside = [below[e] for e, *_ in lines]
    own = [line for line, ok in zip(lines, inside, strict=True) if ok]
    linked = [bool(link) for link, ok in zip(links, inside, strict=True) if ok]
    if article or all(linked):
        linked = [False] * len(own)
    among = [x and (page.name[line[0]] not in PROSE or any(linked[max(0, k - 1) : k] + linked[k + 1 : k + 2])) for k, (x, line) in enumerate(zip(linked, own, strict=True))]
    return "\n".join(line[1] for line, x in zip(own, among, strict=True) if not x)


def _up(parent: list[int], e: int):
    while e:
        yield e
        e = parent[e]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row, from its whole html.

    Null html counts as empty and gives an empty text. Broken markup is read as the parser reads it: end
    tags that may be missing (p, li, dt, dd, td, th, tr, option and parts of tables) are supplied where
    browsers do, an element that is never closed lasts to the end of the one around it, end tags without a
    start count for nothing, and an unfinished tag at the end is dropped. Rows are independent: repeated rows repeat, an empty table
    gives an empty result, other columns are not read."""

    def run(batches):
        for ids, urls, htmls in rows_of(batches, 500):
            texts = [main_text(h) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
