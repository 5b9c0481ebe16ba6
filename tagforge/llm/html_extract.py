"""Main text of web pages by line-block distribution.

A page is read once, left to right, and cut into lines, one per block-level element.  Markup, scripts, styles and whatever stands
inside elements that are no article text by their tag (nav, aside, footer, form, ...) or by an unmistakable word of their class, id or role
(menu, sidebar, advert, cookie, comments, ...) are no lines.

Each line has a weight: its code points outside links, 0 if links hold more than half of it.  Evidence lowers it: half for text inside elements with a
doubtful word (alert, disclaimer, related, ...), a tenth for text outside the marked content (article, main) of a page that has
such, unless more surges outside than stands inside, when the marks count for nothing.

On every page the weights are summed over sliding windows of ``window`` lines, each stretch inside or outside marked content by itself.  The
text surges where a window's sum reaches ``surge`` (in marked content that counts, the stretch's own largest sum if that is less) and dives
where a sum is 0.  The lines with a weight from surge to dive are the main text, with the headings before them and, in
marked content that counts, what stands between the dive before and the surge.  Without a surge on the whole page the lines with a weight are the text.

Inside a line white space becomes one space; lines are joined by one newline.  A null, empty or
textless page gives the empty text.  Malformed pages have a text too: an attribute's quote that isn't closed, or not before
white space, "/" or ">", is an ordinary character; a "<" that starts no tag is text; what an unclosed script, style or comment holds is dropped.
The time taken grows with the length of the page, also for very long pages, deep nesting and broken tags.
Repeated rows are extracted alike; columns other than those asked for are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tagforge.llm.common import map_texts

# HTML element names by their role in the page.
SKIPPED = frozenset("script style noscript template svg math head title iframe object canvas audio video select textarea datalist button".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form menu dialog header".split())
CONTENT_TAGS = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCKS - frozenset("body html li dd dt tr td th tbody thead tfoot option optgroup caption legend summary figcaption".split())
# Words in class, id or role attributes that mark boilerplate; those of a page's or an article's head; those that leave it in doubt.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot bottombar breadcrumb breadcrumbs captcha comment comments commentlist complementary consent contentinfo cookie cookies copyright disqus footer footnav form gdpr hidden login menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promoted promotion respond sharing sidebar signin signup skiplink skyscraper sponsor sponsored subscribe subscription toolbar topbar tracking widget widgets".split()
)
HEAD_WORDS = frozenset("banner header masthead".split())
DOUBTFUL_WORDS = frozenset("alert dialog disclaimer discussion recommended register related replies search share skip social tags teaser toc".split())
SECTIONS = frozenset("article main div section body html".split())
LISTS = frozenset("ul ol menu".split())
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
SPLIT_WORDS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


QUOTE_OR_END = re.compile("[>\"']")
SPEAKS = re.compile("class|id|role|hidden|style", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in SKIPPED}
#: Factors of a line's weight; a window's sum up to EMPTY is 0 but for rounding.
OUTSIDE, DOUBTFUL, EMPTY = 0.1, 0.5, 1e-9


class Line:
    """A line's text, its code points inside links, its marked region (0 outside), and whether it is a heading or in doubt."""

    __slots__ = ("doubtful", "heading", "link_chars", "region", "text")

    def __init__(self, text: str, link_chars: int, region: int, heading: bool, doubtful: bool):
        self.text, self.link_chars, self.region, self.heading, self.doubtful = text, link_chars, region, heading, doubtful


def evidence(attributes: str, in_content: bool) -> str:
    """"bad" for boilerplate by class, id, role or a hiding attribute, "doubtful", or nothing."""
    if not SPEAKS.search(attributes):
        return ""
    found = ""
    for name, *values in ATTRIBUTE.findall(attributes):
        value, name = "".join(values), name.lower()
        if name in ("class", "id", "role"):
            words = set(SPLIT_WORDS.split(CAMEL.sub(" ", value).lower()))
            if words & BOILERPLATE_WORDS or (not in_content and words & HEAD_WORDS):
                return "bad"
            if words & DOUBTFUL_WORDS:
                found = "doubtful"
        elif (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return "bad"
    return "bad" if "hidden" in attributes and HIDDEN.search(ATTRIBUTE.sub(" ", attributes).lower()) else found


def tag_end(page: str, at: int, spent: set[str]) -> int:
    """The offset behind the ">" that ends the tag whose name ends at ``at``; -1 without one.  ``spent`` holds quotes that stand nowhere later."""
    end = page.find(">", at)
    if end < 0:
        return -1
    if page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
        return end + 1
    while found := QUOTE_OR_END.search(page, at):
        quote, at = found[0], found.end()
        if quote == ">":
            return at
        before = found.start() - 1
        while before > 0 and page[before].isspace():
            before -= 1
        if page[before] != "=" or quote in spent:
            continue
        close = page.find(quote, at)
        if close < 0:
            spent.add(quote)
        elif close + 1 == len(page) or page[close + 1] in "/>" or page[close + 1].isspace():
            at = close + 1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text before, tag name, attributes) in one pass; an end tag's name starts with "/"; comments and raw elements are skipped."""
    at, held, size, spent = 0, 0, len(page), set()
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        if not (after.isalpha() or (after and after in "/!?")):
            at = lt + 1
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = size if end < 0 else end + 3
        elif page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            end = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt) + 1
            if not end:
                break
        else:
            closing = page.startswith("/", lt + 1)
            name = TAG_NAME.match(page, lt + 1 + closing)
            if not name:
                at = lt + 1
                continue
            end = page.find(">", name.end()) + 1 if closing else tag_end(page, name.end(), spent)
            if end <= 0:
                break
            word, attributes = name[0].lower(), page[name.end() : end - 1]
            if not closing and word in SKIPPED and word != "head":
                if not attributes.endswith("/"):
                    close = RAW_END[word].search(page, end)
                    end = close.end() if close else size
                yield page[held:lt], "", ""
            else:
                yield page[held:lt], "/" + word if closing else word, attributes
            at = held = end
            continue
        yield page[held:lt], "", ""
        at = held = end
    yield page[held:], "", ""


class _Reader:
    """The elements open at a place of the page, and the lines so far."""

    def __init__(self):
        self.lines: list[Line] = []
        self.open: list[tuple[str, str, bool]] = []  # name, evidence, content
        self.names: Counter[str] = Counter()
        self.said: Counter[str] = Counter()
        self.depth = self.regions = self.region = self.headings = self.linked = 0
        self.held: list[str] = []

    def text(self, piece: str) -> None:
        if piece and not self.said["bad"]:
            self.held.append(piece)
            if self.names["a"]:
                self.linked += len(piece.strip())

    def flush(self) -> None:
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            if text:
                self.lines.append(Line(text, self.linked, self.region, self.headings > 0, self.said["doubtful"] > 0))
            self.held, self.linked = [], 0

    def pop(self) -> str:
        name, said, content = self.open.pop()
        self.names[name] -= 1
        self.said[said] -= 1
        self.headings -= name in HEADINGS
        if content:
            self.depth -= 1
            self.region = self.region if self.depth else 0
        return name

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.flush()
        if self.names[name] > 0:
            while self.pop() != name:
                pass

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
            return
        if name in BLOCKS:
            self.flush()
            if name in CLOSES_P:
                while self.names["p"] > 0 and self.open[-1][0] not in SECTIONS:
                    self.pop()
        if name in VOID or attributes.endswith("/"):
            return
        if name == "li" and self.names["li"] > 0 and self.open[-1][0] not in LISTS and any(t[0] == "li" for t in self.open[-3:]):
            while self.pop() != "li":
                pass
        marks = name in CONTENT_TAGS
        said = "bad" if name == "head" or (name in BOILERPLATE_TAGS and not (name == "header" and self.depth)) else ""
        if not said and name not in ("html", "body") and not (marks and not self.depth):
            said = evidence(attributes, self.depth > 0)
        content = marks and said != "bad" and not self.said["bad"]
        if content:
            if not self.depth:
                self.regions += 1
                self.region = self.regions
            self.depth += 1
        self.open.append((name, said, content))
        self.names[name] += 1
        self.said[said] += 1
        self.headings += name in HEADINGS


def lines_of(page: str) -> list[Line]:
    """The page's text lines outside boilerplate elements, in order; region 0 is outside marked content."""
    at = _Reader()
    for text, name, attributes in tokens(page):
        at.text(text)
        if name.startswith("/"):
            at.close(name[1:])
        elif name:
            at.start(name, attributes)
    at.flush()
    return at.lines


def main_text(page: str | None, window: int = 3, surge: int = 60) -> str:
    """The page's main text; see the module's docstring."""
    lines = lines_of(page or "")
    if not lines:
        return ""
    own = np.array([0 if 2 * x.link_chars > len(x.text) else (len(x.text) - x.link_chars) * (DOUBTFUL if x.doubtful else 1.0) for x in lines])
    region = np.array([x.region for x in lines])
    edges = [0, *(np.flatnonzero(np.diff(region)) + 1).tolist(), len(lines)]
    marked = region > 0

    def search(weight: np.ndarray, trusted: bool) -> np.ndarray:
        kept = np.zeros(len(lines), bool)
        for a, b in zip(edges, edges[1:], strict=False):
            kept[a:b] = between(weight[a:b], [x.heading for x in lines[a:b]], window, surge, trusted and bool(marked[a]))
        return kept

    plain = search(own, False)
    trusted = marked.any() and own[plain & ~marked].sum() <= own[marked].sum()
    kept = search(np.where(marked, own, OUTSIDE * own), True) if trusted else plain
    if not kept.any():  # no surge anywhere: a page of short lines
        kept = own > 0
    return "\n".join(x.text for x, k in zip(lines, kept, strict=True) if k)


def between(weight: np.ndarray, heading: list[bool], window: int, surge: float, trusted: bool) -> np.ndarray:
    """The lines of a stretch with a weight, from each surge to its dive, and what leads to the surge."""
    ahead = np.convolve(weight, np.ones(window), "full")[window - 1 :]
    need = min(surge, ahead.max()) if trusted else surge
    kept = np.zeros(len(weight), bool)
    i = dived = 0
    while i < len(weight):
        if ahead[i] <= EMPTY:
            dived = i + 1
        if ahead[i] < need or weight[i] <= 0:
            i += 1
            continue
        dive = i
        while dive < len(weight) and ahead[dive] > EMPTY:
            dive += 1
        back = dived if trusted else i
        kept[back:dive] = weight[back:dive] > 0
        i = dived = dive
    for i in range(len(weight) - 2, -1, -1):
        kept[i] |= heading[i] and kept[i + 1]
    return kept


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html_col: str = "html", window: int = 3, surge: int = 60) -> DataFrame:
    """The columns ``keep``, text, and n_chars (its code points)."""
    fields = [T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)]
    return map_texts(pages, list(keep), html_col, fields, partial(_columns, window, surge))


def _columns(window, surge, pages):
    texts = [main_text(p, window, surge).encode("utf-8", "replace").decode() for p in pages]
    return [texts, [len(t) for t in texts]]
