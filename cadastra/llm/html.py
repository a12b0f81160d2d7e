"""Main text of web pages.

The page streams through the standard library's event parser and is cut into lines
at block boundaries.  Each line has a text-to-tag ratio; the ratios are smoothed
along the page by a Gaussian kernel and split by threshold clustering (two means):
lines above the threshold with little of their text in links are content lines.

Content lines select the regions: the article elements that hold any, or else the main
element, or else the lowest element that holds all of them.  A region gives all its
blocks, short ones included, but for furniture.  Tags and roles that mean furniture
always count as such, inline ones too, and so do inline elements named like it: their text
is dropped as it comes.  Names of other elements only weigh: an element around the article,
or on a page without one around more than half of the content, is a wrapper whatever it is
called, a form too, and inside an article ambiguous names count only for elements with
little content that no heading begins.  A name that is only a part of a class or id, or that
of a paragraph or heading, counts only where most of the element is no content.

Lines and elements are lists in page order and every pass over them is linear."""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SIGMA = 1.0
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Furniture by meaning, whatever it holds.
FURNITURE = frozenset("head title script style noscript template nav footer aside button select option textarea iframe object svg canvas dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar status".split())
#: Names of furniture, unless the element is a wrapper.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar "
    "cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login share sharing social comment comments disqus respond pagination pager paywall".split()
)
#: Names that in an article may as well be of its parts.
AMBIGUOUS = frozenset(
    "header masthead topbar footer bottombar aside rail widget widgets notice notices notification alert banner overlay related recommended trending reply replies "
    "discussion toolbar search copyright disclaimer hidden skip form".split()
)
#: Words beside names that do not change what the name means.
GENERIC = frozenset("box slot list wrapper wrap container block section area bar unit inner outer button buttons link links item items group panel top bottom left right icon icons row col".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
#: Elements of one text each, which are no region.
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote summary figcaption caption legend".split())
_NAME = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_CLOSES_P = BLOCK - {"option", "caption", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
_P_ENDS = ("article", "section", "div", "td", "li", "blockquote", "form", "aside", "nav", "body", "main", "table", "button")
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_HOLDS = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def names_of(value: str) -> set[str]:
    return {w.lower() for w in _NAME.findall(value)}


def whole_names(value: str) -> set[str]:
    """Names that a class or id as a whole stands for: ``ad-slot`` but not ``ad-hoc``."""
    out: set[str] = set()
    for token in value.split():
        words = names_of(token)
        if words & (NAMES | AMBIGUOUS) and words <= NAMES | AMBIGUOUS | GENERIC:
            out |= words - GENERIC
    return out


class Page(HTMLParser):
    """Events into elements and lines, both numbered in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parent: list[int] = []
        self.tag_of: list[str] = []
        self.hint: list[str] = []  # "", "always", "wrapper", "ambiguous" or "weak"
        self.comments: list[bool] = []
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags met, linked characters, block element
        self.stack: list[tuple[str, int, int, bool]] = []  # tag, element, nearest block element, whether text counts for nothing
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.linked = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][2] if self.stack else -1))
            self.tags = 0
        self.text, self.linked = [], 0

    def _pop(self, to: int) -> None:
        for tag, *_ in self.stack[to:]:
            self.open[tag] -= 1
        del self.stack[to:]

    def _close(self, tags: tuple[str, ...], until: tuple[str, ...]) -> None:
        if any(self.open[t] for t in tags):
            for i in range(len(self.stack) - 1, -1, -1):
                tag = self.stack[i][0]
                if tag in tags:
                    return self._pop(i)
                if tag in until:
                    return None
        return None

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in _CLOSES_P:
            self._close(("p",), _P_ENDS)
        if tag in _SAME:
            self._close(_SAME[tag], _HOLDS[tag])
        number, above = len(self.tag_of), self.stack[-1] if self.stack else ("", -1, -1, False)
        told = {k: v or "" for k, v in attrs}
        names = whole_names(told.get("class", "")) | whole_names(told.get("id", ""))
        some = names_of(told.get("class", "")) | names_of(told.get("id", ""))
        self.tag_of.append("main" if told.get("role", "").lower() == "main" else tag)
        self.parent.append(above[1])
        hint = self._hint(tag, told, names, some)
        self.hint.append(hint)
        self.comments.append(bool(names & COMMENTS))
        inline = tag not in BLOCK and bool(names & NAMES)  # is no element of lines of its own
        self.stack.append((tag, number, number if tag in BLOCK else above[2], above[3] or hint == "always" or inline))
        self.open[tag] += 1

    def _hint(self, tag: str, told: dict[str, str], names: set[str], some: set[str]) -> str:
        if tag in FURNITURE or told.get("role", "").lower() in ROLES or "hidden" in told or told.get("aria-hidden") == "true" or _HIDDEN.search(told.get("style", "")):
            return "always"
        if tag in ("html", "body", "main", "article"):
            return "wrapper" if tag == "article" and names & COMMENTS else ""
        if tag in ("form", "fieldset") or names & NAMES and tag not in _TEXTS:
            return "wrapper"
        if tag == "header" or names & AMBIGUOUS and tag not in _TEXTS:
            return "ambiguous"
        return "weak" if some & NAMES else ""

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
            return
        if tag in BLOCK:
            self.flush()
        if self.open[tag] > 0:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == tag:
                    return self._pop(i)
                if tag not in BLOCK and self.stack[i][0] in BLOCK:
                    return None  # an inline end tag does not close blocks
        return None

    def handle_data(self, data):
        if self.stack and self.stack[-1][3]:
            return
        self.text.append(data)
        if self.open["a"]:
            self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = math.ceil(2 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        part = [(k, values[i + d]) for k, d in zip(kernel, range(-reach, reach + 1)) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in part) / sum(k for k, _ in part))
    return out


def two_means(values: list[float]) -> float:
    """Threshold half-way between the means of a low and a high cluster."""
    low, high = min(values), max(values)
    for _ in range(50):
        cut = (low + high) / 2
        below, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not over:
            return min(values)
        now = sum(below) / len(below), sum(over) / len(over)
        if now == (low, high):
            break
        low, high = now
    return (low + high) / 2


def extract(html: str | None) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    page = Page()
    page.feed(html or "")
    page.close()
    page.flush()
    parent, tag_of, hint, n = page.parent, page.tag_of, page.hint, len(page.parent)
    barred = [False] * (n + 1)  # the last stands for no element
    for e in range(n):
        barred[e] = hint[e] == "always" or barred[parent[e]]
    lines = [line for line in page.lines if not barred[line[3]]]
    if not lines:
        return ""
    ratio = smooth([len(text) / max(1, tags) for text, tags, *_ in lines])
    cut = two_means(ratio)
    plain = [2 * linked <= len(text) for text, _, linked, _ in lines]
    is_content = [r >= cut and p for r, p in zip(ratio, plain)]
    if not any(is_content):
        is_content = plain
    content, every, linked_in = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for (text, _, linked, e), good in zip(lines, is_content):
        every[e] += len(text)
        linked_in[e] += linked
        content[e] += len(text) * good
    for e in range(n - 1, -1, -1):
        every[parent[e]] += every[e]
        content[parent[e]] += content[e]
        linked_in[parent[e]] += linked_in[e]
    total = content[-1]
    marks = [tag in ("article", "main") and not c and not b for tag, c, b in zip(tag_of, page.comments, barred)] + [False]
    for e in range(n - 1, -1, -1):
        marks[parent[e]] |= marks[e]

    # from the page down: what is furniture, and which articles and mains stand outside it
    gone, within = [False] * (n + 1), [False] * (n + 1)
    articles, mains = [], []
    for e in range(n):
        up, tag = parent[e], tag_of[e]
        within[e] = within[up] or tag in ("article", "main")
        gone[e] = gone[up] or barred[e]
        if hint[e] and not gone[e]:
            # a form may stand around the text anywhere, another wrapper around the article only
            around = tag == "form" or not within[up] and (marks[e] or not marks[-1])
            if hint[e] == "weak":  # the lines must agree with the name
                gone[e] = 2 * content[e] < every[e] and not marks[e]
            elif page.comments[e] or not around or 2 * content[e] <= total:
                part = within[up] and (2 * content[e] >= every[e] or _heads(tag_of, parent, e))
                gone[e] = hint[e] != "ambiguous" or not part
        if not gone[e] and tag == "article":
            articles.append(e)
        elif not gone[e] and tag == "main":
            mains.append(e)
    held = [e for e in articles if content[e] or 2 * linked_in[e] < every[e]] or articles or [e for e in mains if content[e]] or mains
    marked = bool(held)
    if not held:
        kept = [(line, good) for line, good in zip(lines, is_content) if not gone[line[3]]]
        at = [line[3] for line, good in kept if good] or [line[3] for line, _ in kept]
        held = [_common(parent, tag_of, at)] if at else []
    inside = [False] * (n + 1)
    for e in held:
        inside[e] = True
    for e in range(n):
        inside[e] = inside[e] or inside[parent[e]]
    if held == [-1]:
        inside = [True] * (n + 1)
    if not marked and not any(tag_of[line[3]] == "h1" and inside[line[3]] for line in lines if line[3] >= 0):
        for e in range(min(held, default=-1)):  # the title may stand before the region
            inside[e] = inside[e] or tag_of[e] == "h1"
    # nothing marks the article: what is mostly links is a menu
    return "\n".join(line[0] for line, p in zip(lines, plain) if inside[line[3]] and not gone[line[3]] and (marked or p))


def _heads(tag_of: list[str], parent: list[int], e: int) -> bool:
    """Whether an element starts with a heading."""
    return e + 1 < len(tag_of) and parent[e + 1] == e and tag_of[e + 1] in ("h1", "h2", "h3", "h4", "h5", "h6")


def _common(parent: list[int], tag_of: list[str], elements: list[int]) -> int:
    """Lowest element around all of ``elements`` that can hold several; -1 if none."""
    count = Counter(elements)
    for e in range(len(parent) - 1, -1, -1):  # children have larger numbers
        if count[e]:
            if count[e] == len(elements) and tag_of[e] not in _TEXTS:
                return e
            count[parent[e]] += count[e]
    return -1


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` per row of ``pages``.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one line feed.  Very long pages take time in proportion; ties of
    ratios with the threshold are content.  A null or empty page gives an empty text;
    null ids and urls are carried; repeated rows stay repeated; an empty table gives
    no rows; other columns are ignored, whatever their names."""

    def run(batches):
        for b in batches:
            found = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=["id", "url", "text", "n_chars"])

    return shared.map_batches(pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")), run, "id long, url string, text string, n_chars long")
