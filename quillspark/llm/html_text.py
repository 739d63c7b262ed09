"""Main text of HTML pages by block rules in two passes.

A page is cut into blocks where a block-level element begins or ends (and at two line breaks in a row). The first pass
judges each block by itself, by its share of linked characters, its length and its density of stop words: good, bad or,
where it is too short or has no links and is neither, undecided. In the second pass undecided blocks inherit the label of
the nearest decided block, before or after: of the same element, or else of the page; a heading goes with what follows
it. On a page without any good block, and where nothing is decided, all stays that nothing speaks against.

What markup says comes first: blocks inside elements that never hold main text (navigation, forms, asides, footers, page
headers, scripts, hidden parts), or whose class, id or role names an advert, notice, menu, comments and the like, are
bad. Where a page marks its text with <article> or <main>, only blocks in there can be good; among those a low density
of stop words doesn't make a block bad but undecided, as tables, names and foreign words are part of an article, and
where nothing near is decided they stay.

Pages never leave their task: there is no shuffle. Blocks of all pages of an Arrow batch are judged at once, in arrays.

Defined results: null or empty html, and pages without any good block, give an empty text of 0 characters; character
references are decoded, runs of white space (Unicode's, so no-break spaces too) become one space; an element that is
never closed ends with the element around it, an unclosed comment, script or tag with the page; a "<" that begins no
tag is text; very long pages are read whole; repeated rows and null ids are kept; further columns stay, those named as a
result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillspark.llm.textops import chunks, map_texts

# Elements of HTML by their part in a page, words that name what isn't main text, frequent words.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = frozenset("applet aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe input label legend menu nav noscript object optgroup option progress select svg template video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that the next of their group closes.
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
HINTS = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr hidden login masthead menu modal nav navbar navigation "
    "newsletter notice notification overlay pager pagination paywall popup promo promotion search share sharing sidebar signup skip social subscribe subscription tags toolbar topbar widget".split()
)
#: Those that hold articles which aren't the page's own.
OTHERS = frozenset("comment comments disqus discussion recommended related replies reply respond sponsor sponsored teaser".split())
NOT_HINTS = frozenset("has no with without".split())
STOP_WORDS = frozenset(
    # English
    "a an and are as at be but by for from has have he her his i in is it its not of on or she that the their there they this to was we were which who will with would you "
    # German
    "als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist mit nach nicht sich sie sind um und von war wie wird zu zum zur über "
    # French
    "au aux avec ce ces cette dans de du elle en est et il ils je la le les leur lui mais nous ont ou par pas pour plus que qui sa se ses son sont sur un une vous "
    # Spanish
    "al como con del desde el era esta este ha hay las lo los más mi muy no nos o para pero por porque sin sobre su sus también todo una y ya".split()
)

TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>]|\Z)[^>]*+(?:>.*?(?:</\1(?=[\s/>]|\Z)[^>]*+(?:>|\Z)|\Z)|\Z)"
    r"""|<(/?)([a-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|<[a-z/!?][^>]*+(?:>|\Z)""",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?=[\s=>/]|\Z)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
WORD = re.compile(r"\w+")

HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Where a block stands: nowhere special, in a marked article, in what a class name speaks against, in what is never main text.
OUTSIDE, INSIDE, WEAK, NEVER_MAIN = 0, 1, 2, 3


@dataclass(frozen=True)
class Rules:
    """Bounds of the first pass: characters of a short and of a long block, share of linked characters (of pages and of
    marked articles), densities of stop words."""

    short: int = 70
    long: int = 200
    links: float = 0.2
    article_links: float = 0.5
    low: float = 0.15
    high: float = 0.2
    stop_words: frozenset[str] = STOP_WORDS


@dataclass
class Blocks:
    """Blocks of several pages: text, place, linked characters, whether a heading, number of the element around, page."""

    text: list[str] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    heading: list[bool] = field(default_factory=list)
    around: list[int] = field(default_factory=list)
    page: list[int] = field(default_factory=list)


def named(parts: Iterable[str], hints: frozenset[str]) -> bool:
    """Some class or id begins or ends with a hint."""
    for name in parts:
        p = [x.lower() for x in PART.findall(name)]
        if p and not NOT_HINTS & set(p) and (p[0] in hints or p[-1] in hints):
            return True
    return False


def judged_by_markup(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is no main text: at all; unless an article begins inside it."""
    if tag in NEVER:
        return True, False
    if not attributes:
        return False, False
    names: list[str] = []
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), html.unescape(value.strip("\"'"))
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, False
        if key == "role" and value.lower() in ROLES:
            return True, False
        if key in ("class", "id"):
            names += value.split()
    if tag in ("html", "body", "main"):
        return False, False
    return named(names, OTHERS), tag != "article" and named(names, HINTS)


def cut(page: str, number: int, out: Blocks) -> None:
    """Appends the blocks of a page."""
    stack: list[tuple[str, int, bool, int]] = []  # element, place within it, heading, number of the element around
    texts: list[str] = []
    linked: list[str] = []
    link: int | None = None  # depth at which an open link began
    breaks = at = elements = 0

    def close() -> None:
        nonlocal breaks
        if texts:
            if text := " ".join("".join(texts).split()):
                _, place, heading, around = stack[-1] if stack else ("", OUTSIDE, False, 0)
                out.text.append(text)
                out.place.append(place)
                out.linked.append(len(" ".join("".join(linked).split())))
                out.heading.append(heading)
                out.around.append(around)
                out.page.append(number)
            texts.clear()
            linked.clear()
        breaks = 0

    def read(piece: str) -> None:
        nonlocal breaks
        if piece:
            piece = html.unescape(piece)
            texts.append(piece)
            if link is not None:
                linked.append(piece)
            if not piece.isspace():
                breaks = 0

    for m in TAG.finditer(page):
        read(page[at : m.start()])
        at = m.end()
        if m[3] is None:  # comments, scripts and the like, stray marks
            continue
        tag, ends, attributes = m[3].lower(), m[2], m[4]
        if tag == "a":
            link = None if ends else len(stack)
        elif tag == "br":
            breaks += 1
            texts.append(" ")
            if breaks == 2:
                close()
        elif tag in BLOCKS or tag in NEVER:
            close()
            if ends:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
                link = None if link is None or len(stack) < link else link
            else:
                if tag == "body":
                    stack.clear()
                while stack and (stack[-1][0] == "p" or stack[-1][0] in CLOSED_BY.get(tag, ())):
                    stack.pop()
                link = None if link is None or len(stack) < link else link  # a link ends with the element it stands in
                if tag not in VOID:
                    _, place, heading, around = stack[-1] if stack else ("", OUTSIDE, False, 0)
                    never, weak = judged_by_markup(tag, attributes)
                    if never or place == NEVER_MAIN:
                        place = NEVER_MAIN
                    elif tag in ("article", "main"):
                        place = INSIDE
                    elif weak or tag == "header" and place != INSIDE:
                        place = WEAK
                    elements += 1
                    stack.append((tag, place, heading or tag in HEADINGS, around if tag == "p" or tag in HEADINGS else elements))
    read(page[at:])
    close()


def nearest(group: np.ndarray, speaks: np.ndarray, good: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether a block's group has a decided one, and the label of the nearest; where two as near differ, ``near``."""
    order = np.argsort(group, kind="stable")
    g, n = group[order], len(group)
    at = np.arange(n)
    before = np.maximum.accumulate(np.where(speaks[order], at, -1))
    after = np.minimum(np.minimum.accumulate(np.where(speaks[order], at, n)[::-1])[::-1], n - 1)
    far = 2 * n + 1
    to_before = np.where((before >= 0) & (g[before] == g), order - order[before], far)
    to_after = np.where(speaks[order][after] & (g[after] == g) & (after >= at), order[after] - order, far)
    one, two = good[order][before], good[order][after]
    label = np.where(to_before < to_after, one, np.where(to_after < to_before, two, near[order] | one & two))
    has, out = np.zeros(n, bool), np.zeros(n, bool)
    has[order], out[order] = (to_before < far) | (to_after < far), label
    return has, out


def judge(b: Blocks, rules: Rules) -> np.ndarray:
    """Which blocks are main text."""
    n = len(b.text)
    place, page, linked, heading, around = map(np.array, (b.place, b.page, b.linked, b.heading, b.around))
    size = np.array([len(t) for t in b.text])
    pages = int(page[-1]) + 1
    marked = np.bincount(page[place == INSIDE], minlength=pages) > 0
    plain = np.bincount(page[place == OUTSIDE], minlength=pages) > 0
    inside = place == INSIDE
    # a page in which class names leave nothing is judged without them
    region = np.where(marked[page], inside, (place == OUTSIDE) | (place == WEAK) & ~plain[page])

    words, stops = np.zeros(n), np.zeros(n)
    for i in np.flatnonzero(region).tolist():
        w = WORD.findall(b.text[i].lower())
        words[i], stops[i] = len(w), sum(x in rules.stop_words for x in w)
    density, links = stops / np.maximum(words, 1), linked / size
    owned = np.array(["\u00a9" in t for t in b.text]) & ~inside & (size < rules.long)

    dense = links > np.where(inside, rules.article_links, rules.links)
    short = size < rules.short
    bad = ~region | dense | owned | ~inside & (linked > 0) & (short | (density < rules.low))
    good = ~bad & ~short & (size > rules.long) & (density >= rules.high)
    some = np.bincount(page[good], minlength=pages) > 0
    # what leans to good where two decided blocks differ: parts of a marked article, prose that isn't long, and on pages
    # without anything good all that nothing speaks against
    near = ~bad & ~good & (inside | ~short & (density >= rules.low) | ~some[page])

    # second pass; a marked article's neighbours are its own blocks, and a list of links says nothing of what is beside it
    speaks = (good | bad) & (region & ~dense | ~marked[page])
    here, own = nearest(page * (int(around.max()) + 1) + around, speaks, good, near)
    there, other = nearest(page, speaks, good, near)
    label = np.where(here, own, np.where(there & some[page], other, near))
    at = np.arange(n)
    after = np.minimum.accumulate(np.where(speaks, at, n)[::-1])[::-1]
    follows = (after < n) & (page[np.minimum(after, n - 1)] == page)
    label = np.where(heading & follows & some[page], good[np.minimum(after, n - 1)], label)
    return good | ~bad & label


def main_texts(pages: list[str], rules: Rules) -> list[str]:
    """The main text of each page."""
    b = Blocks()
    for i, p in enumerate(pages):
        cut(p, i, b)
    out: list[list[str]] = [[] for _ in pages]
    if b.text:
        for i in np.flatnonzero(judge(b, rules)).tolist():
            out[b.page[i]].append(b.text[i])
    return ["\n".join(x) for x in out]


def extract_text(pages: DataFrame, html_col: str = "html", rules: Rules | None = None) -> DataFrame:
    """All columns of ``pages`` but the html, with text and n_chars (code points)."""
    rules = rules or Rules()

    def make() -> Callable:
        def run(raw: list[bytes]) -> list:
            found: list[str] = []
            for i, j in chunks(raw):
                found += main_texts([r.decode("utf-8", "replace") for r in raw[i:j]], rules)
            return [found, [len(t) for t in found]]

        return run

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_texts(pages, html_col, make, fields, [c for c in pages.columns if c != html_col])
