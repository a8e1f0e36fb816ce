"""Main text of web pages from parser events, text-to-tag ratios and threshold clustering.

The standard library's parser streams events; each block of text is a line with a ratio of its characters to its tags. Ratios
are smoothed with a Gaussian, split in two clusters by an iterated threshold, and the container that holds the upper cluster
is the content; of it, menus, forms, adverts and the like are left out by element and by telling class names. A name tells if
every word of it says so or is neutral (``ad-box``, ``comment-list``): ``side-effects`` doesn't. Pages without telling
elements and names rest on the clusters alone: where no container below the page holds most of the upper cluster, the clusters choose
among containers and, directly in the page, among blocks.

Defined results: a null or empty page, or one without text, gives an empty string; unclosed elements end with their parent or the page;
repeated rows are read each; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heliograph.llm.shared import map_texts

SIGMA = 1.5
#: Share of the upper cluster's characters that the content's container holds at least.
COVER = 0.8
CHUNK = 1 << 16

#: Elements by their part on a page.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("nav footer aside form script style noscript template title head button select textarea option iframe object svg canvas audio video map menu dialog".split())
RAW = frozenset("script style noscript template button select textarea iframe object svg canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body html td".split())
#: Containers that are the page itself.
PAGE = frozenset("html body".split())
NEVER_SKIPPED = frozenset("html body main article".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead comment comments respond replies disqus cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login popup modal overlay"
    " share sharing social related recommended widget toolbar pagination pager skip search copyright".split()
)
#: Words that don't change what a class name tells.
NEUTRAL_WORDS = frozenset(
    "area bar block bottom box btn button buttons col column container content group holder inline inner item items left link links list main outer panel"
    " right row section site page slot text the title top unit wrap wrapper".split()
)
_TOKENS = re.compile(r"[a-z0-9]+")
_HEADING = re.compile(r"h[1-6]")
_WHITE = re.compile(r"\s+")
_TAIL = re.compile(r"<(?:[a-zA-Z!?]|/[a-zA-Z])[^<>]*$")


def tells(name: str) -> bool:
    """Whether a class name or id marks what isn't content."""
    found = [w for w in _TOKENS.findall(name.lower()) if not w.isdigit()]
    return any(w in SKIPPED_WORDS for w in found) and all(w in SKIPPED_WORDS or w in NEUTRAL_WORDS for w in found)


class Page(HTMLParser):
    """Collects blocks: text, tags inside, the element they are in, and whether they are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, bool]] = []  # element, its number, left out
        self.open: Counter[str] = Counter()
        self.names: list[str] = [""]  # by number; an element's number is greater than its parent's
        self.parents: list[int] = [0]
        self.texts: list[str] = []
        self.tags: list[int] = []
        self.places: list[int] = []
        self.out: list[bool] = []
        self.buffer: list[str] = []
        self.inside = 0

    def end_block(self) -> None:
        if self.buffer:
            text = _WHITE.sub(" ", "".join(self.buffer)).strip()
            self.buffer = []
            if text:
                self.texts.append(text)
                self.tags.append(self.inside)
                self.places.append(self.stack[-1][1] if self.stack else 0)
                self.out.append(bool(self.stack) and self.stack[-1][2])
        self.inside = 0

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in BLOCKS and tag not in RAW:
            self.inside += 1
            if tag == "br":
                self.buffer.append(" ")
            return
        self.end_block()
        self.inside = 1
        if tag in VOID:
            return
        if self.stack and (self.stack[-1][0] == "p" and tag not in RAW or self.stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
            self.pop()
        above = bool(self.stack) and self.stack[-1][2]
        out = above or tag in SKIPPED or tag == "header" and not self.open["article"] and not self.open["main"]
        if not out and tag not in NEVER_SKIPPED:
            out = any(tells(name) for k, v in attrs if k in ("class", "id", "role") for name in (v or "").split())
        self.names.append(tag)
        self.parents.append(self.stack[-1][1] if self.stack else 0)
        self.stack.append((tag, len(self.names) - 1, out))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in BLOCKS and tag not in RAW:
            self.inside += 1
            return
        self.end_block()
        if self.open[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat their value."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray) -> float:
    """Midway between the means of the two clusters that it makes (iterated)."""
    cut = float(values.mean())
    for _ in range(50):
        low, high = values[values <= cut], values[values > cut]
        if not len(low) or not len(high):
            break
        new = (float(low.mean()) + float(high.mean())) / 2
        if abs(new - cut) < 1e-9:
            break
        cut = new
    return cut


def main_text(html: str | None) -> str:
    """The content's blocks, joined by newlines."""
    if not html:
        return ""
    page = Page()
    html = _TAIL.sub("", html)  # a tag that the page's end cuts off
    for i in range(0, len(html), CHUNK):
        page.feed(html[i : i + CHUNK])
    page.close()
    page.end_block()
    if not page.texts:
        return ""
    sizes = np.array([len(t) for t in page.texts], dtype=float)
    kept = ~np.array(page.out)
    if not kept.any():
        return ""
    ratios = sizes * kept / np.maximum(1, page.tags)
    soft = smoothed(ratios)
    cut = threshold(soft)
    content = kept & (soft >= cut)
    if not content.any():
        content = kept
    # characters of the content in each element, from the innermost outwards
    held = [0.0] * len(page.names)
    for i in np.flatnonzero(content):
        held[page.places[i]] += sizes[i]
    for n in range(len(held) - 1, 0, -1):
        held[page.parents[n]] += held[n]
    enough = [n for n in range(1, len(held)) if page.names[n] in CONTAINERS and held[n] >= COVER * sizes[content].sum()]
    named = [n for n in enough if page.names[n] in ("article", "main")]
    own = [n for n in enough if page.names[n] not in PAGE]
    if not named and not own:
        stays = scattered(page, kept, content, ratios >= cut, sizes)
        return "\n".join(t for t, s in zip(page.texts, stays, strict=True) if s)
    root = max(named or own)  # the innermost: numbers grow inwards
    within = [False] * len(held)
    for n in range(1, len(held)):
        within[n] = n == root or within[page.parents[n]]
    # without a named root, blocks elsewhere stay if they are in the upper cluster by themselves too
    also = content & (ratios >= cut) & (not named)
    return "\n".join(t for t, n, k, c in zip(page.texts, page.places, kept, also, strict=True) if k and within[n] or c)


def scattered(page: Page, kept: np.ndarray, content: np.ndarray, high: np.ndarray, sizes: np.ndarray) -> list[bool]:
    """Which blocks are the content where no container below the page holds it.

    The containers next to the upper cluster's blocks are taken one by one: one whose own blocks are mostly (by characters) in the
    cluster stays as a whole, the others go. Blocks directly in the page stay if they are in the cluster, by themselves or with both
    neighbours, and so do headings before such a block. A page of one cluster stays whole.
    """
    if not (kept & ~content).any() or not (content & high).any():
        return kept.tolist()
    near = [0] * len(page.names)
    for n in range(1, len(near)):
        near[n] = (0 if page.names[n] in PAGE else n) if page.names[n] in CONTAINERS else near[page.parents[n]]
    place = np.array([near[n] for n in page.places])
    both = np.zeros((2, len(near)))
    for i in np.flatnonzero(kept):
        both[0, place[i]] += sizes[i]
        both[1, place[i]] += sizes[i] * content[i]
    chosen = 2 * both[1] >= both[0]
    stays, order = [False] * len(place), np.flatnonzero(kept).tolist()
    for j in range(len(order) - 1, -1, -1):
        i, after, before = order[j], order[j + 1] if j + 1 < len(order) else None, order[j - 1] if j else None
        if place[i]:
            stays[i] = bool(chosen[place[i]] and both[1, place[i]])
        elif content[i] and high[i]:
            stays[i] = True
        elif _HEADING.fullmatch(page.names[page.places[i]]):
            stays[i] = after is not None and stays[after]
        else:
            stays[i] = bool(content[i] and after is not None and before is not None and content[after] and content[before])
    return stays


def extract_pages(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """``carry``, ``text`` and ``n_chars`` (code points) for each page."""

    def make():
        return lambda texts: [(t, len(t)) for t in map(main_text, texts)]

    return map_texts(pages, carry, html, make, {"text": pa.string(), "n_chars": pa.int64()}, "text string, n_chars long")
