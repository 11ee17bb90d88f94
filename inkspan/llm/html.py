"""HTML extraction (operator 6) by line-block distribution.

Markup is stripped into lines, one for each block of text. A line weighs as much as it has text outside links; a line that is mostly links weighs
nothing, lines inside article or main weigh more, and lines under an element whose names only hint at something else (``search-results``,
``product-review``) weigh less. Weights are summed over a sliding window of WINDOW lines. The page sets the threshold: a share of the mean weight of a
line, lines counted by their weight. Where the sums rise from nothing towards the threshold is a surge point, where they fall to nothing a dive
point; of the stretches between them that reach the threshold, the heaviest is the main text. Stretches beside it that are nearly as heavy, across a
short gap, belong to it. In an article (or main) element the element's ends are the edges, so short lines at them stay.

What the contract names is taken away whatever its weight: menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments, by element, role, class or id. An element is only taken for one of them by a name all of whose parts are known (``ad-slot``, ``comment-list``,
not ``search-algorithms``), and not where it is the wrapper of the page: where it holds the heaviest article, or WRAPPER of all text. What
is taken away inside a text (an advert, a form) leaves a gap too short for a dive point; what ends one (a menu, a footer, comments) a longer one.

Cases: null or empty html, or a page without such text, gives an empty text; repeated rows are extracted alike and kept; an empty table
gives no rows; columns named in ``keep`` pass through; a page of any length is read whole, in one pass over its tags. Unclosed elements end
with the element around them. Where names leave nothing, only elements count."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.llm.common import small_batches, tidy

WINDOW = 3
#: A line with a larger share of its text in links weighs nothing.
LINK_SHARE = 0.6
CORE_WEIGHT = 4.0
HINT_WEIGHT = 0.4
#: Of the mean line's weight: what the sum of a window must reach for a surge.
SURGE_SHARE = 0.2
#: Of the heaviest stretch: what one beside it must weigh to belong to it.
JOIN_SHARE = 0.25
JOIN_LINES = 2 * WINDOW
WRAPPER = 0.8
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?])[^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "xmp", "noembed", "noframes"}
#: Elements that end a text, and such as stand inside one.
ENDING = {"head", "nav", "header", "footer", "menu"}
INSIDE = {"aside", "form", "dialog", "button", "select", "datalist", "fieldset", "audio", "video", "canvas"}
CORE = {"article", "main"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q ruby rp rt s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mspace mstyle mpadded semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Parts of names that name something else than the article, by whether it ends a text.
NAMED_ENDING = set("comment comments commentlist disqus replies reply respond sidebar sidebars menu menus nav navbar navigation navi breadcrumb breadcrumbs pagination pager footer footers masthead topbar related recommended recommendations contentinfo complementary".split())
NAMED_INSIDE = set("ad ads advert adverts advertisement advertisements advertising adbox sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices alert alerts popup popups modal modals overlay newsletter newsletters subscribe subscription signup login share sharing social widget widgets toc search header headers".split())
#: Parts that only hint at it.
HINTS = set("review reviews tag tags byline teaser teasers".split())
#: Parts that may stand beside a name without saying anything of their own.
FILLERS = set("site page main top bottom left right global primary secondary post posts list lists box block bar wrapper wrap container area section module item items link links inner outer content form button buttons icon icons group panel unit slot side mini sticky fixed mobile desktop js the user reader readers body thread head title text".split())
#: Words before a name that say what a page has or lacks, not what the element is.
_SAYS = re.compile(r"(?:has|have|with|without|no|not|is|hide|show)[-_]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@lru_cache(maxsize=4096)
def meaning(word: str) -> str:
    """Of one word of a class, id or role: ending, inside (both name something else than the article), hint, or nothing."""
    if _SAYS.match(word.lower()):
        return ""
    parts = [x.lower() for x in _PARTS.findall(word)]
    names = [x for x in parts if x in NAMED_ENDING or x in NAMED_INSIDE]
    if not names:
        return "hint" if any(x in HINTS for x in parts) else ""
    if all(x in NAMED_ENDING or x in NAMED_INSIDE or x in FILLERS for x in parts):
        return "ending" if any(x in NAMED_ENDING for x in names) else "inside"
    return "hint"


def meaning_of(attributes: str) -> str:
    """The strongest meaning among an element's names; hidden elements are taken away too."""
    best = ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return "inside"
        for word in value.split() if name in ("class", "id", "role") else ():
            found = meaning(word)
            best = found if found == "ending" or found == "inside" and best != "ending" or not best else best
    return best


@dataclass
class Line:
    text: str
    linked: int
    core: int  # number of the nearest article, else main, around it; 0 for none
    marked: tuple[int, ...]  # elements around it that are something else, by number
    hinted: bool

    @property
    def plain(self) -> int:
        """Characters outside links; none where links are most of it."""
        return 0 if self.linked > LINK_SHARE * len(self.text) else len(self.text) - self.linked


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    ending: list[bool] = field(default_factory=list)  # of each marked element
    holder: list[int] = field(default_factory=lambda: [0])  # of each core: what holds it
    held_by: list[tuple[int, ...]] = field(default_factory=lambda: [()])  # of each core: the marked elements around it


def read(page: str, names: bool = True) -> Page:
    """names: roles, classes and ids count, beside elements."""
    out = Page()
    held: list[str] = []
    stack: list[str] = []
    numbers: list[int] = []  # of each open element
    open_: dict[str, int] = {}  # how often each name is on the stack, so that a stray end tag costs no search
    marks: list[tuple[int, int]] = []  # depth and number of open marked elements
    cores: list[tuple[int, int, str]] = []  # depth, number, name
    hints: list[int] = []  # depths
    link = linked = at = count = 0
    lower = None

    def close() -> None:
        nonlocal held, linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            out.lines.append(Line(text, min(linked, len(text)), cores[-1][1] if cores else 0, tuple(k for _, k in marks), bool(hints)))
        held, linked = [], 0

    def drop_to(depth: int) -> None:
        nonlocal link
        for name in stack[depth:]:
            open_[name] -= 1
        del stack[depth:], numbers[depth:]
        if link > depth:
            link = 0
        if marks and marks[-1][0] > depth or cores and cores[-1][0] > depth or hints and hints[-1] > depth:
            close()
            while marks and marks[-1][0] > depth:
                marks.pop()
            while cores and cores[-1][0] > depth:
                cores.pop()
            while hints and hints[-1] > depth:
                hints.pop()

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else n]
        if piece:
            held.append(piece)
            linked += len(piece) if link else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                close()
            if open_.get(tag):
                depth = len(stack) - 1
                while stack[depth] != tag:
                    depth -= 1
                drop_to(depth)
            continue
        if tag in RAW:
            lower = page.lower() if lower is None and len(page.lower()) == n else lower or page
            end = lower.find(f"</{tag}", at)
            end_of = page.find(">", end) if end >= 0 else -1
            at = end_of + 1 if end_of >= 0 else n
            continue
        if tag not in INLINE:
            close()
        if tag in VOID or m[3].endswith("/") and tag not in INLINE and tag not in ENDING and tag not in INSIDE:
            continue
        if tag == "body" and open_.get("head"):  # a head left open
            drop_to(stack.index("head"))
        stack.append(tag)
        count += 1
        numbers.append(count)
        open_[tag] = open_.get(tag, 0) + 1
        named = meaning_of(m[3]) if names and m[3] and tag not in ("html", "body") else ""
        away = "ending" if tag in ENDING or named == "ending" else "inside" if tag in INSIDE or named == "inside" else ""
        if tag == "header" and cores:  # the title of the article
            away = named if named != "hint" else ""
        if away:
            close()
            marks.append((len(stack), len(out.ending)))
            out.ending.append(away == "ending")
        elif named == "hint":
            close()
            hints.append(len(stack))
        if tag in CORE and not away:  # not one that is named as a comment, say
            close()
            if tag == "article" or not any(name == "article" for _, _, name in cores):
                cores.append((len(stack), len(out.holder), tag))
                out.holder.append(numbers[-2] if len(numbers) > 1 else 0)
                out.held_by.append(tuple(k for _, k in marks))
        if tag == "a" and not link:
            link = len(stack)
    close()
    return out


def taken_away(page: Page) -> set[int]:
    """The marked elements that are no wrapper of the page."""
    every = sum(x.plain for x in page.lines)
    inside, by_core = [0] * len(page.ending), [0] * len(page.holder)
    for x in page.lines:
        for k in x.marked:
            inside[k] += x.plain
        if x.core and x.marked == page.held_by[x.core]:
            by_core[x.core] += x.plain
    best = max(range(len(by_core)), key=lambda k: (by_core[k], -k))
    wraps = set(page.held_by[best]) if by_core[best] else {k for k, plain in enumerate(inside) if every and plain >= WRAPPER * every}
    return set(range(len(inside))) - wraps


def weighed(page: Page, away: set[int]) -> list[tuple[float, Line | None]]:
    """The lines in page order with their weights; gaps are lines of weight 0 without text."""
    out: list[tuple[float, Line | None]] = []
    core, gap = 0, 0
    for x in page.lines:
        gone = [k for k in x.marked if k in away]
        if gone:
            gap = max(gap, WINDOW if any(page.ending[k] for k in gone) else 1)
            continue
        if x.core != core:
            gap = WINDOW
        out.extend([(0.0, None)] * gap)
        core, gap = x.core, 0
        out.append((x.plain * (CORE_WEIGHT if x.core else 1.0) * (HINT_WEIGHT if x.hinted else 1.0), x))
    return out


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the lines between surge and dive points, in order."""
    if not weights.any():
        return []
    sums = np.convolve(weights, np.ones(WINDOW))[WINDOW - 1 :]  # of each line and the next ones
    threshold = SURGE_SHARE * float(weights @ weights / weights.sum())
    rising = np.concatenate([[0], (sums > 0).astype(np.int8), [0]])
    surges, dives = np.flatnonzero(np.diff(rising) == 1), np.flatnonzero(np.diff(rising) == -1)
    found = []
    for a, b in zip(surges, dives, strict=True):
        if sums[a:b].max() >= threshold:
            heavy = np.flatnonzero(weights[a:b])
            found.append((int(a + heavy[0]), int(a + heavy[-1] + 1)))
    return found


def main_text(page: str | None) -> str:
    return _between(read(page or "")) or _between(read(page or "", names=False))


def _between(page: Page) -> str:
    lines = weighed(page, taken_away(page))
    weights = np.array([w for w, _ in lines], float)
    found = stretches(weights)
    if not found:
        return ""
    heavy = [float(weights[a:b].sum()) for a, b in found]
    k = max(range(len(found)), key=lambda i: (heavy[i], -i))
    first, end = found[k]
    core = lines[first][1].core
    if core:  # the element's edges, and those of others beside it that are nearly as heavy
        by_core = np.zeros(len(page.holder))
        for w, x in lines:
            if x:
                by_core[x.core] += w
        cores = {c for c in range(1, len(by_core)) if page.holder[c] == page.holder[core] and by_core[c] >= JOIN_SHARE * by_core[core]} | {core}
        return " ".join(x.text for _, x in lines if x and x.core in cores)
    for step in (-1, 1):
        i = k + step
        while 0 <= i < len(found):
            a, b = found[i]
            far = first - b if step < 0 else a - end
            if far > JOIN_LINES or heavy[i] < JOIN_SHARE * heavy[k] or lines[a][1].core:
                break
            first, end = min(first, a), max(end, b)
            i += step
    return " ".join(x.text for _, x in lines[first:end] if x)


@tidy
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*batch.schema.names[:-1], "text", "n_chars"])


def extract(df: DataFrame, page: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep..., text (string), n_chars (long)."""
    small_batches(df.sparkSession)
    source = df.select(*(df[c].alias(f"k{i}") for i, c in enumerate(keep)), df[page].alias("html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(_extract, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "text", "n_chars")
