"""Main text of web pages by line-block distribution: where text lengths over sliding line windows surge, and where they dive."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements whose content is no text; those that stand outside an article; those that begin a new line; of these
#: those in which a line of links is still prose; those that hold other blocks; and of these those whose border leaves an empty line.
RAW = "script style noscript template iframe object svg math canvas audio video textarea title xmp noembed noframes".split()
ASIDE = set("nav footer aside form menu dialog select button fieldset datalist header search".split())
LINES = set(
    "p div h1 h2 h3 h4 h5 h6 li ul ol dl dt dd table tr thead tbody tfoot caption section article blockquote pre figure figcaption"
    " hr main header footer nav aside address details summary center form body html hgroup search menu dialog fieldset".split()
)
PROSE = set("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption summary pre blockquote".split())
BOXES = set("div section article main header footer nav aside form menu dialog select button fieldset datalist search center ul ol dl table blockquote figure details hgroup".split())
STEPS = set("div section article main header footer nav aside form menu dialog fieldset search center".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Words whose tokens in a box's class, id or role name such places, and words that may stand beside them in one token.
HINTS = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu submenu"
    " breadcrumb breadcrumbs sidebar side aside footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe"
    " subscription signup share sharing social comment comments commentlist respond replies disqus related recommended recommendations widget login search"
    " toolbar masthead copyright pagination pager contentinfo complementary hidden topbar header tags disclaimer outbrain taboola".split()
)
BESIDE = set(
    "site page block box wrapper wrap container list section area bar top bottom left right inner outer main content group panel row col column links link"
    " item items global primary secondary mobile desktop fixed sticky text body title unit slot zone module component view thread holder the and of to us".split()
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[\s/>])[^>]*+(?:>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>(?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass(slots=True)
class Box:
    """An element that holds blocks: its place in the page, and what its lines add up to."""

    name: str
    parent: int
    hints: frozenset[str]
    unseen: bool
    closed: bool = False
    head: bool = False  # holds a first heading, an article or a main element
    lines: int = 0
    size: int = 0
    linked: int = 0
    links: int = 0
    listed: bool = False  # holds items of a list


@dataclass(slots=True)
class Line:
    text: str
    linked: int  # characters within links
    links: int
    box: int
    prose: bool
    crossed: list[int] = field(default_factory=list)  # boxes that began or ended since the line before


@lru_cache(100_000)
def hints_of(attrs: str) -> frozenset[str]:
    """The hint words of those tokens of class, id and role that hold no other word but such as may stand beside them."""
    found: set[str] = set()
    for match in _NAMED.finditer(attrs):
        for token in (match[1] or match[2] or match[3] or "").split():
            words = {w for w in _WORD.findall(_CAMEL.sub(" ", token).lower()) if len(w) > 1}
            if words & HINTS and words <= HINTS | BESIDE:
                found |= words & HINTS
    return frozenset(found)


def to_lines(html: str) -> tuple[list[Box], list[Line]]:
    """The page without markup as lines, a line per block, and the boxes in which they lie (box 0: the page)."""
    boxes, lines = [Box("", -1, frozenset(), False, True)], []
    stack, open_ = [0], dict.fromkeys(BOXES, 0)
    text: list[str] = []
    crossed: list[int] = []
    linked = links = at = 0
    link = prose = False

    def close() -> None:
        nonlocal linked, links
        line = " ".join(unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append(Line(line, min(linked, len(line)), links, stack[-1], prose, crossed.copy()))
            crossed.clear()
        linked = links = 0

    def add(piece: str) -> None:
        nonlocal linked
        text.append(piece)
        if link:
            linked += len(piece.strip())

    for tag in _TAG.finditer(html):
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        name, ends = (tag["name"] or "").lower(), bool(tag["end"])
        if not name:
            continue
        if name == "br" or name in ("td", "th"):
            text.append(" ")
        elif name == "a":
            link = not ends
            links += link
        if name in LINES or name in BOXES:
            close()
            link, prose = False, name in PROSE and not ends
        if name == "h1" and not ends:
            boxes[stack[-1]].head = True
        if name not in BOXES:
            continue
        if not ends:
            attrs = tag["attrs"]
            boxes.append(Box(name, stack[-1], hints_of(attrs), bool(attrs and _UNSEEN.search(attrs)), head=name in ("article", "main")))
            stack.append(len(boxes) - 1)
            open_[name] += 1
            crossed.append(stack[-1])
        elif open_[name]:
            while True:
                last = stack.pop()
                open_[boxes[last].name] -= 1
                # what was never closed ends with the box around it, but not with an article
                boxes[last].closed = boxes[last].name == name or name not in ("article", "main")
                crossed.append(last)
                if boxes[last].name == name:
                    break
    add(html[at:])
    close()
    for line in lines:
        box = boxes[line.box]
        box.lines, box.size, box.linked, box.links = box.lines + 1, box.size + len(line.text), box.linked + line.linked, box.links + line.links
    for box in reversed(boxes[1:]):  # a box comes after the one that holds it
        outer = boxes[box.parent]
        outer.lines, outer.size, outer.linked, outer.links = outer.lines + box.lines, outer.size + box.size, outer.linked + box.linked, outer.links + box.links
        outer.head |= box.head and not (box.hints and box.name == "article")
        outer.listed |= box.listed or box.name in ("ul", "ol")
    return boxes, lines


def places(boxes: list[Box], surge: int) -> tuple[list[bool], list[int]]:
    """For each box, whether it is a menu, header, footer, sidebar, notice, advert, form or comment section or lies in one; and the outermost article or
    main element around it that isn't (0: none).

    An element's name tells it, or a hint in a div or list, which never counts alone: not in a section, nor in a box that holds the
    page's heading or article, and not in one that holds over half of the page's text, if that text is itself a surge.
    """
    total = boxes[0].size
    out, marked, hinted = [False] * len(boxes), [0] * len(boxes), [False] * len(boxes)
    for i, box in enumerate(boxes[1:], 1):
        above = hinted[box.parent]
        hinted[i] = above or box.name in ("article", "main")
        most = 2 * box.size > total and box.size >= surge
        own = box.unseen
        if box.name in ASIDE:
            own |= box.closed and not (box.name == "header" and above) and not (box.name in ("form", "fieldset") and (most or box.head))
        elif hints := box.hints - ({"header", "tags"} if above else set()):
            plain = box.name in ("blockquote", "figure", "details", "table", "main") or box.name == "section" and above
            own |= not most if box.name == "article" else not (plain or box.head or most and not boxes[0].head)
        out[i] = out[box.parent] or own
    kind = next((k for k in ("article", "main") if any(b.name == k and b.size and not out[i] for i, b in enumerate(boxes))), "")
    for i, box in enumerate(boxes[1:], 1):
        marked[i] = marked[box.parent] or (i if box.name == kind and not out[i] else 0)
    return out, marked


@dataclass(slots=True)
class Stretch:
    """The lines from a surge to a dive (numbers of lines), their weight, and whether it reaches the surge."""

    lines: list[int]
    weight: int
    strong: bool


def stretches(lines: list[Line], boxes: list[Box], out: list[bool], window: int, surge: int) -> list[Stretch]:
    """What lies between the dives of the line-block distribution: sums of text over ``window`` lines.

    A line weighs its text, linked text a tenth; lines that are ``out`` and rows of links weigh nothing. The border of a box of several lines is two empty lines, and one
    more for each box that begins or ends there. A stretch is strong if the sum of a window rises to ``surge``, or to half of the greatest sum if that is less.
    """
    slots: list[tuple[int, int]] = []
    for k, line in enumerate(lines):
        n, linked = len(line.text), line.linked
        weight = 0 if out[line.box] or not line.prose and line.links > 1 and 5 * linked >= 4 * n else n - linked + linked // 10
        crossed = sum(boxes[c].lines > 1 and boxes[c].name in STEPS for c in line.crossed) if k else 0
        slots += [(0, -1)] * (crossed and crossed + 2) + [(weight, k)]
    sums = [sum(w for w, _ in slots[i : i + window]) for i in range(len(slots))]
    rise = min(surge, (max(sums, default=0) + 1) // 2)
    found: list[Stretch] = []
    begin = None
    for i, total in enumerate([*sums, 0]):
        if begin is None and total and slots[i][0]:
            begin = i
        elif begin is not None and not total:
            inside = slots[begin:i]
            found.append(Stretch([k for _, k in inside if k >= 0], sum(w for w, _ in inside), max(sums[begin:i]) >= rise))
            begin = None
    return found


def main_text(html: str | None, window: int = 3, surge: int = 86) -> str:
    """The main stretch of the line-block distribution, widened to the box that it fills, its lines joined by line feeds.

    Of the ``stretches`` in which text surges, those that lie in a marked article go first, then the heaviest is the main one. Its home is the box around its lines; a
    marked article around it widens the home to itself, and so does each box further out of which every line is in a strong stretch (an article in
    sections). Of the home's lines those that are ``places`` out go; menus, boxes of several lines that are links without being a list, go; what else
    lies in the home stays, but for weaker stretches beside the main one in a home that nothing marks. What lies outside goes: notices, comments and
    teasers, by whatever name.
    """
    if not html:
        return ""
    boxes, lines = to_lines(html)
    out, marked = places(boxes, surge)
    found = stretches(lines, boxes, out, window, surge)
    strong = [s for s in found if s.strong]
    if not strong:
        return ""
    main = max(strong, key=lambda s: (any(marked[lines[k].box] for k in s.lines), s.weight))
    last, region = _tree(boxes)
    own = home = _around(boxes, last, [lines[k].box for k in main.lines])
    article = max((marked[lines[k].box] for k in main.lines), key=lambda box: (box > 0, boxes[box].size))
    firm = {k for s in strong if 7 * s.weight >= main.weight for k in s.lines}
    if article:
        home = article
    else:
        weak = [0] * len(boxes)
        for k, line in enumerate(lines):
            weak[line.box] += k not in firm
        for i in range(len(boxes) - 1, 0, -1):
            weak[boxes[i].parent] += weak[i]
        while home and not weak[boxes[home].parent]:
            home = boxes[home].parent
    inside = [home <= line.box <= last[home] for line in lines]
    regions = {region[lines[k].box] for k in main.lines}
    wide = {k for k in {*main.lines, *(firm if home != own else ())} if inside[k]}
    low, high = min(wide), max(wide)
    kept = []
    for k, line in enumerate(lines):
        here = region[line.box]
        if out[line.box] or not inside[k]:
            continue
        menu = here not in regions and boxes[here].links > 1 and 5 * boxes[here].linked >= 4 * boxes[here].size and not boxes[here].listed
        beside = here in regions and (home > 0 or 2 * line.linked <= len(line.text))
        if k in wide or not menu and (article or beside or low < k < high):
            kept.append(line.text)
    return "\n".join(kept)


def _tree(boxes: list[Box]) -> tuple[list[int], list[int]]:
    """For each box the last box inside it, and the innermost box around it that leaves a border (0: the page)."""
    last, region = list(range(len(boxes))), [0] * len(boxes)
    for i in range(len(boxes) - 1, 0, -1):  # a box comes after the one that holds it
        last[boxes[i].parent] = max(last[boxes[i].parent], last[i])
    for i, box in enumerate(boxes[1:], 1):
        region[i] = i if box.name in STEPS and box.lines > 1 else region[box.parent]
    return last, region


def _around(boxes: list[Box], last: list[int], of: list[int]) -> int:
    """The innermost box that holds all of these boxes."""
    home, lowest, highest = of[0], min(of), max(of)
    while not home <= lowest <= highest <= last[home]:
        home = boxes[home].parent
    return home


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars), one per row of ``pages(page_id, url, html)``; a page without main text has text ''.

    A null or empty html gives ''. Character references are decoded; white space within a line becomes one space. Very long pages are read
    whole, in linear time. Repeated rows and null ids or urls come back as they are; other columns are ignored, whatever their names; an empty table
    gives an empty result.
    """

    def extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(html) for html in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInPandas(extracted, "page_id long, url string, text string, n_chars long")
