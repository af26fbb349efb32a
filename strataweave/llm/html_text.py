"""Main text of web pages: parser events, text-to-tag ratios, smoothing and clustering.

The standard library's parser streams a page's events into lines, one for each block of text,
each within the containers (page, body, div, section, cell, article, main) that are open. A line's
ratio is its characters outside links per tag seen since the line before. Ratios are smoothed with
a Gaussian over neighbouring lines and split at a threshold by two-means clustering; lines above
it vote, by their characters outside links. From the page on, the container that holds at least
``SHARE`` of the votes is entered again and again; an article or main element is entered but not
gone into, so its title and short paragraphs stay. Where that ends is the content region; titles
right before it belong to it. Of the region all lines are taken, but for those in containers
without any vote that are links for the most part.

Furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) has ratio 0, no
vote, and is never taken: elements that say so by their name or role, and elements one of whose
class or id tokens is made of such words alone (``ad``, ``cookie-notice``, ``comment-list``, not
``notice-period``). Words for teasers (``related``) only count outside of articles.

A null, empty or furniture-only page gives an empty text. Broken markup never fails: end
tags without a start are ignored, unclosed elements end with their container. Columns besides
page_id, url and html are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame

from .common import bounded_batches, read

SIGMA = 1.5
_kernel = [2.718281828459045 ** (-(d * d) / (2 * SIGMA * SIGMA)) for d in range(5)]

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template iframe svg math canvas object audio video head title select textarea button datalist".split())
FURNITURE = frozenset("nav aside footer form menu dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
#: Words of class and id tokens that mark furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion nav navbar navigation menu menubar submenu topnav "
    "breadcrumb breadcrumbs pagination pager sidebar aside widget widgets footer foot colophon masthead topbar header banner "
    "cookie cookies consent gdpr notice notices disclaimer alert popup modal overlay newsletter subscribe subscription signup login signin share sharing "
    "social comment comments commentlist reply replies respond discussion disqus search toolbar copyright".split()
)
TEASERS = frozenset("related recommended recommendations teaser teasers morestories trending popular".split())
#: Words that say nothing of what an element holds.
NEUTRAL = frozenset(
    "area bar block body bottom box btn button center col column container content details group inner item items left link links list main "
    "outer page panel right row section site slot text title top unit wrap wrapper".split()
)
#: Containers of lines, and the share of the votes that a container must hold to be entered.
HOLDERS, SHARE = frozenset("div section td body article main".split()), 0.75
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCKS - {"html", "body"}


def _marked(value: str | None, marks: frozenset) -> bool:
    """Is one of the tokens made of ``marks`` (one at least), neutral words and numbers alone?"""
    for token in re.sub(r"([a-z])([A-Z])", r"\1-\2", value or "").lower().split():
        parts = [x for x in re.split(r"[^a-z]+", token) if x]
        if token in marks or any(x in marks for x in parts) and all(x in marks or x in NEUTRAL for x in parts):
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, characters in links, tags before it, container, furniture?, title?) for each block of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool, bool]] = []
        #: Open elements: name, furniture?, silent?, container number.
        self.open: list[tuple[str, bool, bool, int]] = []
        self.parts: list[str] = []
        self.linked = self.tags = self.links = 0
        #: Name and parent of each container; a parent comes before its children.
        self.containers: list[tuple[str, int]] = [("page", 0)]

    def _at(self) -> tuple[bool, bool, int]:
        return self.open[-1][1:] if self.open else (False, False, 0)

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        furniture, _, container = self._at()
        if text:
            title = any(x[0] in TITLES for x in self.open[-3:])
            self.lines.append((text, self.linked, self.tags, container, furniture, title))
            self.tags = 0
        self.parts, self.linked = [], 0

    def _furniture(self, tag: str, attrs) -> bool:
        if tag in FURNITURE:
            return True
        within = any(x[0] in ("article", "main") for x in self.open)
        if tag == "header":
            return not within
        for name, value in attrs:
            if name in ("class", "id"):
                if tag not in ("html", "body", "main") and (_marked(value, MARKS) or not within and _marked(value, TEASERS)):
                    return True
            elif name == "role":
                if value in ROLES:
                    return True
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                return True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value or ""):
                return True
        return False

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
            if tag in CLOSES_P:
                self._close("p", stop=CLOSES_P - {"p"})
            if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
                self._close(tag, stop=frozenset(("ul", "ol", "dl", "table", "select")))
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID:
            return
        furniture, silent, container = self._at()
        furniture = furniture or self._furniture(tag, attrs)
        silent = silent or tag in SILENT
        name = "article" if tag == "main" or dict(attrs).get("role") in ("main", "article") else tag
        if name in HOLDERS:
            self.containers.append((name, container))
            container = len(self.containers) - 1
        self.links += tag == "a"
        self.open.append((tag, furniture, silent, container))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def _close(self, tag: str, stop: frozenset = frozenset()) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self.links -= sum(x[0] == "a" for x in self.open[k:])
                del self.open[k:]
                return
            if self.open[k][0] in stop:
                return

    def handle_endtag(self, tag):
        self.tags += 1
        if tag in VOID:
            return
        if tag in BLOCKS:
            self._end_line()
            self._close(tag)
        else:
            self._close(tag, stop=BLOCKS)

    def handle_data(self, data):
        if not self._at()[1]:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def unknown_decl(self, data):
        pass


def lines_of(html: str) -> Lines:
    parser = Lines()
    try:
        parser.feed(html)
        parser.close()
    except AssertionError:  # a malformed marked section
        parser = Lines()
        parser.feed(html.replace("<![", "&lt;!["))
        parser.close()
    parser._end_line()
    return parser


def smoothed(ratios: list[float]) -> list[float]:
    n, out = len(ratios), []
    for i in range(n):
        total = weight = 0.0
        for j in range(max(0, i - 4), min(n, i + 5)):
            k = _kernel[abs(i - j)]
            total += k * ratios[j]
            weight += k
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """The midpoint of two means; 0 where the values don't differ."""
    low, high = min(values), max(values)
    for _ in range(20):
        cut = (low + high) / 2
        under, over = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not under or not over:
            return 0.0
        new = sum(under) / len(under), sum(over) / len(over)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def region(parsed: Lines, votes: list[int]) -> int:
    """The container to take, for the votes of each line."""
    held = [0] * len(parsed.containers)
    for x, n in zip(parsed.lines, votes):
        held[x[3]] += n
    children: list[list[int]] = [[] for _ in held]
    for c in range(len(held) - 1, 0, -1):
        parent = parsed.containers[c][1]
        held[parent] += held[c]
        children[parent].append(c)
    at = 0
    while parsed.containers[at][0] != "article":
        inner = max(children[at], key=lambda c: (held[c], -c), default=None)
        if inner is None or held[inner] < SHARE * held[0] or not held[inner]:
            break
        at = inner
    return at


def main_text(html: str | None) -> str:
    parsed = lines_of(html or "")
    lines = parsed.lines
    if all(x[4] for x in lines):
        return ""
    ratios = smoothed([0.0 if x[4] else max(0, len(x[0]) - x[1]) / max(1, x[2]) for x in lines])
    cut = threshold(ratios)
    votes = [0 if x[4] or r < cut else len(x[0]) - x[1] for x, r in zip(lines, ratios)]
    at = region(parsed, votes)
    inside, voted = {at}, {x[3] for x, n in zip(lines, votes) if n}
    for c in range(at + 1, len(parsed.containers)):
        if parsed.containers[c][1] in inside:
            inside.add(c)
    for c in range(len(parsed.containers) - 1, at, -1):
        if c in voted:
            voted.add(parsed.containers[c][1])
    taken = [not x[4] and x[3] in inside and (x[3] in voted or 2 * x[1] <= len(x[0])) for x in lines]
    # Titles right before the region.
    k = taken.index(True) - 1 if True in taken else -1
    while k >= 0 and lines[k][5] and not lines[k][4]:
        taken[k] = True
        k -= 1
    return "\n".join(x[0] for x, t in zip(lines, taken) if t)


def _extract(batches):
    import pyarrow as pa

    for batch in batches:
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    bounded_batches(pages.sparkSession)
    rows = pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html")
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def op6_html(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
