"""Main text of web pages, from the standard library's streaming parser.

The parser's events are folded into *lines*, one for each block of text, with the number of tags met
since the last line and the containers around it. The text-to-tag ratio of the lines is smoothed
with a Gaussian and thresholded at its standard deviation; lines above it, link lists aside, are the
seeds. The content region is the innermost container around all of them, or the article or main
element around that, and all its lines belong to it, short ones and lists of links too. Elements that
are menus, footers, forms and the like never make lines, and neither do scripts and styles. Lines of
those that a class or id calls so (sidebars, notices, adverts, comments) are left out, unless one such
name takes most of the page's text: then it doesn't mean what it says.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knitwork.llm.common import give_back

# Elements of HTML by their role, and words by which sites name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("head script style noscript template svg math canvas iframe object applet audio video map nav footer aside form menu dialog button select textarea input label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar widget widgets aside footer header masthead toolbar share sharing social related recommended comment comments commentlist respond reply replies disqus pagination pager copyright disclaimer search skip".split())
#: Of those, what an article element may still be.
NOT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies notice widget".split())
#: Words before which a class or id ends: the rest says what else there is, or isn't.
MODIFIERS = frozenset("has with without no not".split())
#: Last words that make a name a state or a kind of page.
STATES = frozenset("open opened closed collapsed expanded enabled disabled active fixed result results page template layout".split())
#: What the header is of, where it belongs to the article.
OWN_HEADERS = frozenset("article post entry content story".split())
#: Words that may follow such a name without changing what it says.
PARTS = frozenset("area bar block blocks body bottom box button buttons column container content footer group header holder icons inner items left link links list main panel placeholder posts primary right row secondary section slot stories text top unit wrap wrapper zone".split())
#: Names that stay excluded however much text they take.
NEVER_BACK = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr popup modal comment comments commentlist respond reply replies disqus".split())
#: Elements that a new one of the same group ends, if nothing of the second group lies between.
ENDS = {"p": (frozenset(["p"]), frozenset()), "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])), "option": (frozenset(["option"]), frozenset(["select"]))}
_SPLIT = re.compile(r"[^a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Line:
    """at: number of the innermost container around the text."""

    __slots__ = ("text", "tags", "linked", "at")

    def __init__(self, text: str, tags: int, linked: int, at: int):
        self.text, self.tags, self.linked, self.at = text, tags, linked, at


class LineParser(HTMLParser):
    """Folds events into lines. The stack has (tag, container number, excluded). Containers are
    numbered as they open, and each knows the one around it: a line holds one number, however deep
    it is. Container 0 is the page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = [""]
        self.parents: list[int] = [0]
        self.named: dict[int, frozenset[str]] = {}
        self._stack: list[tuple[str, int, bool]] = []
        self._open: Counter = Counter()
        self._parts: list[str] = []
        self._tags = self._linked = self._link = 0

    def _within_article(self) -> bool:
        return self._open["article"] + self._open["main"] > 0

    def _excluded(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        if tag == "header":
            return not self._within_article()
        if not attrs or tag in ("html", "body", "main"):
            return False
        found = dict(attrs)
        if "hidden" in found or found.get("aria-hidden") == "true" or (found.get("role") or "").lower() in ROLES or _HIDDEN.search(found.get("style") or ""):
            return True
        return False

    def _names(self, tag: str, attrs: list[tuple[str, str | None]]) -> frozenset[str]:
        """The words of its class and id by which an element says that it isn't content."""
        if not attrs or tag in ("html", "body", "main"):
            return frozenset()
        found, out = dict(attrs), set()
        for name in f"{found.get('class') or ''} {found.get('id') or ''}".lower().split():
            words = [w for w in _SPLIT.split(name) if w]
            words = words[: next((i for i, w in enumerate(words) if w in MODIFIERS), None)]
            if len(words) > 1 and words[-1] in STATES:
                continue
            while words and words[-1].isdigit():
                words.pop()
            while len(words) > 1 and words[-1] in PARTS - NAMES:
                words.pop()
            # what the name ends in says what the element is: "cookie-notice" is one, "ad-free" isn't
            said = set(words[-1:]) & (NOT_ARTICLES if tag == "article" else NAMES)
            said |= set(words[:-1]) & NAMES if said and tag != "article" else set()
            if len(words) > 1 and words[-1] == "header" and (OWN_HEADERS & set(words) or self._within_article()):
                said.discard("header")
            out |= said
        return frozenset(out)

    def _break(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.lines.append(Line(text, self._tags, self._linked, self._stack[-1][1] if self._stack else 0))
                self._tags = 0
            self._parts, self._linked = [], 0

    def _pop(self, depth: int) -> None:
        if any(n in self.named for _, n, _ in self._stack[depth:]):
            self._break()
        for t, _, _ in self._stack[depth:]:
            self._open[t] -= 1
        del self._stack[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._tags += 1
        if tag == "br":
            self._parts.append(" ")
            return
        block = tag in BLOCKS
        if block:
            self._break()
        if tag in VOID:
            return
        if tag == "a":
            self._link += 1
        if block:
            ended, stop = ENDS.get(tag, ENDS["p"])
            for depth in range(len(self._stack) - 1, -1, -1):
                t = self._stack[depth][0]
                if t in ended:
                    self._pop(depth)
                    break
                if t in stop or t not in ("p", "li", "td", "th", "dd", "dt") and t in BLOCKS:
                    break
        above = bool(self._stack) and self._stack[-1][2]
        out = above or self._excluded(tag, attrs)
        names = frozenset() if out else self._names(tag, attrs)
        if block or out or names:
            if (out or names) and not above:
                self._break()
            number = len(self.kinds)
            if names:
                self.named[number] = names
            self.kinds.append(tag)
            self.parents.append(self._stack[-1][1] if self._stack else 0)
            self._stack.append((tag, number, out))
            self._open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        # in HTML the slash means nothing but on void elements; svg and the like are skipped anyway
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        if tag == "a":
            self._link = max(0, self._link - 1)
        if tag in BLOCKS:
            self._break()
        if not self._open[tag]:
            return
        for depth in range(len(self._stack) - 1, -1, -1):
            if self._stack[depth][0] == tag:
                self._pop(depth)
                return
            if tag not in BLOCKS and self._stack[depth][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if self._stack and self._stack[-1][2]:
            return
        self._parts.append(data)
        if self._link:
            self._linked += len(data)

    def close(self) -> None:
        super().close()
        self._break()


_MARKED = re.compile(r"<!--.*?(?:-->|\Z)|<!\[[^>]*(?:>|\Z)", re.S)


def parse(html: str) -> LineParser:
    """A marked section that the parser can't read is dropped up to its end, as browsers do; comments
    stay comments."""
    drop = lambda m: m.group() if m.group().startswith("<!--") else ""
    for clean in (False, True):
        parser = LineParser()
        try:
            parser.feed(_MARKED.sub(drop, html) if clean else html)
            parser.close()
            return parser
        except AssertionError:
            continue
    return LineParser()


def smooth(ratios: np.ndarray, radius: int = 2) -> np.ndarray:
    """Gaussian of standard deviation ``radius`` over two of them on either side; ends reflect."""
    reach = 2 * radius
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * radius**2))
    padded = np.pad(ratios, reach, mode="reflect" if len(ratios) > reach else "edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def content_lines(parser: LineParser) -> list[Line]:
    """The lines outside what is named as no content; tags met in between count for the next line."""
    none: frozenset[str] = frozenset()
    above = [none]  # of each container the names of all around it; few have any
    for n in range(1, len(parser.kinds)):
        outer = above[parser.parents[n]]
        above.append(outer | parser.named[n] if n in parser.named else outer)
    names = [above[x.at] for x in parser.lines]
    weight: Counter = Counter()
    total = 0
    for line, own in zip(parser.lines, names, strict=True):
        if not own & NEVER_BACK:
            total += len(line.text)
            for w in own:
                weight[w] += len(line.text)
    back = {w for w, size in weight.items() if size > 0.5 * total}
    out, tags = [], 0
    for line, own in zip(parser.lines, names, strict=True):
        tags += line.tags
        if own <= back:
            line.tags, tags = tags, 0
            out.append(line)
    return out


def main_text(html: str | None) -> str:
    """Blocks of the content region in page order, joined by newlines; empty where there is none."""
    parser = parse(html or "")
    lines = content_lines(parser)
    if not lines:
        return ""
    kind, parents = parser.kinds, parser.parents
    listed_in, last = [False], list(range(len(kind)))
    for n in range(1, len(kind)):
        listed_in.append(kind[n] == "li" or listed_in[parents[n]])
    for n in range(len(kind) - 1, 0, -1):  # containers are numbered from the outside in
        last[parents[n]] = max(last[parents[n]], last[n])
    sizes = np.array([len(x.text) for x in lines], float)
    ratios = sizes / np.array([max(x.tags, 1) for x in lines])
    smoothed = smooth(ratios)
    listed = np.array([x.linked >= 0.9 * len(x.text) and listed_in[x.at] for x in lines])
    seeds = smoothed >= min(smoothed.std(), smoothed.max())
    seeds = np.flatnonzero(seeds & ~listed if (seeds & ~listed).any() else seeds)
    # the innermost container around all seeds: it opens no later than any, and ends no earlier
    low, high = min(lines[i].at for i in seeds), max(lines[i].at for i in seeds)
    region = low
    while last[region] < high:
        region = parents[region]
    article = region
    while article and kind[article] not in ("article", "main"):
        article = parents[article]
    while not article and kind[region] in ("p", "li", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6"):
        region = parents[region]
    region = article or region
    if not region or kind[region] in ("html", "body"):
        # nothing marks where the content begins: lists of links above it are menus
        return "\n".join(x.text for i, x in enumerate(lines) if i >= seeds[0] or not listed[i])
    return "\n".join(x.text for x in lines if region <= x.at <= last[region])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row, from the whole html. A null or empty page, and one
    without text, has empty text; null ids and repeated rows are rows like any other; an empty
    table gives no rows; other columns are not read."""

    def rows(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])
        give_back()

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(rows, "page_id long, url string, text string, n_chars long")
