"""HTML extraction by tag-path ratios.

A page is cut into its text nodes, each with its root-to-leaf tag path (tags with their first class). For each path the
text length, punctuation and node count, and what lies in links, are added up over the page. A path's ratios are text
and punctuation for each node; they are smoothed over neighbouring paths in page order, fused by their product and
compared with a share of the page's highest. A class or id that names adverts, notices, comments and the like lowers
the score of what is below it, but not around the page's best text. The element that holds most of the passing text (the
article, where the page marks one) is the container: its other paths, lists, tables and code with few words as they
are, belong to the text too unless they are lowered or mostly links. What lies outside goes, but for headings before
passing text.

Before that, text is out below navigation, headers, footers, asides, forms, scripts, styles and the like (by tag or
role, never by name), unless they are around the page's article (the first ``main``, else the ``article`` with the most
text); with an article, what isn't below ``article`` or ``main`` is out.

Text: character references are decoded by text node, white space inside a block becomes one space, blocks are trimmed and
joined by one line break in page order, empty ones left out. Nothing is cut or capped. One page is one row's work, and
that grows with the page's length, whatever its markup: paths are numbers, and what holds for an element is handed down
to those inside. No shuffle.

Defined results: a null or empty page gives an empty text; of broken markup, open elements reach to the page's end, an
open quote ends with its tag, and a tag without an end takes what is left; very long pages are read whole; rows with null
ids stay; repeated rows are extracted alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML's own classes of elements.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("head nav header footer aside form script style noscript template iframe svg button select option textarea title menu dialog math object".split())
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tbody", "tbody": "thead tbody"}
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HOLDERS = frozenset("article body center div main section td".split())
# Names of classes and ids: those that count as a part of a name too, and those that count alone.
OUT_PARTS = "ads? advert\\w* adbox banner sponsor\\w* promo\\w* cookies? consent notices? popup modal newsletter subscribe sidebar menu nav\\w* breadcrumbs? footer masthead comments? feedback responses? reactions? discussion gdpr disqus login signup pagination".split()
OUT_WHOLE = "side toolbar share sharing social related recommended recommendations replies respond search pager widget".split()
OUT_NAMES = re.compile(rf"(?:^|[\s_-])(?:{'|'.join(OUT_PARTS)})(?:$|[\s_-])|(?:^|\s)(?:{'|'.join(OUT_WHOLE)})(?:$|\s)", re.IGNORECASE)

NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
PUNCTUATION = frozenset(".,;:!?…。，、！？¿¡")
SHARE = 0.05  # of the page's highest score
LOWERED = 0.02  # what a name leaves of a score
MOST = 0.5  # of the passing text, in its container
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert".split())


class Element:
    """An element: its parent, tag, tag path (a number), and whether tag or role, or class or id, put it out."""

    __slots__ = ("bad", "named", "parent", "path", "tag")

    def __init__(self, parent: Element | None, tag: str, path: int, bad: bool, named: bool) -> None:
        self.parent, self.tag, self.path, self.bad, self.named = parent, tag, path, bad, named


class Page:
    """A page's elements, its tag paths and its text nodes, read in one pass."""

    def __init__(self, html: str) -> None:
        self.elements: list[Element] = []  # parents before children
        self.texts: list[tuple[int, Element | None, str]] = []  # block number, element, decoded text
        self.numbers: dict[tuple[int, str], int] = {}  # (parent's path, label) -> path; 0 is the root
        self.parents, self.tags = [0], [""]  # by path
        self._read(html)

    def path(self, parent: int, label: str, tag: str) -> int:
        n = self.numbers.setdefault((parent, label), len(self.parents))
        if n == len(self.parents):
            self.parents.append(parent)
            self.tags.append(tag)
        return n

    def _read(self, html: str) -> None:
        stack: list[Element] = []
        standing: Counter[str] = Counter()  # open elements by tag
        at, pos, block = 0, 0, 0

        def text(to: int) -> None:
            if to > at:
                self.texts.append((block, stack[-1] if stack else None, entities.unescape(html[at:to])))

        def close(tag: str, within: str = "") -> None:
            nonlocal block
            if not standing[tag]:
                return
            stop = within.split()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].tag == tag:
                    block += any(e.tag in BLOCK for e in stack[i:])
                    for e in stack[i:]:
                        standing[e.tag] -= 1
                    del stack[i:]
                    return
                if stack[i].tag in stop:
                    return

        while (pos := html.find("<", pos)) >= 0:
            if html.startswith("<!--", pos):
                end = html.find("-->", pos + 4)
                text(pos)
                at = pos = end + 3 if end >= 0 else len(html)
                continue
            m = NAME.match(html, pos)
            if not m and html[pos + 1 : pos + 2] not in ("!", "?"):
                pos += 1  # a lone sign
                continue
            rest = REST.match(html, m.end()) if m else None
            # an open quote ends with the tag; a tag without an end takes what is left of the page
            end = rest.end() if rest else html.find(">", pos) + 1
            text(pos)
            if not end:
                at = len(html)
                break
            start, at, pos = pos, end, end
            if not m:
                continue
            tag = m[2].lower()
            if m[1]:
                close(tag)
                continue
            for old in CLOSES.get(tag, "").split():
                close(old, "ul ol dl table" if tag != "p" else "td th li article section div body")
            if tag in ENDS_P:
                close("p", "td th li article section div body")
            if tag in BLOCK or tag == "br":
                block += 1
            if tag in VOID or html[end - 2] == "/":
                continue
            names = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(html, m.end(), end)} if end - start > len(tag) + 2 else {}
            label = f"{names.get('class', '')} {names.get('id', '')}".strip()
            named = bool(label and OUT_NAMES.search(label)) and tag not in ("html", "body", "article", "main")
            bad = tag in OUT or names.get("role", "").lower() in OUT_ROLES
            parent = stack[-1] if stack else None
            number = self.path(parent.path if parent else 0, f"{tag}.{label.split()[0]}" if label else tag, tag)
            if tag in RAW:  # up to its end tag, or to the page's
                found = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, pos)
                at = pos = found.end() if found else len(html)
                continue
            e = Element(parent, tag, number, bad, named)
            self.elements.append(e)
            stack.append(e)
            standing[tag] += 1
        if at < len(html):
            text(len(html))

    def below(self, mark: Callable[[Element], bool]) -> dict[Element | None, bool]:
        """For each element, whether it or one around it is marked."""
        out: dict[Element | None, bool] = {None: False}
        for e in self.elements:
            out[e] = out[e.parent] or mark(e)
        return out

    def around(self, e: Element | None) -> set[Element]:
        out: set[Element] = set()
        while e is not None:
            out.add(e)
            e = e.parent
        return out


Text = tuple[int, "Element | None", str]


def _path(e: Element | None) -> int:
    return e.path if e else 0


def _fused(page: Page, found: list[Text]) -> tuple[dict[int, float], dict[int, float]]:
    """The smoothed, fused ratio of each path that has text, and the share of its text that lies in links."""
    linked = [False]
    for n in range(1, len(page.parents)):
        linked.append(linked[page.parents[n]] or page.tags[n] == "a")
    stats: dict[int, list[float]] = {}
    for _, e, raw in found:
        plain = raw.strip()
        if plain:
            s = stats.setdefault(_path(e), [0, 0, 0, 0])
            s[0] += len(plain)
            s[1] += sum(map(plain.count, PUNCTUATION))
            s[2] += 1
            s[3] += len(plain) if linked[_path(e)] else 0
    if not stats:
        return {}, {}
    v = np.array(list(stats.values()), np.float64)
    k = np.array([0.25, 0.5, 0.25])
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), k, "valid")
    fused = smooth(v[:, 0] / v[:, 2]) * smooth((v[:, 1] + 1) / v[:, 2]) * (1 - v[:, 3] / v[:, 0])
    return dict(zip(stats, fused.tolist(), strict=True)), dict(zip(stats, (v[:, 3] / v[:, 0]).tolist(), strict=True))


def _in_question(page: Page) -> tuple[list[Text], Element | None]:
    """The text nodes that no tag or role puts out, and the element that the page marks as its article."""
    main = next((e for e in page.elements if e.tag == "main"), None)
    if main is None:
        weight: dict[Element, int] = {e: 0 for e in page.elements if e.tag == "article"}
        nearest: dict[Element | None, Element | None] = {None: None}
        for e in page.elements:
            nearest[e] = e if e.tag == "article" else nearest[e.parent]
        for _, e, raw in page.texts:
            if nearest[e]:
                weight[nearest[e]] += len(raw.strip())
        for e in reversed(list(weight)):
            if outer := nearest[e.parent]:
                weight[outer] += weight[e]
        main = max(weight, key=weight.__getitem__, default=None) if any(weight.values()) else None
    free = page.around(main.parent) if main else set()
    bad = page.below(lambda e: e.bad and e not in free)
    found = [x for x in page.texts if not bad[x[1]]]
    if main:
        inside = page.below(lambda e: e.tag in ("article", "main"))
        found = [x for x in found if inside[x[1]]]
    return found, main


def _container(page: Page, core: list[Text]) -> Element | None:
    """The innermost element that holds most of the text of ``core``; None for the page."""
    weight = dict.fromkeys(page.elements, 0)
    for _, e, raw in core:
        if e is not None:
            weight[e] += len(raw.strip())
    for e in reversed(page.elements):
        if e.parent is not None:
            weight[e.parent] += weight[e]
    total = sum(len(raw.strip()) for _, _, raw in core)
    held = [e for e in page.elements if weight[e] >= MOST * total and e.tag in HOLDERS]
    return held[-1] if held else None  # of nested elements the inner one comes later; two apart can't both hold most


def _content(page: Page, found: list[Text], main: Element | None) -> list[Text]:
    """The text nodes of the paths whose ratios pass, and of their container's other paths that aren't lists of links."""
    fused, links = _fused(page, found)
    if not fused:
        return []
    kept = page.around(main) if main else set()
    named = page.below(lambda e: e.named and e not in kept)
    best = max((x for x in found if x[2].strip()), key=lambda x: fused[_path(x[1])] * (LOWERED if named[x[1]] else 1))
    kept |= page.around(best[1])  # a name around the best text isn't about what isn't content
    named = page.below(lambda e: e.named and e not in kept)
    score = lambda e: fused.get(_path(e), 0.0) * (LOWERED if named[e] else 1)
    limit = SHARE * max(*(score(x[1]) for x in found), 1e-9)
    core = [x for x in found if x[2].strip() and score(x[1]) >= limit]
    inside = page.below(lambda e, holder=main or _container(page, core): e is holder)
    whole = not any(inside.values())
    heading = page.below(lambda e: e.tag in HEADINGS)

    def passes(e: Element | None) -> bool:
        here = inside[e] or whole or main is not None
        return here and (score(e) >= limit or (not named[e] and (inside[e] or whole) and _path(e) in links and links[_path(e)] <= 0.5))

    chosen = {e: passes(e) for _, e, _ in found}
    # a heading, short as it is, goes with the text below it, from outside the container too
    body = None
    for _, e, raw in reversed(found):
        if raw.strip():
            if not heading[e]:
                body = e
            elif body is not None and chosen[body] and not named[e]:
                chosen[e] = True
    # inline children (b, i, a ...) of a content block belong to its text, and so does white space

    def holds(e: Element | None) -> bool:
        while e is not None and not chosen.get(e, False) and e.tag not in BLOCK:
            e = e.parent
        return chosen.get(e, False)

    return [x for x in found if holds(x[1])]


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = Page(html)
    blocks: dict[int, list[str]] = {}
    for block, _, raw in _content(page, *_in_question(page)):
        blocks.setdefault(block, []).append(raw)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
