"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element.  Text lengths are summed over a sliding
window of lines; a region begins where the sum surges and ends where it dives to nothing.  Nothing
are the lines of menus (``window`` or more short lines in a row that are links and nothing else) and the
gaps that parts leave which are marked as something else than the article (by element, or by a whole
token of class, role or id) and are cut: a marked part is cut unless it holds more than half of the page's text
and that is not mostly links (reader comments: unless less than ``surge`` characters are outside of them).  Text
between surge and dive is kept: the region with the most text, every other whose window sum
reaches ``surge``, and the short ones that share a container with a kept one.

Article and main elements are weights: the largest and those with a quarter of its text are taken
alone, unless the largest region outside of them has more text and ``surge`` characters.  A marked part does not cut the largest article in it.

End tags that HTML leaves out (p, li, dt, dd, tr, td, th, option and what an outer end closes) are implied.
Character references are decoded, white space inside a line is one space, lines are joined by a
line end.  A null page is empty.  Pages are read whole and are independent of each other.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from . import _arrow as A

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no markup and no text.
RAW = frozenset("script style noscript template textarea iframe object svg math canvas audio video title".split())
#: Elements that hold something else than the article.
OTHER = frozenset("head nav footer aside form button select dialog menu".split())
#: Of these, elements that are not the article even if they hold all text.
NEVER = frozenset("head nav button select menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark
meter output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr""".split())
ARTICLE = frozenset(("article", "main"))
#: Words in class, id or role that mark something else than the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion
nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside footer masthead topbar toolbar
cookie cookies consent gdpr notice popup modal overlay alert newsletter subscribe subscription signup login search
share sharing social related recommended recommendations comment comments disqus respond replies reply discussion
pagination pager widget complementary contentinfo""".split())
#: Words that may stand beside these in a token: ``main-nav``, ``comment-list``.
NEUTRAL = frozenset("""site main page post article top bottom left right container wrapper wrap box block area inner outer bar primary
secondary global section list item items links unit slot mobile desktop""".split())
#: Of the marks, words of parts that stand within an article's text and do not end it.
WITHIN = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion share sharing widget".split())
COMMENTS = frozenset("comment comments disqus respond replies reply discussion".split())
#: Elements that are never marked by their attributes: the page itself and headings.
UNMARKED = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements that a start tag of the same row closes, and the elements that end the search for them.
IMPLIED = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
           "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
           "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)), "tfoot": (("tbody", "tr", "td", "th"), ("table",))}
#: Part of a block's text that makes it a block of links, and the longest line of a menu.
LINKS, MENU_LINE = 0.5, 60


def _marks(attributes: str, anchor: bool = False) -> set[str]:
    """Marks of whole tokens of class, role and (unless it is an ``anchor``) id."""
    found: set[str] = set()
    if not attributes:
        return found
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in WORD.findall(token)}
            marks = words & MARKS
            if marks and words <= MARKS | NEUTRAL and not (anchor and m[1].lower() == "id" and marks & {"discussion"} | marks - COMMENTS):
                found |= marks
    return found


class Part:
    """A marked element: the marked one around it, what it leaves (a gap or a place within a text), whether it
    is never the article or holds comments, its text and link text."""

    def __init__(self, parent: Part | None, gap: int, other: bool, comments: bool) -> None:
        self.parent, self.gap, self.other, self.comments, self.size, self.links = parent, gap, other, comments, 0, 0

    def cut(self, total: int, surge: int) -> bool:
        rest = total - self.size
        return self.other or self.size <= rest or self.links >= LINKS * self.size or self.comments and rest >= surge


def page_lines(page: str) -> tuple[list[tuple[str, int, int, int, Part | None]], list[Part], dict[int, Part | None]]:
    """Lines of a page as (text, link characters, outermost article or 0, container, innermost marked part), the
    marked parts in order and the part around each outermost article."""
    lines: list[tuple[str, int, int, int, Part | None]] = []
    found: list[Part] = []
    around: dict[int, Part | None] = {}
    parts: list[str] = []
    linked = 0
    # open elements: name, link or not, article, container and marked part
    stack: list[tuple[str, bool, int, int, Part | None]] = [("", False, 0, 0, None)]
    opened: Counter[str] = Counter()
    serial = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, _, article, container, marked = stack[-1]
                lines.append((text, min(linked, len(text)), article, container, marked))
                if marked:
                    marked.size += len(text)
                    marked.links += min(linked, len(text))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if stack[-1][1]:
            linked += len(" ".join(text.split()))

    def pop(size: int) -> None:
        # text up to here belongs to what was open; a marked inline part is a line of its own
        if any(e[0] not in INLINE or e[4] is not stack[size - 1][4] for e in stack[size:]):
            close()
        for e in stack[size:]:
            opened[e[0]] -= 1
        del stack[size:]

    at, n = 0, len(page)
    while at < n:
        tag = TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        if tag.start() > at:
            add(page[at:tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if tag[1] != "/" and not tag[3].endswith("/"):
                end = re.compile(f"</{name}\\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if tag[1] == "/":
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name and (name not in INLINE or stack[k][0] in INLINE):
                    k -= 1
                if k and stack[k][0] == name:
                    pop(k)
            continue
        if opened["head"] and name not in ("head", "title"):
            pop(next(k for k, e in enumerate(stack) if e[0] == "head"))
        if name not in INLINE and opened["p"]:
            k = len(stack) - 1
            while stack[k][0] in INLINE:
                k -= 1
            if stack[k][0] == "p":
                pop(k)
        if name in IMPLIED:
            ends, borders = IMPLIED[name]
            if any(opened[e] for e in ends):
                upper, k = 0, len(stack) - 1
                while k and stack[k][0] not in borders and stack[k][0] not in ("div", "section", "article", "main", "aside", "table"):
                    if stack[k][0] in ends:
                        upper = k
                    k -= 1
                if upper:
                    pop(upper)
        _, link, article, container, marked = stack[-1]
        serial += 1
        marks = set() if name in UNMARKED - ARTICLE else _marks(tag[3], bool(article)) & (COMMENTS if name in ARTICLE else MARKS)
        if name in ARTICLE and not marks:
            if not article:
                article = serial
                around[article] = marked
        if marks or name in OTHER or name == "header" and not article:
            if name in INLINE:
                close()
            within = marks and marks <= WITHIN and name not in OTHER
            marked = Part(marked, -2 if within else -1, name in NEVER, bool(marks & COMMENTS))
            found.append(marked)
        if name not in INLINE and name not in ("p", "ul", "ol", "table", "blockquote", "pre", "li", "dl") and name[:1] != "h" or name in ("html", "header"):
            container = serial
        stack.append((name, link or name == "a", article, container, marked))
        opened[name] += 1
    close()
    for m in reversed(found):
        if m.parent:
            m.parent.size += m.size
            m.parent.links += m.links
    return lines, found, around


def line_blocks(lengths: list[int], window: int, surge: int) -> list[tuple[int, int]]:
    """Line ranges from surge to dive: runs without ``window`` empty lines in a row.

    The run with the most text, and those whose largest window sum reaches ``surge``."""
    size = np.array(lengths, np.int64)
    full = np.flatnonzero(size)
    if not len(full):
        return []
    cuts = np.flatnonzero(np.diff(full) > window)
    starts = full[np.concatenate([[0], cuts + 1])]
    ends = full[np.concatenate([cuts, [len(full) - 1]])] + 1
    total = np.concatenate([[0], np.cumsum(size)])
    sums = total[np.minimum(np.arange(len(size)) + window, len(size))] - total[:-1]
    texts = total[ends] - total[starts]
    best = int(np.argmax(texts))
    return [(int(s), int(e)) for k, (s, e) in enumerate(zip(starts, ends)) if k == best or sums[s:e].max() >= surge]


def _cuts(found: list[Part], base: Part | None, total: int, surge: int) -> dict[Part | None, Part | None]:
    """The outermost part inside ``base`` that is cut, for each part inside it."""
    cuts: dict[Part | None, Part | None] = {base: None}
    for m in found:
        if m.parent in cuts and m is not base:
            cuts[m] = cuts[m.parent] or (m if m.cut(total, surge) else None)
    return cuts


def _spread(lines: list, window: int) -> list[tuple[str, int, int]]:
    """Lines as (text, weight, container); what was cut is ``window`` empty lines, or one within a text."""
    out: list[tuple[str, int, int]] = []
    last = None
    for text, links, container, cut in lines:
        if cut is None:
            out.append((text, 0 if links >= 0.9 * len(text) and len(text) <= MENU_LINE else len(text), container))
        elif cut is not last:
            out += [("", 0, -1)] * (window if cut.gap == -1 else 1)
        last = cut
    # links count as nothing where they are a menu
    at = 0
    while at < len(out):
        end = at
        while end < len(out) and out[end][0] and not out[end][1]:
            end += 1
        if end - at < window:
            out[at:end] = [(t, len(t), c) for t, _, c in out[at:end]]
        at = end + 1
    return out


def _regions(spread: list[tuple[str, int, int]], window: int, surge: int) -> list[tuple[int, int]]:
    """Regions of the line blocks and those that share a container with one."""
    weights = [w for _, w, _ in spread]
    kept = line_blocks(weights, window, surge)
    inside = {spread[k][2] for s, e in kept for k in range(s, e) if spread[k][0]}
    full = line_blocks(weights, window, 0)
    return [r for r in full if r in kept or any(spread[k][2] in inside for k in range(*r) if spread[k][0])]


def main_text(page: str, window: int = 3, surge: int = 120) -> str:
    lines, found, around = page_lines(page)
    sizes: Counter[int] = Counter()
    for text, _, article, _, _ in lines:
        sizes[article] += len(text)
    cuts = _cuts(found, None, sizes.total(), surge)
    articles = {a: n for a, n in sizes.items() if a}
    largest = max(articles, key=articles.get, default=0)
    # parts around the largest article are wrappers or were never closed; those inside it are held against it
    own = _cuts(found, around.get(largest), sizes[largest], surge)
    gap = Part(None, -1, True, False)
    inside, outside = [], []
    for text, links, article, container, marked in lines:
        if article and 4 * sizes[article] >= sizes[largest]:
            inside.append((text, links, container, own[marked] if article == largest else cuts[marked]))
        outside.append((text, links, container, cuts[marked] or (gap if article else None)))
    spread = _spread(outside, window)
    ranges = _regions(spread, window, surge)
    if inside:
        article = _spread(inside, window)
        rest = max((sum(w for _, w, _ in spread[s:e]) for s, e in ranges), default=0)
        if rest < surge or sum(w for _, w, _ in article) >= rest:
            spread, ranges = article, _regions(article, window, 0)
    return "\n".join(spread[k][0] for s, e in ranges for k in range(s, e) if spread[k][0])


def extract(pages: DataFrame, keys: tuple[str, ...] = ("page_id", "url"), page: str = "html", window: int = 3, surge: int = 120) -> DataFrame:
    """``keys``, ``text`` and ``n_chars`` of every page."""

    def run(buf, offsets):
        texts = [main_text(buf[a:b].tobytes().decode("utf-8"), window, surge) for a, b in zip(offsets[:-1], offsets[1:])]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return A.per_text(pages, list(keys), page, [StructField("text", StringType()), StructField("n_chars", LongType())], run)
