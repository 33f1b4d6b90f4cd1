"""Main text of web pages by ratios of text and punctuation per tag path.

A page is cut into blocks; each block stands on a root-to-leaf path of block elements with their classes. Per
path, text and punctuation are averaged over its blocks, up to the size of a paragraph, and fused by their geometric
mean and the share of text outside links; the fused values are smoothed over neighbouring blocks of one parent and
held against a share of the page's largest. What stands beside chosen blocks in one element is chosen with them. Elements whose tag says that they are no article text, and hidden ones, never take part. A class, id or
role that says so is only a mark: it is ignored if the elements that carry it hold most of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracekit.llm.common import free_name

#: Share of the page's largest smoothed value from which a block counts as content.
THRESHOLD = 0.3
#: Average length and punctuation of a path from which it is no more text-like: one long block does not set the limit.
FULL_LENGTH, FULL_MARKS = 200, 5
#: Weights of a block's neighbours at distance 0, 1 and 2.
SMOOTH = (0.4, 0.24, 0.06)
#: Share of link text from which a block counts as a menu.
MOST_LINKS = 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = set("ul ol dl table article section main body div td th blockquote aside nav form".split())
_NOT_TEXT = set("head script style title noscript template iframe object svg canvas math nav footer aside button select option textarea dialog menu xmp noembed noframes audio video".split())
_MARKS = set("""ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner nav navbar
    navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer foot masthead topbar toolbar cookie cookies
    consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related
    recommended recommendations teaser pagination pager comment comments commentlist disqus respond replies reply skip hidden""".split())
_HEADERS = {"header", "top"}
#: Words that change nothing beside a mark: ``widget-area`` is one, ``has-sidebar`` and ``social-post`` are none.
_AROUND = set("area bar block bottom box container inner item items left list main outer page right section site slot top unit wrap wrapper".split())
#: Marks of what can be longer than the article: they count unless nothing else is there.
_APART = set("comment comments commentlist disqus respond replies reply cookie cookies consent gdpr".split())
_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？«»\"()-]")


@dataclass
class Block:
    path: tuple[str, ...]
    home: int
    text: str
    links: int
    #: Numbers of the elements around the block, from the outermost to its own, inline ones left out.
    around: tuple[int, ...] = ()


@dataclass
class Piece:
    text: str
    link: bool
    marks: frozenset[tuple[str, str]]
    home: int


def _attributes(data: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(data)}


def _unwanted(tag: str, attributes: dict[str, str]) -> bool:
    if tag in _NOT_TEXT or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return True
    return tag not in ("html", "body", "article", "main") and bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def _marks(tag: str, attributes: dict[str, str], in_article: bool) -> frozenset[tuple[str, str]]:
    """Tag and reason of each sign that an element is no article text: whole class or id tokens, a role, a tag."""
    if tag in ("html", "body", "article", "main"):
        return frozenset()
    known = _MARKS if in_article else _MARKS | _HEADERS
    found = []
    for token in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(re.split(r"[^a-z]+", token)) - {""}
        if words & known and words <= known | _AROUND:
            found.append(token)
    if (role := attributes.get("role", "").lower()) in _ROLES:
        found.append(f"role {role}")
    if tag == "form" or tag == "header" and not in_article:
        found.append("")
    return frozenset((tag, x) for x in found)


def _apart(mark: tuple[str, str]) -> bool:
    return not _APART.isdisjoint(re.split(r"[^a-z]+", mark[1]))


def _ignored(pieces: list[Piece], marks: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """Marks whose elements together hold at least half of the text outside links.

    Text in articles decides where it is at least a quarter of the page's; comments and the like decide only if there is
    nothing else.
    """
    if not marks:
        return marks
    weights = [(0 if x.link else len(x.text.strip()), x) for x in pieces]
    pool = [(w, x) for w, x in weights if w and not any(map(_apart, x.marks))]
    alone = not pool
    pool = pool or [(w, x) for w, x in weights if w]
    total = sum(w for w, _ in pool)
    at_home = [(w, x) for w, x in pool if x.home]
    if 4 * sum(w for w, _ in at_home) >= total:
        pool, total = at_home, sum(w for w, _ in at_home)
    held: dict[tuple[str, str], int] = defaultdict(int)
    for w, x in pool:
        for mark in x.marks:
            held[mark] += w
    return {mark for mark in marks if 2 * held[mark] >= total > 0 and (alone or not _apart(mark))}


def blocks(page: str) -> list[Block]:
    """Text blocks in page order, unwanted elements left out.

    ``home`` numbers the innermost article or main element around a block, 0 if there is none. Open tags that
    are never closed, and closing tags that were never opened, are tolerated.
    """
    # path, number of the article and pieces of each block, before marks are judged
    raw: list[tuple[tuple[str, ...], int, tuple[int, ...], list[Piece]]] = []
    # of an open element: tag, name in paths, inside something unwanted, inside a link, number of its article, marks, place in the page
    stack: list[tuple[str, str, bool, bool, int, frozenset[tuple[str, str]], int]] = [("", "", False, False, 0, frozenset(), 0)]
    parts: list[Piece] = []
    homes, at = 0, 0

    def flush() -> None:
        if parts:
            raw.append((tuple(x[1] for x in stack if x[1]), stack[-1][4], tuple(x[6] for x in stack if x[1]), parts.copy()))
        parts.clear()

    def say(data: str) -> None:
        _, _, bad, link, home, marks, _ = stack[-1]
        if data and not bad:
            parts.append(Piece(data, link, marks, home))

    def close_to(k: int) -> None:
        if any(x[0] not in _INLINE for x in stack[k:]):
            flush()
        del stack[k:]

    while m := _TOKEN.search(page, at):
        say(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k:
                close_to(k)
            elif tag == "p":
                flush()
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        inline = tag in _INLINE
        if not inline:
            closed = _CLOSES.get(tag) or {"p"}
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in closed:
                    close_to(k)
                    break
                if stack[k][0] in _HOLDS:
                    break
            flush()
        _, _, bad, link, home, marks, _ = stack[-1]
        attributes = _attributes(m[3])
        bad = bad or _unwanted(tag, attributes)
        marks |= _marks(tag, attributes, home > 0)
        if tag in ("article", "main") or attributes.get("role") == "main":
            homes += 1
            home = homes
        name = "" if inline else f"{tag}.{attributes['class']}" if attributes.get("class") else tag
        if m[3].endswith("/") and tag not in ("p", "div", "article", "span"):
            continue
        stack.append((tag, name, bad, link or tag == "a", home, marks, at))
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            say(page[at : end.start()] if end else page[at:])
            at = end.end() if end else len(page)
            close_to(len(stack) - 1)
    # a "<" that opens no tag is text; an unfinished tag at the very end is not
    rest = page[at:]
    say(rest if not re.match(r"[^<]*<[a-zA-Z/!][^>]*\Z", rest) else rest[: rest.index("<")])
    flush()
    pieces = [x for *_, some in raw for x in some]
    marked = set().union(*(x.marks for x in pieces))
    counting = marked - _ignored(pieces, marked)
    out: list[Block] = []
    for path, home, around, some in raw:
        left = [x for x in some if counting.isdisjoint(x.marks)]
        if text := " ".join(html.unescape("".join(x.text for x in left)).split()):
            out.append(Block(path, home, text, sum(len(x.text.strip()) for x in left if x.link), around))
    return out


def path_values(found: list[Block]) -> list[float]:
    """Smoothed and fused tag-path ratio of every block."""
    length, marks, linked, count = (defaultdict(float) for _ in range(4))
    for b in found:
        length[b.path] += len(b.text)
        marks[b.path] += len(_PUNCTUATION.findall(b.text))
        linked[b.path] += b.links
        count[b.path] += 1
    fused = {p: math.sqrt(min(FULL_LENGTH, length[p] / n) * min(FULL_MARKS, (marks[p] + 1) / n)) * max(0.0, 1 - linked[p] / length[p]) for p, n in count.items()}
    raw, out = [fused[b.path] for b in found], []
    for i, b in enumerate(found):
        total = 0.0
        for j in range(max(0, i - 2), min(len(found), i + 3)):
            if found[j].path[:-1] == b.path[:-1]:
                total += SMOOTH[abs(i - j)] * raw[j]
        out.append(total)
    return out


def _widened(found: list[Block], chosen: list[bool]) -> list[bool]:
    """Chosen blocks, and all blocks outside menus in the elements that chosen blocks stand in.

    A block's element is its parent, or itself if other blocks lie in it. Where that is the body or nothing, only
    blocks right below it are taken.
    """
    inner = {x for b in found for x in b.around[:-1]}

    def place(b: Block) -> tuple[int, bool]:
        """Number of the element a block stands in, and whether that is the page itself."""
        depth = len(b.around) - (not b.around or b.around[-1] not in inner)
        return (b.around[depth - 1], b.path[depth - 1] in ("html", "body") or b.path[depth - 1].startswith(("html.", "body."))) if depth > 0 else (0, True)

    places = [place(b) for b in found]
    held = {p for p, c in zip(places, chosen) if c}
    deep = {x for x, page in held if not page}
    return [b.links < MOST_LINKS * len(b.text) and (c or p in held or not deep.isdisjoint(b.around)) for b, p, c in zip(found, places, chosen)]


def main_text(page: str | None) -> str:
    """Blocks of the main text in page order, joined by one space; empty if there are none."""
    found = blocks(page or "")
    if not found:
        return ""
    values = path_values(found)
    limit = THRESHOLD * max(values)
    chosen = [v >= limit and b.links < MOST_LINKS * len(b.text) for v, b in zip(values, found)]
    weight: dict[int, int] = defaultdict(int)
    for b, c in zip(found, chosen):
        weight[b.home] += c * len(b.text)
    total = sum(weight.values())
    homes = {h for h, w in weight.items() if h and w}
    if homes and sum(weight[h] for h in homes) * 2 >= total:
        # the chosen paths lie in articles: their other blocks (headings, lists) belong to them too
        return " ".join(b.text for b in found if b.home in homes)
    places = [i for i, c in enumerate(_widened(found, chosen)) if c]
    if not places:
        return ""
    span = found[places[0] : places[-1] + 1]
    return " ".join(b.text for b in span if b.links < MOST_LINKS * len(b.text))


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """Every page with its main text in ``out_col``; one pass over whole pages, no shuffle.

    Null and empty pages, and pages without text, give an empty text. Columns that are there stay; if
    ``out_col`` is taken, underscores are added. Repeated rows stay repeated.
    """

    @F.pandas_udf(T.StringType())
    def apply(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    return pages.withColumn(free_name(pages, out_col), apply(F.coalesce(F.col(html_col), F.lit(""))))
