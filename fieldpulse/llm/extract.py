"""Main text of a web page by its line-block distribution.

Markup is stripped into lines, one per block element.  A line has a length; lengths are summed over a sliding
window of ``WINDOW`` lines.  Text surges where the sum rises from zero and dives where it falls back to zero; the
lines between a surge and its dive are kept when they hold ``LEAST`` characters, and the longest such run always is.

The length of a line is its text outside links.  Where a page marks its article (``article``, ``main`` or such a
role), lines inside count in full, lines outside as zero, and no run is too short.  Parts that are no article
by what they declare leave empty lines: menus, headers, footers, sidebars, forms, scripts and
styles by their tag, and also notices, adverts and reader comments by their role or a word of their class or id
(``APART``).  Between two paragraphs or inside a marked article they leave no empty lines, so the text around them stays one
run.  Of a header inside an article the headings stay.  A form or classed part that holds the marked article stays.

An element that is taken out and never closed ends with its parent, or before the article or main heading, so
broken markup does not swallow the page.  Character references are decoded once; white space inside a block, line
breaks included, becomes one space; blocks are joined by one line break.

Edge cases: null and empty pages and pages without text give an empty text; a page cut off anywhere gives
what it holds; null keys, repeated rows and ties are kept row by row; among equal longest runs the first one
counts; memory grows with the longest page alone; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST = 3, 86

#: Elements whose content is no text of the page.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video title textarea select button".split())
#: Elements of their own purpose.
OUTSIDE = frozenset("head nav footer aside dialog menu header".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that mark menus, headers, footers, sidebars, notices, adverts, forms and reader comments.
APART = frozenset("""
    nav navbar navigation menu submenu breadcrumb breadcrumbs topbar toolbar pagination pager
    header masthead footer colophon copyright sidebar aside widget widgets related recommended
    notice notices cookie cookies consent gdpr banner alert popup modal overlay newsletter subscribe paywall
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
    form login signup search share sharing social
    comment comments reply replies respond discussion disqus
""".split())
#: A class that begins with one of these tells of another part: ``has-sidebar``.
TELLING = ("has-", "has_", "no-", "no_", "with-", "with_", "without-", "without_")
COMMENTS = frozenset("comment comments reply replies respond discussion disqus".split())
HEADERS = frozenset(("header", "masthead"))
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(f"h{i}" for i in range(1, 7))
PARAGRAPHS = HEADINGS | frozenset("p ul ol dl blockquote pre table figure".split())
#: Elements that end when the next one of their kind begins.
IMPLIED = frozenset("p li dt dd tr td th".split())
#: Elements that begin and end a line.
BLOCKS = HEADINGS | frozenset("""
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul
""".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that only format words, whatever their class.
FORMATTING = frozenset("abbr b bdi bdo cite code del dfn em font i ins kbd mark q s samp small strong sub sup time tt u var".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.S)
_NAME = re.compile(r"[A-Za-z0-9]+")
_HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Tag(NamedTuple):
    """One tag or comment of a page by its place; ``kind`` is open, close, raw (text to leave out) or none."""

    begin: int
    end: int
    kind: str
    name: str
    attributes: str


def _tags(page: str) -> list[Tag]:
    out: list[Tag] = []
    at = 0
    while (begin := page.find("<", at)) >= 0:
        hit = _TAG.match(page, begin)
        if not hit:
            at = begin + 1  # a bare "<" is text
            continue
        at = hit.end()
        name = (hit.group(2) or "").lower()
        out.append(Tag(begin, at, "none" if not name else "close" if hit.group(1) else "open", name, hit.group(3) or ""))
        if name in RAW and not hit.group(1):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if close or name in ("script", "style", "title", "textarea"):
                out.append(Tag(at, close.start() if close else len(page), "raw", name, ""))
                at = out[-1].end
    return out


def _ends(tags: list[Tag]) -> dict[int, tuple[int, bool]]:
    """``(place, own)`` for each opening tag: where its element ends, and whether by an end tag of its own.

    Every tag is pushed and popped once; an end tag closes the innermost element of its name, if one is open.
    """
    ends: dict[int, tuple[int, bool]] = {}
    opened: list[int] = []
    depth: dict[str, int] = {}

    def close(place: int, own: bool) -> str:
        j = opened.pop()
        ends[j] = place, own
        depth[tags[j].name] -= 1
        return tags[j].name

    for i, tag in enumerate(tags):
        if tag.kind not in ("open", "close") or tag.name in VOID:
            continue
        if tag.kind == "open":
            if opened and tag.name in BLOCKS:
                inner = tags[opened[-1]].name
                if inner == "p" or inner == tag.name and inner in IMPLIED:
                    close(i, False)
            opened.append(i)
            depth[tag.name] = depth.get(tag.name, 0) + 1
        elif depth.get(tag.name):
            while tags[opened[-1]].name != tag.name:
                close(i, False)
            close(i, True)
    while opened:
        close(len(tags), False)
    return ends


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), references.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
    return out


def _words(found: dict[str, str]) -> set[str]:
    """Words of class and id, whole names and the parts of ``camelCase``."""
    names = [n for key in ("class", "id") for n in found.get(key, "").split() if not n.lower().startswith(TELLING)]
    plain = [part for n in names for part in _NAME.findall(n)]
    return {w.lower() for part in plain for w in (part, *_HUMP.findall(part))}


def _is_main(tag: Tag, found: dict[str, str]) -> bool:
    marked = tag.name in MAIN or found.get("role", "").lower() in MAIN or found.get("itemprop", "") == "articleBody"
    return marked and not COMMENTS & _words(found)


def _is_apart(tag: Tag, found: dict[str, str], holds_main: bool) -> bool:
    """Whether an element is no part of the article by its tag, attributes, role, class or id."""
    if tag.name in OUTSIDE or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if tag.name in FORMATTING or tag.name in ("html", "body"):
        return False
    if COMMENTS & _words(found):
        return True
    if holds_main:
        return False
    return tag.name == "form" or found.get("role", "").lower() in ROLES or bool(APART & _words(found))


class Line(NamedTuple):
    text: str
    length: int
    free: int  # length outside links
    main: bool


EMPTY = Line("", 0, 0, False)


def lines_of(page: str) -> list[Line]:
    """The lines of a page in order; empty ones stand for what was taken out."""
    tags = _tags(page)
    ends = _ends(tags)
    details = {i: _attributes(t.attributes) if t.attributes.strip() else {} for i, t in enumerate(tags) if t.kind == "open"}
    mains = [i for i, found in details.items() if _is_main(tags[i], found)]
    marked = set(mains)
    landmarks = [i for i in details if tags[i].name in ("body", "h1") or i in marked]
    lines: list[Line] = []
    parts: list[str] = []
    free: list[str] = []

    def close_line(main: bool) -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            lines.append(Line(text, len(text), len(" ".join(references.unescape("".join(free)).split())), main))
        parts.clear()
        free.clear()

    def next_of(places: list[int], after: int) -> int:
        k = bisect_right(places, after)
        return places[k] if k < len(places) else len(tags) + 1

    main_end = link_end = header_end = heading_end = -1  # the tags at which such elements end
    at = i = 0
    before = ""  # name of the last block tag
    while i <= len(tags):
        tag = tags[i] if i < len(tags) else Tag(len(page), len(page), "none", "", "")
        inside = i <= main_end
        if tag.begin > at and (i > header_end or i <= heading_end):
            parts.append(page[at: tag.begin])
            if i > link_end:
                free.append(parts[-1])
        at = max(at, tag.end)
        if tag.name in BLOCKS or i == len(tags):
            close_line(inside)
        elif tag.name == "br":
            parts.append(" ")
            free.append(" ")
        if tag.kind == "open" and tag.name not in VOID and tag.name not in RAW:
            end, own = ends[i]
            found = details[i]
            header = tag.name in HEADERS or bool(HEADERS & _words(found))
            if i in marked:
                main_end = max(main_end, end)
            elif inside and header and tag.name in BLOCKS:
                header_end = max(header_end, end)
            elif _is_apart(tag, found, next_of(mains, i) < end):
                if not own:
                    end = min(end, next_of(landmarks, i))
                after = end + 1 if own else end
                follows = tags[after].name if after < len(tags) and tags[after].kind == "open" else ""
                if tag.name in BLOCKS and not inside and not (before in PARAGRAPHS and follows in PARAGRAPHS):
                    lines.extend([EMPTY] * WINDOW)
                at = tags[end].end if own else tags[end].begin if end < len(tags) else len(page)
                i = after
                continue
            elif tag.name in HEADINGS:
                heading_end = max(heading_end, end)
            elif tag.name == "a" and own:
                link_end = max(link_end, end)
        if tag.name in BLOCKS:
            before = tag.name
        i += 1
    return lines


def runs(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """First line and the one after the last of every run of text between a surge and its dive."""
    out: list[tuple[int, int]] = []
    total, begin, last = 0, -1, -1
    for i, length in enumerate(lengths):
        total += length - (lengths[i - window] if i >= window else 0)
        if begin < 0 and total:
            begin = i  # surge: a window that ends here is the first one with text
        elif begin >= 0 and not total:
            out.append((begin, last + 1))  # dive: a whole window without text
            begin = -1
        if length:
            last = i
    return out + [(begin, last + 1)] if begin >= 0 else out


def main_text(page: str | None) -> str:
    """The article of one page."""
    lines = lines_of(page or "")
    marked = any(line.main for line in lines)
    lengths = [line.length * line.main if marked else line.free for line in lines]
    found = runs(lengths)
    if not found:
        return ""
    sizes = [sum(lengths[a:b]) for a, b in found]
    longest = sizes.index(max(sizes))
    kept = [run for k, run in enumerate(found) if marked or k == longest or sizes[k] >= LEAST]
    return "\n".join(line.text for a, b in kept for line in lines[a:b] if line.text and (line.main or not marked))


def extract(pages: DataFrame, key: str = "page_id", page: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns ``keep`` and ``main_text`` of every page, in place of the page."""
    names = [key, *keep]
    kinds = ", ".join(f"c{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.columns[:-1]
            texts = pa.array([main_text(p.as_py()) for p in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, texts], [*[f"c{i}" for i in range(len(kept))], "main_text"])

    rows = pages.select(*[pages[c].alias(f"c{i}") for i, c in enumerate(names)], pages[page].alias("page"))
    found = rows.mapInArrow(run, f"{kinds}, main_text string")
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "main_text")
