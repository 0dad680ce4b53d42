"""Main text of web pages by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import to_batch
from .store import table
from .words_common import STOP_WORDS

#: Characters below which a block is short and from which it is long, stop-word densities, and the link density that condemns a block.
SHORT, LONG, FEW, MANY, LINKS = 70, 200, 0.15, 0.28, 0.35
#: Link density that condemns a block within a marked article.
ALL_LINKS = 0.8

# What elements and class names of web pages mean.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template iframe svg math textarea title object canvas".split())
_DROPPED = _RAW | frozenset("head nav footer aside form button select menu dialog header label fieldset video audio".split())
_PHRASE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_MAIN = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_CLOSED_BY_BLOCK = frozenset("p".split())
_BOILERPLATE = re.compile(
    r"(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|post|entry|user|reader|cookie|social|share|related|google|ad|article)[_-])*"
    r"(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|gdpr|notices?|disclaimer|alert|menus?|nav|navbar|navigation|"
    r"sidebar|side|footer|header|masthead|comments?|commentlist|disqus|replies|respond|breadcrumbs?|share|sharing|social|related|recommended|newsletter|subscribe|subscription|"
    r"signup|login|popup|modal|overlay|widget|pagination|pager|toolbar|copyright|skip|hidden)"
    r"(?:[_-](?:list|area|section|box|bar|wrapper|wrap|container|inner|links?|block|banner|notice|form|posts?|articles?|items?|menu|nav|widgets?|primary|secondary|left|right|top|bottom|[0-9]+))*",
    re.I,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


@dataclass
class Block:
    """A run of text between block elements."""

    text: str
    linked: int = 0
    main: bool = False
    heading: bool = False
    label: str = ""
    place: int = 0
    parent: int = 0  # the element around the block's own
    reach: range = range(0)  # the places of all blocks in the parent


def _excluded(name: str, attrs: str) -> bool:
    if name in _DROPPED:
        return True
    if not attrs.strip(" /"):
        return False
    of = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attrs)}
    if "hidden" in of or of.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", of.get("style", ""), re.I):
        return name not in ("html", "body")
    if name in ("html", "body", "article", "main"):
        return False
    return of.get("role", "").lower() in _ROLES or any(_BOILERPLATE.fullmatch(x) for k in ("class", "id") for x in of.get(k, "").split())


def blocks(page: str) -> list[Block]:
    """The text blocks of the page that no element or class name rules out, in page order.

    Unclosed elements end with their parent; a paragraph also ends where a block begins. A
    header inside an article keeps its headings.
    """
    found: list[Block] = []
    stack: list[tuple[str, bool]] = []  # open elements and whether they are ruled out
    names: Counter[str] = Counter()  # how many of each are open
    opened, closed, serials = [0], {}, [0]  # blocks found when an element began and ended, and the open ones
    out = anchors = mains = headings = headers = 0
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        if text:
            found.append(Block(text, linked, mains > 0, headings > 0, place=len(found), parent=serials[-2] if len(serials) > 1 else 0))
        pieces.clear()
        linked = 0

    def push(name: str, excluded: bool, sign: int = 1) -> None:
        nonlocal out, mains, headings, headers
        out += sign * excluded
        mains += sign * (name in _MAIN)
        headings += sign * (name in _HEADING)
        headers += sign * (excluded and name == "header")
        names[name] += sign
        if sign > 0:
            stack.append((name, excluded))
            serials.append(len(opened))
            opened.append(len(found))

    def pop_to(k: int) -> None:
        for name, excluded in stack[k:]:
            push(name, excluded, -1)
        closed.update((x, len(found)) for x in serials[k + 1 :])
        del stack[k:], serials[k + 1 :]

    def place(name: str) -> int:
        """Where the innermost open element of that name is, -1 if there is none."""
        return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1) if names[name] else -1

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            in_heading = mains and headings and out == headers
            if not out or in_heading:
                text = html.unescape(page[at:stop])
                pieces.append(text)
                if anchors:
                    linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m.group().startswith("<![CDATA[") and not out:
                pieces.append(m.group()[9:].removesuffix("]]>"))
            continue
        closing = bool(m["close"] or m["close2"])
        if name == "a":
            anchors = 0 if closing else 1
        if name in _PHRASE:
            top_phrase = bool(stack) and stack[-1][0] in _PHRASE
            if closing:
                if top_phrase and place(name) >= 0:
                    flush() if out else None
                    pop_to(place(name))
            elif top_phrase or (not out and _excluded(name, m["attrs"] or "")):
                push(name, _excluded(name, m["attrs"] or ""))
            continue
        if name == "br":
            pieces.append(" ")
            continue
        if name in _VOID:
            if name == "hr":
                flush()
            continue
        if name in _RAW and not closing:
            if (m["attrs"] or "").rstrip().endswith("/") and name in ("svg", "math"):
                continue
            end = re.compile(rf"</{re.escape(name)}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        flush()
        if closing:
            if place(name) >= 0:
                pop_to(place(name))
            continue
        while stack and (stack[-1][0] in _CLOSED_BY_BLOCK or stack[-1][0] in _PHRASE or stack[-1][0] == name == "li"):
            pop_to(len(stack) - 1)
        push(name, _excluded(name, m["attrs"] or ""))
        anchors = 0
    flush()
    for b in found:
        b.reach = range(opened[b.parent], closed.get(b.parent, len(found)))
    return found


def _density(text: str) -> float:
    """Share of stop words among the words."""
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in STOP_WORDS for w in words) / len(words)


def _first_pass(b: Block, known: bool) -> str:
    """good, bad, near (nearly good) or open, by link density, length and stop-word density of the block alone."""
    size, links = len(b.text), b.linked / len(b.text)
    if links > (ALL_LINKS if b.main else LINKS) and (size < LONG or not b.main):
        return "bad"
    if b.heading or links > LINKS:
        return "open"
    if size < SHORT:
        return "bad" if links > 0 and not b.main else "open"
    density = _density(b.text) if known else MANY
    if density >= MANY:
        return "good" if size >= LONG else "near"
    return "near" if density >= FEW else "open"


def _second_pass(found: list[Block], labels: list[str], edge: str) -> None:
    """Decides what the first pass left open by the nearest decided neighbours; with one only, by that if its
    parent holds the block too, else by ``edge``."""
    if "good" not in labels:  # no long block at all: the nearly good ones decide
        labels = ["good" if x == "near" else x for x in labels]
    left: list[Block | None] = []
    right: list[Block | None] = [None] * len(found)
    decided, before, after = {b.place: x for b, x in zip(found, labels) if x in ("good", "bad")}, None, None
    for b in found:
        left.append(before)
        before = b if b.place in decided else before
    for k in range(len(found) - 1, -1, -1):
        right[k] = after
        after = found[k] if found[k].place in decided else after
    for b, label, u, v in zip(found, labels, left, right):
        x, y = (decided[z.place] if z else "" for z in (u, v))
        if not x or not y:  # the one neighbour counts for the blocks around it, not for another part of the page
            x = y = x or y if (u or v) and b.place in (u or v).reach else edge
        if label in ("good", "bad"):
            b.label = label
        elif x == y and label == "open":
            b.label = x
        else:
            b.label = "good" if label == "near" and "good" in (x, y) or (b.heading and y == "good") or (b.main and label == "open") else "bad"


def classify(found: list[Block]) -> list[Block]:
    """Label every block good or bad.

    First pass, block by block: link-dense blocks are bad, long ones with many stop words
    good, ones with fewer nearly good, and short ones, headings and the rest stay open. Where
    a page has hardly any of the known stop words (English, French, German, Spanish), its
    language is another and length alone counts. Second pass: open blocks take the label on
    which their nearest decided neighbours agree; a nearly good block with a good neighbour,
    and a heading before a good block, are good, any other is bad.

    In a page that marks its article, blocks outside are bad, and the passes run over those
    inside: there a block is bad by links only if it is hardly anything else, and where
    neighbours differ, or there is none, an open block stays.
    """
    prose = [b for b in found if len(b.text) >= SHORT]
    known = not prose or any(_density(b.text) >= FEW for b in prose)
    marked = [b for b in found if b.main]
    for b in found:
        b.label = "bad"
    some = marked or found
    _second_pass(some, [_first_pass(b, known) for b in some], "good" if marked else "bad")
    return found


def main_text(page: str | None) -> str:
    """The good blocks of the page, joined by empty lines; empty for a null or empty page."""
    return "\n\n".join(b.text for b in classify(blocks(page or "")) if b.label == "good")


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py()) for page in batch.column(2)]
        yield to_batch(page_id=batch.column(0), url=batch.column(1), text=pa.array(texts, pa.string()), n_chars=pa.array(map(len, texts), pa.int64()))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``.

    Null and empty pages have an empty text; null ids and urls stay; repeated rows are each
    extracted; other columns are ignored; no rows give no rows. The page is read whole.
    """
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(_extracted, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
