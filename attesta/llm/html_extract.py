"""Main text of web pages: two-pass block rules.

A page becomes blocks: runs of text between block-level tags. What page structure rules out (menus,
headers, footers, sidebars, notices, adverts, forms, comments, scripts) makes no block. First pass, every block
alone: a block made of links is bad; a long block, or one with many stop words, is good; the others
are ambiguous. Second pass: an ambiguous block takes the label of its nearest decided neighbours in its
own container, bad only when the decided blocks on all sides are bad. Where no neighbour is decided,
the container is: an article is good, a bare page is bad. A bare page without any good block, say in a language
whose stop words are not known here, has its long blocks of low link density as main text, or else all blocks that
are not made of links. Good blocks of the container around the article, such as a headline, belong to the text.

One pass over the pages, no shuffle; a task holds one batch of pages and one page's blocks. Time is linear in the
page's length, also for markup that is never closed.

Defined results: null or empty html gives the empty text; a null ``page_id`` or ``url`` is passed on;
repeated rows give a row each; an empty table gives no rows; further columns of the input are ignored. A ``page_id``
that is no whole number comes back as a string.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm.common import arrow_rows

# Names of HTML elements by their role, from the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noframes", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div",
    "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section",
    "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
LEFT_OUT = {
    "head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "noscript", "template", "iframe",
    "object", "svg", "canvas", "audio", "video", "map", "fieldset",
}
RUNNING_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "figcaption", "pre", "dd"}
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog",
    "menu", "menubar", "toolbar",
}
# Words in class and id that mark page furniture, and those that mark the main text.
FURNITURE = {
    "ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "widgets",
    "footer", "header", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "search", "share", "sharing", "social", "related", "recommended", "recommendations", "pagination", "pager",
    "disclaimer", "copyright", "comments", "comment", "commentlist", "replies", "reply", "respond", "disqus", "hidden",
}
# Parts of longer names that also mark text inside of an article, as in entry-header, side-by-side, alert-level.
WEAK = {"header", "side", "alert"}
COMMENTS = {"comments", "comment", "commentlist", "replies", "reply", "respond", "disqus"}
CONTENT = {
    "articlebody", "article-body", "article-content", "article-text", "article", "post-content", "post-body", "entry-content",
    "story-body", "story", "main-content", "maincontent", "page-content", "content", "main",
}
# Very common words of some languages.
STOP_WORDS = frozenset(
    "the of and to in a is that it for was on are be with as by at this from or an have not but "
    "der die und das in den von zu mit ist im für auf nicht ein eine dem des sich auch als an "
    "le la les de des et un une en que qui est dans pour pas au aux du sur par ce il avec "
    "el la los las de y que en un una es por con para del se no al lo su como "
    "il di che e un una in per non con del da si al le o os um uma em do da não com het een van ik je".split()
)

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
MARKED = re.compile(r"class|\bid\b|role|hidden|display|itemprop", re.IGNORECASE)
PARTS = re.compile(r"[^a-z0-9]+")
RAW_END = {name: re.compile(f"</{name}[^>]*>", re.IGNORECASE) for name in RAW}


@dataclass(frozen=True)
class Rules:
    """Bounds of the first pass: lengths in code points, shares between 0 and 1."""

    long_chars: int = 140
    medium_chars: int = 70
    stop_share: float = 0.3
    low_stop_share: float = 0.15
    link_share: float = 0.5


@dataclass
class Block:
    text: str
    link_chars: int
    tag: str
    zone: int
    strength: int
    around: int = 0
    label: bool | None = None


def marks_of(name: str, attributes: str, in_article: bool = False) -> tuple[bool, bool]:
    """(furniture, content) as an element's attributes tell."""
    if not attributes or not MARKED.search(attributes):
        return False, False
    values = {}
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        values.setdefault(key.lower(), (a or b or c).lower())
    names = f"{values.get('class', '')} {values.get('id', '')}".split()
    words = {w for n in names for w in PARTS.split(n)}
    if in_article:
        words -= WEAK
    words |= set(names)
    role = values.get("role", "")
    content = bool(CONTENT.intersection(names)) or role == "main" or "articlebody" in values.get("itemprop", "")
    if name in ("html", "body", "main"):
        return False, content
    if name == "article":
        return bool(COMMENTS & words), content
    hidden = (
        "hidden" in values or values.get("aria-hidden") == "true"
        or "display:none" in values.get("style", "").replace(" ", "")
    )
    return hidden or role in ROLES or (bool(FURNITURE & words) and not content), content


def blocks_of(html: str) -> list[Block]:
    """The page's blocks outside of its furniture."""
    out: list[Block] = []
    # open elements: name, left out, inside a link, zone, strength of the zone
    stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]
    # where the open elements of a name are in the stack, and where the open block-level ones are
    places: defaultdict[str, list[int]] = defaultdict(list)
    levels: list[int] = [0]
    around = {0: 0}
    parts: list[tuple[str, bool]] = []
    breaks = 0

    def close_block() -> None:
        nonlocal parts
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                links = " ".join(unescape(" ".join(p for p, link in parts if link)).split())
                _, _, _, zone, strength = stack[-1]
                out.append(Block(text, len(links), stack[levels[-1]][0], zone, strength, around[zone]))
            parts = []

    def nearest(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places[n]), default=0)

    def pop_to(place: int) -> None:
        if levels[-1] >= place:
            close_block()
        while len(stack) > place:
            places[stack.pop()[0]].pop()
        while levels[-1] >= place:
            levels.pop()

    at, end = 0, len(html)
    last = html.rfind(">") + 1  # no tag ends beyond
    while at < end:
        found = TAG.search(html, at, last) if at < last else None
        if found:
            start = found.start()
        else:
            start = html.find("<!--", at)  # a comment that is never closed
            start = end if start < 0 else start
        if start > at and not stack[-1][1]:
            piece = html[at:start]
            if breaks and piece.strip():
                breaks = 0
            parts.append((piece, stack[-1][2]))
        if not found:
            break
        at = found.end()
        name = (found[2] or found[5] or "").lower()
        if not name:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):
                break
            continue
        if found[1] or found[4]:
            if places[name]:
                pop_to(places[name][-1])
            elif name in BLOCKS and not stack[-1][1]:
                close_block()
            continue
        if name in RAW:
            closing = RAW_END[name].search(html, at, last)
            at = closing.end() if closing else end
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                close_block()
            parts.append((" ", stack[-1][2]))
            continue
        if name in BLOCKS:
            breaks = 0
            if name in CLOSED_BY:
                closes, stops = CLOSED_BY[name]
                open_one = nearest(closes)
                if open_one > nearest(stops):
                    pop_to(open_one)
            elif stack[levels[-1]][0] == "p":  # a block ends an open paragraph
                pop_to(levels[-1])
            close_block()
        if name in VOID:
            continue
        _, left_out, link, zone, strength = stack[-1]
        if not left_out:
            furniture, content = marks_of(name, found[3] or found[6] or "", strength == 2)
            left_out = furniture or name in LEFT_OUT or (name == "header" and strength < 2)
            power = 2 if name == "article" else 1 if content or name == "main" else 0
            if power > strength:
                around[len(around)] = zone
                zone, strength = len(around) - 1, power
        places[name].append(len(stack))
        if name in BLOCKS:
            levels.append(len(stack))
        stack.append((name, left_out, link or name == "a", zone, strength))
    close_block()
    return out


def stop_share(text: str) -> float:
    words = [w.strip(".,;:!?\"'()") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(block: Block, rules: Rules) -> bool | None:
    """Good, bad or, for None, ambiguous."""
    size = len(block.text)
    links = block.link_chars / size
    if links > rules.link_share and not (block.strength == 2 and block.tag in RUNNING_TEXT):
        return False
    share = stop_share(block.text)
    if size >= rules.long_chars and (block.strength or share >= rules.low_stop_share):
        return True
    if size >= rules.medium_chars and share >= rules.stop_share:
        return True
    return None


def second_pass(blocks: list[Block]) -> None:
    """Ambiguous blocks take the label of the nearest decided blocks of their zone."""
    decided = [b.label for b in blocks]
    before: dict[int, bool] = {}
    sides: list[list[bool]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        before.clear()
        for i in order:
            zone = blocks[i].zone
            if decided[i] is not None:
                before[zone] = decided[i]
            elif zone in before:
                sides[i].append(before[zone])
    for block, near in zip(blocks, sides):
        if block.label is None:
            block.label = any(near) if near else block.strength > 0


def bare_pass(blocks: list[Block], rules: Rules) -> None:
    """On a page without container and without good block, long blocks are good, or else all that no links make up."""
    if any(b.label or b.strength for b in blocks):
        return
    open_ones = [b for b in blocks if b.label is None]
    for block in [b for b in open_ones if len(b.text) >= rules.long_chars] or open_ones:
        block.label = True


def main_text(html: str | None, rules: Rules = Rules()) -> str:
    blocks = blocks_of(html) if html else []
    for block in blocks:
        block.label = first_pass(block, rules)
    bare_pass(blocks, rules)
    second_pass(blocks)
    good = [b for b in blocks if b.label]
    top = max((b.strength for b in good), default=0)
    # the container right around the article, if it is one, holds its headline and lead
    frames = {b.around for b in good if b.strength == top and top}
    inside = [b for b in good if b.strength == top or (b.strength and b.zone in frames)]
    outside = sum(len(b.text) for b in good) - sum(len(b.text) for b in inside)
    if outside <= 3 * sum(len(b.text) for b in inside):
        good = inside  # the strongest container holds the article; a teaser in a small one does not
    return "\n\n".join(b.text for b in good)


def extract_pages(pages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def row(page_id, url, html):
        text = main_text(html, rules)
        return page_id, url, text, len(text)

    whole = isinstance(pages.schema["page_id"].dataType, T.IntegralType)
    run = arrow_rows(
        row, ["page_id", "url", "html"], ["page_id", "url", "text", "n_chars"],
        [pa.int64() if whole else pa.string(), pa.string(), pa.string(), pa.int64()], size=512,
    )
    kind = "long" if whole else "string"
    return pages.select(F.col("page_id").cast(kind), "url", "html").mapInArrow(
        run, f"page_id {kind}, url string, text string, n_chars long"
    )
