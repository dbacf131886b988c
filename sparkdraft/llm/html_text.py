"""Main text of web pages by two-pass block rules.

A page is walked once and cut into blocks at block-level tags.  The first pass
decides blocks on their own: link density, length and stop-word density.  Blocks of
an article need no stop words, as soon as one of them is long and not a list of
links.  Short and middling blocks stay open; in the second pass they inherit the
label of the nearest decided neighbour, in the article or outside as they are.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments that
the markup names are left out before any rule, with the articles inside a closed
sidebar, menu, advert or list of related pages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdraft.llm.common import query
from sparkdraft.session import importable

# Element names, words of class and id attributes, stop words, thresholds.
RAW = frozenset("script style noscript template iframe object textarea title svg canvas audio video select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset(
    "article aside blockquote body button details dialog div dl fieldset figure footer form head header main menu nav "
    "ol section table ul span".split()
)
LEFT_OUT = frozenset("aside button dialog footer form head header menu nav".split())
ARTICLES = frozenset(("article", "main"))
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice notification "
    "pagination pager popup promo promoted promotion recommended related reply replies respond share sharing sidebar "
    "signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: What stands beside the text: an article inside is a teaser.  Forms and notices may hold the whole page.
BESIDE = frozenset("aside footer menu nav".split())
BESIDE_MARKS = frozenset(
    "ad ads adv advert advertisement advertising breadcrumb breadcrumbs footer menu nav navbar navigation newsletter "
    "pager pagination promo promoted promotion recommended related sidebar sponsor sponsored teaser widget "
    "complementary contentinfo menubar".split()
)
HEADLINE_MARKS = frozenset("header masthead banner".split())
COMMENT_MARKS = frozenset("comment comments disqus replies respond".split())
STOP_WORDS = frozenset(
    "the of and to in is that it for on with as was be by are this from at or an not a "
    "de la le et les des en un une du que est pour dans qui sur par au plus pas avec ce "
    "der die und das den von zu mit ist im dem nicht ein eine auf für als auch sich es "
    "el los las y se con para su al lo como una del no si".split()
)
SHORT = 70
LONG = 200
LINKED = 0.33
LINKED_ARTICLE = 0.66
STOPS_LOW = 0.06
STOPS_HIGH = 0.12

_PIECE = re.compile(
    r"<!--(?s:.*?)(?:-->|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^<>\"'=]++"
    # A quoted value may hold anything, markup too, if it ends where a value can.
    r"|=\s*+\"[^\"]*+\"(?=[\s/>])|=\s*+'[^']*+'(?=[\s/>])"
    r"|\"[^\"<]*+\"|'[^'<]*+'|[\"'=])*+)>"
    r"|<[!?/][^>]*+>"
    r"|(?P<text>[^<]++|<)"
)
_MARKED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
#: "no-sidebar" and "has-sidebar" speak of the layout, not of the element.
_WITHOUT = re.compile(r"(?i)\b(?:no|has|with|without)[-_]+[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[a-z]+")
_WORD = re.compile(r"[^\W\d_]+")
#: The next start or end of a link.
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)


class Block(NamedTuple):
    text: str
    link_chars: int
    n_links: int
    in_article: bool
    #: Whether the block begins inside a link, as the blocks of a linked card do.
    in_link: bool = False


class _Open(NamedTuple):
    name: str
    left_out: bool
    article: bool
    comments: bool
    #: Whether the element itself stands beside the text, and where it starts.
    beside: bool = False
    start: int = 0


_NOTHING = _Open("", False, False, False)


def _marks(attributes: str) -> set[str]:
    """Words of class, id and role."""
    found = " ".join(m.strip("\"'") for m in _MARKED.findall(attributes))
    found = _WITHOUT.sub(" ", found)
    return set(_NAME.findall(_CAMEL.sub(" ", found).lower()))


def _pieces(html: str) -> Iterator[tuple[int, str | None, str, bool, str]]:
    """``start, text, name, closing, attributes`` of texts and tags; scripts and the like are one tag."""
    end_of_raw: dict[str, re.Pattern] = {}
    at, size, last_tag = 0, len(html), html.rfind(">")
    while at < size:
        start = at
        piece = _PIECE.match(html, at)
        text = piece["text"]
        if text == "<" and at > last_tag and html[at + 1 : at + 2].isalpha():
            break  # an unclosed tag at the end of the page
        at = piece.end()
        if text is not None:
            yield start, text, "", False, ""
        elif piece["name"] is not None:
            name = piece["name"].lower()
            closing = bool(piece["end"])
            if name in RAW and not closing and not piece["attributes"].endswith("/"):
                if name not in end_of_raw:
                    end_of_raw[name] = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)
                stop = end_of_raw[name].search(html, at)
                at = stop.end() if stop else size
            yield start, None, name, closing, piece["attributes"]


def _closed(html: str) -> set[int]:
    """Where the containers start that an end tag of their own closes."""
    closed: set[int] = set()
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    for start, _, name, closing, attributes in _pieces(html):
        if name not in CONTAINERS:
            continue
        if closing:
            while opened[name]:
                last, where = stack.pop()
                opened[last] -= 1
                if last == name:
                    closed.add(where)
                    break
        elif not attributes.endswith("/"):
            if name in ("html", "body"):
                stack.clear()
                opened.clear()
            stack.append((name, start))
            opened[name] += 1
    return closed


def blocks_of(html: str, lift: bool = False) -> list[Block]:
    """All blocks with a text that the markup does not name as something else.

    ``lift`` takes articles out of whatever is around them.
    """
    blocks: list[Block] = []
    stack: list[_Open] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = [0, 0]
    in_link, skip, breaks = False, False, 0
    #: Whether the open link has an end of its own, and whether the block began in it.
    ended, began = False, False
    closed: set[int] | None = None

    def flush() -> None:
        nonlocal in_link, began
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks.append(Block(text, links[0], links[1], bool(stack) and stack[-1].article, began))
            parts.clear()
        # A link that nothing ends goes no further than its block.
        in_link = began = in_link and ended
        links[:] = [0, int(in_link)]

    for start, text, name, closing, attributes in _pieces(html):
        if text is not None:
            if not (skip or stack and stack[-1].left_out):
                text = unescape(text)
                parts.append(text)
                if not text.isspace():
                    breaks = 0
                    if in_link:
                        links[0] += len("".join(text.split()))
            continue
        if name in RAW:
            parts.append(" ")
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if name == "a":
            in_link = not closing
            links[1] += not closing
            if in_link:
                following = _LINK.search(html, start + 2)
                ended = following is not None and following[1] == "/"
            continue
        if name in BLOCKS:
            flush()
            breaks = 0
            skip = False
        if name not in CONTAINERS:
            if name in BLOCKS and not closing and len(attributes) > 6:
                # A paragraph may be a notice of its own; it ends where the next block begins.
                skip = _element(stack[-1] if stack else _NOTHING, name, attributes).left_out
            continue
        if closing:
            # Up to the element's own start, if it has one.
            while opened[name]:
                last = stack.pop()
                opened[last.name] -= 1
                if last.name == name:
                    break
        elif not attributes.endswith("/"):
            if name in ("html", "body"):
                stack.clear()  # the page's own element ends an unclosed head
                opened.clear()
            if name in ARTICLES and stack and stack[-1].left_out and not stack[-1].comments:
                if closed is None and name == "article" and not lift:
                    closed = _closed(html)
                if lift or name != "article" or not any(e.beside and e.start in closed for e in stack):
                    while stack and stack[-1].left_out:  # nor is an article part of an unclosed advert
                        opened[stack.pop().name] -= 1
            stack.append(_element(stack[-1] if stack else _NOTHING, name, attributes, start))
            opened[name] += 1
    flush()
    return blocks


def _element(above: _Open, name: str, attributes: str, start: int = 0) -> _Open:
    """What an element and those around it say about its text."""
    marks = _marks(attributes) if "=" in attributes else set()
    comments = above.comments or bool(marks & COMMENT_MARKS)
    if name in ("html", "body"):
        return _Open(name, False, False, False)
    if name in ARTICLES and not comments:
        return _Open(name, above.left_out, True, False)
    # The header of an article holds its headline.
    marked = marks & (MARKS | ROLES) - (HEADLINE_MARKS if above.article else frozenset())
    named = bool(marked) or name in LEFT_OUT and not (name == "header" and above.article)
    hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
    beside = name in BESIDE or bool(marked & BESIDE_MARKS)
    return _Open(name, above.left_out or named or hidden, above.article, comments, beside, start)


GOOD, BAD, OPEN = 1, -1, 0


def _linked(block: Block) -> float:
    letters = len(block.text.replace(" ", ""))
    return block.link_chars / letters if letters else 0.0


def _decide_article(block: Block) -> int:
    """The label of an article's block on its own."""
    if _linked(block) > LINKED_ARTICLE and (block.n_links > 1 or block.in_link):
        return BAD
    return GOOD if len(block.text) >= SHORT else OPEN


def _decide(block: Block, known: bool = True) -> int:
    """The label of any other block on its own; by links and length alone if the page's language is not ``known``."""
    if _linked(block) > LINKED:
        return BAD
    if len(block.text) < SHORT:
        return OPEN
    if not known:
        return GOOD
    words = _WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if stops >= STOPS_HIGH:
        return GOOD if len(block.text) >= LONG or stops >= 2 * STOPS_HIGH else OPEN
    return OPEN if stops >= STOPS_LOW else BAD


def _known_language(blocks: list[Block]) -> bool:
    """Whether a listed stop word stands anywhere on the page."""
    return any(w in STOP_WORDS for b in blocks for w in _WORD.findall(b.text.lower()))


def _has_article(blocks: list[Block]) -> bool:
    return any(b.in_article and _decide_article(b) == GOOD for b in blocks)


def _settle(blocks: list[Block], labels: list[int], alone: int) -> list[int]:
    """The second pass over neighbours; ``alone`` is the label where none is decided."""
    before: list[int | None] = []
    after: list[int | None] = []
    for places, found in ((range(len(blocks)), before), (range(len(blocks) - 1, -1, -1), after)):
        last = None
        for place in places:
            if labels[place] != OPEN:
                last = place
            found.append(last)
    after.reverse()
    out = list(labels)
    for place, (left, right) in enumerate(zip(before, after)):
        if labels[place] != OPEN:
            continue
        if left is None and right is None:
            out[place] = alone
        elif left is None or right is None:
            out[place] = labels[right if left is None else left]
        elif place - left < right - place:
            out[place] = labels[left]
        elif place - left > right - place:
            out[place] = labels[right]
        else:
            # As near to one as to the other: a block without a link is text.
            same = labels[left] == labels[right]
            out[place] = labels[left] if same else (BAD if blocks[place].n_links else GOOD)
    return out


def labels_of(blocks: list[Block]) -> list[int]:
    """Both passes: every block is good or bad.

    Where there is an article, blocks have their neighbours on their own side of
    its edge, and open ones outside need a good one there.
    """
    if not _has_article(blocks):
        # Nothing on the page speaks against a page of open blocks.
        known = _known_language(blocks)
        return _settle(blocks, [_decide(b, known) for b in blocks], GOOD)
    out = [BAD] * len(blocks)
    for inside, decide, alone in ((True, _decide_article, GOOD), (False, _decide, BAD)):
        chosen = [i for i, b in enumerate(blocks) if b.in_article == inside]
        own = [blocks[i] for i in chosen]
        for i, label in zip(chosen, _settle(own, [decide(b) for b in own], alone)):
            out[i] = label
    return out


def main_text(html: str) -> str:
    """The good blocks of a whole page in their order, one line each.

    A page whose only text is an article in an element that is named as something
    else, by a misleading class say, is that article.
    """
    blocks = blocks_of(html)
    labels = labels_of(blocks)
    if GOOD not in labels:
        lifted = blocks_of(html, lift=True)
        if _has_article(lifted):
            blocks, labels = lifted, labels_of(lifted)
    return "\n".join(b.text for b, label in zip(blocks, labels) if label == GOOD)


def main_text_column(html: Column) -> Column:
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p or "") for p in pages], dtype=object)

    return F.pandas_udf(run, "string")(html)


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text``, one row per input row; a page without a good block has an empty text.

    A null page is an empty one.  Null and repeated keys are kept as they are;
    other columns are not looked at.
    """
    importable(pages.sparkSession)
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), main_text_column(body).alias("text"))


@query("op8_html_text", "pages")
def op8(pages: DataFrame) -> DataFrame:
    """The contract's columns of every page."""
    return extract_main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
