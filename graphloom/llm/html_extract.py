"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass labels blocks by container, link density, length and
stop-word density; short blocks, and long ones of an article that the words don't decide, stay open. The second pass gives
an open block the label of its nearest decided neighbours within its region (an article, or what is outside of articles).

What is outside of an article goes. Several articles that hold fewer words of good blocks than the rest, or one that holds none, are mere parts of the
page, such as cards of a list, and only blocks of their own merit stay. An article in another, or one whose marks say so, may be a reader's comment. Stop words are those of
four languages. Where they decide for no block of a page, as in other languages or on short pages, blocks that neither marks nor links speak against are
its text. Text in other scripts than Latin is decided by its length and links alone.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filled_id, true_id

# Frequent function words.
STOP_WORDS = frozenset(
    # English
    "the of and to in is that it for was on are as with be by this at from or an have not but had his they you which were all we there can "
    # German
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind "
    # French
    "de la le et les des en un du une que est pour qui dans par au sur pas plus ne se ce il sont avec ou aux son "
    # Spanish
    "el los las y del por con para su al lo como más pero sus una o este sí porque esta entre cuando muy sin sobre".split()
)
# Elements whose content is never text of the page.
RAW = "script|style|noscript|template|title|textarea|select|svg|iframe|object|math|canvas|audio|video"
# Elements that begin and end a block.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
# Elements that are a block themselves, rather than hold several.
HOLDERS_NOT = frozenset("p h1 h2 h3 h4 h5 h6 caption dd dt figcaption legend option pre summary td th".split())
# Elements that hold no main text; the last two do inside an article.
BOILER_TAGS = frozenset("nav footer aside form menu dialog button label fieldset head".split())
OUTER_TAGS = frozenset("header".split())
# Words of class and id attributes that mark boilerplate; the last ones only outside of articles.
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs footer sidebar cookie cookies consent notice notices banner popup modal comment comments reply replies respond disqus review reviews share sharing social related newsletter subscribe signup login form pagination pager widget".split()
)
OUTER_WORDS = frozenset("header masthead top".split())
# Those of them that name a subject as well, as in share-price. In an article, long blocks there decide themselves, unless the name has nothing but such
# words and those of mere layout.
SUBJECT_WORDS = frozenset("share sharing social related form pager login promotion widget".split())
LAYOUT_WORDS = frozenset("post posts article articles story stories link links list box block wrapper wrap container section bar button buttons item items icons area inner outer row col".split())
# Those that mark readers' comments, also on an article.
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus review reviews".split())

#: A quote counts in a tag only after an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>=]++|=\s*(?:\"[^\"]*\"|'[^']*')|=)*+)>|<[!?/][^>]*>", re.S | re.I
)
ATTRIBUTE = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
UNSEEN = re.compile(r"(?<![\w-])(?:aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*|[^\s\"'>]*)display\s*:\s*none)", re.I)
LINK = re.compile(r"(?<![\w-])href\s*=", re.I)
OTHER_SCRIPT = re.compile(r"[^\x00-\u02af\u1e00-\u2bff]+")
EDGE = re.compile(r"^\W+|\W+$")

#: Link density above which a block is boilerplate, words from which a block can decide itself, stop-word densities.
MAX_LINKS, LONG, STOPS_GOOD, STOPS_BAD = 0.5, 10, 0.15, 0.05
#: Letters that count as a word in other scripts than Latin, some of which have no spaces.
LETTERS_A_WORD = 4
GOOD, BAD, OPEN = 1, -1, 0


@dataclass
class Block:
    text: str
    linked: int
    boiler: bool
    region: int  # number of the article it is in; 0: outside
    parent: int = 0  # number of the element that holds it
    subject: bool = False  # within boilerplate only by a word that may name a subject


@dataclass
class Element:
    name: str
    boiler: bool  # its own marks, or those of an element around it
    region: int
    parent: int  # number of the nearest element, itself included, that may hold several blocks
    subject: bool


OUTSIDE = Element("", False, 0, 0, False)


def marks_of(name: str, attributes: str, region: int, outermost: bool = False) -> tuple[bool, bool]:
    """Whether an element's tag and words mark boilerplate, and whether they may name a subject in place of it. ``outermost``: an article or main in no other."""
    sure, subject = name in BOILER_TAGS or not region and name in OUTER_TAGS, False
    if attributes and name not in ("html", "body"):
        names = [[w.lower() for w in NAME_WORD.findall(part)] for x in ATTRIBUTE.finditer(attributes) for part in (x[1] or x[2] or x[3] or "").split()]
        words = {w for own in names for w in own}
        if outermost:
            sure |= bool(words & COMMENT_WORDS)
        else:
            plain = any(set(own) & SUBJECT_WORDS and set(own) <= SUBJECT_WORDS | LAYOUT_WORDS for own in names)
            sure |= plain or bool(words & (BOILER_WORDS - SUBJECT_WORDS)) or not region and bool(words & OUTER_WORDS)
            subject = bool(words & SUBJECT_WORDS)
        sure |= bool(UNSEEN.search(attributes) or HIDDEN.search(QUOTED.sub("", attributes)))
    return sure, subject


def blocks(page: str) -> list[Block]:
    """The page's blocks that have text, in order; mended as browsers do where elements aren't closed.

    A link goes on over the blocks in it, until its end, the next link, or the end of the element in which it began.
    """
    out: list[Block] = []
    stack: list[Element] = [OUTSIDE]
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    linked, link_at, articles, opened = 0, 0, 0, 0  # link_at: depth at which the open link began; 0: none

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            e = stack[-1]
            out.append(Block(text, linked, e.boiler or e.subject, e.region, e.parent, e.subject and not e.boiler))
        parts.clear()
        linked = 0

    def leave(depth: int) -> None:
        nonlocal link_at
        open_names.subtract(e.name for e in stack[depth:])
        del stack[depth:]
        if link_at > depth:
            link_at = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            parts.append(html.unescape(raw))
            if link_at:
                linked += size(parts[-1])

    at = 0
    for m in TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name == "br" or m[1]:
            parts.append(" ")
        elif name == "a":
            link_at = 0 if m[2] or not LINK.search(m[4]) else len(stack)
        elif name in BLOCK:
            close()
            if m[2]:
                if open_names[name]:
                    leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name))
                continue
            if stack[-1].name == "p" or name in ("li", "td", "tr", "dd", "dt") and stack[-1].name == name:
                leave(len(stack) - 1)
            if name == "hr":
                continue
            e = stack[-1]
            region = e.region
            outermost = name in ("article", "main") and not region
            if outermost:
                articles += 1
                region = articles
            sure, subject = marks_of(name, m[4], region, outermost)
            opened += 1
            stack.append(Element(name, e.boiler or sure, region, e.parent if name in HOLDERS_NOT else opened, e.subject or subject))
            open_names[name] += 1
    add(page[at:])
    close()
    return out


def other_letters(text: str) -> int:
    """Number of letters of other scripts, if they are most of the text; else 0."""
    n = 0 if text.isascii() else len(text) - len(OTHER_SCRIPT.sub("", text))
    return n if 2 * n > len(text) - text.count(" ") else 0


def size(text: str) -> int:
    """Number of words; in other scripts than Latin, of groups of letters."""
    return max(len(text.split()), other_letters(text) // LETTERS_A_WORD)


def merit(b: Block) -> tuple[int, int]:
    """Size and label of a block by its links, length and words."""
    n = size(b.text)
    if b.boiler and not (b.subject and b.region):
        return n, BAD
    if b.linked > MAX_LINKS * n:
        return n, OPEN if b.region and n >= LONG else BAD
    if n < LONG:
        return n, BAD if b.boiler else OPEN
    if other_letters(b.text):
        return n, GOOD
    words = b.text.split()
    stops = sum(EDGE.sub("", w).lower() in STOP_WORDS for w in words) / len(words)
    if stops >= STOPS_GOOD:
        return n, GOOD
    return n, BAD if b.boiler or stops < STOPS_BAD and not b.region else OPEN


def first_pass(own: list[Block]) -> list[int]:
    """Labels of blocks by themselves. Articles stand for all of the main text, unless they hold fewer words of good blocks than the rest, and are several or hold none."""
    found = [merit(b) for b in own]
    inside, outside = (sum(n for b, (n, label) in zip(own, found) if label == GOOD and (b.region > 0) == side) for side in (True, False))
    articles = {b.region for b in own if b.region and not b.boiler}
    if inside < outside and (len(articles) > 1 or not inside):  # mere parts
        for b in own:
            b.region = 0
        found = [merit(b) for b in own]
        articles = set()
    labels = [label if b.region or not articles else BAD for b, (_, label) in zip(own, found)]
    if GOOD not in labels:  # words decide nothing: what nothing speaks against, long blocks first
        free = [not b.boiler and b.linked <= MAX_LINKS * n and (b.region > 0 or not articles) for b, (n, _) in zip(own, found)]
        long = [ok and n >= LONG for ok, (n, _) in zip(free, found)]
        keep = long if any(long) else free
        if sum(n for ok, (n, _) in zip(keep, found) if ok) > 1:  # a single word is no text
            labels = [GOOD if ok else label for ok, label in zip(keep, labels)]
    return labels


def second_pass(own: list[Block], labels: list[int]) -> list[int]:
    """Open blocks get the label of the nearer decided neighbour of their region, one in the same element counting as half a block nearer.

    Outside of articles the page's ends count as boilerplate. Where both are as near, or there is none, the region decides.
    """
    found: list[dict[int, tuple[float, int]]] = []
    for step in (1, -1):  # the nearest decided block before, then after
        near = {0: (-1 if step == 1 else len(own), BAD, -1)}
        seen = {}
        for k in range(len(own))[::step]:
            b = own[k]
            if labels[k] == OPEN:
                j, label, parent = near.get(b.region, (None, OPEN, -1))
                seen[k] = (float("inf") if j is None else abs(k - j) - 0.5 * (parent == b.parent), label)
            elif not b.boiler:
                near[b.region] = (k, labels[k], b.parent)
        found.append(seen)
    out = list(labels)
    for k, (before, label) in found[0].items():
        after, other = found[1][k]
        out[k] = label if before < after or label == other else other if after < before else OPEN
        out[k] = out[k] or (GOOD if own[k].region else BAD)
    return out


def main_text(page: str | None) -> str:
    """The main text; empty for a null or empty page."""
    if not page:
        return ""
    own = blocks(page)
    labels = second_pass(own, first_pass(own))
    return " ".join(b.text for b, label in zip(own, labels) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: (page_id, url, text, n_chars).

    A null or empty page, and one without main text, gives the empty text; null ids and urls pass through. Pages of any
    length are read whole; repeated rows give repeated results; empty table: empty result. Further columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["page_id", "url"]].copy()
            out["text"] = [main_text(x) if isinstance(x, str) else "" for x in batch["html"]]
            out["n_chars"] = out["text"].str.len().astype("int64")
            yield out

    cols = pages.select(filled_id("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cols.mapInPandas(run, "page_id long, url string, text string, n_chars long").withColumn("page_id", true_id("page_id"))
