"""Main text of HTML pages by two passes of block rules.

First pass: a page is cut into blocks at block-level tags; each block is decided
by where it stands (navigation, footer, advert, form, comment containers), by
link density, by length and by stop-word density, or is left ambiguous because
it is short.  Second pass: an ambiguous block takes the label of its nearest
decided neighbours, within its article where the page marks one.

A class or id marks a container only where the name as a whole says so
(``sidebar``, ``ad-box``, but not ``has-sidebar``), and a name around the page's
only articles doesn't make them boilerplate.  Within a marked article nothing is
dropped but marked containers and menus, which are runs of list items that are
links.  Scripts without word lists, and Latin text on pages where no block
reaches the density, are judged by length and links alone; characters of scripts
without spaces count as half a word.  A page of nothing but short blocks keeps them.

Defined cases: null and empty pages give an empty text; unclosed, stray and cut
off tags are tolerated; text in no marked article is judged by the rules alone;
rows are independent of each other, so repeated rows give equal results.  The
work for a page is linear in its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages that are told from lists.
STOP_WORDS = frozenset(
    """
    the of and to in a is that it for was on are as with his they at be this from i have or by one had not but what all were
    when we there can an your which their said if do will each about how up out them then she many some so these would other
    le la les de des du et un une en est que qui dans pour pas au aux sur par avec il elle ce se ne plus sont ou mais nous vous leur son sa ses
    der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am
    el los las y en un una que por con no su para al lo como más pero sus o este sí porque esta entre cuando muy sin sobre del se
    """.split()
)

# HTML elements by role.
BLOCK_TAGS = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = "script|style|noscript|template|textarea|iframe|object|svg|math|title|noframes|audio|video|canvas"
BOILERPLATE_TAGS = frozenset("nav footer aside form button select dialog menu head".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Parts of class and id names; a name is boilerplate if all parts are in either list and one is in the first.
BOILERPLATE_PARTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside widget comment comments
    commentlist disqus replies respond cookie cookies consent gdpr notice notices notification alert popup modal newsletter subscribe signup share
    sharing social related recommended recommendations breadcrumb breadcrumbs menu nav navbar navigation footer header masthead toolbar pagination
    pager login search copyright legal disclaimer skip teaser
    """.split()
)
NEUTRAL_PARTS = frozenset(
    """
    area articles bar block blocks body bottom box btn button buttons col column container form group icons inner item items label left links list
    main media message middle module outer overlay page panel post posts primary right row secondary section side site slot stories story text
    thread top unit view wrap wrapper
    """.split()
)
CONTENT_TAGS = {"main": 1, "article": 2}
ARTICLE_NAMES = frozenset("ad ads advert advertisement comment comments reply promo sponsored teaser related recommended".split())  # whole names that make an article none
LIST_TAGS = frozenset("li dd dt option td th".split())
SCOPES = frozenset("table caption td th".split())  # a closing tag of anything else doesn't reach beyond them
TABLE_TAGS = frozenset("table caption tbody thead tfoot tr td th".split())
HEADING_TAGS = frozenset("h1 h2 h3 h4 h5 h6".split())

SHORT_WORDS = 10  # a block of fewer words is ambiguous
STOP_DENSITY = 0.12  # of a running text at least
LINK_DENSITY = 0.5  # of characters, beyond which a block is a list of links
MENU = 3  # list items of links in a row that make a menu of an article

TOKEN = re.compile(
    rf"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<raw>{RAW_TAGS})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*[^>]*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(?=[a-zA-Z/!?])[^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"\w+")
# Scripts that are written without spaces between words, and letters that aren't Latin.
UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿]")
OTHER_LETTERS = re.compile("[Ͱ-᷿Ⰰ-꯿가-힯豈-﷿ﹰ-﻾]")
NAME_PARTS = re.compile(r"[a-z]+|[0-9]+|[^\x00-\x7f]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Block:
    """Text between block-level tags, where it stands and how it is labelled."""

    __slots__ = ("text", "linked", "hinted", "around", "article", "kind", "tag", "label")

    def __init__(self, text: str, linked: int, tag: str, place: Place):
        self.text, self.linked, self.tag = text, linked, tag
        self.hinted, self.around, self.article, self.kind = place.hinted, place.around, place.article, place.kind
        self.label: bool | None = None

    @property
    def heading(self) -> bool:
        return self.tag in HEADING_TAGS


class Place:
    """An open element: within boilerplate, a name around its article, the article's number and kind."""

    __slots__ = ("tag", "hinted", "around", "article", "kind")

    def __init__(self, tag: str = "", hinted: bool = False, around: bool = False, article: int = 0, kind: int = 0):
        self.tag, self.hinted, self.around, self.article, self.kind = tag, hinted, around, article, kind


def boilerplate_name(name: str) -> bool:
    parts = NAME_PARTS.findall(CAMEL.sub("-", name).lower())
    kinds = [p in BOILERPLATE_PARTS for p in parts if not p.isdigit()]
    return any(kinds) and all(p.isdigit() or p in BOILERPLATE_PARTS or p in NEUTRAL_PARTS for p in parts)


def _hint(tag: str, attrs: str, in_article: bool) -> int:
    """2 if the element is boilerplate by its tag, role or style, 1 by its name, else 0."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not in_article:
        return 2
    if not attrs or tag in ("html", "body", "main"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if tag == "article":
            if name in ("class", "id") and not ARTICLE_NAMES.isdisjoint(value.lower().split()):
                return 2
            continue
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return 2
        if name == "role" and value.lower() in BOILERPLATE_ROLES:
            return 2
        if name in ("class", "id") and any(map(boilerplate_name, value.split())):
            found = 1
    return found


class Stack:
    """Open elements; how many of each tag are open in the innermost table cell is known without a search."""

    def __init__(self) -> None:
        self.places: list[Place] = []
        self.open: list[dict[str, int]] = [{}]

    def top(self) -> Place:
        return self.places[-1] if self.places else Place()

    def push(self, place: Place) -> None:
        self.places.append(place)
        self.open[-1][place.tag] = self.open[-1].get(place.tag, 0) + 1
        if place.tag in SCOPES:
            self.open.append({})

    def pop(self) -> str:
        tag = self.places.pop().tag
        if tag in SCOPES:
            self.open.pop()
        self.open[-1][tag] -= 1
        return tag

    def close(self, tag: str) -> None:
        """Closes the innermost open element of the tag with all that is open in it; a stray tag closes nothing."""
        if tag in TABLE_TAGS:
            if any(scope.get(tag) for scope in reversed(self.open[-4:])):
                while self.pop() != tag:
                    pass
        elif self.open[-1].get(tag):
            while self.pop() != tag:
                pass


def blocks_of(html: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    links, linked, articles, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            place = stack.top()
            out.append(Block(text, linked, place.tag, place))
        parts.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    for m in TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        closing = bool(m["close"])
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK_TAGS:
            flush()
            links = 0
            if closing:
                stack.close(tag)
            elif tag not in VOID_TAGS:
                if stack.top().tag == "p" or tag in LIST_TAGS | {"tr"} and stack.top().tag == tag or tag == "body" and stack.top().tag == "head":
                    stack.pop()
                on = stack.top()
                hint = _hint(tag, m["attrs"], on.article > 0)
                place = Place(tag, on.hinted or hint == 2 or hint == 1 and on.article > 0, on.around or hint == 1 and not on.article, on.article, on.kind)
                if CONTENT_TAGS.get(tag, 0) > on.kind and not place.hinted:
                    articles += 1
                    place.article, place.kind = articles, CONTENT_TAGS[tag]
                stack.push(place)
    if at < len(html):
        add(html[at:])
    flush()
    return out


def _size(text: str) -> int:
    """Words of a text; characters of scripts without spaces count half."""
    n = len(UNSPACED.findall(text))
    return -(-n // 2) + len(WORD.findall(UNSPACED.sub(" ", text) if n else text))


def _running(b: Block) -> bool:
    """Whether a long block reads like running text, as far as its script lets us know."""
    if 2 * len(OTHER_LETTERS.findall(b.text)) > sum(map(str.isalpha, b.text)):
        return True
    words = WORD.findall(b.text.lower())
    return sum(w in STOP_WORDS for w in words) >= STOP_DENSITY * len(words)


def _menus(blocks: list[Block]) -> set[int]:
    """Places of list items that are links, MENU or more in a row, in articles."""
    out: set[int] = set()
    run: list[int] = []
    for i, b in enumerate([*blocks, None]):
        if b is not None and b.article and b.tag in LIST_TAGS and b.linked > LINK_DENSITY * len(b.text) and _size(b.text) < SHORT_WORDS:
            run.append(i)
        else:
            out.update(run if len(run) >= MENU else ())
            run = []
    return out


def _settle_articles(blocks: list[Block]) -> bool:
    """Decides which articles count, marks all other blocks as standing in none, and says whether there is one."""
    held: dict[tuple[int, bool], int] = {}
    for b in blocks:
        if b.article and not b.hinted:
            held[b.kind, b.around] = held.get((b.kind, b.around), 0) + len(b.text)
    around = not any(not a for _, a in held)  # all articles stand below a name: it is theirs, not boilerplate's
    least = 2 if held.get((2, around), 0) >= held.get((1, around), 0) else 1
    for b in blocks:
        if b.article and (b.kind < least or b.around != around):
            b.hinted = b.hinted or b.around
            b.article = 0
        elif b.around and not b.article:
            b.hinted = True
    return bool(held)


def classify(blocks: list[Block]) -> None:
    """Labels every block: True is main text."""
    marked = _settle_articles(blocks)
    menus = _menus(blocks)
    long: list[Block] = []
    for i, b in enumerate(blocks):  # first pass
        if b.hinted or i in menus or not b.article and b.linked > LINK_DENSITY * len(b.text):
            b.label = False
        elif _size(b.text) < SHORT_WORDS:
            b.label = None
        else:
            b.label = b.article > 0 or _running(b)
            long.append(b)
    if not any(b.label for b in long):  # a language without a list
        for b in long:
            b.label = True
    decided = [b.label for b in blocks]
    before: list[tuple[int, bool] | None] = _nearest(blocks, decided, 1)
    after = _nearest(blocks, decided, -1)
    for i, b in enumerate(blocks):  # second pass
        if b.label is not None:
            continue
        near = [x for x in (before[i], after[i]) if x]
        if b.heading and after[i]:  # a heading goes with what it heads
            b.label = after[i][1]
        elif b.article:
            b.label = True
        elif near:
            b.label = not marked and min(near, key=lambda x: (abs(x[0] - i), x[1]))[1]
        else:
            b.label = not marked and not long and _size(b.text) > 0
    if marked:  # running text outside a marked article is no part of it
        for b in blocks:
            b.label = b.label and b.article > 0


def _nearest(blocks: list[Block], decided: list[bool | None], step: int) -> list[tuple[int, bool] | None]:
    """For each block the nearest decided one on one side, of its own article where it stands in one; containers that don't count as text decide nothing."""
    out: list[tuple[int, bool] | None] = [None] * len(blocks)
    last: dict[int, tuple[int, bool]] = {}
    for i in range(len(blocks))[::step]:
        b = blocks[i]
        out[i] = last.get(b.article)
        if decided[i] is not None and not b.hinted:
            last[b.article] = (i, bool(decided[i]))
    return out


def main_text(html: str | None) -> str:
    """The page's main text, its blocks joined by spaces."""
    blocks = blocks_of(html or "")
    classify(blocks)
    return " ".join(b.text for b in blocks if b.label)


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col(f"`{id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
