"""Main text of HTML pages by two passes of rules over blocks.

The first pass scores every block by itself: its length, the density of stop words, the density of links, and, as further
features, what its elements and their names say about the part of the page. High scores are text, low ones are not.
The second pass gives the blocks between, mostly short ones, the label of their nearest decided neighbour."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched, rows

#: A comment, another declaration, or a tag: its name, then anything up to the first ">" that is in no quoted value. Quotes open a value only behind "=".
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z>][^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
MAY_HIDE = re.compile(r"hidden|display", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
LETTERS = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s+")

# HTML elements by what they mean here.
RAW = frozenset("script style noscript template textarea select iframe svg math object canvas video audio title option datalist".split())
ENDLESS = frozenset("script style textarea title".split())  # without an end tag they go on to the end of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
APART = frozenset("nav aside footer form button menu dialog head".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split()
)
MAIN, WALLS, HOLDS, BREAKS = frozenset(("article", "main")), frozenset(("article", "main", "body")), frozenset(("aside", "form")), frozenset(("br", "td", "th"))
#: Words in class, id or role that mark a part as no article text.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer masthead menu modal nav navbar navigation newsletter notice alert pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored sponsors subscribe toolbar widget widgets complementary contentinfo disclaimer paywall login discussion".split()
)
#: Words before them that only say where a part of the page stands.
PLACES = frozenset("site page main post entry article global top bottom left right".split())
#: The commonest function words of widely written languages.
STOP = frozenset(
    "the of and to in a is that it for was on are as with be by this from at have or an they which not he we but you der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei noch wie einem le la les et des en un une du que est pour qui dans au sur pas par plus avec ne ce se son il sont aux el los las de y que una por con para del se no su al lo como más o pero di che è il della per non i una sono da os um do na não com uma het van een dat op te zijn".split()
)


def hidden(attributes: str) -> bool:
    """Whether the attributes hide an element: by name (hidden, aria-hidden) or by style, not by words in other values."""
    if not MAY_HIDE.search(attributes):
        return False
    for x in ATTRIBUTE.finditer(attributes):
        name, value = x[1].lower(), (x[2] or x[3] or x[4] or "").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and NO_DISPLAY.search(value):
            return True
    return False


def marked(attributes: str) -> set[str]:
    """What class, id and role call an element: of every token the leading word, behind words of PLACES. has-sidebar is no sidebar."""
    out = set()
    for x in ATTRIBUTE.finditer(attributes):
        for token in (x[2] or x[3] or x[4] or "").lower().split() if x[1].lower() in ("class", "id", "role") else ():
            words = [w for w in re.split(r"[^a-z]+", token) if w]
            while len(words) > 1 and words[0] in PLACES:
                del words[0]
            out.update(words[:1])
    return out


#: What the features of a block add to its score. At GOOD or more it is text, at BAD or less it is not.
LONG, MEDIUM, SHORT = 1.0, 0.5, 0.0  # from 200 characters, from 70, below
MANY_STOP, SOME_STOP, NO_STOP = 1.0, 0.5, -0.5  # a share of stop words from 0.2, from 0.1, below 0.05; not for short blocks
MOSTLY_LINK, HALF_LINK, LINK_ITEM, RIGHTS = -1.5, -0.5, -1.0, -1.5
IN_ARTICLE, BESIDE_ARTICLE, IN_PART = 1.0, -2.5, -4.0  # no prose makes up for a part such as an advert or comment; prose beside an article is left to its neighbours
GOOD, BAD = 1.5, -1.0


@dataclass(slots=True)
class Block:
    """A block's text and features: characters in links, whether it is an item of a list, in a part such as a menu or advert, in an article."""

    text: str
    linked: int
    item: bool
    part: bool
    article: bool


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Broken markup is no error; time is linear in the page's length, however deep its elements are."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # element, part, article
    places: dict[str, list[int]] = {}  # where the open elements of a name stand in the stack
    walls = [-1]  # open articles and bodies, which end tags of inner elements don't close
    parts: list[str] = []
    endless: dict[str, int] = {}  # from where on an element has no end tag
    linked = in_part = in_article = held = 0  # held: open elements that an article doesn't break out of
    at = 0

    def close() -> None:
        nonlocal parts, linked
        if parts and (text := SPACE.sub(" ", "".join(parts)).strip()):
            out.append(Block(text, linked, any(x[0] == "li" for x in stack[-3:]), in_part > 0, in_article > 0))
        parts, linked = [], 0

    def past(name: str, start: int) -> int:
        """Behind the end tag of an element whose content is no text. That there is none from some place on is found once a name."""
        stop = None if endless.get(name, len(page) + 1) <= start else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, start)
        if stop:
            return stop.end()
        endless[name] = min(start, endless.get(name, start))
        return len(page) if name in ENDLESS else start

    def pop(to: int) -> None:
        nonlocal in_part, in_article, held
        while len(stack) > to:
            name, part, article = stack.pop()
            places[name].pop()
            in_part -= part
            in_article -= article
            held -= name in HOLDS or part and name == "section"
            if walls[-1] >= len(stack):
                walls.pop()

    while m := TOKEN.search(page, at):
        start = m.start()
        if start > at:
            text = html.unescape(page[at:start])
            parts.append(text)
            if places.get("a"):
                linked += len(text.strip())
        at = m.end()
        name, attributes = (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        end, empty = m[1] == "/", attributes.endswith("/")
        if name in RAW:
            if not end and not empty:
                at = past(name, at)
            parts.append(" ")
            continue
        if name in BLOCK:
            close()
        elif name in BREAKS:
            parts.append(" ")
        known = places.get(name)
        if end:
            if known and (known[-1] >= walls[-1] or name == "body" or name == "html"):
                pop(known[-1])
            continue
        if name in VOID or empty:
            continue
        if name in BLOCK and (p := places.get("p")) and p[-1] >= len(stack) - 6:  # a new block ends a paragraph
            pop(p[-1])
        if name == "li" and stack and stack[-1][0] == "li" or name == "a" and known and known[-1] > walls[-1]:
            pop(known[-1])
        part = article = False
        if attributes and ("=" in attributes or MAY_HIDE.search(attributes)):
            marks = marked(attributes)
            part = bool(marks & BOILER) and (name not in MAIN or in_part > 0)  # its name alone doesn't make an article a comment
            part |= hidden(attributes) or "header" in marks and not in_article and name not in MAIN
        article = name in MAIN and not part
        if article and in_part and not in_article and not held:
            while in_part:  # an unclosed menu or advert before the article
                pop(len(stack) - 1)
        part = (part or name in APART or name == "header" and not in_article) and name not in ("body", "html")
        places.setdefault(name, []).append(len(stack))
        if name in WALLS:
            walls.append(len(stack))
        stack.append((name, part, article))
        in_part += part
        in_article += article
        held += name in HOLDS or part and name == "section"
    if at < len(page):
        parts.append(html.unescape(page[at:]))
    close()
    return out


def score(b: Block, beside: bool) -> float:
    """The first pass: what a block's features add up to. beside: there is an article on the page and the block isn't in it."""
    n = len(b.text)
    s = LONG if n >= 200 else MEDIUM if n >= 70 else SHORT
    if n >= 70:
        words = LETTERS.findall(b.text.lower())
        stop = sum(w in STOP for w in words) / max(1, len(words))
        s += MANY_STOP if stop >= 0.2 else SOME_STOP if stop >= 0.1 else NO_STOP if stop < 0.05 else 0.0
    density = b.linked / n
    s += MOSTLY_LINK if density > 0.5 else HALF_LINK if density > 0.25 else 0.0
    s += LINK_ITEM if b.item and density > 0.5 else 0.0
    s += RIGHTS if "©" in b.text and n < 200 else 0.0
    return s + (IN_PART if b.part else 0.0) + (IN_ARTICLE if b.article else BESIDE_ARTICLE if beside else 0.0)


def decide(found: list[Block]) -> list[bool | None]:
    """The first pass over a page: True text, False none, None not decided."""
    some = any(b.article and not b.part for b in found)
    return [True if s >= GOOD else False if s <= BAD else None for s in (score(b, some and not b.article) for b in found)]


def inherit(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """The second pass: blocks that aren't decided take the label of the nearest decided block, those of an article among themselves.

    At equal distance of unlike labels, and where nothing is decided, they are text; beside an article they aren't."""
    out, some = list(labels), any(b.article and not b.part for b in found)
    for region in (True, False):
        group, default = [k for k, b in enumerate(found) if b.article is region], region or not some
        before: list[tuple[int, bool]] = [(-1, True)] * len(group)  # how far the last decided block is, and its label
        last = None
        for k, i in enumerate(group):
            last = (k, labels[i]) if labels[i] is not None else last
            before[k] = (k - last[0], last[1]) if last else (len(found) + 1, default)
        last = None
        for k in range(len(group) - 1, -1, -1):
            i = group[k]
            last = (k, labels[i]) if labels[i] is not None else last
            if labels[i] is None:
                after = (last[0] - k, last[1]) if last else (len(found) + 1, default)
                out[i] = before[k][1] if before[k][0] < after[0] else after[1] if after[0] < before[k][0] else before[k][1] or after[1]
    return out


def main_text(page: str | None) -> str:
    """The blocks that the two passes call text, joined by blank lines; empty if there are none."""
    if not page:
        return ""
    found = blocks(page)
    return "\n\n".join(b.text for b, good in zip(found, inherit(found, decide(found))) if good)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page. No shuffle.

    Null or empty html gives an empty text. Repeated rows and null ids or urls stay. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(((i, u, t := main_text(h), len(t)) for i, u, h in rows(batches, "id", "url", "html")), _OUT, 500)

    chosen = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
