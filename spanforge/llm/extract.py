"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at block-level tags. The first pass decides what it can from where a block stands, its link density,
its length and its share of stop words; blocks that are short, or long with few stop words, stay open. The second pass gives
an open block the label of the nearest decided one.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm._shared import small_batches, table

#: Share of a block's characters inside links above which it is a menu.
MOST_LINKS = 0.5
#: Characters below which a block is short, and above which running text is good by itself.
SHORT, LONG = 70, 200
#: Share of stop words of running text: surely, and perhaps.
STOPS_HIGH, STOPS_LOW = 0.30, 0.18
#: Share of stop words on the whole page below which it is taken for another language.
FEW_STOPS = 0.02
#: Inside an article these are enough.
ARTICLE_STOPS, ARTICLE_SHORT = 0.08, 25

STOP_WORDS = frozenset(
    """
    the and of to a in is that it for was on with as are be at by this from have has had not or an but they which
    you we he she his her their its were been will would can all one there so what about who if when more
    der die das und ist nicht ein eine einen einem einer den dem des von zu mit sich auf für im als auch es an werden aus er
    hat dass sie nach wird bei noch wie um am sind war oder wenn nur
    le la les et de du des un une est que qui dans pour pas au aux sur par il elle ne ce se avec sont plus son sa ses
    ou mais comme nous vous leur été cette ces
    el los las y en que del se por con una su para al lo como más pero sus fue este ha es o sobre también entre no
    il di che non per sono da della dei delle gli nel alla si o os um uma não com em dos das ao het een van niet
    """.split()
)

#: Elements whose content is no markup; without an end tag, that of the first two runs to the end of the page.
_RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
_RAW_TO_END = frozenset(("script", "style"))
#: Elements that show no running text. Without an end tag, or closed by "/>", only their tag goes.
_DROPPED = frozenset("noscript template select button svg object math canvas audio video datalist".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+)>"
    # A quote that is not closed before the tag ends belongs to the tag.
    r"|<(/?)([a-z][^\s/<>]*)([^<>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img input del picture source".split())
#: Elements that are followed from their start to their end tag.
_NESTED = frozenset("div section article main nav header footer aside form ul ol dl table head fieldset dialog menu figure details li".split())
_OUT = frozenset("nav footer aside form head dialog menu fieldset".split())
_LISTS = frozenset("ul ol dl menu".split())
#: Of these, and of elements named by hints, pages sometimes have one around everything: then it decides nothing.
_PAGE_WIDE = frozenset(("form", "fieldset"))
_HINTS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe
    subscription signup login comment comments disqus reply replies respond related recommended recommendations share sharing social
    widget pagination pager toolbar skip copyright disclaimer alert topbar
    """.split()
)
#: Words that with hints make up whole names, as in share-buttons; other names only have a hint as a part.
_HOLDERS = frozenset(
    """
    list lists section area thread threads wrapper wrap container box block blocks inner outer form panel feed holder group item items bar
    button buttons icon icons link links post posts article articles story stories content slot unit units label text title top bottom left
    right js id widget widgets banner popup modal
    """.split()
)
#: Words before a hint that make a class speak of the page around it, as in has-sidebar.
_ABOUT = frozenset("has have no non not with without is hide show hidden disable disabled enable enabled js layout theme page main content body article post entry template type style single left right".split())
#: Names under which readers write, if what they hold also has authors or dates.
_VOICES = frozenset("comment comments commentary reply replies respond response responses discussion discussions feedback review reviews thread threads disqus guestbook".split())
_SIGNED = frozenset("author byline date datetime timestamp posted username user avatar ago permalink vcard".split())
#: Share of a page's text that an element may hold and still go for its class (part of one, whole one), or without an end tag.
MOST_PART, MOST_WHOLE = 0.5, 0.8
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‚‘’…–—¿¡"
_DENSE = re.compile("[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff]")
_HEADLINES = frozenset(("h1", "h2", "h3"))


@dataclass
class Block:
    """holder: the nearest element around it that may go, or -1; listed: it stands in a list."""

    text: str
    links: int
    holder: int
    article: int
    headline: bool
    listed: bool
    out: bool = False
    label: str = ""


@dataclass
class Element:
    """An element that is followed to its end.

    most: the share of the page's text from which on it isn't unwanted (0: wanted); comments: by its name it holds readers' comments;
    voices: it may hold them; under: it or one around it is unwanted by its name; outer: the nearest one around it that may go;
    begin, chars: text before and in it; signed: authors and dates in it.
    """

    name: str
    most: float
    comments: bool
    voices: bool
    under: bool
    outer: int
    article: int
    begin: int
    signed: int
    chars: int = 0
    closed: bool = False
    holds_main: bool = False


def _parts(name: str) -> list[str]:
    return [x for x in re.split(r"[-_]+", name) if x]


def _hinted(value: str, in_article: bool) -> float:
    """The most share for a class or id: whole names weigh more than parts of names, which don't count in an article."""
    most = 0.0
    for name in value.split():
        parts = _parts(name)
        known = _HINTS - {"header"} if in_article else _HINTS
        if name in known:
            return MOST_WHOLE
        if len(parts) > 1 and not known.isdisjoint(parts) and parts[0] not in _ABOUT:
            if all(x in known or x in _HOLDERS or x.isdigit() for x in parts):
                return MOST_WHOLE
            if not in_article:
                most = MOST_PART
    return most


def _of_readers(value: str) -> bool:
    """Whether a class or id names the place of readers' comments: the plural, last or before words for places; or comment-list and the like."""
    for name in value.split():
        parts = _parts(name)
        if not parts or parts[0] in _ABOUT:
            continue
        places = [x in _HOLDERS or x.isdigit() for x in parts]
        if name in ("commentlist", "commentsection", "disqus") or "comments" in parts and all(places[parts.index("comments") + 1 :]):
            return True
        if parts[0] in ("comment", "disqus") and len(parts) > 1 and all(places[1:]):
            return True
    return False


def _unwanted(name: str, attributes: str, in_article: bool) -> tuple[float, bool, bool]:
    """(most, comments, voices) of an element, from its name and attributes."""
    most, comments, voices = 0.0, False, False
    if name in _OUT and not (name == "aside" and in_article) or name == "header" and not in_article:
        most = MOST_PART if name in _PAGE_WIDE else 1.0
    for key, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            most = 1.0
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            most = 1.0
        if key == "role" and value in _ROLES:
            most = 1.0
        if key in ("class", "id"):
            most = max(most, _hinted(value, in_article))
            comments = comments or _of_readers(value)
            voices = voices or not _VOICES.isdisjoint(x for n in value.split() for x in _parts(n))
    return most, comments, voices


def _is_signed(name: str, attributes: str) -> bool:
    """Whether a tag begins an author's name or a date."""
    if name == "time":
        return True
    return "class" in attributes and any(k.lower() == "class" and not _SIGNED.isdisjoint(x for n in v.strip("\"'").lower().split() for x in _parts(n)) for k, v in _ATTRIBUTE.findall(attributes))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order; those without text are left out."""
    out: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []
    opened: Counter[str] = Counter()
    article, articles = 0, 0
    #: The nearest element around that may go; text and authors or dates so far; open elements that readers may have written.
    holder, total, signed, voices = -1, 0, 0, 0
    parts: list[str] = []
    links = link = 0
    headline = False
    # The element that is left out with all it holds, and how often it stands inside itself.
    dropped, depth = "", 0
    without_end: set[str] = set()

    def flush() -> None:
        nonlocal links, link, total
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, holder, article, headline, any(opened[x] for x in _LISTS)))
                total += _length(text)
            parts.clear()
        links = link = 0

    def shut(k: int) -> None:
        """Element k ends here."""
        nonlocal voices
        e = elements[k]
        e.chars, e.signed = total - e.begin, signed - e.signed
        opened[e.name] -= 1
        voices -= e.voices

    def end_of(name: str, at: int) -> re.Match | None:
        if name in without_end:
            return None
        found = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
        if not found:
            without_end.add(name)
        return found

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        piece = page[at : m.start() if m else len(page)]
        if piece and not depth:
            parts.append(piece)
            if link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, ends, attributes = name.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if depth:
            # A button or a list of choices can't hold another; of other elements the inner ones are counted.
            if name == dropped and (ends or name not in ("button", "select")) and not attributes.endswith("/"):
                depth += -1 if ends else 1
            continue
        if name in _RAW:
            if not ends:
                found = end_of(name, at)
                at = found.end() if found else len(page) if name in _RAW_TO_END else at
            continue
        if name in _DROPPED:
            if not ends and not attributes.endswith("/") and end_of(name, at):
                dropped, depth = name, 1
            continue
        if voices and not ends and _is_signed(name, attributes):
            signed += 1
        if name in _INLINE:
            if name == "a":
                link = 0 if ends else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        flush()
        headline = name in _HEADLINES and not ends
        if name not in _NESTED:
            continue
        if ends:
            while opened[name]:
                k = stack.pop()
                shut(k)
                article, holder = elements[k].article, elements[k].outer
                if elements[k].name == name:
                    elements[k].closed = True
                    break
        else:
            if name == "main":
                for k in reversed(stack):
                    if elements[k].holds_main:
                        break
                    elements[k].holds_main = True
            most, comments, voiced = _unwanted(name, attributes, article > 0)
            under = most > 0 or comments or holder >= 0 and elements[holder].under
            elements.append(Element(name, most, comments, voiced, under, holder, article, total, signed))
            stack.append(len(elements) - 1)
            opened[name] += 1
            voices += voiced
            if most or comments or voiced:
                holder = stack[-1]
            if name in ("article", "main") and not under:
                articles += 1
                article = articles
    flush()
    for k in stack:
        shut(k)
    _leave_out(out, elements, total)
    return out


def _leave_out(found: list[Block], elements: list[Element], total: int) -> None:
    """Mark the blocks in elements that go: readers' comments whatever they hold, others up to a share of the page without comments."""
    by_readers = [
        not e.holds_main and (e.comments and (e.closed or e.begin >= LONG) or e.voices and e.signed >= 2 and e.begin >= SHORT) for e in elements
    ]
    # An element comes after those around it.
    inside = [False] * len(elements)
    for k, e in enumerate(elements):
        inside[k] = e.outer >= 0 and (by_readers[e.outer] or inside[e.outer])
    rest = total - sum(e.chars for k, e in enumerate(elements) if by_readers[k] and not inside[k])
    gone = [False] * len(elements)
    for k, e in enumerate(elements):
        most = e.most if e.closed else min(e.most, MOST_WHOLE)
        alone = by_readers[k] or not e.holds_main and most > 0 and (most == 1.0 or e.chars <= most * rest)
        gone[k] = alone or e.outer >= 0 and gone[e.outer]
    for b in found:
        b.out = b.holder >= 0 and gone[b.holder]


def stop_share(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(_PUNCTUATION) in STOP_WORDS for w in words) / max(1, len(words))


def _length(text: str) -> int:
    """Characters, those of scripts that write words without blanks for three."""
    return len(text) + 2 * len(_DENSE.findall(text))


def decide(block: Block, known_language: bool = True) -> str:
    """First pass: good, bad, near (perhaps text) or short. In other languages than those of the stop words, length decides."""
    n = _length(block.text)
    # In an article a paragraph may be a link as a whole; a list of links is none of its text.
    if block.out or block.links > MOST_LINKS * len(block.text) and (block.listed or not block.article):
        return "bad"
    stops = stop_share(block.text) if known_language else STOPS_HIGH
    if block.article:
        return "good" if stops >= ARTICLE_STOPS and known_language or n >= LONG else "near" if n >= ARTICLE_SHORT or block.headline else "short"
    if n < SHORT:
        return "bad" if block.links else "near" if block.headline else "short"
    if stops >= STOPS_HIGH:
        return "good" if n > LONG else "near"
    return "near" if stops >= STOPS_LOW else "bad"


def _inherit(row: list[Block], when_none: str) -> None:
    """Second pass over blocks that stand together: open ones take the label of the nearest decided block."""
    decided = [k for k, b in enumerate(row) if b.label in ("good", "bad")]
    if not decided:
        for b in row:
            b.label = "good" if when_none == "good" or b.label == "near" else "bad"
        return
    before, labels = -1, {k: row[k].label for k in decided}
    for k, b in enumerate(row):
        while before + 1 < len(decided) and decided[before + 1] < k:
            before += 1
        if k in labels:
            continue
        left = decided[before] if before >= 0 else None
        after = before + 1
        right = decided[after] if after < len(decided) else None
        sides = [labels[x] for x in (left, right) if x is not None]
        if b.label == "near":
            # Perhaps text: good unless what is decided on both sides is bad.
            b.label = "good" if "good" in sides else "bad"
        elif len(sides) == 2 and k - left == right - k:
            b.label = "good" if sides == ["good", "good"] else "bad"
        else:
            b.label = labels[left if right is None or left is not None and k - left < right - k else right]


def main_text(page: str | None) -> str:
    """The text of the good blocks, joined by blanks; '' for a null or empty page or one without main text.

    Where articles hold less than the good blocks outside them (teasers around a text), all blocks are judged alike. Where
    no block is good, those that the first pass left open are the text: it is a short page.
    """
    if not page:
        return ""
    found = blocks(page)
    known_language = stop_share(" ".join(b.text for b in found if not b.out)) >= FEW_STOPS
    for b in found:
        b.label = decide(b, known_language)
    undecided = [b for b in found if b.label in ("near", "short") and any(c.isalnum() for c in b.text)]
    nothing_decided = all(b.out for b in found if b.label in ("good", "bad"))
    outside = [b for b in found if not b.article]
    inside: dict[int, list[Block]] = {}
    for b in found:
        if b.article and not b.out:
            inside.setdefault(b.article, []).append(b)
    for row in inside.values():
        _inherit(row, "good")
    in_articles = sum(len(b.text) for row in inside.values() for b in row if b.label == "good")
    if in_articles and in_articles >= sum(len(b.text) for b in outside if b.label == "good"):
        for b in outside:
            b.label = "bad"
    else:
        _inherit(found, "bad")
    if nothing_decided or not any(b.label == "good" for b in found):
        for b in undecided:
            b.label = "good"
    return " ".join(b.text for b in found if b.label == "good")


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of pages; null html gives an empty text, rows repeat as they do in pages.

    A very long page is worked on whole, in one pass over its tags; broken markup gives what text there is.
    """
    small_batches(pages.sparkSession)
    narrow = pages.select(id, url, F.col(html).alias("__html"))
    schema = narrow.select(id, url).withColumn("text", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=[id, url, "text"])

    return narrow.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; the cases are those of extracted. Repeated rows each get a row."""
    return extracted(table(spark, sf_dir, "pages"))
