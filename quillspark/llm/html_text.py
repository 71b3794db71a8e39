"""Main text of web pages by two passes over blocks.

The first pass classifies blocks by link density, stop-word density and length, on every page; the second gives those in
doubt the label of their nearest decided neighbours. A main part that the page marks counts only where it holds most of
the good text: what is outside then needs more to be good. Elements that hold no article text by their name are left out with
all that is in them. Names in a class, id or role are only signs: what they mark is bad unless, for a whole name, nothing else
on the page could be the article or, for a part of a compound name, it holds most of the text that isn't bad.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only

#: Elements that hold no article text.
SKIPPED = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea dialog menu head title object canvas video audio".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript template iframe svg".split())
#: Elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that belong to a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Words in a class, id or role that say that an element is no article text.
SIGNS = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|popup|modal|newsletter|subscribe|comments?|disqus|respond|replies|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|related|share|sharing|social|search|login|pagination|pager|toolbar|skip|hidden|complementary|contentinfo)", re.I)
ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>|<[!?][^>]*+>|</?[a-zA-Z!?][^>]*+\Z", re.S)
#: Frequent words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to a in is that for it was on are as with be by at this from or an not but they his her which have had has were their there been if will would can who what when so no all we you he she i "
    "der die das und ist in den von zu mit sich des auf für im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde "
    "le la les de des du et en un une que est pour qui dans par sur au pas plus ce avec il se sont son sa ses ou mais aux ne on cette comme être nous vous "
    "el los las del y que una por con para su al lo más pero sus como está sin sobre también hay fue ser son desde muy entre".split()
)
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
GOOD, BAD, DOUBT = 1, -1, 0


class Block:
    """A run of text between block-level tags."""

    __slots__ = ("text", "linked", "main", "heading", "suspect")

    def __init__(self, text: str, linked: int, main: bool, heading: bool, suspect: "Suspect | None" = None):
        self.text, self.linked, self.main, self.heading, self.suspect = text, linked, main, heading, suspect


class Suspect:
    """An element with a sign: the next one around it, and whether the sign is a whole name (of it or of one around it)."""

    __slots__ = ("around", "depth", "whole", "size", "kept")

    def __init__(self, around: "Suspect | None", depth: int, whole: bool):
        self.around, self.depth, self.size, self.kept = around, depth, 0, True
        self.whole = whole or around is not None and around.whole


def _signs(attributes: str) -> tuple[bool, bool]:
    """Whether a name in class, id or role is a sign, and whether a part of a compound one is."""
    names = [x for m in ATTRIBUTE.findall(attributes) for x in next(filter(None, m), "").split()]
    return any(SIGNS.fullmatch(x) for x in names), any(SIGNS.fullmatch(part) for x in names for part in re.split("[_-]", x))


def blocks_of(page: str) -> tuple[list[Block], list[Suspect]]:
    """The blocks of a page outside of skipped elements, and its elements with signs, outer ones first."""
    out: list[Block] = []
    stack: list[str] = []
    skip_at = None  # depth at which a skipped element began
    text: list[str] = []
    linked = 0
    links = mains = 0
    opened: Counter[str] = Counter()  # of the stack
    suspects: list[Suspect] = []
    suspect: Suspect | None = None
    heading = False

    def flush():
        nonlocal linked
        if text:
            whole = " ".join(entities.unescape("".join(text)).split())
            if whole:
                out.append(Block(whole, linked, mains > 0, heading, suspect))
            text.clear()
        linked = 0

    def leave(name: str) -> None:
        nonlocal links, mains, suspect
        opened[name] -= 1
        links -= name == "a"
        mains -= name in ("article", "main")
        while suspect and suspect.depth >= len(stack):
            suspect = suspect.around

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        end = m.start() if m else n
        if end > at and skip_at is None:
            text.append(page[at:end])
            if links:
                linked += len("".join(page[at:end].split()))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing, attributes = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name not in INLINE and skip_at is None:
            if name == "br":
                text.append(" ")
            else:
                flush()
                heading = False
        if closing:
            if opened[name]:
                while True:
                    top = stack.pop()
                    if suspect and suspect.depth >= len(stack) and skip_at is None:
                        flush()
                    leave(top)
                    if skip_at is not None and len(stack) <= skip_at:
                        skip_at = None
                    if top == name:
                        break
            continue
        if name in VOID or attributes.endswith("/") and name in ("svg", "iframe"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th") and stack and stack[-1] == name:
            leave(stack.pop())  # an end tag that is left out
        sign, part = _signs(attributes) if attributes and skip_at is None and name not in ("html", "body", "article", "main") else (False, False)
        if skip_at is None and name in SKIPPED:
            flush()
            skip_at = len(stack)
        elif skip_at is None and name == "article" and attributes and re.search(r"comment|reply", attributes, re.I):
            skip_at = len(stack)
        elif sign or part:
            flush()
            suspect = Suspect(suspect, len(stack), sign)
            suspects.append(suspect)
        stack.append(name)
        opened[name] += 1
        links += name == "a"
        mains += name in ("article", "main")
        heading |= name in HEADING
    flush()
    return out, suspects


def classify(b: Block, fits: bool, outside: bool = False, short: int = 70, low: float = 0.1, links: float = 0.5) -> int:
    """The first pass. Stop words count where the page ``fits`` them; ``outside`` of its main part a block must be twice as long."""
    size = max(1, len(b.text) - b.text.count(" "))
    if b.linked > links * size and not b.heading:
        return BAD
    if length(b.text) < short * (1 + outside) or b.heading:
        return BAD if outside or b.linked and not b.heading and not b.main else DOUBT
    if fits and density(b.text) < low:
        return BAD if outside else DOUBT
    return GOOD


def length(text: str) -> int:
    """Characters, East Asian ones twice, since they say as much as two letters."""
    return len(text) if text.isascii() else len(text) + sum(c >= "\u2e80" for c in text)


def density(text: str) -> float:
    """The share of stop words among a text's words."""
    words = [w.strip(".,;:!?\"'()[]*#$%&|").lower() for w in text.split()]
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def labels_of(found: list[Block], suspects: list[Suspect]) -> list[int]:
    """The labels of a page's blocks after both passes.

    Whole signs rule out what they mark if the page has anything else that isn't bad. The other signs, and all where it hasn't, rule
    out what doesn't hold most of the text that isn't bad: what does is a wrapper.
    """
    if suspects:
        able = [classify(b, False) != BAD for b in found]
        plain = any(x and not (b.suspect and b.suspect.whole) for b, x in zip(found, able, strict=True))
        free = [not (plain and b.suspect and b.suspect.whole) for b in found]
        total = 0
        for b, x, y in zip(found, able, free, strict=True):
            if x and y:
                total += len(b.text)
                if b.suspect:
                    b.suspect.size += len(b.text)
        for s in reversed(suspects):
            if s.around:
                s.around.size += s.size
        for s in suspects:
            s.kept = 2 * s.size > total and (s.around is None or s.around.kept)
        inside = [y and (b.suspect is None or b.suspect.kept) for b, y in zip(found, free, strict=True)]
        rest = iter(labels_of([b for b, x in zip(found, inside, strict=True) if x], []))
        return [next(rest) if x else BAD for x in inside]
    marked = any(b.main for b in found)
    labels = [classify(b, False) for b in found]
    # stop words say nothing about a page in a language that isn't listed
    fits = density(" ".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)) >= 0.1
    labels = [classify(b, fits) for b in found]
    counts = False
    if marked:
        good = [(len(b.text), b.main) for b, label in zip(found, labels, strict=True) if label == GOOD]
        # where nothing is good, or most of it outside, the mark says nothing
        counts = 2 * sum(n for n, main in good if main) > sum(n for n, _ in good)
        if counts:
            labels = [classify(b, fits, outside=not b.main) for b in found]
    # a heading in doubt over links goes with them, unless the main part that counts holds it
    for k in range(len(found) - 2, -1, -1):
        if found[k].heading and labels[k] == DOUBT and labels[k + 1] == BAD and not (counts and found[k].main):
            labels[k] = BAD
    # where nothing is good, links alone decide about nothing but themselves
    return settle(labels) if GOOD in labels else [GOOD if x == DOUBT else x for x in labels]


def settle(labels: list[int]) -> list[int]:
    """The second pass: a block in doubt gets the label of its nearest decided neighbours; good wins a tie, or where none is decided."""
    n = len(labels)
    before, after = [n + 1] * n, [n + 1] * n
    what_before, what_after = [DOUBT] * n, [DOUBT] * n
    for order, gap, what in ((range(n), before, what_before), (range(n - 1, -1, -1), after, what_after)):
        last, kind = None, DOUBT
        for k in order:
            if labels[k] != DOUBT:
                last, kind = k, labels[k]
            elif last is not None:
                gap[k], what[k] = abs(k - last), kind
    out = []
    for k, label in enumerate(labels):
        if label == DOUBT:
            label = what_before[k] if before[k] < after[k] else what_after[k] if after[k] < before[k] else max(what_before[k], what_after[k])
        out.append(label if label != DOUBT else GOOD)
    return out


def main_text(page: str | None) -> str:
    """The article of a page, blocks joined by one space; of a null or empty page, nothing."""
    found, suspects = blocks_of(page or "")
    labels = labels_of(found, suspects)
    return " ".join(b.text for b, label in zip(found, labels, strict=True) if label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages(page_id, url, html)``.

    Null pages are empty ones; ids and addresses may be null and rows may repeat; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return only(pages, "page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
