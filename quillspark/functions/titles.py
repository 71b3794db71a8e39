"""Choice of a document's title, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, presence, strip, utf16_length

#: Headings of sections, not of documents: fixed values.
SECTIONS = (
    "abstract", "introduction", "background", "preliminaries", "related work", "prior work", "method", "methods", "methodology",
    "approach", "experiments", "experimental setup", "evaluation", "results", "analysis", "discussion", "limitations", "conclusion",
    "conclusions", "references", "bibliography", "appendix", "acknowledgments", "acknowledgements", "contents", "table of contents",
    "supplementary material",
)
#: Fixed patterns: file endings of authoring tools, their placeholders, a section's number.
AUTHORING = r"(?i)\.(indd|docx?|qxd|pdf|tex|pages|pptx?|rtf|odt|wpd)$"
PLACEHOLDER = r"(?i)^(microsoft (word|powerpoint)|untitled|no title|document ?\d*|unknown)\b"
NUMBER = rf"^\d+(\.\d+)*[.)]?{WS}+"


def section_like(x: Column) -> Column:
    bare = F.regexp_replace(x, NUMBER, "")
    named = F.regexp_replace(F.lower(bare), "[.:]+$", "").isin(*SECTIONS)
    return named | ((bare != x) & (F.size(F.split(bare, f"{WS}+")) <= 3))


def from_metadata(x: Column) -> Column:
    t = presence(x)
    bad = (utf16_length(t) < 4) | t.rlike(AUTHORING) | t.rlike(PLACEHOLDER) | (~t.rlike(WS) & t.rlike(r"[_\d]")) | section_like(t)
    return F.when(~bad, t)


def from_heading(x: Column) -> Column:
    t = presence(x)
    return F.when(~section_like(t), t)


def choose(metadata: Column, heading: Column, fallback: Column) -> Column:
    return F.coalesce(from_metadata(metadata), from_heading(heading), presence(fallback), fallback)


def from_items(items: Column, fallback: Column) -> Column:
    """The first title among a document's ``items`` (array of label and text), else its first section header, else the fallback; blank ones don't count."""
    first = lambda label: F.get(F.filter(F.transform(F.filter(items, lambda x: x["label"] == label), lambda x: strip(x["text"])), lambda t: t != ""), F.lit(0))
    return F.coalesce(first("title"), first("section_header"), fallback)
