"""Paragraphs from positioned text, as a fold over each page's tokens: a line's extent grows with each of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, collapse

#: Share of a line's height within which centres are one line, that parts words, that parts paragraphs.
SAME_LINE, WORD_GAP, PARAGRAPH_GAP = 0.55, 0.22, 0.75
#: Fixed value: a token is this high at least.
LEAST_HEIGHT = 0.001


def outside(tokens: Column, boxes: Column) -> Column:
    """The tokens whose centre is in none of the boxes (edges count as inside)."""
    inside = lambda t, b: ((t["l"] + t["r"]) / 2).between(b["l"], b["r"]) & ((t["t"] + t["b"]) / 2).between(b["t"], b["b"])
    return F.filter(tokens, lambda t: ~F.exists(boxes, lambda b: inside(t, b)))


def _fold(tokens: Column) -> Column:
    """A page's text: lines grow token by token, with their extent and the height of the tallest; each closed line knows the gap above it."""
    kind = "struct<lines:array<struct<gap:string,text:string>>,below:double,text:string,top:double,bottom:double,right:double,height:double>"
    names = ("lines", "below", "text", "top", "bottom", "right", "height")
    state = lambda *values: F.struct(*[v.alias(n) for v, n in zip(values, names, strict=True)])

    def closed(s: Column) -> Column:
        gap = F.when(s["below"].isNull(), "").when(s["top"] - s["below"] > PARAGRAPH_GAP * s["height"], "\n\n").otherwise(" ")
        return F.when(s["text"].isNull(), s["lines"]).otherwise(F.concat(s["lines"], F.array(F.struct(gap.alias("gap"), s["text"].alias("text")))))

    def step(s: Column, t: Column) -> Column:
        high, centre = F.greatest(t["b"] - t["t"], F.lit(LEAST_HEIGHT)), (t["t"] + t["b"]) / 2
        same = s["text"].isNotNull() & (F.abs(centre - (s["top"] + s["bottom"]) / 2) <= SAME_LINE * F.greatest(high, s["height"]))
        space = F.when((t["r"] > s["right"]) & (t["l"] - s["right"] > WORD_GAP * high), " ").otherwise("")
        longer = state(s["lines"], s["below"], F.concat(s["text"], space, t["str"]), F.least(s["top"], t["t"]), F.greatest(s["bottom"], t["b"]), F.greatest(s["right"], t["r"]), F.greatest(s["height"], high))
        return F.when(same, longer).otherwise(state(closed(s), s["bottom"], t["str"], t["t"], t["b"], t["r"], high))

    start = F.from_json(F.lit('{"lines":[]}'), kind)
    whole = lambda s: F.array_join(F.transform(closed(s), lambda x: F.concat(x["gap"], collapse(x["text"]))), "")
    return F.aggregate(F.filter(tokens, lambda t: t["str"].rlike(f"[^{WS[1:-1]}]")), start, step, whole)


def paragraphs(pages: DataFrame) -> DataFrame:
    """``pages(doc_id, page, tokens, boxes)`` to (doc_id, page, text): paragraphs parted by blank lines; '' without tokens."""
    kept = outside(F.col("tokens"), F.coalesce("boxes", F.array().cast("array<struct<l:double,t:double,r:double,b:double>>")))

    return pages.select("doc_id", "page", F.coalesce(_fold(kept), F.lit("")).alias("text"))
