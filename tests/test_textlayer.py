"""Paragraphs of the text layer against plain Python."""

import random
import re

from quillspark.functions.text import WS
from quillspark.operators import textlayer
from quillspark.operators.textlayer import LEAST_HEIGHT, PARAGRAPH_GAP, SAME_LINE, WORD_GAP

SPACE = re.compile(WS + "+")
TOKEN = "struct<str:string,l:double,t:double,r:double,b:double>"


def group_lines(tokens) -> list[dict]:
    """Lines with their extent and the height of their tallest token, by which centres and gaps are measured."""
    out: list[dict] = []
    for t in tokens if tokens is not None else ():
        if not SPACE.sub("", t["str"] or ""):
            continue
        h, mid = max(t["b"] - t["t"], LEAST_HEIGHT), (t["t"] + t["b"]) / 2
        line = out[-1] if out else None
        if line and abs(mid - (line["top"] + line["bottom"]) / 2) <= SAME_LINE * max(h, line["height"]):
            gap = t["r"] > line["right"] and t["l"] - line["right"] > WORD_GAP * h
            line["text"] += " " * gap + t["str"]
            line["top"], line["bottom"], line["right"], line["height"] = min(line["top"], t["t"]), max(line["bottom"], t["b"]), max(line["right"], t["r"]), max(line["height"], h)
        else:
            out.append({"text": t["str"], "top": t["t"], "bottom": t["b"], "right": t["r"], "height": h})
    return out


def paragraph_text(tokens) -> str:
    """A page's paragraphs, white space collapsed, parted by blank lines."""
    parts: list[str] = []
    below = None
    for line in group_lines(tokens):
        if below is None or line["top"] - below > PARAGRAPH_GAP * line["height"]:
            parts.append(line["text"])
        else:
            parts[-1] += " " + line["text"]
        below = line["bottom"]
    return "\n\n".join(x for x in (SPACE.sub(" ", p).strip(" ") for p in parts) if x)


def paragraphs(spark, pages):
    typed = [p if p is None else [(s, *map(float, at)) for s, *at in p] for p in pages]
    d = spark.createDataFrame([(k, 1, p, None) for k, p in enumerate(typed)], f"doc_id long, page int, tokens array<{TOKEN}>, boxes array<struct<l:double,t:double,r:double,b:double>>")
    out = textlayer.paragraphs(d)
    assert "Python" not in out._jdf.queryExecution().toString()
    return [r.text for r in sorted(out.collect(), key=lambda r: r.doc_id)]


def test_lines_and_paragraphs(spark):
    t = lambda s, l, y: (s, l, y, l + 0.1, y + 0.02)
    tall = lambda s, l, top, end: (s, l, top, l + 0.05, end)
    pages = [
        [t("a", 0, 0.1), t("b", 0.2, 0.1), t("c", 0, 0.125), t("d", 0, 0.3)],
        None,
        [],
        # the tallest token decides, not the extent that a shifted one makes
        [tall("a", 0, 0.10, 0.12), tall("b", 0.05, 0.11, 0.13), tall("c", 0.1, 0.119, 0.139)],
        [tall("a\u00a0", 0, 0.1, 0.1), tall(None, 0.1, 0.1, 0.1), tall(" \n", 0.1, 0.1, 0.1), tall("b", 0.2, 0.1, 0.1)],
    ]
    assert paragraphs(spark, pages) == ["a b c\n\nd", "", "", "ab c", "a b"]


def test_paragraphs_are_those_of_plain_python(spark):
    r = random.Random(8)
    pages = []
    for _ in range(300):
        y, page = 0.0, []
        for _ in range(r.randint(0, 12)):
            x = r.random() / 10
            for _ in range(r.randint(1, 6)):
                w, h = r.random() / 8, r.choice([0.0, 0.01, 0.02, 0.02, 0.05])
                page.append((r.choice(["word", "a ", " b", "\u3000", "x-", "é", ""]), x, y + r.choice([0, 0, 0.004, -0.006]), x + w, y + h))
                x += w * r.choice([0.5, 1, 1.01, 1.2])
            y += r.choice([0.005, 0.021, 0.03, 0.08])
        pages.append(page)
    pages.append([("w", k / 10_000, 0.01 * (k // 10), k / 10_000 + 0.0001, 0.01 * (k // 10) + 0.008) for k in range(5000)])
    names = ("str", "l", "t", "r", "b")
    assert paragraphs(spark, pages) == [paragraph_text([dict(zip(names, x, strict=True)) for x in p]) for p in pages]
