"""DocTags pages to tokens, blocks, tables, figures and formulas.

Tokens come from one regular expression; ``segments`` cuts pages into blocks; numbering, titles and Markdown are windows and
columns over the blocks. All of it runs in the JVM. ``page_blocks`` reads one page without Spark; tests compare with it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, collapse, let, strip
from .segments import FIGURES, once, segment

#: The grid of location tags: fixed value.
GRID = 500
#: Wrappers whose children count as top level, blocks that are dropped, cells, cells without text.
WRAPPERS = ("doctag", "unordered_list", "ordered_list", "group")
DROPPED = ("page_header", "page_footer", "page_break")
CELLS = ("fcel", "ecel", "ched", "rhed", "crhed", "lcel", "ucel", "xcel")
SPANS = ("lcel", "ucel", "xcel")
PIECE = r"</?[a-z0-9_]+>|[^<]+|<"
_space = re.compile(WS)
_tag = re.compile(r"<(/?)([a-z0-9_]+)>")


def tokens(pages: DataFrame, text: str = "doc_tags") -> DataFrame:
    """The other columns of ``pages`` with pos, kind (open, close, loc, text), name, loc and text of each token."""
    rest = [c for c in pages.columns if c != text]
    d = pages.select(*rest, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    name = F.regexp_extract("piece", "^</?([a-z0-9_]+)>$", 1)
    loc = F.regexp_extract("piece", r"^</?loc_(\d+)>$", 1)
    kind = F.when(loc != "", "loc").when(name == "", "text").when(F.col("piece").startswith("</"), "close").otherwise("open")
    return d.select(*rest, "pos", kind.alias("kind"), F.when(kind.isin("open", "close"), name).alias("name"), F.nullif(loc, F.lit("")).cast("int").alias("loc"), F.when(kind == "text", F.col("piece")).alias("text"))


def _squeeze(x: str) -> str:
    return " ".join(w for w in _space.split(x) if w)


class _Page:
    """The tokens of a page, and for each opening tag the place of the tag that closes it (none: the page's end)."""

    def __init__(self, source: str):
        self.toks: list[tuple[str, str]] = []
        at = 0
        for m in _tag.finditer(source):
            if m.start() > at:
                self.toks.append(("text", source[at : m.start()]))
            loc = m[2].startswith("loc_") and m[2][4:].isdigit()
            self.toks.append(("loc", m[2][4:]) if loc else ("close" if m[1] else "open", m[2]))
            at = m.end()
        if at < len(source):
            self.toks.append(("text", source[at:]))
        self.ends: dict[int, int] = {}
        waiting: dict[str, list[int]] = {}
        for k, (kind, name) in enumerate(self.toks):
            if kind == "open":
                waiting.setdefault(name, []).append(k)
            elif kind == "close" and waiting.get(name):
                self.ends[waiting[name].pop()] = k

    def places(self, k: int) -> tuple[int, list[float] | None]:
        """Up to four locations from k on: where they end, and the box if there are four."""
        box = []
        while len(box) < 4 and k < len(self.toks) and self.toks[k][0] == "loc":
            box.append(int(self.toks[k][1]) / GRID)
            k += 1
        return k, box if len(box) == 4 else None

    def text(self, lo: int, hi: int) -> str:
        return "".join(x for kind, x in self.toks[lo:hi] if kind == "text")

    def end(self, k: int) -> tuple[int, int]:
        """Of the tag at k: the end of what it holds, and where the page goes on."""
        e = self.ends.get(k)
        return (len(self.toks), len(self.toks)) if e is None else (e, e + 1)

    def caption(self, k: int) -> tuple[int, str | None]:
        """The caption that follows at k, white space between, and where the page goes on after it."""
        j = k
        while j < len(self.toks) and self.toks[j][0] == "text" and not _squeeze(self.toks[j][1]):
            j += 1
        if j < len(self.toks) and self.toks[j] == ("open", "caption"):
            lo, _ = self.places(j + 1)
            hi, on = self.end(j)
            return max(on, lo), _squeeze(self.text(lo, hi)) or None
        return k, None

    def grid(self, lo: int, hi: int) -> tuple[list[list[str]], bool]:
        """The rows of a table, and whether merged cells were left blank."""
        rows, row, spans, open_cell = [], [], False, False
        for kind, x in self.toks[lo:hi]:
            if kind == "open" and x in CELLS:
                row.append("")
                spans |= x in SPANS
                open_cell = x not in SPANS
            elif kind == "text" and open_cell:
                row[-1] += x
            elif kind == "loc" and open_cell and not row[-1]:
                pass
            else:
                open_cell = False
                if kind == "open" and x == "nl" and row:
                    rows.append(row)
                    row = []
        if row:
            rows.append(row)
        return [[_squeeze(c) for c in r] for r in rows], spans

    def blocks(self) -> list[dict]:
        out, k = [], 0
        while k < len(self.toks):
            kind, name = self.toks[k]
            if kind != "open":
                k += 1
                continue
            lo, box = self.places(k + 1)
            if name in WRAPPERS:
                k = lo
                continue
            hi, k = self.end(k)
            block = {"block_no": len(out), "cls": name, "bbox": box, "raw": self.text(lo, hi), "caption": None, "grid": None, "spans": False}
            if name == "otsl":
                block["grid"], block["spans"] = self.grid(lo, hi)
            elif name in ("picture", "chart"):
                k, block["caption"] = self.caption(k)
            if name not in DROPPED:
                out.append(block)
        return out


def page_blocks(source: str | None) -> list[dict]:
    """The blocks of one page, in order; of a null page none."""
    return _Page(source or "").blocks()


def segmented(pages: DataFrame) -> DataFrame:
    """The blocks of each page of ``pages`` (doc_tags and other columns): block_no, cls, bbox, raw, caption, grid, spans."""
    return segment(pages, "doc_tags", WRAPPERS, DROPPED, CELLS, SPANS, GRID)


def hashes(cls: Column) -> Column:
    """The marks of a heading's level; null for other blocks."""
    # few classes are looked at by the regular expression
    level = F.when(cls.startswith("section_header_level_"), F.regexp_extract(cls, r"^section_header_level_(\d+)$", 1)).otherwise("")
    return F.when(cls == "title", "#").when(cls == "section_header", "##").when(level != "", F.repeat(F.lit("#"), F.least(F.coalesce(F.try_to_number(level, F.lit("999")).cast("int"), F.lit(6)) + 1, F.lit(6))))


def table_markdown(grid: Column) -> Column:
    """A grid as a Markdown table: first row as head, short rows filled up, pipes escaped."""
    cell = lambda c: F.replace(c, F.lit("|"), F.lit("\\|"))
    line = lambda r, width: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | "), F.lit(" |"))
    rule = lambda width: F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = lambda width: F.transform(grid, lambda r, i: F.when(i == 0, F.concat(line(r, width), F.lit("\n"), rule(width))).otherwise(line(r, width)))
    return F.when(F.size(grid) > 0, F.array_join(let(F.array_max(F.transform(grid, F.size)), lines), "\n"))


def blocks(pages: DataFrame, classes: tuple[str, ...] | None = None) -> DataFrame:
    """Blocks of ``pages(doc_id, page, doc_tags)`` with text, running figure and formula numbers and Markdown.

    Numbers run over all pages of a document. Blocks without text, tables without rows and captions that a figure has taken
    give no row; a figure always does. Of ``classes`` (none: all) only those blocks are given, numbered as all are; pictures
    and charts share their numbers, so they come together. Blocks that nothing numbers aren't shuffled or sorted.
    """
    d = segmented(pages.select("doc_id", "page", "doc_tags"))
    if classes is not None:
        d = d.where(F.col("cls").isin(*classes, *(FIGURES if set(FIGURES) & set(classes) else ())))
    d = once(d, text=F.when(F.col("cls") == "code", strip(F.col("raw"))).when(F.col("cls") != "otsl", collapse(F.col("raw"))))
    figure = F.col("cls").isin("picture", "chart")
    d = d.where(figure | (F.coalesce("text", F.lit("")) != "") | F.col("cells")).drop("cells")
    w = Window.partitionBy("doc_id").orderBy("page", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    for name, counted, of in (("figure_no", figure, FIGURES), ("formula_no", F.col("cls") == "formula", ("formula",))):
        some = classes is None or set(of) & set(classes)
        d = d.withColumn(name, F.when(counted, F.sum(counted.cast("int")).over(w)) if some else F.lit(None).cast("long"))
    fig = F.concat(F.lit("figure-"), F.col("figure_no"))
    picture = F.concat(F.lit("!["), F.coalesce(F.translate("caption", "[]", ""), fig), F.lit("](images/"), fig, F.lit(".png)"), F.coalesce(F.concat(F.lit("\n\n*"), F.col("caption"), F.lit("*")), F.lit("")))
    md = F.when(hashes(F.col("cls")).isNotNull(), F.concat(hashes(F.col("cls")), F.lit(" "), F.col("text")))
    for cls, x in (("list_item", F.concat(F.lit("- "), F.col("text"))), ("formula", F.concat(F.lit("$$"), F.col("text"), F.lit("$$"))), ("code", F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))), ("otsl", table_markdown(F.col("grid"))), ("caption", F.concat(F.lit("*"), F.col("text"), F.lit("*")))):
        md = md.when(F.col("cls") == cls, x)
    return d.withColumn("markdown", md.when(figure, picture).otherwise(F.col("text")))


def parsed_pages(found: DataFrame) -> DataFrame:
    """(doc_id, page, markdown, title, dropped_spans) of each page that has blocks."""
    heading = F.when(hashes(F.col("cls")).isNotNull(), F.col("text"))
    return found.groupBy("doc_id", "page").agg(
        F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "markdown"))), lambda x: x["markdown"]), "\n\n"), F.lit("\n")).alias("markdown"),
        F.min_by(heading, F.when(heading.isNotNull(), F.col("block_no"))).alias("title"),
        F.bool_or("spans").alias("dropped_spans"),
    )


def table_cells(found: DataFrame) -> DataFrame:
    """(doc_id, page, block_no, row_no, col_no, text) of every cell."""
    d = found.where("cls = 'otsl'").select("doc_id", "page", "block_no", F.posexplode("grid").alias("row_no", "row"))
    return d.select("doc_id", "page", "block_no", "row_no", F.posexplode("row").alias("col_no", "text"))
