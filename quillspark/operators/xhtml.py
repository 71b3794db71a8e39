"""Notes to XHTML blocks, as arrays in a note's row.

A body is cut by one regular expression into its blocks: fenced code, displayed formulas, headings, figures, tables, quotes, lists, texts
and blank lines. A quote's text is cut in its place, one round for each level of quotes that the notes have, so a note's blocks are one
array in reading order and nothing is shuffled or sorted. Inline text is rendered by columns: what must not be touched (images,
formulas, code, links) is lifted out into arrays, in this order, and put back in the reverse one. Displayed formulas are keyed by their
place among a document's, inline ones by first use.

A block's ``path`` is its place: chapter, block in it, block in that quote and so on; blank lines count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import trivial_xhtml
from ..functions.text import WS, escape_xml, let, strip

#: White space, that within a line, and what an image's path is made of; visible ASCII takes one comparison.
SPACE = f"[[^!-~]&&{WS}]"
_BLANKS = WS[1:-1].replace(r"\n", "")
BLANK = f"[[^!-~]&&[{_BLANKS}]]"
HREF = f"[[!-(*-~][^){WS[1:-1]}]]"
#: Patterns of the notes' Markdown: fixed values.
IMAGE = rf"!\[([^\]]*)\]\(({HREF}+)\)"
MATH = r"(?<!\$)\$([^$\n]+?)\$(?!\$)"
CODE = r"`([^`]+)`"
LINK = rf"\[([^\]]+)\]\(({HREF}+)\)"
HEADING = rf"^(#{{1,6}}){SPACE}+(.*)\z"
BULLET = rf"^{SPACE}*[-*]{SPACE}+(.*)\z"
CALLOUT = rf"^\[!(\w+)\][+-]?{SPACE}*(.*)\z"
CROP = r"!\[[^\]]*\]\(images/formula-\d+\.png\)"
#: Lines by what they begin with. A bar begins a table where the next line is a rule.
_TO_END = r"[^\n\r\x85\u2028\u2029]*$"
_HEADING = rf"#{{1,6}}{BLANK}+{_TO_END}"
_FIGURE = rf"!\[[^\]\n]*\]\({HREF}+\){BLANK}*$"
_BAR = rf"{BLANK}*+\|[^\n]*+"
_TABLE = rf"{_BAR}\n{BLANK}*\|[{_BLANKS}:|-]+\|{BLANK}*$"
_BULLET = rf"{BLANK}*+[-*]{BLANK}+{_TO_END}"
_BLANK = rf"{BLANK}*+$"
_SPECIAL = rf"{_BLANK}|{BLANK}*+(?:```|\$\$)|{_HEADING}|{_FIGURE}|{_TABLE}|>|{_BULLET}"
#: What a body is cut into: code up to its closing fence or the end, a formula up to a line that ends in $$ or the end, a heading, a figure, lines of
#: a table, a quote, a list, blank ones, and text. Runs of lines are possessive, so that they take no stack.
BLOCK = rf"(?dm)^(?:{BLANK}*```[^\n]*(?:\n(?s:.*?)^{BLANK}*```[^\n]*$|(?s:.*))|{BLANK}*\$\$(?:[^\n]*?\$\$$|[^\n]*?\$\${BLANK}+$|(?s:.*?)\n[^\n]*?\$\${BLANK}*$|(?s:.*))|{_HEADING}|{_FIGURE}|{_TABLE}(?:\n{_BAR})*+|>[^\n]*+(?:\n>[^\n]*+)*+|{_BULLET}(?:\n{_BULLET})*+|(?:{BLANK}*+\n)++(?:{BLANK}++\z)?|{BLANK}++\z|[^\n]++(?:\n(?!{_SPECIAL})[^\n]++)*+)"
#: What stands for an image, a formula, code and a link that were lifted out; no text holds these characters.
HOLES = ("\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3")


def lifted(text: Column) -> Column:
    """A text without the characters that stand for lifted parts: they become U+FFFD."""
    return F.translate(text, "".join(HOLES), "\ufffd" * len(HOLES))


def image(alt: Column, source: Column) -> Column:
    return F.concat(F.lit('<img src="'), escape_xml(relative(source)), F.lit('" alt="'), escape_xml(alt), F.lit('"/>'))


def relative(source: Column) -> Column:
    """An image's path as the package has it."""
    return F.regexp_replace(source, r"^\./", "")


def as_code(tex: Column) -> Column:
    return F.concat(F.lit('<code class="tex">'), escape_xml(strip(tex)), F.lit("</code>"))


def _filled(text: Column, hole: str, parts: Column) -> Column:
    """``text`` with its k-th hole filled by the k-th of ``parts``."""
    return F.array_join(F.zip_with(F.split(text, hole, -1), parts, lambda x, part: F.concat(x, F.coalesce(part, F.lit("")))), "")


def inline(text: Column) -> Column:
    """Inline Markdown as XHTML: images, formulas, code, links, strong and emphasis; all else is escaped.

    Lifted parts may hold earlier ones (a link's label an image, code a formula): they are filled from the last kind to the first,
    which keeps the order of each kind's holes. What begins no kind of part is passed over.
    """
    part = lambda x, pattern, k: F.regexp_extract(x, f"(?s)^{pattern}$", k)

    def code(x: Column) -> Column:
        return F.concat(F.lit("<code>"), escape_xml(part(x, CODE, 1)), F.lit("</code>"))

    def link(x: Column) -> Column:
        return F.concat(F.lit('<a href="'), escape_xml(part(x, LINK, 2)), F.lit('">'), escape_xml(part(x, LINK, 1)), F.lit("</a>"))

    def formula_in(x: Column) -> Column:
        return let(F.substr(x, F.lit(2), F.char_length(x) - 2), lambda tex: F.coalesce(trivial_xhtml(tex), as_code(tex)))

    def picture(x: Column) -> Column:
        return image(part(x, IMAGE, 1), part(x, IMAGE, 2))

    kinds = list(zip((IMAGE, MATH, CODE, LINK), ("![", "$", "`", "["), HOLES, (picture, formula_in, code, link), strict=True))

    def marked(s: Column) -> Column:
        strong = F.regexp_replace(escape_xml(s), r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
        return F.when(s.contains("*"), F.regexp_replace(strong, r"(?<![*\w])\*([^*\n]+)\*(?!\*)", "<em>$1</em>")).otherwise(escape_xml(s))

    def lift(s: Column, left: list) -> Column:
        if not left:
            return marked(s)
        (pattern, begin, hole, made), *rest = left
        none = F.struct(F.array().cast("array<string>").alias("found"), s.alias("s"))
        some = F.struct(F.regexp_extract_all(s, F.lit(pattern), F.lit(0)).alias("found"), F.regexp_replace(s, pattern, hole).alias("s"))
        filled = lambda x, html: F.when(F.size(x["found"]) > 0, _filled(html, hole, F.transform(x["found"], made))).otherwise(html)
        return let(F.when(s.contains(begin), some).otherwise(none), lambda x: let(lift(x["s"], rest), lambda html: filled(x, html)))

    return F.when(text.rlike('[!$`\\[*&<>"' + "".join(HOLES) + "]"), let(lifted(text), lambda s: lift(s, kinds))).otherwise(text)


def _images(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(IMAGE), F.lit(2)), relative)


def _formulas(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(lifted(text), IMAGE, HOLES[0]), F.lit(MATH), F.lit(1))


def _kind(p: Column) -> Column:
    """What a piece of BLOCK is; tested in this order."""
    kind = F.when(p.rlike(rf"^{SPACE}*\z"), "blank").when(p.rlike(f"^{BLANK}*```"), "code").when(p.rlike(rf"^{BLANK}*\$\$"), "math").when(p.rlike(rf"(?d)\A{_HEADING}(?!\n)"), "heading").when(p.rlike(rf"(?d)\A{_FIGURE}(?!\n)"), "figure")
    return kind.when(p.rlike(rf"(?dm)\A{_TABLE}"), "table").when(p.startswith(">"), "quote").when(p.rlike(rf"(?dm)\A{_BULLET}"), "list").otherwise("text")


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^\|", ""), r"\|\z", "")
    return F.transform(F.split(bare, r"\|", -1), strip)


def _code(piece: Column) -> Column:
    """What stands between two fences."""
    rest = F.regexp_replace(piece, r"^[^\n]*\n?", "")
    return F.regexp_replace(rest, rf"(?:^|\n){BLANK}*```[^\n]*\z", "")


def _tex(piece: Column) -> Column:
    lines = F.array_join(F.transform(F.split(piece, "\n", -1), strip), "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"^\$\$", ""), r"\$\$\z", "")


def _block(path: Column, kind: Column, rows: Column | None = None, source: Column | None = None, callout: Column | None = None, first: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    rows = F.lit(None).cast("array<array<string>>") if rows is None else rows
    return F.struct(path.alias("path"), kind.alias("kind"), rows.alias("rows"), (none if source is None else source).alias("source"), (none if callout is None else callout).alias("callout"), (F.lit(True) if first is None else first).alias("first"))


def _made(path: Column, kind: Column, piece: Column) -> Column:
    """A piece as a block: the inline texts of its rows, its source (code, TeX, quoted lines), a callout's kind."""
    one = lambda x: F.array(F.array(x))
    lines = F.split(piece, "\n", -1)
    table = let(lines, lambda x: F.transform(F.concat(F.slice(x, 1, 1), F.slice(x, 3, F.size(x))), _cells))
    rows = F.when(kind == "text", one(strip(F.replace(piece, F.lit("\n"), F.lit(" "))))).when(kind == "heading", one(F.regexp_extract(piece, HEADING, 2)))
    rows = rows.when(kind == "list", F.transform(lines, lambda x: F.array(F.regexp_extract(x, BULLET, 1)))).when(kind == "table", table)
    source = F.when(kind == "code", _code(piece)).when(kind == "math", _tex(piece)).when(kind == "figure", piece).when(kind == "heading", F.char_length(F.regexp_extract(piece, HEADING, 1)).cast("string"))

    def quote(q: Column) -> Column:
        mark = F.substring_index(q, "\n", 1)
        title = lambda name: let(F.regexp_extract(mark, CALLOUT, 2), lambda x: F.when(x != "", x).otherwise(name))
        return let(F.regexp_extract(mark, CALLOUT, 1), lambda name: F.when(name == "", _block(path, kind, source=q)).otherwise(_block(path, kind, one(title(name)), F.regexp_replace(q, r"^[^\n]*\n?", ""), F.lower(name))))

    return F.when(kind == "quote", let(F.regexp_replace(piece, f"(?dm)^>{BLANK}?", ""), quote)).otherwise(_block(path, kind, rows, source))


def _cut(body: Column, path: Column, cropped: Column | None = None) -> Column:
    """The blocks of a body, quotes as they are. Callouts that only offer a formula's crop go where ``cropped`` holds."""
    pieces = F.transform(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0)), lambda p, i: F.struct((i + 1).cast("long").alias("n"), _kind(p).alias("kind"), p.alias("piece")))
    made = F.transform(F.filter(pieces, lambda x: x["kind"] != "blank"), lambda x: _made(F.concat(path, F.array(x["n"])), x["kind"], x["piece"]))
    if cropped is not None:
        made = F.filter(made, lambda b: ~F.coalesce(b["callout"].isNotNull() & cropped & b["source"].rlike(CROP), F.lit(False)))
    return F.transform(made, lambda b, i: _block(b["path"], b["kind"], b["rows"], b["source"], b["callout"], i == 0))


def depth(text: Column) -> Column:
    """The most quote marks that a line of a text begins with; null for none."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(f"(?dm)^(?:>{BLANK}?)++"), F.lit(0)), lambda x: F.char_length(x) - F.char_length(F.replace(x, F.lit(">"), F.lit("")))))


def cut(bodies: Column, deepest: int, cropped: Column | None = None, path: Column | None = None) -> Column:
    """All blocks of an array of bodies (null: none) and of their quotes, in reading order: path, kind, rows, source, callout, first.

    A block of the kind ``chapter`` stands before each body; a quote is ``open``, what it holds, and ``close``. ``first`` is for blocks that begin a body or
    a quote. ``deepest`` is how many levels of quotes there may be. Where ``cropped`` holds, callouts of the first level that show a formula's crop are left out.
    """
    place = (lambda i: F.array((i + 1).cast("long"))) if path is None else lambda i: path.cast("array<long>")
    found = F.flatten(F.transform(F.coalesce(bodies, F.array().cast("array<string>")), lambda body, i: F.concat(F.array(_block(place(i), F.lit("chapter"))), _cut(body, place(i), cropped))))

    def opened(b: Column) -> Column:
        begin = _block(b["path"], F.lit("open"), b["rows"], None, b["callout"], b["first"])
        return F.concat(F.array(begin), _cut(b["source"], b["path"]), F.array(_block(b["path"], F.lit("close"), callout=b["callout"])))

    for _ in range(deepest):
        found = F.flatten(F.transform(found, lambda b: F.when(b["kind"] == "quote", opened(b)).otherwise(F.array(b))))
    return found


def displayed(blocks: Column) -> Column:
    """The displayed formulas of ``cut`` in reading order, ``source`` being their TeX: equal ones stay apart."""
    return F.filter(blocks, lambda b: b["kind"] == "math")


def _each(blocks: Column, found) -> Column:
    """What ``found`` finds in blocks, each once, by first use."""
    return F.array_distinct(F.flatten(F.transform(blocks, lambda b: F.coalesce(found(b), F.array().cast("array<string>")))))


def inlined(blocks: Column) -> Column:
    """The different inline formulas of ``cut``, by first use."""
    some = lambda x: F.when(x.contains("$"), _formulas(x)).otherwise(F.array().cast("array<string>"))
    return _each(blocks, lambda b: F.flatten(F.transform(F.flatten(b["rows"]), some)))


def shown(blocks: Column) -> Column:
    """The images that the blocks of ``cut`` show, each once, by first use."""
    some = lambda x: F.when(x.contains("!["), _images(x)).otherwise(F.array().cast("array<string>"))
    return _each(blocks, lambda b: F.when(b["kind"] == "figure", F.slice(_images(b["source"]), 1, 1)).otherwise(F.flatten(F.transform(F.flatten(b["rows"]), some))))


#: What takes the place of a formula without a picture: fixed value.
UNRENDERED = '<aside class="callout callout-warning math-unrendered"><p class="callout-title">Formula could not be rendered</p><p>'


def formula(tex: Column, crop_id: Column) -> Column:
    """A displayed formula as its crop or, where there is none, as a marked text."""
    picture = F.concat(F.lit('<div class="math-display"><img src="images/'), crop_id, F.lit('.png" alt="'), escape_xml(strip(tex)), F.lit('"/></div>'))
    return F.coalesce(picture, F.concat(F.lit(UNRENDERED), as_code(tex), F.lit("</p></aside>")))


#: What stands for a displayed formula and for a body's begin while a note is put together: texts are escaped and hold no such tags.
_FORMULA, _BODY = "<0>", "<1>"


def _html(b: Column) -> Column:
    """A block as XHTML: of a quote what stands before its blocks or behind them, of a formula its mark."""
    kind, source, callout = b["kind"], b["source"], b["callout"].isNotNull()
    wrapped = lambda r, tag: F.array_join(F.transform(r, lambda x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))), "")
    part = lambda k: F.regexp_extract(source, f"^{IMAGE}", k)

    def with_rows(rows: Column) -> Column:
        text = F.get(F.get(rows, F.lit(0)), F.lit(0))
        body = F.array_join(F.transform(F.slice(rows, 2, F.size(rows)), lambda r: F.concat(F.lit("<tr>"), wrapped(r, "td"), F.lit("</tr>"))), "")
        html = F.when(kind == "text", F.concat(F.lit("<p>"), text, F.lit("</p>"))).when(kind == "heading", F.concat(F.lit("<h"), source, F.lit(">"), text, F.lit("</h"), source, F.lit(">")))
        html = html.when(kind == "list", F.concat(F.lit("<ul>"), wrapped(F.flatten(rows), "li"), F.lit("</ul>")))
        html = html.when(kind == "table", F.concat(F.lit("<table><thead><tr>"), wrapped(F.get(rows, F.lit(0)), "th"), F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>")))
        return html.otherwise(F.concat(F.lit('<aside class="callout callout-'), escape_xml(b["callout"]), F.lit('"><p class="callout-title">'), text, F.lit("</p>")))

    html = F.when(b["rows"].isNotNull(), let(F.transform(b["rows"], lambda r: F.transform(r, inline)), with_rows)).when(kind == "math", _FORMULA).when(kind == "chapter", _BODY)
    html = html.when(kind == "code", F.concat(F.lit("<pre><code>"), escape_xml(source), F.lit("</code></pre>"))).when(kind == "figure", F.concat(F.lit("<figure>"), image(part(1), part(2)), F.lit("</figure>")))
    html = html.when(kind == "open", "<blockquote>").otherwise(F.when(callout, "</aside>").otherwise("</blockquote>"))
    return F.when(b["first"], html).otherwise(F.concat(F.lit("\n"), html))


def html(blocks: Column, formulas: Column) -> Column:
    """An array of the bodies of ``cut`` as XHTML; ``formulas`` are what is shown for the displayed ones, in their order."""
    whole = _filled(F.array_join(F.transform(blocks, _html), ""), _FORMULA, formulas)
    return let(F.split(whole, _BODY, -1), lambda x: F.slice(x, 2, F.size(x)))


def blocks(bodies: DataFrame, deepest: int | None = None) -> DataFrame:
    """``bodies(doc_id, path, body)`` with their blocks as ``cut`` gives them; where ``deepest`` isn't given, one job finds it."""
    if deepest is None:
        deepest = bodies.agg(F.max(depth(F.col("body")))).first()[0] or 0
    return bodies.select("doc_id", "path", cut(F.array("body"), deepest, path=F.col("path")).alias("blocks"))


def rendered(b: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, html) of ``blocks``, formulas as texts; a body without blocks has no row."""
    texts = F.transform(displayed(F.col("blocks")), lambda x: formula(x["source"], F.lit(None).cast("string")))
    return b.where(F.size("blocks") > 1).select("doc_id", F.get("path", F.lit(0)).alias("chapter_no"), F.get(html(F.col("blocks"), texts), F.lit(0)).alias("html"))
