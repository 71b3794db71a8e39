"""Where the blocks of a DocTags page begin and end, in the JVM.

A block goes from an opening tag to the tag that closes it, or to the page's end. Unless a block holds a tag of its own
name, its end is the first closing tag of that name: such pages are cut by one regular expression, in their row. One that
walks over the page without backtracking tells which they are. The others are dealt out by page, and windows match their brackets: a tag's partner has its name and its level, the running depth
of that name alone, so that tags which are never closed (cells, line breaks) don't matter. A fold over a page's opening
tags then takes each that lies behind the end of the last one taken, so tags that cross are read in order as well.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, collapse, let

TAG = "</?[a-z0-9_]+>"
LOC = "</?loc_[0-9]+>"
#: A tag that isn't a location begins a piece, which goes on to the next such tag.
CUT = "(?=</?(?!loc_[0-9]+>)[a-z0-9_]+>)"
#: Blocks that the caption behind them belongs to: fixed values.
FIGURES = ("picture", "chart")
SPAN = "struct<pos:int,end:int,name:string>"


def _after(tag: Column, piece: Column) -> Column:
    """What follows ``tag`` at the beginning of ``piece``."""
    return F.substr(piece, F.char_length(tag) + 1)


def once(df: DataFrame, **made: Column) -> DataFrame:
    """``df`` with the new columns, each computed once a row: filters and projections above copy no expression across an explode."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("__x")).select(*df.columns, *[f"__x.{n}" for n in made])


def _opening(wrappers: tuple[str, ...]) -> tuple[str, str, str]:
    """Regular expressions: not a block's tag, a block's opening tag (its name is the first group), and what follows to its next tag of that name."""
    no = f"loc_[0-9]+>|(?:{'|'.join(wrappers)})>"
    return f"(?!(?!{no})[a-z0-9_]+>)", f"<(?!{no})([a-z0-9_]+)>", r"[^<]*+(?:<(?!/?\1>)[^<]*+)*+"


def _nested(source: Column, wrappers: tuple[str, ...]) -> Column:
    """Whether a block holds a tag of its own name, closed or not."""
    other, opening, body = _opening(wrappers)
    return source.rlike(rf"(?s)\A(?:[^<]++|<{other}|{opening}{body}</\1>)*+{opening}{body.replace('1', '2')}<\2>")


def _cut(source: Column, wrappers: tuple[str, ...]) -> Column:
    """The blocks of a page that isn't nested, each with a figure's caption."""
    figures = "|".join(f"</{f}>" for f in FIGURES)
    _, opening, body = _opening(wrappers)
    caption = body.replace(r"\1", "caption")
    return F.regexp_extract_all(source, F.lit(rf"(?s){opening}{body}(?:</\1>(?:(?<={figures}){WS}*+<caption>{caption}(?:</caption>)?+)?+)?+"), F.lit(0))


def _opened(d: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """Of blocks as ``_cut`` gives them (``b``): block_no, name, body and the caption's source."""
    some = lambda m: reduce(Column.__or__, [m.startswith(f"<{x}>") for x in dropped])
    d = d.select(*[c for c in d.columns if c != "b"], F.posexplode(F.filter("b", lambda m: ~some(m))).alias("block_no", "m"))
    d = once(d, name=F.substr(F.substring_index("m", ">", 1), F.lit(2)))
    d = once(d, at=F.call_function("locate", F.concat(F.lit("</"), "name", F.lit(">")), F.col("m")))
    start = F.char_length("name") + 3
    body = F.when(F.col("at") > 0, F.substr("m", start, F.col("at") - start)).otherwise(F.substr("m", start))
    caption = F.when(F.col("name").isin(*FIGURES) & (F.col("at") > 0), F.substr("m", F.col("at") + start))
    return d.withColumn("body", body).withColumn("caption", caption).drop("m", "at")


def _matched(pages: DataFrame, source: str, rest: list[str], wrappers: tuple[str, ...]) -> DataFrame:
    """The other columns of each page and its blocks, for any page."""
    d = pages.select(*rest, F.col(source), F.monotonically_increasing_id().alias("__p")).repartition("__p")
    d = d.select("__p", *rest, F.posexplode(F.split(source, CUT, -1)).alias("pos", "piece"))
    name = F.regexp_extract("piece", "^</?([a-z0-9_]+)>", 1)
    d = d.withColumn("name", F.when(name.rlike("^loc_[0-9]+$"), "").otherwise(name)).withColumn("shut", F.col("piece").startswith("</"))
    step = F.when(F.col("name") == "", 0).when(F.col("shut"), -1).otherwise(1)
    depth = F.sum(step).over(Window.partitionBy("__p", "name").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("level", depth + F.when(F.col("shut"), 1).otherwise(0))
    # after a tag of some level the next of that name and level can only close it
    d = d.withColumn("end", F.lead("pos").over(Window.partitionBy("__p", "name", "level").orderBy("pos")))
    opens = (F.col("name") != "") & ~F.col("shut") & ~F.col("name").isin(*wrappers)
    in_order = lambda x: F.sort_array(F.collect_list(x))
    d = d.groupBy("__p").agg(*[F.first(c).alias(c) for c in rest], F.transform(in_order(F.struct("pos", "piece")), lambda x: x["piece"]).alias("p"), in_order(F.when(opens, F.struct("pos", "end", "name"))).alias("opens"))

    step = lambda acc, o: F.when(o["pos"] > acc["reached"], F.struct(F.coalesce(o["end"], F.size("p")).alias("reached"), F.concat(acc["tops"], F.array(F.struct(o["pos"].alias("pos"), F.coalesce(o["end"], F.size("p")).alias("end"), o["name"].alias("name")))).alias("tops"))).otherwise(acc)
    start = F.struct(F.lit(-1).alias("reached"), F.array().cast(f"array<{SPAN}>").alias("tops"))
    d = d.withColumn("tops", F.aggregate("opens", start, step, lambda acc: acc["tops"]))

    text = lambda lo, hi: F.array_join(F.slice("p", lo + 1, hi - lo), "")
    lone = lambda k: collapse(F.regexp_replace(F.get("p", k), "^</[a-z0-9_]+>", "")) == ""
    follows = lambda a, b: a["name"].isin(*FIGURES) & (b["name"] == "caption") & (b["pos"] == a["end"] + 1) & lone(a["end"])
    yes = lambda x: F.coalesce(x, F.lit(False))

    def parts(t: Column, i: Column) -> Column:
        after = F.get("tops", i + 1)
        body = _after(F.concat(F.lit("<"), t["name"], F.lit(">")), text(t["pos"], t["end"]))
        return F.struct(t["name"].alias("name"), body.alias("body"), F.when(yes(follows(t, after)), text(after["pos"], after["end"])).alias("caption"))

    taken = lambda t, i: yes((i > 0) & follows(F.get("tops", i - 1), t))
    kept = F.filter(F.transform("tops", lambda t, i: F.struct(parts(t, i).alias("b"), taken(t, i).alias("taken"))), lambda x: ~x["taken"])
    return d.select(*rest, F.transform(kept, lambda x: x["b"]).alias("b"))


def _grid(body: Column, cells: tuple[str, ...], spans: tuple[str, ...]) -> Column:
    """The rows of a table that have cells; a cell's text is the first between its tag and the next, locations apart."""
    cell = f"^<(?:{'|'.join(cells)})>"

    def text(x: Column) -> Column:
        first = F.coalesce(F.get(F.filter(F.split(x, LOC, -1), lambda y: y != ""), F.lit(0)), F.lit(""))
        return F.when(F.contains(x, F.lit("loc_")), first).otherwise(x)

    blank = lambda piece: reduce(Column.__or__, [piece.startswith(f"<{s}>") for s in spans])
    value = lambda piece: F.when(blank(piece), "").otherwise(collapse(let(F.regexp_replace(piece, cell, ""), text)))
    row = lambda line: F.transform(F.filter(F.split(line, CUT, -1), lambda x: x.rlike(cell)), value)
    return F.filter(F.transform(F.split(body, "<nl>", -1), row), lambda r: F.size(r) > 0)


def segment(pages: DataFrame, source: str, wrappers: tuple[str, ...], dropped: tuple[str, ...], cells: tuple[str, ...], spans: tuple[str, ...], grid: int) -> DataFrame:
    """The other columns of ``pages`` and the fields of a block: block_no, cls, bbox, raw, caption, grid, spans, and whether it is a table with cells.

    A null or empty page has no blocks; repeated pages each have theirs.
    """
    rest = [c for c in pages.columns if c != source]
    some = _nested(F.col(source), wrappers)
    plain = _opened(once(pages.where(~some), b=_cut(F.col(source), wrappers)).select(*rest, "b"), dropped)
    nested = _matched(pages.where(some), source, rest, wrappers)
    nested = nested.select(*rest, F.posexplode(F.filter("b", lambda x: ~x["name"].isin(*dropped))).alias("block_no", "b")).select(*rest, "block_no", "b.*")
    d = plain.unionByName(nested)
    d = once(d.select(*rest, "block_no", "name", F.col("body").alias("__body"), "caption"), body=F.col("__body"))
    text = lambda x: F.when(F.contains(F.col(x), F.lit("<")), F.regexp_replace(x, TAG, "")).otherwise(F.col(x))
    places = [F.regexp_extract("body", "^" + "</?loc_([0-9]+)>" * 4, k + 1) for k in range(4)]
    box = F.when(F.col("body").rlike("^" + LOC * 4), F.array(*[x.try_cast("double") / grid for x in places]))
    table = F.col("name") == "otsl"
    span = F.col("body").rlike(f"<(?:{'|'.join(spans)})>")
    return d.select(*rest, "block_no", F.col("name").alias("cls"), box.alias("bbox"), text("body").alias("raw"), F.nullif(collapse(text("caption")), F.lit("")).alias("caption"), F.when(table, _grid(F.col("body"), cells, spans)).alias("grid"), (table & span).alias("spans"), (table & F.col("body").rlike(f"<(?:{'|'.join(cells)})>")).alias("cells"))
