"""Notes to e-books: front matter, chapters, assets, formula crops, statistics, and the container's bytes."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formulas import trivial_xhtml
from ..functions.text import WS, front_fields, let, media_type
from . import xhtml

IMAGE = r"!\[[^\]]*\]\(([^)\s]+)\)"


def body_of(md: Column) -> Column:
    """A note without its front matter."""
    end = F.locate("\n---", md, 5)
    rest = F.substr(md, end + 1)
    line = F.instr(rest, "\n")
    return F.when(md.startswith("---\n") & (end > 0), F.when(line > 0, F.substr(rest, line + 1)).otherwise(md)).otherwise(md)


def _chapters(md: Column) -> Column:
    """An array of (title, body) of a note: one at each heading of the first two levels."""
    blank = WS.replace(r"\n", "")
    filled = lambda x: x.rlike(f"[^{WS[1:-1]}]")
    part = lambda body, line: F.struct(body.alias("body"), F.substring_index(line, "\n", 1).alias("line"))

    def parts(p: Column) -> Column:
        # blank lines before the first heading are part of its chapter
        one, two = F.get(p, F.lit(0)), F.get(p, F.lit(1))
        joined = F.concat(F.array(part(F.concat(one, F.lit("\n"), two), two)), F.transform(F.slice(p, 3, F.size(p)), lambda x: part(x, x)))
        return F.when((F.size(p) > 1) & ~filled(one), joined).otherwise(F.transform(p, lambda x: part(x, x)))

    # a line break goes where a chapter ends
    found = F.filter(let(F.split(body_of(md), rf"\n(?=#{{1,2}}{blank})", -1), parts), lambda x: filled(x["body"]))
    title = lambda line: F.when(line.rlike(rf"^#{{1,2}}{WS}+"), F.regexp_extract(line, rf"^#{{1,2}}{WS}+(.*)$", 1))
    return F.transform(found, lambda x: F.struct(title(x["line"]).alias("title"), x["body"].alias("body")))


def chapters(notes: DataFrame) -> DataFrame:
    """(doc_id, chapter_no, title, n_lines, body) of ``notes(doc_id, markdown)``: one at each heading of the first two levels.

    A note is one row and is cut in it, so nothing is shuffled.
    """
    d = notes.select("doc_id", F.posexplode(_chapters(F.col("markdown"))).alias("no", "c"))
    return d.select("doc_id", (F.col("no") + 1).alias("chapter_no"), "c.title", F.size(F.split("c.body", "\n", -1)).cast("long").alias("n_lines"), "c.body")


def assets(notes: DataFrame) -> DataFrame:
    """(doc_id, href, seq, id, media_type): the images a note shows, each once, by first use. A note is one row, so nothing is shuffled."""
    d = notes.select("doc_id", F.posexplode(F.array_distinct(F.regexp_extract_all("markdown", F.lit(IMAGE), F.lit(1)))).alias("pos", "href"))
    return d.select("doc_id", "href", (F.col("pos") + 1).alias("seq"), F.concat(F.lit("img-"), F.regexp_replace("href", r"\W", "-")).alias("id"), media_type(F.col("href")).alias("media_type"))


def missing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, warning) of wanted assets without a file in ``files(doc_id, href)``."""
    return wanted.join(files, ["doc_id", "href"], "left_anti").select("doc_id", F.concat(F.lit("missing image: "), "href").alias("warning"))


def same_tex(a: Column, b: Column) -> Column:
    """Whether two formulas are equal but for white space."""
    return F.regexp_replace(a, f"{WS}+", "") == F.regexp_replace(b, f"{WS}+", "")


def crops(displayed: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Displayed formulas (doc_id, ordinal, tex) with the id of the crop that shows the same formula, or null."""
    same = same_tex(F.col("tex"), F.col("sidecar_tex"))
    d = displayed.join(sidecar.selectExpr("doc_id", "ordinal", "tex AS sidecar_tex", "id AS crop"), ["doc_id", "ordinal"], "left")
    return d.select("doc_id", "ordinal", F.when(same, F.col("crop")).alias("crop_id"), (~F.coalesce(same, F.lit(False))).alias("as_text"))


def _times(x: Column, by: int) -> Column:
    """``x * by`` modulo 2**32, of 32-bit numbers held in 64 bits."""
    high = F.shiftleft((F.shiftright(x, 16) * by).bitwiseAND(0xFFFF), 16)
    return (high + x.bitwiseAND(0xFFFF) * by).bitwiseAND(0xFFFFFFFF)


def uuids(seeds: Column) -> Column:
    """A UUID that only depends on the seed: two multiplicative hashes over its UTF-16 units (fixed multipliers and starts).

    A null seed is an empty one.
    """
    code = F.hex(F.encode(F.coalesce(seeds, F.lit("")), "UTF-16BE"))
    n = (F.char_length(code) / 4).cast("int")
    units = F.transform(F.regexp_extract_all(code, F.lit(".{4}"), F.lit(0)), lambda u: F.conv(u, 16, 10).cast("long"))
    start = F.struct(F.lit(0x9E3779B9).cast("long").bitwiseXOR(n.cast("long")).alias("a"), F.lit(0x85EBCA6B).cast("long").alias("b"))
    step = lambda h, u: F.struct(_times(h["a"].bitwiseXOR(u), 2654435761).alias("a"), _times(h["b"].bitwiseXOR(u), 1597334677).alias("b"))
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")

    def text(h: Column) -> Column:
        a, b = h["a"], h["b"]
        x = F.concat(digits(a), digits(b), digits(a.bitwiseXOR(b)), digits((a + b).bitwiseAND(0xFFFFFFFF)))
        return F.regexp_replace(x, "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")

    return F.aggregate(units, start, step, text)


def _escaped(x: str) -> str:
    return x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


#: How pages look where readers' own defaults don't do.
STYLE = """body { line-height: 1.5; margin: 0 5%; }
h1, h2, h3, figure, .math-display { page-break-inside: avoid; }
h1, h2, h3 { page-break-after: avoid; }
figure, .math-display { margin: 1em 0; text-align: center; }
img { max-width: 100%; }
table { border-collapse: collapse; font-size: 85%; }
td, th { border: 1px solid #888; padding: 2px 6px; }
.callout { border-left: 3px solid #888; padding-left: 1em; }
.callout-title { font-weight: bold; }
.tex { font-size: 90%; }
"""


def container(title: str, parts: list[tuple[str, str]], uuid: str = "", creators: list[str] | None = None, source: str | None = None, files: list[tuple[str, str, str, bytes]] | None = None) -> bytes:
    """The e-book's bytes; the same for the same input: times are fixed, the first entry is stored.

    ``parts`` are chapters' titles and XHTML, ``files`` the ids, paths, media types and bytes of images.
    """
    buffer, names = io.BytesIO(), [f"ch{k:03d}.xhtml" for k in range(1, len(parts) + 1)]
    page = '<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="en" xml:lang="en"><head><meta charset="utf-8"/><title>{}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body>\n{}\n</body></html>\n'
    with zipfile.ZipFile(buffer, "w") as z:

        def put(name: str, data: str | bytes, how: int = zipfile.ZIP_DEFLATED) -> None:
            info = zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0))
            info.compress_type = how
            z.writestr(info, data)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for name, (head, html) in zip(names, parts, strict=True):
            put(f"OEBPS/{name}", page.format(_escaped(head), html))
        put("OEBPS/style.css", STYLE)
        for _, href, _, data in files or ():
            put(f"OEBPS/{href}", data)
        put("OEBPS/nav.xhtml", page.format(_escaped(title), '<nav epub:type="toc" id="toc"><h1>Contents</h1><ol>' + "".join(f'<li><a href="{n}">{_escaped(head)}</a></li>' for n, (head, _) in zip(names, parts, strict=True)) + "</ol></nav>"))
        items = "".join(f'<item id="ch{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names)) + "".join(f'<item id="{i}" href="{_escaped(href)}" media-type="{kind}"/>' for i, href, kind, _ in files or ())
        about = "".join(f"<dc:creator>{_escaped(c)}</dc:creator>" for c in creators or ()) + (f"<dc:source>{_escaped(source)}</dc:source>" if source else "")
        spine = "".join(f'<itemref idref="ch{k}"/>' for k in range(len(names)))
        put("OEBPS/package.opf", f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="bookid" xml:lang="en"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">urn:uuid:{uuid}</dc:identifier><dc:title>{_escaped(title)}</dc:title><dc:language>en</dc:language>{about}<meta property="dcterms:modified">2026-01-01T00:00:00Z</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine>{spine}</spine></package>')
    return buffer.getvalue()


#: Characters of notes in a partition.
PART = 2**21


def _dealt(notes: DataFrame) -> tuple[DataFrame, int, int]:
    """``notes`` dealt out once by doc_id, in parts of about PART characters, how many, and how deep their quotes are.

    What a book is made of is cut in its row, so nothing else of the notes is shuffled, and what a task sorts doesn't grow with the
    input. One job measures the notes.
    """
    size, deepest = notes.agg(F.sum(F.char_length("markdown")), F.max(xhtml.depth(F.col("markdown")))).first()
    parts = max(int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // PART)
    return notes.repartition(parts, "doc_id"), parts, deepest or 0


def _id(href: Column, crop: Column) -> Column:
    """An asset's id in the package."""
    return F.concat(F.when(crop, "math-").otherwise("img-"), F.regexp_replace(href, r"\W", "-"))


class Book:
    """The tables of which e-books of ``notes(doc_id, title, markdown)`` are made; ``title`` is used where a note has none.

    ``sidecar(doc_id, ordinal, tex, id)`` are the crops of displayed formulas. A row of ``rows`` holds a note with its chapters, displayed formulas and images;
    all tables are lazy and come from it:

    * ``html``: doc_id, chapter_no, title, html
    * ``formulas``: doc_id, ordinal, path, tex, crop_id (null: shown as text)
    * ``inline``: doc_id, index, tex, xhtml of the different inline formulas
    * ``assets``: doc_id, seq, href, id, media_type, crop of what is shown, images first, then crops
    """

    def __init__(self, notes: DataFrame, sidecar: DataFrame | None = None):
        # what a note may show is found in its text, so that files need not wait for its blocks: all images are among these paths
        links = F.regexp_extract_all("markdown", F.lit(rf"\](?=\(([^){WS[1:-1]}]+)\))"), F.lit(1))
        self.named = notes.select("doc_id", F.explode_outer(F.array_distinct(F.transform(links, xhtml.relative))).alias("href"))
        if sidecar is not None:
            self.named = self.named.unionByName(sidecar.select("doc_id", F.concat(F.lit("images/"), "id", F.lit(".png")).alias("href")))
        notes, self.parts, deepest = _dealt(notes.select("doc_id", "title", "markdown"))
        side = "array<struct<ordinal:int,sidecar_tex:string,crop:string>>"
        if sidecar is not None:
            # one row for each document, dealt out as the notes are
            sides = sidecar.repartition(self.parts, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("tex").alias("sidecar_tex"), F.col("id").alias("crop")))).alias("sides"))
            notes = notes.join(sides, "doc_id", "left").withColumn("sides", F.col("sides").cast(side))
        else:
            notes = notes.withColumn("sides", F.lit(None).cast(side))
        d = notes.withColumn("chapters", F.coalesce(_chapters(F.col("markdown")), F.array().cast("array<struct<title:string,body:string>>")))
        d = d.withColumn("blocks", xhtml.cut(F.transform("chapters", lambda x: x["body"]), deepest, F.col("sides").isNotNull()))

        def crop(tex: Column, ordinal: Column) -> Column:
            # a crop is taken if it shows the formula that has its place
            return F.get(F.filter("sides", lambda x: (x["ordinal"] == ordinal) & same_tex(tex, x["sidecar_tex"])), F.lit(0))["crop"]

        formulas = F.transform(xhtml.displayed(F.col("blocks")), lambda b, i: F.struct((i + 1).alias("ordinal"), b["path"].alias("path"), b["source"].alias("tex"), crop(b["source"], i + 1).alias("crop_id")))
        self.rows = d.withColumn("formulas", formulas).withColumn("images", xhtml.shown(F.col("blocks")))
        # outer, since for others Spark would make the array in a filter once more
        self.formulas = self.rows.select("doc_id", F.inline_outer("formulas")).where("ordinal IS NOT NULL")
        inline = self.rows.select("doc_id", F.posexplode_outer(xhtml.inlined(F.col("blocks"))).alias("pos", "tex")).where("pos IS NOT NULL")
        self.inline = inline.select("doc_id", (F.col("pos") + 1).alias("index"), "tex", trivial_xhtml(F.col("tex")).alias("xhtml"))
        self.html = self.rows.select("doc_id", F.posexplode_outer(self._parts()).alias("pos", "part")).where("pos IS NOT NULL").select("doc_id", (F.col("pos") + 1).cast("long").alias("chapter_no"), "part.title", "part.html")
        a = self.rows.select("doc_id", F.size("images").alias("n"), F.posexplode_outer(self._hrefs()).alias("pos", "href")).where("pos IS NOT NULL").withColumn("crop", F.col("pos") >= F.col("n"))
        self.assets = a.select("doc_id", (F.col("pos") + 1).alias("seq"), "href", _id(F.col("href"), F.col("crop")).alias("id"), media_type(F.col("href")).alias("media_type"), "crop")

    @staticmethod
    def _parts() -> Column:
        """The chapters of a row as an array of (title, html)."""
        shown = xhtml.html(F.col("blocks"), F.transform("formulas", lambda x: xhtml.formula(x["tex"], x["crop_id"])))
        return F.zip_with("chapters", shown, lambda x, html: F.struct(x["title"].alias("title"), html.alias("html")))

    @staticmethod
    def _hrefs() -> Column:
        """The paths of a row's assets: images by first use, then crops that no image shows."""
        crops = F.filter(F.transform("formulas", lambda x: F.concat(F.lit("images/"), x["crop_id"], F.lit(".png"))), lambda x: x.isNotNull())
        return F.concat("images", F.array_except(crops, F.col("images")))

    def stats(self, files: DataFrame) -> DataFrame:
        """A row for each note: n_chapters, n_images, formulas_as_crop, formulas_as_text, inline_as_text, warnings.

        ``files(doc_id, href)`` are the files that exist. Of images those count that exist and show no formula; of inline formulas the different
        ones that need no renderer.
        """
        there = files.select("doc_id", "href").repartition(self.parts, "doc_id").groupBy("doc_id").agg(F.collect_set("href").alias("there"))
        d = self.rows.join(there, "doc_id", "left").withColumn("there", F.coalesce("there", F.array().cast("array<string>")))
        inline = F.filter(xhtml.inlined(F.col("blocks")), lambda x: trivial_xhtml(x).isNotNull())
        numbers = {"n_chapters": F.size("chapters"), "n_images": F.size(F.array_intersect("images", "there")), "formulas_as_crop": F.size(F.filter("formulas", lambda x: x["crop_id"].isNotNull())), "formulas_as_text": F.size(F.filter("formulas", lambda x: x["crop_id"].isNull())), "inline_as_text": F.size(inline)}
        gone = F.transform(F.array_except(self._hrefs(), F.col("there")), lambda x: F.concat(F.lit("missing image: "), x))
        d = d.select("doc_id", *(n.cast("long").alias(name) for name, n in numbers.items()), gone.alias("gone"))
        # fixed sentence
        said = F.when(F.col("formulas_as_text") > 0, F.concat("formulas_as_text", F.when(F.col("formulas_as_text") > 1, " equations").otherwise(" equation"), F.lit(" could not be rendered and were exported as LaTeX source — no formula image was available. Converted papers get one by re-converting the PDF.")))
        return d.select("doc_id", *numbers, F.concat(F.array_compact(F.array(said)), "gone").alias("warnings"))

    def epubs(self, files: DataFrame) -> DataFrame:
        """(doc_id, epub) of each note; ``files(doc_id, href, content)`` are the images' bytes.

        One row per document, so a task holds one book at a time. Only the container's bytes are made in Python.
        """
        fields = self.rows.select("doc_id", F.col("title").alias("fallback"), front_fields(F.col("markdown")).alias("f"), self._parts().alias("parts"), self._hrefs().alias("hrefs"), F.size("images").alias("n"))
        value = lambda key: F.try_element_at(F.filter("f", lambda x: x["key"] == key), F.lit(-1))
        title = F.coalesce(F.nullif(value("title")["value"], F.lit("")), F.col("fallback"), F.lit(""))
        names = F.when(value("author")["value"].isNotNull(), F.array(value("author")["value"])).otherwise(value("author")["items"])
        assets = F.transform("hrefs", lambda x, i: F.struct(_id(x, i >= F.col("n")).alias("id"), x.alias("href"), media_type(x).alias("media_type")))
        about = fields.select("doc_id", title.alias("title"), F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.rlike(f"[^{WS[1:-1]}]")).alias("creators"), value("source")["value"].alias("source"), "parts", assets.alias("assets"))
        about = about.withColumn("uuid", uuids(F.concat("title", F.coalesce("source", F.lit("")))))
        held = files.select("doc_id", "href", "content").join(self.named, ["doc_id", "href"], "left_semi").repartition(self.parts, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("href", "content"))).alias("files"))

        @F.pandas_udf("binary")
        def pack(title: pd.Series, uuid: pd.Series, creators: pd.Series, source: pd.Series, parts: pd.Series, assets: pd.Series, files: pd.Series) -> pd.Series:
            out = []
            for t, u, c, s, ps, shown, fs in zip(title, uuid, creators, source, parts, assets, files, strict=True):
                there = {f["href"]: f["content"] for f in (fs if fs is not None else ())}
                out.append(container(t, [(p["title"] or t, p["html"]) for p in ps], u, list(c), s, [(a["id"], a["href"], a["media_type"], there[a["href"]]) for a in shown if there.get(a["href"]) is not None]))
            return pd.Series(out)

        d = about.join(held, "doc_id", "left")
        return d.select("doc_id", pack("title", "uuid", "creators", "source", "parts", "assets", "files").alias("epub"))
