"""Pages to one Markdown note per document, with warnings where the damage is and at the head."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas, titles
from ..functions.text import TAGS, frontmatter, strip, utf16_length

#: Fixed values, as are the sentences of ``page_marker``, ``image_only``, ``banner`` and ``packages``: characters a page below which a source looks scanned, and below which a text layer is no rescue.
IMAGE_ONLY, MIN_RESCUE = 200, 200
RESCUED = "no text was recognized on this page; the text above comes from the PDF's own text layer, so it has no headings, tables or equations"


def within_limit(pages: DataFrame, max_pages: int | None) -> DataFrame:
    """The first ``max_pages`` pages of each document; all if it is None or 0. Applied before any costly step."""
    return pages.where(F.col("page") <= max_pages) if max_pages else pages


def throughput(generations: DataFrame) -> DataFrame:
    """Tokens a second of each page, two decimals; null for a page that took no time."""
    return generations.withColumn("tokens_per_sec", F.when(F.col("ms") > 0, F.round(F.col("gen_tokens") * 1000.0 / F.col("ms"), 2)))


def has_prose(md: Column) -> Column:
    return strip(F.regexp_replace(md, r"!\[[^\]]*\]\([^)]*\)", "")) != ""


def fallback(formula_id: Column) -> Column:
    return F.concat(F.lit("> [!warning]- This formula may be incomplete — show the original from the PDF\n> !["), formula_id, F.lit("](images/"), formula_id, F.lit(".png)"))


def suspects(blocks: DataFrame, generations: DataFrame) -> DataFrame:
    """Formulas of ``operators.doctags.blocks`` with id, repaired LaTeX and whether they look cut off."""
    f = blocks.where("cls = 'formula'").join(generations.select("doc_id", "page", "truncated"), ["doc_id", "page"], "left")
    last = F.lead("block_no").over(Window.partitionBy("doc_id", "page").orderBy("block_no")).isNull()
    tex = formulas.fix(F.col("text"))
    suspect = F.col("bbox").isNotNull() & (formulas.truncated(tex) | (last & F.col("truncated").isNotNull()))
    return f.select("doc_id", "page", "block_no", F.concat(F.lit("formula-"), "formula_no").alias("id"), tex.alias("tex"), suspect.alias("suspect"))


def annotate(md: Column, found: Column) -> Column:
    """Markdown with the notice below each suspect formula; the nth ``$$...$$`` is the nth of ``found`` (id, suspect), null: none."""
    pattern = r"(?s)\$\$.+?\$\$"
    between, maths = F.split(md, pattern, -1), F.regexp_extract_all(md, F.lit(pattern), F.lit(0))

    def part(text, k):
        own = F.get(found, k)
        block = F.when(F.coalesce(own["suspect"], F.lit(False)), F.concat(F.get(maths, k), F.lit("\n\n"), fallback(own["id"]))).otherwise(F.get(maths, k))
        return F.concat(text, F.coalesce(block, F.lit("")))

    return F.when(found.isNull(), md).otherwise(F.array_join(F.transform(between, part), ""))


def document_metrics(pages: DataFrame) -> DataFrame:
    """Sums over ``pages(doc_id, page, gen_tokens, prompt_tokens, ms)``: pages, tokens, time and tokens a second (null without time)."""
    d = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("gen_tokens").alias("gen_tokens"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("ms").alias("ms"))
    return d.withColumn("tokens_per_sec", F.when(F.col("ms") > 0, F.round(F.col("gen_tokens") * 1000.0 / F.col("ms"), 2)))


def page_marker(page: Column, rescued: Column, truncated: Column, spans: Column) -> Column:
    """The notice at a page's end; null if nothing is wrong."""
    issues = F.array_compact(F.array(F.when(rescued, F.lit(RESCUED)), F.when(truncated.isNotNull(), F.concat(F.lit("generation stopped early ("), truncated, F.lit("), so text may be missing here"))), F.when(spans, F.lit("a table here had merged cells that render blank"))))
    return F.when(F.size(issues) > 0, F.concat(F.lit("> [!warning] Page "), page.cast("string"), F.lit(" may be incomplete — "), F.array_join(issues, "; "), F.lit(".")))


def image_only(chars: Column, pages: Column, ocr: Column | None = None) -> Column:
    """The warning for a source with little text; null otherwise."""
    tail = F.lit(" — retry with --ocr") if ocr is None else F.when(ocr, F.lit("")).otherwise(F.lit(" — retry with --ocr"))
    return F.when((pages > 0) & (chars < IMAGE_ONLY * pages), F.concat(F.lit("very little text extracted; source may be scanned/image-only"), tail))


def banner(warnings: Column) -> Column:
    head = F.concat(F.lit("> [!warning]+ Conversion warnings ("), F.size(warnings).cast("string"), F.lit(")\n> This note was converted from a PDF and parts of it may be incomplete.\n> Check the source PDF where flagged below.\n"))
    return F.when(F.size(warnings) > 0, F.concat(head, F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("> - "), w)), "\n"), F.lit("\n\n"))).otherwise("")


def _ordered(value: Column, when: Column) -> Column:
    """The values of those rows, by page."""
    return F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("page", value.alias("v"))))), lambda x: x["v"])


def packages(pages: DataFrame, documents: DataFrame, created: str, max_pages: int | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """A note per document: title, warnings and Markdown with front matter and banner.

    ``pages(doc_id, page, markdown, title, truncated, spans, rescued, n_suspect)``: ``rescued`` is the text layer's text or
    null, used where a page has no prose and it has 200 characters. Where there is a column ``formulas`` (array of id and
    suspect, in order), each suspect formula gets its notice. ``documents(doc_id, source, stem, page_count, meta_title,
    author, published, description)``. A document without pages gives no note; null Markdown is empty.
    """
    p = within_limit(pages, max_pages)
    md = F.coalesce("markdown", F.lit(""))
    if "formulas" in p.columns:
        p = p.withColumn("markdown", annotate(md, F.col("formulas"))).withColumn("n_suspect", F.coalesce(F.size(F.filter("formulas", lambda f: f["suspect"])), F.lit(0)))
    saved = ~has_prose(md) & (utf16_length(F.coalesce("rescued", F.lit(""))) >= MIN_RESCUE)
    p = p.select("doc_id", "page", md.alias("markdown"), "title", "truncated", F.coalesce("spans", F.lit(False)).alias("spans"), F.coalesce("n_suspect", F.lit(0)).alias("n_suspect"), "rescued", saved.alias("saved"))
    marker = page_marker(F.col("page"), F.col("saved"), F.col("truncated"), F.col("spans"))
    part = F.array_join(F.array_compact(F.array("markdown", F.when(F.col("saved"), F.col("rescued")), marker)), "\n\n")
    numbers = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(F.col(cond), F.col("page")))), ", ")
    g = p.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("raw"),
        F.max(F.when(F.col("page") == 1, F.col("title"))).alias("heading"),
        F.max("page").alias("last"),
        _ordered(F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(": generation stopped early ("), F.col("truncated"), F.lit(") — output may be incomplete")), F.col("truncated").isNotNull()).alias("cut"),
        numbers("spans").alias("span_pages"), F.count_if("spans").alias("n_span"), numbers("saved").alias("saved_pages"), F.count_if("saved").alias("n_saved"), F.sum("n_suspect").alias("n_suspect"),
    )
    d = g.join(documents, "doc_id").withColumn("body", formulas.clean(F.col("raw")))
    s = lambda n: F.when(F.col(n) > 1, "s").otherwise("")
    spans = F.when(F.col("n_span") > 0, F.concat(F.lit("table"), s("n_span"), F.lit(" on page"), s("n_span"), F.lit(" "), F.col("span_pages"), F.lit(" contained merged cells rendered blank — verify against source")))
    rescue = F.when(F.col("n_saved") > 0, F.concat(F.lit("page"), s("n_saved"), F.lit(" "), F.col("saved_pages"), F.lit(": no text recognized — the text there was read from the PDF's own text layer, so it has no headings, tables or equations")))
    suspect = F.when(F.col("n_suspect") > 0, F.concat(F.col("n_suspect").cast("string"), F.lit(" formula"), s("n_suspect"), F.lit(" may be incomplete — the original from the PDF is inlined below each, collapsed")))
    limit = F.when(F.col("last") < F.col("page_count"), F.concat(F.lit("processed only "), F.col("last").cast("string"), F.lit(" of "), F.col("page_count").cast("string"), F.lit(" pages (--max-pages)")))
    d = d.withColumn("warnings", F.array_compact(F.concat(F.col("cut"), F.array(image_only(utf16_length(F.col("body")), F.col("last")), spans, rescue, suspect, limit))))
    d = d.withColumn("title", titles.choose(F.col("meta_title"), F.col("heading"), F.col("stem")))
    fm = frontmatter(F.col("title"), F.col("source"), F.col("author"), F.col("published"), F.lit(created), F.col("description"), F.col("last"), F.size("warnings"), tags)
    return d.select("doc_id", "title", "last", "warnings", F.concat(fm, F.lit("\n"), banner(F.col("warnings")), F.col("body")).alias("markdown"), utf16_length(F.col("body")).alias("body_chars"))
