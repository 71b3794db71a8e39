"""Quality checks of notes against expectations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS


def norm(x: Column) -> Column:
    return F.regexp_replace(x, f"{WS}+", " ")


def headings(md: Column) -> Column:
    return F.regexp_count(md, F.lit("(?m)^#{1,6} .+$"))


def math_blocks(md: Column) -> Column:
    return F.floor((F.size(F.split(md, r"\$\$", -1)) - 1) / 2).cast("int")


def table_text(md: Column) -> Column:
    return F.array_join(F.filter(F.split(md, "\n", -1), lambda x: x.startswith("|") | x.contains("<td")), "\n")


def run(notes: DataFrame, expectations: DataFrame) -> DataFrame:
    """(doc_id, name, ok): eight checks for each of ``notes(doc_id, title, images, markdown)`` that has an expectation."""
    d = notes.join(expectations, "doc_id")
    flat, tables = norm(F.col("markdown")), table_text(F.col("markdown"))
    named = {
        "title": F.contains("title", "title_contains"),
        "frontmatter": F.col("markdown").startswith("---\n"),
        "min_headings": headings(F.col("markdown")) >= F.col("min_headings"),
        "min_images": F.col("images") >= F.col("min_images"),
        "min_math_blocks": math_blocks(F.col("markdown")) >= F.col("min_math_blocks"),
        "required_substrings": F.forall("required_substrings", lambda s: F.contains(flat, norm(s))),
        "required_table_cells": F.forall("required_table_cells", lambda s: F.contains(tables, s)),
        "forbidden_substrings": ~F.exists("forbidden_substrings", lambda s: F.contains(flat, norm(s))),
    }
    return d.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in named.items()])))


def passed(checks: DataFrame) -> DataFrame:
    return checks.groupBy("doc_id").agg(F.bool_and("ok").alias("passed"), F.count_if(~F.col("ok")).alias("n_failed"))


def contract(notes: DataFrame) -> DataFrame:
    """(doc_id, name, ok): the checks of a figure-rich paper's package, ``notes(doc_id, markdown, stem, meta)``; meta as ``sidecars`` reads it."""
    md, meta = F.col("markdown"), F.col("meta")
    file = lambda x: F.regexp_extract(x, r"[^/\\\\]*$", 0)
    named = {
        "folder": file(meta["out_dir"]) == F.col("stem"),
        "file": file(meta["md_path"]) == F.concat("stem", F.lit(".md")),
        "frontmatter": md.startswith("---\n") & F.contains(F.get(F.split(md, "---", 3), F.lit(1)), F.lit("title:")),
        "size": F.length(md) > 5000,
        "headings": F.size(F.split(md, "## ", -1)) > 3,
        "counts": (meta["pages"] > 0) & (meta["wall_ms"] > 0),
        "images": meta["images"] >= 1,
        "maths": F.contains(md, F.lit("$$")),
    }
    return notes.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in named.items()])))


def smoke(notes: DataFrame) -> DataFrame:
    """(doc_id, name, ok): the checks that hold for any PDF, of ``notes(doc_id, markdown, warnings)``."""
    md = F.col("markdown")
    named = {"no_warnings": F.size("warnings") == 0, "frontmatter": md.startswith("---\n"), "size": F.length(md) > 2000, "headings": headings(md) > 0, "no_glyphs": ~F.contains(md, F.lit("GLYPH"))}
    return notes.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in named.items()])))
