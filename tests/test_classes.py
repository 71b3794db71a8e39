"""Blocks of some classes: the same rows as among all, made with less."""

import pytest

from quillspark.operators import doctags

PAGES = [
    (1, 2, "<picture></picture><caption>b</caption><formula>y</formula><otsl><fcel>1<nl></otsl>"),
    (1, 1, "<title>t</title><chart></chart><formula> </formula><formula>x</formula><group><picture><caption>in</caption></picture></group>"),
    (2, 1, "<text>a<text>b</text></text><picture>p</picture><otsl></otsl><formula>z</formula><otsl><ched>h<nl><lcel><nl></otsl>"),
    (3, 1, None),
]


@pytest.mark.parametrize("classes", [("otsl",), ("formula",), ("chart",), ("picture", "formula"), ("text", "title")])
def test_classes_are_the_rows_among_all(spark, classes):
    pages = spark.createDataFrame(PAGES, "doc_id long, page int, doc_tags string")
    wanted = {*classes, *(("picture", "chart") if {"picture", "chart"} & {*classes} else ())}
    key = lambda r: (r.doc_id, r.page, r.block_no)
    some = doctags.blocks(pages, classes)
    whole = doctags.blocks(pages)
    drop = [n for n, of in (("figure_no", {"picture", "chart"}), ("formula_no", {"formula"})) if not of & {*classes}]
    assert sorted(some.drop(*drop).collect(), key=key) == sorted((r for r in whole.drop(*drop).collect() if r.cls in wanted), key=key)
    assert some.schema == whole.schema


def test_tables_are_not_sorted_for_figures(spark):
    pages = spark.createDataFrame([(1, 1, "<otsl><fcel>1<nl></otsl>")], "doc_id long, page int, doc_tags string")
    windows = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("figure_no")
    assert windows(doctags.blocks(pages).where("cls = 'otsl'").select("doc_id", "markdown")) > 0
    assert windows(doctags.blocks(pages, ("otsl",)).select("doc_id", "markdown")) == 0
