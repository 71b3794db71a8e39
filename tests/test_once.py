"""Costly expressions are in the plan once, however often their values are used."""

import pytest
from pyspark.sql import functions as F

from quillspark.functions import formulas
from quillspark.operators import doctags

PAGES = [(1, 1, "<title>t  t</title><otsl><fcel>1<nl><fcel>2<fcel>3<nl></otsl>"), (1, 2, "<fcel>a<fcel>b"), (2, 1, "<text>a<text>b</text></text><fcel>x</fcel><picture></picture> <caption>c<loc_1>")]


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("wanted", ["titles", "blocks", "notes"])
def test_a_page_is_cut_by_one_expression(spark, wanted):
    found = doctags.blocks(spark.createDataFrame(PAGES, "doc_id long, page int, doc_tags string"))
    d = {"titles": lambda: doctags.parsed_pages(found).select("doc_id", "page", "title", "dropped_spans"), "blocks": lambda: found.where("cls <> 'otsl'").select("doc_id", "cls", "text"), "notes": lambda: doctags.parsed_pages(found)}[wanted]()
    assert plan(d).count("regexp_extract_all") == 1
    assert plan(d).count("substring_index") <= 1
    # a column that isn't wanted isn't made
    assert ("<nl>" in plan(d)) == (wanted == "notes")


def test_a_formula_is_stripped_once_and_a_table_measured_once(spark):
    d = spark.createDataFrame([(" {a & b ", [["x", "y"], ["z"]]), (None, [])], "t string, g array<array<string>>").select(formulas.fix(F.col("t")).alias("t"), doctags.table_markdown(F.col("g")).alias("g"))
    assert plan(d.select("t")).count("\\uFEFF]+$") == 1 and plan(d.select("g")).count("array_max") == 1
    assert [tuple(r) for r in d.collect()] == [("\\begin{aligned}{a & b}\\end{aligned}", "| x | y |\n| --- | --- |\n| z |  |"), (None, None)]


def test_lists_are_sorted_without_a_comparison_in_sql(spark):
    found = doctags.blocks(spark.createDataFrame(PAGES, "doc_id long, page int, doc_tags string"))
    assert "lambda left" not in plan(doctags.parsed_pages(found))
