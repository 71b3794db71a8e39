"""Queries of branches that other queries' rows don't reach: broken formulas, captions alone, expectation files, devices that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..operators import checks, doctags, packages
from ..sources import readers
from ..streaming import runs
from .registry import query
from .synthetic import table, turns


@query(r"""SELECT p_partkey, 'Of $$\frac{a_{' || p_partkey || '}}$$ and $$' || CASE WHEN p_size % 3 = 0 THEN '{b}' ELSE '{{c}}' END || '$$' || CASE WHEN p_size % 3 = 0 THEN ' $$$' ELSE '' END AS md FROM part""")
def broken_formulas(spark, sf_dir):
    """Formulas that lack braces at the end or at the front, in texts with and without a third dollar."""
    even, three = F.col("p_size") % 2 == 0, F.col("p_size") % 3 == 0
    md = F.concat(F.lit("Of $$\\frac{a_{"), "p_partkey", F.when(even, "}").otherwise(""), F.lit("$$ and $$"), F.when(three, "b}").otherwise("c}}"), F.lit("$$"), F.when(three, " $$$").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", formulas.clean(md).alias("md"))


@query("""SELECT p_partkey AS doc_id, b.n AS block_no, b.md AS markdown FROM part, LATERAL (VALUES (0, '*see [' || p_partkey || ']*'), (1, 'between'), (2, CASE WHEN p_size % 2 = 0 THEN '*alone*' END)) AS b(n, md) WHERE b.md IS NOT NULL""")
def lone_captions(spark, sf_dir):
    """Captions without a picture before them; an empty one gives nothing."""
    tags = F.concat(F.lit("<caption><loc_1> see  ["), "p_partkey", F.lit("]</caption><paragraph>between</paragraph><caption>"), F.when(F.col("p_size") % 2 == 0, "alone").otherwise(" "), F.lit("</caption>"))
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), tags.alias("doc_tags"))
    return doctags.blocks(d).select("doc_id", "block_no", "markdown")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, n_nationkey % 3 = 0 AND n_regionkey > 0 AS passed, CAST(n_nationkey % 3 <> 0 AS BIGINT) + CAST(n_nationkey % 3 = 2 AS BIGINT) + CAST(n_regionkey = 0 AS BIGINT) AS n_failed FROM nation""")
def expected_notes(spark, sf_dir):
    """Notes held against expectation files, one for each nation, which are written first: the title, a cell and the headings may fail."""
    n, root = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey") % 3), runs.scratch(spark, "expectations")
    want = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.when(F.col("k") == 0, F.col("n_name")).otherwise("nobody").alias("title_contains"), F.when(F.col("k") == 2, 9).otherwise(1).alias("min_headings"), F.lit(1).alias("min_images"), F.lit(1).alias("min_math_blocks"), F.array(F.concat(F.lit("land  "), "n_name")).alias("required_substrings"), F.array(F.lit("| 1 |")).alias("required_table_cells"), F.array(F.lit("GLYPH")).alias("forbidden_substrings"))
    packages.write(n.select(F.concat("n_nationkey", F.lit(".json")).alias("path"), F.encode(F.to_json(want, {"pretty": "true"}), "UTF-8").alias("content")), root).collect()
    md = F.concat(F.lit("---\nx\n---\n# a\nland "), "n_name", F.lit("\n\n$$x$$\n\n| a | "), F.when(F.col("n_regionkey") > 0, "1").otherwise("2"), F.lit(" |"))
    notes = n.select(F.col("n_nationkey").cast("string").alias("doc_id"), F.col("n_name").alias("title"), F.lit(1).alias("images"), md.alias("markdown"))
    return checks.passed(checks.run(notes, readers.expectations(spark, root).withColumnRenamed("id", "doc_id")))


@query("""SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, 'wasm' AS device, TRUE AS fell_back, ['webgpu: no adapter', 'webnn-npu: no driver'] AS failures, '<text>' || role || '</text>' AS doc_tags FROM conversations""")
def device_fallback(spark, sf_dir):
    """Each task tries its devices in order; two fail to start, and their failures come with the pages."""

    def load(device):
        if device != "wasm":
            raise RuntimeError("no adapter" if device == "webgpu" else "no driver")
        return lambda r: {"doc_id": str(r["doc_id"]), "page": r["page"], "doc_tags": f"<text>{r['role']}</text>", "truncated": None, "gen_tokens": 1, "prompt_tokens": 1, "ms": 1}

    d = readers.infer_on(turns(spark, sf_dir).select("doc_id", "page", "role"), ["webgpu", "webnn-npu", "wasm"], load)
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "page", "device", "fell_back", "failures", "doc_tags")
