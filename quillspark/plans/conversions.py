"""Queries of whole conversions: pages with and without prose, notes, packages and their files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble, packages
from ..sources import rasters
from ..streaming import runs
from .registry import query
from .synthetic import table, turns

_NOTES = """
WITH p AS (SELECT conv_id AS k, turn + 1 AS t, (turn + 1) % 4 = 2 AND conv_id % 3 > 0 AS saved,
  CASE (turn + 1) % 4 WHEN 2 THEN '![figure-' || (turn + 1) || '](images/figure-' || (turn + 1) || '.png)' ELSE '## Turn ' || (turn + 1) END AS md, repeat('r', 199 + CAST(conv_id % 3 AS INT)) AS r FROM conversations),
b AS (SELECT k, max(t) AS n, string_agg(md || CASE WHEN saved THEN '~~' || r || '~~> [!warning] Page ' || t || ' may be incomplete — no text was recognized on this page; the text above comes from the PDF''s own text layer, so it has no headings, tables or equations.' ELSE '' END, '~~' ORDER BY t) AS body,
  count(*) FILTER (WHERE saved) AS m, string_agg(CASE WHEN saved THEN CAST(t AS VARCHAR) END, ', ' ORDER BY t) AS s FROM p GROUP BY k),
w AS (SELECT *, list_filter([CASE WHEN length(body) < 200 * n THEN 'very little text extracted; source may be scanned/image-only — retry with --ocr' END, CASE WHEN m > 0 THEN 'page' || CASE WHEN m > 1 THEN 's ' ELSE ' ' END || s || ': no text recognized — the text there was read from the PDF''s own text layer, so it has no headings, tables or equations' END], lambda x: x IS NOT NULL) AS warnings FROM b),
f AS (SELECT k, n, warnings, replace('---~title: "talk ' || k || '"~source: "c.pdf"~created: 2024-01-02~pages: ' || n || '~' || CASE WHEN len(warnings) > 0 THEN 'conversion_warnings: ' || len(warnings) || '~' ELSE '' END || 'tags:~  - paper~  - converted~---~~'
  || CASE WHEN len(warnings) > 0 THEN '> [!warning]+ Conversion warnings (' || len(warnings) || ')~> This note was converted from a PDF and parts of it may be incomplete.~> Check the source PDF where flagged below.~> - ' || array_to_string(warnings, '~> - ') || '~~' ELSE '' END || body, '~', chr(10)) AS markdown FROM w)
"""


def _notes(spark, sf_dir):
    """Every fourth page shows a picture only; its text layer has 199, 200 or 201 characters. Another with a text layer has prose."""
    t = turns(spark, sf_dir).select("doc_id", "page")
    null, k = F.lit(None).cast("string"), F.col("page") % 4
    md = F.when(k == 2, F.concat(F.lit("![figure-"), "page", F.lit("](images/figure-"), "page", F.lit(".png)"))).otherwise(F.concat(F.lit("## Turn "), "page"))
    layer = F.when(k == 2, F.repeat(F.lit("r"), (F.lit(199) + F.col("doc_id") % 3).cast("int"))).when(k == 3, F.repeat(F.lit("s"), F.lit(500)))
    pages = t.select("doc_id", "page", md.alias("markdown"), null.alias("title"), null.alias("truncated"), F.lit(False).alias("spans"), layer.alias("rescued"), F.lit(0).alias("n_suspect"))
    docs = t.groupBy("doc_id").agg(F.max("page").alias("page_count")).select("doc_id", F.lit("c.pdf").alias("source"), F.concat(F.lit("talk "), "doc_id").alias("stem"), "page_count", null.alias("meta_title"), null.alias("author"), null.alias("published"), null.alias("description"))
    return assemble.packages(pages, docs, "2024-01-02")


@query(_NOTES + "SELECT k AS doc_id, 'talk ' || k AS title, CAST(n AS INT) AS last, warnings, markdown FROM f")
def rescued_notes(spark, sf_dir):
    return _notes(spark, sf_dir).select("doc_id", "title", "last", "warnings", "markdown")


@query(_NOTES + ", x AS (SELECT 'c/' || k || '/talk ' || k || '.md' AS path, sha256(markdown) AS sha256 FROM f UNION ALL SELECT 'c/' || conv_id || '/images/figure-' || (turn + 1) || '.png', sha256('figure ' || conv_id) FROM conversations WHERE (turn + 1) % 4 = 2) SELECT * FROM x")
def committed_packages(spark, sf_dir):
    """From pages to files: notes, sidecars and pictures are committed as packages, and read again from there. Sidecars, which say how long their notes are, are left out."""
    root = runs.scratch(spark, "packages")
    notes = _notes(spark, sf_dir).select("doc_id", "title", "warnings", "markdown", F.col("last").alias("pages"), F.lit("c.pdf").alias("source"), F.concat(F.lit("c/"), "doc_id").alias("out_dir"), F.col("title").alias("stem"), F.lit(0).alias("images"))
    shown = turns(spark, sf_dir).where("page % 4 = 2").select("doc_id", F.concat(F.lit("figure-"), "page").alias("id"), F.encode(F.concat(F.lit("figure "), "doc_id"), "UTF-8").alias("png"))
    packages.commit(packages.files(packages.meta(notes, "e", "1", "m"), shown), root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/c")
    return found.where("path NOT LIKE '%/meta.json'").select(F.regexp_extract("path", "(c/[0-9]+/.*)$", 1).alias("path"), F.sha2("content", 256).alias("sha256"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 1 THEN 'out/' || o_orderkey || '/a.pdf' WHEN 3 THEN CASE WHEN first THEN 'shared/a.pdf' END END AS target,
 CASE WHEN o_orderkey % 4 = 2 THEN 'Left a.pdf where it was — out/' || o_orderkey || ' already holds a file of that name.' WHEN o_orderkey % 4 = 3 AND NOT first THEN 'Left a.pdf where it was — shared already holds a file of that name.' END AS warning
FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY 'in/' || o_orderkey) = 1 AS first FROM orders)""")
def source_moves(spark, sf_dir):
    """Sources in their package, with a free target, with a taken one, and many with one target."""
    k = F.col("o_orderkey") % 4
    o = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("k"), F.concat(F.lit("out/"), "o_orderkey").alias("own"))
    sources = o.select("o_orderkey", F.when(F.col("k") == 0, F.concat("own", F.lit("/a.pdf"))).otherwise(F.concat(F.lit("in/"), "o_orderkey", F.lit("/a.pdf"))).alias("path"), F.when(F.col("k") == 3, "shared").otherwise(F.col("own")).alias("folder"))
    return packages.moves(sources, o.where("k = 2").select(F.concat("own", F.lit("/a.pdf")).alias("path"))).select("o_orderkey", "target", "warning")


def _rasters(spark, sf_dir):
    """Pages of 8 x 6 pixels in the grey of the part's size; of the second rendering the first ``p_partkey % 9`` pixels are brighter by 20 and all have another alpha."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.lpad(F.hex("p_size"), 2, "0").alias("v"), F.lpad(F.hex(F.col("p_size") + 20), 2, "0").alias("w"), (F.col("p_partkey") % 9).cast("int").alias("k"), (F.col("p_partkey") % 7).alias("seven"), (F.col("p_partkey") % 5).alias("five"))
    grey = lambda x, alpha: F.concat(x, x, x, F.lit(alpha))
    one = p.select("doc_id", "page", F.lit(8).alias("width"), F.lit(6).alias("height"), F.unhex(F.repeat(grey("v", "FF"), F.lit(48))).alias("rgba"))
    two = p.where("seven <> 0").select("doc_id", "page", F.when(F.col("five") == 0, 6).otherwise(8).alias("width"), F.when(F.col("five") == 0, 8).otherwise(6).alias("height"), F.unhex(F.concat(F.repeat(grey("w", "00"), F.col("k")), F.repeat(grey("v", "00"), F.lit(48) - F.col("k")))).alias("rgba"))
    return rasters.bands(one, 4), rasters.bands(two, 4)


@query("""
SELECT p_partkey AS doc_id, 1 AS page, CASE WHEN e IS NULL THEN '8x6' END AS size, CASE WHEN e IS NULL THEN 48 END AS pixels, CASE WHEN e IS NULL THEN round(100.0 * (p_partkey % 9) / 48, 3) END AS differing_pct, CASE WHEN e IS NULL THEN round(20.0 * (p_partkey % 9) / 48, 3) END AS mean_abs_luma,
 CASE WHEN e IS NULL THEN CASE WHEN p_partkey % 9 > 0 THEN 20 ELSE 0 END END AS max_abs_luma, e AS error
FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'missing render' WHEN p_partkey % 5 = 0 THEN 'size 8x6 vs 6x8' END AS e FROM part)""")
def raster_differences(spark, sf_dir):
    return rasters.differences(*_rasters(spark, sf_dir))


@query("""
SELECT p_partkey AS doc_id, 'figure-' || b.n AS id, b.w AS width, b.h AS height, b.w * b.h * 4 + b.h AS bytes FROM part, LATERAL (VALUES (1, 8, 6), (2, 3, 2), (3, 1, 1), (4, 1 + p_partkey % 4, 3)) AS b(n, w, h)""")
def crop_images(spark, sf_dir):
    """Crops across bands: the whole page, a box rounded outwards, one outside of the page, and one that grows with the part."""
    one, _ = _rasters(spark, sf_dir)
    box = lambda l, t, r, b: F.struct(*[F.lit(x).cast("double").alias(k) if not hasattr(x, "alias") else x.alias(k) for k, x in zip("ltrb", (l, t, r, b), strict=True)])
    named = F.array(*[F.struct(F.lit(f"figure-{n}").alias("id"), b.alias("box")) for n, b in enumerate((box(0, 0, 1, 1), box(0.2, 0.4, 0.45, 0.6), box(1.2, 1.2, 1.4, 1.3), box(0, 0.5, (F.col("p_partkey") % 4 + 1) / 8.0, 1)), 1)])
    boxes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).alias("page"), F.inline(named))
    number = lambda k: F.conv(F.hex(F.substring("png", k, 4)), 16, 10).cast("int")

    @F.pandas_udf("long")
    def unpacked(x):
        import zlib

        return x.map(lambda v: len(zlib.decompress(bytes(v)[41:-16])))

    return rasters.crops(one, boxes).select("doc_id", "id", number(17).alias("width"), number(21).alias("height"), unpacked("png").alias("bytes"))
