"""Queries of e-books: notes of many constructs made from ``part``, whose XHTML is known."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import epub
from ..sources import readers
from .registry import query
from .synthetic import table

_NOTE = r"""concat('---\ntitle: "Part ', p_partkey, '"\n---\n# Part ', p_partkey, '\n\nWeighs *', p_size, '* or **more**, `a<b>` and $w_{', p_size, '}$, $\\frac{1}{', p_size, '}$ [see ', p_partkey, ' & on](http://h/?q="', p_partkey, '").\nSecond ![pic](./images/p-', p_partkey,
 '.png) line\n\n$$e = ', p_size, '$$\n\n> [!warning]- May be cut\n> ![f](images/formula-1.png)\n\n> [!NOTE] About $w_{', p_size, '}$\n> - one\n> > deep *q*\n\n| no table\n\n| a | b |\n| --- | --- |\n| ', p_partkey, ' | $v$ |\n\n$$\ne = ', p_size, '\n$$\n## Code ', p_partkey, '\n```\n # x & "', p_partkey, '"\n```\n![alone](images/q-', p_partkey, '.png)')"""


def _book(spark, sf_dir) -> epub.Book:
    """Every fifth size has no sidecar; of the others the first crop fits even sizes, the second those that three divides."""
    p = table(spark, sf_dir, "part")
    notes = p.select(F.col("p_partkey").alias("doc_id"), F.lit("none").alias("title"), F.expr(_NOTE).alias("markdown"))
    some = p.where("p_size % 5 <> 0")
    one = some.selectExpr("p_partkey AS doc_id", "1 AS ordinal", "concat('e=', if(p_size % 2 = 0, p_size, -1)) AS tex", "'formula-1' AS id")
    two = some.where("p_size % 3 = 0").selectExpr("p_partkey AS doc_id", "2 AS ordinal", "concat('e  = ', p_size) AS tex", "'formula-2' AS id")
    return epub.Book(notes, one.unionByName(two))


def _files(spark, sf_dir):
    """All crops and first pictures exist; the last picture only of odd sizes."""
    names = F.expr("filter(array(concat('images/p-', p_partkey, '.png'), if(p_size % 2 = 1, concat('images/q-', p_partkey, '.png'), null), 'images/formula-1.png', 'images/formula-2.png'), x -> x IS NOT NULL)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.explode(names).alias("href"), F.encode(F.col("p_name"), "UTF-8").alias("content"))


_CROP = """CASE WHEN p_size % 5 <> 0 AND p_size % {1} = 0 THEN '<div class="math-display"><img src="images/formula-{0}.png" alt="e = ' || p_size || '"/></div>'
 ELSE '<aside class="callout callout-warning math-unrendered"><p class="callout-title">Formula could not be rendered</p><p><code class="tex">e = ' || p_size || '</code></p></aside>' END"""


@query(
    r"""SELECT p_partkey AS doc_id, c.no AS chapter_no, c.title, c.html FROM part, LATERAL (VALUES (1, 'Part ' || p_partkey, '<h1>Part ' || p_partkey || '</h1>' || chr(10) || '<p>Weighs <em>' || p_size || '</em> or <strong>more</strong>, <code>a&lt;b&gt;</code> and <em>w</em><sub>' || p_size || '</sub>, <code class="tex">\frac{1}{' || p_size || '}</code> <a href="http://h/?q=&quot;' || p_partkey || '&quot;">see ' || p_partkey
 || ' &amp; on</a>. Second <img src="images/p-' || p_partkey || '.png" alt="pic"/> line</p>' || chr(10) || """
    + _CROP.format(1, 2)
    + r""" || chr(10) || CASE WHEN p_size % 5 = 0 THEN '<aside class="callout callout-warning"><p class="callout-title">May be cut</p><figure><img src="images/formula-1.png" alt="f"/></figure></aside>' || chr(10) ELSE '' END
 || '<aside class="callout callout-note"><p class="callout-title">About <em>w</em><sub>' || p_size || '</sub></p><ul><li>one</li></ul>' || chr(10) || '<blockquote><p>deep <em>q</em></p></blockquote></aside>' || chr(10) || '<p>| no table</p>' || chr(10)
 || '<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>' || p_partkey || '</td><td><em>v</em></td></tr></tbody></table>' || chr(10) || """
    + _CROP.format(2, 3)
    + r"""), (2, 'Code ' || p_partkey, '<h2>Code ' || p_partkey || '</h2>' || chr(10) || '<pre><code> # x &amp; &quot;' || p_partkey || '&quot;</code></pre>' || chr(10) || '<figure><img src="images/q-' || p_partkey || '.png" alt="alone"/></figure>')) AS c(no, title, html)"""
)
def rendered_chapters(spark, sf_dir):
    return _book(spark, sf_dir).html.select("doc_id", "chapter_no", "title", "html")


@query("""SELECT p_partkey AS doc_id, o.n AS ordinal, CASE o.n WHEN 1 THEN 'e = ' || p_size ELSE chr(10) || 'e = ' || p_size || chr(10) END AS tex, CASE WHEN p_size % 5 <> 0 AND p_size % (o.n + 1) = 0 THEN 'formula-' || o.n END AS crop_id FROM part, (VALUES (1), (2)) AS o(n)""")
def book_formulas(spark, sf_dir):
    """Displayed formulas are keyed by their place: two with the same TeX have a crop each."""
    return _book(spark, sf_dir).formulas.select("doc_id", "ordinal", "tex", "crop_id")


@query(r"""SELECT p_partkey AS doc_id, f.i AS index, f.tex, f.x AS xhtml FROM part, LATERAL (VALUES (1, 'w_{' || p_size || '}', '<em>w</em><sub>' || p_size || '</sub>'), (2, '\frac{1}{' || p_size || '}', NULL), (3, 'v', '<em>v</em>')) AS f(i, tex, x)""")
def inline_formulas(spark, sf_dir):
    """Inline formulas are keyed by their TeX, in the order of first use, also where that is in a quote."""
    return _book(spark, sf_dir).inline.select("doc_id", "index", "tex", "xhtml")


@query("""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) AS INT) AS seq, href, CASE WHEN crop THEN 'math-' ELSE 'img-' END || regexp_replace(href, '[^A-Za-z0-9_]', '-', 'g') AS id, crop
FROM (SELECT p_partkey AS doc_id, a.k, a.href, a.crop, a.yes FROM part, LATERAL (VALUES (1, 'images/p-' || p_partkey || '.png', FALSE, TRUE), (2, 'images/formula-1.png', FALSE, p_size % 5 = 0), (3, 'images/q-' || p_partkey || '.png', FALSE, TRUE), (4, 'images/formula-1.png', TRUE, p_size % 5 <> 0 AND p_size % 2 = 0), (5, 'images/formula-2.png', TRUE, p_size % 5 <> 0 AND p_size % 3 = 0)) AS a(k, href, crop, yes)) WHERE yes""")
def book_assets(spark, sf_dir):
    """Pictures by first use, also in quotes, then the crops that are shown."""
    return _book(spark, sf_dir).assets.select("doc_id", "seq", "href", "id", "crop")


@query("""
SELECT doc_id, n_chapters, n_images, crops AS formulas_as_crop, 2 - crops AS formulas_as_text, 2 AS inline_as_text,
 list_filter([CASE WHEN crops = 1 THEN '1 equation' WHEN crops = 0 THEN '2 equations' END || ' could not be rendered and were exported as LaTeX source — no formula image was available. Converted papers get one by re-converting the PDF.', CASE WHEN even THEN 'missing image: images/q-' || doc_id || '.png' END], lambda x: x IS NOT NULL) AS warnings
FROM (SELECT p_partkey AS doc_id, 2 AS n_chapters, 1 + p_size % 2 + CAST(p_size % 5 = 0 AS INT) AS n_images, CASE WHEN p_size % 5 = 0 THEN 0 ELSE CAST(p_size % 2 = 0 AS INT) + CAST(p_size % 3 = 0 AS INT) END AS crops, p_size % 2 = 0 AS even FROM part)""")
def book_stats(spark, sf_dir):
    return _book(spark, sf_dir).stats(_files(spark, sf_dir))


@query()
def books(spark, sf_dir):
    """E-books with pictures and crops; their bytes are the same in every run."""
    return _book(spark, sf_dir).epubs(_files(spark, sf_dir)).select("doc_id", F.sha2("epub", 256).alias("sha256"))


@query("""SELECT r_regionkey AS doc_id, f.href, 'PAR1' AS head FROM region, (VALUES ('region.parquet'), ('nation.parquet')) AS f(href)""")
def asset_bytes(spark, sf_dir):
    """The tables' own files stand for pictures: those that are there are read, a missing one and one of another folder aren't."""
    wanted = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc_id"), F.lit("").alias("folder"), F.explode(F.array(F.lit("region.parquet"), F.lit("nation.parquet"), F.concat(F.lit("images/gone-"), "r_regionkey", F.lit(".png")), F.lit("../region.parquet"))).alias("href"))
    return readers.asset_bytes(spark, sf_dir, wanted).select("doc_id", "href", F.decode(F.substring("content", 1, 4), "UTF-8").alias("head"))
