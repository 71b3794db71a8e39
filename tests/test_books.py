"""Rendering of notes, formula keys, assets and containers."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import epub, xhtml
from quillspark.sources import readers

CASES = [
    ("para *em* **strong** `c<o>de`", "<p>para <em>em</em> <strong>strong</strong> <code>c&lt;o&gt;de</code></p>"),
    ("two\nlines  \n\nnext & <b> \"q\"", "<p>two lines</p>\n<p>next &amp; &lt;b&gt; &quot;q&quot;</p>"),
    ("a*b*c 2*3 **x*y** *open", "<p>a*b*c 2*3 **x*y** *open</p>"),
    ("h$_{t}$ $h_{t}$ $x_i^2$ $ab$ $\\frac{a}{b}$ $$no$$ 5$", '<p>h<sub>t</sub> <em>h</em><sub>t</sub> <em>x</em><sub>i</sub><sup>2</sup> <em>ab</em> <code class="tex">\\frac{a}{b}</code> $$no$$ 5$</p>'),
    ("$a_b * c$ *x* $d * e_f$", '<p><code class="tex">a_b * c</code> <em>x</em> <code class="tex">d * e_f</code></p>'),
    ("[l & $x_1$](http://a?b=\"c) [![i](p.png)](u) `$y$ <`", '<p><a href="http://a?b=&quot;c">l &amp; <em>x</em><sub>1</sub></a> <a href="u"><img src="p.png" alt="i"/></a> <code><em>y</em> &lt;</code></p>'),
    ("![a \"b\"](./x/y.png) in text", '<p><img src="x/y.png" alt="a &quot;b&quot;"/> in text</p>'),
    ("![alone](x.png)  \n![two](y.png) z", '<figure><img src="x.png" alt="alone"/></figure>\n<p><img src="y.png" alt="two"/> z</p>'),
    ("# One *e*\n####### seven\n#none\n### three", "<h1>One <em>e</em></h1>\n<p>####### seven #none</p>\n<h3>three</h3>"),
    ("- a\n* b *c*\n  - d\ntext\n- e", "<ul><li>a</li><li>b <em>c</em></li><li>d</li></ul>\n<p>text</p>\n<ul><li>e</li></ul>"),
    ("| a | b |\n|---|:-:|\n| 1 | *2* |\n| 3 |\nend", "<table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td><td><em>2</em></td></tr><tr><td>3</td></tr></tbody></table>\n<p>end</p>"),
    ("| no\n| a |\n| - |\n| x | y |\n\n| z", "<p>| no</p>\n<table><thead><tr><th>a</th></tr></thead><tbody><tr><td>x</td><td>y</td></tr></tbody></table>\n<p>| z</p>"),
    ("t\n```py\n # h\n\n$$ <x>\n > q\n```\nu", "<p>t</p>\n<pre><code> # h\n\n$$ &lt;x&gt;\n &gt; q</code></pre>\n<p>u</p>"),
    ("```\n```\n  ```\nopen\n", "<pre><code></code></pre>\n<pre><code>open\n</code></pre>"),
    ("$$a$$\n$$\nb\n c $$\n$$$$\n$$open\n\n- x", "D<a>\nD<\nb\nc >\nD<>\nD<open\n\n- x>"),
    ("> q *e*\n>> deep\n> > - x\n>\n> end\nout", "<blockquote><p>q <em>e</em></p>\n<blockquote><p>deep</p>\n<ul><li>x</li></ul></blockquote>\n<p>end</p></blockquote>\n<p>out</p>"),
    ("> [!NOTE]+ Look *here*\n> body\n> ```\n> > code\n> ```", '<aside class="callout callout-note"><p class="callout-title">Look <em>here</em></p><p>body</p>\n<pre><code>&gt; code</code></pre></aside>'),
    ("> [!tip]", '<aside class="callout callout-tip"><p class="callout-title">tip</p></aside>'),
    (">", "<blockquote></blockquote>"),
    ("> [!warning]- x\n> ![f](images/formula-3.png)", '<aside class="callout callout-warning"><p class="callout-title">x</p><figure><img src="images/formula-3.png" alt="f"/></figure></aside>'),
    ("﷐ ﷑ $x$", "<p>� � <em>x</em></p>"),
    (" \n\n", None),
]


def body_html(spark, texts):
    d = spark.createDataFrame([(k, [1], t) for k, t in enumerate(texts)], "doc_id long, path array<int>, body string")
    b = xhtml.blocks(d).withColumn("crop_id", F.lit(None).cast("string"))
    return {r.doc_id: r.html for r in xhtml.rendered(b).collect()}


def test_blocks_and_inline_text(spark):
    mark = '<aside class="callout callout-warning math-unrendered"><p class="callout-title">Formula could not be rendered</p><p><code class="tex">'
    found = body_html(spark, [t for t, _ in CASES])
    for k, (text, html) in enumerate(CASES):
        got = found.get(k)
        if html and "D<" in html:  # a displayed formula's TeX, stripped
            got = got.replace(mark, "D<").replace("</code></p></aside>", ">")
            html = html.replace("D<\nb\nc >", "D<b\nc>")
        assert got == html, text


def test_long_bodies_take_time_in_proportion(spark):
    quotes = "\n".join("> " * (1 + k % 3) + "x" for k in range(3000))
    began = time.perf_counter()
    found = body_html(spark, ["a < *b* `c`\n" * 20_000, "```\n" + "x\n" * 50_000, "$$\n" * 3 + "y\n" * 50_000, quotes, "*" * 30_000, "[" * 20_000, "$" * 20_001])
    assert len(found) == 7 and found[0].startswith("<p>a &lt; <em>b</em>") and found[1].count("x") == 50_000
    assert time.perf_counter() - began < 60


NOTE = """---
title: "Book"
title: "Book & more"
source: "a.pdf"
author:
  - "A B"
  - " "
---
intro $z$

$$x = 1$$

> [!warning]- This formula may be incomplete
> ![formula-1](images/formula-1.png)

> $$x  = 1$$
> ![in](images/in.png)

## Two $z$
$$y$$
![fig](./images/figure-1.png)
"""


@pytest.fixture(scope="module")
def book(spark):
    notes = spark.createDataFrame([(1, "fallback", NOTE, 5), (2, "plain", "$$y$$\n> [!warning]- This formula may be incomplete\n> ![formula-1](images/formula-1.png)", 5), (3, "none", None, 5), (4, None, "", 5)], "doc_id long, title string, markdown string, crop_id int")
    sidecar = spark.createDataFrame([(1, 1, "x=1", "formula-1"), (1, 2, "x = 1", "formula-2"), (1, 3, "other", "formula-3"), (1, 4, "y", "formula-4")], "doc_id long, ordinal int, tex string, id string")
    return epub.Book(notes, sidecar)


def test_formulas_are_keyed_by_place_and_by_tex(book):
    assert sorted((r.doc_id, r.ordinal, r.crop_id) for r in book.formulas.collect()) == [(1, 1, "formula-1"), (1, 2, "formula-2"), (1, 3, None), (2, 1, None)]
    assert [(r.doc_id, r["index"], r.tex, r.xhtml) for r in book.inline.collect()] == [(1, 1, "z", "<em>z</em>")]
    html = {(r.doc_id, r.chapter_no): r.html for r in book.html.collect()}
    assert sorted(html) == [(1, 1), (1, 2), (2, 1)]
    # a callout that only offers a crop goes where the document has crops
    assert "may be incomplete" not in html[1, 1] and "may be incomplete" in html[2, 1]
    assert '<blockquote><div class="math-display"><img src="images/formula-2.png" alt="x  = 1"/></div>\n<figure>' in html[1, 1]


def test_stats_and_containers(spark, book):
    files = spark.createDataFrame([(1, "images/figure-1.png", b"png"), (1, "images/formula-1.png", b"f1"), (1, "images/formula-2.png", b"f2"), (9, "images/in.png", b"of another")], "doc_id long, href string, content binary")
    said = "could not be rendered and were exported as LaTeX source — no formula image was available. Converted papers get one by re-converting the PDF."
    assert sorted(tuple(r) for r in book.stats(files).collect()) == [
        (1, 2, 1, 2, 1, 1, [f"1 equation {said}", "missing image: images/in.png"]),
        (2, 1, 0, 0, 1, 0, [f"1 equation {said}", "missing image: images/formula-1.png"]),
        (3, 0, 0, 0, 0, 0, []),
        (4, 0, 0, 0, 0, 0, []),
    ]
    made = {r.doc_id: bytes(r.epub) for r in book.epubs(files).collect()}
    assert made == {r.doc_id: bytes(r.epub) for r in book.epubs(files).collect()} and len(made) == 4
    assert made[1][8:10] == b"\0\0" and made[1][30:58] == b"mimetypeapplication/epub+zip"
    z = zipfile.ZipFile(io.BytesIO(made[1]))
    assert z.namelist() == ["mimetype", "META-INF/container.xml", "OEBPS/ch001.xhtml", "OEBPS/ch002.xhtml", "OEBPS/style.css", "OEBPS/images/figure-1.png", "OEBPS/images/formula-1.png", "OEBPS/images/formula-2.png", "OEBPS/nav.xhtml", "OEBPS/package.opf"]
    package = z.read("OEBPS/package.opf").decode()
    assert "<dc:title>Book &amp; more</dc:title>" in package and package.count("<dc:creator>") == 1 and "<dc:source>a.pdf</dc:source>" in package
    assert 'id="math-images-formula-2-png" href="images/formula-2.png" media-type="image/png"' in package and "in.png" not in package
    assert z.read("OEBPS/images/figure-1.png") == b"png"


def plain_uuid(seed):
    units = memoryview(seed.encode("utf-16-le", "surrogatepass")).cast("H")
    full = 0xFFFFFFFF
    a, b = (0x9E3779B9 ^ len(units)) & full, 0x85EBCA6B
    for u in units:
        a, b = (a ^ u) * 2654435761 & full, (b ^ u) * 1597334677 & full
    x = f"{a:08x}{b:08x}{a ^ b:08x}{(a + b) & full:08x}"
    return f"{x[:8]}-{x[8:12]}-4{x[13:16]}-a{x[17:20]}-{x[20:]}"


def test_uuids_fold_over_utf16_units(spark):
    seeds = ["", "x", "añ", "😀 a", "漢" * 500, "z" * 5000]
    d = spark.createDataFrame([(s,) for s in [*seeds, None]], "s string").select("s", epub.uuids(F.col("s")).alias("u"))
    assert {r.s: r.u for r in d.collect()} == {s: plain_uuid(s or "") for s in [*seeds, None]}


def test_assets_are_read_only_where_wanted(spark, tmp_path):
    for name in ("p/images/a.png", "p/images/b[1] ü.png", "q/images/a.png", "secret.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    wanted = spark.createDataFrame([(1, "p", "images/a.png"), (1, "p", "images/b[1] ü.png"), (1, "p", "images/gone.png"), (2, "q", "images/a.png"), (2, "q", "../secret.png"), (3, None, "secret.png")], "doc_id long, folder string, href string")
    for size in (10_000, 1):
        got = sorted((r.doc_id, r.href, bytes(r.content).decode()) for r in readers.asset_bytes(spark, str(tmp_path), wanted, size).collect())
        assert got == [(1, "images/a.png", "p/images/a.png"), (1, "images/b[1] ü.png", "p/images/b[1] ü.png"), (2, "images/a.png", "q/images/a.png"), (3, "secret.png", "secret.png")]
    names = readers.asset_names(spark, str(tmp_path))
    assert "content" not in names._jdf.queryExecution().executedPlan().toString()
    assert readers.asset_bytes(spark, str(tmp_path), wanted.where("href LIKE '%gone%'")).collect() == []


def test_of_repeated_keys_the_last_counts(spark):
    from quillspark.functions.text import front_fields

    d = spark.createDataFrame([('---\na: 1\nb:\n  - x\na: "2"\nb:\n  - y\n  - z\n---\ntext',), ("no",), (None,)], "md string")
    got = [[(f.key, f.value, list(f["items"])) for f in r.f] if r.f is not None else None for r in d.select(front_fields(F.col("md")).alias("f")).collect()]
    assert got[0] == [("a", "2", []), ("b", None, ["y", "z"])] and got[1] == []
