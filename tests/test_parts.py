"""What books shuffle: notes once, not their lines."""

import io
import re
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import epub, xhtml


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_chapters_and_images_are_cut_in_their_row(spark):
    cases = {1: "---\na: b\n---\n\n \n## One\nx\n#\n# Two \n\n### small\n# Three", 2: "intro\n#no\n# A", 3: " \n\n", 4: "# X\n## Y\n\n", 5: "", 6: None, 7: "\n\n# Z"}
    notes = spark.createDataFrame(list(cases.items()), "doc_id long, markdown string")
    d = epub.chapters(notes)
    assert not re.search("Exchange|Sort|Window", plan(d))
    assert sorted(tuple(r) for r in d.collect()) == [
        (1, 1, "One", 5, "\n \n## One\nx\n#"), (1, 2, "Two ", 3, "# Two \n\n### small"), (1, 3, "Three", 1, "# Three"),
        (2, 1, None, 2, "intro\n#no"), (2, 2, "A", 1, "# A"), (4, 1, "X", 1, "# X"), (4, 2, "Y", 3, "## Y\n\n"), (7, 1, "Z", 3, "\n\n# Z"),
    ]
    shown = epub.assets(notes.select("doc_id", F.lit("![](b.png) ![](a.jpg)\n![](b.png)").alias("markdown")).where("doc_id = 1"))
    assert not re.search("Exchange|Sort|Window", plan(shown))
    assert [(r.seq, r.href) for r in shown.collect()] == [(1, "b.png"), (2, "a.jpg")]


def test_lines_and_blocks_of_books_stay_in_their_part(spark):
    notes = spark.createDataFrame([(1, "t", "a $x$\n\n$$y$$\n> b\n> > c")], "doc_id long, title string, markdown string")
    sidecar = spark.createDataFrame([(1, 1, "y", "formula-1")], "doc_id long, ordinal int, tex string, id string")
    book = epub.Book(notes, sidecar)
    for d in (book.html, book.formulas, book.inline, book.assets):
        dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(d))
        assert dealt and all(re.fullmatch(r"doc_id#\d+L, \d+", x) for x in dealt), dealt


QUOTED = "a $x$ ![](p.png)\n\n$$y$$\n> b ![](q.png)\n> > $$z$$\n\n\n$$y$$\n## C"


def quoted(spark):
    notes = spark.createDataFrame([(1, "t", QUOTED), (2, "t", "plain"), (3, "t", None)], "doc_id long, title string, markdown string")
    sidecar = spark.createDataFrame([(1, 2, " z", "formula-2"), (1, 3, "x", "formula-3")], "doc_id long, ordinal int, tex string, id string")
    return epub.Book(notes, sidecar)


def test_assets_come_from_the_note_s_row(spark):
    book = quoted(spark)
    for d in (book.assets, book.formulas, book.inline):
        # one cut for each level of quotes, and no window, union or group of lines or blocks
        assert d._jdf.queryExecution().optimizedPlan().toString().count("(?dm)^(?:[") == 3
        assert not re.search("Window|Union", plan(d)) and plan(d).count("Exchange hashpartitioning") == 2
    assert sorted(tuple(r) for r in book.assets.select("seq", "href", "crop").collect()) == [(1, "p.png", False), (2, "q.png", False), (3, "images/formula-2.png", True)]
    assert [tuple(r) for r in book.formulas.orderBy("ordinal").collect()] == [(1, 1, [1, 3], "y", None), (1, 2, [1, 4, 2, 1], "z", "formula-2"), (1, 3, [1, 6], "y", None)]


def test_stats_come_from_the_note_s_row(spark):
    files = spark.createDataFrame([(1, "q.png"), (1, "q.png"), (1, "images/formula-2.png"), (2, "q.png"), (9, "p.png")], "doc_id long, href string")
    d = quoted(spark).stats(files)
    # notes, crops and files are dealt out once each, and nothing is counted in rows of their own
    assert plan(d).count("Exchange hashpartitioning") == 3 and not re.search("Window|Union|Generate", plan(d))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("(?dm)^(?:[") == 3
    assert sorted(tuple(r)[:6] for r in d.collect()) == [(1, 2, 1, 1, 2, 1), (2, 1, 0, 0, 0, 0), (3, 0, 0, 0, 0, 0)]
    assert [r.warnings[1:] for r in d.where("doc_id = 1").collect()] == [["missing image: p.png"]]


def test_books_are_packed_from_the_note_s_row(spark):
    files = spark.createDataFrame([(1, "q.png", b"q"), (1, "images/formula-2.png", b"z"), (1, "other.png", b"o"), (9, "p.png", b"p")], "doc_id long, href string, content binary")
    d = quoted(spark).epubs(files)
    # files are chosen by what a note's text names, so its blocks are cut once, for chapters and images alike
    assert d._jdf.queryExecution().optimizedPlan().toString().count("(?dm)^(?:[") == 3 and not re.search("Window", plan(d))
    found = {r.doc_id: zipfile.ZipFile(io.BytesIO(bytes(r.epub))) for r in d.collect()}
    assert sorted(found) == [1, 2, 3] and [x for x in found[1].namelist() if x.endswith("png")] == ["OEBPS/q.png", "OEBPS/images/formula-2.png"]
    assert 'id="math-images-formula-2-png"' in found[1].read("OEBPS/package.opf").decode() and found[1].read("OEBPS/q.png") == b"q"


def test_runs_of_blank_lines_and_lines_that_only_look_like_a_kind(spark):
    body = "a\n\n\n\n#\nb\n# h\r\n| x\n| y |\n| - |\n- i\r\n  \n\t\n>q\n"
    b = xhtml.blocks(spark.createDataFrame([(1, [1], body)], "doc_id long, path array<int>, body string"))
    assert [(x.kind, x.path) for x in b.first().blocks] == [("chapter", [1]), ("text", [1, 1]), ("text", [1, 3]), ("table", [1, 4]), ("text", [1, 5]), ("open", [1, 7]), ("text", [1, 7, 1]), ("close", [1, 7])]
