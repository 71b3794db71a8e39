"""Every query with SQL against DuckDB on the smallest tables, and vectors for what SQL can't say."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark.functions import formulas, text, titles
from quillspark.operators import assemble, checks, doctags, epub, guard, packages, textlayer
from quillspark.plans import registry
from quillspark.sources import readers

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cur = duck.execute(registry.ORACLE[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*sorted(names)).collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_rows(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0


def one(spark, column, **values):
    d = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return d.select(column).first()[0]


@pytest.mark.parametrize(
    ("tex", "want"),
    [("a_{b", "a_{b}"), ("a}b", "{a}b"), (r"x & & ( 3 )", r"x \tag{3}"), (r"a \\ b", r"\begin{aligned}a \\ b\end{aligned}"), (r"\{ a", r"\{ a"), ("  y ", "y"), (r"\begin{m}a&b\end{m}", r"\begin{m}a&b\end{m}")],
)
def test_fix(spark, tex, want):
    assert one(spark, formulas.fix(F.col("t")), t=tex) == want


@pytest.mark.parametrize(("md", "want"), [("$$a_{$$", "$$a_{}$$"), ("$$$$", "$$$$"), ("a $$ b", "a $$ b"), ("$$x{$$ y $$z{$$ $$", "$$x{}$$ y $$z{}$$ $$"), ("$$$a{$$", "$$$a{}$$"), ("", "")])
def test_clean(spark, md, want):
    assert one(spark, formulas.clean(F.col("m")), m=md) == want


@pytest.mark.parametrize(("tex", "want"), [("_{t}", "<sub>t</sub>"), ("h_{t}", "<em>h</em><sub>t</sub>"), ("x_i^2", "<em>x</em><sub>i</sub><sup>2</sup>"), ("x_i_j", None), (r"\alpha", None), ("d", "<em>d</em>"), ("toolong", None)])
def test_trivial(spark, tex, want):
    assert one(spark, formulas.trivial_xhtml(F.col("t")), t=tex) == want


@pytest.mark.parametrize(("t", "bad"), [("1 Introduction", True), ("4K Video of Northern Birds", False), ("12 Ways of Folding a Paper Crane", False), ("Related Work:", True), ("Backpropagation", False)])
def test_section(spark, t, bad):
    assert one(spark, titles.section_like(F.col("t")), t=t) is bad


@pytest.mark.parametrize("t", ["ms.docx", "Untitled", "abc", "scan_01", "Microsoft Word - x", "Abstract"])
def test_bad_metadata(spark, t):
    assert one(spark, titles.from_metadata(F.col("t")), t=t) is None


def blocks(source):
    return [(b["cls"], b["raw"].strip(), b["caption"], b["grid"]) for b in doctags.page_blocks(source)]


def test_blocks():
    assert blocks("<text>a<text>b</text>c</text><x>y") == [("text", "abc", None, None), ("x", "y", None, None)]
    assert blocks("<text>never closed <b>x</b>") == [("text", "never closed x", None, None)]
    assert blocks("<picture></picture> <caption> </caption><caption>z</caption>") == [("picture", "", None, None), ("caption", "z", None, None)]
    assert blocks("stray </text> text") == []
    assert doctags.page_blocks("<text><loc_1><loc_2>x</text>")[0]["bbox"] is None
    assert doctags.page_blocks("<otsl><fcel>a<nl><nl><lcel><fcel>b</otsl>")[0]["grid"] == [["a"], ["", "b"]]
    assert doctags.page_blocks(None) == []


def test_guard(spark):
    for a, want in (([1, 2, 1, 2, 1, 2], True), ([1, 2, 1, 2, 2, 1], False), ([5, 5, 5], True), ([5, 5], False), (list(range(16)) * 3, True), (list(range(17)) * 3, False)):
        assert one(spark, guard.short_cycle(F.array(*[F.lit(x) for x in a]))) is want


def test_epub():
    assert epub.container("t", [("a", "<p>b</p>")]) == epub.container("t", [("a", "<p>b</p>")])


def test_checks(spark):
    assert one(spark, checks.math_blocks(F.col("m")), m="$$a$$ $$") == 1
    assert one(spark, checks.headings(F.col("m")), m="# a\n## b\n#c") == 2


def test_text(spark):
    assert one(spark, text.utf16_length(F.col("t")), t="\U0001f600a") == 3
    assert one(spark, text.collapse(F.col("t")), t=" a ﻿ b\n") == "a b"
    assert one(spark, text.published(F.col("t")), t="x") is None


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "a.md").write_text("# x\n")
    (tmp_path / "a" / "meta.json").write_text('{"title": "T", "pages": 3}')
    (tmp_path / "b.pdf").write_bytes(b"12")
    assert [r.markdown for r in readers.notes(spark, str(tmp_path)).collect()] == ["# x\n"]
    assert readers.sidecars(spark, str(tmp_path)).first().meta.pages == 3
    pages = readers.pdf_pages(spark, str(tmp_path), lambda data: ({"page": k + 1} for k in range(len(data))), "page int")
    assert pages.count() == 2


def test_devices(spark):
    of = lambda *x: spark.range(1).select(readers.device_candidates(F.lit(x[0]), F.lit(x[1]), F.array(*map(F.lit, x[2])).cast("array<string>")).alias("d")).first().d
    assert of("auto", True, ["npu", "gpu"]) == ["webgpu", "wasm"] and of("auto", False, []) == ["wasm"]
    assert of("webnn", True, ["gpu", "npu"]) == ["webnn-npu", "webnn-gpu", "webgpu", "wasm"] and of("webnn", False, ["cpu"]) == ["wasm"]
    assert of("wasm", True, ["npu"]) == ["wasm"] and of("webgpu", False, ["npu"]) == ["wasm"]


def test_packages(spark, tmp_path):
    notes = spark.createDataFrame([(1, "s.pdf", "T", "p/a", "a", "# x", 2, 0, None)], "doc_id long, source string, title string, out_dir string, stem string, markdown string, pages int, images int, warnings array<string>")
    rows = packages.files(packages.meta(notes, "e", "1", "m"), spark.createDataFrame([(1, "f", b"x"), (1, "g", None)], "doc_id long, id string, png binary"))
    wrote = {r.path: r.size for r in packages.write(rows, str(tmp_path)).collect()}
    assert set(wrote) == {"p/a/a.md", "p/a/meta.json", "p/a/images/f.png"} and (tmp_path / "p/a/a.md").read_text() == "# x"
    m = readers.sidecars(spark, str(tmp_path)).first().meta
    assert (m.title, m.pages, m.warnings, m.formulas, m.options.ocr) == ("T", 2, [], None, False)
    assert [r.markdown for r in readers.notes(spark, str(tmp_path)).collect()] == ["# x"]
    listing = spark.createDataFrame([(p,) for p in [*wrote, "q/q.md", "r/meta.json", "meta.json", None]], "path string")
    assert [r.folder for r in packages.package_folders(listing).collect()] == ["p/a"]
    d = packages.destinations(spark.createDataFrame([("p/a/z.pdf", "New"), ("q/z.pdf", None), ("z.pdf", "A: b")], "path string, title string"), listing)
    assert {(r.path, r.folder, r.stem) for r in d.collect()} == {("p/a/z.pdf", "p/a", "a"), ("q/z.pdf", "q/z", "z"), ("z.pdf", "A- b", "A- b")}
    assert packages.files(packages.meta(notes.limit(0), "e", "1", "m")).count() == 0


def test_annotate(spark):
    found = F.from_json(F.lit('[{"id": "formula-1", "suspect": true}, {"id": "formula-2", "suspect": null}]'), "array<struct<id:string,suspect:boolean>>")
    notice = "> [!warning]- This formula may be incomplete — show the original from the PDF\n> ![formula-1](images/formula-1.png)"
    assert one(spark, assemble.annotate(F.col("m"), found), m="$$a$$ $$b$$ $$c$$") == f"$$a$$\n\n{notice} $$b$$ $$c$$"
    assert one(spark, assemble.annotate(F.col("m"), found), m="none") == "none" and one(spark, assemble.annotate(F.col("m"), F.lit(None).cast("array<struct<id:string,suspect:boolean>>")), m="$$a$$") == "$$a$$"


def test_front_fields(spark):
    md = '---\ntitle: "a \\"b\\""\nauthor:\n  - "x"\n  - y\nempty:\nstray\n---\nkey: no\n'
    assert [tuple(r) for r in one(spark, text.front_fields(F.col("m")), m=md)] == [("title", 'a \\"b\\"', []), ("author", None, ["x", "y"]), ("empty", None, [])]
    assert one(spark, text.front_fields(F.col("m")), m="no") == []


def test_bar_creeps(spark):
    d = spark.createDataFrame([("a", 0.0, 0, 0.0, None, 0), ("a", 1.0, 0, 0.0, -59_999.0, 2), ("a", 2.0, 0, 0.0, -119_998.0, 2), ("a", 3.0, 1, 9000.0, None, 2), ("a", 4.0, 1, 9000.0, None, 4)], "doc_id string, at_ms double, pages_done int, spent_ms double, page_started_ms double, page_count int")
    got = [(round(r.fraction, 4), r.left_s) for r in guard.bar(d).orderBy("at_ms").collect()]
    assert got == [(0.0, None), (0.4, None), (0.4632, None), (0.5, 9), (0.5, 27)]


def test_infer_and_replay(spark):
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, page int")
    model = lambda: lambda r: {**r, "doc_tags": "<text>x</text>", "truncated": None, "gen_tokens": 3, "prompt_tokens": 4, "ms": 5}
    made = readers.infer(pages, model, 2)
    assert sorted(r.page for r in readers.replay(made).collect()) == [1, 2]


def test_checks_passed(spark):
    d = spark.createDataFrame([(1, "a", True), (1, "b", False), (2, "a", True)], "doc_id long, name string, ok boolean")
    assert {tuple(r) for r in checks.passed(d).collect()} == {(1, False, 1), (2, True, 0)}
