"""Packages are committed whole, and again over older ones."""

import os

import pytest

from quillspark.operators import packages


def rows(spark, *files):
    return spark.createDataFrame([(p, c) for p, c in files], "path string, content binary")


def tree(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, dirs, fs in os.walk(root) for f in fs if not os.path.relpath(d, root).startswith(".")}


def test_commit_and_commit_again(spark, tmp_path):
    root = str(tmp_path)
    first = rows(spark, ("o/a/a.md", b"1"), ("o/a/meta.json", b"{}"), ("o/a/images/f 1.png", b"png"), ("o/b/b.md", b"2"), ("o/b/meta.json", None))
    assert sorted(tuple(r) for r in packages.commit(first, root).collect()) == [("o/a", 3, 6, False), ("o/b", 2, 1, False)]
    assert tree(root) == {"o/a/a.md": b"1", "o/a/meta.json": b"{}", "o/a/images/f 1.png": b"png", "o/b/b.md": b"2", "o/b/meta.json": b""}
    again = rows(spark, ("o/a/a.md", b"new"), ("o/a/meta.json", b"{1}"), ("o/c/c.md", b"3"), ("o/c/meta.json", b"{}"))
    assert sorted(tuple(r) for r in packages.commit(again, root).collect()) == [("o/a", 2, 6, True), ("o/c", 2, 3, False)]
    # what the new package lacks stays
    assert tree(root) == {"o/a/a.md": b"new", "o/a/meta.json": b"{1}", "o/a/images/f 1.png": b"png", "o/b/b.md": b"2", "o/b/meta.json": b"", "o/c/c.md": b"3", "o/c/meta.json": b"{}"}
    assert not [f for f in os.listdir(root) if f.startswith(".staging")]
    assert packages.commit(rows(spark, ("x/y.md", b"")).limit(0), root).collect() == []


def test_a_failed_run_leaves_no_half_package(spark, tmp_path):
    from pyspark.sql import functions as F

    root = str(tmp_path)
    broken = rows(spark, ("o/a/a.md", b"1"), ("o/a/meta.json", b"{}")).withColumn("content", F.when(F.col("path").endswith("json"), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        packages.commit(broken, root)
    assert tree(root) == {}


def test_moves(spark):
    d = spark.createDataFrame([("in/a.pdf", "o/a"), ("in/b.pdf", "o/b"), ("o/c/c.pdf", "o/c"), ("x/d.pdf", "o/d"), ("y/d.pdf", "o/d"), ("e.pdf", "")], "path string, folder string")
    listing = spark.createDataFrame([("o/b/b.pdf",), ("o/b/b.pdf",)], "path string")
    assert sorted(tuple(r) for r in packages.moves(d, listing).collect()) == [
        ("e.pdf", "", None, None),
        ("in/a.pdf", "o/a", "o/a/a.pdf", None),
        ("in/b.pdf", "o/b", None, "Left b.pdf where it was — o/b already holds a file of that name."),
        ("o/c/c.pdf", "o/c", None, None),
        ("x/d.pdf", "o/d", "o/d/d.pdf", None),
        ("y/d.pdf", "o/d", None, "Left d.pdf where it was — o/d already holds a file of that name."),
    ]


def test_a_cancelled_run_leaves_no_package(spark, tmp_path):
    import threading
    import time

    from pyspark.sql import functions as F

    from quillspark.streaming import runs

    @F.udf("binary")
    def slow(x):
        time.sleep(30)
        return x

    root, said = str(tmp_path), []

    def work():
        with runs.cancellable(spark, "convert"):
            try:
                packages.commit(rows(spark, ("o/a/a.md", b"1"), ("o/a/meta.json", b"{}")).withColumn("content", slow("content")), root)
            except Exception as e:  # noqa: BLE001
                said.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    began = time.perf_counter()
    while t.is_alive() and time.perf_counter() - began < 25:
        time.sleep(0.5)
        runs.cancel(spark, "convert")
    t.join(1)
    assert said and time.perf_counter() - began < 25
    assert tree(root) == {}


def test_devices(spark):
    from quillspark.sources import readers

    def load(device):
        raise ValueError(f"{device} is busy")

    pages = spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int")
    got = readers.infer_on(pages, ["a", "b"], load, "m").collect()
    assert {(r.page, r.device, r.doc_tags, tuple(r.failures)) for r in got} == {(k, None, None, ("no usable compute backend for m. Tried 2: a: a is busy | b: b is busy",)) for k in (1, 2)}
