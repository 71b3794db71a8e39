"""Packages of converted documents: ``<folder>/<stem>.md``, ``images/`` and ``meta.json``, as rows and as files."""

from __future__ import annotations

import contextlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import package_name, utf16_length


def meta(notes: DataFrame, engine: str, version: str, model: str) -> DataFrame:
    """``notes`` with ``meta``, the text of their ``meta.json``.

    ``notes(doc_id, source, title, out_dir, stem, markdown, pages, images, warnings)``, and where there are such columns
    ``formulas`` (array of id, tex, page, suspect), ``formula_options`` and ``ocr`` (booleans; true and false), ``load_ms``,
    ``inference_ms``, ``assemble_ms``, ``wall_ms`` and ``providers``. Null warnings are none; formulas that aren't suspect
    don't say so, and a note without formulas has no such field.
    """
    has = lambda name, other: F.col(name) if name in notes.columns else other
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    formulas = F.lit(None)
    if "formulas" in notes.columns:
        listed = F.transform("formulas", lambda f: F.struct(f["id"].alias("id"), f["tex"].alias("tex"), f["page"].alias("page"), F.when(f["suspect"], True).alias("suspect")))
        formulas = F.when(F.size("formulas") > 0, listed)
    fields = {
        "source": F.col("source"),
        "title": F.col("title"),
        "out_dir": F.col("out_dir"),
        "md_path": F.concat("out_dir", F.lit("/"), "stem", F.lit(".md")),
        "engine": F.lit(engine),
        "engine_version": F.lit(version),
        "model": F.lit(model),
        "options": F.struct(has("formula_options", F.lit(True)).alias("formulas"), has("ocr", F.lit(False)).alias("ocr")),
        "pages": F.col("pages"),
        "images": F.col("images"),
        "formulas": formulas,
        "markdown_chars": utf16_length(F.col("markdown")),
        "timings_ms": F.struct(has("load_ms", zero).alias("load"), has("inference_ms", zero).alias("inference"), has("assemble_ms", zero).alias("assemble")),
        "wall_ms": has("wall_ms", zero),
        "execution_providers": has("providers", none),
        "warnings": F.coalesce("warnings", none),
    }
    if "formulas" not in notes.columns:
        del fields["formulas"]
    return notes.withColumn("meta", F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "true", "pretty": "true"}))


def files(notes: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(path, content) of the packages of ``notes(doc_id, out_dir, stem, markdown, meta)`` and of ``images(doc_id, id, png)``; images without bytes are left out."""
    path = lambda *x: F.concat_ws("/", "out_dir", *x)
    rows = F.array(F.struct(path(F.concat("stem", F.lit(".md"))).alias("path"), F.col("markdown").cast("binary").alias("content")), F.struct(path(F.lit("meta.json")).alias("path"), F.col("meta").cast("binary").alias("content")))
    out = notes.select(F.inline(rows))
    if images is None:
        return out
    shown = images.where("png IS NOT NULL").join(notes.select("doc_id", "out_dir"), "doc_id")
    return out.unionByName(shown.select(path(F.lit("images"), F.concat("id", F.lit(".png"))).alias("path"), F.col("png").alias("content")))


def write(rows: DataFrame, root: str) -> DataFrame:
    """Writes ``rows(path, content)`` below ``root`` (a folder or a URI that pyarrow knows) when acted on, and gives (path, size). A task that runs again writes the same files."""

    def run(batches):
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(content or b"")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["path", "size"])

    return rows.select("path", "content").mapInArrow(run, "path string, size long")


def _system(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def stage(rows: DataFrame, root: str, staging: str) -> DataFrame:
    """Writes ``rows(path, content)`` below ``root/staging`` when acted on: (folder, name, staged, size).

    ``folder`` is the package, the path up to its note or ``images/``. Every attempt of a task writes files of its own, so nothing
    that a reader of packages looks at is touched.
    """

    def run(batches):
        system, base = _system(root)
        for batch in batches:
            staged, sizes = [], []
            for content in batch.column(1).to_pylist():
                name = uuid.uuid4().hex
                at = f"{staging}/files/{name[:2]}"
                system.create_dir(f"{base}/{at}", recursive=True)
                with system.open_output_stream(f"{base}/{at}/{name}") as out:
                    out.write(content or b"")
                staged.append(f"{at}/{name}")
                sizes.append(len(content or b""))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(staged, pa.string()), pa.array(sizes, pa.int64())], names=["path", "staged", "size"])

    d = rows.select("path", "content").mapInArrow(run, "path string, staged string, size long")
    folder = F.regexp_extract("path", "^(.*?)(?:/images)?/[^/]*$", 1)
    return d.select(folder.alias("folder"), F.substr("path", F.char_length(folder) + 2).alias("name"), "staged", "size")


def commit(rows: DataFrame, root: str) -> DataFrame:
    """Writes the packages of ``rows(path, content)`` below ``root``, each whole or not at all: (folder, files, size, replaced).

    First all files are staged; the list of what successful tasks have staged is a table, which Spark commits. Then each package is
    put together beside the others and renamed to its place in one step. Where there is a package already, its files are replaced
    one by one, the sidecar last, and files that the new one lacks stay. Each step can be done again: a lost task leaves no half
    package, and what is already in its place is left there. Runs when called; the staging folder goes at the end.
    """
    staging = f".staging-{uuid.uuid4().hex}"
    listed, done = f"{root}/{staging}/list", f"{root}/{staging}/done"
    try:
        return _commit(rows, root, staging, listed, done)
    finally:
        # also of a run that failed or was cancelled; tasks that still end may leave a file, which nothing reads
        system, base = _system(root)
        with contextlib.suppress(OSError):
            system.delete_dir(f"{base}/{staging}")


def _commit(rows: DataFrame, root: str, staging: str, listed: str, done: str) -> DataFrame:
    spark = rows.sparkSession
    stage(rows, root, staging).write.parquet(listed)
    files = F.transform(F.array_sort(F.collect_list(F.struct((F.col("name") == "meta.json").alias("last"), "name", "staged", "size"))), lambda x: F.struct(x["name"].alias("name"), x["staged"].alias("staged"), x["size"].alias("size")))
    wanted = spark.read.parquet(listed).groupBy("folder").agg(files.alias("files"))

    def run(batches):
        from pyarrow import fs

        system, base = _system(root)
        there = lambda path: system.get_file_info(path).type != fs.FileType.NotFound
        for batch in batches:
            out = []
            for folder, files in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                final, fresh = f"{base}/{folder}", f"{base}/{staging}/new/{folder}"
                for f in files:
                    if there(f"{base}/{f['staged']}"):
                        system.create_dir(f"{fresh}/{f['name']}".rpartition("/")[0], recursive=True)
                        system.move(f"{base}/{f['staged']}", f"{fresh}/{f['name']}")
                replaced = there(final)
                if not replaced and there(fresh):
                    system.create_dir(final.rpartition("/")[0], recursive=True)
                    system.move(fresh, final)
                for f in files if replaced else ():
                    if there(f"{fresh}/{f['name']}"):
                        system.create_dir(f"{final}/{f['name']}".rpartition("/")[0], recursive=True)
                        system.move(f"{fresh}/{f['name']}", f"{final}/{f['name']}")
                if gone := [f["name"] for f in files if not there(f"{final}/{f['name']}")]:
                    raise FileNotFoundError(f"{folder} lacks {gone[:3]}")
                out.append((folder, len(files), sum(f["size"] for f in files), replaced))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.bool_()), strict=True)] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.bool_())], names=["folder", "files", "size", "replaced"])

    schema = "folder string, files long, size long, replaced boolean"
    wanted.mapInArrow(run, schema).write.parquet(done)
    out = spark.read.schema(schema).parquet(done)
    # the summary has a row for each package; it outlives the staging folder as a table of its own
    kept = f"{root}/.committed-{uuid.uuid4().hex}"
    out.write.parquet(kept)
    return spark.read.schema(schema).parquet(kept)


def moves(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """``sources(path, folder)`` with the ``target`` in their package and the ``warning`` if they can't be moved there.

    A source that lies in its package has neither. A target that ``listing(path)`` has already is left alone, and of sources of one
    target the first path gets it.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    target = F.when(F.col("folder") == "", name).otherwise(F.concat("folder", F.lit("/"), name))
    d = sources.withColumn("target", F.when(target != F.col("path"), target))
    d = d.join(listing.select(F.col("path").alias("target"), F.lit(True).alias("__held")).distinct(), "target", "left")
    first = F.row_number().over(Window.partitionBy(F.coalesce("target", "path")).orderBy("path")) == 1
    # fixed sentence
    said = F.concat(F.lit("Left "), name, F.lit(" where it was — "), "folder", F.lit(" already holds a file of that name."))
    d = d.withColumn("warning", F.when(F.col("target").isNotNull() & (F.coalesce("__held", F.lit(False)) | ~first), said))
    return d.select(*sources.columns, F.when(F.col("warning").isNull(), F.col("target")).alias("target"), "warning")


def package_folders(listing: DataFrame) -> DataFrame:
    """(folder) of the ``listing(path)`` of files: folders with ``meta.json`` and a note of the folder's own name."""
    parts = listing.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract("path", "[^/]*$", 0).alias("file")).where("folder <> ''")
    own = F.concat(F.regexp_extract("folder", "[^/]*$", 0), F.lit(".md"))
    return parts.where(F.col("file") == own).select("folder").distinct().join(parts.where("file = 'meta.json'").select("folder"), "folder", "left_semi")


def destinations(sources: DataFrame, listing: DataFrame, output: str = "", by_title: bool = True) -> DataFrame:
    """``sources(path, title)`` with the ``folder`` and ``stem`` of their package.

    A source that lies in a package keeps it. Any other goes to the folder ``output``, or beside itself, under its title's
    name or, unless ``by_title``, its file's; a null title falls back to the file's.
    """
    parent, base = F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.regexp_replace(F.regexp_extract("path", "[^/]*$", 0), r"\.[^.]*$", "")
    d = sources.withColumn("__parent", parent).join(package_folders(listing).withColumnRenamed("folder", "__own"), F.col("__own") == F.col("__parent"), "left")
    name: Column = package_name(F.coalesce("title", F.lit("")), base) if by_title else base
    at = F.lit(output.strip()) if output.strip() else F.col("__parent")
    fresh = F.regexp_replace(F.concat(at, F.lit("/"), name), "^/|/+(?=/)", "")
    stem = F.when(F.col("__own").isNotNull(), F.regexp_extract("__own", "[^/]*$", 0)).otherwise(name)
    return d.select(*[F.col(c) for c in sources.columns], F.coalesce("__own", fresh).alias("folder"), stem.alias("stem"))


def missing_or_present(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """``wanted(path)`` with ``present``: whether the listing has the file."""
    return wanted.join(listing.select("path").distinct().withColumn("__there", F.lit(True)), "path", "left").withColumn("present", F.coalesce("__there", F.lit(False))).drop("__there")
