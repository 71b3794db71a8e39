"""Readers of packages, sidecars, expectations and page sources, all by Spark's own readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META = "source string, title string, out_dir string, md_path string, engine string, engine_version string, model string, options struct<formulas:boolean,ocr:boolean>, pages int, images int, formulas array<struct<id:string,tex:string,page:int,suspect:boolean>>, markdown_chars int, timings_ms struct<load:bigint,inference:bigint,assemble:bigint>, wall_ms bigint, execution_providers array<string>, warnings array<string>"
EXPECTATION = "id string, title_contains string, min_headings int, min_images int, min_math_blocks int, required_substrings array<string>, required_table_cells array<string>, forbidden_substrings array<string>"
GENERATION = "doc_id string, page int, doc_tags string, truncated string, gen_tokens int, prompt_tokens int, ms bigint"


def notes(spark: SparkSession, path: str) -> DataFrame:
    """(path, markdown) of every ``.md`` file at or below ``path``."""
    d = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("markdown"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``meta.json`` files; one that can't be read has a null ``meta``."""
    d = spark.read.option("pathGlobFilter", "meta.json").option("recursiveFileLookup", True).text(path, wholetext=True)
    return d.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", META, {"mode": "PERMISSIVE"}).alias("meta"))


def expectations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EXPECTATION).option("multiLine", True).option("pathGlobFilter", "*.json").json(path)


def pdf_pages(spark: SparkSession, path: str, render: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Pages of every PDF at or below ``path`` by an injected renderer, which yields a row for each page of a file's bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([{"path": name, **row} for row in render(data)])

    return files.mapInPandas(run, "path string, " + schema)


def infer(pages: DataFrame, load: Callable[[], Callable[[dict], dict]], max_pages: int | None = None) -> DataFrame:
    """DocTags of pages by an injected model, loaded once a task. The page limit comes first: nothing is read in vain."""
    pages = pages.where(F.col("page") <= max_pages) if max_pages else pages

    def run(batches):
        model = load()
        for batch in batches:
            yield pd.DataFrame([model(r) for r in batch.to_dict("records")])

    return pages.mapInPandas(run, GENERATION)


def first_working(candidates: list[str], load: Callable[[str], Callable[[dict], dict]], name: str) -> tuple[Callable[[dict], dict] | None, str | None, list[str]]:
    """The model on the first device it loads on, that device, and what the ones before said; without any, what is said of all."""
    failures: list[str] = []
    for device in candidates:
        try:
            return load(device), device, failures
        except Exception as e:  # noqa: BLE001 - whatever a backend throws when it starts
            failures.append(f"{device}: {str(e)[:200]}")
    # fixed sentence
    return None, None, [f"no usable compute backend for {name}. Tried {len(candidates)}: {' | '.join(failures)}"]


def infer_on(pages: DataFrame, candidates: list[str], load: Callable[[str], Callable[[dict], dict]], name: str = "the model") -> DataFrame:
    """``infer`` on the first of ``candidates`` that works in a task, with columns device, fell_back and failures.

    Only loading falls through: a page that fails later is an error, as half a document on another device would have other numerics.
    Where no device works, the pages come without DocTags and say so in ``failures``.
    """
    def run(batches):
        model, device, failures = first_working(candidates, load, name)
        for batch in batches:
            rows = [(model(r) if model else {"doc_id": r["doc_id"], "page": r["page"]}) | {"device": device, "fell_back": bool(failures) and model is not None, "failures": failures} for r in batch.to_dict("records")]
            d = pd.DataFrame(rows, columns=[*[c.split()[0] for c in GENERATION.split(", ")], "device", "fell_back", "failures"])
            yield d.astype(object).where(d.notna(), None)

    return pages.mapInPandas(run, GENERATION + ", device string, fell_back boolean, failures array<string>")


def replay(pages: DataFrame) -> DataFrame:
    """The backend that replays stored DocTags."""
    return pages.select("doc_id", "page", "doc_tags", "truncated", "gen_tokens", "prompt_tokens", "ms")


def crop_box(box: Column, width: Column, height: Column) -> Column:
    """A box's pixels: rounded outwards, within the page, one pixel at least."""
    lim = lambda x, n: F.greatest(F.lit(0), F.least(x, n))
    x0, y0 = lim(F.floor(box["l"] * width), width - 1), lim(F.floor(box["t"] * height), height - 1)
    x1, y1 = lim(F.ceil(box["r"] * width), width), lim(F.ceil(box["b"] * height), height)
    return F.struct(x0.alias("x"), y0.alias("y"), F.greatest(F.lit(1), x1 - x0).alias("w"), F.greatest(F.lit(1), y1 - y0).alias("h"))


def device_candidates(preference: Column, webgpu: Column, webnn: Column) -> Column:
    """Devices to try, in order, by preference and by what the probe found; ``webnn`` lists its usable kinds.

    The CPU comes last. Neural devices come only where they are asked for, the NPU before the GPU.
    """
    some = lambda ok, name: F.when(ok, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    neural = F.concat(*[some((preference == "webnn") & F.coalesce(F.array_contains(webnn, k), F.lit(False)), f"webnn-{k}") for k in ("npu", "gpu")])
    return F.concat(neural, some(webgpu & (preference != "wasm"), "webgpu"), F.array(F.lit("wasm")))


def text_token(item: Column, width: Column, height: Column) -> Column:
    """A positioned token from a PDF text item (str, transform, width, height) and its unscaled page's size.

    PDF space begins at the bottom; the box is in fractions of the page, from its top. Null for an item without text.
    """
    e, f = F.coalesce(F.get(item["transform"], F.lit(4)), F.lit(0.0)), F.coalesce(F.get(item["transform"], F.lit(5)), F.lit(0.0))
    x, h = e / width, F.coalesce(item["height"], F.lit(0.0)) / height
    top = 1 - f / height - h
    box = F.struct(item["str"].alias("str"), x.alias("l"), top.alias("t"), (x + F.coalesce(item["width"], F.lit(0.0)) / width).alias("r"), (top + h).alias("b"))
    return F.when(F.coalesce(item["str"], F.lit("")) != "", box)


def embed_type(device: Column, f16: Column) -> Column:
    return F.when((device == "webgpu") & f16, "fp16").otherwise("fp32")


def asset_names(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length) of every file below ``root``; ``name`` is relative to it. No file's content is read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = str(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop)).rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.substr("path", F.lit(len(top) + 1)).alias("name"), "length").where(F.col("path").startswith(top))


def asset_bytes(spark: SparkSession, root: str, wanted: DataFrame, per_read: int = 10_000) -> DataFrame:
    """(doc_id, href, content) of the files of ``wanted(doc_id, folder, href)`` that exist below ``root``.

    Two scans: the first lists names and joins them with what is wanted, the second reads only the files that are. Their paths go
    through the driver, as those of any scan of files do, ``per_read`` at a time. A href that leaves its folder finds nothing.
    """
    name = F.when(F.coalesce("folder", F.lit("")) == "", F.col("href")).otherwise(F.concat("folder", F.lit("/"), "href"))
    named = wanted.select("doc_id", "href", name.alias("name")).where(~F.col("href").rlike(r"(^|/)\.\.(/|$)"))
    found = named.join(asset_names(spark, root), "name").select("doc_id", "href", "path")
    parts, batch = [], []
    read = lambda paths: spark.read.format("binaryFile").load([re.sub(r"([\[\]{}*?\\])", r"\\\1", p) for p in paths]).select("path", "content")
    for row in found.select("path").distinct().toLocalIterator():
        batch.append(row.path)
        if len(batch) == per_read:
            parts.append(read(batch))
            batch = []
    if batch:
        parts.append(read(batch))
    if not parts:
        return found.select("doc_id", "href", F.lit(None).cast("binary").alias("content")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return found.join(out, "path").select("doc_id", "href", "content")
