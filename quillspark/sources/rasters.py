"""Rendered pages as bands of lines: crops as PNG files, and how much two renderings differ.

A band is a row (doc_id, page, width, height, y, rgba): whole lines of four bytes a pixel from line ``y`` on. Bands keep batches small whatever a
page's size is, and what is computed of them merges by sums and maxima.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import crop_box

#: Weights of red, green and blue in a pixel's brightness, and the difference of brightness that counts.
LUMA, VISIBLE = np.array([0.299, 0.587, 0.114]), 8


def bands(rasters: DataFrame, lines: int = 64) -> DataFrame:
    """Whole pages (doc_id, page, width, height, rgba) cut into bands of ``lines`` lines."""
    d = rasters.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1, F.lit(lines)))).where("width > 0 AND height > 0")
    return d.select("doc_id", "page", "width", "height", "y", F.substring("rgba", F.col("y") * F.col("width") * 4 + 1, F.lit(lines) * F.col("width") * 4).alias("rgba"))


def png(width: int, lines: list[bytes]) -> bytes:
    """An image of RGBA lines; the same bytes for the same pixels."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines), 6)) + chunk(b"IEND", b"")


def crops(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """(doc_id, id, png) of ``boxes(doc_id, page, id, box)`` on the bands ``pages``.

    Each band gives its lines within a box; a crop is put together from these, so a task holds one crop at a time. A box is rounded
    outwards and has one pixel at least; without bands there is no crop.
    """
    at = crop_box(F.col("box"), F.col("width"), F.col("height"))
    d = pages.join(boxes.select("doc_id", "page", "id", "box"), ["doc_id", "page"]).withColumn("c", at)
    bottom = F.col("y") + F.octet_length("rgba") / (F.col("width") * 4)
    d = d.where((F.col("y") < F.col("c.y") + F.col("c.h")) & (bottom > F.col("c.y"))).select("doc_id", "page", "id", "y", "width", "rgba", *[F.col(f"c.{k}").cast("int").alias(f"c{k}") for k in "xywh"])

    @F.pandas_udf("array<binary>")
    def cut(rgba: pd.Series, width: pd.Series, y: pd.Series, cx: pd.Series, cy: pd.Series, cw: pd.Series, ch: pd.Series) -> pd.Series:
        out = []
        for data, w, top, x, first, wide, high in zip(rgba, width, y, cx, cy, cw, ch, strict=True):
            lines = np.frombuffer(data, np.uint8).reshape(-1, 4 * w)[max(0, first - top) : max(0, first + high - top)]
            out.append([line[4 * x : 4 * (x + wide)].tobytes() for line in lines])
        return pd.Series(out)

    @F.pandas_udf("binary")
    def encode(width: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([png(int(w), list(x)) for w, x in zip(width, lines, strict=True)])

    d = d.select("doc_id", "page", "id", "y", "cw", cut("rgba", "width", "y", "cx", "cy", "cw", "ch").alias("lines"))
    d = d.groupBy("doc_id", "page", "id").agg(F.first("cw").alias("cw"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("y", "lines"))), lambda x: x["lines"])).alias("lines"))
    return d.select("doc_id", "id", encode("cw", "lines").alias("png"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """How the bands of two renderings differ: doc_id, page, size, pixels, differing_pct, mean_abs_luma, max_abs_luma, error.

    Brightness counts, as readers and models don't see alpha. Both have to be cut alike. A page that one of them lacks, or that has other
    sizes, has an error and no figures.
    """
    names = ("width", "height", "rgba")
    left = a.select("doc_id", "page", "y", *[F.col(n).alias(f"{n}_a") for n in names])
    right = b.select("doc_id", "page", "y", *[F.col(n).alias(f"{n}_b") for n in names])
    d = left.join(right, ["doc_id", "page", "y"], "full")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("rgba_a"), batch.column("rgba_b"), strict=True):
                if not x.is_valid or not y.is_valid or len(x.as_buffer()) != len(y.as_buffer()):
                    rows.append((0, 0, 0.0, 0.0))
                    continue
                p, q = (np.frombuffer(v.as_buffer(), np.uint8).reshape(-1, 4)[:, :3] for v in (x, y))
                delta = np.abs(p @ LUMA - q @ LUMA)
                rows.append((len(delta), int((delta > VISIBLE).sum()), float(delta.sum()), float(delta.max(initial=0))))
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            kept = ["doc_id", "page", "width_a", "height_a", "width_b", "height_b"]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], *found], names=[*kept, "pixels", "differing", "total", "most"])

    types = dict(d.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in ("doc_id", "page", "width_a", "height_a", "width_b", "height_b")) + ", pixels long, differing long, total double, most double"
    parts = d.mapInArrow(run, schema)
    size = lambda s: F.concat(F.max(f"width_{s}"), F.lit("x"), F.max(f"height_{s}"))
    g = parts.groupBy("doc_id", "page").agg(size("a").alias("size_a"), size("b").alias("size_b"), F.sum("pixels").alias("pixels"), F.sum("differing").alias("differing"), F.sum("total").alias("total"), F.max("most").alias("most"))
    error = F.when(F.col("size_a").isNull() | F.col("size_b").isNull(), "missing render").when(F.col("size_a") != F.col("size_b"), F.concat(F.lit("size "), "size_a", F.lit(" vs "), "size_b"))
    fine = lambda x: F.when(F.col("error").isNull(), x)
    g = g.withColumn("error", error)
    return g.select("doc_id", "page", fine(F.col("size_a")).alias("size"), fine(F.col("pixels")).alias("pixels"), fine(F.round(100 * F.col("differing") / F.col("pixels"), 3)).alias("differing_pct"), fine(F.round(F.col("total") / F.col("pixels"), 3)).alias("mean_abs_luma"), fine(F.floor(F.col("most") + 0.5)).alias("max_abs_luma"), "error")
