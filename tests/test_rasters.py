"""Crops and differences of rendered pages, pixel by pixel."""

import struct
import zlib

import numpy as np

from quillspark.sources import rasters


def pixels(data):
    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, found = 8, {}
    while at < len(data):
        n, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        assert zlib.crc32(data[at + 4 : at + 8 + n]) == struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]
        found[kind] = data[at + 8 : at + 8 + n]
        at += 12 + n
    w, h = struct.unpack(">II", found[b"IHDR"][:8])
    lines = np.frombuffer(zlib.decompress(found[b"IDAT"]), np.uint8).reshape(h, 1 + 4 * w)
    assert (lines[:, 0] == 0).all()
    return lines[:, 1:].reshape(h, w, 4)


def page(spark, images):
    rows = [(k, 1, x.shape[1], x.shape[0], bytearray(x.tobytes())) for k, x in images.items()]
    return spark.createDataFrame(rows, "doc_id long, page int, width int, height int, rgba binary")


def test_crops_are_the_pixels_of_their_boxes(spark):
    r = np.random.default_rng(4)
    images = {k: r.integers(0, 256, (h, w, 4), dtype=np.uint8) for k, (w, h) in enumerate(((7, 5), (1, 1), (40, 200)))}
    boxes = {"a": (0.0, 0.0, 1.0, 1.0), "b": (0.21, 0.3, 0.55, 0.8), "c": (-1.0, 0.99, 0.0, 2.0)}
    d = spark.createDataFrame([(k, 1, i, b) for k in (*images, 9) for i, b in boxes.items()], "doc_id long, page int, id string, box struct<l:double,t:double,r:double,b:double>")
    for lines in (1, 3, 500):
        got = {(x.doc_id, x.id): pixels(bytes(x.png)) for x in rasters.crops(rasters.bands(page(spark, images), lines), d).collect()}
        assert set(got) == {(k, i) for k in images for i in boxes}
        for (k, i), found in got.items():
            h, w = images[k].shape[:2]
            left, top, right, low = boxes[i]
            x, y = (min(max(int(np.floor(v * n)), 0), n - 1) for v, n in ((left, w), (top, h)))
            x1, y1 = (min(max(int(np.ceil(v * n)), 0), n) for v, n in ((right, w), (low, h)))
            assert (found == images[k][y : max(y + 1, y1), x : max(x + 1, x1)]).all()


def test_differences_of_renderings(spark):
    r = np.random.default_rng(5)
    a = {k: r.integers(0, 256, (30, 20, 4), dtype=np.uint8) for k in range(4)}
    b = {0: a[0].copy(), 1: r.integers(0, 256, (30, 20, 4), dtype=np.uint8), 2: a[2][:10]}
    b[0][..., 3] ^= 1
    luma = lambda x: x[..., :3].astype(float) @ np.array([0.299, 0.587, 0.114])
    delta = np.abs(luma(a[1]) - luma(b[1]))
    want = [(0, 1, "20x30", 600, 0.0, 0.0, 0, None), (1, 1, "20x30", 600, round(100 * float((delta > 8).mean()), 3), round(float(delta.mean()), 3), int(np.floor(delta.max() + 0.5)), None), (2, 1, None, None, None, None, None, "size 20x30 vs 20x10"), (3, 1, None, None, None, None, None, "missing render")]
    for lines in (1, 7, 64):
        got = rasters.differences(rasters.bands(page(spark, a), lines), rasters.bands(page(spark, b), lines))
        assert sorted(tuple(x) for x in got.collect()) == want
