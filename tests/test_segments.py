"""Native block segmentation against the parser."""

import random
import time

from quillspark.operators import doctags

NAMES = ["text", "text", "picture", "caption", "caption", "otsl", "formula", "page_header", "unordered_list", "list_item", "doctag", "chart", "odd_1"]
CELL = ["fcel", "ecel", "ched", "lcel", "xcel", "nl", "nl"]


def element(r, depth=0):
    name = r.choice(NAMES)
    locs = "".join(f"<loc_{r.randint(0, 500)}>" for _ in range(r.choice([0, 0, 3, 4, 4, 5])))
    inside = r.choice(["", "a | b", " x\n y ", "1 < 2", "é<b", "\x01" if r.random() < 0.02 else "z"])
    if name == "otsl":
        inside = "".join(f"<{r.choice(CELL)}>" + r.choice(["", " c ", "<loc_1>d", "e<loc_2>f", "g|h"]) for _ in range(r.randint(0, 9)))
    elif depth < 3 and r.random() < 0.4:
        inside += "".join(element(r, depth + 1) for _ in range(r.randint(1, 3))) + inside
    return f"<{name}>{locs}{inside}</{name}>" + r.choice(["", "", " ", "\n", "stray", "<loc_7>"])


def page(r, harm):
    source = "".join(element(r) for _ in range(r.randint(0, 6)))
    for _ in range(harm):
        at = r.randint(0, len(source))
        source = source[:at] + r.choice(["</text>", "<text>", "<picture>", "</otsl>", "<", "<nl>", "</caption>", "<list_item>"]) + source[at:]
    return source


def rows(d):
    return sorted((tuple(x[c] for c in ("doc_id", "page", "block_no", "cls", "bbox", "raw", "caption", "grid", "spans")) for x in d.collect()), key=repr)


def test_blocks_are_those_of_the_parser(spark):
    r = random.Random(11)
    pages = [(k, 1, page(r, 0)) for k in range(600)] + [(k, 2, page(r, r.randint(1, 3))) for k in range(600)]
    pages += [(1, 3, None), (1, 4, ""), (1, 5, "no tags"), (None, None, "<text>a</text>"), (7, 7, "<text>same key</text>"), (7, 7, "<text>same key</text><text>b</text>"), (8, 1, "<a>" * 3000 + "</a>" * 3000), (8, 2, "<loc_99999999999><text><loc_99999999999><loc_1><loc_2><loc_3>x</text>")]
    want = sorted(((d, p, *(b[c] for c in ("block_no", "cls", "bbox", "raw", "caption", "grid", "spans"))) for d, p, s in pages for b in doctags.page_blocks(s)), key=repr)
    assert rows(doctags.segmented(spark.createDataFrame(pages, "doc_id long, page int, doc_tags string"))) == want and len(want) > 3000


def test_pages_never_leave_the_jvm_and_only_nested_ones_are_shuffled(spark):
    pages = [(1, 1, "<text>a</text><otsl><fcel>b<nl></otsl><text>cut")]
    d = doctags.segmented(spark.createDataFrame(pages, "doc_id long, page int, doc_tags string"))
    assert [x.raw for x in sorted(d.collect(), key=lambda x: x.block_no)] == ["a", "b", "cut"]
    plan = d._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sum("Exchange" in line for line in plan.split("== Physical Plan ==")[1].split("== Initial Plan ==")[-1].splitlines()) == 1


def test_long_pages_take_time_in_proportion(spark):
    """A page of tags that are never closed, one of many blocks, one of deep nests, and one long word."""
    pages = [(1, 1, "".join(f"<t{k}>" for k in range(20_000))), (2, 1, "<text>a</text>" * 20_000), (3, 1, "<text>" * 2000 + "</text>" * 2000), (4, 1, "<text>" + "a <" * 200_000 + "</text>")]
    began = time.perf_counter()
    d = doctags.segmented(spark.createDataFrame(pages, "doc_id long, page int, doc_tags string"))
    assert {r[0]: r[1] for r in d.groupBy("doc_id").count().collect()} == {1: 1, 2: 20_000, 3: 1, 4: 1}
    assert time.perf_counter() - began < 30
