"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles; equal sets are one node. XOR-hashing a set gives a parity sketch: the hash says
in which part an element falls, and a part's signature is the XOR of its elements' hashes. Sets whose symmetric difference
is d differ in d parts at most, so the number of parts that differ is a lower bound of d. Sketches are made per size band (a
set near a band's end is in two); a linked pair's d is bounded by its sizes, and parts hold two to four elements. By the
pigeonhole principle linked sets agree in ``extra + 1`` of the first d + 1 + extra parts that aren't empty. A set with too
few such parts deals its elements to parts anew, and its partners do so if they must: the one that must do so least often
finds the other.

Signatures that only one node has join nothing. Of the others each node leaves out the ``extra`` that most nodes share, and
still agrees in one with every node that it links to. A signature that many nodes share isn't expanded into pairs. Its
nodes are first held against one, the pivot, which shares the most signatures; links found so join most of a group of near copies. Where a
signature then still has nodes of different components, lower bounds of the symmetric difference say which pairs of them
can be linked at all: the Hamming distance of two parity sketches, bit for bit; and the elements that no other of these
nodes has (``alone``) with the difference of what either has lost of the pivot (``lost``). Nodes that can be linked to none go, and the other pairs across components are verified on their
whole sets. So no link between different components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, only, release, utf8, written
from .graph import components
from .words import LOWER, Block, blocks, mix, spread

#: Dealings of a set's elements to parts before each element becomes a part.
LAST = 8
#: Bytes of text whose sets a task holds at once.
BLOCK = 500_000
#: Nodes that a task remembers, so as to emit a copy once.
SEEN = 200_000
_STEPS = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407]


def shingle_sets(b: Block, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted sets of shingle hashes of a block's texts, one after the other, and where each begins (and the end)."""
    b.words(LOWER)
    n = np.diff(b.first)
    h = b.hashes
    short = (n > 0) & (n < words)
    count = np.where(n >= words, n - words + 1, short.astype(np.int64))
    at = spread(b.first[:-1], count)
    text_of = np.repeat(np.arange(len(n)), count)
    with np.errstate(over="ignore"):
        s = np.zeros(len(at), np.uint64)
        for k in range(words):
            inside = at + k < b.first[1:][text_of]
            s += np.where(inside, h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else 0, np.uint64(k + 1)) * np.uint64(_STEPS[k % 5] + 2 * (k // 5) * 0x9E3779B1)
    s = mix(s)
    order = np.lexsort((s, text_of))
    s, text_of = s[order], text_of[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (text_of[1:] != text_of[:-1])
    s, text_of = s[new], text_of[new]
    return s, np.searchsorted(text_of, np.arange(len(n) + 1))


def nodes_of(s: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, from its elements and size; 0 for an empty one."""
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
        size = np.diff(start)
        name = mix(sums[start[1:]] - sums[start[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(size > 0, name, 0).astype(np.uint64).view(np.int64)


def most_different(size: np.ndarray, other: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of linked sets of these sizes: 100 c >= percent (s + t - c) bounds s + t - 2 c."""
    return (size + other) * (100 - percent) // (100 + percent)


def band_of(size: np.ndarray) -> np.ndarray:
    """Sizes 2**k to 2**(k+1) - 1 are band k."""
    return np.frexp(size.astype(np.float64))[1].astype(np.int64) - 1


def shape(band: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each band the parts of its sketches, and how many more signatures than one linked sets of it share."""
    top = (np.int64(2) << band) - 1
    d = most_different(top, top, percent)
    extra = d // 3
    return np.where(d > 0, (d + 1 + extra) * 17 // 16 + 2, 1), extra


def signatures(s: np.ndarray, start: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The sketch signatures of many sorted sets, and the set that each is of. The low six bits of a signature are its band."""
    size = np.diff(start)
    most = size * 100 // percent
    own = np.flatnonzero(size > 0)
    upper = own[band_of(most[own]) > band_of(size[own])]
    which = np.concatenate([own, upper])
    band = np.concatenate([band_of(size[own]), band_of(most[upper])])
    out: list[np.ndarray] = []
    of: list[np.ndarray] = []
    turn = 0
    while len(which):
        n = size[which]
        parts, extra = shape(band, percent)
        # of its own band no partner is larger than the band's end, or than the similarity allows
        need = most_different(n, np.minimum(most[which], (np.int64(2) << band) - 1), percent) + 1 + extra
        at = spread(start[which], n)
        job = np.repeat(np.arange(len(which)), n)
        h = s[at]
        if turn:  # another dealing of the elements to parts
            with np.errstate(over="ignore"):
                h = mix(h + np.uint64(turn) * np.uint64(0x9E3779B97F4A7C15))
            order = np.lexsort((h, job))
            h, job = h[order], job[order]
        # at last each element is a part by itself
        part = (h >> np.uint64(32)) * parts[job].astype(np.uint64) >> np.uint64(32) if turn < LAST else h
        first = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (job[1:] != job[:-1])]))
        xor, owner = np.bitwise_xor.reduceat(h, first), job[first]
        begin = np.searchsorted(owner, np.arange(len(which)))
        place = np.arange(len(first)) - begin[owner]
        full = np.diff(np.append(begin, len(first)))
        take = place < need[owner]
        xor, owner, part = xor[take], owner[take], part[first[take]]
        with np.errstate(over="ignore"):
            key = mix(xor * np.uint64(3) + part * np.uint64(0x9E3779B97F4A7C15) + np.uint64(turn))
        out.append(key & ~np.uint64(63) | band[owner].astype(np.uint64))
        of.append(which[owner])
        again = (full < need) & (turn < LAST)
        which, band = which[again], band[again]
        turn += 1
    return (np.concatenate(out), np.concatenate(of)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def digests(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, n_shingles, node) of every row of ``docs(doc_id, text)``."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                s, start = shingle_sets(b, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), pa.array(np.diff(start)), pa.array(nodes_of(s, start))], names=["doc_id", "n_shingles", "node"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long")


def shared_signatures(docs: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """(signature, node): every signature that two nodes or more have."""

    def emit(batches):
        seen: set[int] = set()  # copies in a task are emitted once
        for batch in batches:
            for b in blocks(batch.column(0), BLOCK):
                s, start = shingle_sets(b, words)
                nodes = nodes_of(s, start)
                names, first = np.unique(nodes, return_index=True)
                new = np.sort([k for x, k in zip(names.tolist(), first.tolist(), strict=True) if x and x not in seen]).astype(np.int64)
                if len(seen) > SEEN:
                    seen.clear()
                seen.update(names.tolist())
                sizes = np.diff(start)[new]
                keys, of = signatures(s[spread(start[new], sizes)], np.concatenate([[0], np.cumsum(sizes)]), percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[new][of])], names=["signature", "node"])

    def group(batches):
        """Rows come by signature and node; a row is given if a neighbour has its signature. The last row waits for the next batch."""
        held = (np.zeros(0, np.int64),) * 2  # the last different row, and whether the one before it has its signature
        joined = False
        for batch in batches:
            k, n = (np.concatenate([a, batch.column(i).to_numpy()]) for i, a in enumerate(held))
            if not len(k):
                continue
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            k, n = k[new], n[new]
            same = np.zeros(len(k) + 1, bool)  # same[i]: row i has the signature of row i - 1
            same[1:-1] = k[1:] == k[:-1]
            same[0] = joined
            keep = (same[:-1] | same[1:])[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(k[:-1][keep]), pa.array(n[:-1][keep])], names=["signature", "node"])
            held, joined = (k[-1:], n[-1:]), bool(same[len(k) - 1])
        if joined:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["signature", "node"])

    rows = docs.select("text").mapInArrow(emit, "signature long, node long")
    dealt = rows.repartition("signature").sortWithinPartitions("signature", "node")
    return dealt.mapInArrow(group, "signature long, node long")


def sketch_words(band):
    """64-bit words of a band's parity sketch: about four bits for each element that linked sets may differ by, 4 to 64 words."""
    return np.clip(np.int64(1) << np.maximum(band, 5) - 5, 4, 64)


def sketches(s: np.ndarray, start: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The parity sketch of each set, in the width of the larger of its bands: a bit is the parity of the elements dealt to it."""
    width = np.where(np.diff(start) > 0, sketch_words(band_of(np.maximum(1, np.diff(start) * 100 // percent))), 0)
    offset = np.concatenate([[0], np.cumsum(width)])
    of = np.repeat(np.arange(len(width)), np.diff(start))
    bit = offset[of] * 64 + (s & (width[of] * 64 - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=int(offset[-1]) * 64) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64), offset


def sets_of(docs: DataFrame, percent: int, words: int = 5) -> DataFrame:
    """(node, shingles, sketch) of rows of ``docs(node, text)``: the set as an array of longs, and its parity sketch."""

    def run(batches):
        for batch in batches:
            for b in blocks(batch.column(1), BLOCK):
                s, start = shingle_sets(b, words)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.view(np.int64))) for x, at in ((s, start), sketches(s, start, percent))]
                rows = pa.RecordBatch.from_arrays([batch.column(0).slice(b.lo, b.hi - b.lo), *lists], names=["node", "shingles", "sketch"])
                yield rows.filter(pa.array(nodes_of(s, start) == rows.column(0).to_numpy()))  # where an id repeats, its other texts go

    return docs.mapInArrow(run, "node long, shingles array<long>, sketch array<long>")


def kept_signatures(shared: DataFrame, percent: int) -> DataFrame:
    """(signature, node, pivot): of each node and band all shared signatures but the ``extra`` that most nodes have, where two nodes keep one."""
    n = shared.groupBy("signature").agg(F.count("*").alias("n"))
    common = Window.partitionBy("node", "band").orderBy(F.desc("n"), F.desc("signature"))
    extra = np.array([shape(np.array([k]), percent)[1][0] for k in range(48)])
    rank = shared.join(n, "signature").withColumn("band", F.expr("cast(signature & 63 AS int)")).withColumn("rank", F.row_number().over(common))
    rank = rank.withColumn("size", F.count("*").over(Window.partitionBy("node", "band")))
    kept = rank.where(F.col("rank") > F.element_at(F.array(*[F.lit(int(x)) for x in extra]), F.col("band") + 1)).select("signature", "node", "size")
    kept = written(kept, "kept")
    pivots = kept.groupBy("signature").agg(F.max(F.struct("size", "node"))["node"].alias("pivot"), F.count("*").alias("n")).where("n > 1")
    return kept.drop("size").join(pivots.select("signature", "pivot"), "signature")


def sets_for(nodes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """(node, shingles, sketch) of ``nodes(node, doc_id)``, each from one text that has it."""
    return written(sets_of(docs.join(nodes, "doc_id").select("node", "text"), percent, words).dropDuplicates(["node"]), "sets")


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs(a, b)`` with ``common``, the size of the intersection of the whole sets, and whether they are ``linked``."""
    a, b = sets.selectExpr("node AS a", "shingles AS sa"), sets.selectExpr("node AS b", "shingles AS sb")
    # the size of an intersection, once a pair
    both = pairs.join(a, "a").join(b, "b").select("a", "b", F.explode(F.array(F.struct(F.size(F.array_intersect("sa", "sb")).alias("common"), (F.size("sa") + F.size("sb")).alias("total")))).alias("x"))
    return both.select("a", "b", "x.common", F.expr(f"100L * x.common >= {percent}L * (x.total - x.common)").alias("linked"))


def across(rows: DataFrame, tested: DataFrame, comps: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share a signature of ``rows`` and that the lower bound lets be linked, but for those ``tested``."""
    most = f"div {100 + percent}"  # a linked pair's difference: (s + t) * (100 - percent) div (100 + percent)
    c = rows.join(comps, "node", "left").withColumn("c", F.coalesce("component", "node")).drop("component")
    mixed = c.groupBy("signature").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("signature")
    left = written(c.join(mixed, "signature"), "left")
    nodes = left.select("node").distinct()
    once = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("x")).groupBy("x").agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    alone = nodes.join(once.groupBy("node").agg(F.count("*").alias("alone")), "node", "left").join(classes.select("node", "size"), "node")
    alone = written(alone.select("node", F.coalesce("alone", F.lit(0)).alias("alone"), "size"), "alone")
    lost = tested.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "common").join(classes.selectExpr("node AS pivot", "size AS whole"), "pivot").select("pivot", "node", (F.col("whole") - F.col("common")).alias("lost"))
    left = left.join(alone, "node").join(lost, ["pivot", "node"], "left").withColumn("lost", F.coalesce("lost", F.lit(0)))
    left = written(left, "left")
    # the least that a node and the best partner of its signature can differ by
    best = left.groupBy("signature").agg(F.max(F.col("lost") - F.col("alone")).alias("best"), F.max("size").alias("largest"))
    left = left.join(best, "signature").where(f"alone + lost - best <= (size + least(largest, size * 100 div {percent})) * {100 - percent} {most}")
    mixed = left.groupBy("signature").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("signature")
    # a sketch of twice the width of its band's is folded
    width = F.array(*[F.lit(int(sketch_words(np.int64(k)))) for k in range(48)])
    left = left.join(mixed, "signature").join(sets.select("node", "sketch"), "node").withColumn("width", F.element_at(width, F.expr("cast(signature & 63 AS int) + 1")))
    left = left.withColumn("sketch", F.expr("CASE WHEN size(sketch) > width THEN zip_with(slice(sketch, 1, width), slice(sketch, width + 1, width), (x, y) -> x ^ y) ELSE sketch END"))
    left = written(left.select("signature", "node", "c", "size", "alone", "lost", "sketch"), "left")
    x, y = (left.selectExpr("signature", *[f"{n} AS {n}_{k}" for n in ("node", "c", "size", "alone", "lost", "sketch")]) for k in "ab")
    d = f"(size_a + size_b) * {100 - percent} {most}"
    bounds = f"alone_a + alone_b + abs(lost_a - lost_b) <= {d} AND aggregate(zip_with(sketch_a, sketch_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) <= {d}"
    pairs = x.join(y, "signature").where(f"node_a < node_b AND c_a <> c_b AND 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) AND {bounds}")
    return pairs.selectExpr("node_a AS a", "node_b AS b").distinct().join(tested.selectExpr("least(a, b) AS a", "greatest(a, b) AS b"), ["a", "b"], "left_anti")


def _documents(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select("doc_id", F.coalesce(utf8("text"), F.lit(b"")).alias("text"))


def link_components(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id for ``docs(doc_id, text)``.

    A null or empty text has no shingles and is its own component; rows that repeat are copies; ids must not be null (rows
    with a null id are returned with a null component and link nothing). Other columns are not read.
    """
    spark = docs.sparkSession
    d = _documents(docs)
    digest = written(digests(d, words), "digests")
    classes = written(digest.where("node <> 0 AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size")), "classes")
    shared = written(shared_signatures(d.where("doc_id IS NOT NULL"), percent, words), "shared")
    release(spark)
    rows = written(kept_signatures(shared, percent), "rows")
    drop_written(shared)
    release(spark)
    pairs = written(rows.where("node <> pivot").selectExpr("pivot AS a", "node AS b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").selectExpr("node", "rep AS doc_id")
    sets = sets_for(nodes, d, percent, words)
    release(spark)
    tested = written(measured(pairs, sets, percent), "tested")
    links = tested.where("linked").select("a", "b")
    comps = written(components(links), "components")
    release(spark)
    others = written(across(rows, tested, comps, classes, sets, percent), "across")
    release(spark)
    more = written(measured(others, sets, percent).where("linked").select("a", "b"), "links")
    if more.limit(1).count():
        comps = written(components(links.unionByName(more)), "components")
    drop_written(sets)
    release(spark)
    # nodes are hashes: a component is named by its smallest document
    named = classes.join(comps, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    least = written(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    final = written(named.join(least, "component").select("node", "component_id"), "final")
    out = digest.join(final, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def count_links(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """doc_id and n_links, the number of other documents that it links to, for every different id of ``docs(doc_id, text)``.

    ``link_components`` needs just enough links to join a component; here every pair of different sets that keep a common
    signature is verified, which grows with the square of a group of near copies as the links themselves do. Ids must not repeat.
    """
    d = _documents(docs).where("doc_id IS NOT NULL")
    digest = written(digests(d, words), "digests")
    classes = written(digest.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.countDistinct("doc_id").alias("copies")), "classes")
    rows = written(kept_signatures(written(shared_signatures(d, percent, words), "shared"), percent).select("signature", "node"), "rows")
    pairs = written(rows.withColumnRenamed("node", "a").join(rows.withColumnRenamed("node", "b"), "signature").where("a < b").select("a", "b").distinct(), "pairs")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes, "node").selectExpr("node", "rep AS doc_id")
    links = written(measured(pairs, sets_for(nodes, d, percent, words), percent).where("linked").select("a", "b"), "links")
    release(docs.sparkSession)
    both = links.unionByName(links.selectExpr("b AS a", "a AS b"))
    others = both.join(classes.selectExpr("node AS b", "copies"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("copies").alias("others"))
    found = classes.join(others, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return digest.select("doc_id", "node").distinct().join(found, "node", "left").select("doc_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """One row of each component of ``docs``, the one with the smallest id, with all columns; rows without words all stay.

    Rows with a null id stay as well, since nothing names their component.
    """
    found = link_components(docs, percent, words).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
