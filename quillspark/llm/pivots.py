"""Hard negatives by a pivot table: exact maximum inner products through stored distances.

Rows get one more component, sqrt(M - |x|**2) with M the largest squared norm, and anchors a zero: then
2 * q.x = |q|**2 + M - d(q, x)**2, so scores are distances. ``pivot_table`` stores each row's distances to a few pivots; by the
triangle inequality |d(q, p) - d(x, p)| <= d(q, x) <= d(q, p) + d(x, p) these bracket every score. ``search`` drops pairs of blocks,
then pairs of rows, whose bracket can't reach what an anchor still needs, and computes the others' scores exactly. So the
result is exact, whatever the pivots are.

Anchors meet the rows in blocks: tasks take one block of anchors and stream some blocks of rows past it, the most promising
first, with a few best rows for each anchor as their only state; tasks' best rows are merged by anchor. Only pivots are broadcast.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component take no part; of rows that share an
id the one with the smallest label, then vector, counts; shorter vectors end in zeros; an empty one scores 0 with all; without rows
the result is empty. Scores that don't fit 56 bits are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, only, written

#: Pivots, and rows of the sample (those with the smallest hashes of their ids) that they are chosen from.
PIVOTS, SAMPLE = 8, 4096
#: Rows and anchors in a block, blocks of rows that one task takes, rows that are scored at once.
BLOCK, ANCHORS, TURN, TILE = 4096, 512, 64, 2048


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(F.col(vector), lambda x: F.floor(scale * x.cast("double")))


def clean(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label (long) and v (array<long>) of the rows that take part, one for each id."""
    r = only(rows, "vec_id", "label", vector).toDF("vec_id", "label", "__v")
    sound = F.forall("__v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    r = r.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("__v").isNotNull() & sound)
    r = r.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), quantised("__v", scale).alias("v")).alias("__r"))
    return written(r.groupBy("vec_id").agg(F.min("__r").alias("__r")).select("vec_id", "__r.label", "__r.v"), "vectors")


def choose_pivots(rows: DataFrame, dim: int, n: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray:
    """Far apart rows of a sample of at most ``sample`` rows: the first by hash, then each time the one farthest from all chosen."""
    found = rows.select("v", F.xxhash64("vec_id").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("v").collect()
    x = np.zeros((len(found), dim))
    for k, r in enumerate(found):
        x[k, : len(r.v)] = r.v
    chosen, least = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


class Space:
    """What every task knows: pivots, the largest squared norm and how scores are computed exactly."""

    def __init__(self, pivots: np.ndarray, most: float, dim: int, largest: int):
        self.pivots, self.most, self.dim = pivots, most, dim
        self.dtype = next(d for d in ("<i2", "<i4", "<i8") if largest <= np.iinfo(d).max)
        # a sum of products of which none nor any partial sum exceeds the largest squared norm is exact in 53 bits
        self.exact = np.float64 if most < 2**53 else np.int64
        self.lift = np.sqrt(np.maximum(most - (pivots**2).sum(1), 0))
        self.slack = 1e-9 * (most + 1)

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Distances of augmented vectors to the augmented pivots."""
        x = x.astype(np.float64)
        own = (x**2).sum(1)
        lift = np.zeros(len(x)) if anchors else np.sqrt(np.maximum(self.most - own, 0))
        square = (own + lift**2)[:, None] + self.most - 2 * (x @ self.pivots.T + np.outer(lift, self.lift))
        return np.sqrt(np.maximum(square, 0))

    def brackets(self, norms: np.ndarray, dq: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score that each pair of an anchor and a row can have."""
        near, far = np.zeros((len(dq), len(dx))), np.full((len(dq), len(dx)), np.inf)
        for p in range(dq.shape[1]):
            np.maximum(near, np.abs(dq[:, p, None] - dx[None, :, p]), out=near)
            np.minimum(far, dq[:, p, None] + dx[None, :, p], out=far)
        top = (norms + self.most)[:, None]
        # distances are known to half of the digits where they are small
        return (top - (far + self.slack**0.5) ** 2) / 2 - self.slack, (top - np.maximum(near - self.slack**0.5, 0) ** 2) / 2 + self.slack

    def scores(self, q: np.ndarray, x: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The exact scores of the wanted pairs, in the order of ``nonzero``."""
        q, x = q.astype(self.exact), x.astype(self.exact)
        a, b = np.nonzero(wanted)
        if 20 * len(a) > wanted.size:
            return (q @ x.T)[a, b].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", q[a[k : k + 65536]], x[b[k : k + 65536]]) for k in range(0, len(a), 65536)] or [np.zeros(0)]).astype(np.int64)


def _vectors(column: pa.Array, space: Space) -> np.ndarray:
    """A binary column of equally long values as a matrix."""
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data.view(space.dtype).reshape(len(column), space.dim)


def _table(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def pivot_table(rows: DataFrame, space: Space, anchors: bool, size: int) -> DataFrame:
    """vec_id, label, v (binary), dist (array<double>), cell (the nearest pivot) and block; written.

    Rows are sorted by label, cell and distance over ranges, so that a block's rows have distances within a small range.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("dist", pa.list_(pa.float64())), ("cell", pa.int32()), ("near", pa.float64())])
        for batch in batches:
            x, lists = np.zeros((len(batch), space.dim), np.int64), batch.column(2)
            sizes, flat = np.diff(np.asarray(lists.offsets)), lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(batch)), sizes)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
            d = space.distances(x, anchors)
            cell = d.argmin(1)
            yield _table([batch.column(0), batch.column(1), [r.tobytes() for r in x.astype(space.dtype)], list(d), cell, d[np.arange(len(d)), cell]], schema)

    d = rows.mapInArrow(measured, "vec_id long, label long, v binary, dist array<double>, cell int, near double")
    order = ("label", "cell", "near", "vec_id")
    # no more ranges than there are blocks to fill
    n = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-rows.count() // size)))
    d = d.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(at, 33), 33) + F.floor(at.bitwiseAND(F.lit((1 << 33) - 1)) / size)
    return written(d.drop("near").withColumn("block", block), "pivots")


def _summary(table: DataFrame, n: int, prefix: str) -> DataFrame:
    """Each block's labels and, for each pivot, the range of its distances."""
    ranges = [f(F.col("dist")[p]).alias(f"{prefix}{name}{p}") for p in range(n) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    return table.groupBy(F.col("block").alias(f"{prefix}block")).agg(F.min("label").alias(f"{prefix}l0"), F.max("label").alias(f"{prefix}l1"), *ranges)


def _pairs(q: DataFrame, x: DataFrame, space: Space, keep: str) -> DataFrame:
    """Pairs of a block of anchors (q_block) and a block of rows (x_block) that ``keep`` doesn't rule out, with ``near`` and ``far``.

    The query set meets all rows, block by block: every summary of anchors is sent to each share of the rows' summaries.
    """
    n, shares = len(space.pivots), int(q.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = q.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    b = x.withColumn("share", F.pmod(F.xxhash64("x_block"), F.lit(shares)).cast("int"))
    near = ", ".join(f"q_lo{p} - x_hi{p}, x_lo{p} - q_hi{p}" for p in range(n))
    far = f"least({', '.join(f'q_hi{p} + x_hi{p}' for p in range(n))})" if n > 1 else "q_hi0 + x_hi0"
    return a.join(b, "share").withColumn("near", F.expr(f"greatest(0D, {near})")).withColumn("far", F.expr(far)).where(keep).select("q_block", "x_block", "near")


def _met(q: DataFrame, x: DataFrame, pairs: DataFrame, extra: str, function, schema: str) -> DataFrame:
    """Streams the rows of each pair of blocks past the anchors and returns what ``function`` finds."""
    slots = max(1, -(-x.select("block").distinct().count() // TURN))
    pairs = pairs.withColumn("slot", F.pmod(F.xxhash64("x_block"), F.lit(slots)).cast("int"))
    columns = ["q_block", "slot", "kind", "near", "block", "vec_id", "label", "v", "dist", extra]
    right = x.join(pairs, F.expr("block = x_block")).select("q_block", "slot", F.lit(1).alias("kind"), "near", "block", "vec_id", "label", "v", "dist", F.lit(None).cast(dict(q.dtypes)[extra]).alias(extra))
    asked = pairs.select("q_block", "slot").distinct()
    left = q.join(asked, F.expr("block = q_block")).select("q_block", "slot", F.lit(0).alias("kind"), F.lit(0.0).alias("near"), "block", "vec_id", "label", "v", "dist", extra)
    stream = left.select(columns).unionAll(right.select(columns)).repartition("q_block", "slot").sortWithinPartitions("q_block", "slot", "kind", "near", "block")
    return written(stream.mapInArrow(function, schema), "found")


def _groups(batches: Iterator[pa.RecordBatch], space: Space):
    """Runs of one kind within one task's (q_block, slot), at most ``TILE`` rows or one block of anchors."""
    for batch in batches:
        key = np.stack([np.asarray(batch.column(k)).astype(np.int64) for k in range(3)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            for at in range(lo, hi, TILE):
                part = batch.slice(at, min(hi, at + TILE) - at)
                dist = part.column(8).flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
                yield tuple(key[:2, lo].tolist()), bool(key[2, lo]), (np.asarray(part.column(5)), np.asarray(part.column(6)), _vectors(part.column(7), space), dist, part.column(9))


class Best:
    """The first ``n`` rows (score, then smaller id) of each of some keys."""

    def __init__(self, keys: int, n: int):
        self.n, self.key, self.score, self.id = n, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.least = np.full(keys, np.iinfo(np.int64).min)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.r_[first, len(key)]))
        kept = rank < self.n
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]
        full = rank == self.n - 1
        self.least[key[full]] = score[full]


def _searching(space: Space, n: int, wants, schema: pa.Schema):
    """A function for ``mapInArrow``: ``wants`` turns a block of anchors into what its rows must satisfy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, anchors, task = None, [], None
        for key, rows, part in _groups(batches, space):
            if key != at:
                if task:
                    yield task.found(schema)
                at, anchors, task = key, [], None
            if not rows:
                anchors.append(part)
                continue
            if task is None:
                ids, labels, v, dist = (np.concatenate([a[k] for a in anchors]) for k in range(4))
                task = wants(space, n, ids, labels, v, dist, [y for a in anchors for y in a[4].to_pylist()])
            task.take(*part[:4])
        if task:
            yield task.found(schema)

    return run


class Positives:
    """Other rows of the anchor's label."""

    def __init__(self, space, n, ids, labels, v, dist, extra):
        self.space, self.ids, self.labels, self.v, self.dist = space, ids, labels, v, dist
        self.norms, self.best = (v.astype(np.float64) ** 2).sum(1), Best(len(ids), n)

    def take(self, ids, labels, v, dist):
        _, most = self.space.brackets(self.norms, self.dist, dist)
        wanted = (self.labels[:, None] == labels[None, :]) & (self.ids[:, None] != ids[None, :]) & (most >= self.best.least[:, None])
        score, (a, b) = self.space.scores(self.v, v, wanted), np.nonzero(wanted)
        kept = score >= self.best.least[a]
        self.best.add(a[kept], score[kept], ids[b[kept]])

    def found(self, schema):
        return _table([self.ids[self.best.key], self.best.id, self.best.score], schema)


class Negatives:
    """Rows of other labels whose score lies between two shares of a positive's score, for each of an anchor's positives."""

    def __init__(self, space, n, ids, labels, v, dist, extra):
        self.space, self.ids, self.labels, self.v, self.dist = space, ids, labels, v, dist
        self.norms = (v.astype(np.float64) ** 2).sum(1)
        flat = [(a, p["id"], p["score"], p["lo"], p["hi"]) for a, ps in enumerate(extra) for p in ps or ()]
        self.of, self.positive, self.score, self.lo, self.hi = (np.array(c, np.int64) for c in zip(*flat, strict=True)) if flat else (np.zeros(0, np.int64) for _ in range(5))
        self.best, self.pending = Best(len(self.of), n), []

    def take(self, ids, labels, v, dist):
        none = np.iinfo(np.int64)
        # an anchor wants scores from the least that any of its positives still takes to the greatest
        least, most = np.full(len(self.ids), none.max), np.full(len(self.ids), none.min)
        floor = np.maximum(self.lo, self.best.least)
        np.minimum.at(least, self.of, floor)
        np.maximum.at(most, self.of, self.hi)
        low, high = self.space.brackets(self.norms, self.dist, dist)
        wanted = (self.labels[:, None] != labels[None, :]) & (high >= least[:, None]) & (low <= most[:, None])
        score, (a, b) = self.space.scores(self.v, v, wanted), np.nonzero(wanted)
        kept = (score >= least[a]) & (score <= most[a])
        a, b, score = a[kept], b[kept], score[kept]
        starts, ends = np.searchsorted(a, self.of), np.searchsorted(a, self.of, "right")
        for k in np.flatnonzero(ends > starts).tolist():
            s = slice(starts[k], ends[k])
            fit = (score[s] >= floor[k]) & (score[s] <= self.hi[k])
            if fit.any():
                mine, found = score[s][fit], ids[b[s][fit]]
                # no more than the first n of a tile can count
                first = np.lexsort((found, -mine))[: self.best.n]
                self.pending.append((np.full(len(first), k), mine[first], found[first]))
        if self.pending:
            self.best.add(*(np.concatenate(c) for c in zip(*self.pending, strict=True)))
            self.pending = []

    def found(self, schema):
        k = self.best.key
        return _table([self.ids[self.of[k]], self.positive[k], self.score[k], self.best.id, self.best.score], schema)


def mine(rows: DataFrame, anchors: str, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Hard negatives of the rows of ``clean`` (vec_id, label, v) that satisfy ``anchors`` (a condition in SQL).

    For each anchor and each of its first ``n_positives`` other rows of the same label, the first ``n_negatives`` rows of another
    label whose score is from ``low`` to ``high`` per cent of the positive's: anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score. Higher scores come first, ties by smaller ids.
    """
    spark = rows.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    most, dim, largest = rows.agg(F.max(norm), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()
    if most is None:
        return spark.createDataFrame([], schema)
    if most >= 2**56:
        raise ValueError("inner products that don't fit 56 bits")
    dim = max(1, dim)
    space = Space(choose_pivots(rows, dim), most, dim, largest or 0)
    x, q = pivot_table(rows, space, False, BLOCK), pivot_table(rows.where(anchors), space, True, ANCHORS)
    n = len(space.pivots)
    sx = _summary(x, n, "x_")
    # anchors' norms bound a block's scores from both sides
    length = q.join(rows.select("vec_id", norm.alias("norm")), "vec_id").groupBy(F.col("block").alias("q_block")).agg(F.max("norm").alias("q_norm1"), F.min("norm").alias("q_norm0"))
    sq = written(_summary(q, n, "q_").join(length, "q_block"), "anchors")

    out = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
    same = _pairs(sq, sx, space, "q_l0 <= x_l1 AND x_l0 <= q_l1")
    found = _met(q.withColumn("none", F.lit(None).cast("int")), x, same, "none", _searching(space, n_positives, Positives, out), "anchor_id long, positive_id long, score long")
    first = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("positive_id").alias("id"))))
    # a task returns at most n_positives rows for an anchor, so a list has as many for each slot
    per = found.groupBy("anchor_id").agg(F.slice(first, 1, n_positives).alias("p"))
    # the least and the greatest whole number within the two shares
    limits = f"transform(p, x -> named_struct('id', x.id, 'score', -x.s, 'lo', (-{low} * x.s + pmod({low} * x.s, 100L)) div 100, 'hi', (-{high} * x.s - pmod(-{high} * x.s, 100L)) div 100))"
    per = written(per.select("anchor_id", F.filter(F.expr(limits), lambda p: p["lo"] <= p["hi"]).alias("positives")), "positives")
    asked = q.join(per.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    asked = written(asked.where(F.size("positives") > 0), "asked")

    limits = asked.groupBy(F.col("block").alias("q_block")).agg(F.min(F.array_min(F.transform("positives", lambda p: p["lo"]))).alias("least"), F.max(F.array_max(F.transform("positives", lambda p: p["hi"]))).alias("greatest"))
    top, slack = f"{space.most!r}D", f"{space.slack!r}D"
    reach = f"(q_norm1 + {top} - power(greatest(near - sqrt({slack}), 0D), 2)) / 2 + {slack} >= least AND (q_norm0 + {top} - power(far + sqrt({slack}), 2)) / 2 - {slack} <= greatest"
    other = _pairs(sq.join(limits, "q_block"), sx, space, f"NOT (q_l0 = q_l1 AND x_l0 = x_l1 AND q_l0 = x_l0) AND {reach}")
    out = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", pa.int64()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])
    negatives = _met(asked, x, other, "positives", _searching(space, n_negatives, Negatives, out), "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ordered = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("negative_score")).alias("s"), F.col("negative_id").alias("id")))), 1, n_negatives)
    result = negatives.groupBy("anchor_id", "positive_id", "positive_score").agg(ordered.alias("n")).select("anchor_id", "positive_id", "positive_score", F.posexplode("n").alias("rank", "n"))
    result = result.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.s")).alias("negative_score"))
    for done in (x, q, sq, found, per, asked):
        drop_written(done)
    return result
