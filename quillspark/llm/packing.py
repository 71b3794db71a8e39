"""Best-fit packing of documents into sequences of at most ``capacity`` tokens.

Pattern packing: only the histogram of piece lengths (``capacity`` numbers at most, whatever the corpus) reaches the
driver. Patterns of few pieces that fill a sequence are enumerated, repeat counts are fitted to the histogram by
non-negative least squares, rounded, and what they leave is packed by best fit, again on the histogram. Pieces then
find their place by their rank among the pieces of their length, so no task ever holds all pieces of a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import byte_bpe
from .common import only, utf8, written

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, rank long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of a document's pieces: a document that fits is one; of a longer one only the first is shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))] if n else []


def patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of two to four lengths (0: none) that fill a sequence but for one part in 256 at most, longest first.

    For each length the others are spread over what may stand beside it; the last is the largest that fits.
    """
    have = np.zeros(capacity + 1, np.int64)
    have[lengths] = lengths
    below = np.maximum.accumulate(have)  # the largest length that fits
    a, none = lengths, np.zeros_like(lengths)
    rows = [np.stack([a, below[capacity - a], none, none], 1)]
    for part in range(1, 24):
        b = below[(capacity - a) * part // 24]
        rest = capacity - a - b
        rows.append(np.stack([a, b, below[rest], none], 1))
        for share in (2, 4):
            c = below[rest // share]
            rows.append(np.stack([a, b, c, below[rest - c]], 1))
    found = np.sort(np.concatenate(rows), 1)[:, ::-1]
    return np.unique(found[found.sum(1) >= capacity - capacity // 256], axis=0)


def fit(pats: np.ndarray, hist: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts c >= 0 that minimise |A c - hist|^2, each length weighted by itself (accelerated projected gradient)."""
    weight = np.arange(len(hist)) / len(hist)
    size = len(hist)

    def forward(c):
        out = np.zeros(size)
        for k in range(pats.shape[1]):
            out += np.bincount(pats[:, k], c, size)
        out[0] = 0
        return out * weight

    def back(r):
        r = r * weight
        r[0] = 0
        return sum(r[pats[:, k]] for k in range(pats.shape[1]))

    v = np.ones(len(pats))
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 1 / (norm * 1.02 + 1e-12)
    target = hist * weight
    c = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - target))
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - c)
        c, t = new, t2
    return c


class Bins:
    """Open sequences by the room they have left: kinds (lengths, longest first) and how many there are of each."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
        self.open = np.zeros(capacity + 1, np.int64)

    def put(self, lengths: tuple[int, ...], m: int) -> None:
        room = self.capacity - sum(lengths)
        self.by_room.setdefault(room, []).append((lengths, m))
        self.open[room] += m

    def take(self, room: int, m: int) -> Iterator[tuple[tuple[int, ...], int]]:
        """``m`` of the sequences with this room."""
        self.open[room] -= m
        kinds = self.by_room[room]
        while m:
            lengths, n = kinds.pop()
            if n > m:
                kinds.append((lengths, n - m))
            yield lengths, min(m, n)
            m -= min(m, n)

    def best_fit(self, left: np.ndarray) -> None:
        """Packs the pieces of a histogram, longest first, each into the open sequence with the least room that holds it."""
        for x in np.flatnonzero(left)[::-1].tolist():
            n = int(left[x])
            while n:
                rooms = np.flatnonzero(self.open[x:])
                if not len(rooms):
                    per = self.capacity // x
                    self.put((x,) * min(per, n), max(1, n // per))
                    n -= min(per, n) * max(1, n // per)
                    continue
                room = x + int(rooms[0])
                per = min(n, room // x)  # what one has room for, best fit gives it before it opens the next
                m = min(int(self.open[room]), n // per)
                for lengths, k in list(self.take(room, m)):
                    self.put(lengths + (x,) * per, k)
                n -= per * m

    def rows(self) -> list[tuple[tuple[int, ...], int]]:
        return [(lengths, m) for _, kinds in sorted(self.by_room.items()) for lengths, m in kinds if m]


def plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequence (lengths, longest first) and how many there are of each; every piece of the histogram is used once.

    The fitted counts are rounded down, to the nearest, and up, as far as the pieces go; best fit packs the rest, into what
    patterns leave as into new sequences. Of the three, and of best fit alone, the plan with the fewest sequences is taken.
    """
    hist = hist.astype(np.int64).copy()
    hist[0] = 0
    lengths = np.flatnonzero(hist)
    if not len(lengths):
        return []
    pats = patterns(lengths, capacity)
    fitted = fit(pats, hist) if len(pats) else np.zeros(0)
    order = np.argsort(-pats.sum(1) * 10_000 - pats[:, 0], kind="stable")
    found = []
    for more in (1e-6, 0.5, 1 - 1e-6, None):
        left, bins = hist.copy(), Bins(capacity)
        if more is not None:
            counts = np.floor(fitted + more).astype(np.int64)
            for p in order[counts[order] > 0]:
                kinds, need = np.unique(pats[p][pats[p] > 0], return_counts=True)
                m = int(min(counts[p], (left[kinds] // need).min()))
                if m > 0:
                    left[kinds] -= m * need
                    bins.put(tuple(int(x) for x in pats[p] if x), m)
        bins.best_fit(left)
        found.append(bins.rows())
    return min(found, key=lambda rows: sum(m for _, m in rows))


def slots(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of ranks: key (length * 2^40 + first rank), the first one's sequence, and the offset in it; sorted by key."""
    seen: dict[int, int] = {}
    rows, seq = [], 0
    for lengths, m in packed:
        offset = 0
        for x in lengths:
            rows.append(((x << 40) + seen.get(x, 0), seq, offset))
            seen[x] = seen.get(x, 0) + m
            offset += x
        seq += m
    rows.sort()
    k, s, o = np.array(rows, np.int64).reshape(-1, 3).T
    return k, s, o


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of ``docs(doc_id, text)``, with its rank among the pieces of its length in its partition."""

    def encode(batches):
        from pyspark import TaskContext

        part, ranks = TaskContext.get().partitionId(), [0] * (capacity + 1)
        bpe = byte_bpe(tokenizer)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())])
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, ids, counts in bpe.column(batch.column(1)):
                at, out = 0, []
                for i, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], bpe.dtype.type(end_id)).astype("<u4")
                    at += n
                    for k, (s, length) in enumerate(cut(n + 1, capacity)):
                        out.append((doc_ids[lo + i], k, s, length, zlib.crc32(own[s : s + length].tobytes()), part, ranks[length]))
                        ranks[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce(utf8("text"), F.lit(b"")).alias("text"))
    return d.mapInArrow(encode, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs every piece of ``docs(doc_id, text)``; a null or empty text is the end id alone.

    Repeated rows are packed as often as they occur, ids may be null, other columns are not read, an empty table gives
    no rows. Which of two equally long pieces comes first is arbitrary.
    """
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id), "pieces")
    sizes = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    hist = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # capacity rows at most
        hist[r["length"]] = r["count"]
    key, seq, offset = slots(plan(hist, capacity))

    def place(batches):
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy() + batch.column(6).to_numpy()
            wanted = (length << 40) + rank
            at = np.searchsorted(key, wanted, "right") - 1
            columns = [*batch.columns[:3], pa.array(length), batch.column(4), pa.array(seq[at] + wanted - key[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(base, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "rank", "base")
    return ranked.mapInArrow(place, PLACED)
