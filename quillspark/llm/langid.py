"""Language identification by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot is a 64-bit mask with a bit per language, and the AND of an
n-gram's slots gives all languages that (seem to) contain it. A text's n-grams are counted per language, each count is
corrected for the language's false positives, and the largest decides.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, utf8, written
from .words import blocks, mix

N = 4
UNKNOWN = "und"
_fold: list[np.ndarray] = []


def folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 for what is no letter."""
    if not _fold:
        out = np.zeros(sys.maxunicode + 2, np.uint32)
        for c in range(sys.maxunicode + 1):
            if unicodedata.category(x := chr(c))[0] == "L":
                out[c] = ord(low) if len(low := x.lower()) == 1 else c
        _fold.append(out)
    return _fold[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of many UTF-8 texts, and at which of them each text begins (one more: the end).

    Runs of other characters count as one gap; a gap stands before and after each text. Every n-gram has a letter.
    """
    text = data.tobytes()
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != lead.sum():  # invalid bytes: text by text
        texts = [text[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    else:
        first = np.concatenate([[0], np.cumsum(lead)])[offsets]
    code = folded()[points]
    n = len(first) - 1
    seq = np.zeros(len(code) + n, np.uint64)  # a gap before each text
    at = np.arange(len(code)) + np.repeat(np.arange(1, n + 1), np.diff(first))
    seq[at] = code
    begin = np.zeros(len(seq), bool)
    begin[first[:-1] + np.arange(n)] = True
    keep = seq != 0
    keep[1:] |= seq[:-1] != 0
    keep |= begin
    kept = np.concatenate([[0], np.cumsum(keep)])
    start = np.append(kept[first[:-1] + np.arange(n)], kept[-1])
    seq = np.concatenate([seq[keep], np.zeros(N, np.uint64)])
    text_of = np.repeat(np.arange(n), np.diff(start))
    m = len(text_of)
    with np.errstate(over="ignore"):
        h, some = np.zeros(m, np.uint64), np.zeros(m, bool)
        end = np.repeat(start[1:], np.diff(start))
        for k in range(N):
            c = np.where(np.arange(m) + k < end, seq[k : k + m], 0).astype(np.uint64)
            h = h * np.uint64(0x9E3779B97F4A7C15) + c
            some |= c != 0
    index = np.concatenate([[0], np.cumsum(some)])
    return mix(h[some]), index[start]


@dataclass
class Filters:
    """The learned filters: languages by bit, the slots (a row for each 64 languages), and each language's false-positive rate."""

    languages: list[str]
    slots: np.ndarray
    wrong: np.ndarray
    probes: int = 3

    @classmethod
    def build(cls, languages: list[str], members: dict[str, np.ndarray], bits: int = 18, probes: int = 3) -> Filters:
        out = cls(languages, np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64), np.zeros(len(languages)), probes)
        for k, lang in enumerate(languages):
            for p in range(probes):
                at = np.unique(out._at(members[lang], p))
                out.slots[k // 64, at] |= np.uint64(1 << k % 64)
        for k in range(len(languages)):
            out.wrong[k] = float(((out.slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) ** probes
        return out

    def _at(self, h: np.ndarray, p: int) -> np.ndarray:
        return ((h >> np.uint64(20 * p)) & np.uint64(self.slots.shape[1] - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, a row for each 64 of them."""
        out = self.slots[:, self._at(h, 0)]
        for p in range(1, self.probes):
            out = out & self.slots[:, self._at(h, p)]
        return out

    def decide(self, h: np.ndarray, start: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share of its n-grams that the language contains, corrected."""
        masks, total = self.masks(h), np.diff(start)
        share = np.zeros((len(self.languages), len(total)))
        for k in range(len(self.languages)):
            sums = np.concatenate([[0], np.cumsum((masks[k // 64] >> np.uint64(k % 64)) & np.uint64(1))]).astype(np.int64)
            hits = np.diff(sums[start])
            share[k] = np.clip((hits - total * self.wrong[k]) / (1 - self.wrong[k]), 0, None) / np.maximum(total, 1)
        if not len(self.languages):
            return [UNKNOWN] * len(total), np.zeros(len(total))
        best = share.argmax(0)
        score = np.clip(share[best, np.arange(len(total))], 0, 1)
        return [self.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), total.tolist(), strict=True)], np.where(total > 0, score, 0.0)


def learn(labelled: DataFrame, max_rows: int = 20_000, least: float = 2e-5, near_best: float = 0.3) -> Filters:
    """Filters from ``labelled(doc_id, text, lang)``.

    The classifier is fitted on about ``max_rows`` different texts: all of them if there are no more, else of each language
    an equal part of ``max_rows``, those with the smallest hash, or all that it has. A language keeps the n-grams
    that are ``least`` of its own and at least ``near_best`` times as frequent as where they are most frequent. The driver
    gets 1 / ``least`` n-grams of a language at most. Languages come by falling number of rows, so ties go to the commoner.
    """
    d = only(labelled, "text", "lang").where("lang IS NOT NULL AND text IS NOT NULL")
    d = d.withColumn("h", F.xxhash64("text"))
    found = d.groupBy("lang", "h").agg(F.count("*").alias("n")).groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).collect()
    sizes, texts = {r["lang"]: r["n"] for r in found}, {r["lang"]: r["texts"] for r in found}
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filters.build([], {})
    if sum(texts.values()) > max_rows:
        # hashes are spread evenly over 64 bits: a bound for each language
        bounds = [(x, min(2**63 - 1, -(2**63) + 2**64 * max_rows // (len(texts) * n))) for x, n in texts.items()]
        d = d.join(F.broadcast(labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")), "lang").where("h <= bound")
    d = d.dropDuplicates(["lang", "h"])

    def count(batches):
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for b in blocks(batch.column(0)):
                h, start = grams(b.data, b.offsets)
                own = np.repeat(langs[b.lo : b.hi], np.diff(start))
                for lang in set(langs[b.lo : b.hi]):
                    keys, n = np.unique(h[own == lang], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    found = written(d.select(utf8("text").alias("text"), "lang").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = found.groupBy("lang").agg(F.sum("n").alias("total"))
    share = found.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * least).withColumn("share", F.col("n") / F.col("total"))  # totals: 64 rows at most
    rows = share.select("lang", "gram", "share").toArrow()
    lang, gram, part_of = np.array(rows.column(0).to_pylist(), object), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    keys, inverse = np.unique(gram, return_inverse=True)
    top = np.zeros(len(keys))
    np.maximum.at(top, inverse, part_of)
    good = part_of >= near_best * top[inverse]
    return Filters.build(languages, {x: gram[good & (lang == x)].view(np.uint64) for x in languages})


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, from its column ``text`` alone.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if nothing was learned. Columns of
    these two names in ``docs`` are replaced; rows that repeat stay.
    """
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            langs, scores = [], []
            for b in blocks(batch.column(at).cast(pa.binary())):
                got = filters.decide(*grams(b.data, b.offsets))
                langs += got[0]
                scores.append(got[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    out = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType())
    return docs.mapInArrow(run, out)


def trainable(docs: DataFrame) -> DataFrame:
    """The rows that a model may learn from: crc32 of the id as text, modulo 4, isn't 2."""
    return docs.where("lang IS NOT NULL AND crc32(cast(doc_id AS string)) % 4 <> 2")


def keep_identified(docs: DataFrame, least: float = 0.15) -> DataFrame:
    """The rows whose language is known with a score of ``least`` or more, with the columns of ``docs``."""
    return predict(docs, learn(trainable(docs))).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*docs.columns)
