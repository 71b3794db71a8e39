"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

Leaves are clauses (up to and with their punctuation), a paragraph is a line, and a section ends after a paragraph whose
digest says so, so an edit moves no boundary but its own. Equal roots mean equal texts; where roots differ, only the
branches that differ are followed to find the edits. A fingerprint is the tree written out with short digests.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, written

CLAUSE = re.compile(r"[^.!?,;:|\n]+[.!?,;:|]*[^\S\n]*|[.!?,;:|]+[^\S\n]*")
#: One paragraph in so many ends a section.
SECTION = 8
COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


@dataclass
class Tree:
    """Digests: the root, each section's, each section's paragraphs', each paragraph's leaves."""

    root: bytes
    sections: list[bytes]
    paragraphs: list[list[bytes]]
    leaves: list[list[list[bytes]]]

    @property
    def fingerprint(self) -> str:
        """The root, and for each section its digest and its paragraphs, each the digests of its leaves."""
        below = (s.hex()[:8] + ",".join([b"".join([x[:4] for x in p]).hex() for p in ps]) for s, ps in zip(self.sections, self.leaves, strict=True))
        return self.root.hex() + ":" + "/".join(below)


def _node(kind: bytes, below: list[bytes]) -> bytes:
    return hashlib.blake2b(b"".join(below), digest_size=16, person=kind).digest()


def tree(text: str) -> Tree:
    """The tree of a whole text; an empty text is one section of one paragraph without leaves."""
    sections, paragraphs, leaves = [], [], []
    own, own_leaves = [], []
    digest = xxhash.xxh3_128_digest
    lines = text.split("\n")
    for k, line in enumerate(lines):
        below = [digest(c) for c in CLAUSE.findall(line)]
        own.append(p := _node(b"paragraph", below))
        own_leaves.append(below)
        if p[0] % SECTION == 0 or k + 1 == len(lines):
            sections.append(_node(b"section", own))
            paragraphs.append(own)
            leaves.append(own_leaves)
            own, own_leaves = [], []
    return Tree(_node(b"root", sections), sections, paragraphs, leaves)


def _unmatched(a: list[str], b: list[str], name) -> tuple[list[str], list[str]]:
    """The branches of either side that the other hasn't, by their names; a branch that repeats is matched as often as both have it."""
    left = Counter(map(name, b))
    mine = []
    for x in a:
        if left[name(x)] > 0:
            left[name(x)] -= 1
        else:
            mine.append(x)
    own = Counter(map(name, mine))
    rest, theirs = Counter(map(name, b)) - (Counter(map(name, a)) - own), []
    for x in b:
        if rest[name(x)] > 0:
            rest[name(x)] -= 1
            theirs.append(x)
    return mine, theirs


def likeness(a: str, b: str) -> float:
    """Of two fingerprints: 1 where the roots agree, else the share of leaves that they have in common (Dice).

    Only branches that differ are followed: sections of one digest are alike, of the others the paragraphs are compared,
    and of paragraphs that differ the leaves.
    """
    if a[:32] == b[:32]:
        return 1.0
    total = a.count("/") + a.count(",") + 2, b.count("/") + b.count(",") + 2
    leaves = lambda f, marks: (len(f) - 33 - (marks - 2) - 8 * (f.count("/") + 1)) // 8
    n = leaves(a, total[0]) + leaves(b, total[1])
    x, y = _unmatched(a[33:].split("/"), b[33:].split("/"), lambda s: s[:8])
    x, y = _unmatched([p for s in x for p in s[8:].split(",")], [p for s in y for p in s[8:].split(",")], lambda p: p)
    x, y = (Counter(p[k : k + 8] for p in side for k in range(0, len(p), 8)) for side in (x, y))
    differ = (x - y).total() + (y - x).total()
    return (n - differ) / n if n else 0.0


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """Where ``a`` was edited: section and paragraph of each paragraph that ``b`` hasn't, following differing branches only."""
    if a.root == b.root:
        return []
    whole = Counter(b.sections)
    rest, out = [], []
    for k, s in enumerate(a.sections):
        if whole[s] > 0:
            whole[s] -= 1
        else:
            rest.append(k)
    left = Counter(p for s, ps in zip(b.sections, b.paragraphs, strict=True) if whole[s] > 0 for p in ps)
    for k in rest:
        for j, p in enumerate(a.paragraphs[k]):
            if left[p] > 0:
                left[p] -= 1
            else:
                out.append((k, j))
    return out


def compare(doc_id, text: str, own: str, following: str, next_print: str) -> tuple:
    """The result row of a text, its fingerprint, and the next text with its fingerprint."""
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    print_ = tree(edited).fingerprint
    return doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest(), own, print_, likeness(own, print_), likeness(own, next_print)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints every text of ``docs(doc_id, text)`` and its edited text, whose end is the next document's beginning.

    Null texts are empty ones. Documents are sorted by id, null ids first and rows of one id by text; the last is followed
    by the first. An empty table gives no rows. Other columns are not read. A task compares the documents of one range of
    ids; only the last and first of each range are joined afterwards, by the ranges' numbers.
    """
    d = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    schema = "part int, kind int, text string, " + COLUMNS
    names = [x.split()[0] for x in schema.split(", ")]
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        edge = lambda kind, doc, text, own: (part, kind, text, doc, None, None, own, None, None, None)
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                out = []
                some = batch.slice(lo, 1000)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                    own = tree(text).fingerprint
                    out.append((part, 0, None, *compare(*last, text, own)) if last else edge(1, doc, text, own))
                    last = (doc, text, own)
                yield batch_of(out)
        if last:
            yield batch_of([edge(2, *last)])

    found = written(d.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, schema), "fingerprints")
    edges = found.where("kind > 0").select("part", "kind", "text", "doc_id", "fingerprint")
    parts = sorted(r.part for r in edges.where("kind = 2").select("part").collect())  # a number for each range
    if not parts:
        return found.select(*names[3:])
    after = docs.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, after int")
    firsts = edges.where("kind = 1").selectExpr("part AS after", "text AS following", "fingerprint AS next_print")
    joined = edges.where("kind = 2").drop("kind").join(after, "part").join(firsts, "after").select("doc_id", "text", "fingerprint", "following", "next_print")

    def close(batches):
        for batch in batches:
            rows = [compare(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[3:], strict=True)], names=names[3:])

    return found.where("kind = 0").select(*names[3:]).unionByName(joined.mapInArrow(close, COLUMNS))
