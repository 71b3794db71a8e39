"""The prefix trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from quillspark.llm import trie


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - c % 20, [])[:h] + v[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out, leaves, saved, children = {}, defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        words = len(k[-1][1].translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " ", 0x1C: "x", 0x85: "x", 0xA0: "x"}).split(" ")) - k[-1][1].translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ").count("") if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * words
    for k, m in members.items():
        ends = ",".join(str(c) for c in m if len(built[c]) == len(k))
        out[k] = (m[0], len(k), members[k[:-1]][0] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=repr)


def run(spark, rows):
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, d int, k1 int")
    return sorted((tuple(r) for r in trie.prefix_trie(d).collect()), key=repr)


def conversations(seed, n, deepest):
    r = random.Random(seed)
    texts = ["hello you", "", None, "a b\tc\nd", "é   x", "why", " two  words "]
    out = []
    for c in range(n):
        k = r.choice([1, 2, 3, 5, deepest])
        out += [(c * r.choice([1, 1, 7]) if c % 9 else c, r.choice([None, t, t, t]), r.choice(["user", "assistant", None]), r.choice(texts[:3] if t < 2 else texts)) for t in range(k)]
    return out


@pytest.mark.parametrize("piece", [3, 4096])
def test_trie_is_that_of_plain_python(spark, monkeypatch, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    monkeypatch.setattr(trie, "ENDS", 8 * piece)
    monkeypatch.setattr(trie, "HOT", 4 * piece)
    rows = conversations(piece, 120, 12) + [(None, 1, "user", "x"), (40, 5, "user", "again"), (40, 5, "user", "again"), (41, 5, "user", "again" * 30_000)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(2)]
    assert run(spark, rows) == plain(rows)


def test_trie_of_one_long_conversation_of_turnless_ones_and_of_none(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(3, t, "user", f"turn {t % 5}") for t in range(300)] + [(23, t, "user", f"turn {t % 5}") for t in range(290)] + [(25, 0, "user", "x")]
    assert run(spark, rows) == plain(rows)
    # conversations that give up their only turns and whose group has no first one
    alone = [c for c in range(100, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:5]
    rows = [(c, 0, "user", "gone") for c in alone]
    assert run(spark, rows) == plain(rows) and len(plain(rows)) == 1
    assert run(spark, []) == []


def test_tables_of_parts_merge_to_the_table_of_all(spark):
    rows = conversations(4, 60, 6)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    paths = trie.with_digests(trie.rebuilt(trie.ranked(d)))
    halves = [trie.merge(trie.partial(paths.where(f"conv_id % 2 = {k}"))) for k in (0, 1)]
    columns = halves[0].columns
    assert sorted(trie.merge(halves[0].unionByName(halves[1])).select(columns).collect()) == sorted(trie.merge(trie.partial(paths)).select(columns).collect())
