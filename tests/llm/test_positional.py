"""The positional index against plain Python."""

import hashlib
import random
import re

from quillspark.llm import positional

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, size=10):
    windows = {}
    for i, t in items:
        w = plain_words(t)
        if i is not None and w:
            n = min(size, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = []
    for doc, t in docs:
        w, hit, ids = plain_words(t), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, word string, pos int, term int")
    i = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, item int")
    return sorted((tuple(r) for r in positional.contamination(d, i).collect()), key=repr)


def test_contamination_is_that_of_a_plain_search(spark):
    r = random.Random(5)
    vocabulary = ["a", "b", "c", "É", "é", "zug", "Zug", "x9", "漢字", "the"]
    text = lambda n: "".join(r.choice(vocabulary) + r.choice([" ", ", ", "\n", "--", "\x00"]) for _ in range(n))
    items = [(k, text(r.randint(0, 30))) for k in range(60)] + [(None, text(20)), (3, text(12)), (61, None), (62, ""), (63, "Zug"), (64, "zug zug zug zug zug zug zug zug zug zug zug zug"), (65, "nowhere is this word"), (9, "the the")]
    docs = [(k, text(r.randint(0, 80))) for k in range(80)]
    for k in range(40):  # passages of items, whole and cut, copies, several in one text
        words = plain_words(items[k][1])
        cut = words[r.randint(0, 3) : len(words) - r.randint(0, 3)]
        docs.append((100 + k, text(r.randint(0, 9)) + " " + " ".join(cut).upper() + " ." * r.randint(0, 4) + text(r.randint(0, 9)) + " ".join(cut)))
    docs += [(200, None), (201, ""), (202, " .,"), (None, "zug zug zug"), (203, docs[100][1]), (203, docs[100][1]), (203, docs[101][1]), (204, "zug " * 5000), (205, "q" * 100_000 + " zug")]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == plain([(1, "a b")], [])


def test_words_in_proximity(spark):
    r = random.Random(7)
    docs = [(k, " ".join(r.choice("abcdefgh") for _ in range(60))) for k in range(30)] + [(99, None), (98, "a a b")]
    items = [(0, "a b c"), (1, "d d d"), (2, "a b c d e f g h"), (3, "a nowhere"), (4, None), (5, "h A")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    words = positional.item_words(spark.createDataFrame(items, "item_id long, text string"))
    terms = positional.vocabulary(words)
    postings = positional.index(d, terms)
    counts = {}
    for _, t in docs:
        for w in plain_words(t):
            counts[w] = counts.get(w, 0) + 1
    number = {x.word: x.term for x in terms.collect()}
    for within in (1, 3, 9):
        want = set()
        for doc, t in docs:
            w = plain_words(t)
            for i, bag in ((i, set(plain_words(x))) for i, x in items if x):
                rarest = min(bag, key=lambda x: (counts.get(x, 0), number[x]))
                for k in range(len(w)):
                    if bag <= set(w[k : k + within]):
                        want |= {(doc, i, p) for p in range(k, min(len(w), k + within)) if w[p] == rarest}
        assert {(x.doc_id, x.item_id, x.pos) for x in positional.proximity(postings, words, terms, within).collect()} == want


def test_all_tokens_can_be_stored_and_the_index_needs_no_python(spark):
    d = spark.createDataFrame([(1, "one two one"), (2, "Two")], "doc_id long, text string")
    every = positional.vocabulary(d.selectExpr("explode(split(lower(text), ' ')) AS word"))
    postings = positional.index(d, every).join(every, "term")
    assert sorted((r.word, r.doc_id, r.pos) for r in postings.collect()) == [("one", 1, 0), ("one", 1, 2), ("two", 1, 1), ("two", 2, 0)]
    plan = positional.contamination(d, d.selectExpr("doc_id AS item_id", "text"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
