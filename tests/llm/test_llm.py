"""The ten operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns; and against plain versions."""

import functools
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe, graph, html_text, langid, licenses, lines, merkle, ngram_join, packing, quality, token_files
from quillspark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, component_id long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed, n):
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[r.integers(12)]}{r.integers(50)}" for _ in range(n))


LONG = "\n".join(prose(k, 200) for k in range(60))
TEXTS = [None, "", " \n\t ", "word", "a b c a b c a b c", prose(1, 80), prose(1, 80), prose(1, 80) + " end", prose(2, 300), LONG, "été ça – 日本語 😀\r\n\nx", "line one is a long line\nline one is a long line\n" + prose(3, 60), "<|endoftext|> mid<|endoftext|>"]


def docs(spark, texts=TEXTS, repeat=False):
    rows = [(k, t, "en" if k % 2 else None, "s", -1, False, -5, -7) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows + rows[3:5] * repeat, SCHEMA)


@functools.cache
def ids_of(path, text, end=True):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(tokenizer_path(path)).encode(text or "", add_special_tokens=False).ids
    return np.array(ids + [0] * end, "<u4")


def test_quality(spark):
    for r in quality.assess(docs(spark, repeat=True)).collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) for k in range(3) if c[tuple(w[i : i + 3])] > 1}
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(own) - len(set(own)), len(covered))
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.assess(docs(spark).limit(0)).count() == 0
    assert quality.keep_good(docs(spark)).columns == docs(spark).columns


def test_rules_are_ordered_by_yield(spark):
    found = quality.order_by_yield(quality.counts(docs(spark)))
    rates = [hit / cost for _, cost, hit in found]
    assert rates == sorted(rates, reverse=True) and {r for r, _, _ in found} == set(quality.RULES)


def test_lines(spark):
    near = "the quick brown fox jumps over the lazy dog near the river bank today"
    d = docs(spark, [near + "\nother text that stays in place here", None, "", near.replace("today", "todax") + "\nshort", near + "\n" + near])
    got = {r.doc_id: r for r in lines.drop_lines(d).collect()}
    assert got[0].text == near + "\nother text that stays in place here" and got[0].n_chars == -1
    assert got[1].text is None and got[2].text == "" and got[3].text == "short" and got[4].text == "" and got[4].n_chars == 0
    assert lines.drop_lines(d.limit(0)).count() == 0


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 1), (5, 4), (7, 7), (None, 3), (9, 8), (8, 4)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 8: 4, 9: 4}
    chain = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    assert graph.components(chain).where("component <> 0").count() == 0
    assert graph.components(chain.limit(0)).count() == 0


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", "nothing"), ("a/y", "x\nLicensed under the Apache License, Version 2.0."), ("c/z", None), (None, "All rights reserved."), ("a/b/x", "nothing"), ("top", "")]
    got = {r.path: (r.own_license, r.inherited_from, r.license) for r in licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, license int")).collect()}
    assert got["a/b/x"] == (None, "a", "MIT") and got["a/y"][0] == "Apache-2.0" and got["c/z"] == got[None] == got["top"] == (None, None, None)
    assert licenses.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_language(spark):
    rows = [(k, f"the and of {prose(k, 40)}" if k % 2 else f"der und nicht {prose(k, 40).upper()}ß ung", "en" if k % 2 else "de") for k in range(80)]
    d = spark.createDataFrame(rows + [(100, None, None), (101, "123 !!", None), (102, "", "en"), (103, "é", None)], "doc_id long, text string, lang string")
    model = langid.learn(langid.trainable(d))
    got = {r.doc_id: r for r in langid.predict(d.withColumn("score", F.lit("x")), model).collect()}
    assert sum(got[k].lang_pred == ("en" if k % 2 else "de") for k in range(80)) >= 78
    assert {got[k].lang_pred for k in (100, 101, 102)} == {"und"} and got[103].lang_pred in ("en", "de")
    empty = langid.learn(d.limit(0))
    assert {r.lang_pred for r in langid.predict(d, empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.predict(d, langid.learn(langid.trainable(d))).where("crc32(cast(doc_id AS string)) % 4 = 2")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()


def test_filters_have_no_misses():
    r = np.random.default_rng(1)
    members = {x: r.integers(0, 2**63, 500, dtype=np.uint64) for x in "ab"}
    f = langid.Filters.build(["a", "b"], members)
    assert (f.masks(members["a"]) & np.uint64(1)).all() and (f.masks(members["b"]) & np.uint64(2)).all()


def test_token_files(spark):
    d = docs(spark, repeat=True)
    got = sorted(token_files.tokens_on_disk(d, tokenizer_path("byte_bpe_50k.json"), length=64).collect(), key=lambda r: r.start)
    at = 0
    for r in got:
        want = ids_of("byte_bpe_50k.json", TEXTS[r.doc_id])
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) == len(TEXTS) + 2
    assert token_files.tokens_on_disk(d.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_ngram_join(spark):
    d = docs(spark, repeat=True)
    sets = {}
    for k, t in enumerate(TEXTS):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    root = {k: min([j for j in sets if sets[k] and sets[j] and 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j])], default=k) for k in sets}
    for r in ngram_join.link_components(d).collect():
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root[r.doc_id])
    assert ngram_join.link_components(d.limit(0)).count() == 0
    assert ngram_join.keep_one(docs(spark)).count() == len({*root.values()})


def test_ngram_join_chains_and_groups(spark):
    """Chains whose ends aren't alike, and a group of more near copies than a signature may have nodes."""
    base = prose(9, 200).split()
    chain = [" ".join(base[3 * k : 3 * k + 120]) for k in range(12)]
    group = [" ".join([*base[:150], f"tail{k}"]) + " z" for k in range(80)]
    own = {r.doc_id: r.component_id for r in ngram_join.link_components(docs(spark, chain + group)).collect()}
    texts = chain + group
    sets = [{*zip(*[t.split()[k:] for k in range(5)], strict=False)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert own == {k: find(k) for k in range(len(texts))}


def test_fingerprints(spark):
    got = sorted(merkle.fingerprints(docs(spark)).collect(), key=lambda r: r.doc_id)
    for k, r in enumerate(got):
        t, n = TEXTS[k] or "", TEXTS[(k + 1) % len(TEXTS)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (k, len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert got[5].fingerprint == got[6].fingerprint != got[7].fingerprint and got[5].near_next == 1
    assert merkle.fingerprints(docs(spark).limit(0)).count() == 0
    assert merkle.fingerprints(docs(spark, ["only one. text"])).first().near_next == 1


def test_merkle_locates_edits():
    a = "\n".join(f"paragraph {k} is here, with words." for k in range(40))
    x, y = merkle.tree(a), merkle.tree(a.replace("paragraph 17 is", "paragraph 17 was"))
    (place,) = merkle.differing(x, y)
    flat = [(s, p) for s, ps in enumerate(x.paragraphs) for p in range(len(ps))]
    assert flat.index(place) == 17 and merkle.differing(x, x) == []


def test_bpe(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for r in bpe.encode_decode(docs(spark, repeat=True), tokenizer_path("word_bpe_49k.json")).collect():
        ids = tok.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a&amp;b  c\n<b>d</b>e<br>f", "a&b c def".replace("def", "de f")),
        ("<nav>menu</nav><article><h1>T</h1><p>one<p>two<div class='ad'>x</div><script>var a='</p>';</script></article><footer>f</footer>", "T one two"),
        ("<article><p>x</p><section id=comments><p>bad</p></section><form><p>no</p></form></article><aside>s</aside>", "x"),
        ("<article><p>5 < 6 <!-- c --> ok</article", "5 < 6 ok"),
    ],
)
def test_html(page, want):
    assert html_text.main_text(page) == want


def test_html_rows(spark):
    d = spark.createDataFrame([(1, "u", None, 1), (None, None, "<p>a", 2), (1, "u", None, 1)], "page_id long, url string, html string, text int")
    assert sorted((r.text, r.n_chars) for r in html_text.extract(d).collect()) == [("", 0), ("", 0), ("a", 1)]


def test_packing(spark):
    for capacity in (64, 2048):
        got = packing.pack(docs(spark, repeat=True), tokenizer_path("byte_bpe_50k.json"), capacity).collect()
        n = {}
        for r in got:
            ids = ids_of("byte_bpe_50k.json", TEXTS[r.doc_id])[r.start : r.start + r.length]
            assert len(ids) == r.length <= capacity and zlib.crc32(ids.tobytes()) == r.ids_crc32
            n.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for own in n.values():
            at = 0
            for o, length in sorted(own):
                assert o == at
                at += length
            assert at <= capacity
        total = sum(len(ids_of("byte_bpe_50k.json", t)) for t in [*TEXTS, *TEXTS[3:5]])
        assert sum(r.length for r in got) == total and len(n) <= -(-total // capacity) + 1
    assert packing.pack(docs(spark).limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_plan_uses_every_piece():
    r = np.random.default_rng(5)
    hist = np.bincount(r.integers(1, 301, 20_000), minlength=301)
    used = np.zeros(301, np.int64)
    packed = packing.plan(hist, 300)
    for lengths, m in packed:
        assert sum(lengths) <= 300
        for x in lengths:
            used[x] += m
    assert (used == hist).all() and sum(m for _, m in packed) <= 1.01 * (hist * np.arange(301)).sum() / 300 + 1


def test_store_stays_bounded():
    from quillspark.llm.words import Store

    store, rng = Store([np.dtype(np.uint64)], 12), np.random.default_rng(5)
    for _ in range(200):
        h = rng.integers(1, 2**63, 500, dtype=np.uint64)
        h = np.concatenate([h, h[:100]])
        found, lengths = store.gather(store.lookup(h, lambda at: [[h[a : a + 1] for a in at]]))  # noqa: B023
        assert (found == h).all() and (lengths == 1).all()
    assert store.bits == 12 and store.n <= 1 << 10
