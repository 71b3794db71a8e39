"""What a whole job covers: each test failed while an operator did less."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import html_text, langid, licenses, lines, merkle, ngram_join, packing, quality
from quillspark.llm.bpe import forced_bpe
from quillspark.llm.chunks import byte_bpe
from quillspark.llm.queries import tokenizer_path
from quillspark.llm.words import Store, blocks


def resembling(seed, n, lengths):
    """Pairs of lines, differing at an end or by a number in front, with an exact similarity of 0.8 or more."""
    r = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    shingles = lambda t: {t[i : i + 5] for i in range(max(1, len(t) - 4))}
    out = []
    while len(out) < n:
        a = "".join(r.choice(letters + "    ") for _ in range(r.randint(*lengths)))
        b = r.choice(["#" + a[1:], "3. " + a, a[:-1] + "#", "#" + a[1:-1] + "#"])
        x, y = shingles(a), shingles(b)
        if a.strip() and 100 * len(x & y) >= 80 * len(x | y):
            out.append((a, b))
    return out


def test_lines_that_resemble_are_found(spark):
    pairs = resembling(3, 400, (20, 80))
    d = spark.createDataFrame([(2 * k + i, t) for k, p in enumerate(pairs) for i, t in enumerate(p)], "doc_id long, text string")
    missed = {2 * k + 1 for k in range(len(pairs))} - {r.doc_id for r in lines.dropped(d).collect()}
    assert len(missed) <= 4


def test_short_lines_take_part(spark):
    d = spark.createDataFrame([(0, "ok\n \na line that stays where it is"), (1, "ok\nOK\n\n "), (2, "été 😀\nok"), (3, "été 😀")], "doc_id long, text string")
    assert sorted(lines.dropped(d).collect()) == [(1, 0), (2, 1), (3, 0)]


PROSE = "The ship was on its way to the island when the storm came, and all that was left of it in the end was a part of the mast."


def test_html_teasers_and_long_text_outside_of_the_mark():
    teaser = "<article><h3>Other story</h3><a href=x>read the whole of it here</a></article>"
    body = "".join(f"<p>{PROSE} {k}" for k in range(4))
    assert html_text.main_text(f"<div>{body}</div>{teaser}") == " ".join(f"{PROSE} {k}" for k in range(4))
    assert html_text.main_text(f"<article>{body}</article><div>{PROSE} {PROSE}</div><div>imprint</div>") == " ".join([*(f"{PROSE} {k}" for k in range(4)), PROSE, PROSE])
    list_of_links = "<ul>" + "<li><a href=x>some other page</a>" * 5 + "</ul>"
    assert html_text.main_text(f"<div>{list_of_links}{body}</div>") == " ".join(f"{PROSE} {k}" for k in range(4))


def test_html_other_languages_and_compound_names():
    russian = "Корабль шёл к острову, когда началась буря, и от него осталась только часть мачты, которую потом нашли на берегу рыбаки."
    chinese = "这艘船在驶往岛屿的途中遇到了暴风雨，最后只剩下一截桅杆，后来被渔民在岸边找到并带回了村子里保存起来。"
    menu = "<div>" + "<div><a href=x>page</a></div>" * 6 + "</div>"
    for text in (russian, chinese):
        assert html_text.main_text(f"{menu}<div><p>{text}</p><p>{text}</p></div>") == f"{text} {text}"
    assert html_text.main_text(f"{menu}<p>short one</p>") == "short one"
    for name in ("content with-sidebar", "no-sidebar", "post_no-comments"):
        assert html_text.main_text(f'<div class="{name}"><p>{PROSE}</p><p>{PROSE}</p></div>') == f"{PROSE} {PROSE}"
    assert html_text.main_text(f'<div class="no-sidebar"><p>{PROSE}<p>{PROSE}<div class=comment-list><p>{PROSE}</div></div><div id=site-footer>imprint') == f"{PROSE} {PROSE}"


def test_license_headers(spark):
    mpl = "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed with this\n// file, You can obtain one at https://mozilla.org/MPL/2.0/.\n\nint main() { return 0; }"
    gpl = "/*\n    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n*/\nint x;"
    rows = {"a.c": mpl, "b.c": gpl, "c.py": "# SPDX-License-Identifier: Apache-2.0\nimport os", "d.c": "/* Copyright (c) 2020 Foo Inc. All rights reserved. */\nint y;", "COPYING": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", "e/LICENSE": "MIT License\n\nCopyright (c) 2020 Foo\n\n" + licenses._MIT, "f.c": "int main() { return 0; }"}
    got = {r.path: r.own_license for r in licenses.scan(spark.createDataFrame([*rows.items()], "path string, text string")).collect()}
    assert got == {"a.c": "MPL-2.0", "b.c": "GPL-3.0", "c.py": "Apache-2.0", "d.c": "proprietary", "COPYING": "GPL-3.0", "e/LICENSE": "MIT", "f.c": None}


def test_every_link_is_counted(spark):
    r = random.Random(9)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(150)]
    texts = [" ".join([*base, f"tail{k}", "z"]) for k in range(80)] + [" ".join(base[:130])] * 2 + ["", "other words", None]
    sets = [{*zip(*[t.split()[k:] for k in range(5)], strict=False)} or {tuple(t.split())} - {()} for t in (t or "" for t in texts)]
    want = [sum(i != j and bool(x) and 100 * len(x & y) >= 80 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    d = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.n_links for r in ngram_join.count_links(d).collect()} == dict(enumerate(want)) and want[0] == 81


def test_groups_across_batches_stay_whole(spark):
    r = random.Random(4)
    base = [[f"w{r.randint(0, 10**6)}" for _ in range(60)] for _ in range(6)]
    d = spark.createDataFrame([(2 * k + i, " ".join([*b, f"tail{i}"])) for k, b in enumerate(base) for i in range(2)], "doc_id long, text string")
    found = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (10_000, 1, 2, 3):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found.append(sorted((x.signature, x.node) for x in ngram_join.shared_signatures(d, 80).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    print("groups of", [len(x) for x in found])
    assert found[0] and all(x == found[0] for x in found)


def test_rare_languages_are_learned(spark):
    r = random.Random(6)
    word = lambda letters: "".join(r.choice(letters) for _ in range(5))
    rows = [(k, " ".join(word("abcdefg") for _ in range(20)), "aa") for k in range(3000)] + [(5000 + k, "same text " * 9, "aa") for k in range(2000)]
    rare = [(9000 + k, " ".join(word("nopqrst") for _ in range(20)), "bb") for k in range(20)]
    d = spark.createDataFrame(rows + rare, "doc_id long, text string, lang string")
    got = langid.predict(spark.createDataFrame(rare, d.schema), langid.learn(d, max_rows=60)).collect()
    assert all(x.lang_pred == "bb" and x.score > 0.5 for x in got)


def thue_morse(n, letters="ab"):
    """Two words of ``n`` letters that collide under any polynomial hash modulo a power of two."""
    bits = [k.bit_count() & 1 for k in range(n)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


def test_words_that_collide_are_told_apart(spark):
    from tokenizers import Tokenizer

    texts = [*thue_morse(1024), *thue_morse(4096), "it\u2019s \u201cquoted\u201d \u2013 and\u2026", "x\u2003y\u2028z \u202f1", "\u00e9" * 9, "seventeen-letters", "sixteen-letters!", ""]
    column = pa.array([t.encode() for t in texts])
    for path, run in (("byte_bpe_50k.json", lambda b: byte_bpe(tokenizer_path("byte_bpe_50k.json")).block(b)), ("word_bpe_49k.json", lambda b: (lambda x: (x[0], np.diff(x[1])))(forced_bpe(tokenizer_path("word_bpe_49k.json")).block(b)[0]))):
        tok = Tokenizer.from_file(tokenizer_path(path))
        ids, n = run(next(blocks(column)))
        assert [x.tolist() for x in np.split(ids, np.cumsum(n))[:-1]] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    d = spark.createDataFrame([*enumerate(texts[:4])], "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in ngram_join.link_components(d).collect())


def test_equal_hashes_are_told_apart():
    store = Store([np.dtype(np.uint64)], 12)
    h, words = np.full(6, 7, np.uint64), np.array([1, 2, 3, 1, 2, 3], np.uint64)
    for _ in range(2):
        found, _ = store.gather(store.lookup(h, lambda at: [[words[a : a + 1] for a in at]], [words, words, words]))
        assert (found == words).all()


@pytest.mark.parametrize(("name", "capacity"), [("even", 300), ("wide", 2048), ("lognormal", 2048), ("middle", 2048)])
def test_plan_is_no_worse_than_best_fit(name, capacity):
    r = np.random.default_rng(5)
    pieces = {"even": lambda: r.integers(1, 301, 20_000), "wide": lambda: r.integers(1, 2049, 20_000), "lognormal": lambda: np.clip(r.lognormal(6, 1, 20_000), 1, 2048).astype(int), "middle": lambda: r.integers(500, 1201, 20_000)}[name]()
    hist = np.bincount(pieces, minlength=capacity + 1)
    bins = packing.Bins(capacity)
    bins.best_fit(hist)
    got = sum(m for _, m in packing.plan(hist, capacity))
    assert got <= sum(m for _, m in bins.rows()) and got <= 1.01 * pieces.sum() / capacity + 1


def test_best_fit_is_best_fit():
    r = np.random.default_rng(8)
    pieces = np.concatenate([r.integers(1, 100, 400), r.integers(20, 40, 300)])
    rooms = []
    for x in np.sort(pieces)[::-1].tolist():
        fits = [(room, k) for k, room in enumerate(rooms) if room >= x]
        if not fits:
            rooms.append(100)
        rooms[min(fits)[1] if fits else -1] -= x
    bins = packing.Bins(100)
    bins.best_fit(np.bincount(pieces, minlength=101))
    assert sorted(100 - sum(p) for p, m in bins.rows() for _ in range(m)) == sorted(rooms)


def test_lines_of_an_id_that_repeats(spark):
    x, y = "first line that is found nowhere else at all", "another line, found in two of the documents"
    d = spark.createDataFrame([(1, y), (5, x), (5, y), (7, x + "\n" + x)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.drop_lines(d).collect())
    assert got == [(1, y), (5, ""), (5, x), (7, "")]


def test_lines_against_brute_force(spark):
    """Components of lines of every length, chains, long runs of one letter and ties at the threshold."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8)))
    texts = []
    for n in [3, 5, 9, 14, 30, 60, 120, 400]:
        for _ in range(6):
            base = [word() for _ in range(n)]
            texts.append(" ".join(base))
            for _ in range(3):
                now = list(base)
                for _ in range(max(1, n // 25)):
                    now[r.randrange(n)] = word()
                texts.append(" ".join(now))
    texts += ["-" * 10, "-" * 500, "-" * 4000, "ok", "OK", "\U0001f600\U0001f601\U0001f602\U0001f603\U0001f604 ab", "abcdefghi", "abcdefghij"]
    texts += [" ".join(f"w{k}x{j}" for k in range(40)) for j in (1, 2)]
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
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
    want = {(k, 0) for k in range(len(texts)) if find(k) != k}
    got = {tuple(x) for x in lines.dropped(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert not got - want and len(got) >= 0.97 * len(want) and len(want) > 60


def test_short_circuit_keeps_what_no_rule_rejects(spark):
    from pyspark.sql import functions as F

    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "1 2 " * 60), (-4, "ABC " * 70), (-5, "a b c d e f g " * 30)], "doc_id long, text string")
    d = d.unionByName(odd, allowMissingColumns=True).withColumn("n_words", F.lit("clash")).withColumn("__by", F.lit(1))
    want = sorted(r.doc_id for r in quality.assess(d.drop("n_words")).select("doc_id", "kept").collect() if r.kept)
    got = quality.keep_good(d)
    assert got.columns == d.columns and sorted(r.doc_id for r in got.collect()) == want and {r.n_words for r in got.collect()} == {"clash"}
    assert quality.keep_good(d.limit(0)).count() == 0


def test_likeness_through_the_tree_counts_every_common_leaf():
    from collections import Counter

    r = random.Random(5)
    line = lambda: " ".join(f"clause {r.randint(0, 60)}," for _ in range(r.randint(0, 5)))
    for _ in range(60):
        a = [line() for _ in range(r.randint(1, 40))]
        b = [x for x in a if r.random() < 0.8] + [line() for _ in range(r.randint(0, 6))]
        x, y = "\n".join(a), "\n".join(b)
        own, other = (Counter(merkle.CLAUSE.findall(t.replace("\n", "\n"))) for t in (x, y))
        n = own.total() + other.total()
        want = 1.0 if x == y else 2 * (own & other).total() / n if n else 0.0
        assert abs(merkle.likeness(merkle.tree(x).fingerprint, merkle.tree(y).fingerprint) - want) < 1e-9


def test_more_than_64_languages(spark):
    r = random.Random(7)
    letters = [chr(0x4E00 + k) for k in range(700)]
    rows = [(100 * k + j, "".join(r.choice(letters[10 * k : 10 * k + 10]) for _ in range(40)), f"l{k:02d}") for k in range(70) for j in range(4)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(d, langid.learn(d)).collect()
    assert sum(x.lang_pred == x.lang for x in got) == len(rows)


def test_language_counts_against_exact_sets(spark):
    """What the filters count, less their false positives, is close to exact n-gram sets of the same texts."""
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL")
    model = langid.learn(d, least=0, near_best=0)
    rows = [(x.text, x.lang) for x in d.select("text", "lang").collect()]
    sets = {}

    def grams(text):
        s = " " + "".join(c.lower() if c.isalpha() else " " for c in text) + " "
        s = " ".join(s.split())
        s = f" {s} " if s else ""
        return [s[i : i + 4].ljust(4) for i in range(len(s)) if s[i : i + 4].strip()]

    for text, lang in rows:
        if lang is not None:
            sets.setdefault(lang, set()).update(grams(text))
    got = {x.text: x for x in langid.predict(d.select("text"), model).collect()}
    for text, _ in rows[:60]:
        g = grams(text)
        share = {k: sum(x in s for x in g) / max(1, len(g)) for k, s in sets.items()}
        if g and got[text].lang_pred != "und":
            assert got[text].score >= max(share.values()) - 0.05 and share[got[text].lang_pred] >= max(share.values()) - 0.05


def test_headers_equal_plain_cosines(spark):
    import re
    from collections import Counter
    from math import sqrt

    rows, weights, other = licenses.whole_templates()
    weights = dict(weights)
    texts = [t for _, t in licenses.HEADERS[:16]] + [licenses._MIT + " extra word" * k for k in (5, 20, 60, 200)] + ["the of and to " * 4000, "no notice at all", "a\n" * 300]
    files = [(f"{k}/LICENSE", t) for k, t in enumerate(texts)] + [("0/LICENSE", texts[0])] * 2 + [("x", None), (None, texts[0]), ("y", "")]
    templates = {}
    for k, lic, word, weight in rows:
        templates.setdefault((k, lic), {})[word] = weight
    want = {}
    for path, t in files:
        if path and t:
            w = {x: n * weights.get(x, other) for x, n in Counter(re.findall("[a-z0-9]+", t.lower())).items()}
            norm = sqrt(sum(x * x for x in w.values()))
            scores = [(sum(w.get(x, 0) * y for x, y in v.items()) / norm, lic) for (_, lic), v in templates.items()]
            if max(scores)[0] >= licenses.THRESHOLD:
                want[path] = round(max(scores)[0], 5)
    got = {r.path: round(r.score, 5) for r in licenses.header_notices(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got.keys() == want.keys() and len(got) < len(texts)
    assert all(abs(got[p] - want[p]) < 2e-5 for p in want)


def test_rules_after_a_rejection_are_not_evaluated(spark):
    d = spark.createDataFrame([(1, "few words"), (2, "the ship and its mast " * 30 + "Zz"), (3, "X" * 3 + " WORD" * 60), (4, None)], "doc_id long, text string")
    counted = quality.counts(d)
    rules = [quality.BASE[0], quality.Rule("boom", "n_capitals > 1000 OR raise_error('reached') IS NOT NULL", ("words", "capitals"))]
    # a row that the first rule rejects never reaches the second
    few = quality.cascade(counted.where("n_words < 50"), rules, quality.LAZY).collect()
    assert {r.rejected_by for r in few} == {"few_words"}
    with pytest.raises(Exception, match="reached"):
        quality.cascade(counted, rules, quality.LAZY).collect()
    got = {r.doc_id: r.rejected_by for r in quality.assess(d, quality.RULES[:1] + quality.RULES[5:]).collect()}
    assert got.pop(4) in ("few_words", "no_letters") and got == {1: "few_words", 2: None, 3: "capitals"}
