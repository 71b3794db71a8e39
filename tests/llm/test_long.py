"""Very long words and deep nests take time in proportion."""

import random
import time

from quillspark.llm import html_text
from quillspark.llm.bpe import forced_bpe
from quillspark.llm.queries import tokenizer_path


def test_long_words_before_a_forced_cut():
    b, r = forced_bpe(tokenizer_path("word_bpe_49k.json")), random.Random(1)
    texts = ["a" * 200_000 + "jqb", "".join(r.choice("acgt") for _ in range(200_000)) + "jqb", "zq" * 50_000]
    texts += ["".join(r.choice("abcdeghijklmnopqrstuvwxyzéß12'-漢") for _ in range(r.choice((3, 24, 25, 26, 60, 200)))) for _ in range(2000)]
    began = time.perf_counter()
    found = [b.chunk(t) for t in texts]
    assert time.perf_counter() - began < 10
    assert found == [b.tok.encode(t, add_special_tokens=False).ids for t in texts]


PROSE = "The ship was on its way to the island when the storm came, and all that was left of it in the end was a part of the mast."


def test_deep_nests_of_elements_with_signs():
    began = time.perf_counter()
    html_text.main_text("<div class='x-ad'>y" * 20_000 + "</div>" * 20_000)
    html_text.main_text("<div class='ad'>" * 20_000 + PROSE)
    html_text.main_text("<div>" * 20_000 + "</b>" * 20_000 + "</div>" * 20_000)
    assert time.perf_counter() - began < 5


def test_a_whole_sign_rules_out_only_beside_other_text():
    alone = [f"<div class='content header'><p>{PROSE}</p></div>", f"<div class='page search'><p>{PROSE}</p><div class=sidebar>a list of links</div></div>", f"<section class='social'><p>{PROSE}</p></section>", f"<blockquote class='related'>{PROSE}</blockquote>"]
    assert [html_text.main_text(h) for h in alone] == [PROSE] * 4
    comments = f"<div id=comments><p>{PROSE} one</p><p>{PROSE} two</p><p>{PROSE} three</p></div>"
    assert html_text.main_text(f"<article><p>{PROSE}</p></article>{comments}") == PROSE
    assert html_text.main_text(f"<div><p>{PROSE}</p>{comments}</div>") == PROSE


def test_a_document_that_loses_very_many_lines(spark):
    from quillspark.llm import lines

    r = random.Random(6)
    text = "\n".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(30)) + "." for _ in range(40_000))
    d = spark.createDataFrame([(1, text), (2, "kept\n" + text + "\nkept too"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    found = {r.doc_id: r.text for r in lines.drop_lines(d.select("doc_id", "text"), 100).collect()}
    assert found == {1: text, 2: "kept\nkept too", 3: None}
    assert time.perf_counter() - began < 120
