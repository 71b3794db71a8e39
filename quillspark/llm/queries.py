"""The queries opN_<name> of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, langid, licenses, lines, merkle, ngram_join, packing, pivots, positional, quality, token_files, trie
from .common import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is: under TOKENIZER_DIR if that is set, else in the installed package."""
    if where := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(where, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what is left of its text."""
    return lines.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The documents stand for files: a directory for each source and language and each hundred ids; short ones are licence files.
PATH = "concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), cast(doc_id AS bigint) div 100, CASE WHEN length(text) < 200 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END)"


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr(PATH).alias("path"))
    return licenses.scan(docs).select("doc_id", "path", "own_license", "own_score", "inherited_from", "license")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(langid.trainable(docs.select("doc_id", "text", "lang")))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(F.expr("crc32(cast(doc_id AS string)) % 4 = 2"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.tokens_on_disk(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.fingerprints(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return pivots.mine(pivots.clean(rows), "vec_id % 50 = 0")


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_line_dedup, op3_license_scan, op4_language_id, op5_token_files, op6_ngram_join, op7_fingerprints, op8_bpe, op9_html_text, op10_packing, op11_hard_negatives, op12_decontamination, op13_prefix_trie)}

ORACLE = {
    "op1_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY doc_id),
c AS (SELECT d.doc_id, t, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
      FROM d LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 5 * n_dup_lines > 2 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 0.5 * word_chars OR NOT regexp_matches(t, '\p{L}')) AS kept
FROM b""",
    "op6_ngram_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
m AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
k AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m.b, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id""",
}
ORACLE["op3_license_scan"] = (
    r"""
WITH f AS (SELECT doc_id, text, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), CAST(doc_id // 100 AS VARCHAR), CASE WHEN length(text) < 200 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path FROM documents),
l AS (SELECT doc_id, path, line FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line FROM f) WHERE regexp_matches(line, '"""
    + licenses.MAYBE
    + r"""')),
u AS (SELECT line, count(*) AS n FROM l GROUP BY line),
w AS (SELECT line, word, count(*) AS tf FROM (SELECT line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM u) GROUP BY ALL),
total AS (SELECT coalesce(sum(n), 0) AS t FROM u),
idf AS (SELECT word, ln((1.0 + any_value(t)) / (1.0 + sum(n))) + 1.0 AS idf FROM w JOIN u USING (line), total GROUP BY word),
tpl AS (SELECT * FROM (VALUES """
    + ", ".join(f"({k}, '{lic}', '{text}')" for k, (lic, text) in enumerate(licenses.TEMPLATES))
    + r""") AS x(template, license, line)),
tw AS (SELECT template, license, word, count(*) * any_value(coalesce(idf, (SELECT ln(1.0 + t) + 1.0 FROM total))) AS tw FROM (SELECT template, license, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS word FROM tpl) LEFT JOIN idf USING (word) GROUP BY ALL),
tn AS (SELECT template, sqrt(sum(tw * tw)) AS tn FROM tw GROUP BY template),
x AS (SELECT line, word, tf * idf AS w FROM w JOIN idf USING (word)),
norm AS (SELECT line, sqrt(sum(w * w)) AS norm FROM x GROUP BY line),
scored AS (SELECT line, license, round(sum(w * tw / tn) / any_value(norm), 6) AS score FROM x JOIN tw USING (word) JOIN tn USING (template) JOIN norm USING (line) GROUP BY line, template, license),
best AS (SELECT line, license, score FROM scored WHERE score >= 0.7 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
own AS (SELECT path, license, score FROM l JOIN best USING (line) QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1),
holder AS (SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS dir, license FROM own WHERE path LIKE '%/LICENSE' QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1),
near AS (SELECT path, dir, h.license AS inherited FROM (SELECT DISTINCT path FROM f) JOIN holder h ON starts_with(path, dir || '/') QUALIFY row_number() OVER (PARTITION BY path ORDER BY length(dir) DESC) = 1)
SELECT f.doc_id, f.path, own.license AS own_license, own.score AS own_score, CASE WHEN own.license IS NULL THEN near.dir END AS inherited_from, coalesce(own.license, near.inherited) AS license
FROM f LEFT JOIN own USING (path) LEFT JOIN near USING (path)"""
)

ORACLE["op12_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: array_to_string(w[k:k + 9], ' '))) AS g FROM i WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
place AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, n, k FROM place JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLE["op13_prefix_trie"] = r"""
WITH t AS (SELECT conv_id, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(x ORDER BY i) AS xs,
             xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: [ascii(z)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                             lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 4 AS h
      FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(list_slice(b.xs, 1, c.h), []), list_slice(c.xs, c.h + 1, len(c.xs))) AS xs FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, list_slice(xs, 1, d) AS k, d = len(xs) AS ends FROM (SELECT conv_id, xs, unnest(range(0, len(xs) + 1)) AS d FROM r)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY k, d),
v AS (SELECT *, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(k[d].t, '[\x20\x09-\x0D]+'), lambda z: z <> '')) END AS saved FROM n),
ch AS (SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
l AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN ch USING (k, d)),
up AS (SELECT list_slice(k, 1, e) AS k, e AS d, n_children, saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM l)),
s AS (SELECT k, d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM up GROUP BY k, d)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, l.n_convs, l.n_children, n_leaves, saved_tokens, l.ends_sha256
FROM l JOIN s USING (k, d) LEFT JOIN n q ON l.d > 0 AND q.d = l.d - 1 AND q.k = list_slice(l.k, 1, l.d - 1)"""

ORACLE["op11_hard_negatives"] = r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, CAST(list_inner_product(a.v, x.v) AS BIGINT) AS score FROM r a JOIN r x ON a.vec_id % 50 = 0 AND a.vec_id <> x.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3"""
