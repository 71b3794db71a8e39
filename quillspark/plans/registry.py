"""Queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formulas, text, titles
from ..operators import assemble, checks, doctags, epub, guard, packages, textlayer
from ..sources import readers
from .synthetic import order_pages, table, turns

QUERIES: dict = {}
ORACLE: dict = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return add


def _blocks(spark, sf_dir, *classes):
    return doctags.blocks(order_pages(spark, sf_dir), classes or None)


@query("""
SELECT l_orderkey AS doc_id, CAST(row_no AS INT) AS row_no, c.col_no, c.text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS row_no FROM lineitem),
 LATERAL (VALUES (0, CAST(l_linenumber AS VARCHAR)), (1, 'P|' || l_partkey), (2, CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END)) AS c(col_no, text)
UNION ALL SELECT DISTINCT l_orderkey, 0, col_no, text FROM lineitem, (VALUES (0, 'line'), (1, 'part'), (2, 'qty')) AS h(col_no, text)""")
def otsl_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doctags.table_cells(_blocks(spark, sf_dir, "otsl")).select("doc_id", "row_no", "col_no", "text")


@query(r"""
SELECT page_id, CAST(i - 1 AS INT) AS pos, CASE WHEN regexp_matches(p, '^</?loc_\d+>$') THEN 'loc' WHEN NOT regexp_matches(p, '^</?[a-z0-9_]+>$') THEN 'text' WHEN p LIKE '</%' THEN 'close' ELSE 'open' END AS kind, CASE WHEN regexp_matches(p, '^</?[a-z0-9_]+>$') AND NOT regexp_matches(p, '^</?loc_\d+>$') THEN trim(p, '</>') END AS name
FROM (SELECT page_id, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?[a-z0-9_]+>|[^<]+|<') AS l FROM pages))""")
def doctags_tokens(spark, sf_dir):
    return doctags.tokens(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc_tags"))).select("page_id", "pos", "kind", "name")


@query(r"SELECT trim(t, '<>') AS name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<[a-z0-9_]+>')) AS t FROM pages) GROUP BY 1")
def tag_counts(spark, sf_dir):
    d = doctags.tokens(table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("doc_tags")))
    return d.where("kind = 'open'").groupBy("name").agg(F.count("*").alias("n"))


_ORDER = "(SELECT l_orderkey AS k, CAST(l_orderkey AS VARCHAR) AS o, count(*) AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)"


@query(f"""
SELECT k AS doc_id, page, cls, txt AS text FROM {_ORDER}, LATERAL (VALUES (1, 'title', 'Order ' || o), (1, 'text', n || ' lines'), (2, 'section_header_level_2', 'Notes'), (2, 'formula', 'x_{{' || o), (2, 'formula', '( ' || n), (2, 'list_item', 'a b'), (2, 'odd', 'left'), (2, 'code', 'y' || chr(10) || '  z')) AS b(page, cls, txt)""")
def doctags_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).where("cls NOT IN ('otsl', 'picture', 'chart')").select("doc_id", "page", "cls", "text")


@query("""
SELECT l_orderkey AS doc_id, '| line | part | qty |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || l_linenumber || ' | P\\|' || l_partkey || ' | ' || CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END || ' |', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS markdown, bool_or(l_returnflag = 'R') AS dropped_spans
FROM lineitem GROUP BY 1""".replace("\\\\", "\\"))
def otsl_markdown(spark, sf_dir):
    return _blocks(spark, sf_dir, "otsl").select("doc_id", "markdown", F.col("spans").alias("dropped_spans"))


@query(f"""
SELECT k AS doc_id, f.no AS figure_no, f.md AS markdown FROM {_ORDER}, LATERAL (VALUES (1, '![Fig ' || o || '](images/figure-1.png)' || chr(10) || chr(10) || '*Fig [' || o || ']*'), (2, '![figure-2](images/figure-2.png)')) AS f(no, md)""")
def figure_numbering(spark, sf_dir):
    return _blocks(spark, sf_dir, "picture", "chart").select("doc_id", "figure_no", "markdown")


@query(f"SELECT k AS doc_id, f.no AS formula_no, f.l, f.t, f.r, f.b FROM {_ORDER}, (VALUES (1, 0.0::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE), (2, NULL, NULL, NULL, NULL)) AS f(no, l, t, r, b)")
def formula_boxes(spark, sf_dir):
    b = F.col("bbox")
    return _blocks(spark, sf_dir, "formula").select("doc_id", "formula_no", *[b[k].alias(n) for k, n in enumerate("ltrb")])


@query(f"SELECT k AS doc_id, p.page, CASE p.page WHEN 1 THEN 'Order ' || o ELSE 'Notes' END AS title, p.page = 1 AND r AS dropped_spans FROM {_ORDER}, (VALUES (1), (2)) AS p(page)")
def page_titles(spark, sf_dir):
    return doctags.parsed_pages(_blocks(spark, sf_dir)).select("doc_id", "page", "title", "dropped_spans")


@query(f"""
SELECT k AS doc_id, f.id, f.tex, f.suspect FROM {_ORDER}, LATERAL (VALUES ('formula-1', '( ' || n, TRUE), ('formula-2', '( z', FALSE), ('formula-3', 'y_{{' || o || '}}', n % 2 = 0)) AS f(id, tex, suspect)""")
def suspect_formulas(spark, sf_dir):
    """The first is cut off, the second has no box, the third ends a page that was cut off for an even number of lines."""
    pages = _formula_pages(spark, sf_dir)
    return assemble.suspects(doctags.blocks(pages, ("formula",)), pages.select("doc_id", "page", "truncated")).select("doc_id", "id", "tex", "suspect")


def _formula_pages(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n"))
    box = "<loc_0><loc_0><loc_250><loc_500>"
    tags = F.concat(F.lit(f"<formula>{box}( "), "n", F.lit(f"</formula><formula>( z</formula><formula>{box}y_{{"), "doc_id", F.lit("</formula>"))
    return d.select("doc_id", F.lit(1).alias("page"), tags.alias("doc_tags"), F.when(F.col("n") % 2 == 0, "timeout").alias("truncated"))


@query("""
SELECT p_partkey AS doc_id, b.no - 1 AS block_no, b.cls, b.raw, b.caption FROM part, LATERAL (VALUES (1, 'list_item', 'a' || p_partkey || 'b', NULL, -1), (2, 'picture', '', CASE WHEN p_size % 2 = 0 THEN 'see ' || p_size END, -1), (3, 'caption', 'see ' || p_size, NULL, 1), (3 + p_size % 2, 'text', 'ab', NULL, -1), (4 + p_size % 2, 'formula', 'cut ' || p_size, NULL, -1)) AS b(no, cls, raw, caption, odd) WHERE odd < 0 OR p_size % 2 = 1""")
def nested_blocks(spark, sf_dir):
    """Blocks that hold blocks of their own name, tags that cross, a caption with and without text before it, and a block that never ends."""
    key, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    between = F.when(F.col("p_size") % 2 == 0, " \n").otherwise("and ")
    tags = F.concat(F.lit("<list_item>a<list_item>"), key, F.lit("</list_item>b</list_item><picture></picture>"), between, F.lit("<caption>see <caption> "), size, F.lit("</caption></caption><text>a<formula>b</text>c</formula></text><formula><loc_1>cut "), size)
    d = doctags.segmented(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), tags.alias("doc_tags")))
    return d.select("doc_id", "block_no", "cls", F.when(F.col("cls") == "caption", text.collapse(F.col("raw"))).otherwise(F.col("raw")).alias("raw"), "caption")


_NOTICE = "chr(10) || chr(10) || '> [!warning]- This formula may be incomplete — show the original from the PDF' || chr(10) || '> ![formula-' || {0} || '](images/formula-' || {0} || '.png)'"


@query(f"""
SELECT l_orderkey AS doc_id, 'a $$x' || l_linenumber || '$$' || CASE WHEN l_returnflag = 'R' THEN {_NOTICE.format(1)} ELSE '' END || ' b $$y$$' || CASE WHEN l_linenumber % 2 = 0 THEN {_NOTICE.format(2)} ELSE '' END || ' $$ end' AS md FROM lineitem""")
def annotated_formulas(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    found = F.array(F.struct(F.lit("formula-1").alias("id"), (F.col("l_returnflag") == "R").alias("suspect")), F.struct(F.lit("formula-2").alias("id"), (F.col("l_linenumber") % 2 == 0).alias("suspect")))
    md = F.concat(F.lit("a $$x"), "l_linenumber", F.lit("$$ b $$y$$ $$ end"))
    return li.select(F.col("l_orderkey").alias("doc_id"), assemble.annotate(md, found).alias("md"))


@query("SELECT l_orderkey AS doc_id, count(*) AS pages, CAST(sum(l_partkey) AS BIGINT) AS gen_tokens, CAST(sum(l_suppkey) AS BIGINT) AS prompt_tokens, CAST(sum(l_linenumber - 1) AS BIGINT) AS ms, CASE WHEN sum(l_linenumber - 1) > 0 THEN round(sum(l_partkey) * 1000.0 / sum(l_linenumber - 1), 2) END AS tokens_per_sec FROM lineitem GROUP BY 1")
def document_metrics(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return assemble.document_metrics(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.col("l_partkey").cast("long").alias("gen_tokens"), F.col("l_suppkey").cast("long").alias("prompt_tokens"), (F.col("l_linenumber") - 1).cast("long").alias("ms")))


_TEX = "concat(CASE WHEN p_size % 7 = 0 THEN '[ ' ELSE '' END, '\\\\frac{', p_partkey, CASE WHEN p_size % 3 = 0 THEN '}' ELSE '' END, CASE WHEN p_size % 5 = 0 THEN '}' ELSE '' END, CASE WHEN p_size % 2 = 0 THEN concat(' & & ( ', p_size, ' )') ELSE '' END)"


@query(r"""
SELECT p_partkey, CASE WHEN c = 0 AND p_size % 2 = 0 THEN '\begin{aligned}' || o || '\frac{' || p_partkey || ' & & ( ' || p_size || ' )}\end{aligned}' WHEN c = 0 THEN o || '\frac{' || p_partkey || '}'
  ELSE repeat('{', c - 1) || o || '\frac{' || p_partkey || repeat('}', c) || CASE WHEN p_size % 2 = 0 THEN ' \tag{' || p_size || '}' ELSE '' END END AS tex, o <> '' AS cut
FROM (SELECT *, CAST(p_size % 3 = 0 AS INT) + CAST(p_size % 5 = 0 AS INT) AS c, CASE WHEN p_size % 7 = 0 THEN '[ ' ELSE '' END AS o FROM part)""")
def fixed_formulas(spark, sf_dir):
    """Braces are closed at the end or opened at the front, equation numbers become tags, other alignment marks get an environment."""
    d = table(spark, sf_dir, "part").withColumn("tex", F.expr(_TEX))
    return d.select("p_partkey", formulas.fix(F.col("tex")).alias("tex"), formulas.truncated(F.col("tex")).alias("cut"))


@query(r"""SELECT l_orderkey, l_linenumber, (l_linenumber % 2 = 0) AS cut FROM lineitem""")
def truncated_formulas(spark, sf_dir):
    tex = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(r"softmax ( Q \( "), F.col("l_partkey"))).otherwise(F.concat(F.lit(r"f ( [ "), F.col("l_partkey"), F.lit(r" ] ) \[")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", formulas.truncated(tex).alias("cut"))


@query(r"""SELECT doc_id, doc_id || ' $$a_{' || doc_id || '}$$ b $$$' AS md FROM documents""")
def clean_math(spark, sf_dir):
    md = F.concat(F.col("doc_id"), F.lit(" $$a_{"), F.col("doc_id"), F.lit("$$ b $$$"))
    return table(spark, sf_dir, "documents").select("doc_id", formulas.clean(md).alias("md"))


@query(r"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '<em>x</em><sub>' || p_size || '</sub>' WHEN 1 THEN '<sup>' || p_size || '</sup>' WHEN 2 THEN '<em>d</em><sub>i</sub><sup>' || p_size || '</sup>' END AS xhtml FROM part""")
def trivial_math(spark, sf_dir):
    n = F.col("p_size")
    tex = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("x_{"), n, F.lit("}"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("^{"), n, F.lit("}"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("d _i ^{"), n, F.lit("}"))).otherwise(F.concat(F.lit("\\frac{"), n, F.lit("}{2}")))
    return table(spark, sf_dir, "part").select("p_partkey", formulas.trivial_xhtml(tex).alias("xhtml"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'On ' || p_name WHEN p_partkey % 3 = 1 THEN 'Heading of ' || p_partkey ELSE 'file ' || p_partkey END AS title FROM part""")
def choose_title(spark, sf_dir):
    k = F.col("p_partkey")
    meta = F.when(k % 3 == 0, F.concat(F.lit(" On  "), "p_name")).when(k % 3 == 1, F.concat(F.lit("scan_"), k, F.lit(".indd"))).otherwise("Untitled")
    head = F.when(k % 3 == 2, F.concat(k, F.lit(". Introduction"))).otherwise(F.concat(F.lit("Heading of "), k))
    return table(spark, sf_dir, "part").select("p_partkey", titles.choose(meta, head, F.concat(F.lit("file "), k)).alias("title"))


@query(r"""SELECT o_orderkey, ['A ' || o_custkey, o_orderstatus, 'Z'] AS names, strftime(o_orderdate, '%Y-%m-%d') AS published FROM orders""")
def authors_and_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    by = F.concat(F.lit("A "), F.col("o_custkey"), F.lit("; "), F.col("o_orderstatus"), F.lit(" and Z;"))
    return o.select("o_orderkey", text.authors(by).alias("names"), text.published(F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("120000Z"))).alias("published"))


@query(r"""SELECT c_custkey, '---' || chr(10) || 'title: "' || c_name || ' \"q\""' || chr(10) || 'source: "s.pdf"' || chr(10) || 'author:' || chr(10) || '  - "' || c_mktsegment || '"' || chr(10) || 'created: 2024-01-02' || chr(10) || 'pages: ' || c_nationkey || chr(10) || CASE WHEN c_nationkey > 0 THEN 'conversion_warnings: ' || c_nationkey || chr(10) ELSE '' END || 'tags:' || chr(10) || '  - paper' || chr(10) || '  - converted' || chr(10) || '---' || chr(10) AS fm FROM customer""")
def frontmatter(spark, sf_dir):
    null = F.lit(None).cast("string")
    fm = text.frontmatter(F.concat("c_name", F.lit(' "q"')), F.lit("s.pdf"), F.col("c_mktsegment"), null, F.lit("2024-01-02"), null, F.col("c_nationkey"), F.col("c_nationkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", fm.alias("fm"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'Untitled' WHEN p_partkey % 5 = 1 THEN 'file ' || p_partkey ELSE p_name || '- a' END AS name, '---' || chr(10) || 'source: "new"' || chr(10) || '---' || chr(10) || 'source: "old"' || chr(10) || p_partkey AS note FROM part""")
def package_names(spark, sf_dir):
    note = F.concat(F.lit('---\nsource: "old"\n---\nsource: "old"\n'), F.col("p_partkey"))
    k = F.col("p_partkey") % 5
    title = F.when(k < 2, "..# - ").otherwise(F.concat(F.lit(".."), "p_name", F.lit(":  a - ")))
    return table(spark, sf_dir, "part").select("p_partkey", text.package_name(title, F.when(k == 0, "[#]").otherwise(F.concat(F.lit("file "), "p_partkey"))).alias("name"), text.retarget_source(note, F.lit("old"), F.lit("new")).alias("note"))


@query(r"""
WITH p AS (SELECT conv_id, turn + 1 AS page, text FROM conversations WHERE turn < 3), n AS (SELECT conv_id, count(*) AS all_pages FROM conversations GROUP BY 1),
b AS (SELECT conv_id, max(page) AS last, string_agg(text || CASE WHEN page % 2 = 0 THEN chr(10) || chr(10) || '> [!warning] Page ' || page || ' may be incomplete — generation stopped early (timeout), so text may be missing here.' ELSE '' END, chr(10) || chr(10) ORDER BY page) AS body, list('page ' || page || ': generation stopped early (timeout) — output may be incomplete' ORDER BY page) FILTER (page % 2 = 0) AS cut FROM p GROUP BY 1)
SELECT conv_id AS doc_id, last, list_filter(list_concat(coalesce(cut, []), [CASE WHEN length(body) + length(regexp_replace(body, '[^\x{10000}-\x{10FFFF}]', '', 'g')) < 200 * last THEN 'very little text extracted; source may be scanned/image-only — retry with --ocr' END, CASE WHEN last < all_pages THEN 'processed only ' || last || ' of ' || all_pages || ' pages (--max-pages)' END]), lambda x: x IS NOT NULL) AS warnings
FROM b JOIN n USING (conv_id)""")
def assembled_warnings(spark, sf_dir):
    t = turns(spark, sf_dir)
    null = F.lit(None).cast("string")
    pages = t.where("markdown IS NOT NULL").select("doc_id", "page", "markdown", null.alias("title"), F.when(F.col("page") % 2 == 0, "timeout").alias("truncated"), F.lit(False).alias("spans"), null.alias("rescued"), F.lit(0).alias("n_suspect"))
    docs = t.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count")).select("doc_id", F.lit("c.pdf").alias("source"), F.concat(F.lit("talk "), "doc_id").alias("stem"), "page_count", null.alias("meta_title"), null.alias("author"), null.alias("published"), null.alias("description"))
    return assemble.packages(pages, docs, "2024-01-02", 3).select("doc_id", "last", "warnings")


@query(r"""
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag = 'R') AS r, string_agg('| ' || l_linenumber || ' | P\|' || l_partkey || ' | ' || CASE WHEN l_returnflag = 'R' THEN '' ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END || ' |', '~' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS t FROM lineitem GROUP BY 1),
b AS (SELECT k, r, replace('# Order ' || k || '~~' || n || ' lines~~| line | part | qty |~| --- | --- | --- |~' || t || '~~~' || CASE WHEN r THEN '> [!warning] Page 1 may be incomplete — a table here had merged cells that render blank.~~' ELSE '' END || '### Notes~~$$x_{' || k || '}$$~~![Fig ' || k || '](images/figure-1.png)~~*Fig [' || k || ']*~~![figure-2](images/figure-2.png)~~$$( ' || n || '$$~~- a b~~left~~```~y~  z~```~', '~', chr(10)) AS body FROM l),
w AS (SELECT *, list_concat(CASE WHEN length(body) < 400 THEN ['very little text extracted; source may be scanned/image-only — retry with --ocr'] ELSE [] END, CASE WHEN r THEN ['table on page 1 contained merged cells rendered blank — verify against source'] ELSE [] END) AS warnings FROM b)
SELECT k AS doc_id, 'Order ' || k AS title, 2 AS last, warnings, length(body) AS body_chars,
       replace('---~title: "Order ' || k || '"~source: "o.pdf"~created: 2024-01-02~pages: 2~' || CASE WHEN len(warnings) > 0 THEN 'conversion_warnings: ' || len(warnings) || '~' ELSE '' END || 'tags:~  - paper~  - converted~---~~'
         || CASE WHEN len(warnings) > 0 THEN '> [!warning]+ Conversion warnings (' || len(warnings) || ')~> This note was converted from a PDF and parts of it may be incomplete.~> Check the source PDF where flagged below.~> - ' || array_to_string(warnings, '~> - ') || '~~' ELSE '' END, '~', chr(10)) || body AS markdown
FROM w""")
def assembled_notes(spark, sf_dir):
    """Whole notes of the order pages, by all stages from DocTags on."""
    pages = order_pages(spark, sf_dir)
    found = doctags.blocks(pages)
    null = F.lit(None).cast("string")
    parsed = doctags.parsed_pages(found).select("doc_id", "page", "markdown", "title", null.alias("truncated"), F.col("dropped_spans").alias("spans"), null.alias("rescued"), F.lit(0).alias("n_suspect"))
    docs = pages.groupBy("doc_id").agg(F.max("page").alias("page_count")).select("doc_id", F.lit("o.pdf").alias("source"), F.lit("order").alias("stem"), "page_count", null.alias("meta_title"), null.alias("author"), null.alias("published"), null.alias("description"))
    return assemble.packages(parsed, docs, "2024-01-02")


@query(r"""SELECT event_id, CASE WHEN value > 0 THEN round(event_id % 4096 * 1000.0 / value, 2) END AS tokens_per_sec, CASE WHEN event_id % 7 = 0 THEN 'timeout' WHEN event_id % 4097 >= 4096 THEN 'max_tokens' END AS truncated FROM events""")
def page_throughput(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4096).alias("gen_tokens"), F.col("value").alias("ms"), guard.truncation(F.when(F.col("event_id") % 7 == 0, "timeout"), F.col("event_id") % 4097).alias("truncated"))
    return assemble.throughput(e).select("event_id", "tokens_per_sec", "truncated")


_EVENTS = "(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)"


@query(f"SELECT user_id, event_id, count(*) OVER w AS seen, CAST(floor(avg(value) OVER w * 1000 + 1e-6) AS BIGINT) AS mean_us, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def progress_high_water(spark, sf_dir):
    d = guard.progress(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return d.select("user_id", "event_id", "seen", F.floor(F.col("mean") * 1000 + 1e-6).alias("mean_us"), "high")


@query("SELECT user_id, count(*) AS n, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.95) AS BIGINT) + 1)] AS p95, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 0.5) AS BIGINT) + 1)] AS median, max(value) AS worst, count(*) FILTER (value > 100) AS stalls FROM events GROUP BY 1")
def lag_percentiles(spark, sf_dir):
    return guard.lag_statistics(table(spark, sf_dir, "events"), "user_id", "value")


@query("SELECT user_id, bool_and(coalesce(value >= p - 1e-9, TRUE)) AS monotonic, count(DISTINCT value) AS n_distinct, min(value) AS low, max(value) AS high FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1")
def bar_probe(spark, sf_dir):
    return guard.monotonic(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")


@query("SELECT user_id, arg_max(value, event_id) - arg_min(event_id, event_id) AS growth FROM events GROUP BY 1")
def memory_growth(spark, sf_dir):
    return guard.net_growth(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id", "value")


@query("""
SELECT user_id AS gen_id, CASE WHEN n >= 6 AND user_id % 2 = 0 THEN 6 ELSE n END AS stopped_at, CASE WHEN n >= 6 AND user_id % 2 = 0 THEN 'repetition' WHEN n >= 9 THEN 'max_tokens' END AS reason FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)""")
def guard_first_trigger(spark, sf_dir):
    """Streams of two alternating tokens, for every other user: they repeat three times at the sixth."""
    step = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = table(spark, sf_dir, "events").withColumn("step", step)
    token = F.when(F.col("user_id") % 2 == 0, F.col("step") % 2).otherwise(F.col("step"))
    return guard.first_trigger(d.select(F.col("user_id").alias("gen_id"), "step", token.alias("token"), F.lit(0).alias("ms"), F.lit(False).alias("aborted")), 1000, 9)


@query(r"""
WITH n AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'x' || chr(10) || '---' || chr(10) ELSE '' END || '## ' || source || chr(10) || text || chr(10) || '| a | ' || lang || ' |' AS md FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, coalesce(ok, FALSE) AS ok FROM n, LATERAL (VALUES ('title', contains('From ' || source, lang)), ('frontmatter', CASE WHEN md IS NOT NULL THEN doc_id % 2 = 0 END), ('min_headings', len(regexp_extract_all(md, '(?m)^#{1,6} .+$')) >= 2), ('min_images', doc_id % 3 >= 1), ('min_math_blocks', (len(string_split(md, '$$')) - 1) // 2 >= 1), ('required_substrings', contains(md, 'the')), ('required_table_cells', lang = 'en'), ('forbidden_substrings', NOT contains(md, 'License'))) AS c(name, ok)""")
def fixture_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    md = F.concat(F.when(F.col("doc_id") % 2 == 0, "---\nx\n---\n").otherwise(""), F.lit("## "), "source", F.lit("\n"), "text", F.lit("\n| a | "), "lang", F.lit(" |"))
    notes = d.select("doc_id", F.concat(F.lit("From "), "source").alias("title"), (F.col("doc_id") % 3).alias("images"), md.alias("markdown"))
    want = d.select("doc_id", F.col("lang").alias("title_contains"), F.lit(2).alias("min_headings"), F.lit(1).alias("min_images"), F.lit(1).alias("min_math_blocks"), F.array(F.concat(F.lit("##  "), "source"), F.lit("the")).alias("required_substrings"), F.array(F.lit("| en |")).alias("required_table_cells"), F.array(F.lit("License")).alias("forbidden_substrings"))
    return checks.run(notes, want)


@query(r"""
WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) ELSE '' END || '## a' || chr(10) || text AS md, source, doc_id % 3 AS k FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, coalesce(ok, FALSE) AS ok FROM n, LATERAL (VALUES ('folder', k > 0), ('file', source = 'web'), ('frontmatter', doc_id % 2 = 0), ('size', length(md) > 5000), ('headings', len(string_split(md, '## ')) > 3), ('counts', k > 1), ('images', k >= 1), ('maths', contains(md, '$$')), ('no_warnings', k = 0), ('long', length(md) > 2000), ('any_heading', TRUE), ('no_glyphs', NOT contains(md, 'GLYPH'))) AS c(name, ok)""")
def package_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    k = F.col("doc_id") % 3
    md = F.concat(F.when(F.col("doc_id") % 2 == 0, "---\ntitle: x\n---\n").otherwise(""), F.lit("## a\n"), "text")
    side = F.struct(F.when(k > 0, "out/p").otherwise("out/q").alias("out_dir"), F.when(F.col("source") == "web", "out/p/p.md").otherwise("p.txt").alias("md_path"), k.alias("pages"), (k - 1).alias("wall_ms"), k.alias("images"))
    notes = d.select("doc_id", md.alias("markdown"), F.lit("p").alias("stem"), side.alias("meta"), F.when(k == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("w"))).alias("warnings"))
    names = {"frontmatter": None, "size": "long", "headings": "any_heading"}
    rest = checks.smoke(notes).withColumn("name", F.when(F.col("name") == "size", names["size"]).when(F.col("name") == "headings", names["headings"]).otherwise(F.col("name"))).where("name <> 'frontmatter'")
    return checks.contract(notes).unionByName(rest)


@query(r"""
SELECT CAST(o_orderkey AS BIGINT) AS doc_id, c.no AS chapter_no, c.title, c.n AS n_lines FROM orders, LATERAL (VALUES (1, NULL, 2), (2, 'Two ' || o_orderkey, 3), (3, 'Three', 2)) AS c(no, title, n)""")
def split_chapters(spark, sf_dir):
    md = F.concat(F.lit("---\ntitle: x\n---\n\nintro\n# Two "), F.col("o_orderkey"), F.lit("\n\n### small\n## Three\nend"))
    return epub.chapters(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), md.alias("markdown"))).select("doc_id", "chapter_no", "title", "n_lines")


_NOTE = "concat('![](images/', l_partkey, '.png) ![b](images/', l_suppkey, '.jpg)')"


@query(r"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS no FROM lineitem),
h AS (SELECT l_orderkey AS doc_id, no * 2 AS pos, 'images/' || l_partkey || '.png' AS href FROM n UNION ALL SELECT l_orderkey, no * 2 + 1, 'images/' || l_suppkey || '.jpg' FROM n),
g AS (SELECT doc_id, href, min(pos) AS pos FROM h GROUP BY ALL)
SELECT doc_id, href, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS seq, 'img-' || regexp_replace(href, '[^A-Za-z0-9_]', '-', 'g') AS id, CASE WHEN href LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END AS media_type FROM g""")
def asset_manifest(spark, sf_dir):
    return epub.assets(_shown(spark, sf_dir))


def _shown(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumn("x", F.expr(_NOTE))
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "x"))), lambda r: r["x"]), "\n").alias("markdown"))


@query(r"""SELECT DISTINCT l_orderkey AS doc_id, 'missing image: images/' || l_suppkey || '.jpg' AS warning FROM lineitem""")
def missing_assets(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("images/"), "l_partkey", F.lit(".png")).alias("href"))
    return epub.missing(epub.assets(_shown(spark, sf_dir)), have)


@query(r"""SELECT l_orderkey AS doc_id, CAST(no AS INT) AS ordinal, CASE WHEN no % 3 = 0 THEN 'f' || no END AS crop_id, no % 3 <> 0 AS as_text FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS no FROM lineitem)""")
def crop_resolution(spark, sf_dir):
    no = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), no.alias("ordinal"), "l_partkey")
    side = li.where("ordinal % 3 <> 1").select("doc_id", "ordinal", F.when(F.col("ordinal") % 3 == 0, F.concat(F.lit("x "), "l_partkey")).otherwise("other").alias("tex"), F.concat(F.lit("f"), "ordinal").alias("id"))
    return epub.crops(li.select("doc_id", "ordinal", F.concat(F.lit("x"), "l_partkey").alias("tex")), side)


@query(r"""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, CASE page_id % 3 WHEN 0 THEN 'image/svg+xml' WHEN 1 THEN 'image/gif' ELSE 'application/octet-stream' END AS media_type FROM pages""")
def escaped_pages(spark, sf_dir):
    name = F.when(F.col("page_id") % 3 == 0, "a.b.SVG").when(F.col("page_id") % 3 == 1, "x.gif").otherwise("none")
    return table(spark, sf_dir, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"), text.media_type(name).alias("media_type"))


_IMUL = "((((({0}) >> 16) * {1}) & 65535) * 65536 + (({0}) & 65535) * {1}) & 4294967295"


@query(rf"""
WITH u AS (SELECT page_id, CAST(flatten(list_transform(string_split(url, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END)) AS BIGINT[]) AS u FROM pages),
h AS (SELECT page_id, list_reduce(list_concat([xor(2654435769::BIGINT, len(u))], u), lambda h, c: {_IMUL.format("xor(h, c)", 2654435761)}) AS a, list_reduce(list_concat([2246822507::BIGINT], u), lambda h, c: {_IMUL.format("xor(h, c)", 1597334677)}) AS b FROM u),
x AS (SELECT page_id, lower(lpad(to_hex(a), 8, '0') || lpad(to_hex(b), 8, '0') || lpad(to_hex(xor(a, b)), 8, '0') || lpad(to_hex((a + b) & 4294967295), 8, '0')) AS x FROM h)
SELECT page_id, x[1:8] || '-' || x[9:12] || '-4' || x[14:16] || '-a' || x[18:20] || '-' || x[21:32] AS uuid FROM x""")
def stable_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", epub.uuids(F.col("url")).alias("uuid"))


@query(r"""SELECT doc_id, regexp_replace(text, '^[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2000}-\x{200A}]+|[\t\n\x0B\f\r \x{00A0}\x{FEFF}\x{2000}-\x{200A}]+$', '', 'g') AS doc_tags FROM documents""")
def stripped_output(spark, sf_dir):
    t = F.concat(F.lit("<doctag>"), "text", F.lit("</doctag><|im_end|><end_of_utterance>\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.strip_chrome(t).alias("doc_tags"))


@query(r"""
WITH p AS (SELECT vec_id, ['auto', 'webgpu', 'webnn', 'wasm'][CAST(label % 4 + 1 AS INT)] AS wanted, vec_id % 2 = 0 AS gpu, vec_id % 3 AS k FROM embeddings)
SELECT vec_id, list_concat(CASE WHEN wanted = 'webnn' AND k = 0 THEN ['webnn-npu', 'webnn-gpu'] WHEN wanted = 'webnn' AND k = 1 THEN ['webnn-gpu'] ELSE [] END, CASE WHEN gpu AND wanted <> 'wasm' THEN ['webgpu'] ELSE [] END, ['wasm']) AS devices,
       CASE WHEN gpu AND (wanted IN ('auto', 'webgpu') OR wanted = 'webnn' AND k = 2) THEN 'fp16' ELSE 'fp32' END AS embed, NOT (gpu AND wanted <> 'wasm') AND NOT (wanted = 'webnn' AND k < 2) AS slow,
       CASE WHEN k = 0 THEN 'no adapter' ELSE 'No compatible GPU was found.' END || CASE WHEN gpu THEN ' On Linux, Chromium still hides WebGPU behind a flag — launching the application with --enable-features=Vulkan --enable-unsafe-webgpu may enable it.' ELSE '' END AS reason FROM p""")
def devices(spark, sf_dir):
    """Every preference, with and without a GPU and neural devices."""
    gpu, k = F.col("vec_id") % 2 == 0, F.col("vec_id") % 3
    wanted = F.element_at(F.array(*map(F.lit, ("auto", "webgpu", "webnn", "wasm"))), (F.col("label") % 4 + 1).cast("int"))
    neural = F.when(k == 0, F.array(F.lit("gpu"), F.lit("npu"))).when(k == 1, F.array(F.lit("gpu"))).otherwise(F.array().cast("array<string>"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", gpu.alias("gpu"), k.alias("k"), readers.device_candidates(wanted, gpu, neural).alias("devices"))
    first = F.col("devices")[0]
    return d.select("vec_id", "devices", readers.embed_type(first, F.col("gpu")).alias("embed"), text.slow_device(first).alias("slow"), text.slow_reason(F.when(F.col("k") == 0, "no adapter"), F.when(F.col("gpu"), "linux").otherwise("mac")).alias("reason"))


@query(r"""
WITH b AS (SELECT vec_id, least(abs(embedding[1]), 1)::DOUBLE AS l, least(abs(embedding[2]), 1)::DOUBLE AS t, least(abs(embedding[1]) + abs(embedding[3]), 1)::DOUBLE AS r, least(abs(embedding[2]) + abs(embedding[4]), 1)::DOUBLE AS b FROM embeddings),
c AS (SELECT vec_id, least(floor(l * 612), 611)::BIGINT AS x, least(floor(t * 792), 791)::BIGINT AS y, least(ceil(r * 612), 612)::BIGINT AS x1, least(ceil(b * 792), 792)::BIGINT AS y1 FROM b)
SELECT vec_id, x, y, greatest(1, x1 - x) AS w, greatest(1, y1 - y) AS h FROM c""")
def crop_boxes(spark, sf_dir):
    e = [F.abs(F.element_at("embedding", k)) for k in range(1, 5)]
    one = F.lit(1.0).cast("float")
    box = F.struct(F.least(e[0], one).cast("double").alias("l"), F.least(e[1], one).cast("double").alias("t"), F.least(e[0] + e[2], one).cast("double").alias("r"), F.least(e[1] + e[3], one).cast("double").alias("b"))
    d = table(spark, sf_dir, "embeddings").select("vec_id", box.alias("box"))
    return d.select("vec_id", readers.crop_box(F.col("box"), F.lit(612).cast("long"), F.lit(792).cast("long")).alias("c")).select("vec_id", *[F.col(f"c.{k}").cast("long").alias(k) for k in "xywh"])


@query(r"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS no FROM lineitem),
p AS (SELECT l_orderkey, (no - 1) // 4 AS g, string_agg('p' || l_partkey, ' ' ORDER BY no) AS x FROM n WHERE l_returnflag <> 'R' GROUP BY ALL)
SELECT l_orderkey AS doc_id, coalesce(x, '') AS text FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN (SELECT l_orderkey, string_agg(x, chr(10) || chr(10) ORDER BY g) AS x FROM p GROUP BY 1) USING (l_orderkey)""")
def textlayer_paragraphs(spark, sf_dir):
    """Two tokens on a line, two lines in a paragraph; a box covers each returned one. Positions come from PDF text items."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    k = F.col("no") - 1
    top, left = F.floor(k / 4) * 60.0 + F.floor(k % 4 / 2) * 15.0, k % 2 * 250.0
    item = F.struct(F.concat(F.lit("p"), "l_partkey").alias("str"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), left, 792.0 - top - 12.0).alias("transform"), F.lit(100.0).alias("width"), F.lit(12.0).alias("height"))
    box = F.when(F.col("l_returnflag") == "R", F.struct((left / 612 - 0.001).alias("l"), (top / 792 - 0.001).alias("t"), ((left + 100) / 612 + 0.001).alias("r"), ((top + 12) / 792 + 0.001).alias("b")))
    d = table(spark, sf_dir, "lineitem").withColumn("no", F.row_number().over(w)).withColumn("token", readers.text_token(item, F.lit(612.0), F.lit(792.0)))
    g = d.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("no", "token"))), lambda t: t["token"]).alias("tokens"), F.collect_list(box).alias("boxes"))
    return textlayer.paragraphs(g.withColumn("page", F.lit(1))).select("doc_id", "text")


@query("SELECT l_orderkey, l_linenumber, floor((l_partkey % 600 / 612.0) * 1e6 + 0.5) AS l, floor((1 - l_suppkey % 700 / 792.0 - 12 / 792.0) * 1e6 + 0.5) AS t, floor(((l_partkey % 600 + 30) / 612.0) * 1e6 + 0.5) AS r FROM lineitem WHERE l_returnflag <> 'R'")
def text_tokens(spark, sf_dir):
    item = F.struct(F.when(F.col("l_returnflag") != "R", "x").otherwise("").alias("str"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), (F.col("l_partkey") % 600).cast("double"), (F.col("l_suppkey") % 700).cast("double")).alias("transform"), F.lit(30.0).alias("width"), F.lit(12.0).alias("height"))
    d = table(spark, sf_dir, "lineitem").withColumn("x", readers.text_token(item, F.lit(612.0), F.lit(792.0))).where("x IS NOT NULL")
    return d.select("l_orderkey", "l_linenumber", *[F.floor(F.col(f"x.{k}") * 1e6 + 0.5).cast("double").alias(k) for k in "ltr"])


@query(r"""
SELECT event_id, CAST(floor(max(f) OVER (PARTITION BY user_id ORDER BY event_id) * 1e6 + 0.5) AS BIGINT) AS millionths, CASE WHEN event_id % 5 > 0 THEN CAST(floor(event_id % 5 * 30000.0 / (event_id % 5) / 1000 * (6 - event_id % 5) + 0.5) AS BIGINT) END AS left_s
FROM (SELECT event_id, user_id, least(1.0, (event_id % 5 + CASE WHEN event_id % 7 = 0 THEN 0.0 WHEN q <= 1 THEN 0.8 * q ELSE 1 - 0.2 * exp(1 - q) END) / 6) AS f
      FROM (SELECT event_id, user_id, (event_id % 11) * 9000.0 / CASE WHEN event_id % 5 > 0 THEN 30000.0 ELSE 60000.0 END AS q FROM events))""")
def progress_bar(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    done = F.col("event_id") % 5
    d = e.select("event_id", F.col("user_id").alias("doc_id"), F.col("event_id").cast("double").alias("at_ms"), done.alias("pages_done"), (done * 30000.0).alias("spent_ms"), F.when(F.col("event_id") % 7 != 0, F.col("event_id") - F.col("event_id") % 11 * 9000.0).alias("page_started_ms"), F.lit(6).alias("page_count"))
    return guard.bar(d).select("event_id", F.floor(F.col("fraction") * 1e6 + 0.5).alias("millionths"), "left_s")


@query(r"""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'T ' || p_partkey WHEN 1 THEN 'S' ELSE p_name END AS title FROM part""")
def item_titles(spark, sf_dir):
    item = lambda label, x: F.struct(F.lit(label).alias("label"), x.alias("text"))
    k = F.col("p_partkey") % 3
    items = F.array(item("text", F.lit("x")), item("section_header", F.when(k < 2, " S ").otherwise(" ")), item("title", F.lit(" ")), item("title", F.when(k == 0, F.concat(F.lit(" T "), "p_partkey")).otherwise("")))
    return table(spark, sf_dir, "part").select("p_partkey", titles.from_items(items, F.col("p_name")).alias("title"))


@query(r"""SELECT c_custkey, f.key, f.value, f.items FROM customer, LATERAL (VALUES ('title', c_name, NULL), ('author', NULL, ['A ' || c_custkey, c_mktsegment]), ('pages', CAST(c_nationkey AS VARCHAR), NULL), ('tags', NULL, ['paper', 'converted'])) AS f(key, value, items)""")
def front_fields(spark, sf_dir):
    null = F.lit(None).cast("string")
    by = F.concat(F.lit("A "), F.col("c_custkey").cast("string"), F.lit("; "), "c_mktsegment")
    md = F.concat(text.frontmatter(F.col("c_name"), F.lit("s"), by, null, F.lit("2024-01-02"), null, F.col("c_nationkey"), F.lit(0)), F.lit("\nkey: not one of them\n"))
    d = table(spark, sf_dir, "customer").select("c_custkey", F.inline(text.front_fields(md))).where("key NOT IN ('source', 'created')")
    return d.select("c_custkey", "key", "value", F.when(F.size("items") > 0, F.col("items")).alias("items"))


@query(r"""
WITH n AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT 'out/' || k || x.name AS path, x.size FROM n, LATERAL (VALUES ('/n.md', length('# ' || k)), ('/images/f1.png', CASE WHEN r THEN 3 END)) AS x(name, size) WHERE x.size IS NOT NULL
UNION ALL SELECT 'meta of ' || k || ': ' || n || ' pages, ' || length('# ' || k) || ' characters, ' || CASE WHEN r THEN 'f1 true' ELSE 'none' END, 0 FROM n""")
def package_files(spark, sf_dir):
    """The files of a package, but for the sidecar's size, and what its sidecar says."""
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count("*").alias("pages"), F.bool_or(F.col("l_returnflag") == "R").alias("r"))
    found = F.when(F.col("r"), F.array(F.struct(F.lit("f1").alias("id"), F.lit("x").alias("tex"), F.lit(1).alias("page"), F.lit(True).alias("suspect")))).otherwise(F.array().cast("array<struct<id:string,tex:string,page:int,suspect:boolean>>"))
    notes = d.select("doc_id", F.lit("s.pdf").alias("source"), F.lit("T").alias("title"), F.concat(F.lit("out/"), "doc_id").alias("out_dir"), F.lit("n").alias("stem"), F.concat(F.lit("# "), "doc_id").alias("markdown"), "pages", F.lit(0).alias("images"), F.array().cast("array<string>").alias("warnings"), found.alias("formulas"))
    notes = packages.meta(notes, "e", "1", "m")
    images = d.select("doc_id", F.lit("f1").alias("id"), F.when(F.col("r"), F.lit(b"png")).alias("png"))
    rows = packages.files(notes, images).where("path NOT LIKE '%/meta.json'").select("path", F.octet_length("content").cast("long").alias("size"))
    side = F.from_json("meta", readers.META)
    said = notes.select("doc_id", side.alias("m")).select(F.concat(F.lit("meta of "), "doc_id", F.lit(": "), "m.pages", F.lit(" pages, "), "m.markdown_chars", F.lit(" characters, "), F.when(F.col("m.formulas").isNull(), "none").otherwise(F.concat(F.col("m.formulas")[0]["id"], F.lit(" "), F.col("m.formulas")[0]["suspect"].cast("string")))).alias("path"), F.lit(0).cast("long").alias("size"))
    return rows.unionByName(said)


@query(r"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'in/p' || o_orderkey ELSE 'out/' || CASE WHEN o_orderkey % 3 = 1 THEN 'Title ' || o_custkey ELSE 'file' END END AS folder, CASE WHEN o_orderkey % 3 = 0 THEN 'p' || o_orderkey WHEN o_orderkey % 3 = 1 THEN 'Title ' || o_custkey ELSE 'file' END AS stem FROM orders""")
def package_destinations(spark, sf_dir):
    """A third of the sources lie in a package; of the others' folders, those that lack the sidecar or the note are none."""
    o = table(spark, sf_dir, "orders")
    at = F.concat(F.lit("in/p"), "o_orderkey")
    k = F.col("o_orderkey") % 3
    listing = o.select(F.explode(F.array(F.when(k != 1, F.concat(at, F.lit("/meta.json"))), F.when(k != 2, F.concat(at, F.lit("/p"), "o_orderkey", F.lit(".md"))))).alias("path")).where("path IS NOT NULL")
    sources = o.select("o_orderkey", F.concat(at, F.lit("/file.pdf")).alias("path"), F.when(k == 1, F.concat(F.lit(" Title  "), "o_custkey")).otherwise("..").alias("title"))
    return packages.destinations(sources, listing, "out").select("o_orderkey", "folder", "stem")


@query(r"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'The CPU backend ran out of memory on this page. WebAssembly is capped at 4 GB, and pages that split into many tiles exceed it — this document needs a GPU. Other documents may still convert on the CPU.'
  WHEN event_id % 4 = 1 THEN 'Conversion ran out of memory (failed, ERROR_CODE: 6, x). Try a shorter document, or restart the application to free memory.' WHEN event_id % 4 = 2 THEN 'Conversion failed: failed, ERROR_CODE: 61' ELSE 'Conversion failed: ' END AS message FROM events""")
def failure_messages(spark, sf_dir):
    k = F.col("event_id") % 4
    message = F.when(k == 0, "std::bad_alloc").when(k == 1, "failed, ERROR_CODE: 6, x").when(k == 2, "failed, ERROR_CODE: 61")
    return table(spark, sf_dir, "events").select("event_id", text.explain_failure(message, F.when(k == 0, "wasm").when(k == 1, "webgpu").when(k == 2, "cpu")).alias("message"))


from . import books  # noqa: E402, F401 - adds its queries

from . import branches, conversions, streams  # noqa: E402, F401 - add their queries
