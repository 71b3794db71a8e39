"""Fuzzy line deduplication by MinHash, in DataFrame functions only.

Equal lines are one line first. A line is the set of its character shingles; minima of a signature are taken over those of
them whose hash is in a line's share: all of a short line, and of a longer one as many as leave about SAMPLE, by bits of the
hash, so that lines of one length choose alike. Bands of minima give candidates, a sketch of all minima tells which of them
are likely to be similar, whole shingle sets verify those, and distributed union-find joins verified lines; of each
component the first line, by document and place, stays.

Small bands give all their pairs. A band that many lines share isn't expanded into pairs: in two turns its lines are held
against a few neighbours and one pivot. Of the pairs of the first turn each line's likeliest is verified; the others wait for
the second, when most are of one component, and only those of different ones are verified. Of the larger bands only lines go
on that have a partner of another component whose sketch agrees; of their pairs those are verified whose parity sketches
differ by no more bits than the sets of similar lines may differ by elements.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE, drop_written, only, release, written
from .graph import components

#: Characters in a shingle, of the signature as of the verification.
SHINGLE = 5
#: Minima in a band, and bands: 99.5 % of the pairs with a similarity of 0.8 meet in one, 99.99 % of those with 0.9.
ROWS, BANDS = 4, 10
#: Shingles that a signature is made of, at least, where a line has as many.
SAMPLE = 48
#: Minima, of ROWS * BANDS, that may differ: 99.8 % of the pairs with a similarity of 0.8 differ in no more.
DIFFER = 16
#: The same for lines that are held against a pivot: they are likely to be similar, and what is missed here comes afterwards.
LIKELY = 9
#: Lines of a band that are all held against each other at once; those of larger bands meet a few others in two turns.
SMALL = 8
#: Seconds until Spark's Python side has let go of a table: a thread of its looks once a second.
WAIT = 1.2
#: A signature of a sample that has fewer different shingles, as a bitmap of 64 counts them, is made again of all of the line's.
FEW = 12
#: Minima are those of a hash turned by some bits and crossed with a number: of one order each. Low bits choose the sample.
_RANDOM = random.Random(20240229)
ORDERS = [(turn, _RANDOM.randrange(-(2**63), 2**63)) for turn in range(0, 42, 6) for _ in range(6)][: ROWS * BANDS]
NIBBLES = 0x1111111111111111


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line, h) of the lines that take part: every one with a word."""
    d = only(docs, "doc_id", "text").where("text IS NOT NULL AND doc_id IS NOT NULL")
    d = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    # not by a regular expression, for which each line would be decoded
    return d.where(F.ltrim("line", F.lit(WHITE)) != "").withColumn("h", F.xxhash64("line"))


def _turned(x: str, bits: int) -> str:
    return f"(shiftleft({x}, {bits}) | shiftrightunsigned({x}, {64 - bits}))" if bits else x


def _share(n: str) -> str:
    """How many low bits of a hash must be zero for a line of ``n`` shingles."""
    return f"greatest(0, cast(floor(log2({n} / {SAMPLE}D)) AS int))"


def _once(df: DataFrame, *keep: str, **made: Column) -> DataFrame:
    """``keep`` and the new columns, each computed once a row: an optimizer copies no expression across an explode."""
    return df.select(*keep, F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("__x")).select(*keep, *[f"__x.{n}" for n in made])


def signatures(distinct: DataFrame, *keep: str, whole: bool = False) -> DataFrame:
    """(h, share, second, bands, sketch, few, and what to ``keep``) per line of ``distinct(h, line)``, which must be partitioned by h, so that nothing is shuffled.

    A line near the end of its share has a ``second`` signature in the next one, where its longer partners are. ``bands`` are
    hashes of ROWS minima each, ``sketch`` holds four bits of each minimum. ``whole`` makes them of all shingles.
    """
    d = distinct.selectExpr("h", *keep, "encode(line, 'UTF-32') AS b", f"greatest(1, length(line) - {SHINGLE - 1}) AS n")
    d = d.selectExpr("h", *keep, "b", "n", *([f"{_share('n')} AS low", f"{_share('n * 1.25D')} AS high"] if not whole else ["0 AS low", "0 AS high"]))
    d = d.select("h", *keep, "b", "low", "high", F.explode(F.expr("sequence(0, n - 1)")).alias("i"))
    d = d.selectExpr("h", *keep, "low", "high", "i", f"xxhash64(substring(b, 4 * i + 1, {4 * SHINGLE})) AS x").where("i = 0 OR x & (shiftleft(1L, low) - 1) = 0")
    # the first shingle stands for a line of which none is in the share
    d = d.select("h", *keep, F.expr("CASE WHEN x & (shiftleft(1L, low) - 1) = 0 THEN x END AS x"), F.explode(F.expr("CASE WHEN high > low AND x & (shiftleft(1L, high) - 1) = 0 THEN array(2 * low, 2 * high + 1) ELSE array(2 * low) END")).alias("half"))
    mins = [F.min(F.expr(f"{_turned('x', turn)} ^ {number}L")).alias(f"m{k}") for k, (turn, number) in enumerate(ORDERS)]
    mins = d.groupBy("h", "half", *keep).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(x, 58) AS int))")).alias("seen"), *mins)
    # one array first: a projection of all that follows over 40 columns is too much code for the compiler
    mins = _once(mins.withColumn("share", F.expr("half div 2").cast("int")), "h", "share", "half", "seen", *keep, m=F.array(*[f"m{k}" for k in range(len(ORDERS))]))
    parts = ", ".join(f"m[{ROWS} * b + {r}]" for r in range(ROWS))
    bands = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, share, {parts}))")
    sketch = F.expr(f"transform(sequence(0, {-(-len(ORDERS) // 16) - 1}), w -> aggregate(slice(m, 16 * w + 1, 16), 0L, (s, x) -> shiftleft(s, 4) | (xxhash64(x) & 15)))")
    few = F.expr(f"share > 0 AND coalesce(bit_count(seen), 0) < {FEW}")
    return mins.select("h", "share", F.expr("half & 1 = 1").alias("second"), *keep, bands.alias("bands"), sketch.alias("sketch"), few.alias("few"))


def differing(x: str, y: str) -> str:
    """SQL: the number of minima in which two sketches differ."""
    word = lambda w: f"({x}[{w}] ^ {y}[{w}])"
    some = lambda w: f"bit_count(({word(w)} | shiftrightunsigned({word(w)}, 1) | shiftrightunsigned({word(w)}, 2) | shiftrightunsigned({word(w)}, 3)) & {NIBBLES}L)"
    return " + ".join(some(w) for w in range(-(-len(ORDERS) // 16)))


def agree(x: str, y: str, differ: int = DIFFER) -> str:
    """SQL: two sketches differ in ``differ`` minima at most."""
    return f"{differing(x, y)} <= {differ}"


def _shingles(line: str) -> Column:
    """The hash of every shingle of SHINGLE code points of a line; of a shorter one, of itself. They may repeat."""
    return F.expr(f"transform(array(encode({line}, 'UTF-32')), b -> transform(sequence(1, greatest(1, cast(octet_length(b) AS int) - {4 * SHINGLE - 1}), 4), i -> xxhash64(substring(b, i, {4 * SHINGLE}))))[0]")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The ``pairs(a, b)`` whose lines in ``texts(h, line)`` are similar enough, by whole shingle sets. Lines are joined, and their sets made here: a set is 20 times its line."""
    both = pairs.join(texts.selectExpr("h AS a", "line AS la"), "a").join(texts.selectExpr("h AS b", "line AS lb"), "b")
    both = _once(both, "a", "b", sa=_shingles("la"), sb=_shingles("lb"))
    both = _once(both, "a", "b", whole=F.size(F.array_union("sa", "sb")), total=F.size(F.array_distinct("sa")) + F.size(F.array_distinct("sb")))
    return both.where(f"100 * (total - whole) >= {percent} * whole").select("a", "b")


def _texts(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h, line) of the lines ``wanted(h)``. A bitmap of 2**22 bits keeps most of the others out of the shuffle."""
    wanted = written(wanted.distinct(), "wanted")
    bits = wanted.groupBy(F.expr("h & 65535").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 16) & 63 AS int))")).alias("bits"))
    bitmap = wanted.sparkSession.range(65536).join(bits, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b")).select(F.col("b.bits")).scalar()
    some = lines.where(F.get(bitmap, F.expr("cast(h & 65535 AS int)")).bitwiseAND(F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 16) & 63 AS int))")) != 0)
    return written(some.join(wanted, "h", "left_semi").groupBy("h").agg(F.first("line").alias("line")), "texts")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("h"))


def _neighbours(rows: DataFrame, turn: int) -> DataFrame:
    """(h, o, d): a few partners o for each line h of ``rows(key, h, c, degree, sketch)``, of one band and different components, that are likely to be similar, and in how many minima they differ.

    A line meets those just before it, in an order by some of the minima that changes with band and turn, and one pivot. The
    first turn, which joins most, takes few.
    """
    line = F.struct("h", "c", "sketch")
    order = Window.partitionBy("key").orderBy(F.expr(f"sketch[cast(pmod(key + {turn}, {-(-len(ORDERS) // 16)}) AS int)]"), "h")
    first = F.col("degree") if not turn else F.xxhash64("h", F.lit(turn))
    pivot = F.max(F.struct(first.alias("by"), line.alias("line"))).over(Window.partitionBy("key"))["line"]
    met = rows.select("h", "c", "sketch", F.array(pivot, *[F.lag(line, k).over(order) for k in range(1, SMALL if turn else 2)]).alias("others"))
    met = met.withColumn("o", F.explode("others")).where("o.h <> h AND o.c <> c")
    return met.where(agree("sketch", "o.sketch", LIKELY)).select("h", F.col("o.h").alias("o"), F.expr(differing("sketch", "o.sketch")).alias("d"))


def _all_pairs(rows: DataFrame) -> DataFrame:
    """(h, o, d) of all pairs in the bands of ``rows(key, h, sketch)`` that may be similar, and in how many minima they differ."""
    other = rows.selectExpr("key", "h AS o", "sketch AS so")
    return rows.select("key", "h", "sketch").join(other, "key").where(f"o < h AND {agree('sketch', 'so')}").select("h", "o", F.expr(differing("sketch", "so")).alias("d"))


def _pairs(met: DataFrame) -> DataFrame:
    """(a, b) of ``met(h, o)``, each once, the smaller first."""
    return met.selectExpr("least(h, o) AS a", "greatest(h, o) AS b").distinct()


def _across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The ``pairs(a, b)`` of different components, with these as ca and cb; a line that ``comps(h, component)`` hasn't is one by itself."""
    for end in "ab":
        pairs = pairs.join(comps.selectExpr(f"h AS {end}", f"component AS c{end}"), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb")


def _linked(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` that are similar enough, written; only their own lines are fetched."""
    texts = _texts(lines, _ends(pairs))
    links = written(_verified(pairs, texts, percent), "links")
    drop_written(texts)
    return links


def _width(share: str) -> str:
    """64-bit words of a parity sketch: about four bits for each shingle that similar lines of a share may differ by, 4 to 64 words."""
    return f"cast(greatest(4, least(64, shiftleft(1, least({share}, 6) + 1))) AS int)"


def parities(texts: DataFrame) -> DataFrame:
    """(h, size, parity) of ``texts(h, line)``: the size of the shingle set, and a bit for the parity of the shingles dealt to it.

    Two sets differ by as many shingles, at least, as their sketches do by bits.
    """
    d = texts.withColumn("width", F.expr(_width(_share(f"greatest(1, length(line) - {SHINGLE - 1}) * 1.25D"))))
    d = _once(d, "h", "width", s=F.array_distinct(_shingles("line"))).select("h", "width", F.size("s").alias("size"), F.explode("s").alias("x")).withColumn("x", F.xxhash64("x"))
    d = d.groupBy("h", "width", "size", F.expr("cast(shiftrightunsigned(x, 6) & (width - 1) AS int)").alias("word")).agg(F.bit_xor(F.expr("shiftleft(1L, cast(x & 63 AS int))")).alias("bits"))
    d = d.groupBy("h", "width", "size").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))
    return d.select("h", "size", F.expr("transform(sequence(0, width - 1), k -> coalesce(words[k], 0L))").alias("parity"))


def _near(percent: int) -> str:
    """SQL: the sizes and parity sketches of a and b let them be similar enough."""
    differ = "aggregate(zip_with(parity_a, parity_b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"
    return f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b) AND {differ} <= (size_a + size_b) * {100 - percent} div {100 + percent}"


def _fold(width: str) -> str:
    return f"CASE WHEN size(parity) > {width} THEN transform(sequence(0, {width} - 1), k -> aggregate(sequence(0, size(parity) div {width} - 1), 0L, (b, j) -> b ^ parity[cast(k + j * {width} AS int)])) ELSE parity END"


def linked(docs: DataFrame, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(a, b): links of lines, by hash, that join every component of similar lines; and (h, doc_id, line_no, n) of each different line, its first place and how many it has."""
    spark = docs.sparkSession
    lines = lines_of(docs)
    # equal lines meet once per task before the shuffle; what follows stays in the partitions that this makes
    classes = lines.groupBy("h").agg(F.first("line").alias("line"), F.min(F.struct("doc_id", "line_no")).alias("at"), F.count("*").alias("n_rows")).select("h", "line", "at.doc_id", "at.line_no", "n_rows")
    made = written(signatures(classes, "doc_id", "line_no", "n_rows"), "signatures")
    del classes
    release(spark, WAIT)
    firsts = written(made.where("NOT second").selectExpr("h", "doc_id", "line_no", "n_rows AS n"), "firsts")
    again = _texts(lines, made.where("few").select("h"))
    again = written(signatures(again.groupBy("h").agg(F.first("line").alias("line")), whole=True), "signatures")
    table, made = made, made.drop("doc_id", "line_no", "n_rows").unionByName(again)
    by_key = Window.partitionBy("key")
    keyed = made.select("h", "share", F.explode("bands").alias("key"))
    shared = written(keyed.withColumn("n", F.count("*").over(by_key)).where("n > 1"), "shared")
    release(spark, WAIT)
    # by h alone, so that counting a line's bands and fetching its sketch take one shuffle
    sketches = made.selectExpr("h", "share AS its", "sketch")
    rows = shared.withColumn("degree", F.count("*").over(Window.partitionBy("h"))).join(sketches, "h").where("share = its").drop("its")
    rows = written(rows.withColumn("c", F.col("h")), "rows")
    release(spark, WAIT)
    for x in (shared, table, again):
        drop_written(x)

    def apart(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The components of ``links``, and rows of larger bands that hold more than one."""
        comps = written(components(links), "components").withColumnRenamed("node", "h")
        release(spark)
        named = rows.where(f"n > {SMALL}").drop("c").join(comps, "h", "left").withColumn("c", F.coalesce("component", "h")).drop("component")
        named = named.withColumn("low", F.min("c").over(by_key)).withColumn("high", F.max("c").over(by_key))
        return comps, written(named.where("low <> high").drop("low", "high"), "rows")

    met = _all_pairs(rows.where(f"n <= {SMALL}")).unionByName(_neighbours(rows.where(f"n > {SMALL}"), 0))
    met = written(met.distinct(), "met")
    best = met.where(f"d <= {LIKELY}").groupBy("h").agg(F.min(F.struct("d", "o")).alias("best")).selectExpr("h", "best.o")
    tested = written(_pairs(best), "pairs")
    links = _linked(tested, lines, percent)
    comps, left = apart(links)
    drop_written(rows)
    rows = left
    # of the pairs of two components the likeliest; the others wait until it is known whether that has joined them
    waiting = met.selectExpr("least(h, o) AS a", "greatest(h, o) AS b", "d").join(tested, ["a", "b"], "left_anti")
    likeliest = _across(waiting, comps).groupBy(F.expr("least(ca, cb)"), F.expr("greatest(ca, cb)")).agg(F.min(F.struct("d", "a", "b")).alias("best")).select("best.a", "best.b")
    pairs = _pairs(_neighbours(rows, 1)).unionByName(likeliest).distinct()
    pairs = written(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    tested = tested.unionByName(pairs)
    links = links.unionByName(_linked(pairs, lines, percent))
    comps, left = apart(links)
    drop_written(rows)
    rows = left
    waiting = written(_across(waiting, comps).select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"), "waiting")
    drop_written(met)
    # lines without a partner whose sketch agrees need no text: one row a line comes out, however large its band is
    x, y = (rows.selectExpr("*", f"h AS h_{k}", f"c AS c_{k}", f"sketch AS sketch_{k}") for k in "ab")
    rest = x.join(y.select("key", "h_b", "c_b", "sketch_b"), (x["key"] == y["key"]) & F.expr(f"h_a <> h_b AND c_a <> c_b AND {agree('sketch_a', 'sketch_b')}"), "left_semi")
    rest = written(rest.select(*rows.columns), "rest")
    texts = _texts(lines, rest.select("h").unionByName(_ends(waiting)))
    left = written(rest.join(parities(texts.join(rest, "h", "left_semi")), "h").withColumn("parity", F.expr(_fold(_width("share")))), "left")
    x, y = (left.selectExpr("key", *[f"{n} AS {n}_{k}" for n in ("h", "c", "sketch", "size", "parity")]) for k in "ab")
    near = x.join(y, "key").where(f"h_a < h_b AND c_a <> c_b AND {agree('sketch_a', 'sketch_b')} AND {_near(percent)}")
    near = written(near.selectExpr("h_a AS a", "h_b AS b").distinct().join(tested, ["a", "b"], "left_anti"), "near")
    release(spark)
    more = written(_verified(near.unionByName(waiting).distinct(), texts, percent), "links")
    release(spark)
    for x in (rows, rest, left, texts, waiting):
        drop_written(x)
    return links.unionByName(more), firsts


def dropped(docs: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, line_no) of every line of ``docs(doc_id, text)`` that equals or resembles an earlier one."""
    return _dropped(docs, percent).select("doc_id", "line_no")


def _dropped(docs: DataFrame, percent: int) -> DataFrame:
    """``dropped`` with each line's hash h.

    "Earlier" is by id, then by place: each component keeps its first line. Rows with a null id or text have no lines here.
    Where an id repeats, its rows' lines are told apart by place and hash: equal ones at one place stay or go together.
    """
    spark = docs.sparkSession
    lines = lines_of(docs)
    links, firsts = linked(docs, percent)
    comps = written(components(links), "components")
    # each line's component, and the component's first line
    firsts = firsts.select("h", F.struct("doc_id", "line_no").alias("at"), "n")
    named = firsts.join(comps.withColumnRenamed("node", "h"), "h", "left").where("n > 1 OR component IS NOT NULL").select("h", "at", "n", F.coalesce("component", "h").alias("component"))
    named = written(named, "named")
    best = written(named.groupBy("component").agg(F.min(F.struct("at", "h")).alias("first"), F.sum("n").alias("n")).where("n > 1"), "best")
    repeated = written(named.select("h", "component").join(best.select("component", "first"), "component").select("h", "first"), "repeated")
    release(spark)
    hit = lines.select("h", "doc_id", "line_no").join(repeated, "h").where("NOT (h = first.h AND doc_id = first.at.doc_id AND line_no = first.at.line_no)")
    return hit.select("doc_id", "line_no", "h")


def drop_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with the lines of ``dropped`` taken out of ``text``, all columns and rows otherwise unchanged.

    Null texts stay null, an empty table stays empty; a text all of whose lines go becomes empty. ``n_chars``, where there
    is such a column, is brought up to date.
    """
    # removed places by runs of RUN lines, so that a line is only looked for among those of its own run
    gone = _dropped(docs, percent).groupBy("doc_id", F.expr(f"line_no div {RUN}").cast("int").alias("run")).agg(F.collect_set(F.struct("line_no", "h")).alias("at"))
    gone = gone.groupBy(F.col("doc_id").alias(GONE + "id")).agg(F.map_from_entries(F.collect_list(F.struct("run", "at"))).alias("runs"))
    gone = written(gone.select(GONE + "id", F.expr("transform(sequence(0, array_max(map_keys(runs))), k -> runs[k])").alias(GONE)), "gone")
    release(docs.sparkSession)
    out = docs.join(gone, F.col("doc_id") == F.col(GONE + "id"), "left")
    kept = F.expr(f"CASE WHEN {GONE} IS NULL THEN text ELSE array_join(filter(split(text, '\\n'), (x, i) -> NOT coalesce(array_contains(get({GONE}, i div {RUN}), struct(i AS line_no, xxhash64(x) AS h)), false)), '\n') END")
    made = {"text": kept}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(GONE).isNull(), F.col("n_chars")).otherwise(F.length(kept).cast(docs.schema["n_chars"].dataType))
    return out.select(*[made.get(c, docs[c]).alias(c) for c in docs.columns])


#: Lines in a run of places.
RUN = 128
#: A name that no column of a table has.
GONE = "__gone_6d1f0c"
