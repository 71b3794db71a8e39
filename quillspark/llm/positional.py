"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

``index`` stores the postings of training tokens (term, document, place) where the documents are read, without a shuffle.
``phrases`` takes the two rarest terms of every window of a test item by their counts in all documents, moves each posting
by the term's offset in its item, and intersects the two lists; what survives is intersected with the lists of the window's other
terms. ``proximity`` finds the places where all words of an item stand close together in any order.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became a-z. Defined cases: a null or empty text has no words and
no postings; an item without words or without an id takes no part; repeated items count once by their id; repeated rows of
documents each get the same result; other columns are ignored. Nothing is capped: an item of common words only makes as many
candidates as its second rarest term's list has places beside the rarest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, only, written

#: Words in a window.
WINDOW = 10
#: What parts words, where A-Z still are letters.
PARTING = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document's key: rows of one id with different texts stay apart.
KEY = ("doc_id", "text_hash")


def split_words(text: str | Column) -> Column:
    """The words in order, cases as they are; the first and the last may be empty."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), PARTING)


def folded(word: Column) -> Column:
    """A-Z to a-z, nothing else: ``lower`` where all characters are ASCII, which is quick."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def count_words(text: str | Column) -> Column:
    """How many words a text has (long)."""
    w = split_words(text)
    return (F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)).cast("long")


def item_words(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """A row for each word of each item: item, item_id, q (place from 0), n_item (the item's words), word. Written.

    Items are small beside the documents; ``item`` is a number for each distinct pair of id and text.
    """
    i = items.where(F.col(item_id).isNotNull()).select(F.col(item_id).alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).distinct()
    i = i.select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_remove(split_words("__t"), "").alias("__w"))
    i = i.select("item", "item_id", F.size("__w").alias("n_item"), F.posexplode("__w").alias("q", "word"))
    return written(i.withColumn("word", folded(F.col("word"))), "item-words")


def vocabulary(words: DataFrame) -> DataFrame:
    """The distinct words of a column ``word``, numbered (``term``). Written, so that the numbers stay."""
    return written(words.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")


def index(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of whole texts: term, doc_id, text_hash, pos. Written in the documents' order, without a shuffle.

    ``terms`` (word, term) are the words to store; ``vocabulary`` of all documents' words stores every token. Words that no
    item holds can be left out, as no item asks for them. Spark broadcasts ``terms`` where it is small, else joins by
    word and splits the frequent ones. ``pos`` counts from 0, or from 1 after leading separators: differences count.
    """
    d = only(docs, doc_id, text).toDF("doc_id", "__t")
    d = d.select("doc_id", F.xxhash64("__t").alias("text_hash"), F.posexplode(split_words("__t")).alias("pos", "word")).where("word <> ''")
    return written(d.withColumn("word", folded(F.col("word"))).join(terms, "word").select("term", *KEY, "pos"), "postings")


def _with_counts(words: DataFrame, terms: DataFrame, postings: DataFrame) -> DataFrame:
    """Items' words with their terms and the terms' counts over all documents."""
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return written(words.join(terms, "word").join(counts, "term", "left").select("item", "item_id", "n_item", "q", "term", F.coalesce("n", F.lit(0)).alias("n")), "item-terms")


def _seeds(terms: DataFrame, window: int) -> DataFrame:
    """The two rarest terms of each window, q1 and q2 their places in the item, and the places lo..hi of the windows that have them.

    A window with a term that no document has is left out: it occurs nowhere.
    """
    ahead = Window.partitionBy("item").orderBy("q").rowsBetween(0, window - 1)
    w = terms.withColumn("__w", F.array_sort(F.collect_list(F.struct("n", "q", "term")).over(ahead)))
    w = w.where((F.size("__w") == F.least(F.col("n_item"), F.lit(window))) & (F.col("__w")[0]["n"] > 0))
    second = F.when(F.size("__w") > 1, F.col("__w")[1])
    w = w.select("item", F.col("__w")[0]["q"].alias("q1"), F.col("__w")[0]["term"].alias("t1"), second["q"].alias("q2"), second["term"].alias("t2"), F.col("q").alias("lo"), (F.col("q") + F.size("__w") - 1).alias("hi"))
    return w.groupBy("item", "q1", "t1", "q2", "t2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(F.monotonically_increasing_id().alias("seed"), "*")


def phrases(postings: DataFrame, words: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document word inside an occurrence of a window of an item: doc_id, text_hash, item_id, pos (distinct). Written.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. Each list is joined by what
    makes its rows few: the rarest terms first, the others only in documents where those meet.
    """
    known = _with_counts(words, terms, postings)
    seeds = written(_seeds(known, window), "seeds")
    sides = seeds.select(F.col("t1").alias("term"), "seed", F.col("q1").alias("q"), F.lit(1).alias("side")).unionAll(seeds.where("t2 IS NOT NULL").select(F.col("t2").alias("term"), "seed", F.col("q2").alias("q"), F.lit(2).alias("side")))
    moved = postings.join(sides, "term").select(*KEY, "seed", (F.col("pos") - F.col("q")).alias("start"), "side")
    met = moved.groupBy(*KEY, "seed", "start").agg(F.bit_or("side").alias("side")).join(seeds, "seed").where(F.col("side") == F.when(F.col("t2").isNull(), 1).otherwise(3))
    met = written(met.groupBy(*KEY, "item", "start").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), "met")
    wanted = met.select(*KEY, "item", "start", F.explode(F.sequence("lo", "hi")).alias("q")).join(known, ["item", "q"]).withColumn("pos", F.col("start") + F.col("q"))
    there = _meet(postings, met.select(*KEY).distinct(), KEY)
    found = _meet(wanted, there, (*KEY, "pos", "term"))
    place = Window.partitionBy(*KEY, "item", "start")
    runs = found.withColumn("__run", F.col("q") - F.row_number().over(place.orderBy("q")))
    runs = runs.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*KEY, "item", "start", "__run")))
    out = written(runs.where(F.col("__n") >= F.least(F.col("n_item"), F.lit(window))).select(*KEY, "item_id", "pos").distinct(), "hits")
    for done in (known, seeds, met):
        drop_written(done)
    return out


def _meet(a: DataFrame, b: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """The rows of ``a`` that have a partner with the same values in ``b``; null ids are equal."""
    b = b.select(*[F.col(n).alias(f"b_{n}") for n in names])
    return a.join(b, F.expr(" AND ".join(f"{n} <=> b_{n}" if n == "doc_id" else f"{n} = b_{n}" for n in names)), "left_semi")


def proximity(postings: DataFrame, words: DataFrame, terms: DataFrame, within: int) -> DataFrame:
    """Where all distinct words of an item stand in ``within`` consecutive words, in any order: doc_id, text_hash, item_id, pos.

    ``pos`` are the places of the item's rarest term that lie in such a stretch. Each of that term's postings asks only for the
    postings of the others in its own stretch of places and the two beside it, so a join has no more rows than those
    places. An item with a word that no document has, or with more distinct words than ``within``, is found nowhere.
    """
    known = _with_counts(words, terms, postings).groupBy("item", "item_id", "term").agg(F.min("n").alias("n"))
    whole = known.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("item"))).withColumn("__least", F.min("n").over(Window.partitionBy("item"))).where((F.col("__n") <= within) & (F.col("__least") > 0))
    whole = written(whole.withColumn("__k", F.row_number().over(Window.partitionBy("item").orderBy("n", "term"))).select("item", "item_id", "term", "__n", "__k"), "near-terms")
    bucket = F.floor(F.col("pos") / within)
    first = postings.join(whole.where("__k = 1").select("item", "item_id", "term", "__n"), "term").select(*KEY, "item", "item_id", "__n", F.col("pos").alias("at"), bucket.alias("__b"))
    first = first.withColumn("__b", F.explode(F.array(F.col("__b") - 1, F.col("__b"), F.col("__b") + 1)))
    all_terms = postings.join(whole.select("item", "term"), "term").select(*[F.col(k).alias(f"p_{k}") for k in KEY], F.col("item").alias("p_item"), "term", "pos", bucket.alias("p_b"))
    near = first.join(all_terms, F.col("doc_id").eqNullSafe(F.col("p_doc_id")) & F.expr(f"text_hash = p_text_hash AND item = p_item AND __b = p_b AND abs(pos - at) < {int(within)}"))
    near = near.groupBy(*KEY, "item", "item_id", "__n", "at").agg(F.collect_set(F.struct("pos", "term")).alias("__p"))
    ahead = lambda x: F.filter("__p", lambda y: (y["pos"] >= x["pos"]) & (y["pos"] < x["pos"] + within))
    full = F.exists("__p", lambda x: (x["pos"] <= F.col("at")) & (F.col("at") < x["pos"] + within) & (F.size(F.array_distinct(F.transform(ahead(x), lambda y: y["term"]))) == F.col("__n")))
    return near.where(full).select(*KEY, "item_id", F.col("at").alias("pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """What of each document occurs in ``items`` (item_id, text): doc_id, n_words, n_hit, n_items (long), items_sha256, contaminated.

    ``n_hit`` counts the words inside any occurrence of a window, ``items_sha256`` is the digest of the ids of the items that have
    one, sorted as strings and joined by commas (of the empty text where there is none).
    """
    words = item_words(items)
    terms = vocabulary(words)
    postings = index(docs, terms)
    hits = phrases(postings, words, terms, window)
    per = hits.groupBy(*KEY).agg(F.count_distinct("pos").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("__items"))
    d = only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_hash"), count_words("text").alias("n_words"))
    n = F.coalesce(F.col("n_hit"), F.lit(0).cast("long"))
    ids = F.coalesce(F.col("__items"), F.array().cast("array<string>"))
    joined = d.join(per.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), "n_hit", "__items"), F.expr("doc_id <=> __doc AND text_hash = __hash"), "left")
    return joined.select("doc_id", "n_words", n.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (n > 0).alias("contaminated"))
