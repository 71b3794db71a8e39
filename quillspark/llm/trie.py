"""The prefix trie of conversations, from mergeable partial tries.

A node is a sequence of first turns and is known by a 128-bit digest: the exclusive or of the digests of its turns with their
depths, so that the digest of a long path comes from those of its pieces and a parent's from its child's. Tasks emit locally
combined node tables; ``merge`` sums members and takes the smallest one, first within a few dozen shares of each node, then
over all. Lists of ends merge likewise: sorted pieces of neighbouring ids are joined to texts, and the texts are digested in order.
The rollup goes bottom-up along paths: a node's own value is added up from the end of its smallest member's path, each path's sum is
handed to the prefixes that it shares with a smaller member, and these sums merge by the node's digest. So no step depends on the depth.

No key gathers its rows in one task: turns are sorted over ranges of (conversation, turn), ranks and digests run over pieces
and the pieces' totals, and a node that very many nodes hang on is joined by broadcast (at most 1,000 such).
Only the digest of a node's ends reads a node's pieces in one task, as SHA-256 must; it streams them.

Defined cases: null turns come first, ties of a turn go by role, then text; null role or text is empty; rows without a conv_id
take no part; repeated rows are turns like others; other columns are ignored; without conversations there is no node at all.
A turnless conversation, which only the rebuilding can make, ends at the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_RE, drop_written, only, written

#: Turns in a piece of a conversation, conversations in a piece of a list of ends.
PIECE, ENDS = 4096, 65536
#: The first turns that a group of conversations shares, at most, and how many ids make a group: fixed values of the contract.
SHARED, GROUP = 3, 20
#: Shares of a node in the first merge, and how many nodes can have a thousandth of all children.
SHARES, HOT = 64, 1000


def _words(text: str) -> Column:
    w = F.split(F.col(text), f"{WHITE_RE}+")
    return (F.size(w) - F.when(w[0] == "", 1).otherwise(0) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)).cast("long")


def ranked(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), x1, x2 (the digest of role and text), words; written.

    Rows are sorted over ranges of (conv_id, turn, role, the text's beginning), so a conversation of any length is spread over
    tasks; its ranks are the places in a task plus the rows of the tasks before.
    """
    c = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    c = c.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(c.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    c = c.withColumn("begin", F.substring("text", 1, 64)).repartitionByRange(n, "conv_id", F.asc_nulls_first("turn"), "role", "begin")
    c = c.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    digest = (F.xxhash64("role", "text").alias("x1"), F.xxhash64(F.lit(7), "text", "role").alias("x2"))
    rows = written(c.select("conv_id", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("at"), *digest, _words("text").alias("words")), "turns")
    spans = rows.groupBy("conv_id", "task").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.join(spans.select("conv_id", "task", "first", before.alias("before")), ["conv_id", "task"])
    out = written(out.select("conv_id", (F.col("before") + F.col("at") - F.col("first") + 1).alias("rank"), "x1", "x2", "words"), "ranked")
    drop_written(rows)
    return out


def rebuilt(turns: DataFrame) -> DataFrame:
    """The rebuilt conversations: conv_id, d (depth from 0), x1, x2, words; the row of depth 0 is the root's.

    Conversation c has the first ``crc32(c) % 4`` turns of ``c - c % 20``, then its own after as many.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    counts = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.select("conv_id", "n", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base")), "conversations")
    of = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    made = written(counts.join(of, "base", "left").select("conv_id", "base", "h", F.least(F.col("h"), F.coalesce("n_base", F.lit(0))).alias("m")), "made")
    heads = turns.where(F.col("rank") <= SHARED).select(F.col("conv_id").alias("base"), "rank", "x1", "x2", "words")
    lent = made.where("m > 0").join(heads, "base").where("rank <= m").select("conv_id", F.col("rank").alias("d"), "x1", "x2", "words")
    # the piece number is part of the key, so a long conversation's turns don't meet in one task
    piece = F.floor(F.col("rank") / PIECE)
    pieces = turns.groupBy("conv_id", piece.alias("piece")).agg(F.lit(1).alias("__one")).join(made, "conv_id").select("conv_id", "piece", "h", "m")
    own = turns.withColumn("piece", piece).join(pieces, ["conv_id", "piece"]).where("rank > h").select("conv_id", (F.col("m") + F.col("rank") - F.col("h")).alias("d"), "x1", "x2", "words")
    zero = F.lit(0).cast("long")
    root = made.select("conv_id", zero.alias("d"), zero.alias("x1"), zero.alias("x2"), zero.alias("words"))
    return written(root.unionByName(lent.withColumn("d", F.col("d").cast("long"))).unionByName(own.withColumn("d", F.col("d").cast("long"))), "rebuilt")


def with_digests(rows: DataFrame) -> DataFrame:
    """Adds k1, k2, the digest of the path down to each row, and p1, p2, that of its parent."""
    own = rows.withColumns({"piece": F.floor(F.col("d") / PIECE), "g1": F.when(F.col("d") > 0, F.xxhash64("d", "x1", "x2")).otherwise(F.lit(0).cast("long")), "g2": F.when(F.col("d") > 0, F.xxhash64("x2", "d", "x1")).otherwise(F.lit(0).cast("long"))})
    within = Window.partitionBy("conv_id", "piece").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    inside = own.select("conv_id", "d", "words", "piece", "g1", "g2", F.bit_xor("g1").over(within).alias("k1"), F.bit_xor("g2").over(within).alias("k2"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = own.groupBy("conv_id", "piece").agg(F.bit_xor("g1").alias("t1"), F.bit_xor("g2").alias("t2"), F.max("d").alias("last"))
    pieces = pieces.select("conv_id", "piece", F.max("last").over(Window.partitionBy("conv_id")).alias("last"), F.coalesce(F.bit_xor("t1").over(earlier), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("t2").over(earlier), F.lit(0)).alias("b2"))
    out = inside.join(pieces, ["conv_id", "piece"])
    k1, k2 = F.col("k1").bitwiseXOR(F.col("b1")), F.col("k2").bitwiseXOR(F.col("b2"))
    return written(out.select("conv_id", "d", "words", (F.col("d") == F.col("last")).alias("ends"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("g1")).alias("p1"), k2.bitwiseXOR(F.col("g2")).alias("p2")), "paths")


def partial(paths: DataFrame) -> DataFrame:
    """Paths as node tables of one member each: k1, k2, d, p1, p2, words, conv_id (smallest member), n_convs."""
    return paths.select("k1", "k2", "d", "p1", "p2", "words", "conv_id", F.lit(1).cast("long").alias("n_convs"))


def merge(tables: DataFrame) -> DataFrame:
    """One node table of a union of node tables: members are summed and the smallest taken, in two rounds.

    Each task combines its rows before it sends them; the first round leaves at most ``SHARES`` rows of a node that has
    rows in every task, the second one row.
    """
    own = ("k1", "k2", "d", "p1", "p2", "words")
    sums = (F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    shared = tables.withColumn("share", F.spark_partition_id() % SHARES)
    return shared.groupBy(*own, "share").agg(*sums).groupBy(*own).agg(*sums)


def ends_digest(paths: DataFrame) -> DataFrame:
    """k1, k2, d, ends_sha256 of every node that a conversation ends at: its ids as decimals, ascending, joined by commas.

    Ids of one range of ``ENDS`` numbers become one text (at most as many ids); a node's texts are then digested in order.
    """
    ids = paths.where("ends").groupBy("k1", "k2", "d", F.floor(F.col("conv_id") / ENDS).alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    texts = ids.select("k1", "k2", "d", "piece", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"))
    texts = texts.repartition("k1", "k2", "d").sortWithinPartitions("k1", "k2", "d", "piece")
    return texts.mapInArrow(_digests, "k1 long, k2 long, d long, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("d", pa.int64()), ("ends_sha256", pa.string())])
    key, state, out = None, None, []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(3)]
        for new, ids in zip(zip(*columns, strict=True), batch.column(4), strict=True):
            if new == key:
                state.update(b",")
            else:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = new, hashlib.sha256()
            state.update(ids.as_py().encode())
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if key:
        out.append((*key, state.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def with_parents(nodes: DataFrame) -> DataFrame:
    """Adds n_children and parent_conv_id (null for the root). Written.

    All nodes together have fewer children than there are nodes, so at most ``HOT`` of them have more than one child in ``HOT``:
    those are broadcast to their children, and only the children of the others are shuffled.
    """
    node, parent = ["k1", "k2", "d"], ["p1", "p2", "d"]
    children = nodes.where("d > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("d") - 1).alias("d")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = written(nodes.join(children, node, "left").na.fill(0, ["n_children"]), "nodes")
    parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("d") + 1).alias("d"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    hot = F.col("n_children") * HOT > nodes.count()
    near = nodes.join(F.broadcast(parents.where(hot).drop("n_children")), parent, "left")
    far = near.where("parent_conv_id IS NULL").drop("parent_conv_id").join(parents.where(~hot).drop("n_children"), parent, "left")
    out = written(near.where("parent_conv_id IS NOT NULL").unionByName(far), "with-parents")
    drop_written(nodes)
    return out


def with_rollup(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens, sums over the node and all below it.

    The nodes that have one smallest member are the end of that member's path, without a gap. Their values are added up from
    the deepest, and their whole is handed to the nodes above, which the path shares with smaller members.
    """
    own = nodes.withColumns({"piece": F.floor(F.col("d") / PIECE), "leaf": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("words")})
    below = Window.partitionBy("conv_id", "piece").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    deeper = Window.partitionBy("conv_id").orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)
    pieces = own.groupBy("conv_id", "piece").agg(F.sum("leaf").alias("t_leaf"), F.sum("saved").alias("t_saved"), F.min("d").alias("top"))
    carried = pieces.select("conv_id", "piece", F.coalesce(F.sum("t_leaf").over(deeper), F.lit(0)).alias("b_leaf"), F.coalesce(F.sum("t_saved").over(deeper), F.lit(0)).alias("b_saved"))
    inside = own.withColumns({"leaf": F.sum("leaf").over(below), "saved": F.sum("saved").over(below)})
    inside = inside.join(carried, ["conv_id", "piece"]).withColumns({"leaf": F.col("leaf") + F.col("b_leaf"), "saved": F.col("saved") + F.col("b_saved")}).drop("piece", "b_leaf", "b_saved")
    whole = pieces.groupBy("conv_id").agg(F.min("top").alias("top"), F.sum("t_leaf").alias("h_leaf"), F.sum("t_saved").alias("h_saved")).where("top > 0 AND (h_leaf > 0 OR h_saved > 0)")
    whole = whole.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("top") - 1) / PIECE))))
    above = paths.select("conv_id", "d", "k1", "k2", F.floor(F.col("d") / PIECE).alias("piece")).join(whole, ["conv_id", "piece"]).where("d < top")
    handed = above.groupBy("k1", "k2", "d").agg(F.sum("h_leaf").alias("h_leaf"), F.sum("h_saved").alias("h_saved"))
    out = inside.join(handed, ["k1", "k2", "d"], "left")
    zero = F.lit(0).cast("long")
    return out.withColumns({"n_leaves": F.col("leaf") + F.coalesce("h_leaf", zero), "saved_tokens": F.col("saved") + F.coalesce("h_saved", zero)}).drop("leaf", "saved", "h_leaf", "h_saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    One row for each distinct sequence of first turns, the root's included.
    """
    turns = ranked(conversations)
    rows = rebuilt(turns)
    paths = with_digests(rows)
    nodes = with_rollup(with_parents(merge(partial(paths))), paths)
    out = nodes.join(ends_digest(paths), ["k1", "k2", "d"], "left")
    none = hashlib.sha256(b"").hexdigest()
    out = out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
    drop_written(turns)
    drop_written(rows)
    return out
