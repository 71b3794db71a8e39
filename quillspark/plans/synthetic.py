"""DocTags pages and notes made from the relational tables, so that what an operator must give is known from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, doc_tags): two pages for each order.

    Lines of one number come by part, supplier, quantity and flag. The first has a title, a text and a table of its lines, a merged cell for each returned one; the second a section, two
    formulas, pictures with and without a caption, and a block of an unknown kind.
    """
    li = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("<fcel>"), F.col("l_linenumber"), F.lit("<fcel>P|"), F.col("l_partkey"), F.when(F.col("l_returnflag") == "R", "<lcel>").otherwise(F.concat(F.lit("<fcel> "), F.col("l_quantity").cast("long"), F.lit(" "))), F.lit("<nl>"))
    rows = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", row.alias("row")))), lambda x: x["row"]), "")
    d = li.groupBy("l_orderkey").agg(rows.alias("rows"), F.count("*").alias("n"))
    key = F.col("l_orderkey").cast("string")
    one = F.concat(F.lit("<doctag><page_header>x</page_header><title><loc_50><loc_10><loc_450><loc_40>Order  "), key, F.lit("</title>\n<text>"), F.col("n"), F.lit(" lines</text><otsl><loc_1><loc_2><loc_3><loc_4><ched>line<ched>part<ched>qty<nl>"), F.col("rows"), F.lit("</otsl></doctag>"))
    two = F.concat(F.lit("<section_header_level_2>Notes</section_header_level_2><formula><loc_0><loc_0><loc_250><loc_500>x_{"), key, F.lit("</formula><picture><loc_5><loc_5><loc_9><loc_9></picture> <caption>Fig ["), key, F.lit("]</caption><chart></chart><formula>( "), F.col("n"), F.lit("</formula><unordered_list><list_item>a\n b</list_item></unordered_list><odd>left</odd><code> y\n  z </code>"))
    return d.select(F.col("l_orderkey").alias("doc_id"), F.explode(F.array(F.struct(F.lit(1).alias("page"), one.alias("doc_tags")), F.struct(F.lit(2).alias("page"), two.alias("doc_tags")))).alias("p")).select("doc_id", "p.*")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), F.col("text").alias("markdown"), "role")
