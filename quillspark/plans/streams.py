"""Queries of the guard, on streams of tokens that the conversations' turns stand for, in a batch and as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import guard as batch
from ..streaming import guard, progress, runs
from .registry import query
from .synthetic import table

_ANSWERS = """
SELECT conv_id AS gen_id, CASE WHEN conv_id % 3 = 0 AND n >= 3 THEN 3 WHEN conv_id % 3 = 1 AND n >= 4 THEN 4 WHEN conv_id % 3 = 2 AND conv_id % 2 = 0 AND n >= 3 THEN 3 ELSE n END AS stopped_at,
 CASE WHEN conv_id % 3 = 0 AND n >= 3 THEN 'repetition' WHEN conv_id % 3 = 1 AND n >= 4 THEN 'timeout' WHEN conv_id % 3 = 2 AND conv_id % 2 = 0 AND n >= 3 THEN 'aborted' WHEN n >= 6 THEN 'max_tokens' END AS reason
FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)"""


def _steps(turns: DataFrame) -> DataFrame:
    """A third of the streams repeat one token, a third grow slow, of the others every second is aborted at its third step."""
    k, t = F.col("conv_id") % 3, F.col("turn")
    token, slow, stop = F.when(k == 0, 7).otherwise(t).cast("long"), F.when(k == 1, 400.0 * t).otherwise(0.0), (k == 2) & (F.col("conv_id") % 2 == 0) & (t == 2)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("conv_id") * 10 + t)
    return turns.select(F.col("conv_id").alias("gen_id"), (t + 1).cast("long").alias("step"), token.alias("token"), slow.alias("ms"), stop.alias("aborted"), at.alias("ts"))


def _arriving(spark, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it a file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


@query(_ANSWERS)
def guard_reasons(spark, sf_dir):
    return batch.first_trigger(_steps(table(spark, sf_dir, "conversations")), 1000, 6)


@query(_ANSWERS)
def streamed_guard(spark, sf_dir):
    """The same answers from micro-batches. A step far ahead in time, as any later stream brings, ends the last streams."""
    provider = spark.conf.get(guard.PROVIDER[0], None)
    spark.conf.set(*guard.PROVIDER)
    try:
        later = _arriving(spark, sf_dir, "region").where("r_regionkey = 0").selectExpr("-1L AS gen_id", "1L AS step", "0L AS token", "0D AS ms", "true AS aborted", "timestamp_seconds(9000000000) AS ts")
        steps = _steps(_arriving(spark, sf_dir, "conversations")).unionByName(later)
        return runs.finished(guard.online_triggers(steps, 1000, 6), "guard").where("gen_id >= 0")
    finally:
        spark.conf.set(*((guard.PROVIDER[0], provider) if provider else guard.PROVIDER))


@query("""
WITH e AS (SELECT user_id, time_bucket(INTERVAL '1 day', ts) AS day, value, max(ts) OVER () AS latest FROM events)
SELECT user_id AS doc_id, CAST(day AS TIMESTAMP) AS day, count(*) AS pages, max(value) AS worst_ms FROM e GROUP BY user_id, day, latest HAVING CAST(day AS TIMESTAMP) + INTERVAL '1 day' <= latest - INTERVAL '10 minutes'""")
def streamed_progress(spark, sf_dir):
    """Pages of each document and day; the days that the watermark has passed."""
    e = _arriving(spark, sf_dir, "events")
    d = progress.page_progress(e.select(F.col("user_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("ms")), window="1 day")
    return runs.finished(d, "progress").select("doc_id", F.col("window.start").alias("day"), "pages", "worst_ms")
