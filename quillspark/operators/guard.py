"""Degeneration guard over token streams, and statistics of progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Longest period looked for, repetitions, and so the tokens that are kept.
MAX_PERIOD, REPEATS = 16, 3
KEEP = MAX_PERIOD * REPEATS + 4


def short_cycle(tokens: Column, max_period: int = MAX_PERIOD) -> Column:
    """Whether an array ends in three repetitions of a run of ``max_period`` elements or fewer."""
    n = F.size(tokens)
    repeats = lambda p: F.when(n >= p * 3, F.slice(tokens, n - p * 2 + 1, p * 2) == F.slice(tokens, n - p * 3 + 1, p * 2)).otherwise(F.lit(False))
    return F.exists(F.sequence(F.lit(1), F.lit(max_period)), repeats)


def first_trigger(steps: DataFrame, timeout_ms: float, max_tokens: int) -> DataFrame:
    """(gen_id, stopped_at, reason) of ``steps(gen_id, step, token, ms, aborted)``: what would have stopped each stream first.

    At one step an abort comes before the timeout and that before repetition. A stream that nothing stops has the reason
    ``max_tokens`` if it is that long, else null.
    """
    w = Window.partitionBy("gen_id").orderBy("step")
    recent = F.collect_list("token").over(w.rowsBetween(-(KEEP - 1), 0))
    reason = F.when(F.col("aborted"), "aborted").when(F.col("ms") > timeout_ms, "timeout").when(short_cycle(recent), "repetition")
    d = steps.withColumn("why", reason)
    g = d.groupBy("gen_id").agg(F.min(F.when(F.col("why").isNotNull(), F.struct("step", "why"))).alias("hit"), F.count("*").alias("n"))
    return g.select("gen_id", F.coalesce("hit.step", F.col("n")).cast("long").alias("stopped_at"), F.coalesce("hit.why", F.when(F.col("n") >= max_tokens, "max_tokens")).alias("reason"))


def progress(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Running mean, high-water mark and count of ``value`` for each key."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("seen", F.count("*").over(w)).withColumn("mean", F.avg(value).over(w)).withColumn("high", F.max(value).over(w))


def lag_statistics(events: DataFrame, key: str, value: str, stall: float = 100.0) -> DataFrame:
    """Count, 95th percentile, median, maximum and stalls of each key. A quantile is the element at floor(q * n) of the sorted values: not interpolated.

    Equal values are counted first, so a key's rows are never gathered; a value covers the places below its running count.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    d = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(key)))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col(value)))
    return d.groupBy(key).agg(F.max("n").alias("n"), at(0.95).alias("p95"), at(0.5).alias("median"), F.max(value).alias("worst"), F.sum(F.when(F.col(value) > stall, F.col("c")).otherwise(0)).alias("stalls"))


def creep(ratio: Column) -> Column:
    """The share of a page that counts as done after ``ratio`` of its expected time: four fifths at that time, then ever slower."""
    return F.when(ratio <= 1, 0.8 * ratio).otherwise(1 - 0.2 * F.exp(1 - ratio))


#: Fixed value: milliseconds that a first page is expected to take.
FIRST_PAGE_MS = 60_000.0


def bar(samples: DataFrame) -> DataFrame:
    """``samples(doc_id, at_ms, pages_done, spent_ms, page_started_ms, page_count)`` with ``fraction`` and ``left_s``.

    ``spent_ms`` is the time of the pages that are done. The fraction never falls; ``left_s``, the rounded seconds to go, is
    null before the first page is done.
    """
    average = F.when(F.col("pages_done") > 0, F.col("spent_ms") / F.col("pages_done")).otherwise(F.lit(FIRST_PAGE_MS))
    within = F.when(F.col("page_started_ms").isNull(), 0.0).otherwise(creep((F.col("at_ms") - F.col("page_started_ms")) / average))
    now = F.when(F.col("page_count") > 0, F.least(F.lit(1.0), (F.col("pages_done") + within) / F.col("page_count"))).otherwise(0.0)
    w = Window.partitionBy("doc_id").orderBy("at_ms").rowsBetween(Window.unboundedPreceding, 0)
    left = F.when(F.col("pages_done") > 0, F.floor(F.col("spent_ms") / F.col("pages_done") / 1000 * (F.col("page_count") - F.col("pages_done")) + 0.5).cast("long"))
    return samples.withColumn("fraction", F.max(now).over(w)).withColumn("left_s", left)


def monotonic(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Whether ``value`` never falls, with its range and distinct values."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    d = events.withColumn("__ok", F.coalesce(F.col(value) >= before - 1e-9, F.lit(True)))
    return d.groupBy(key).agg(F.bool_and("__ok").alias("monotonic"), F.countDistinct(value).alias("n_distinct"), F.min(value).alias("low"), F.max(value).alias("high"))


def net_growth(runs: DataFrame, key: str, order: str, before: str, after: str) -> DataFrame:
    """The last ``after`` less the first ``before``."""
    return runs.groupBy(key).agg((F.max_by(after, order) - F.min_by(before, order)).alias("growth"))


def truncation(guard: Column, generated: Column, limit: int = 4096) -> Column:
    return F.coalesce(guard, F.when(generated >= limit, "max_tokens"))
