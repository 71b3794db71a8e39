"""Progress of running conversions as a stream: the same columns as the batch operators, with late events dropped by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_progress(events: DataFrame, late: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """Pages, mean and worst milliseconds for each document and window of ``events(doc_id, ts, ms)``."""
    return events.withWatermark("ts", late).groupBy("doc_id", F.window("ts", window)).agg(F.count("*").alias("pages"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("worst_ms"))
