"""Streams that are run until their input is read, with their results as a table."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; without that setting, and on one machine only, in a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finished(stream: DataFrame, name: str) -> DataFrame:
    """The rows that ``stream`` appends until all its input is read; each once, as the sink commits its files by batch."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts within can be ended by ``cancel`` with the same tag, from any thread; their tasks are interrupted."""
    context = spark.sparkContext
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    try:
        yield
    finally:
        context.removeJobTag(tag)
        context.setInterruptOnCancel(False)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the jobs of ``tag`` that run. What they had staged is never committed."""
    spark.sparkContext.cancelJobsWithTag(tag)
