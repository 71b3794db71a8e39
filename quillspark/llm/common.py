"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words in every contract: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\f\r"
WHITE_RE = r"[\x20\x09-\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and runs on one machine, as in tests, a temporary folder is made and kept in the session;
    on a cluster, whose machines don't see each other's folders, that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of executors.

    Hashes and hex digits, which most of these tables hold, take about half the room under Zstandard.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if str(folder).replace("file:///", "file:/").startswith(shared_dir(spark).replace("file:///", "file:/")):
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns: what else ``df`` has can't clash with names that an operator makes."""
    return df.select(*[df[n] for n in names])


def utf8(text: str | Column) -> Column:
    """A text's UTF-8 bytes; null stays null."""
    return F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession, wait: float = 0) -> None:
    """Lets Spark delete the shuffle files of steps that are over and whose tables are written.

    Py4J frees what Python has dropped from a thread that sleeps for a second at a time; a ``wait`` beyond that makes sure
    that the last step's files go too.
    """
    import gc
    import time

    gc.collect()
    time.sleep(wait)
    spark._jvm.System.gc()
