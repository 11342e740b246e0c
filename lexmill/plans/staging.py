"""Where a plan is cut: a DataFrame written once, so that what reads it several times computes it once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, in one that bears the application's id, so that all its tables can be deleted after it.

    A local session without the setting gets a temporary folder; a cluster must name one that all executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/lexmill-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends there, and scans keep pruning and statistics."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, with as many rows as the input, for a join in which both sides are shuffled.

    Spark goes by the size of the Parquet file a table is read from, and sends one of a few MB whole through the driver,
    though its rows take many times that size in memory, the more so after an explode.
    """
    return df.hint("merge")


def bounded(df: DataFrame, most_rows: int = 1 << 20) -> DataFrame:
    """The written table ``df`` marked for broadcast if it has at most ``most_rows`` narrow rows; else Spark shuffles both sides."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= most_rows else df
