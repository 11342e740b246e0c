"""Text files that arrive in a folder, taken in once each by their content, a page a row; broken files are set aside and stop nothing.

A ledger holds a row for each content (its SHA-256) that was ever seen: where it lay, whether it could be read, how many
pages it gave. A batch takes what the ledger does not know yet, writes its pages, and then its part of the ledger; both
lie under the batch's number, so a batch that runs again after a stop replaces itself, and pages count only once
the ledger has their batch. A file that comes again under another name, or a second run, adds nothing; a broken file is
tried again only when its content has changed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import optional

LEDGER = "sha string, path string, status string, error string, pages long, bytes long, batch long"
PAGES = "sha string, page int, text string"


def text_pages(content: bytes) -> list[str]:
    """The pages of a plain text, which form feeds part; raises ValueError for what is no UTF-8 text or holds none."""
    text = content.decode("utf-8-sig")
    if "\0" in text:
        raise ValueError("holds a null character")
    pages = text.split("\f")
    if not any(p.strip() for p in pages):
        raise ValueError("holds no text")
    return pages


def parsed(files: DataFrame, parse: Callable[[bytes], list[str]] = text_pages) -> DataFrame:
    """(sha, path, bytes, error, page, text): the pages of each of ``files`` (sha, path, length, content); one row with the error for a file that ``parse`` refuses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, path, size, content in zip(*(batch.column(c).to_pylist() for c in ("sha", "path", "length", "content"))):
                try:
                    rows = [(sha, path, size, None, n, t) for n, t in enumerate(parse(content), 1)] or [(sha, path, size, "no pages", None, None)]
                except Exception as problem:  # whatever a parser meets in one file concerns that file only
                    rows = [(sha, path, size, f"{type(problem).__name__}: {problem}"[:500], None, None)]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["sha", "path", "bytes", "error", "page", "text"])

    return files.select("sha", "path", "length", "content").mapInArrow(run, "sha string, path string, bytes long, error string, page int, text string")


def ledger(spark: SparkSession, out: str) -> DataFrame:
    return optional(spark, f"{out}/ledger", LEDGER)


def pages(spark: SparkSession, out: str) -> DataFrame:
    """(sha, page, text) of all files that were taken in whole."""
    rows = optional(spark, f"{out}/pages", f"{PAGES}, batch long")
    return rows.join(ledger(spark, out).where("status = 'done'").select("sha", "batch"), ["sha", "batch"], "left_semi").drop("batch")


def take_in(spark: SparkSession, folder: str, out: str, checkpoint: str, glob: str = "*.txt", per_batch: int = 100, parse: Callable[[bytes], list[str]] = text_pages) -> StreamingQuery:
    """Take in all files that wait in ``folder`` and stop."""
    arriving = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        known = ledger(session, out).where(F.col("batch") != number).select("sha")
        files = batch.withColumn("sha", F.sha2("content", 256)).join(known, "sha", "left_anti")
        once = files.groupBy("sha").agg(F.min("path").alias("path"))
        rows = parsed(files.join(once, ["sha", "path"]), parse)
        at = f"{out}/parsed/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        rows = session.read.schema(rows.schema).parquet(at)
        rows.where("error is null").select("sha", "page", "text").write.mode("overwrite").parquet(f"{out}/pages/batch={number}")
        status = F.when(F.max("error").isNull(), "done").otherwise("broken")
        done = rows.groupBy("sha", "path", "bytes").agg(status.alias("status"), F.max("error").alias("error"), F.count("page").alias("pages"))
        done.select("sha", "path", "status", "error", "pages", "bytes").write.mode("overwrite").parquet(f"{out}/ledger/batch={number}")
        where = session._jvm.org.apache.hadoop.fs.Path(at)
        where.getFileSystem(session._jsc.hadoopConfiguration()).delete(where, True)

    return arriving.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
