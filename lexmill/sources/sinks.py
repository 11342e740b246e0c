"""Writers: tables replaced as a whole, and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _versions(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Numbers of the finished versions of the table at ``path``, and the greatest number in use."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at(path)):
        return [], 0
    names = [s.getPath().getName() for s in fs.listStatus(at(path))]
    numbers = [int(n[2:]) for n in names if n.startswith("v-") and n[2:].isdigit()]
    done = [n for n in numbers if fs.exists(at(f"{path}/v-{n:012d}/_SUCCESS"))]
    return sorted(done), max(numbers, default=0)


def replace_table(df: DataFrame, path: str) -> None:
    """Write ``df`` as the next version of the table at ``path``; ``df`` may read the present one.

    A version is a folder that counts once its _SUCCESS file is there, which Spark writes last, so a reader
    and a rerun after a stop at any moment find the last finished version. The version before it stays for
    readers that have begun; older ones are deleted.
    """
    spark = df.sparkSession
    done, last = _versions(spark, path)
    df.write.parquet(f"{path}/v-{last + 1:012d}")
    for n in done[:-1]:
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v-{n:012d}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The last finished version of the table at ``path``; None before there is one."""
    done, _ = _versions(spark, path)
    return spark.read.parquet(f"{path}/v-{done[-1]:012d}") if done else None


def csv_files(df: DataFrame, path: str, order: list[str]) -> None:
    """CSV with a header, sorted over its files."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)
