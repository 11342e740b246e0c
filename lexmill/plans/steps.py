"""Jobs in order: each step maps named tables to new ones, and what it gives is written before the next begins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import read_table, replace_table

Step = Callable[[dict[str, DataFrame]], dict[str, DataFrame]]


def run(spark: SparkSession, folder: str, steps: Iterable[tuple[str, Step]], tables: dict[str, DataFrame], skip: frozenset[str] = frozenset(), resume: bool = False) -> dict[str, DataFrame]:
    """All tables after the steps, but those of the names in ``skip``.

    A finished step leaves a table ``_done`` under its name; with ``resume`` such a step is not run again but
    its tables are read, so a job that stopped goes on where it was.
    """
    out = dict(tables)
    for name, step in steps:
        if name in skip:
            continue
        done = read_table(spark, f"{folder}/{name}/_steps") if resume else None
        if done is None:
            made = step(out)
            for table, df in made.items():
                replace_table(df, f"{folder}/{name}/{table}")
            names = list(made)
            replace_table(spark.createDataFrame([(t,) for t in names], "name string"), f"{folder}/{name}/_steps")
        else:
            names = [r.name for r in done.collect()]
        out.update({t: read_table(spark, f"{folder}/{name}/{t}") for t in names})
    return out
