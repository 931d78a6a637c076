"""Places for models that aren't part of this engine: without one, rows stay as they are."""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


def judged(rows: DataFrame, undecided: Column, judge: Judge | None = None) -> DataFrame:
    """Rows, those that undecided picks out as judge returns them.

    Only undecided rows leave the JVM; judge sees batches of all columns and returns the same columns. Without a judge
    nothing changes. A null condition counts as decided.
    """
    if judge is None:
        return rows
    open_ = F.coalesce(undecided, F.lit(False))
    return rows.where(~open_).unionByName(rows.where(open_).mapInPandas(judge, rows.schema))


def rewritten(rows: DataFrame, column: str, rewrite: Judge | None = None) -> DataFrame:
    """Rows with column rewritten; null and empty results leave the original text, as does the lack of a model."""
    if rewrite is None:
        return rows
    out = rows.withColumn("_old", F.col(column))
    out = out.mapInPandas(rewrite, out.schema)
    return out.withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("_old"))).drop("_old")


def observed(rows: DataFrame, name: str) -> DataFrame:
    """Rows that report their number under name to the session's listeners as they pass."""
    return rows.observe(name, F.count(F.lit(1)).alias("n_rows"))


def retried(call: Callable, tries: int = 3, wait: float = 1.0, on: tuple[type[Exception], ...] = (Exception,)) -> Callable:
    """Call, tried again after wait, twice wait, ... seconds when it raises one of on; the last try's exception is raised.

    For what a hook asks of the world outside; Spark repeats its own tasks.
    """

    @functools.wraps(call)
    def again(*args, **more):  # noqa: ANN002, ANN003, ANN202
        for n in range(tries - 1):
            try:
                return call(*args, **more)
            except on:
                time.sleep(wait * 2**n)
        return call(*args, **more)

    return again
