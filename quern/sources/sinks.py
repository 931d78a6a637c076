"""Sinks: tables, JSON exports and page dumps."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """A whole new table in place of the old one, or the old one as it was if writing fails.

    The new table is written beside the old one, which makes room only then and comes back if the new one can't take its place; so df may
    read from path.
    """
    spark = df.sparkSession
    fs, (at, new, old) = _files(spark, path, f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}")
    w = df.write.option("compression", "zstd")
    try:
        (w.partitionBy(*partition_by) if partition_by else w).parquet(new.toString())
        there = fs.exists(at)
        if there and not fs.rename(at, old):
            raise OSError(f"{path} can't be replaced")
        if not fs.rename(new, at):
            if there:
                fs.rename(old, at)
            raise OSError(f"{path} can't be written")
        fs.delete(old, True)
    finally:
        fs.delete(new, True)


def _files(spark: SparkSession, *paths: str):  # noqa: ANN202
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return found[0].getFileSystem(spark._jsc.hadoopConfiguration()), found


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, in as many files as df has partitions."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def dump_pages(pages: DataFrame, path: str) -> None:
    """The html of pages, partitioned by the address's host."""
    from pyspark.sql import functions as F

    from quern.functions.text import url_host

    pages.select(F.coalesce(url_host(F.col("url")), F.lit("unknown")).alias("host"), F.col("html").alias("value")).write.mode("overwrite").partitionBy("host").text(path)


def create_tables(spark: SparkSession, folder: str, schemas: dict[str, str]) -> list[str]:
    """Writes empty tables of the names that aren't in folder yet; the names written."""
    fs = spark._jvm.org.apache.hadoop.fs
    made = []
    for name, schema in schemas.items():
        at = fs.Path(f"{folder}/{name}.parquet")
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
            made.append(name)
    return made


def drop_tables(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Deletes the tables of these names; those that were there."""
    gone = []
    for name in names:
        fs, (at,) = _files(spark, f"{folder}/{name}.parquet")
        if fs.delete(at, True):
            gone.append(name)
    return gone


def list_tables(spark: SparkSession, folder: str) -> list[str]:
    """Names of the tables in folder, sorted; none if there is no folder."""
    fs, (at,) = _files(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet"))


def healthy(spark: SparkSession, folder: str, names: list[str]) -> bool:
    """Whether all tables of these names are there and can be read."""
    try:
        return all(spark.read.parquet(f"{folder}/{n}.parquet").limit(1).count() <= 1 for n in names)
    except (AnalysisException, Py4JJavaError):
        return False
