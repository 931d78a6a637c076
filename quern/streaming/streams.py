"""Structured Streaming: upserts by micro-batch, queue drain, windows of time and visits.

Late rows: a watermark of ten minutes of event time; rows later than that are dropped, as aggregates that have
been given out aren't reopened. Replays end by themselves (availableNow). Checkpoints lie in the shared folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators import upsert
from quern.session import remove, shared_folder

WATERMARK = "10 minutes"


def stream_of(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files in the folder path, or of the one file path, in the order of their times."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream's path is a folder
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"


def replay(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything the stream has now, written to a table by an exactly-once file sink and read back."""
    spark = stream.sparkSession
    at = _place(spark, name)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def replay_batches(stream: DataFrame, name: str, write: Callable[[DataFrame, int, str], None]) -> str:
    """Runs write(batch, number, folder) over the stream; the folder."""
    at = _place(stream.sparkSession, name)
    stream.writeStream.foreachBatch(lambda b, n: write(b, n, at)).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return at


#: Parts of an upserted table; a batch rewrites only those that it touches.
BUCKETS = 64


def upsert_stream(postings: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Micro-batches of postings kept as one table by application_url.

    The table lies in buckets of its key. A batch is merged into the buckets it touches, which are written anew, and a list of all
    buckets' folders is written as the table's next version: a batch that is run again after a failure starts from the same version, so
    each counts exactly once. Folders that neither this version nor the one before names are deleted.
    """
    bucket = F.pmod(F.xxhash64("application_url"), F.lit(buckets)).cast("int")
    spark = postings.sparkSession

    def version(at: str, n: int) -> dict[int, str]:
        return {r.bucket: r.folder for r in spark.read.schema("bucket int, folder string").parquet(f"{at}/list{n}").collect()} if n >= 0 else {}

    def write(batch: DataFrame, n: int, at: str) -> None:
        batch = batch.select(*upsert.FIELDS).where("application_url is not null")
        before, older = version(at, n - 1), version(at, n - 2)
        touched = [r.bucket for r in batch.select(bucket.alias("bucket")).distinct().collect()]  # at most buckets rows
        there = [before[b] for b in touched if b in before]
        stored = spark.read.schema(batch.schema).parquet(*there) if there else spark.createDataFrame([], batch.schema)
        merged = upsert.upsert_postings(stored, batch).select(*upsert.FIELDS, bucket.alias("bucket"))
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/batch{n}")
        now = before | {b: f"{at}/batch{n}/bucket={b}" for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, folder string").coalesce(1).write.mode("overwrite").parquet(f"{at}/list{n}")
        for folder in set(older.values()) - set(before.values()):
            remove(spark, folder)

    at = replay_batches(postings, "upsert", write)
    n = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    names = [f.getPath().getName() for f in n.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(n)]
    folders = version(at, max((int(x[4:]) for x in names if x.startswith("list")), default=-1)).values()
    schema = postings.select(*upsert.FIELDS).schema
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def drain(jobs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """New rows of the stream worked on as they come, with status analyzed."""
    return replay(work(jobs.where(F.col("status") == "new")).withColumn("status", F.lit("analyzed")), "drain")


def sliding_counts(events: DataFrame, key: str, at: str, length: str = "60 seconds", slide: str = "10 seconds") -> DataFrame:
    """Events of a key in sliding windows."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, WATERMARK)
    return e.groupBy(key, F.window(at, length, slide).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def daily_counts(events: DataFrame, key: str, at: str) -> DataFrame:
    """Events of a key by day."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, WATERMARK)
    return e.groupBy(key, F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("day"), "n")


def visits(events: DataFrame, key: str, at: str, gap: str = "30 minutes") -> DataFrame:
    """Visits of a key that end after gap without an event."""
    e = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, WATERMARK)
    return e.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")


def first_by_url(postings: DataFrame, at: str) -> DataFrame:
    """The first posting of each address within the watermark."""
    return postings.withWatermark(at, WATERMARK).dropDuplicatesWithinWatermark(["application_url"])


def admitted(calls: DataFrame, key: str, at: str, per_minute: int) -> DataFrame:
    """Micros at which a key's calls are admitted, with the last admissions as state across micro-batches."""
    kind = dict(calls.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        times = sorted(t for b in batches for t in b["t"])
        out = []
        for t in times:
            now = max([t, *recent[-1:]])
            while len(recent) >= per_minute:
                now = max(now, recent.pop(0) + 60_000_001)
            recent.append(now)
            out.append(now)
        state.update((recent,))
        yield pd.DataFrame({key: [k[0]] * len(out), "admitted_at": out})

    rows = calls.select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, admitted_at long", "recent array<long>", "append", GroupStateTimeout.NoTimeout)
