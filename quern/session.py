"""Session factory and the tables kept between stages."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """UTC session with adaptive execution; the cluster's own settings win where it sets them."""
    b = SparkSession.builder.appName("quern")
    if master:
        b = b.master(master)
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        # without the call site of each expression a query of many expressions is built in half the calls to the JVM
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the cluster.

    Only a local master, where driver and executors are one process, falls back to a temporary folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    at = spark.conf.get("quern.local.folder", None)
    if not at:
        at = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("quern.local.folder", at)
    return at


_shipped: set[str] = set()
_kept: list[str] = []
_places: dict[int, tuple[weakref.ref, str]] = {}


def _path(spark: SparkSession, at: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application, by way of the shared folder.

    Without a shared folder nothing is sent: workers then need the package on their path.
    """
    if spark.sparkContext.applicationId in _shipped:
        return
    _shipped.add(spark.sparkContext.applicationId)
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # runs from an archive already
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    try:
        at = f"{shared_folder(spark)}/quern-code-{uuid.uuid4().hex}.zip"
    except ValueError:
        return
    fs, p = _path(spark, at)
    out = fs.create(p, True)
    out.write(bytearray(data.getvalue()))
    out.close()
    spark.sparkContext.addPyFile(at)
    _kept.append(at)


def forget(spark: SparkSession) -> None:
    """Deletes the tables that kept() wrote; results that read them must have been used."""
    for at in [a for a in _kept if not a.endswith(".zip")]:
        _delete(spark, at)


def remove(spark: SparkSession, at: str) -> None:
    """Deletes a folder or file, if it is there."""
    fs, p = _path(spark, at)
    fs.delete(p, True)


def _delete(spark: SparkSession, at: str) -> None:
    remove(spark, at)
    _kept.remove(at)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it: a stage with several readers runs once,
    its lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    at = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    _kept.append(at)
    out = spark.read.schema(df.schema).parquet(at)
    _places[id(out)] = (weakref.ref(out), at)
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that kept() returned as df; nothing may read it any more."""
    ref, at = _places.pop(id(df), (None, None))
    if at in _kept and ref is not None and ref() is df:
        _delete(df.sparkSession, at)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def heavy(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The table's columns for work that costs far more than reading them.

    Rows stay where they are read. Only a session that sets quern.spread to a number of partitions, as for tests on tables of
    one row group, has them dealt out evenly over so many, whatever the table's size and keys.
    """
    d = table(spark, folder, name).select(*columns)
    n = int(spark.conf.get("quern.spread", "0"))
    return d.repartition(n) if n > 0 else d
