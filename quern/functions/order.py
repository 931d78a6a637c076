"""Places of rows in the order of their key, for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import kept


def numbered(rows: DataFrame, keys: str | list[str], first: str, then: str, name: str = "n") -> DataFrame:
    """rows with name, their number from 1 in the order of first, then then, within keys.

    Rows are range-partitioned by all of these, so a key of any size is cut into slices of about equal rows, ties of first
    as well; rows are numbered in their slice, and what a key has in earlier slices is added. Only the last key of a slice goes
    on into the next, so there are at most as many of these offsets as slices. Nulls come first; a null key is a key.
    """
    keys = [keys] if isinstance(keys, str) else keys
    d = kept(rows.repartitionByRange(*keys, first, then).withColumn("_slice", F.spark_partition_id()), "ordered")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_slice").orderBy(first, then)))
    sizes = d.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_part")).agg(F.max("_n").alias("_size"))
    before = Window.partitionBy(*[f"_{i}" for i in range(len(keys))]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.sum("_size").over(before)).where("_before is not null").drop("_size")
    same = F.col("_slice") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    d = d.join(F.broadcast(offsets), same, "left")
    return d.withColumn(name, (F.col("_n") + F.coalesce("_before", F.lit(0))).cast("int")).select(*rows.columns, name)


def time_slices(rows: DataFrame, at: Column, reach: int, length: int) -> DataFrame:
    """rows with _slice and _own, for windows that look back reach: a row belongs to the slice of its time, and rows within reach
    of a slice's end also to the next (with _own false), so a key's slices can be worked on apart.

    at: micros; length: micros of a slice, at least reach.
    """
    n = F.floor(at / length)
    late = at + reach >= (n + 1) * length
    return rows.withColumn("_part", F.explode(F.when(late, F.array(F.struct(n.alias("s"), F.lit(True).alias("o")), F.struct((n + 1).alias("s"), F.lit(False).alias("o")))).otherwise(F.array(F.struct(n.alias("s"), F.lit(True).alias("o")))))).select(
        *rows.columns, F.col("_part.s").alias("_slice"), F.col("_part.o").alias("_own")
    )
