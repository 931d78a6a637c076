"""Quotas over time: sliding windows, daily limits, and the admission of calls that wait."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.order import numbered, time_slices


def offered_load(calls: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """Calls with n_window, the calls of the key in the seconds up to and with it (both ends count).

    A key's time is cut into slices that are worked on apart. Calls without time are left out."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    reach = seconds * 1_000_000
    w = Window.partitionBy(key, "_slice").orderBy(t).rangeBetween(-reach, 0)
    parts = time_slices(calls.where(F.col(at).isNotNull()), t, reach, 64 * reach)
    return parts.withColumn("n_window", F.count("*").over(w)).where("_own").drop("_slice", "_own")


def daily_quota(calls: DataFrame, key: str, at: str, order: str, per_day: int) -> DataFrame:
    """Calls with their number in the day (UTC), whether the day's quota admits them, and what is left.

    A key's day is numbered in slices, so it may hold any part of the calls."""
    d = numbered(calls.withColumn("day", F.to_date(at)), [key, "day"], at, order, "n_today")
    return d.withColumn("admitted", F.col("n_today") <= per_day).withColumn("left", F.greatest(F.lit(0), per_day - F.col("n_today")))


def admissions(calls: DataFrame, key: str, at: str, order: str, per_minute: int, seconds: float = 60.0) -> DataFrame:
    """Key, order and the micros at which each call is admitted: calls wait until fewer than per_minute were admitted
    in the seconds before; one that old exactly still counts.

    A wait moves all later ones, so a key's calls are one sequence that no split can share; the state is the last per_minute
    admissions, and a sorted partition is streamed, so no key is held in memory. Calls without key or time are left out.
    """
    keys, orders = dict(calls.dtypes)[key], dict(calls.dtypes)[order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, deque()
        for b in batches:
            out = []
            for k, t in zip(b[key], b["t"]):
                if k != current:
                    current, recent = k, deque()
                now = max(t, recent[-1]) if recent else t
                while len(recent) >= per_minute:
                    free = recent[0] + int(seconds * 1_000_000)
                    if now <= free:
                        now = free + 1
                    recent.popleft()
                recent.append(now)
                out.append(now)
            yield pd.DataFrame({key: b[key], order: b[order], "admitted_at": out})

    rows = calls.select(key, order, F.unix_micros(F.col(at).cast("timestamp")).alias("t")).dropna()
    return rows.repartition(key).sortWithinPartitions(key, "t", order).mapInPandas(run, f"{key} {keys}, {order} {orders}, admitted_at long")
