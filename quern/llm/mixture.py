"""One mixture of several sources by target weights: problem 8.

Blocks of equal tokens go to sources, and within a source to shards, by the highest quotients (Sainte-Laguë),
which gives integer quotas; a source has as many shards as its tokens need, and their quotas stay distributed. Each shard
then fills its quota with documents in a seeded order.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.bpe import token_counts
from quern.session import heavy, kept, table

SEED = 20240229
#: The mixture is cut into at least so many blocks, and into more where a shard would have less than SHARD_BLOCKS.
BLOCKS, SHARD_BLOCKS = 20_000, 32
#: A source has a shard for each SHARD_TOKENS. Shards are apportioned in groups of at most GROUP, and groups of groups.
SHARD_TOKENS, GROUP = 250_000, 1000
#: More targets raise ValueError, so what the driver sees is bounded.
MOST_SOURCES = 1000


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """seats handed out by the highest quotients weight / (2 n + 1), n the seats held; nobody exceeds its cap.

    Ties go to the smaller key. Keys without a positive weight get none. Fewer than seats are handed out only if
    the caps add up to less. The first floor-like share is granted at once: by the method's quota no key ends
    under floor(share) - keys, so only the rest is handed out one by one.
    """
    live = {k: w for k, w in weights.items() if w > 0}
    caps = caps or {}
    total = sum(live.values())
    held = {k: max(0, min(math.floor(seats * w / total) - len(live), caps.get(k, seats))) for k, w in live.items()}
    heap = [(-w / (2 * held[k] + 1), k) for k, w in live.items() if held[k] < caps.get(k, seats)]
    heapq.heapify(heap)
    left = seats - sum(held.values())
    while left > 0 and heap:
        _, k = heapq.heappop(heap)
        held[k] += 1
        left -= 1
        if held[k] < caps.get(k, seats):
            heapq.heappush(heap, (-live[k] / (2 * held[k] + 1), k))
    return {k: held.get(k, 0) for k in weights}


def targets_of(targets: DataFrame) -> list[Row]:
    """Targets with a source, on the driver: over MOST_SOURCES, or two for one source, raise ValueError."""
    wanted = [r for r in targets.select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect() if r.source is not None]
    if len(wanted) > MOST_SOURCES or len({r.source for r in wanted}) < len(wanted):
        raise ValueError(f"over {MOST_SOURCES} targets, or two for one source")
    return wanted


def _apportioned(parents: DataFrame, children: DataFrame, keys: list[str], block: float) -> DataFrame:
    """children (keys, child, tokens, repeats) with their blocks of the parent's (keys, blocks), by highest quotients in each group."""

    def share(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("child", ignore_index=True)
        tokens = dict(enumerate(rows["tokens"].tolist()))
        most = {k: math.ceil(t * r / block) for (k, t), r in zip(tokens.items(), rows["repeats"].tolist())}
        got = sainte_lague(tokens, int(rows["blocks"].iloc[0]), most)
        rows["blocks"] = [got[k] for k in tokens]
        return rows

    rows = children.join(parents, keys)
    return rows.groupBy(*keys).applyInPandas(share, rows.schema).select(*keys, "child", "tokens", "repeats", "blocks")


def _quotas(usable: DataFrame, blocks: dict[str, int], repeats: dict[str, int], most_shards: int, block: float) -> DataFrame:
    """source, shard, every (copies that each document of the shard has) and rest (tokens to be filled beyond them).

    The blocks of a source go down a tree of groups of shards, GROUP at a time, so no task and not the driver sees them all.
    """
    spark = usable.sparkSession
    leaves = usable.groupBy("source", "shard").agg(F.sum("n_tokens").alias("tokens"))
    depth = 1
    while GROUP**depth < most_shards:
        depth += 1
    quota = spark.createDataFrame([(s, n, int(repeats[s])) for s, n in sorted(blocks.items())], "source string, blocks long, repeats long")
    leaves = leaves.join(F.broadcast(quota.select("source", "repeats")), "source")  # a row a target: MOST_SOURCES at most
    parents, keys = quota.select("source", "blocks"), ["source"]
    for level in range(1, depth + 1):
        width = GROUP ** (depth - level)
        up = [F.floor(F.col("shard") / GROUP ** (depth - k)).alias(f"g{k}") for k in range(1, level)]
        children = leaves.groupBy("source", *up, F.floor(F.col("shard") / width).cast("long").alias("child")).agg(F.sum("tokens").alias("tokens"), F.max("repeats").alias("repeats"))
        found = _apportioned(parents, children, keys, block)
        parents, keys = found.withColumnRenamed("child", f"g{level}").select(*keys, f"g{level}", "blocks"), [*keys, f"g{level}"]
    want = F.least(F.col("blocks") * F.lit(block), F.col("tokens") * F.col("repeats"))
    every = F.floor(want / F.col("tokens")).cast("int")
    return found.select("source", F.col("child").alias("shard"), every.alias("every"), (want - every * F.col("tokens")).alias("rest"))


def mixture(sizes: DataFrame, targets: DataFrame, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(documents with copies, report by source) of the largest mixture that meets the targets.

    sizes: doc_id, source, n_tokens; targets: source, target_share, max_repeats. The mixture's size is the most
    at which every source with documents can give its share with at most max_repeats copies of a document; a
    target without documents has its share spread over the others in proportion and is reported with 0. Sources without
    target, null sources and documents without tokens are left out. copies is 0 for none: such documents
    aren't returned. Every document of a shard gets floor(quota / shard) copies, the first ones in seeded order
    one more. The report has source, target_share, available_tokens, mixed_tokens, reached_share, max_copies.
    Targets with a null, a share of 0 or less or max_repeats under 1 count as a target of 0; a source with two targets raises ValueError.
    """
    spark = sizes.sparkSession
    wanted = targets_of(targets)
    share = {r.source: r.target_share for r in wanted if (r.target_share or 0) > 0 and (r.max_repeats or 0) >= 1}
    repeats = {r.source: r.max_repeats for r in wanted if r.source in share}
    usable = sizes.select("doc_id", "source", "n_tokens").where((F.col("n_tokens") > 0) & F.col("source").isin(list(share)))
    have = {r.source: r.tokens for r in usable.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}  # a row a target at most
    given = sum(share[s] for s in have)
    size = min((have[s] * repeats[s] * given / share[s] for s in have), default=0.0)
    block = max(1.0, min(size / blocks, SHARD_TOKENS / SHARD_BLOCKS))
    quota = sainte_lague({s: share[s] for s in have}, int(size // block), {s: int(have[s] * repeats[s] // block) for s in have})
    n_shards = {s: max(1, t // SHARD_TOKENS) for s, t in have.items()}
    shards = F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in sorted(n_shards.items())], F.lit(1))
    usable = usable.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), shards).cast("long"))
    quotas = _quotas(usable, quota, repeats, max(n_shards.values(), default=1), block)
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    chosen = (
        usable.withColumn("upto", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(quotas, ["source", "shard"])
        # the document in which the quota ends is taken if more than half of it lies before the end
        .withColumn("copies", (F.col("every") + F.when(F.col("upto") - F.col("n_tokens") / 2 < F.col("rest"), 1).otherwise(0)).cast("int"))
        .where("copies > 0")
        .select("doc_id", "source", "n_tokens", "copies")
    )
    mixed = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("max_copies"))
    rows = [(r.source, float(r.target_share or 0), int(r.max_repeats or 0), have.get(r.source, 0)) for r in wanted]
    report = (
        spark.createDataFrame(rows, "source string, target_share double, max_repeats int, available_tokens long")
        .join(mixed, "source", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
        .withColumn("max_copies", F.coalesce("max_copies", F.lit(0)))
    )
    total = report.agg(F.sum("mixed_tokens").alias("total"))
    report = report.crossJoin(F.broadcast(total)).withColumn("reached_share", F.coalesce(F.col("mixed_tokens") / F.nullif("total", F.lit(0)), F.lit(0.0))).drop("total")
    return chosen, report


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    wanted = [r.source for r in targets_of(table(spark, folder, "mix_targets"))]
    d = heavy(spark, folder, "documents", "doc_id", "source", "text").where(F.col("source").isin(wanted))
    return kept(token_counts(d, ["doc_id", "source"]), "sizes")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_sizes(spark, folder), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(_sizes(spark, folder), table(spark, folder, "mix_targets"))[1]
