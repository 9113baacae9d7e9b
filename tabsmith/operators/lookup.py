"""Attach values to rows by key: the join behind every encoder and rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARE = 1_000
SALTS = 1_000_000


def attach(
    df: DataFrame,
    lookup: DataFrame,
    key: str | Column,
    values: Sequence[str],
    *,
    lookup_rows: int,
    lookup_bytes: int = 0,
    total: int | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Left join ``df`` with ``lookup(value, n, *values)`` on ``key``; unseen keys get nulls.

    ``lookup`` has one row per key and ``n``, the number of rows with that key. Up to ``broadcast_rows``
    rows and 64 MB of key text (both counted by the caller) it is broadcast and no row moves. Beyond, the rows are
    shuffled by key, except those of hot keys: a key with at least 1/``hot_share`` of all rows. There
    are at most ``hot_share`` of them, so they are broadcast, and their rows are spread by a salt (which
    matches nothing, so it may take any number of values and no row of the lookup is copied).
    """
    key_col = col(key) if isinstance(key, str) else key
    values = list(values)
    side = lookup.select(F.col("value").alias("_key"), *values, "n")
    if lookup_rows <= broadcast_rows and lookup_bytes <= BROADCAST_BYTES:
        rows = df.withColumn("_probe", key_col)
        return rows.join(F.broadcast(side.drop("n")), F.col("_probe") == F.col("_key"), "left").drop("_probe", "_key")

    if total is None:
        total = lookup.agg(F.sum("n")).first()[0]
    bound = max(total // hot_share, 1)
    hot = side.filter(F.col("n") >= bound).select(
        F.col("_key").alias("_hot_key"), *[F.col(v).alias(f"_hot_{v}") for v in values]
    )
    cold = side.filter(F.col("n") < bound).drop("n").withColumn("_side_salt", F.lit(0))
    spread = F.pmod(F.xxhash64(*[col(c) for c in df.columns]), F.lit(SALTS)).cast("int") + 1
    rows = df.withColumn("_probe", key_col)
    rows = rows.join(F.broadcast(hot), F.col("_probe") == F.col("_hot_key"), "left")
    # Rows that are already answered, or have no key at all, must not meet in one partition.
    settled = F.col("_hot_key").isNotNull() | F.col("_probe").isNull()
    rows = rows.withColumn("_salt", F.when(settled, spread).otherwise(F.lit(0)))
    rows = rows.withColumn("_cold_probe", F.when(settled, F.lit(None)).otherwise(F.col("_probe")))
    joined = rows.join(
        cold, (F.col("_cold_probe") == F.col("_key")) & (F.col("_salt") == F.col("_side_salt")), "left"
    )
    picked = [F.coalesce(F.col(f"_hot_{v}"), F.col(v)).alias(v) for v in values]
    return joined.select(*[col(c) for c in df.columns], *picked)
