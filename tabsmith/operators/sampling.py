"""Previews, row caps and repeatable samples. Sampling is a feature the caller asks for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col, hash_text, is_nested, type_of
from tabsmith.operators.profile import memory_mb
from tabsmith.operators.splitting import hash_cuts


def head(df: DataFrame, n: int, key: Sequence[str]) -> DataFrame:
    """First ``n`` rows by key."""
    return df.orderBy(*[col(k) for k in key]).limit(n)


def sample_rows(df: DataFrame, n: int | None, key: Sequence[str], *, seed: int = 42) -> DataFrame:
    """Sample of exactly ``n`` rows without replacement, the same rows for the same seed.

    The rows with the ``n`` smallest key hashes. The hash at the cut is found by counting, so the sample is a filter of the
    table and no rows meet in one task. ``key`` should identify the rows: of rows with the key at the cut, the smallest by
    their other columns are drawn. The table comes back whole where ``n`` is missing, not positive, or not below the number of rows.
    """
    if n is None or n <= 0 or n >= df.count():
        return df
    hashed = hash_text(key, seed)
    (cut,) = hash_cuts(df, F.lit(""), hashed, {"": [n]})[""]
    below, tied = df.agg(F.count_if(hashed < cut), F.count_if(hashed == cut)).first()
    if below + tied == n:
        return df.filter(hashed <= cut)
    # Maps have no order; as texts they do.
    order = [col(c).cast("string") if is_nested(type_of(df, c)) else col(c) for c in df.columns]
    return df.filter(hashed < cut).union(df.filter(hashed == cut).orderBy(*order).limit(n - below))


def sample_fraction(df: DataFrame, fraction: float, *, seed: int = 42) -> DataFrame:
    """Cheap sample of about a fraction of the rows, without a sort."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def sample_if_large(
    df: DataFrame,
    key: Sequence[str],
    *,
    row_threshold: int = 500_000,
    memory_threshold_mb: float = 1024,
    sample_size: int = 50_000,
    seed: int = 42,
) -> tuple[DataFrame, bool]:
    """(table, was_sampled): a sample only where the table is above a threshold."""
    large = df.count() > row_threshold or memory_mb(df) > memory_threshold_mb
    return (sample_rows(df, sample_size, key, seed=seed), True) if large else (df, False)
