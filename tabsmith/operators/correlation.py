"""Pearson and Spearman correlation, pairwise over the rows where both values are present."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import (
    col,
    is_number_or_flag,
    missing,
    number,
    numeric_columns,
    type_of,
)
from tabsmith.operators.counts import category_codes, distinct_count_map
from tabsmith.operators.lookup import BROADCAST_ROWS, attach
from tabsmith.operators.profile import missing_counts
from tabsmith.operators.running import running_totals

SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
MOMENTS = ", ".join(["i int, j int", *[f"{c} double" for c in [*SUMS, "cx", "cy"]]])


def _pair_moments(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """Sufficient statistics (n, sums, squares, product) per pair of columns.

    Each task folds its rows into one small matrix, so the shuffle carries pairs, not rows. Large offsets would cancel the digits of the squares, so every
    batch is taken from its own means; sums from different means are moved to one before they are added. One pass does all of it.
    """
    left = np.array([i for i, _ in pairs], dtype=int)
    right = np.array([j for _, j in pairs], dtype=int)
    p = len(names)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.full(p, np.nan)
        n, sx, sxx, sxy = (np.zeros((p, p)) for _ in range(4))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], float)
            gaps = np.isnan(x)
            known = batch.num_rows - gaps.sum(axis=1)
            # A column of one value is its own mean to the last digit, whatever the order of the sum.
            first = x[np.arange(p), gaps.argmin(axis=1)]
            x -= first[:, None]
            here = first + np.nansum(x, axis=1) / np.maximum(known, 1)
            x -= (here - first)[:, None]
            centre = np.where(np.isnan(centre), here, centre)
            d = np.where(known > 0, here - centre, 0.0)[:, None]
            if gaps.any():
                x = np.where(gaps, 0.0, x)
                mask = (~gaps).astype(float)
                count, total, squares = mask @ mask.T, x @ mask.T, (x * x) @ mask.T
            else:
                count = np.full((p, p), float(batch.num_rows))
                total, squares = (np.repeat(v[:, None], p, axis=1) for v in (x.sum(axis=1), np.einsum("ij,ij->i", x, x)))
            n += count
            sxx += squares + 2 * d * total + count * d * d
            sxy += x @ x.T + d * total.T + total * d.T + count * d * d.T
            sx += total + count * d
        means = [pa.array(centre[k], mask=np.isnan(centre[k])) for k in (left, right)]
        sums = [n[left, right], sx[left, right], sx[right, left], sxx[left, right], sxx[right, left], sxy[left, right]]
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int32()), pa.array(right, pa.int32()), *map(pa.array, sums), *means], ["i", "j", *SUMS, "cx", "cy"])

    parts = df.select(*[col(c).cast("double") for c in names]).mapInArrow(fold, MOMENTS)
    # The common centre is one of those of the parts, so that a column of one value has no spread.
    pair = Window.partitionBy("i", "j")
    for c in ("cx", "cy"):
        parts = parts.withColumn("_middle", F.avg(c).over(pair)).withColumn("_middle", F.min_by(c, F.abs(F.col(c) - F.col("_middle"))).over(pair))
        parts = parts.withColumn(c, F.coalesce(F.col(c) - F.col("_middle"), F.lit(0.0)))
    n, sx, sy, dx, dy = (F.col(c) for c in ("n", "sx", "sy", "cx", "cy"))
    moved = {"n": n, "sx": sx + n * dx, "sy": sy + n * dy, "sxx": F.col("sxx") + 2 * dx * sx + n * dx * dx,
             "syy": F.col("syy") + 2 * dy * sy + n * dy * dy, "sxy": F.col("sxy") + dx * sy + dy * sx + n * dx * dy}
    return parts.select("i", "j", *[v.alias(c) for c, v in moved.items()]).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def _coefficient(moments: DataFrame) -> DataFrame:
    """r per pair; null where a column is constant over the common rows."""
    n = F.col("n")
    covariance = F.try_divide(F.col("sxy") - F.try_divide(F.col("sx") * F.col("sy"), n), n)
    var_x = F.try_divide(F.col("sxx") - F.try_divide(F.col("sx") * F.col("sx"), n), n)
    var_y = F.try_divide(F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n), n)
    # A constant column leaves a variance of rounding size only.
    floor = F.lit(1e-24)
    solid = (var_x > floor * F.try_divide("sxx", n)) & (var_y > floor * F.try_divide("syy", n))
    solid = solid & (var_x > 0) & (var_y > 0)
    r = F.when(solid, covariance / F.sqrt(var_x * var_y))
    return moments.withColumn("r", r)


def _labelled(df: DataFrame, moments: DataFrame, names: Sequence[str], method: str) -> DataFrame:
    labels = df.sparkSession.createDataFrame([(k, c) for k, c in enumerate(names)], "k int, name string")
    a, b = F.broadcast(labels).alias("a"), F.broadcast(labels).alias("b")
    return (
        _coefficient(moments)
        .join(a, F.col("i") == F.col("a.k"))
        .join(b, F.col("j") == F.col("b.k"))
        .select(
            F.col("i").alias("pos_i"),
            F.col("j").alias("pos_j"),
            F.col("a.name").alias("col_i"),
            F.col("b.name").alias("col_j"),
            F.lit(method).alias("method"),
            F.col("n").cast("bigint").alias("n"),
            "r",
        )
    )


def _numbers(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*[number(df, c).alias(c) for c in names])


def average_ranks(df: DataFrame, names: Sequence[str], *, rows_per_bucket: int | None = None,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Replace each value by its average rank within its column (nulls stay null).

    Ranks come from the distinct values and their counts. A column with few distinct values gets its
    ranks from a broadcast table; one with many by a join on the value that spreads hot values.
    """
    limits = {} if rows_per_bucket is None else {"rows_per_bucket": rows_per_bucket}
    table = _numbers(df, names)
    distinct = distinct_count_map(table, names)
    out = table
    for k, c in enumerate(names):
        value = col(c) + F.lit(0.0)
        # One column per branch: its scan reads nothing else.
        counts = table.select(value.alias("value")).filter("value is not null").groupBy("value").agg(F.count("*").alias("n"))
        ranked = running_totals(counts.withColumn("_all", F.lit(0)), ["_all"], "value", ["n"], largest=distinct[c], **limits)
        rank = (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"_rank{k}")
        out = attach(out, ranked.select("value", rank, "n"), value, [f"_rank{k}"], lookup_rows=distinct[c],
                     broadcast_rows=broadcast_rows)
        out = out.drop(c)  # its rank stands for it: the next shuffle need not carry both
    return out.select(*[F.col(f"_rank{k}").alias(c) for k, c in enumerate(names)])


def correlation(df: DataFrame, names: Sequence[str] | None = None, method: str = "pearson", **limits) -> DataFrame:
    """Long matrix (pos_i, pos_j, col_i, col_j, method, n, r) of all ordered pairs of numeric columns.

    Fewer than two numeric columns give no rows.
    """
    names = numeric_columns(df, names)
    if len(names) < 2:
        names = []
    pairs = [(i, j) for i in range(len(names)) for j in range(len(names))]
    return _correlate(df, names, pairs, method, **limits)


def _correlate(df: DataFrame, names: Sequence[str], pairs: Sequence[tuple[int, int]], method: str, **limits) -> DataFrame:
    if method not in {"pearson", "spearman"}:
        raise ValueError(f"Unknown correlation method: {method}")
    schema = "pos_i int, pos_j int, col_i string, col_j string, method string, n bigint, r double"
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    table = _numbers(df, names)
    if method == "pearson":
        return _labelled(df, _pair_moments(table, names, pairs), names, method)
    _, gaps = missing_counts(table, names)
    whole = {i for i, c in enumerate(names) if gaps[c] == 0}
    complete = [(i, j) for i, j in pairs if i == j or (i in whole and j in whole)]
    parts = []
    if complete:
        used = sorted({i for pair in complete for i in pair})
        at = {i: k for k, i in enumerate(used)}
        ranks = average_ranks(table, [names[i] for i in used], **limits)
        local = _pair_moments(ranks, ranks.columns, [(at[i], at[j]) for i, j in complete])
        back = df.sparkSession.createDataFrame(list(enumerate(used)), "k int, at int")
        a, b = F.broadcast(back).alias("ra"), F.broadcast(back).alias("rb")
        local = local.join(a, F.col("i") == F.col("ra.k")).join(b, F.col("j") == F.col("rb.k"))
        parts.append(local.select(F.col("ra.at").alias("i"), F.col("rb.at").alias("j"), *SUMS))
    # With gaps the ranks depend on the partner: rank both again over the common rows.
    gappy = sorted({(min(p), max(p)) for p in pairs} - {(min(p), max(p)) for p in complete})
    for i, j in gappy:
        both = table.filter(col(names[i]).isNotNull() & col(names[j]).isNotNull())
        ranks = average_ranks(both, [names[i], names[j]], **limits)
        part = _pair_moments(ranks, ranks.columns, [(0, 1)])
        if (i, j) in pairs:
            parts.append(part.withColumns({"i": F.lit(i), "j": F.lit(j)}))
        if (j, i) in pairs:
            parts.append(
                part.select(F.lit(j).alias("i"), F.lit(i).alias("j"), "n", F.col("sy").alias("sx"),
                            F.col("sx").alias("sy"), F.col("syy").alias("sxx"), F.col("sxx").alias("syy"), "sxy")
            )
    moments = parts[0]
    for part in parts[1:]:
        moments = moments.unionByName(part)
    return _labelled(df, moments, names, method)


def feature_pairs(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Pearson correlation of each unordered pair of the numeric columns, in column order."""
    names = numeric_columns(df, names)
    return _correlate(df, names, [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))], "pearson")


def coded_target(df: DataFrame, target: str, order_key: str | None = None) -> tuple[DataFrame, str]:
    """Table with a numeric form of the target, and the name of that column.

    A target that is neither number nor flag gets category codes from 0 in value order (or by the
    first ``order_key`` of each category); a missing target becomes -1.
    """
    if is_number_or_flag(type_of(df, target)):
        value = col(target).cast("double") if type_of(df, target).typeName() == "boolean" else number(df, target)
        return df.withColumn("_target", value), "_target"
    codes = category_codes(df, target, order_key)
    size, volume = codes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col("value").cast("string"))), F.lit(0))).first()
    text = F.when(~missing(df, target), col(target))
    with_code = attach(df, codes.withColumn("_code", F.col("code").cast("double")), text, ["_code"], lookup_rows=size,
                       lookup_bytes=volume)
    return with_code.withColumn("_target", F.coalesce("_code", F.lit(-1.0))).drop("_code"), "_target"


def correlation_with_target(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    method: str = "pearson",
    order_key: str | None = None,
) -> DataFrame:
    """(feature, method, n, r) of each numeric feature with the target, largest r first."""
    names = [c for c in numeric_columns(df, [f for f in features if f in df.columns]) if c != target]
    schema = "feature string, position int, method string, n bigint, r double"
    if not names or target not in df.columns:
        return df.sparkSession.createDataFrame([], schema)
    coded, code = coded_target(df, target, order_key)
    columns = [*names, code]
    pairs = [(i, len(names)) for i in range(len(names))]
    table = _correlate(coded, columns, pairs, method)
    return table.select(
        F.col("col_i").alias("feature"), F.col("pos_i").alias("position"), "method", "n", "r"
    ).orderBy(F.desc_nulls_last("r"), "position")
