"""Table and column profiles."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import (
    as_text,
    col,
    epoch_micros,
    is_nested,
    is_numeric,
    is_temporal,
    missing,
    number,
    numeric_columns,
    type_of,
)
from tabsmith.operators.counts import distinct_count_map, text_tops
from tabsmith.operators.quantiles import quantiles

# Bytes of a value whose width does not depend on it; others are measured.
FIXED_WIDTH = {
    "boolean": 1, "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def table_shape(df: DataFrame) -> DataFrame:
    """(rows, columns)."""
    return df.agg(F.count("*").alias("rows")).withColumn("columns", F.lit(len(df.columns)).cast("bigint"))


def missing_counts(df: DataFrame, names: Sequence[str] | None = None) -> tuple[int, dict[str, int]]:
    """(rows, column -> missing values) from one aggregation without a shuffle of rows."""
    names = list(df.columns if names is None else names)
    row = df.agg(F.count("*"), *[F.count_if(missing(df, c)) for c in names]).first()
    return int(row[0]), {c: int(row[i + 1]) for i, c in enumerate(names)}


def missing_ratios(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(feature, missing_ratio, missing_pct), most missing first."""
    names = list(df.columns if names is None else names)
    wide = df.agg(*[F.avg(missing(df, c).cast("double")).alias(c) for c in names])
    return (
        wide.unpivot([], names, "feature", "missing_ratio")
        .withColumn("missing_pct", F.col("missing_ratio") * 100)
        .orderBy(F.desc("missing_ratio"), "feature")
    )


def overview(df: DataFrame, *, approximate: bool = False) -> DataFrame:
    """(position, column, dtype, missing_values, missing_pct, n_unique), one row per column.

    Nested columns are counted by null only; their ``n_unique`` is null.
    """
    rows, gaps = missing_counts(df)
    flat = [c for c in df.columns if not is_nested(type_of(df, c))]
    unique = distinct_count_map(df, flat, approximate=approximate)
    records = [
        (i, c, type_of(df, c).simpleString(), gaps[c], gaps[c] / rows * 100 if rows else None, unique.get(c))
        for i, c in enumerate(df.columns)
    ]
    schema = "position int, column string, dtype string, missing_values bigint, missing_pct double, n_unique bigint"
    table = df.sparkSession.createDataFrame(records, schema)
    return table.withColumn("missing_pct", F.bround("missing_pct", 2))


def dtype_summary(df: DataFrame) -> DataFrame:
    """(dtype, count), most common first."""
    types = df.sparkSession.createDataFrame([(t,) for _, t in df.dtypes], "dtype string")
    return types.groupBy("dtype").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "dtype")


def column_info(df: DataFrame) -> DataFrame:
    """(position, column, non_null, dtype)."""
    rows, gaps = missing_counts(df)
    records = [(i, c, rows - gaps[c], type_of(df, c).simpleString()) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(records, "position int, column string, non_null bigint, dtype string")


def memory_estimate(df: DataFrame) -> DataFrame:
    """(column, bytes, mb): width of the values in memory, texts by their length."""
    sizes = []
    for c in df.columns:
        width = FIXED_WIDTH.get(type_of(df, c).typeName())
        size = F.count("*") * F.lit(width) if width else F.sum(F.coalesce(F.octet_length(as_text(df, c)), F.lit(0)))
        sizes.append(F.coalesce(size.cast("bigint"), F.lit(0)).alias(c))
    long = df.agg(*sizes).unpivot([], list(df.columns), "column", "bytes")
    return long.withColumn("mb", F.col("bytes") / (1024.0 * 1024.0))


def memory_mb(df: DataFrame) -> float:
    return float(memory_estimate(df).agg(F.sum("mb")).first()[0] or 0.0)


def fingerprint(df: DataFrame) -> DataFrame:
    """(fingerprint, rows, columns): equal for equal content whatever the row order.

    Every row takes part. The sum of the row hashes guards against pairs of equal rows, which would
    cancel out in the exclusive-or alone.
    """
    hashed = F.xxhash64(*[as_text(df, c) if is_nested(type_of(df, c)) else col(c) for c in df.columns])
    schema = "|".join(sorted(f"{c}:{t}" for c, t in df.dtypes))
    schema_hash = hashlib.sha256(schema.encode()).hexdigest()[:12]
    parts = df.select(hashed.alias("h")).agg(
        F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
        F.count("*").alias("rows"),
    )
    content = F.sha2(F.concat_ws("|", F.col("x").cast("string"), F.col("s").cast("string")), 256)
    shape = F.concat(F.col("rows").cast("string"), F.lit(f"x{len(df.columns)}"))
    return parts.select(
        F.concat_ws(":", content, F.lit(schema_hash), shape).alias("fingerprint"),
        "rows",
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
    )


def fingerprint_text(df: DataFrame) -> str:
    return fingerprint(df).first()["fingerprint"]


def describe(df: DataFrame, *, exact: bool = True, quantile_rows: int | None = None) -> DataFrame:
    """One row per column: count, and by type (unique, top, freq), number or time statistics."""
    flat = [c for c in df.columns if not is_nested(type_of(df, c))]
    numeric = numeric_columns(df, flat)
    times = [c for c in flat if is_temporal(type_of(df, c))]
    classes = [c for c in flat if c not in set(numeric) and c not in set(times)]

    measures = {c: number(df, c) for c in numeric} | {c: epoch_micros(df, c).cast("double") for c in times}
    wide = [F.count(F.when(~missing(df, c), F.lit(1))) for c in flat]
    for x in measures.values():
        wide += [F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
    got = df.agg(*[e.alias(f"a{i}") for i, e in enumerate(wide)]).first()
    counts = {c: int(got[i]) for i, c in enumerate(flat)}
    basic = {c: got[len(flat) + 4 * i : len(flat) + 4 * i + 4] for i, c in enumerate(measures)}
    limits = {} if quantile_rows is None else {"direct_rows": quantile_rows}
    cuts = quantiles(df, measures, [0.25, 0.5, 0.75], exact=exact, **limits)

    unique, tops = {}, {}
    if classes:
        unique, best = text_tops(df, classes)
        tops = {r["column"]: (r["value"], int(r["n"])) for r in best.collect()}

    records = []
    for i, c in enumerate(flat):
        top, freq = tops.get(c, (None, None))
        row = [i, c, counts[c], (unique.get(c, 0) if c in set(classes) else None), top, freq]
        mean, std, low, high = basic.get(c, (None,) * 4)
        q = cuts.get(c, [None] * 3)
        numbers = [mean, std, low, *q, high]
        if c in set(times):
            moments = [None if v is None else int(round(v)) for v in (mean, low, *q, high)]
            row += [None] * 7 + moments
        else:
            row += numbers + [None] * 6
        records.append(tuple(row))
    stats = ["mean", "std", "min", "p25", "p50", "p75", "max"]
    moments = ["mean_ts", "min_ts", "p25_ts", "p50_ts", "p75_ts", "max_ts"]
    schema = "position int, column string, count bigint, unique bigint, top string, freq bigint, "
    schema += ", ".join(f"{s} double" for s in stats) + ", " + ", ".join(f"{m} bigint" for m in moments)
    table = df.sparkSession.createDataFrame(records, schema)
    return table.withColumns({m: F.timestamp_micros(m) for m in moments})


def duplicate_rows(df: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(rows, distinct_rows, duplicate_rows) over the named columns.

    Rows are compared by a 128-bit key, so whole texts are not shuffled.
    """
    names = list(df.columns if names is None else names)
    cells = [as_text(df, c) if is_nested(type_of(df, c)) else col(c) for c in names]
    # A null marks its place, so that (null, a) and (a, null) differ.
    flags = [missing(df, c) for c in names]
    keys = df.select(F.xxhash64(*cells, *flags).alias("a"), F.xxhash64(F.lit(17), *flags, *cells).alias("b"))
    per_key = keys.groupBy("a", "b").agg(F.count("*").alias("n"))
    totals = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return totals.withColumn("duplicate_rows", F.col("rows") - F.col("distinct_rows"))


def profile(df: DataFrame, *, top_n: int = 5, exact: bool = True) -> DataFrame:
    """Long table (column, metric, value) of table totals, counts, moments, quantiles, and
    (column, metric, text, value) rows for the top values.

    Scans: one for the moments, one for the quantiles, one shuffle for distinct counts, one for the
    top values, one for duplicates. None depends on the number of columns.
    """
    spark = df.sparkSession
    flat = [c for c in df.columns if not is_nested(type_of(df, c))]
    numeric = numeric_columns(df, flat)
    aggs, labels = [F.count("*")], [("", "rows")]

    def add(name: str, metric: str, expr) -> None:
        labels.append((name, metric))
        aggs.append(expr.cast("double"))

    infinite = F.lit(float("inf"))
    for c in df.columns:
        add(c, "missing", F.count_if(missing(df, c)))
    for c in numeric:
        x = number(df, c)
        add(c, "mean", F.avg(x))
        add(c, "std", F.stddev_samp(x))
        add(c, "min", F.min(x))
        add(c, "max", F.max(x))
        add(c, "sum", F.sum(x))
        add(c, "zeros", F.count_if(x == 0))
        add(c, "negative", F.count_if(x < 0))
        add(c, "infinite", F.count_if(F.abs(x) == infinite))
        add(c, "skewness", F.skewness(x))
        add(c, "kurtosis", F.kurtosis(x))
        add(c, "cv", F.try_divide(F.stddev_samp(x), F.avg(x)))
    got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    records = [(c, m, None, None if v is None else float(v)) for (c, m), v in zip(labels, got)]
    records.append(("", "columns", None, float(len(df.columns))))
    for c, n in distinct_count_map(df, flat).items():
        records.append((c, "n_unique", None, float(n)))
    marks = [0.05, 0.25, 0.5, 0.75, 0.95]
    for c, values in quantiles(df, numeric, marks, exact=exact).items():
        records += [(c, f"p{round(p * 100):02d}", None, v) for p, v in zip(marks, values)]
    twins = duplicate_rows(df).first()
    records.append(("", "duplicate_rows", None, float(twins["duplicate_rows"])))
    table = spark.createDataFrame(records, "column string, metric string, text string, value double")

    classes = [c for c in flat if not is_numeric(type_of(df, c)) and not is_temporal(type_of(df, c))]
    if not classes or top_n < 1:
        return table
    tops = text_tops(df, classes, top_n)[1].select(
        "column",
        F.concat(F.lit("top_"), F.col("place").cast("string")).alias("metric"),
        F.col("value").alias("text"),
        F.col("n").cast("double").alias("value"),
    )
    return table.unionByName(tops)
