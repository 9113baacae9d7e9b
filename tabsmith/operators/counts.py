"""Value counts in long form: the table that distinct counts, modes, encoders and charts read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import as_text, col, is_nested, is_text, missing, type_of
from tabsmith.operators.running import number_distinct


def _long(df: DataFrame, cells: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One row per (row, column): ``k`` numbers the column and ``names`` hold its cells."""
    flat = [x for k, row in enumerate(cells) for x in (F.lit(k), *row)]
    return df.select(F.stack(F.lit(len(cells)), *flat).alias("k", *names))


def _with_names(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace the column number ``k`` by the column name."""
    labels = F.array(*[F.lit(c) for c in names])
    return df.withColumn("column", F.get(labels, F.col("k"))).drop("k")


def value_counts(df: DataFrame, names: Sequence[str], *, null_label: str | None = None) -> DataFrame:
    """(column, value, n) with the value as text. One shuffle whatever the number of columns.

    Counts are combined before the shuffle, so a value that fills a third of the rows costs one row
    per task. Nulls are left out unless ``null_label`` names a bucket for them.
    """
    long = _long(df, [[as_text(df, c)] for c in names], ["value"])
    if null_label is None:
        long = long.filter(F.col("value").isNotNull())
    else:
        long = long.withColumn("value", F.coalesce("value", F.lit(null_label)))
    counted = long.groupBy("k", "value").agg(F.count("*").alias("n"))
    return _with_names(counted, names).select("column", "value", "n")


def _value_key(df: DataFrame, name: str) -> list[Column]:
    """Fixed-width key per distinct value: 128 bits for text, 64 for the rest.

    The 64-bit hash of a single value of at most eight bytes is one-to-one, so only text (and
    wide decimals) rests on the improbability of a 128-bit collision.
    """
    dtype = type_of(df, name)
    wide = is_text(dtype) or is_nested(dtype) or dtype.typeName() == "decimal"
    x = as_text(df, name) if wide else col(name)
    if dtype.typeName() in {"double", "float"}:
        x = x + F.lit(0.0)
    second = F.xxhash64(F.lit(17), x) if wide else F.lit(0).cast("bigint")
    return [F.when(~missing(df, name), F.xxhash64(x)), second]


def distinct_counts(df: DataFrame, names: Sequence[str], *, approximate: bool = False) -> DataFrame:
    """(column, n_unique) over non-missing values.

    The exact form shuffles 16-byte keys, never the values; ``approximate`` needs no such shuffle.
    """
    if approximate:
        row = df.agg(*[F.approx_count_distinct(F.when(~missing(df, c), col(c)), 0.01).alias(c) for c in names])
        return row.unpivot([], list(names), "column", "n_unique")
    keys = _long(df, [_value_key(df, c) for c in names], ["a", "b"]).filter(F.col("a").isNotNull())
    counted = keys.distinct().groupBy("k").agg(F.count("*").alias("n_unique"))
    return _with_names(counted, names).select("column", "n_unique")


def distinct_count_map(df: DataFrame, names: Sequence[str], *, approximate: bool = False) -> dict[str, int]:
    """Distinct counts on the driver: one number per column."""
    if not names:
        return {}
    found = {r["column"]: int(r["n_unique"]) for r in distinct_counts(df, names, approximate=approximate).collect()}
    return {c: found.get(c, 0) for c in names}


def most_frequent(counts: DataFrame, value: Column | None = None) -> DataFrame:
    """(column, top, freq): the most frequent value per column, ties to the smallest.

    An aggregate over a struct, not a window: the maximum combines before the shuffle.
    """
    v = F.col("value") if value is None else value
    best = counts.groupBy("column").agg(F.max("n").alias("freq"))
    return (
        counts.join(F.broadcast(best), "column")
        .filter(F.col("n") == F.col("freq"))
        .groupBy("column", "freq")
        .agg(F.min(v).alias("top"))
        .select("column", "top", "freq")
    )


TIED_KEYS = 10_000
"""Up to so many tied values are looked up by a broadcast of their keys."""


def text_tops(df: DataFrame, names: Sequence[str], top_n: int = 1) -> tuple[dict[str, int], DataFrame]:
    """Distinct values per column, and (column, place, value, n) of the ``top_n`` most frequent, ties to the smallest text.

    Values are counted by keys of fixed width; only texts of the winning keys are fetched, so a column of long texts is not
    shuffled. Where single values must fill up the places, each task offers its smallest ones.
    """
    names = list(names)
    schema = "column string, place int, value string, n bigint"
    cells = [_value_key(df, c) for c in names]
    counted = _long(df, cells, ["a", "b"]).filter("a is not null").groupBy("k", "a", "b").agg(F.count("*").alias("n")).persist()
    unique = {names[r["k"]]: int(r["u"]) for r in counted.groupBy("k").agg(F.count("*").alias("u")).collect()}
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n")))
    tops = counted.withColumn("place", place).filter(F.col("place") <= top_n)
    least = {r["k"]: r["least"] for r in tops.groupBy("k").agg(F.min("n").alias("least")).collect()}  # a row per column
    bounds = F.create_map(*[F.lit(x) for k, n in least.items() for x in (k, max(n, 2))]) if least else None
    rows: list[tuple] = []
    if bounds is not None:
        chosen = counted.filter(F.col("n") >= bounds[F.col("k")])
        few = chosen.limit(TIED_KEYS + 1).count() <= TIED_KEYS
        side = F.broadcast(chosen) if few else chosen.hint("merge")
        texts = _long(df, [[*cell, as_text(df, c)] for cell, c in zip(cells, names)], ["a", "b", "value"])
        found = texts.join(side, ["k", "a", "b"]).groupBy("k", "a", "b").agg(F.first("value").alias("value"), F.first("n").alias("n"))
        order = F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), F.asc("value")))
        rows = [tuple(r) for r in found.withColumn("place", order).filter(F.col("place") <= top_n).select("k", "place", "value", "n").collect()]
        for k, n in least.items():
            have = [r for r in rows if r[0] == k]
            if n > 1 or len(have) >= top_n:
                continue
            several = [(r["a"], r["b"]) for r in chosen.filter(F.col("k") == k).select("a", "b").collect()]  # fewer than top_n
            a, b = cells[k]
            single = df.filter(~missing(df, names[k]))
            for x, y in several:
                single = single.filter(~((a == x) & (b == y)))
            rest = single.select(as_text(df, names[k]).alias("value")).orderBy("value").limit(top_n - len(have)).collect()
            rows += [(k, len(have) + i, r["value"], 1) for i, r in enumerate(rest, 1)]
    counted.unpersist()
    return unique, df.sparkSession.createDataFrame([(names[k], p, v, n) for k, p, v, n in sorted(rows, key=lambda r: r[:2])], schema)


def modes(df: DataFrame, names: Sequence[str]) -> dict[str, object]:
    """Most frequent non-missing value per column, in the type of the column; ties to the smallest.

    The result is one value per column. All columns are counted by one shuffle of their texts, and ties break by the value in
    the type of the column.
    """
    if not names:
        return {}
    cells = []
    for name in names:
        value = col(name) + F.lit(0.0) if type_of(df, name).typeName() in {"double", "float"} else col(name)
        cells.append([F.when(~missing(df, name), value.cast("string"))])
    counted = _long(df, cells, ["value"]).filter("value is not null").groupBy("k", "value").agg(F.count("*").alias("n"))
    largest = counted.groupBy("k").agg(F.max("n").alias("n"))
    tied = counted.join(F.broadcast(largest), ["k", "n"])  # a row per column
    best = [F.min(F.when(F.col("k") == i, F.col("value").cast(type_of(df, c)))).alias(f"m{i}") for i, c in enumerate(names)]
    row = tied.agg(*best).first()
    return {c: row[i] for i, c in enumerate(names)}


def top_values(df: DataFrame, name: str, top_n: int = 20) -> DataFrame:
    """(value, count) of the most frequent values of one column as text; nulls count as ``NaN``."""
    value = F.coalesce(as_text(df, name), F.lit("NaN"))
    return (
        df.select(value.alias("value"))
        .groupBy("value")
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), F.asc("value"))
        .limit(top_n)
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """(label, n, pct, ratio) per class over non-missing targets; ratio = largest / smallest."""
    counts = (
        df.filter(~missing(df, target)).groupBy(col(target).alias("label")).agg(F.count("*").alias("n"))
    )
    total, largest, smallest = counts.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    ratio = float(largest) / max(smallest, 1) if total else None
    return counts.select(
        "label", "n", F.bround(F.col("n") * 100.0 / F.lit(total), 2).alias("pct"), F.lit(ratio).cast("double").alias("ratio")
    )


def category_codes(df: DataFrame, name: str, order_key: str | None = None, *, largest: int | None = None,
                   **limits) -> DataFrame:
    """(value, code, n): categories numbered from 0 in value order, or by their first ``order_key``.

    ``order_key`` must differ between categories, as a row key does.
    """
    grouped = df.filter(~missing(df, name)).groupBy(col(name).alias("value"))
    aggs = [F.count("*").alias("n")]
    if order_key is not None:
        aggs.append(F.min(col(order_key)).alias("_first"))
    coded = number_distinct(grouped.agg(*aggs), "value" if order_key is None else "_first", largest=largest, **limits)
    return coded.select("value", (F.col("position") - 1).alias("code"), "n")
