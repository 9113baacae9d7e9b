"""Tables that turn categories into numbers, for all categorical columns in one shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import as_text
from tabsmith.operators.counts import _long, _with_names
from tabsmith.operators.running import running_totals

# Category for missing values, smoothing weights of the two target encodings.
MISSING = "__MISSING__"
TARGET_SMOOTHING = 10.0
STRONG_SMOOTHING = 20.0


def category_text(df: DataFrame, name: str) -> Column:
    return F.coalesce(as_text(df, name), F.lit(MISSING))


def category_stats(df: DataFrame, names: Sequence[str], target: Column | None = None) -> DataFrame:
    """(column, value, n, total): rows and target sum per category of each column.

    Rows are folded per category before the shuffle, so a hot category is one row per task.
    """
    y = F.lit(None).cast("double") if target is None else target.cast("double")
    long = _long(df, [[category_text(df, c), y] for c in names], ["value", "y"])
    stats = long.groupBy("k", "value").agg(F.count("*").alias("n"), F.sum("y").alias("total"))
    return _with_names(stats, names).select("column", "value", "n", "total")


def frequency_table(stats: DataFrame) -> DataFrame:
    """(column, value, n, code): share of the rows."""
    rows = stats.groupBy("column").agg(F.sum("n").alias("rows"))
    return stats.join(F.broadcast(rows), "column").select(
        "column", "value", "n", (F.col("n") / F.col("rows")).alias("code")
    )


def target_mean_table(stats: DataFrame, smoothing: float, overall: float) -> DataFrame:
    """(column, value, n, code): target mean per category, drawn towards the overall mean."""
    code = (F.col("total") + F.lit(smoothing * overall)) / (F.col("n") + F.lit(smoothing))
    return stats.select("column", "value", "n", code.alias("code"))


def label_table(stats: DataFrame, largest: int | None = None) -> DataFrame:
    """(column, value, n, code): categories numbered from 0 in value order."""
    ones = stats.withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_totals(ones, ["column"], "value", ["_one"], largest=largest)
    return ranked.select("column", "value", "n", (F.col("cum__one") - 1).cast("double").alias("code"))


def one_hot_table(stats: DataFrame, max_categories: int, largest: int | None = None) -> DataFrame:
    """(column, value, n, code, name): indicator position per category.

    Categories in value order. With more than ``max_categories``, the ``max_categories - 1`` most frequent
    keep a position of their own (ties: the later value keeps it) and the others share the last one.
    """
    sizes = stats.groupBy("column").agg(F.count("*").alias("categories"))
    sized = stats.join(F.broadcast(sizes), "column")
    if largest is not None and largest <= max_categories:
        kept, rest = sized, sized.limit(0)
    else:
        # Row numbers stop early at the limit, so no task holds more than its share of the categories.
        by_count = Window.partitionBy("column").orderBy(F.desc("n"), F.desc("value"))
        crowded = F.col("categories") > max_categories
        frequent = (
            sized.withColumn("place", F.row_number().over(by_count))
            .filter(F.col("place") <= max_categories)
            .filter(~crowded | (F.col("place") < max_categories))
            .select("column", "value")
        )
        kept = sized.join(F.broadcast(frequent), ["column", "value"], "left_semi")
        rest = sized.join(F.broadcast(frequent), ["column", "value"], "left_anti")
    # At most ``max_categories`` rows per column are numbered here.
    position = F.row_number().over(Window.partitionBy("column").orderBy("value")) - 1
    own = kept.select("column", "value", "n", position.cast("double").alias("code"), F.col("value").alias("name"))
    shared = rest.select(
        "column", "value", "n", F.lit(max_categories - 1).cast("double").alias("code"),
        F.lit("infrequent").alias("name"),
    )
    return own.unionByName(shared)
