"""Data behind charts: histograms, density curves and point clouds."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col, to_number
from tabsmith.operators.sampling import sample_rows

GRID_POINTS = 200


def histogram(df: DataFrame, name: str, bins: int | None = None) -> DataFrame:
    """(bin, low, high, n, density) of the values that read as numbers; empty bins are listed.

    Without ``bins`` the number follows Sturges' rule.
    """
    x = to_number(col(name))
    values = df.select(x.alias("x")).filter("x is not null")
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    schema = "bin int, low double, high double, n bigint, density double"
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    if bins is None:
        bins = math.ceil(math.log2(n)) + 1
    if high == low:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counted = values.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edges = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return edges.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("low"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        (F.coalesce("n", F.lit(0)) / (n * width)).alias("density"),
    )


def density_curve(df: DataFrame, name: str, points: int = GRID_POINTS) -> DataFrame:
    """(point, x, density): Gaussian kernel density on an even grid, Scott's bandwidth.

    Every value takes part. Each task folds its values into one sum per grid point. A column with at
    most one distinct value has no curve.
    """
    values = df.select(to_number(col(name)).alias("x")).filter("x is not null")
    n, low, high, std = values.agg(F.count("*"), F.min("x"), F.max("x"), F.stddev_samp("x")).first()
    schema = "point int, x double, density double"
    if not n or low == high:
        return df.sparkSession.createDataFrame([], schema)
    width = std * n ** (-1 / 5)
    grid = np.linspace(low, high, points)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(points)
        for batch in batches:
            # Equal values share one kernel; slices keep the matrix small.
            unique, counts = np.unique(batch["x"].to_numpy(), return_counts=True)
            for start in range(0, len(unique), 2048):
                z = (grid[:, None] - unique[None, start : start + 2048]) / width
                total += np.exp(-0.5 * z * z) @ counts[start : start + 2048]
        yield pd.DataFrame({"point": np.arange(points), "total": total})

    sums = values.mapInPandas(fold, "point int, total double").groupBy("point").agg(F.sum("total").alias("total"))
    step = (high - low) / (points - 1)
    return sums.select(
        "point",
        (F.lit(low) + F.col("point") * step).alias("x"),
        (F.col("total") / (n * width * math.sqrt(2 * math.pi))).alias("density"),
    )


def actual_vs_predicted(
    df: DataFrame, actual: str, predicted: str, key: Sequence[str], max_points: int | None = None
) -> DataFrame:
    """(key, actual, predicted, low, high): points and the ends of the diagonal over all rows."""
    low = F.least(F.min(col(actual)), F.min(col(predicted)))
    high = F.greatest(F.max(col(actual)), F.max(col(predicted)))
    ends = df.agg(low, high).first()
    points = df.select(*[col(k) for k in key], col(actual).alias("actual"), col(predicted).alias("predicted"))
    points = sample_rows(points, max_points, key)
    return points.withColumns({"low": F.lit(ends[0]), "high": F.lit(ends[1])})


def top_importance(importance: DataFrame, n: int = 25) -> DataFrame:
    """The ``n`` largest importances."""
    return importance.orderBy(F.desc_nulls_last("importance"), "feature").limit(n)
