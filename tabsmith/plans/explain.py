"""Importance of features: from the model itself, and by permutation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.splitting import shifted_values
from tabsmith.plans.boosting import MultinomialBoostingModel
from tabsmith.plans.estimators import OneAgainstRestModel, RandomFeaturesModel
from tabsmith.plans.fitted import FittedModel
from tabsmith.plans.preprocess import FEATURES, feature_names
from tabsmith.plans.random_trees import RandomTreesModel
from tabsmith.plans.stages import ROW_ID

IMPORTANCE = "feature string, importance double"
BLOCK_ROWS = 1_000_000


def _importances(model) -> np.ndarray | None:
    if isinstance(model, PipelineModel):
        if any(isinstance(s, RandomFeaturesModel) for s in model.stages):
            return None  # weights of random features say nothing about the inputs
        return _importances(model.stages[-1])
    if isinstance(model, (OneAgainstRestModel, MultinomialBoostingModel, RandomTreesModel)):
        return model.importances()
    if hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    if hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    if hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    if hasattr(model, "clusterCenters"):
        return np.std(np.array(model.clusterCenters()), axis=0)
    return None


def builtin_importance(fitted: FittedModel, scored: DataFrame) -> DataFrame | None:
    """(feature, importance), largest first; none for neighbour and kernel models.

    ``scored`` is any output of the preprocessing: only its schema is read.
    """
    values = _importances(fitted.pipeline.stages[-1])
    names = feature_names(scored) if FEATURES in scored.columns else []
    if values is None:
        return None
    if not names:
        names = [f"feature_{i}" for i in range(len(values))]
    if len(names) != len(values):
        return None
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return SparkSession.active().createDataFrame(rows, IMPORTANCE).orderBy(F.desc("importance"), "feature")


def grouped_scores(predictions: DataFrame, groups: Sequence[str], actual: str, predicted: str, task: str) -> DataFrame:
    """(groups, score): weighted F1 of a classification or R2 of a regression, per group."""
    groups = list(groups)
    if task == "Regression":
        y, p = col(actual).cast("double"), col(predicted)
        sums = predictions.groupBy(*groups).agg(F.avg((y - p) * (y - p)).alias("mse"), F.var_pop(y).alias("spread"))
        flat = F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
        score = F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(flat)
        return sums.select(*groups, score.alias("score"))
    counts = predictions.groupBy(*groups, col(actual).alias("a"), col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = counts.select(
        *groups,
        F.inline(F.array(
            F.struct(F.col("a").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("c"),
                     F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0).alias("h")),
            F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("s"), F.col("n").alias("c"),
                     F.lit(0).cast("bigint").alias("h")),
        )),
    )
    per_class = sides.groupBy(*groups, "label").agg(F.sum("s").alias("s"), F.sum("c").alias("c"), F.sum("h").alias("h"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("h"), F.col("s") + F.col("c")), F.lit(0.0))
    return per_class.groupBy(*groups).agg((F.sum(f1 * F.col("s")) / F.sum("s")).alias("score"))


def permutation_importance(
    fitted: FittedModel, rows: DataFrame, target: str, *, repeats: int = 5, seed: int = 42, block_rows: int = BLOCK_ROWS
) -> DataFrame | None:
    """(feature, importance): mean loss of score when the values of one raw feature are permuted.

    ``rows`` hold the raw features, the target and the row id. Each repeat permutes all features with one
    shuffle; one pass then scores every feature of every repeat. None for fewer than ten rows.
    """
    n = rows.count()
    if n < 10:
        return None
    names = list(fitted.features)
    predicted = "prediction"
    base = fitted.outputs(fitted.pipeline.transform(rows), [target])
    start = grouped_scores(base.withColumn("_g", F.lit(0)), ["_g"], target, predicted, fitted.task).first()["score"]
    blocks = max(1, -(-n // block_rows))
    parts = []
    for r in range(repeats):
        part = shifted_values(rows, names, [ROW_ID], blocks, seed + r).withColumn("_repeat", F.lit(r))
        parts.append(part)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.withColumn("_feature", F.explode(F.sequence(F.lit(0), F.lit(len(names) - 1))))
    every = every.withColumns(
        {c: F.when(F.col("_feature") == i, F.col(f"_moved_{i}")).otherwise(col(c)) for i, c in enumerate(names)}
    )
    # Copies of a row need ids of their own for models that search by row id.
    every = every.withColumn(ROW_ID, F.xxhash64(ROW_ID, "_repeat", "_feature"))
    scored = fitted.outputs(fitted.pipeline.transform(every), [target, "_repeat", "_feature"])
    scores = grouped_scores(scored, ["_repeat", "_feature"], target, predicted, fitted.task)
    drop = scores.groupBy("_feature").agg((F.lit(start) - F.avg("score")).alias("importance"))
    labels = F.array(*[F.lit(c) for c in names])
    return drop.select(F.get(labels, F.col("_feature")).alias("feature"), "importance").orderBy(
        F.desc("importance"), "feature"
    )
