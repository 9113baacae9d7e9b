"""Metrics of predictions, computed from counts and sums."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.running import running_totals

# Fixed value: smallest denominator of a percentage error (double precision epsilon).
EPSILON = 2.220446049250313e-16

CLASSIFICATION = ["Accuracy", "Precision", "Recall", "F1-Score", "ROC-AUC", "PR-AUC"]
REGRESSION = ["MSE", "RMSE", "MAE", "R2", "MAPE"]
CLUSTERING = ["Squared Silhouette", "Silhouette Score"]


def confusion_counts(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """(actual, predicted, n) of the combinations that occur: at most classes squared rows."""
    return df.groupBy(col(actual).alias("actual"), col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def _labels(counts: DataFrame) -> DataFrame:
    return counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()


def confusion_matrix(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """(actual, predicted, n) for every pair of labels, zeros included."""
    counts = confusion_counts(df, actual, predicted)
    # One row that lists the classes, unfolded twice.
    classes = _labels(counts).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    grid = classes.select(F.explode("labels").alias("actual"), "labels").select(
        "actual", F.explode("labels").alias("predicted")
    )
    return grid.join(F.broadcast(counts), ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def class_scores(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support, hits) per class; empty denominators give 0."""
    counts = confusion_counts(df, actual, predicted)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("label"), F.col("n").alias("s"), F.lit(0).cast("bigint").alias("p"),
                         F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("h")),
                F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("s"),
                         F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")),
            )
        ).alias("e")
    ).select("e.*")
    sums = sides.groupBy("label").agg(F.sum("s").alias("support"), F.sum("p").alias("claimed"), F.sum("h").alias("hits"))
    zero = F.lit(0.0)
    return sums.select(
        "label",
        F.coalesce(F.try_divide("hits", "claimed"), zero).alias("precision"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("hits"), F.col("support") + F.col("claimed")), zero).alias("f1"),
        "support",
        "hits",
    )


def _weighted(name: str) -> Column:
    return F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def label_metrics(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row (accuracy, precision, recall, f1), weighted by support."""
    return class_scores(df, actual, predicted).agg(
        F.try_divide(F.sum("hits"), F.sum("support")).alias("accuracy"),
        _weighted("precision").alias("precision"),
        _weighted("recall").alias("recall"),
        _weighted("f1").alias("f1"),
    )


def classification_report(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1-score, support): classes, accuracy, macro and weighted average."""
    scores = class_scores(df, actual, predicted)
    names = ["label", "precision", "recall", "f1-score", "support"]
    per_class = scores.select(F.col("label").cast("string"), "precision", "recall", F.col("f1").alias("f1-score"), "support")
    accuracy = F.try_divide(F.sum("hits"), F.sum("support"))
    support = F.sum("support").alias("support")
    summary = scores.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), accuracy.alias("precision"), accuracy.alias("recall"),
                     accuracy.alias("f1-score"), support),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1-score"), support),
            F.struct(F.lit("weighted avg").alias("label"), _weighted("precision").alias("precision"),
                     _weighted("recall").alias("recall"), _weighted("f1").alias("f1-score"), support),
        ).alias("rows")
    )
    return per_class.toDF(*names).unionByName(summary.select(F.explode("rows").alias("r")).select("r.*"))


def _score_counts(df: DataFrame, actual: str, scores: Mapping[object, Column]) -> DataFrame:
    """(label, score, pos, neg): rows per distinct score and class, folded before any ordering."""
    cells = [F.struct(F.lit(str(c)).alias("label"), s.cast("double").alias("score"),
                      (col(actual) == F.lit(c)).cast("bigint").alias("pos")) for c, s in scores.items()]
    long = df.filter(col(actual).isNotNull()).select(F.inline(F.array(*cells))).filter(F.col("score").isNotNull())
    return long.groupBy("label", "score").agg(
        F.sum("pos").alias("pos"), (F.count("*") - F.sum("pos")).alias("neg")
    )


def ranking_scores(df: DataFrame, actual: str, scores: Mapping[object, Column], **limits) -> DataFrame:
    """(label, positives, negatives, roc_auc, average_precision) per class, ties counted half.

    Both areas come from running totals over the distinct scores; see ``running_totals`` for how
    they avoid a single task. ROC-AUC is null without positives or without negatives.
    """
    counts = _score_counts(df, actual, scores).withColumn("down", -F.col("score"))
    ranked = running_totals(counts, ["label"], "down", ["pos", "neg"], **limits)
    totals = counts.groupBy("label").agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    hits, seen = F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")
    above = F.col("cum_neg") - F.col("neg") / 2.0
    sums = ranked.groupBy("label").agg(
        F.sum(F.col("pos") * above).alias("lost"), F.sum(F.col("pos") * hits / seen).alias("gained")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives")
    return totals.join(sums, "label").select(
        "label", "positives", "negatives",
        (1 - F.try_divide("lost", pairs)).alias("roc_auc"),
        F.coalesce(F.try_divide("gained", F.col("positives").cast("double")), F.lit(0.0)).alias("average_precision"),
    )


def area_metrics(df: DataFrame, actual: str, scores: Mapping[object, Column], **limits) -> DataFrame:
    """One row (roc_auc, pr_auc).

    ``scores`` maps class -> score in class order. Two classes: the score of the greater class. More:
    each class against the rest, weighted by support; null if a class lacks rows or is all rows.
    """
    if len(scores) <= 2:
        last = list(scores)[-1]
        one = ranking_scores(df, actual, {last: scores[last]}, **limits)
        precision = F.when(F.col("positives") > 0, F.col("average_precision"))
        return one.agg(F.max("roc_auc").alias("roc_auc"), F.max(precision).alias("pr_auc"))
    per_class = ranking_scores(df, actual, scores, **limits)
    whole = F.count("roc_auc") == len(scores)
    weighted = lambda c: F.when(whole, F.sum(F.col(c) * F.col("positives")) / F.sum("positives"))
    return per_class.agg(weighted("roc_auc").alias("roc_auc"), weighted("average_precision").alias("pr_auc"))


def classification_metrics(
    df: DataFrame, actual: str = "actual", predicted: str = "prediction", scores: Mapping[object, Column] | None = None,
    **limits,
) -> DataFrame:
    """One row: accuracy, precision, recall, f1, roc_auc, pr_auc; the areas are null without scores."""
    labels = label_metrics(df, actual, predicted)
    if not scores:
        return labels.withColumns({"roc_auc": F.lit(None).cast("double"), "pr_auc": F.lit(None).cast("double")})
    both = (*labels.first(), *area_metrics(df, actual, scores, **limits).first())
    names = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc"]
    return df.sparkSession.createDataFrame([both], ", ".join(f"{n} double" for n in names))


def regression_metrics(df: DataFrame, actual: str = "actual", predicted: str = "prediction") -> DataFrame:
    """One row: mse, rmse, mae, r2, mape.

    Without variance r2 is 1 for perfect predictions and 0 otherwise.
    """
    y, p = col(actual).cast("double"), col(predicted).cast("double")
    error = y - p
    sums = df.filter(y.isNotNull() & p.isNotNull()).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("spread"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    flat = F.when(F.col("mse") == 0, 1.0).when(F.col("mse").isNotNull(), 0.0)
    return sums.select(
        "mse", F.sqrt("mse").alias("rmse"), "mae",
        F.when(F.col("spread") > 0, 1 - F.col("mse") / F.col("spread")).otherwise(flat).alias("r2"),
        "mape",
    )


def named_metrics(row, task: str) -> dict[str, float | None]:
    """Metrics row as a dictionary under the names of the leaderboard."""
    names = {"Classification": CLASSIFICATION, "Regression": REGRESSION, "Clustering": CLUSTERING}
    if task not in names:
        raise ValueError(f"There are no metrics for the task {task!r}.")
    return {n: (None if v is None else float(v)) for n, v in zip(names[task], row)}


def leaderboard(df: DataFrame, task: str) -> DataFrame:
    """Best model first, NaN as missing and missing last, ties by model name."""
    orders = {
        "Classification": [("F1-Score", False), ("ROC-AUC", False), ("Accuracy", False)],
        "Regression": [("R2", False), ("MAE", True)],
        "Clustering": [("Squared Silhouette", False), ("Silhouette Score", False)],
    }
    keys = []
    for name, ascending in orders[task]:
        if name in df.columns:
            value = F.when(~F.isnan(col(name)), col(name))
            keys.append(F.asc_nulls_last(value) if ascending else F.desc_nulls_last(value))
    return df.orderBy(*keys, "Model")


