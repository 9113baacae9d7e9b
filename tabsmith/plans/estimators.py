"""Estimators that Spark ML lacks, built on its models."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.neighbours import nearest
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.stages import ROW_ID, FittedStage
from tabsmith.session import durable

LABEL, WEIGHT = "_label", "_weight"
PREDICTION, PROBABILITY, RAW = "_prediction", "_probability", "_raw"
RAW_SCORE = {"gbt": GBTClassificationModel, "svc": LinearSVCModel}


def argmax(scores: Column) -> Column:
    """Position of the largest entry, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("double")


class OneAgainstRest(Estimator):
    """One binary model per class, combined to class probabilities inside the JVM.

    ``calibrate`` fits a logistic curve on the margin of each class (Platt scaling); otherwise the logistic
    function of twice the margin is used, as the loss of boosted trees implies. Two classes need one model.
    """

    def __init__(self, make: Callable[[], Estimator], kind: str, n_classes: int, calibrate: bool) -> None:
        super().__init__()
        self.make, self.kind, self.n_classes, self.calibrate = make, kind, n_classes, calibrate

    def _fit(self, df: DataFrame) -> OneAgainstRestModel:
        models, curves = [], []
        for k in [1] if self.n_classes == 2 else range(self.n_classes):
            one = df.withColumn("_is", (col(LABEL) == k).cast("double"))
            model = self.make().fit(one)
            models.append(model)
            if self.calibrate:
                margin = F.get(vector_to_array(RAW), F.lit(1))
                scored = model.transform(one).select(F.array(margin).alias("m"), "_is")
                scored = scored.select(array_to_vector("m").alias("m"), "_is")
                curve = LogisticRegression(featuresCol="m", labelCol="_is", maxIter=50).fit(scored)
                curves.append([float(curve.coefficients[0]), float(curve.intercept)])
            else:
                curves.append([2.0, 0.0])
        state = {"kind": self.kind, "n_classes": self.n_classes, "curves": curves}
        return OneAgainstRestModel(state, models=models)


class OneAgainstRestModel(FittedStage):
    def __init__(self, state: dict | None = None, tables=None, models: list[Model] | None = None) -> None:
        super().__init__(state, tables)
        self.models = models or []

    def save_parts(self, path: str) -> None:
        for i, model in enumerate(self.models):
            model.write().overwrite().save(f"{path}/model_{i}")

    def load_parts(self, path: str) -> None:
        kind = RAW_SCORE[self.state["kind"]]
        self.models = [kind.load(f"{path}/model_{i}") for i in range(len(self.state["curves"]))]

    def importances(self) -> np.ndarray | None:
        if self.state["kind"] != "gbt":
            return None
        total = np.mean([m.featureImportances.toArray() for m in self.models], axis=0)
        return total

    def _transform(self, df: DataFrame) -> DataFrame:
        out, temporary = df, []
        for i, (model, (slope, offset)) in enumerate(zip(self.models, self.state["curves"])):
            raw, guess, extra = f"{RAW}{i}", f"{PREDICTION}{i}", f"{PROBABILITY}{i}"
            names = {model.getParam("rawPredictionCol"): raw, model.getParam("predictionCol"): guess}
            if model.hasParam("probabilityCol"):
                names[model.getParam("probabilityCol")] = extra
            out = model.transform(out, names)
            margin = F.get(vector_to_array(raw), F.lit(1))
            out = out.withColumn(f"_p{i}", 1.0 / (1.0 + F.exp(-(F.lit(slope) * margin + F.lit(offset)))))
            temporary += [raw, guess, extra, f"_p{i}"]
        if self.state["n_classes"] == 2:
            scores = F.array(1 - F.col("_p0"), F.col("_p0"))
        else:
            raw_scores = F.array(*[F.col(f"_p{i}") for i in range(len(self.models))])
            total = F.aggregate(raw_scores, F.lit(0.0), lambda a, v: a + v)
            scores = F.transform(raw_scores, lambda v: v / F.greatest(total, F.lit(1e-300)))
        out = out.withColumn("_scores", scores)
        out = out.withColumns({PROBABILITY: array_to_vector("_scores"), PREDICTION: argmax(F.col("_scores"))})
        return out.drop("_scores", *temporary)


def boosted_classifier(n_classes: int, **params) -> OneAgainstRest:
    """Gradient boosting for any number of classes."""

    def make() -> GBTClassifier:
        trees = GBTClassifier(featuresCol=FEATURES, labelCol="_is", weightCol=WEIGHT, predictionCol=PREDICTION, **params)
        return trees.setProbabilityCol(PROBABILITY).setRawPredictionCol(RAW)

    return OneAgainstRest(make, "gbt", n_classes, calibrate=False)


class EarlyStopped(Estimator):
    """Hold back a share of the training rows and let boosting stop when they no longer improve."""

    def __init__(self, make: Callable[[dict], Estimator], share: float, tolerance: float) -> None:
        super().__init__()
        self.make, self.share, self.tolerance = make, share, tolerance

    def _fit(self, df: DataFrame) -> Model:
        held = F.pmod(F.xxhash64(F.lit(42), col(ROW_ID)), F.lit(1000)) < int(self.share * 1000)
        options = {"validationIndicatorCol": "_held", "validationTol": self.tolerance}
        return self.make(options).fit(df.withColumn("_held", held))


class RandomFeatures(Estimator):
    """Random Fourier features of the Gaussian kernel (Rahimi and Recht, 2007).

    gamma: a number, ``scale`` = 1 / (width * variance of all entries), or ``auto`` = 1 / width.
    """

    def __init__(self, gamma, n_components: int = 256, seed: int = 42) -> None:
        super().__init__()
        self.gamma, self.n_components, self.seed = gamma, n_components, seed

    def _fit(self, df: DataFrame) -> RandomFeaturesModel:
        row = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(FEATURES)).alias("s")).first()["s"]
        mean, n = row["mean"].toArray(), max(int(row["count"]), 1)
        population = row["variance"].toArray() * (n - 1) / n
        width = len(mean)
        # Variance over all entries: within the columns and between their means.
        variance = float(population.mean() + mean.var())
        gamma = {"scale": 1.0 / (width * variance) if variance > 0 else 1.0, "auto": 1.0 / width}.get(self.gamma, self.gamma)
        rng = np.random.default_rng(self.seed)
        weights = rng.normal(scale=math.sqrt(2.0 * float(gamma)), size=(width, self.n_components))
        shifts = rng.uniform(0.0, 2 * math.pi, size=self.n_components)
        return RandomFeaturesModel({"weights": weights.tolist(), "shifts": shifts.tolist()})


class RandomFeaturesModel(FittedStage):
    OUTPUT = "_kernel"

    def _transform(self, df: DataFrame) -> DataFrame:
        weights, shifts = np.array(self.state["weights"]), np.array(self.state["shifts"])

        @F.pandas_udf("array<double>")
        def lift(points: pd.Series) -> pd.Series:
            x = np.array(points.tolist(), dtype=float)
            return pd.Series(list(np.sqrt(2.0 / len(shifts)) * np.cos(x @ weights + shifts)))

        return df.withColumn(self.OUTPUT, array_to_vector(lift(vector_to_array(FEATURES))))


TUBE_ROUNDS = 2


class KernelMachine(Estimator):
    """Approximate kernel machine: random features followed by a linear model of the same loss family.

    ``epsilon``: errors up to it cost nothing. The loss of such a tube is the least over shifts t of the label with |t| <= epsilon; fit
    and shifts are improved in turns, ``TUBE_ROUNDS`` times.
    """

    def __init__(self, linear: Callable[[], Estimator], gamma, n_components: int, seed: int, epsilon: float = 0.0) -> None:
        super().__init__()
        self.linear, self.gamma, self.n_components, self.seed, self.epsilon = linear, gamma, n_components, seed, epsilon

    def _fit(self, df: DataFrame) -> PipelineModel:
        lift = RandomFeatures(self.gamma, self.n_components, self.seed).fit(df)
        lifted = lift.transform(df).select(RandomFeaturesModel.OUTPUT, LABEL, WEIGHT).persist()
        model = self.linear().fit(lifted)
        for _ in range(TUBE_ROUNDS if self.epsilon else 0):
            error = F.col(LABEL) - F.col(PREDICTION)
            shift = F.greatest(F.least(error, F.lit(float(self.epsilon))), F.lit(-float(self.epsilon)))
            inside = model.transform(lifted).withColumn(LABEL, F.col(LABEL) - shift)
            model = self.linear().fit(inside.select(RandomFeaturesModel.OUTPUT, LABEL, WEIGHT))
        lifted.unpersist()
        return PipelineModel([lift, model])


def kernel_classifier(n_classes: int, n_rows: int, c: float, gamma, n_components: int, seed: int) -> KernelMachine:
    def make() -> LinearSVC:
        return LinearSVC(featuresCol=RandomFeaturesModel.OUTPUT, labelCol="_is", weightCol=WEIGHT, maxIter=100, tol=1e-3,
                         regParam=1.0 / (c * max(n_rows, 1)), standardization=False,
                         predictionCol=PREDICTION, rawPredictionCol=RAW)

    return KernelMachine(lambda: OneAgainstRest(make, "svc", n_classes, calibrate=True), gamma, n_components, seed)


def kernel_regressor(n_rows: int, c: float, gamma, n_components: int, seed: int, epsilon: float = 0.1) -> KernelMachine:
    def make() -> LinearRegression:
        return LinearRegression(featuresCol=RandomFeaturesModel.OUTPUT, labelCol=LABEL, loss="huber", maxIter=100, tol=1e-3,
                                regParam=1.0 / (c * max(n_rows, 1)), standardization=False, predictionCol=PREDICTION)

    return KernelMachine(make, gamma, n_components, seed, epsilon)


class NearestRows(Estimator):
    """k nearest neighbours: vote (``n_classes``) or mean. Keeps the training rows."""

    def __init__(self, k: int, weights: str = "uniform", n_classes: int | None = None) -> None:
        super().__init__()
        if weights not in {"uniform", "distance"}:
            raise ValueError(f"Unknown neighbour weights: {weights}")
        self.k, self.weights, self.n_classes = k, weights, n_classes

    def _fit(self, df: DataFrame) -> NearestRowsModel:
        rows = df.select(col(ROW_ID).cast("bigint").alias("tid"), vector_to_array(FEATURES).alias("x"), col(LABEL).alias("y"))
        state = {"k": self.k, "weights": self.weights, "n_classes": self.n_classes}
        return NearestRowsModel(state, {"rows": durable(rows)})


class NearestRowsModel(FittedStage):
    """Needs the row id column in the rows it scores."""

    def _transform(self, df: DataFrame) -> DataFrame:
        rows = self.tables["rows"]
        queries = df.select(col(ROW_ID).cast("bigint").alias("qid"), vector_to_array(FEATURES).alias("x"))
        near = nearest(queries, rows.select("tid", "x"), self.state["k"])
        near = near.join(rows.select("tid", "y"), "tid")
        if self.state["weights"] == "distance":
            # A neighbour at distance zero decides alone.
            exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
            weight = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), "distance"))
        else:
            weight = F.lit(1.0)
        near = near.withColumn("w", weight)
        if self.state["n_classes"] is None:
            answer = near.groupBy("qid").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias(PREDICTION))
        else:
            votes = [F.sum(F.when(F.col("y") == i, F.col("w")).otherwise(0.0)) / F.sum("w")
                     for i in range(self.state["n_classes"])]
            answer = near.groupBy("qid").agg(F.array(*votes).alias("_votes"))
            answer = answer.select("qid", array_to_vector("_votes").alias(PROBABILITY), argmax(F.col("_votes")).alias(PREDICTION))
        return df.join(answer, col(ROW_ID).cast("bigint") == F.col("qid"), "left").drop("qid")


def boosted_regressor(**params) -> GBTRegressor:
    return GBTRegressor(featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, **params)
