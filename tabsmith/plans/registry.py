"""Models by task and name, their defaults and their search spaces."""

from __future__ import annotations

import importlib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression

from tabsmith.plans.bagged_forest import BaggedForest
from tabsmith.plans.boosting import MultinomialBoosting
from tabsmith.plans.clusters import JointKMeans
from tabsmith.plans.estimators import (
    LABEL,
    PREDICTION,
    PROBABILITY,
    RAW,
    WEIGHT,
    EarlyStopped,
    NearestRows,
    boosted_classifier,
    boosted_regressor,
    kernel_classifier,
    kernel_regressor,
)
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.random_trees import RandomTrees

TASKS = ("Classification", "Regression", "Clustering")
DEEPEST = 30  # levels of a forest without a depth


@dataclass(frozen=True)
class FitContext:
    """What a factory may need to know about the training table."""

    n_rows: int
    n_classes: int = 0
    seed: int = 42


Factory = Callable[[dict[str, Any], FitContext], Estimator]


@dataclass
class RegisteredModel:
    task: str
    name: str
    factory: Factory
    params: dict[str, Any] = field(default_factory=dict)
    space: dict[str, list] = field(default_factory=dict)


class ModelRegistry:
    """Extension point: register a factory that returns any pyspark.ml estimator.

    The estimator reads ``_features`` (vector), ``_label`` (double) and ``_weight``, and its model writes
    ``_prediction`` and, for classifiers that have one, ``_probability``.
    """

    def __init__(self) -> None:
        self._models: dict[tuple[str, str], RegisteredModel] = {}

    @staticmethod
    def _check(task: str) -> None:
        if task not in TASKS:
            raise ValueError(f"{task!r} is none of the tasks {', '.join(TASKS)}.")

    def register_model(self, task: str, name: str, factory: Factory, params: Mapping[str, Any] | None = None,
                       space: Mapping[str, list] | None = None) -> None:
        self._check(task)
        self._models[task, name] = RegisteredModel(task, name, factory, dict(params or {}), dict(space or {}))

    def available_models(self, task: str) -> list[str]:
        self._check(task)
        return sorted(n for t, n in self._models if t == task)

    def entry(self, task: str, name: str) -> RegisteredModel:
        if (task, name) not in self._models:
            raise ValueError(f"{task} has no model named {name!r}.")
        return self._models[task, name]

    def params(self, task: str, name: str, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
        return {**self.entry(task, name).params, **(overrides or {})}

    def create_model(self, task: str, name: str, context: FitContext, overrides: Mapping[str, Any] | None = None) -> Estimator:
        return self.entry(task, name).factory(self.params(task, name, overrides), context)

    def search_space(self, task: str, name: str) -> dict[str, list]:
        """Empty for models without a space and for unknown names."""
        found = self._models.get((task, name))
        return dict(found.space) if found else {}


def _logistic(p: dict, ctx: FitContext) -> Estimator:
    return LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, predictionCol=PREDICTION, probabilityCol=PROBABILITY,
        rawPredictionCol=RAW, family="auto", maxIter=p["max_iter"], standardization=False, tol=p.get("tol", 1e-6),
        regParam=1.0 / (p.get("C", 1.0) * max(ctx.n_rows, 1)),
    )


def _forest(features: str, classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        depth = p.get("max_depth")
        return BaggedForest(ctx.n_classes if classify else None, p["n_estimators"], DEEPEST if depth is None else min(depth, DEEPEST),
                            p.get("min_samples_split", 2), features, p["random_state"], p.get("class_weight") == "balanced_subsample")

    return make


def _random_trees(features: str, classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        return RandomTrees(ctx.n_classes if classify else None, p["n_estimators"], p.get("max_depth"), p.get("min_samples_split", 2), features,
                           p["random_state"])

    return make


def _boosting(classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        common = {"maxIter": p.get("n_estimators", 100), "stepSize": p.get("learning_rate", 0.1),
                  "maxDepth": p.get("max_depth", 3), "seed": p["random_state"]}

        patience = p.get("n_iter_no_change") or 0
        if classify and ctx.n_classes > 2:
            return MultinomialBoosting(ctx.n_classes, common["maxIter"], common["stepSize"], common["maxDepth"],
                                       p.get("validation_fraction", 0.1), patience, p.get("tol", 1e-4))

        def build(options: dict) -> Estimator:
            every = common | options
            return boosted_classifier(ctx.n_classes, **every) if classify else boosted_regressor(**every)

        if patience:
            return EarlyStopped(build, p.get("validation_fraction", 0.1), p.get("tol", 1e-4))
        return build({})

    return make


def _kernel(classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        if p.get("kernel", "rbf") != "rbf":
            raise ValueError(f"SVM has the rbf kernel only; got {p['kernel']!r}.")
        shape = (p.get("C", 1.0), p.get("gamma", "scale"), p.get("n_components", 256), ctx.seed)
        return kernel_classifier(ctx.n_classes, ctx.n_rows, *shape) if classify else kernel_regressor(ctx.n_rows, *shape, p.get("epsilon", 0.1))

    return make


def _neighbours(classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        return NearestRows(p["n_neighbors"], p.get("weights", "uniform"), ctx.n_classes if classify else None)

    return make


def _kmeans(p: dict, ctx: FitContext) -> Estimator:
    return JointKMeans(p["n_clusters"], p["n_init"], p["random_state"], p.get("max_iter", 300), p.get("tol", 1e-4))


# Search spaces per model.
TREES = {"n_estimators": [200, 300, 500], "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10]}
BOOSTING = {"n_estimators": [100, 200, 300], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [2, 3, 5]}
NEIGHBOURS = {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"]}
KERNEL = {"C": [0.5, 1.0, 2.0], "gamma": ["scale", "auto"]}
XGBOOST = {"n_estimators": [200, 400, 600], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 5, 7],
           "subsample": [0.7, 0.9, 1.0]}
LIGHTGBM = {"n_estimators": [200, 400, 600], "learning_rate": [0.01, 0.05, 0.1], "num_leaves": [31, 63, 127]}
CATBOOST = {"depth": [4, 6, 8], "learning_rate": [0.01, 0.05, 0.1], "iterations": [200, 400, 600]}

# Optional Spark bindings: module, classes for classification and regression, argument names, search space.
OPTIONAL = {
    "XGBoost": ("xgboost.spark", "SparkXGBClassifier", "SparkXGBRegressor", XGBOOST, {"n_estimators": 400}),
    "LightGBM": ("synapse.ml.lightgbm", "LightGBMClassifier", "LightGBMRegressor", LIGHTGBM, {"n_estimators": 400}),
    "CatBoost": ("catboost_spark", "CatBoostClassifier", "CatBoostRegressor", CATBOOST, {}),
}
_RENAMED = {
    "LightGBM": {"n_estimators": "numIterations", "learning_rate": "learningRate", "num_leaves": "numLeaves",
                 "random_state": "seed"},
    "CatBoost": {"learning_rate": "learningRate", "random_state": "randomSeed"},
}


def optional_libraries() -> dict[str, bool]:
    """Which optional boosting libraries can be imported."""
    found = {}
    for name, (module, *_) in OPTIONAL.items():
        try:
            importlib.import_module(module)
            found[name] = True
        except ImportError:
            found[name] = False
    return found


def _binding(name: str, module: str, class_name: str, classify: bool) -> Factory:
    def make(p: dict, ctx: FitContext) -> Estimator:
        cls = getattr(importlib.import_module(module), class_name)
        args = {_RENAMED.get(name, {}).get(k, k): v for k, v in p.items()}
        if name == "XGBoost":
            columns = {"features_col": FEATURES, "label_col": LABEL, "prediction_col": PREDICTION}
            return cls(**columns, **({"probability_col": PROBABILITY} if classify else {}), **args)
        columns = {"featuresCol": FEATURES, "labelCol": LABEL, "predictionCol": PREDICTION}
        return cls(**columns, **({"probabilityCol": PROBABILITY} if classify else {}), **args)

    return make


def default_registry(seed: int = 42, n_clusters: int = 3, overrides: Mapping[str, Mapping[str, dict]] | None = None) -> ModelRegistry:
    """All models with their defaults. ``overrides``: task -> model -> parameters; unknown names are ignored."""
    registry = ModelRegistry()
    add = registry.register_model
    state = {"random_state": seed}
    add("Classification", "LogisticRegression", _logistic, {"max_iter": 2500, "class_weight": "balanced"},
        {"C": [0.01, 0.1, 1.0, 5.0, 10.0]})
    forest = {"n_estimators": 300, **state}
    add("Classification", "RandomForest", _forest("sqrt", True),
        {**forest, "class_weight": "balanced_subsample"}, TREES)
    add("Regression", "RandomForest", _forest("all", False), forest, TREES)
    add("Classification", "ExtraTrees", _random_trees("sqrt", True),
        {**forest, "class_weight": "balanced"}, TREES)
    add("Regression", "ExtraTrees", _random_trees("all", False), forest, TREES)
    add("Classification", "SVM", _kernel(True), {"kernel": "rbf", "class_weight": "balanced"}, KERNEL)
    add("Regression", "SVM", _kernel(False), {"kernel": "rbf", "epsilon": 0.1}, {**KERNEL, "epsilon": [0.01, 0.1]})
    for task, classify in (("Classification", True), ("Regression", False)):
        add(task, "KNN", _neighbours(classify), {"n_neighbors": 7}, NEIGHBOURS)
        add(task, "GradientBoosting", _boosting(classify), state, BOOSTING)
    add("Clustering", "KMeans", _kmeans, {"n_clusters": n_clusters, "n_init": 20, **state})
    for name, present in optional_libraries().items():
        module, classifier, regressor, space, defaults = OPTIONAL[name]
        if present:
            add("Classification", name, _binding(name, module, classifier, True), {**defaults, **state}, space)
            add("Regression", name, _binding(name, module, regressor, False), {**defaults, **state}, space)
    for task, models in (overrides or {}).items():
        for name, params in models.items():
            if name in registry.available_models(task):
                registry.entry(task, name).params.update(params)
    return registry
