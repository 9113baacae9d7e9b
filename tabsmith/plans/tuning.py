"""Random search over model parameters."""

from __future__ import annotations

import itertools
import random
from concurrent.futures import ThreadPoolExecutor
from typing import Any, Protocol

from pyspark import inheritable_thread_target
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.splitting import with_folds
from tabsmith.plans.estimators import LABEL, PREDICTION
from tabsmith.plans.registry import FitContext, ModelRegistry
from tabsmith.plans.stages import ROW_ID


class Optimizer(Protocol):
    """Extension point: returns the parameters to use for a model."""

    def optimize(self, registry: ModelRegistry, task: str, name: str, train: DataFrame, context: FitContext,
                 overrides: dict[str, Any], n_iter: int, folds: int) -> dict[str, Any]: ...


def draw(space: dict[str, list], n_iter: int, seed: int = 42) -> list[dict[str, Any]]:
    """Distinct combinations drawn at random, or all of them where there are no more than ``n_iter``."""
    names = sorted(space)
    every = [dict(zip(names, values)) for values in itertools.product(*[space[n] for n in names])]
    if n_iter < 1:
        raise ValueError(f"A search needs at least one draw; got {n_iter}.")
    wanted = n_iter
    return every if len(every) <= wanted else random.Random(seed).sample(every, wanted)


def evaluator(task: str):
    if task == "Classification":
        return MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="weightedFMeasure")
    return RegressionEvaluator(labelCol=LABEL, predictionCol=PREDICTION, metricName="r2")


class RandomSearch:
    """Mean cross-validated score (weighted F1 or R2) per drawn combination; the best one wins.

    ``train`` is preprocessed and cached by the caller, so a combination costs its fits alone; ``parallel`` fits run at
    once. Each fit is told the rows of its own folds.
    """

    def __init__(self, seed: int = 42, parallel: int = 4) -> None:
        self.seed, self.parallel = seed, parallel
        self.trials: list[tuple[dict[str, Any], float]] = []

    def optimize(self, registry: ModelRegistry, task: str, name: str, train: DataFrame, context: FitContext,
                 overrides: dict[str, Any], n_iter: int, folds: int) -> dict[str, Any]:
        space = {k: v for k, v in registry.search_space(task, name).items() if k not in overrides}
        if not space:
            return dict(overrides)
        if folds < 2:
            raise ValueError(f"A search needs at least two folds; got {folds}.")
        target = LABEL if task == "Classification" else None
        rows = with_folds(train, [ROW_ID], folds, target=target, seed=self.seed).persist()
        used = rows.agg(F.max("fold")).first()[0] + 1
        sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
        total = sum(sizes.values())

        def score(trial: tuple[dict[str, Any], int]) -> float:
            params, i = trial
            fold = FitContext(total - sizes[i], context.n_classes, context.seed)
            model = registry.create_model(task, name, fold, {**overrides, **params}).fit(rows.filter(F.col("fold") != i))
            return evaluator(task).evaluate(model.transform(rows.filter(F.col("fold") == i)))

        drawn = draw(space, n_iter, self.seed)
        with ThreadPoolExecutor(self.parallel) as pool:
            scores = list(pool.map(inheritable_thread_target(train.sparkSession)(score), [(p, i) for p in drawn for i in range(used)]))
        self.trials = [(p, sum(scores[k * used : (k + 1) * used]) / used) for k, p in enumerate(drawn)]
        rows.unpersist()
        best = max(self.trials, key=lambda t: t[1])[0]
        return {**overrides, **best}
