"""Train, evaluate and rank models."""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.cleaning import TrainingData, prepare
from tabsmith.operators.metrics import (
    CLASSIFICATION,
    CLUSTERING,
    REGRESSION,
    classification_metrics,
    leaderboard,
    named_metrics,
    regression_metrics,
)
from tabsmith.operators.silhouette import euclidean_silhouette, squared_silhouette
from tabsmith.operators.splitting import can_stratify, with_folds, with_holdout
from tabsmith.plans.estimators import LABEL, PREDICTION, WEIGHT
from tabsmith.plans.explain import builtin_importance, permutation_importance
from tabsmith.plans.fitted import FittedModel, label_column, run_metadata, with_row_id
from tabsmith.plans.preprocess import FEATURES, Preprocessor
from tabsmith.plans.registry import FitContext, ModelRegistry, default_registry
from tabsmith.plans.spec import RunSpec
from tabsmith.plans.stages import ROW_ID
from tabsmith.plans.tuning import Optimizer, RandomSearch
from tabsmith.session import spread

LOG = logging.getLogger(__name__)
METRICS = {"Classification": CLASSIFICATION, "Regression": REGRESSION, "Clustering": CLUSTERING}
EARLY_ROUNDS = 10


@dataclass
class ModelRun:
    name: str
    fitted: FittedModel
    predictions: DataFrame
    metrics: dict[str, float | None]
    metadata: dict[str, Any]
    importance: DataFrame | None = None
    permutation: DataFrame | None = None


@dataclass
class TrainingSummary:
    leaderboard: DataFrame
    runs: dict[str, ModelRun]
    errors: dict[str, str]
    best: str
    data: TrainingData
    labels: list[Any] = field(default_factory=list)
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        """Give back the cached tables of the run. Results read later are computed again."""
        for table in [*self.cached, *[r.predictions for r in self.runs.values()]]:
            table.unpersist()


@dataclass
class _Table:
    """Prepared rows with row id, label and numeric target, and what models need to know about them."""

    rows: DataFrame
    n_rows: int
    labels: list[Any]
    sizes: dict[int, int]
    label_type: str
    base: DataFrame


def _prepare_rows(data: TrainingData, spec: RunSpec) -> _Table:
    frame = data.frame
    if spec.key is None:
        frame = spread(with_row_id(frame, None), data.rows, ROW_ID)
    else:
        frame = spread(with_row_id(frame, spec.key), data.rows, ROW_ID).persist()
    if spec.task == "Clustering":
        return _Table(frame, data.rows, [], {}, "string", frame)
    if spec.task == "Regression":
        return _Table(frame.withColumn(LABEL, col(spec.target).cast("double")), data.rows, [], {}, "double", frame)
    counts = frame.groupBy(col(spec.target).alias("label")).agg(F.count("*").alias("n"))
    if spec.max_classes is not None and (classes := counts.count()) > spec.max_classes:
        raise ValueError(f"Target {spec.target!r} has {classes} classes, more than max_classes={spec.max_classes}.")
    found = sorted((r["label"], int(r["n"])) for r in counts.collect())  # a model keeps its classes: they fit in memory
    labels = [v for v, _ in found]
    rows = label_column(frame, spec.target, labels)
    sizes = {i: n for i, (_, n) in enumerate(found)}
    return _Table(rows, data.rows, labels, sizes, frame.schema[spec.target].dataType.simpleString(), frame)


def _weighted(rows: DataFrame, balanced: bool, n_classes: int) -> DataFrame:
    """Add the row weight: rows / (classes * rows of the class) where the model balances, else 1."""
    if not balanced:
        return rows.withColumn(WEIGHT, F.lit(1.0))
    counts = {int(r[LABEL]): int(r["n"]) for r in rows.groupBy(LABEL).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    weights = [total / (len(counts) * counts[i]) if counts.get(i) else 0.0 for i in range(n_classes)]
    return rows.withColumn(WEIGHT, F.get(F.array(*map(F.lit, weights)), F.col(LABEL).cast("int")))


def _overrides(spec: RunSpec, name: str) -> dict[str, Any]:
    """The run's parameters of a model; early stopping where it boosts."""
    given = dict(spec.model_params.get(name, {}))
    if spec.early_stopping and name == "GradientBoosting":
        given.setdefault("n_iter_no_change", EARLY_ROUNDS)
    return given


def _balances(registry: ModelRegistry, spec: RunSpec, name: str, overrides: Mapping[str, Any]) -> bool:
    return str(registry.params(spec.task, name, overrides).get("class_weight", "")).startswith("balanced")


def _fit(registry: ModelRegistry, spec: RunSpec, name: str, train: DataFrame, table: _Table, n_rows: int,
         overrides: Mapping[str, Any]):
    context = FitContext(n_rows, len(table.labels), spec.seed)
    rows = _weighted(train, _balances(registry, spec, name, overrides), len(table.labels))
    return registry.create_model(spec.task, name, context, overrides).fit(rows)


def _tuned(registry, spec, name, train, table, optimizer, overrides, folds) -> dict[str, Any]:
    """Parameters found on ``train`` alone, under the row weights of the fit; those given if the run does not tune."""
    if not spec.tuning:
        return overrides
    context = FitContext(train.count(), len(table.labels), spec.seed)
    base = _weighted(train, _balances(registry, spec, name, overrides), len(table.labels))
    return optimizer.optimize(registry, spec.task, name, base, context, overrides, spec.tuning_iterations, folds)


def _target_column(table: _Table, spec: RunSpec) -> tuple[DataFrame, str]:
    """Numeric target for target encodings: its value, or its class position for text classes."""
    if spec.task == "Clustering":
        return table.rows, ""
    numeric = table.label_type not in {"string", "date", "timestamp", "timestamp_ntz"}
    source = col(spec.target).cast("double") if numeric else col(LABEL)
    return table.rows.withColumn("_target", source), "_target"


def _predictions(fitted: FittedModel, scored: DataFrame, spec: RunSpec, features: list[str]) -> DataFrame:
    key = [ROW_ID, *[c for c in ([spec.key] if spec.key else []) if c not in features]]
    if spec.task == "Clustering":
        return fitted.outputs(scored, [*key, *features])
    named = scored.withColumn("actual", col(spec.target))
    return fitted.outputs(named, [*key, *features, "actual"])


def evaluate(predictions: DataFrame, task: str, scores: Mapping[Any, str] | None = None) -> dict[str, float | None]:
    """Metrics under their leaderboard names; areas need ``scores``: class -> probability column."""
    if task == "Classification":
        present = {v: col(c) for v, c in (scores or {}).items() if c in predictions.columns}
        return named_metrics(classification_metrics(predictions, scores=present or None).first(), task)
    if task == "Regression":
        return named_metrics(regression_metrics(predictions).first(), task)
    raise ValueError(f"There are no metrics for the task {task!r}.")


def _cluster_score(scored: DataFrame, spec: RunSpec) -> dict[str, float | None]:
    """The squared silhouette, and the Euclidean one where the run asks for it."""
    points = scored.select(ROW_ID, F.col(PREDICTION).alias("c"), vector_to_array(FEATURES).alias("x"))
    exact = euclidean_silhouette(points, ROW_ID, "c", "x").first()[0] if spec.exact_silhouette else None
    return {"Squared Silhouette": squared_silhouette(points, "c", "x").first()[0], "Silhouette Score": exact}


def train_models(
    data: TrainingData,
    spec: RunSpec,
    *,
    registry: ModelRegistry | None = None,
    optimizer: Optimizer | None = None,
    fingerprint: str | None = None,
) -> TrainingSummary:
    """Fit every selected model, score it, and rank the models.

    A holdout run fits the preprocessing once and shares its cached output between the models; a cross-
    validation run refits it inside every fold. A model that fails is reported with its error while the
    others go on; unknown names are skipped.
    """
    if not spec.models:
        raise ValueError("The run names no model.")
    registry = registry or default_registry(spec.seed, spec.n_clusters)
    optimizer = optimizer or RandomSearch(spec.seed)
    table = _prepare_rows(data, spec)
    rows, target = _target_column(table, spec)
    table.rows = rows
    preprocessor = Preprocessor(data.features, spec.preprocessing(), target or None)
    known = [m for m in dict.fromkeys(spec.models) if m in registry.available_models(spec.task)]
    for name in spec.models:
        if name not in known:
            LOG.warning("Skipping unknown model %r for task %r", name, spec.task)
    runs: dict[str, ModelRun] = {}
    errors: dict[str, str] = {}
    shared = _shared_holdout(table, spec, preprocessor) if spec.evaluation_mode == "Train/Test Split" else None
    for name in known:
        try:
            runs[name] = _run_model(name, data, spec, table, preprocessor, shared, registry, optimizer, fingerprint)
        except Exception as exc:  # one model must not end the comparison
            LOG.warning("Model %s failed", name, exc_info=True)
            errors[name] = f"{type(exc).__name__}: {str(exc)[:500]}"
    if not runs:
        raise RuntimeError(f"No model could be trained: {errors}")
    board = _leaderboard(runs, errors, spec)
    best = board.first()["Model"]
    cached = [table.base, *data.cleaning.cached]
    if shared:
        cached += [t for t in (shared.train, shared.test, shared.split) if t is not None]
    return TrainingSummary(board, runs, errors, best, data, table.labels, cached)


def _leaderboard(runs: dict[str, ModelRun], errors: dict[str, str], spec: RunSpec) -> DataFrame:
    names = METRICS[spec.task]
    records = [(n, *[r.metrics.get(m) for m in names], r.metadata["train_seconds"], None) for n, r in runs.items()]
    records += [(n, *[None] * len(names), None, e) for n, e in errors.items()]
    schema = ", ".join(["Model string", *[f"`{m}` double" for m in names], "train_seconds double", "error string"])
    return leaderboard(SparkSession.active().createDataFrame(records, schema), spec.task)


@dataclass
class _Shared:
    pipeline: PipelineModel
    train: DataFrame
    test: DataFrame
    n_train: int
    split: DataFrame | None = None


def _shared_holdout(table: _Table, spec: RunSpec, preprocessor: Preprocessor) -> _Shared:
    if spec.task == "Clustering":
        pipeline = preprocessor.fit(table.rows)
        every = pipeline.transform(table.rows).persist()
        return _Shared(pipeline, every, every, table.n_rows)
    classes = {str(k): n for k, n in table.sizes.items()}
    stratify = LABEL if spec.task == "Classification" and spec.stratify and can_stratify(classes) else None
    split = with_holdout(table.rows, [ROW_ID], spec.train_size, stratify=stratify, seed=spec.seed)
    # The statistics of every stage scan the training side: cache the split instead of hashing anew.
    split = split.persist()
    n_train = split.filter("is_train").count()
    table.base.unpersist()
    train, test = split.filter("is_train"), split.filter(~F.col("is_train"))
    pipeline = preprocessor.fit(train)
    train_t, test_t = pipeline.transform(train).persist(), pipeline.transform(test).persist()
    return _Shared(pipeline, train_t, test_t, n_train, split)


def _run_model(name, data, spec, table, preprocessor, shared, registry, optimizer, fingerprint) -> ModelRun:
    overrides = _overrides(spec, name)
    if spec.task == "Clustering":
        overrides.setdefault("n_clusters", spec.n_clusters)
        return _run_clustering(name, data, spec, table, shared, registry, overrides, fingerprint)
    if shared is None:
        return _run_folds(name, data, spec, table, preprocessor, registry, optimizer, overrides, fingerprint)
    overrides = _tuned(registry, spec, name, shared.train, table, optimizer, overrides, 3)
    start = time.perf_counter()
    model = _fit(registry, spec, name, shared.train, table, shared.n_train, overrides)
    seconds = time.perf_counter() - start
    fitted = FittedModel(name, spec.task, data.features, PipelineModel([*shared.pipeline.stages, model]),
                         table.labels, table.label_type)
    scored = model.transform(shared.test)
    predictions = _predictions(fitted, scored, spec, data.features).persist()
    raw = [ROW_ID, *data.features, spec.target]
    permuted = shared.test.select(*[col(c) for c in dict.fromkeys(raw)]) if spec.permutation_importance else None
    return _finish(name, fitted, predictions, shared.train, permuted, spec, data, seconds, overrides, fingerprint)


def _finish(name, fitted, predictions, preprocessed, permuted, spec, data, seconds, overrides, fingerprint) -> ModelRun:
    metrics = evaluate(predictions, spec.task, fitted.probability_columns())
    settings = {**spec.preprocessing().to_dict(), "model_params": overrides}
    meta = run_metadata(name, spec.task, metrics, data.features, settings, seconds, fingerprint)
    fitted.metadata = meta
    importance = builtin_importance(fitted, preprocessed)
    permutation = None
    if permuted is not None:
        try:
            permutation = permutation_importance(fitted, permuted, spec.target, seed=spec.seed)
        except Exception:  # a model without an explanation is still a model
            LOG.warning("No permutation importance for %s", name, exc_info=True)
    return ModelRun(name, fitted, predictions, metrics, meta, importance, permutation)


def _run_folds(name, data, spec, table, preprocessor, registry, optimizer, overrides, fingerprint) -> ModelRun:
    """Every row is predicted once, by the model of the fold it is held out of; then a fit on all rows.

    Preprocessing and search see the rows of their own fit only.
    """
    target = LABEL if spec.task == "Classification" else None
    rows = with_folds(table.rows, [ROW_ID], spec.cv_folds, target=target, seed=spec.seed).persist()
    start = time.perf_counter()
    parts = None
    for i in range(rows.agg(F.max("fold")).first()[0] + 1):
        train, held = rows.filter(F.col("fold") != i), rows.filter(F.col("fold") == i)
        pipeline = preprocessor.fit(train)
        ready = pipeline.transform(train).persist()
        found = _tuned(registry, spec, name, ready, table, optimizer, overrides, min(spec.cv_folds, 3))
        model = _fit(registry, spec, name, ready, table, ready.count(), found)
        ready.unpersist()
        part = FittedModel(name, spec.task, data.features, PipelineModel([*pipeline.stages, model]),
                           table.labels, table.label_type)
        scored = _predictions(part, part.pipeline.transform(held), spec, data.features)
        scored = scored.withColumn("fold", F.lit(i))
        parts = scored if parts is None else parts.unionByName(scored)
    predictions = parts.persist()
    predictions.count()  # fills the cache before the fold tables are given back
    pipeline = preprocessor.fit(table.rows)
    ready = pipeline.transform(table.rows).persist()
    overrides = _tuned(registry, spec, name, ready, table, optimizer, overrides, min(spec.cv_folds, 3))
    model = _fit(registry, spec, name, ready, table, table.n_rows, overrides)
    seconds = time.perf_counter() - start
    ready.unpersist()
    rows.unpersist()
    fitted = FittedModel(name, spec.task, data.features, PipelineModel([*pipeline.stages, model]),
                         table.labels, table.label_type)
    raw = [ROW_ID, *data.features, spec.target]
    permuted = table.rows.select(*[col(c) for c in dict.fromkeys(raw)]) if spec.permutation_importance else None
    return _finish(name, fitted, predictions, ready, permuted, spec, data, seconds, overrides, fingerprint)


def _run_clustering(name, data, spec, table, shared, registry, overrides, fingerprint) -> ModelRun:
    start = time.perf_counter()
    model = registry.create_model(spec.task, name, FitContext(table.n_rows, 0, spec.seed), overrides).fit(shared.train)
    seconds = time.perf_counter() - start
    fitted = FittedModel(name, spec.task, data.features, PipelineModel([*shared.pipeline.stages, model]))
    scored = model.transform(shared.train)
    metrics = _cluster_score(scored, spec)
    settings = {**spec.preprocessing().to_dict(), "model_params": overrides}
    meta = run_metadata(name, spec.task, metrics, data.features, settings, seconds, fingerprint)
    fitted.metadata = meta
    predictions = _predictions(fitted, scored, spec, data.features).persist()
    return ModelRun(name, fitted, predictions, metrics, meta, builtin_importance(fitted, shared.train))


def run_workbench(df: DataFrame, spec: RunSpec, **options) -> TrainingSummary:
    """Clean, prepare, train and compare: the whole run on one table."""
    return train_models(prepare(df, spec.cleaning()), spec, **options)

