from __future__ import annotations

import json

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from tabsmith.plans.estimators import LABEL, PREDICTION, PROBABILITY
from tabsmith.plans.fitted import FittedModel, metadata_table
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.registry import FitContext, ModelRegistry, default_registry, optional_libraries
from tabsmith.plans.spec import RunSpec
from tabsmith.plans.training import run_workbench
from tabsmith.plans.tuning import RandomSearch, draw
from tabsmith.queries import catalog
from tabsmith.sources.tables import append_runs, load_table, read_runs, write_rows
from tabsmith.streaming.scoring import file_stream, score_stream

QUICK = {
    "LogisticRegression": {"max_iter": 15},
    "RandomForest": {"n_estimators": 5, "max_depth": 4},
    "ExtraTrees": {"n_estimators": 5, "max_depth": 4},
    "GradientBoosting": {"n_estimators": 3},
    "SVM": {"n_components": 16},
    "KMeans": {"n_init": 1, "max_iter": 10},
}


@pytest.fixture(scope="module")
def rows(spark):
    rows = []
    for i in range(240):
        x, z = (i * 37) % 100 / 100, (i * 61) % 89 / 89
        y = "low" if x < 0.33 else "mid" if x < 0.66 else "high"
        rows.append((i, x, None if i % 11 == 0 else z, "u" if i % 3 else None, y, 3 * x - z, int(x > 0.5)))
    return spark.createDataFrame(rows, "k bigint, x double, z double, c string, y string, v double, b int").repartition(4).persist()


def spec(models, target="y", task="Classification", **options):
    return RunSpec(["x", "z", "c"], target, task, key="k", models=models, model_params=QUICK, scaling_strategy="StandardScaler", **options)


@pytest.fixture(scope="module")
def classified(rows):
    models = ["LogisticRegression", "RandomForest", "ExtraTrees", "SVM", "KNN", "GradientBoosting", "Unknown"]
    return run_workbench(rows, spec(models))


def test_every_classifier_beats_guessing(classified):
    assert classified.errors == {} and "Unknown" not in classified.runs
    assert set(classified.runs) == {"LogisticRegression", "RandomForest", "ExtraTrees", "SVM", "KNN", "GradientBoosting"}
    for run in classified.runs.values():
        assert run.metrics["Accuracy"] > 0.5 and run.metrics["ROC-AUC"] > 0.6


def test_probabilities_sum_to_one_and_agree_with_the_prediction(classified):
    p = [F.col(f"proba_{c}") for c in ("high", "low", "mid")]
    for run in classified.runs.values():
        best = F.greatest(*p)
        off = run.predictions.filter((F.abs(p[0] + p[1] + p[2] - 1) > 1e-6) | p[0].isNull())
        assert off.count() == 0
        wrong = run.predictions.filter(
            ~F.when(F.col("prediction") == "high", p[0] == best).when(F.col("prediction") == "low", p[1] == best).otherwise(p[2] == best)
        )
        assert wrong.count() == 0


def test_holdout_rows_are_predicted_once(classified):
    for run in classified.runs.values():
        assert run.predictions.count() == 48 == run.predictions.select("k").distinct().count()
        assert {"x", "z", "c", "actual", "prediction"} <= set(run.predictions.columns)


def test_best_model_leads_the_board(classified):
    board = classified.leaderboard.collect()
    assert board[0]["Model"] == classified.best
    assert [r["F1-Score"] for r in board] == sorted((r["F1-Score"] for r in board), reverse=True)


def test_importance_names_the_inputs(classified):
    runs = classified.runs
    assert runs["KNN"].importance is None and runs["SVM"].importance is None
    for name in ("LogisticRegression", "RandomForest", "ExtraTrees", "GradientBoosting"):
        table = runs[name].importance.collect()
        assert {r["feature"] for r in table} == {"x", "z", "c_u"} and table[0]["feature"] == "x"


@pytest.mark.parametrize("name", ["LogisticRegression", "RandomForest", "SVM", "KNN", "GradientBoosting"])
def test_saved_models_score_alike(classified, rows, tmp_path, name):
    fitted = classified.runs[name].fitted
    fitted.save(str(tmp_path / "m"))
    again = FittedModel.load(str(tmp_path / "m"))
    want = {r["k"]: r["prediction"] for r in fitted.score(rows, "k").collect()}
    assert {r["k"]: r["prediction"] for r in again.score(rows, "k").collect()} == want and len(want) == 240


def test_scoring_checks_columns_and_survives_unseen_categories(classified, spark):
    fitted = classified.runs["RandomForest"].fitted
    with pytest.raises(ValueError, match="Missing required columns: c"):
        fitted.score(spark.createDataFrame([(0.1, 0.2)], "x double, z double"))
    scored = fitted.score(spark.createDataFrame([(0.1, None, "never seen", 5)], "x double, z double, c string, extra int"))
    assert scored.columns[:4] == ["x", "z", "c", "extra"] and scored.first()["prediction"] in {"low", "mid", "high"}


def test_stream_is_scored_row_by_row(classified, rows, spark, tmp_path):
    fitted = classified.runs["LogisticRegression"].fitted
    rows.write.parquet(str(tmp_path / "in"))
    job = score_stream(fitted, file_stream(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    job.awaitTermination()
    got = {r["k"]: r["prediction"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["k"]: r["prediction"] for r in fitted.score(rows).collect()}
    with pytest.raises(ValueError, match="cannot score a stream"):
        classified.runs["KNN"].fitted.score(file_stream(spark, str(tmp_path / "in"), rows.schema))


def test_regressors_beat_the_mean(rows):
    names = ["RandomForest", "ExtraTrees", "SVM", "KNN", "GradientBoosting"]
    done = run_workbench(rows, spec(names, "v", "Regression"))
    assert done.errors == {}
    for name, run in done.runs.items():
        assert run.metrics["R2"] > (0.2 if name != "ExtraTrees" else 0.0), name


def test_binary_target_and_permutation_importance(rows):
    run = run_workbench(rows, spec(["RandomForest"], "b", permutation_importance=True)).runs["RandomForest"]
    table = run.permutation.collect()
    assert table[0]["feature"] == "x" and {r["feature"] for r in table} == {"x", "z", "c"}
    assert run.metrics["ROC-AUC"] > 0.9 and run.predictions.schema["prediction"].dataType.simpleString() == "int"


def test_cross_validation_predicts_every_row_once(rows):
    run = run_workbench(rows, spec(["LogisticRegression"], evaluation_mode="Cross Validation", cv_folds=3)).runs["LogisticRegression"]
    assert run.predictions.count() == 240 and run.predictions.select("k").distinct().count() == 240
    assert {r["fold"] for r in run.predictions.select("fold").distinct().collect()} == {0, 1, 2}


def test_clusters(rows):
    run = run_workbench(rows, RunSpec(["x", "z"], None, "Clustering", key="k", models=["KMeans"], model_params=QUICK, n_clusters=4, exact_silhouette=True)).runs["KMeans"]
    assert run.predictions.select("cluster").distinct().count() == 4 and run.predictions.count() == 240
    assert -1 <= run.metrics["Silhouette Score"] < run.metrics["Squared Silhouette"] <= 1


def test_rows_without_a_key_are_numbered(rows):
    run = run_workbench(rows.drop("k"), RunSpec(["x", "z"], "b", models=["LogisticRegression"], model_params=QUICK)).runs["LogisticRegression"]
    assert run.predictions.select("_rid").distinct().count() == 48


def test_one_failing_model_does_not_end_the_run(rows):
    def broken(params, context):
        raise RuntimeError("no such solver")

    registry = default_registry()
    registry.register_model("Classification", "Broken", broken)
    done = run_workbench(rows, spec(["Broken", "LogisticRegression"], "b"), registry=registry)
    assert "no such solver" in done.errors["Broken"] and done.best == "LogisticRegression"
    assert done.leaderboard.count() == 2
    done.release()
    with pytest.raises(RuntimeError, match="No model could be trained"):
        run_workbench(rows, spec(["Broken"], "b"), registry=registry)


def test_own_models_can_be_registered(rows):
    registry = ModelRegistry()
    registry.register_model("Classification", "Mine", lambda p, ctx: LogisticRegression(
        featuresCol=FEATURES, labelCol=LABEL, predictionCol=PREDICTION, probabilityCol=PROBABILITY, **p), {"maxIter": 5})
    assert registry.available_models("Classification") == ["Mine"]
    assert run_workbench(rows, spec(["Mine"], "b"), registry=registry).best == "Mine"
    with pytest.raises(ValueError, match="none of the tasks"):
        registry.register_model("Ranking", "x", lambda p, c: None)
    with pytest.raises(ValueError, match="has no model named"):
        registry.create_model("Classification", "Other", FitContext(1))


def test_default_registry():
    registry = default_registry(n_clusters=5, overrides={"Classification": {"KNN": {"n_neighbors": 3}, "Nope": {}}})
    extra = [n for n, present in optional_libraries().items() if present]
    base = ["ExtraTrees", "GradientBoosting", "KNN", "LogisticRegression", "RandomForest", "SVM"]
    assert registry.available_models("Classification") == sorted(base + extra)
    assert registry.params("Classification", "KNN") == {"n_neighbors": 3}
    assert registry.params("Clustering", "KMeans")["n_clusters"] == 5
    sizes = {n: len(draw(registry.search_space("Classification", n), 50)) for n in base}
    assert sizes == {"ExtraTrees": 36, "GradientBoosting": 27, "KNN": 10, "LogisticRegression": 5, "RandomForest": 36, "SVM": 6}
    assert len(draw(registry.search_space("Regression", "SVM"), 50)) == 12
    assert registry.search_space("Clustering", "KMeans") == {}


def test_random_search_tries_distinct_combinations(rows):
    search = RandomSearch()
    done = run_workbench(rows, spec(["KNN"], "b", tuning=True, tuning_iterations=2), optimizer=search)
    assert len(search.trials) == 2 and search.trials[0][0] != search.trials[1][0]
    best = max(search.trials, key=lambda t: t[1])[0]
    chosen = done.runs["KNN"].metadata["preprocessing"]["model_params"]
    assert {k: chosen[k] for k in best} == best


def test_boosting_stops_early(rows):
    params = {"GradientBoosting": {"n_estimators": 12, "n_iter_no_change": 2, "tol": 0.5}}
    run = run_workbench(rows, RunSpec(["x"], "v", "Regression", key="k", models=["GradientBoosting"], model_params=params))
    assert run.errors == {} and run.runs["GradientBoosting"].fitted.pipeline.stages[-1].getNumTrees < 12


@pytest.mark.parametrize("change", [{"task": "Ranking"}, {"train_size": 0.5}, {"encoding_strategy": "x"}, {"n_clusters": 1},
                                    {"per_column_missing_strategy": {"x": "Guess"}}])
def test_arguments_are_checked(change):
    with pytest.raises(ValueError):
        RunSpec(["x"], "y", **change)


def test_spec_round_trip():
    one = spec(["KNN"], cv_folds=3)
    assert RunSpec.from_dict(json.loads(json.dumps(one.to_dict()))) == one


def test_run_history_and_written_scores(classified, rows, spark, tmp_path):
    append_runs(spark, [r.metadata for r in classified.runs.values()], str(tmp_path / "runs"))
    history = read_runs(spark, str(tmp_path / "runs"))
    assert history.count() == 6 and history.filter("metrics['Accuracy'] > 0.5").count() == 6
    assert metadata_table(spark, [classified.runs["KNN"].metadata]).first()["features"] == ["x", "z", "c"]
    write_rows(classified.runs["LogisticRegression"].fitted.score(rows), str(tmp_path / "scored"))
    back = load_table(spark, str(tmp_path / "scored"), "csv")
    assert back.count() == 240 and {"prediction", "proba_low"} <= set(back.columns)
    with pytest.raises(ValueError, match="Unknown output format"):
        write_rows(rows, str(tmp_path / "x"), "xml")


def test_catalog_is_consistent():
    every = catalog()
    assert set(every.sql) <= set(every.queries) and len(every.queries) > 120
    assert sum(name in every.sql for name in every.queries) / len(every.queries) > 0.75


def test_rows_of_one_file_are_spread_over_tasks(spark, rows, monkeypatch):
    from tabsmith import session

    monkeypatch.setattr(session, "LEAST_ROWS", 40, raising=False)
    monkeypatch.setattr(session, "TASK_ROWS", 30, raising=False)
    run = run_workbench(rows.coalesce(1), spec(["SVM"], "v", "Regression"))
    sizes = run.runs["SVM"].predictions.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 48 and len(sizes) > 4, "a task has about 30 of the 240 rows"
