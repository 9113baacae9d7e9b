"""Fitted models, with the registry's own parameters on whole tables.

Predictions of most models have no SQL; checked is what is determined: rows, actual values, classes, and metrics recomputed from the
predictions. Neighbour models are compared in full.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators.cleaning import prepare
from tabsmith.operators.neighbours import nearest
from tabsmith.operators.profile import fingerprint_text
from tabsmith.plans.explain import builtin_importance
from tabsmith.plans.fitted import FittedModel, metadata_table
from tabsmith.plans.spec import RunSpec
from tabsmith.plans.training import run_workbench, train_models
from tabsmith.plans.tuning import RandomSearch
from tabsmith.queries.base import Catalog, load, r, rounded, scratch
from tabsmith.sources.tables import append_runs, load_table, read_runs, write_rows
from tabsmith.streaming.scoring import file_stream, score_stream

CATALOG = Catalog()
query = CATALOG.query

STATUS = ["o_totalprice", "o_custkey", "o_orderpriority"]
SUPPLIER = ["s_suppkey", "s_nationkey"]


def status_spec(models: list[str], **options) -> RunSpec:
    return RunSpec(STATUS, "o_orderstatus", key="o_orderkey", models=models, scaling_strategy="StandardScaler", **options)


def _status(spark, sf_dir, models, **options):
    return run_workbench(load(spark, sf_dir, "orders"), status_spec(models, **options))


def _supplier(spark, sf_dir, task: str, models: list[str], **options):
    """Tree, kernel and neighbour models with the registry's own parameters, on all suppliers."""
    df = load(spark, sf_dir, "supplier").withColumn("in_debt", (F.col("s_acctbal") < 4000).cast("int"))
    target = "in_debt" if task == "Classification" else "s_acctbal"
    return run_workbench(df, RunSpec(SUPPLIER, target, task, key="s_suppkey", models=models, **options))


def _held_out_sql(table: str, key: str, label: str, seed: int = 42) -> str:
    """(k, l) of the held-out rows of a stratified split at four fifths."""
    return f"""
    WITH b AS (SELECT {key} AS k, {label} AS l FROM {table}), c AS (SELECT l, count(*) AS n FROM b GROUP BY 1),
    t AS (SELECT sum(n) AS rows, floor(sum(n) * 8 / 10) AS want FROM c),
    q AS (SELECT l, floor(n * want / rows) + CASE WHEN row_number() OVER (ORDER BY n * want / rows - floor(n * want / rows) DESC, l)
                 <= want - sum(floor(n * want / rows)) OVER () THEN 1 ELSE 0 END AS keep FROM c, t),
    h AS (SELECT k, l, row_number() OVER (PARTITION BY l ORDER BY md5(concat('{seed}|', k))) AS p FROM b)
    SELECT k, h.l FROM h JOIN q USING (l) WHERE p > keep"""


def _plain_held_out_sql(table: str, key: str, label: str, seed: int = 42) -> str:
    return (f"SELECT k, l FROM (SELECT {key} AS k, {label} AS l, row_number() OVER (ORDER BY md5(concat('{seed}|', {key}))) AS p, "
            f"count(*) OVER () AS n FROM {table}) x WHERE p > floor(n * 8 / 10)")


DEBT = "(s_acctbal < 4000)::INT"


def _known(predictions, key: str, labels) -> DataFrame:
    """What is determined of class predictions: rows, actual values, classes and probabilities that add up to one."""
    shares = [c for c in predictions.columns if c.startswith("proba_")]
    total = reduce(add, [col(c) for c in shares]) if shares else F.lit(1.0)
    return predictions.select(col(key).alias("k"), F.col("actual").alias("l"), F.col("prediction").isin(labels).alias("is_class"),
                              (F.abs(total - 1) < 1e-6).alias("adds_up"))


def _register_predictions(task: str, model: str) -> None:
    name = f"predict_{task.lower()}_{model.lower()}"
    if task == "Regression":
        on_parts = model in ("SVM", "GradientBoosting", "ExtraTrees", "RandomForest")
        key, label = ("p_partkey", "p_retailprice") if on_parts else ("s_suppkey", "s_acctbal")
        sql = _plain_held_out_sql("part" if on_parts else "supplier", key, label)

        @query(name, f"SELECT k, l, true AS is_number FROM ({sql}) h")
        def regress(spark, sf_dir):
            if on_parts:
                spec = RunSpec(["p_size", "p_brand"], label, task, key=key, models=[model], scaling_strategy="StandardScaler")
                p = run_workbench(load(spark, sf_dir, "part"), spec).runs[model].predictions
            else:
                p = _supplier(spark, sf_dir, task, [model]).runs[model].predictions
            number = F.col("prediction").isNotNull() & ~F.isnan("prediction")
            return p.select(F.col(key).alias("k"), F.col("actual").alias("l"), number.alias("is_number"))

        return
    orders = model in ("LogisticRegression", "GradientBoosting")
    sql = _held_out_sql("orders", "o_orderkey", "o_orderstatus") if orders else _held_out_sql("supplier", "s_suppkey", DEBT)

    @query(name, f"SELECT k, l, true AS is_class, true AS adds_up FROM ({sql}) h")
    def classify(spark, sf_dir):
        if orders:
            return _known(_status(spark, sf_dir, [model]).runs[model].predictions, "o_orderkey", ["F", "O", "P"])
        return _known(_supplier(spark, sf_dir, task, [model]).runs[model].predictions, "s_suppkey", [0, 1])


for _model in ("LogisticRegression", "RandomForest", "ExtraTrees", "SVM", "GradientBoosting"):
    _register_predictions("Classification", _model)
for _model in ("RandomForest", "ExtraTrees", "SVM", "GradientBoosting"):
    _register_predictions("Regression", _model)


@query("extra_trees_status",
       f"SELECT k, l, true AS is_class, true AS adds_up FROM ({_held_out_sql('orders', 'o_orderkey', 'o_orderstatus')}) h")
def extra_trees_status(spark, sf_dir):
    """All orders, ten levels deep: a tree without a depth has about a node per order."""
    summary = _status(spark, sf_dir, ["ExtraTrees"], model_params={"ExtraTrees": {"max_depth": 10}})
    return _known(summary.runs["ExtraTrees"].predictions, "o_orderkey", ["F", "O", "P"])


@query("forest_status",
       f"SELECT k, l, true AS is_class, true AS adds_up FROM ({_held_out_sql('orders', 'o_orderkey', 'o_orderstatus')}) h")
def forest_status(spark, sf_dir):
    """All orders, ten levels deep, each bag balanced on its own."""
    summary = _status(spark, sf_dir, ["RandomForest"], model_params={"RandomForest": {"max_depth": 10}})
    return _known(summary.runs["RandomForest"].predictions, "o_orderkey", ["F", "O", "P"])


def _board_rows(summary, task: str) -> DataFrame:
    """Each model's place, and whether its board values equal those recomputed from its predictions."""
    board = summary.leaderboard.collect()
    rows = []
    for place, r_ in enumerate(board, 1):
        predictions = summary.runs[r_["Model"]].predictions
        if task == "Regression":
            error = (F.col("actual") - F.col("prediction")).cast("double")
            got = predictions.agg(F.avg(error * error), F.avg(F.abs(error)), F.var_pop("actual")).first()
            again, shown = [got[0], got[1], 1 - got[0] / got[2]], [r_["MSE"], r_["MAE"], r_["R2"]]
        else:
            got = predictions.agg(F.avg((F.col("actual") == F.col("prediction")).cast("double"))).first()
            again, shown = [got[0]], [r_["Accuracy"]]
        rows.append((r_["Model"], all(abs(a - b) <= 1e-9 * max(1, abs(a)) for a, b in zip(again, shown)), r_["R2" if task == "Regression" else "F1-Score"], place))
    best_first = [x[2] for x in rows] == sorted((x[2] for x in rows), reverse=True)
    spark = SparkSession.active()
    return spark.createDataFrame([(m, ok, best_first) for m, ok, *_ in rows], "model string, recomputed boolean, best_first boolean")


def _board_sql(models: list[str]) -> str:
    return f"SELECT unnest({models}) AS model, true AS recomputed, true AS best_first"


@query("leaderboard_status", _board_sql(["LogisticRegression"]))
def leaderboard_status(spark, sf_dir):
    return _board_rows(_status(spark, sf_dir, ["LogisticRegression"]), "Classification")


@query("leaderboard_debt", _board_sql(["GradientBoosting", "KNN", "LogisticRegression"]))
def leaderboard_debt(spark, sf_dir):
    return _board_rows(_supplier(spark, sf_dir, "Classification", ["LogisticRegression", "GradientBoosting", "KNN"]), "Classification")


PRICE = ["p_partkey", "p_size", "p_brand", "p_type"]


def _price(spark, sf_dir, models, **options):
    spec = RunSpec(PRICE, "p_retailprice", "Regression", key="p_partkey", models=models, scaling_strategy="StandardScaler",
                   encoding_strategy="FrequencyEncoding", **options)
    return run_workbench(load(spark, sf_dir, "part"), spec)


@query("leaderboard_price", _board_sql(["GradientBoosting", "KNN", "SVM"]))
def leaderboard_price(spark, sf_dir):
    return _board_rows(_price(spark, sf_dir, ["KNN", "SVM", "GradientBoosting"]), "Regression")


@query("predict_clusters_customer", "SELECT c_custkey AS k, true AS is_cluster FROM customer")
def predict_clusters_customer(spark, sf_dir):
    """Every customer is in one of the four clusters, and none of these is empty."""
    spec = RunSpec(["c_acctbal", "c_nationkey", "c_mktsegment"], None, "Clustering", key="c_custkey", models=["KMeans"],
                   scaling_strategy="MinMaxScaler", n_clusters=4)
    p = run_workbench(load(spark, sf_dir, "customer"), spec).runs["KMeans"].predictions
    whole = p.select("cluster").distinct().count() == 4
    return p.select(F.col("c_custkey").alias("k"), (F.col("cluster").between(0, 3) & F.lit(whole)).alias("is_cluster"))


@query("held_out_rows", f"SELECT l AS actual, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS all_rows FROM ({_held_out_sql('orders', 'o_orderkey', 'o_orderstatus')}) h GROUP BY 1")
def held_out_rows(spark, sf_dir):
    """Every held-out row is predicted once: the actual classes among the predictions."""
    p = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].predictions
    n = p.count()
    return p.groupBy("actual").agg(F.count("*").alias("n")).withColumn("all_rows", F.lit(n).cast("bigint"))


_FOLDS_SQL = """
    SELECT o_orderkey AS k, o_orderstatus AS l, true AS is_class, true AS adds_up,
           (CASE WHEN p <= 1 * (n // 3) + least(1, n % 3) THEN 0 WHEN p <= 2 * (n // 3) + least(2, n % 3) THEN 1 ELSE 2 END)::INT AS fold
    FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat('42|', o_orderkey))) AS p,
                 count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders) x"""


@query("out_of_fold_rows", _FOLDS_SQL)
def out_of_fold_rows(spark, sf_dir):
    """Cross-validation predicts every row exactly once, in the fold that holds it out."""
    run = _status(spark, sf_dir, ["LogisticRegression"], evaluation_mode="Cross Validation", cv_folds=3)
    p = run.runs["LogisticRegression"].predictions
    folds = p.select(F.col("o_orderkey").alias("k"), "fold")
    return _known(p, "o_orderkey", ["F", "O", "P"]).join(folds, "k")


@query("out_of_fold_predictions_price", "SELECT p_partkey AS k, p_retailprice AS l, true AS is_number FROM part")
def out_of_fold_predictions_price(spark, sf_dir):
    p = _price(spark, sf_dir, ["KNN"], evaluation_mode="Cross Validation", cv_folds=3).runs["KNN"].predictions
    return p.select(F.col("p_partkey").alias("k"), F.col("actual").alias("l"), (F.col("prediction").isNotNull() & ~F.isnan("prediction")).alias("is_number"))


@query("tuned_logistic", "SELECT 5::BIGINT AS draws, true AS best_wins, true AS all_scored, count(*)::BIGINT AS rows FROM orders")
def tuned_logistic(spark, sf_dir):
    """The whole space of five values: the winner is the draw with the best mean score."""
    search = RandomSearch()
    orders = load(spark, sf_dir, "orders")
    spec = status_spec(["LogisticRegression"], tuning=True, tuning_iterations=5)
    run = run_workbench(orders, spec, optimizer=search).runs["LogisticRegression"]
    used = run.metadata["preprocessing"]["model_params"]
    best = max(search.trials, key=lambda t: t[1])
    scored = all(0 < s <= 1 for _, s in search.trials)
    return orders.agg(F.lit(len(search.trials)).cast("bigint").alias("draws"), F.lit(used["C"] == best[0]["C"]).alias("best_wins"),
                      F.lit(scored).alias("all_scored"), F.count("*").alias("rows"))


@query("early_stopped_boosting", "SELECT true AS stopped_early, true AS whole_without, count(*)::BIGINT AS rows FROM supplier")
def early_stopped_boosting(spark, sf_dir):
    """With early stopping boosting grows fewer trees than its default hundred; without it all of them."""
    trees = []
    for stop in (True, False):
        run = _supplier(spark, sf_dir, "Regression", ["GradientBoosting"], early_stopping=stop).runs["GradientBoosting"]
        trees.append(run.fitted.pipeline.stages[-1].getNumTrees)
    return load(spark, sf_dir, "supplier").agg(F.lit(trees[0] < trees[1]).alias("stopped_early"), F.lit(trees[1] == 100).alias("whole_without"), F.count("*").alias("rows"))


@query("importance_debt", f"SELECT unnest({SUPPLIER}) AS feature, true AS is_share, true AS adds_up, count(*)::BIGINT AS rows FROM supplier")
def importance_debt(spark, sf_dir):
    """Importances of a boosted model are shares that add up to one."""
    table = _supplier(spark, sf_dir, "Regression", ["GradientBoosting"]).runs["GradientBoosting"].importance.collect()
    rows = load(spark, sf_dir, "supplier").count()
    total = abs(sum(t["importance"] for t in table) - 1) < 1e-6
    return spark.createDataFrame([(t["feature"], 0 <= t["importance"] <= 1, total, rows) for t in table], "feature string, is_share boolean, adds_up boolean, rows bigint")


@query("importance_status", "SELECT count(DISTINCT o_orderpriority) + 2 AS features, true AS not_negative, count(*)::BIGINT AS rows FROM orders")
def importance_status(spark, sf_dir):
    """A linear model's weights: one for every number and every category."""
    orders = load(spark, sf_dir, "orders")
    table = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].importance
    rows = orders.count()
    return table.agg(F.count("*").alias("features"), F.min(F.col("importance") >= 0).alias("not_negative")).withColumn("rows", F.lit(rows))


@query("importance_permutation_price", "SELECT unnest(['p_size', 'price']) AS feature, unnest([2, 1])::INT AS place, unnest([false, true]) AS matters, count(*)::BIGINT AS rows FROM part")
def importance_permutation_price(spark, sf_dir):
    """A neighbour model on the target itself: permuting that feature costs the score, the other one nothing."""
    df = load(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice") * 100)
    spec = RunSpec(["p_size", "price"], "p_retailprice", "Regression", key="p_partkey", models=["KNN"], permutation_importance=True)
    table = run_workbench(df, spec).runs["KNN"].permutation.collect()
    rows = df.count()
    return spark.createDataFrame([(t["feature"], i, t["importance"] > 0.1, rows) for i, t in enumerate(table, 1)], "feature string, place int, matters boolean, rows bigint")


_NEAREST_SQL = f"""
    SELECT qid, tid, distance, place FROM (
        SELECT s.s_suppkey AS qid, c.c_custkey AS tid, {r('sqrt(power(s.s_acctbal - c.c_acctbal, 2) + power(100.0 * (s.s_nationkey - c.c_nationkey), 2))')} AS distance,
               (row_number() OVER (PARTITION BY s.s_suppkey ORDER BY power(s.s_acctbal - c.c_acctbal, 2) + power(100.0 * (s.s_nationkey - c.c_nationkey), 2), c.c_custkey))::INT AS place
        FROM supplier s, customer c) t WHERE place <= 7"""


@query("nearest_customers", _NEAREST_SQL)
def nearest_customers(spark, sf_dir):
    """Through cells and blocks of small size, the way of large tables."""
    queries = load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("qid"), F.array(F.col("s_acctbal"), F.col("s_nationkey") * F.lit(100.0)).alias("x"))
    train = load(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("tid"), F.array(F.col("c_acctbal"), F.col("c_nationkey") * F.lit(100.0)).alias("x"))
    return rounded(nearest(queries, train, 7, block_rows=200, query_rows=50, cell_rows=100).select("qid", "tid", "distance", "place"))


_KNN_VOTE = f"""
    WITH t AS (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b, p_retailprice AS y,
                      row_number() OVER (ORDER BY md5(concat('42|', p_partkey))) <= floor(count(*) OVER () * 8 / 10) AS is_train FROM part),
    d AS (SELECT q.p_partkey, c.y, row_number() OVER (PARTITION BY q.p_partkey ORDER BY power(q.a - c.a, 2) + power(q.b - c.b, 2), c.p_partkey) AS k
          FROM t q, t c WHERE NOT q.is_train AND c.is_train)
    SELECT p_partkey, {r('avg(y)', 4)} AS prediction FROM d WHERE k <= 7 GROUP BY 1"""


@query("neighbour_means_price", _KNN_VOTE)
def neighbour_means_price(spark, sf_dir):
    """The neighbour model on unscaled numbers: the mean of the seven nearest training rows."""
    df = load(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice"))
    spec = RunSpec(["p_size", "price"], "p_retailprice", "Regression", key="p_partkey", models=["KNN"])
    return run_workbench(df, spec).runs["KNN"].predictions.select("p_partkey", F.round("prediction", 4).alias("prediction"))


_VOTE_SQL = """
    WITH h AS (%s), d AS (
        SELECT q.s_suppkey AS k, %s AS l, row_number() OVER (PARTITION BY q.s_suppkey
               ORDER BY power(q.s_suppkey - c.s_suppkey, 2) + power(q.s_nationkey - c.s_nationkey, 2), c.s_suppkey) AS place
        FROM supplier q JOIN supplier c ON q.s_suppkey IN (SELECT k FROM h) AND c.s_suppkey NOT IN (SELECT k FROM h))
    SELECT k, (avg(l) > 0.5)::INT AS prediction, round(avg(l), 6) + 0.0 AS share FROM d WHERE place <= 7 GROUP BY 1
""" % (_held_out_sql("supplier", "s_suppkey", DEBT), DEBT.replace("s_acctbal", "c.s_acctbal"))


@query("predict_classification_knn", _VOTE_SQL)
def predict_classification_knn(spark, sf_dir):
    """Votes of the seven nearest training rows, in full."""
    p = _supplier(spark, sf_dir, "Classification", ["KNN"]).runs["KNN"].predictions
    return p.select(F.col("s_suppkey").alias("k"), "prediction", (F.round("proba_1", 6) + F.lit(0.0)).alias("share"))


@query("predict_regression_knn", f"""
    WITH h AS ({_plain_held_out_sql("supplier", "s_suppkey", "s_acctbal")}), d AS (
        SELECT q.s_suppkey AS k, c.s_acctbal AS l, row_number() OVER (PARTITION BY q.s_suppkey
               ORDER BY power(q.s_suppkey - c.s_suppkey, 2) + power(q.s_nationkey - c.s_nationkey, 2), c.s_suppkey) AS place
        FROM supplier q JOIN supplier c ON q.s_suppkey IN (SELECT k FROM h) AND c.s_suppkey NOT IN (SELECT k FROM h))
    SELECT k, round(avg(l), 4) + 0.0 AS prediction FROM d WHERE place <= 7 GROUP BY 1""")
def predict_regression_knn(spark, sf_dir):
    p = _supplier(spark, sf_dir, "Regression", ["KNN"]).runs["KNN"].predictions
    return p.select(F.col("s_suppkey").alias("k"), (F.round("prediction", 4) + F.lit(0.0)).alias("prediction"))


@query("scored_batch_inputs", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def scored_batch_inputs(spark, sf_dir):
    """Scoring keeps every input row and column."""
    fitted = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].fitted
    scored = fitted.score(load(spark, sf_dir, "orders").drop("o_orderstatus"))
    return scored.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")


@query("scored_batch_orders", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, true AS is_class, true AS adds_up, true AS agrees FROM orders")
def scored_batch_orders(spark, sf_dir):
    """Scoring keeps every input row and column, and agrees with the predictions of the held-out rows."""
    orders = load(spark, sf_dir, "orders")
    run = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"]
    scored = run.fitted.score(orders.drop("o_orderstatus"))
    earlier = run.predictions.select("o_orderkey", F.col("prediction").alias("earlier"))
    total = reduce(add, [col(c) for c in scored.columns if c.startswith("proba_")])
    return scored.join(earlier, "o_orderkey", "left").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.col("prediction").isin("F", "O", "P").alias("is_class"),
        (F.abs(total - 1) < 1e-6).alias("adds_up"), (F.col("earlier").isNull() | (F.col("earlier") == F.col("prediction"))).alias("agrees"))


@query("saved_model_agrees", "SELECT count(*)::BIGINT AS rows, count(*)::BIGINT AS equal_rows FROM orders")
def saved_model_agrees(spark, sf_dir):
    """A saved and loaded model predicts the same on every row."""
    orders = load(spark, sf_dir, "orders")
    fitted = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].fitted
    path = scratch(spark, "model")
    fitted.save(path)
    again = FittedModel.load(path)
    a = fitted.score(orders).select("o_orderkey", F.col("prediction").alias("a"))
    b = again.score(orders).select("o_orderkey", F.col("prediction").alias("b"))
    return a.join(b, "o_orderkey").agg(F.count("*").alias("rows"), F.count_if(F.col("a") == F.col("b")).alias("equal_rows"))


@query("predictions_written", "SELECT o_orderkey, o_orderstatus, o_totalprice, true AS same FROM orders")
def predictions_written(spark, sf_dir):
    """Scored rows written as CSV and read back: every prediction is the same."""
    fitted = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].fitted
    path = scratch(spark, "scored")
    scored = fitted.score(load(spark, sf_dir, "orders"))
    write_rows(scored, path)
    back = load_table(spark, path, "csv")
    again = scored.select("o_orderkey", F.col("prediction").alias("before"))
    return back.join(again, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("prediction") == F.col("before")).alias("same"))


@query("csv_round_trip_documents", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def csv_round_trip_documents(spark, sf_dir):
    """Texts with line breaks, quotes and commas survive CSV."""
    path = scratch(spark, "documents-csv")
    write_rows(load(spark, sf_dir, "documents"), path)
    return load_table(spark, path, "csv")


@query("csv_round_trip_conversations", "SELECT conv_id, turn, role, text FROM conversations")
def csv_round_trip_conversations(spark, sf_dir):
    path = scratch(spark, "conversations-csv")
    write_rows(load(spark, sf_dir, "conversations"), path)
    return load_table(spark, path, "csv")


@query("streamed_scores", "SELECT o_orderkey, true AS agrees FROM orders")
def streamed_scores(spark, sf_dir):
    """The orders as a stream of files: every row is scored once, as a batch would score it."""
    orders = load(spark, sf_dir, "orders")
    fitted = _status(spark, sf_dir, ["LogisticRegression"]).runs["LogisticRegression"].fitted
    source, output = scratch(spark, "incoming"), scratch(spark, "outgoing")
    orders.repartition(4).write.parquet(source)
    job = score_stream(fitted, file_stream(spark, source, orders.schema), output, scratch(spark, "progress"))
    job.awaitTermination()
    batch = fitted.score(orders).select("o_orderkey", F.col("prediction").alias("batch"))
    return spark.read.parquet(output).join(batch, "o_orderkey").select("o_orderkey", F.col("prediction").eqNullSafe(F.col("batch")).alias("agrees"))


@query("run_history", "SELECT 1 AS schema_version, 'LogisticRegression' AS model_name, 'Classification' AS task, true AS same_metrics, true AS same_table, count(*)::BIGINT AS rows FROM orders")
def run_history(spark, sf_dir):
    """A run written to the history and read again."""
    orders = load(spark, sf_dir, "orders")
    spec = status_spec(["LogisticRegression"])
    text = fingerprint_text(orders)
    summary = train_models(prepare(orders, spec.cleaning()), spec, fingerprint=text)
    path = scratch(spark, "runs")
    append_runs(spark, [run.metadata for run in summary.runs.values()], path)
    accuracy = summary.leaderboard.first()["Accuracy"]
    return read_runs(spark, path).select(
        "schema_version", "model_name", "task", (F.abs(F.col("metrics")["Accuracy"] - accuracy) < 1e-9).alias("same_metrics"),
        (F.col("dataset_fingerprint") == text).alias("same_table"), F.lit(orders.count()).alias("rows"))


@query("run_metadata_clusters", "SELECT 'KMeans' AS model_name, 'Clustering' AS task, true AS in_range, 2::BIGINT AS n_importances, count(*)::BIGINT AS rows FROM supplier")
def run_metadata_clusters(spark, sf_dir):
    suppliers = load(spark, sf_dir, "supplier")
    spec = RunSpec(["s_acctbal", "s_nationkey"], None, "Clustering", key="s_suppkey", models=["KMeans"], exact_silhouette=True)
    run = run_workbench(suppliers, spec).runs["KMeans"]
    size = builtin_importance(run.fitted, run.fitted.pipeline.transform(suppliers)).count()
    scores = [F.col("metrics")[m].between(-1, 1) for m in ("Squared Silhouette", "Silhouette Score")]
    return metadata_table(spark, [run.metadata]).select(
        "model_name", "task", (scores[0] & scores[1]).alias("in_range"), F.lit(size).cast("bigint").alias("n_importances"), F.lit(suppliers.count()).alias("rows"))
