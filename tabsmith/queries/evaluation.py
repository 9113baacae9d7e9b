"""Metrics of made-up predictions: each is a function of the row, so both engines can state it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators import charts, metrics, silhouette
from tabsmith.queries.base import Catalog, load, r, rounded, union

CATALOG = Catalog()
query = CATALOG.query

# A three-class problem over lineitem and a two-class problem over orders. The scores have many ties.
THREE = {
    "actual": "l_returnflag",
    "prediction": "case when (l_orderkey * 31 + l_linenumber * 7) % 10 < 6 then l_returnflag "
                  "when l_orderkey % 2 = 0 then 'A' else 'N' end",
    "p0": "(case when l_returnflag = 'A' then 40 else 0 end + (l_orderkey * 17 + l_partkey) % 61) / 101.0",
    "p1": "(case when l_returnflag = 'N' then 30 else 0 end + (l_orderkey * 13 + l_suppkey) % 71) / 101.0",
    "p2": "(case when l_returnflag = 'R' then 20 else 0 end + (l_orderkey * 11 + l_partkey) % 81) / 101.0",
}
TWO = {
    "actual": "case when o_custkey % 5 = 0 then 1 else 0 end",
    "prediction": "case when (o_orderkey * 31) % 10 < 7 then case when o_custkey % 5 = 0 then 1 else 0 end else o_orderkey % 2 end",
    "score": "(case when o_custkey % 5 = 0 then 15 else 0 end + (o_orderkey * 17 + o_custkey) % 83) / 97.0",
}
VALUE = {"actual": "l_extendedprice", "prediction": "l_extendedprice * 0.9 + (l_partkey % 100) * 37.5"}
LABELS = ["A", "N", "R"]


def _select(made: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in made.items()) + f" FROM {table}"


def made_up(df, made: dict[str, str]):
    # SQL reads 101.0 as a decimal; both engines must divide doubles.
    exprs = [f"{e.replace('101.0', '101.0D').replace('97.0', '97.0D').replace('0.9', '0.9D').replace('37.5', '37.5D')} as {c}"
             for c, e in made.items()]
    return df.selectExpr(*exprs)


def _frame(spark, sf_dir, made: dict[str, str], table: str):
    return made_up(load(spark, sf_dir, table), made)


def _sql(made: dict[str, str], table: str) -> str:
    doubled = {c: e.replace("101.0", "101.0::DOUBLE").replace("97.0", "97.0::DOUBLE").replace("0.9", "0.9::DOUBLE")
               .replace("37.5", "37.5::DOUBLE") for c, e in made.items()}
    return _select(doubled, table)


THREE_SQL, TWO_SQL, VALUE_SQL = _sql(THREE, "lineitem"), _sql(TWO, "orders"), _sql(VALUE, "lineitem")


def _per_class(source: str) -> str:
    return f"""
    SELECT label, sum(s) AS support, coalesce(sum(h) * 1.0 / nullif(sum(c), 0), 0) AS precision,
           coalesce(sum(h) * 1.0 / nullif(sum(s), 0), 0) AS recall, coalesce(2.0 * sum(h) / nullif(sum(s) + sum(c), 0), 0) AS f1,
           sum(h) AS hits
    FROM (SELECT actual AS label, 1 AS s, 0 AS c, (actual = prediction)::INT AS h FROM ({source}) a
          UNION ALL SELECT prediction, 0, 1, 0 FROM ({source}) b) u GROUP BY label"""


def _weighted_sql(source: str) -> str:
    w = "sum({m} * support) / sum(support)"
    return (f"SELECT {r('sum(hits) * 1.0 / sum(support)')} AS accuracy, "
            + ", ".join(f"{r(w.format(m=m))} AS {m}" for m in ("precision", "recall", "f1"))
            + f" FROM ({_per_class(source)}) p")


@query("label_metrics_flag", _weighted_sql(THREE_SQL))
def label_metrics_flag(spark, sf_dir):
    return rounded(metrics.label_metrics(_frame(spark, sf_dir, THREE, "lineitem")))


@query("label_metrics_binary", _weighted_sql(TWO_SQL))
def label_metrics_binary(spark, sf_dir):
    return rounded(metrics.label_metrics(_frame(spark, sf_dir, TWO, "orders")))


@query("metrics_without_scores", f"SELECT *, NULL::DOUBLE AS roc_auc, NULL::DOUBLE AS pr_auc FROM ({_weighted_sql(TWO_SQL)}) m")
def metrics_without_scores(spark, sf_dir):
    return rounded(metrics.classification_metrics(_frame(spark, sf_dir, TWO, "orders")))


@query("confusion_matrix_flag", f"""
    WITH p AS ({THREE_SQL}), l AS (SELECT actual AS v FROM p UNION SELECT prediction FROM p)
    SELECT a.v AS actual, b.v AS predicted, (SELECT count(*) FROM p WHERE p.actual = a.v AND p.prediction = b.v)::BIGINT AS n
    FROM l a, l b""")
def confusion_matrix_flag(spark, sf_dir):
    return metrics.confusion_matrix(_frame(spark, sf_dir, THREE, "lineitem"))


_REPORT = f"WITH p AS ({_per_class(THREE_SQL)}) " + union([
    f"SELECT label::VARCHAR AS label, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS \"f1-score\", "
    "support::BIGINT AS support FROM p",
    f"SELECT 'accuracy', {r('sum(hits) * 1.0 / sum(support)')}, {r('sum(hits) * 1.0 / sum(support)')}, "
    f"{r('sum(hits) * 1.0 / sum(support)')}, sum(support)::BIGINT FROM p",
    f"SELECT 'macro avg', {r('avg(precision)')}, {r('avg(recall)')}, {r('avg(f1)')}, sum(support)::BIGINT FROM p",
    f"SELECT 'weighted avg', {r('sum(precision * support) / sum(support)')}, {r('sum(recall * support) / sum(support)')}, "
    f"{r('sum(f1 * support) / sum(support)')}, sum(support)::BIGINT FROM p",
])


@query("classification_report_flag", _REPORT)
def classification_report_flag(spark, sf_dir):
    return rounded(metrics.classification_report(_frame(spark, sf_dir, THREE, "lineitem")))


def _ranking_sql(source: str, scores: dict[str, str]) -> str:
    """ROC area by average ranks, average precision by running totals."""
    parts = []
    for label, s in scores.items():
        y = f"(actual::VARCHAR = '{label}')::INT"
        parts.append(f"""
        SELECT '{label}' AS label, max(pt)::BIGINT AS positives, max(nt)::BIGINT AS negatives,
               {r('(sum(pos * avg_rank) - max(pt) * (max(pt) + 1) / 2.0) / (max(pt) * max(nt))')} AS roc_auc,
               {r('sum(pos * cp / (cp + cn)) / max(pt)')} AS average_precision
        FROM (SELECT pos, neg, sum(pos) OVER () * 1.0 AS pt, sum(neg) OVER () * 1.0 AS nt,
                     sum(pos + neg) OVER (ORDER BY s) - (pos + neg) + (pos + neg + 1) / 2.0 AS avg_rank,
                     sum(pos) OVER (ORDER BY s DESC) * 1.0 AS cp, sum(neg) OVER (ORDER BY s DESC) * 1.0 AS cn
              FROM (SELECT {s} AS s, sum({y}) AS pos, sum(1 - {y}) AS neg FROM ({source}) t GROUP BY 1) g) w""")
    return union(parts)


_THREE_SCORES = {"A": "p0", "N": "p1", "R": "p2"}


def _scores():
    return {v: col(f"p{i}") for i, v in enumerate(LABELS)}


@query("ranking_scores_flag", _ranking_sql(THREE_SQL, _THREE_SCORES))
def ranking_scores_flag(spark, sf_dir):
    return rounded(metrics.ranking_scores(_frame(spark, sf_dir, THREE, "lineitem"), "actual", _scores()))


@query("ranking_scores_buckets", _ranking_sql(THREE_SQL, _THREE_SCORES))
def ranking_scores_buckets(spark, sf_dir):
    """The way of many distinct scores, taken at any size: running totals in buckets."""
    table = _frame(spark, sf_dir, THREE, "lineitem")
    return rounded(metrics.ranking_scores(table, "actual", _scores(), rows_per_bucket=20))


@query("classification_metrics_flag", f"""
    SELECT m.*, {r('sum(roc_auc * positives) / sum(positives)', 5)} AS roc_auc,
           {r('sum(average_precision * positives) / sum(positives)', 5)} AS pr_auc
    FROM ({_weighted_sql(THREE_SQL)}) m, ({_ranking_sql(THREE_SQL, _THREE_SCORES)}) k GROUP BY ALL""")
def classification_metrics_flag(spark, sf_dir):
    table = _frame(spark, sf_dir, THREE, "lineitem")
    got = rounded(metrics.classification_metrics(table, scores=_scores()))
    return got.withColumns({"roc_auc": F.round("roc_auc", 5), "pr_auc": F.round("pr_auc", 5)})


@query("area_metrics_binary", f"SELECT roc_auc, average_precision AS pr_auc FROM ({_ranking_sql(TWO_SQL, {'1': 'score'})}) k")
def area_metrics_binary(spark, sf_dir):
    table = _frame(spark, sf_dir, TWO, "orders")
    return rounded(metrics.area_metrics(table, "actual", {0: 1 - col("score"), 1: col("score")}))


@query("regression_metrics_price", f"""
    SELECT {r('avg(power(actual - prediction, 2))', 3)} AS mse, {r('sqrt(avg(power(actual - prediction, 2)))')} AS rmse,
           {r('avg(abs(actual - prediction))')} AS mae,
           {r('1 - avg(power(actual - prediction, 2)) / var_pop(actual)')} AS r2,
           {r('avg(abs(actual - prediction) / greatest(abs(actual), 2.220446049250313e-16))')} AS mape FROM ({VALUE_SQL}) t""")
def regression_metrics_price(spark, sf_dir):
    got = metrics.regression_metrics(_frame(spark, sf_dir, VALUE, "lineitem"))
    return rounded(got.withColumn("mse", F.round("mse", 3)))


@query("actual_vs_predicted_price", f"""
    WITH p AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{e} AS {c}' for c, e in VALUE.items())} FROM lineitem)
    SELECT l_orderkey, l_linenumber, {r('actual')} AS actual, {r('prediction', 4)} AS predicted,
           {r('least((SELECT min(actual) FROM p), (SELECT min(prediction) FROM p))')} AS low,
           {r('greatest((SELECT max(actual) FROM p), (SELECT max(prediction) FROM p))', 4)} AS high FROM p""")
def actual_vs_predicted_price(spark, sf_dir):
    made = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", **VALUE}
    table = charts.actual_vs_predicted(_frame(spark, sf_dir, made, "lineitem"), "actual", "prediction", ["l_orderkey", "l_linenumber"])
    return rounded(table.withColumns({"predicted": F.round("predicted", 4), "high": F.round("high", 4)}))


def _distances_sql(distance: str) -> str:
    return f"""
    WITH e AS (SELECT vec_id, label, embedding::DOUBLE[64] AS x FROM embeddings),
    n AS (SELECT label, count(*) AS k FROM e GROUP BY 1),
    d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum({distance}) AS total
          FROM e a, e b GROUP BY ALL),
    m AS (SELECT vec_id, own, n1.k AS own_size,
                 max(CASE WHEN own = other THEN total / nullif(n1.k - 1, 0) END) AS a,
                 min(CASE WHEN own <> other THEN total / n2.k END) AS b
          FROM d JOIN n n1 ON n1.label = own JOIN n n2 ON n2.label = other GROUP BY ALL)
    SELECT {r('avg(CASE WHEN own_size <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM m"""


def _embeddings(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("silhouette_euclidean", _distances_sql("array_distance(a.x, b.x)"))
def silhouette_euclidean(spark, sf_dir):
    return rounded(silhouette.euclidean_silhouette(_embeddings(spark, sf_dir), "vec_id", "label", "x"))


@query("silhouette_squared", _distances_sql("power(array_distance(a.x, b.x), 2)").replace("AS silhouette", "AS silhouette_sq"))
def silhouette_squared(spark, sf_dir):
    return rounded(silhouette.squared_silhouette(_embeddings(spark, sf_dir), "label", "x"))


_BOARD_SQL = """
    SELECT (row_number() OVER (ORDER BY f1 DESC NULLS LAST, roc DESC NULLS LAST, acc DESC NULLS LAST, model))::INT AS place, model AS "Model"
    FROM (SELECT p_brand AS model, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE round(count(*) / 100.0, 1) END::DOUBLE AS f1,
                 round(avg(p_size) / 50, 3)::DOUBLE AS roc, count(*)::DOUBLE AS acc FROM part GROUP BY 1) t"""


@query("leaderboard_order", _BOARD_SQL)
def leaderboard_order(spark, sf_dir):
    from pyspark.sql import Window

    n = F.count("*")
    f1 = F.when(n % 3 == 0, F.lit(float("nan"))).otherwise(F.round(n / 100.0, 1))
    board = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("Model")).agg(
        f1.alias("F1-Score"), F.round(F.avg("p_size") / 50, 3).alias("ROC-AUC"), n.cast("double").alias("Accuracy")
    )
    ordered = metrics.leaderboard(board, "Classification")
    place = F.row_number().over(Window.orderBy("_id"))
    # One row per model: the order is read off row by row.
    return ordered.coalesce(1).withColumn("_id", F.monotonically_increasing_id()).select(place.alias("place"), "Model")


@query("top_importance_brands",
       f"SELECT p_brand AS feature, {r('avg(p_retailprice)')} AS importance FROM part GROUP BY 1 ORDER BY avg(p_retailprice) DESC, 1 LIMIT 20")
def top_importance_brands(spark, sf_dir):
    table = load(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_retailprice").alias("importance"))
    return rounded(charts.top_importance(table, 20))
