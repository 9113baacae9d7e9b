from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.operators import metrics, silhouette
from tabsmith.operators.neighbours import nearest
from tabsmith.plans.training import evaluate


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])


def _brute_ap(y, s):
    total, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        hit = s >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total, last = total + (recall - last) * precision, recall
    return total


def test_binary_without_probabilities(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (0, 0), (1, 0)], "actual bigint, prediction bigint")
    got = evaluate(df, "Classification")
    assert got["Accuracy"] == 0.75 and got["ROC-AUC"] is None and got["PR-AUC"] is None
    assert got["Precision"] == pytest.approx((2 / 3 + 1) / 2) and got["F1-Score"] == pytest.approx((0.8 + 2 / 3) / 2)


def test_multiclass_with_probabilities(spark):
    rows = [(0, 0, [0.8, 0.1, 0.1]), (1, 1, [0.1, 0.7, 0.2]), (2, 1, [0.2, 0.5, 0.3]), (1, 1, [0.1, 0.8, 0.1]),
            (0, 0, [0.7, 0.2, 0.1]), (2, 2, [0.1, 0.2, 0.7])]
    df = spark.createDataFrame(rows, "actual bigint, prediction bigint, p array<double>")
    got = metrics.classification_metrics(df, scores={k: F.get("p", F.lit(k)) for k in range(3)}).first()
    assert got["roc_auc"] == 1.0 and got["pr_auc"] == 1.0 and got["accuracy"] == pytest.approx(5 / 6)


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 4])
@pytest.mark.parametrize("labels", [(0, 1), (1, 2), ("no", "yes")])
def test_areas_with_ties_use_the_greater_class(spark, labels, rows_per_bucket):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 200)
    s = np.round(0.3 * y + rng.random(200), 1)
    df = spark.createDataFrame([(labels[int(a)], float(b)) for a, b in zip(y, s)], ["actual", "s"])
    scores = {labels[0]: 1 - col("s"), labels[1]: col("s")}
    got = metrics.area_metrics(df, "actual", scores, rows_per_bucket=rows_per_bucket).first()
    assert got["roc_auc"] == pytest.approx(_brute_auc(y, s)) and got["pr_auc"] == pytest.approx(_brute_ap(y, s))


def test_area_is_null_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "actual int, s double")
    got = metrics.area_metrics(df, "actual", {0: 1 - col("s"), 1: col("s")}).first()
    assert got["roc_auc"] is None


def test_confusion_matrix_lists_all_labels(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "c"), ("b", "a")], "actual string, prediction string")
    got = {(r["actual"], r["predicted"]): r["n"] for r in metrics.confusion_matrix(df).collect()}
    assert len(got) == 9 and got["a", "c"] == 1 and got["c", "c"] == 0


def test_report_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, prediction string")
    got = {r["label"]: r for r in metrics.classification_report(df).collect()}
    assert got["c"]["precision"] == 0.0 and got["c"]["recall"] == 0.0 and got["c"]["support"] == 1
    assert got["accuracy"]["support"] == 4 and got["accuracy"]["precision"] == 0.5
    assert got["macro avg"]["recall"] == pytest.approx(0.5) and got["weighted avg"]["precision"] == pytest.approx((2 + 1 / 3) / 4)


@pytest.mark.parametrize("rows,r2", [([(1.0, 1.0), (1.0, 1.0)], 1.0), ([(1.0, 2.0), (1.0, 1.0)], 0.0), ([(1.0, 1.5), (3.0, 2.0)], 0.375)])
def test_r2(spark, rows, r2):
    df = spark.createDataFrame(rows, "actual double, prediction double")
    assert metrics.regression_metrics(df).first()["r2"] == pytest.approx(r2)


def test_percentage_error_of_zero_is_huge_but_finite(spark):
    df = spark.createDataFrame([(0.0, 1.0)], "actual double, prediction double")
    assert metrics.regression_metrics(df).first()["mape"] == pytest.approx(1 / 2.220446049250313e-16)


def test_unknown_task():
    with pytest.raises(ValueError, match="no metrics for the task"):
        metrics.named_metrics([], "Ranking")
    with pytest.raises(ValueError, match="no metrics for the task"):
        evaluate(None, "Ranking")


def test_leaderboard_puts_missing_last(spark):
    df = spark.createDataFrame([("x", float("nan"), 1.0), ("y", 0.2, 2.0), ("z", 0.9, 3.0), ("a", 0.2, 2.0)], "Model string, R2 double, MAE double")
    assert [r["Model"] for r in metrics.leaderboard(df, "Regression").collect()] == ["z", "a", "y", "x"]


def _points(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} bigint, x array<double>")


@pytest.mark.parametrize("limits", [{}, {"block_rows": 40, "query_rows": 15, "cell_rows": 30}])
def test_nearest_is_exact_with_ties_and_a_dense_spot(spark, limits):
    rng = np.random.default_rng(9)
    train, asked = rng.normal(size=(400, 3)), rng.normal(size=(60, 3))
    train[:150] = train[0]
    found = {}
    for r in nearest(_points(spark, asked, "qid"), _points(spark, train, "tid"), 5, **limits).collect():
        found.setdefault(r["qid"], {})[r["place"]] = r["tid"]
    for i in range(60):
        d = ((asked[i] - train) ** 2).sum(axis=1)
        assert [found[i][p] for p in range(1, 6)] == list(np.lexsort((np.arange(400), d))[:5])


def test_nearest_with_fewer_rows_than_k(spark):
    got = nearest(_points(spark, [[0.0]], "qid"), _points(spark, [[1.0], [2.0]], "tid"), 5).collect()
    assert sorted(r["tid"] for r in got) == [0, 1]


def test_search_of_a_block_measures_near_leaves_only(monkeypatch):
    from tabsmith.operators import neighbours

    rng = np.random.default_rng(3)
    points, asked = rng.normal(size=(3000, 2)), rng.normal(size=(900, 2))
    points[:500] = points[0]
    asked[:3] = points[0], [50.0, 50.0], points[1000]
    ids = rng.permutation(3000)
    measured, plain = [], neighbours.squared_distances
    monkeypatch.setattr(neighbours, "squared_distances", lambda a, b: measured.append(len(a) * len(b)) or plain(a, b))
    row, at, d = neighbours.near_rows(asked, points, ids, 6)
    assert sum(measured) < 3000 * 900 / 4, "most leaves are skipped"
    every = plain(asked, points)
    want = np.array([np.lexsort((ids, every[i]))[:6] for i in range(900)])
    assert (row == np.repeat(np.arange(900), 6)).all() and (at.reshape(900, 6) == want).all()
    assert (d.reshape(900, 6) == np.take_along_axis(every, want, axis=1)).all()


def test_small_blocks_are_searched_by_tasks_of_their_own(spark):
    rng = np.random.default_rng(4)
    train, asked = rng.normal(size=(3000, 2)).tolist(), rng.normal(size=(600, 2)).tolist()
    found = nearest(_points(spark, asked, "qid"), _points(spark, train, "tid"), 3, cell_rows=100, block_rows=60)
    assert found.count() == 1800
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan, "a shuffle of few bytes is not merged into few tasks"
    for r in found.filter("place = 3").limit(50).collect():
        d = ((np.array(asked[r["qid"]]) - np.array(train)) ** 2).sum(axis=1)
        assert r["tid"] == np.lexsort((np.arange(3000), d))[2]


def _silhouette(x, c, power):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) ** power
    out = []
    for i in range(len(x)):
        own = (c == c[i]).sum()
        if own == 1:
            out.append(0.0)
            continue
        a = d[i][c == c[i]].sum() / (own - 1)
        b = min(d[i][c == k].mean() for k in set(c) - {c[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouettes_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x, c = rng.normal(size=(90, 3)), rng.integers(0, 3, 90)
    x += c[:, None]
    c[0] = 7
    df = spark.createDataFrame([(i, int(c[i]), [float(v) for v in x[i]]) for i in range(90)], "k bigint, c int, x array<double>")
    assert silhouette.euclidean_silhouette(df, "k", "c", "x", block_rows=25).first()[0] == pytest.approx(_silhouette(x, c, 1))
    assert silhouette.squared_silhouette(df, "c", "x").first()[0] == pytest.approx(_silhouette(x, c, 2))


def test_silhouette_of_one_cluster_is_null(spark):
    df = spark.createDataFrame([(1, 0, [1.0]), (2, 0, [2.0])], "k bigint, c int, x array<double>")
    assert silhouette.euclidean_silhouette(df, "k", "c", "x").first()[0] is None
    assert silhouette.squared_silhouette(df, "c", "x").first()[0] is None
    apart = spark.createDataFrame([(1, 0, [1.0]), (2, 1, [2.0])], "k bigint, c int, x array<double>")
    assert silhouette.euclidean_silhouette(apart, "k", "c", "x").first()[0] is None


def test_distances_by_a_product_keep_their_digits(monkeypatch):
    from tabsmith.operators import silhouette

    draw = np.random.default_rng(4)
    a, b = draw.normal(size=(90, 16)), draw.normal(size=(200, 16))
    b[:5] = a[:5]
    b[5:9] = a[5:9] + 1e-9
    plain = silhouette.squared_distances
    assert np.allclose(silhouette.distances(a + 3e5, b + 3e5), np.sqrt(plain(a + 3e5, b + 3e5)), rtol=1e-9, atol=0), "far from zero"
    monkeypatch.setattr(silhouette, "squared_distances", None)
    assert np.allclose(silhouette.distances(a, b), np.sqrt(plain(a, b)), rtol=1e-9, atol=0)


def test_exact_silhouette_measures_a_pair_once_and_copies_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(700, 5)) + 1e-12, rng.integers(0, 4, 700)
    x[:300] = x[:300].astype(np.float32)  # kept as they are beside others that need 64 bits
    df = spark.createDataFrame([(i if i % 9 else None, int(c[i]), [float(v) for v in x[i]]) for i in range(700)], "k bigint, c int, x array<double>")
    keyed = df.selectExpr("row_number() OVER (ORDER BY k NULLS FIRST, x[0]) AS k", "c", "x")
    found = silhouette.euclidean_silhouette(keyed, "k", "c", "x", block_rows=150)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "CartesianProduct" in plan, "a copy of the rows for every block goes to disk"
    assert found.first()[0] == pytest.approx(_silhouette(x, c, 1), rel=1e-12)

    def once(n):
        return (np.arange(n)[:, None] % 3 == np.arange(3)).astype(float)

    pairs, plain = [], silhouette.distances
    monkeypatch.setattr(silhouette, "TILE", 64)
    monkeypatch.setattr(silhouette, "distances", lambda a, b: pairs.append(len(a) * len(b)) or plain(a, b))
    a, b = x[:256], x[256:]
    for one, two in ((a, b), (a, a)):
        got = silhouette.distance_sums(one, once(len(one)), two, once(len(two)))
        whole = np.sqrt(silhouette.squared_distances(one, two))
        assert np.allclose(got[0], whole @ once(len(two))) and np.allclose(got[1], whole.T @ once(len(one)))
    assert sum(pairs) == 256 * 444 + 64 * 64 * 10, "a block and itself: ten of sixteen pairs of tiles"
