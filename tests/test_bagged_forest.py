"""Forests of balanced bags against a plain form that takes one node at a time, and their behaviour."""

from __future__ import annotations

import numpy as np
import pytest

from tabsmith.plans import bagged_forest
from tabsmith.plans.bagged_forest import BaggedForest, Rules, bag_counts
from tabsmith.plans.random_trees import RandomTreesModel
from tests.test_random_trees import frame, points, predictions


def row_keys(spark, n):
    from pyspark.sql import functions as F

    got = spark.range(n).select("id", F.xxhash64("id").alias("h")).collect()
    return np.array([r["h"] for r in sorted(got, key=lambda r: r["id"])], np.int64)


def plain_tree(x, y, w, times, classes, depth, least_rows=2):
    """{rows of a leaf: value} of a tree that tries every cut between values of every feature."""
    leaves, opened = [], [(np.flatnonzero(times), 0)]
    weight = w * times
    if classes == "balanced":
        counts = np.array([times[y == k].sum() for k in range(3)])
        weight = times * np.where(counts > 0, times.sum() / ((counts > 0).sum() * np.maximum(counts, 1)), 0)[y]

    def score(rows):
        total = weight[rows].sum()
        if classes:
            return sum(weight[rows][y[rows] == k].sum() ** 2 for k in range(3)) / total
        return (weight[rows] * y[rows]).sum() ** 2 / total

    while opened:
        rows, level = opened.pop()
        best = None
        if len(rows) >= least_rows and len(set(y[rows])) > 1 and level < depth:
            for j in range(x.shape[1]):
                for cut in sorted(set(x[rows, j]))[:-1]:
                    left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    gain = score(left) + score(right)
                    if best is None or gain > best[0] + 1e-9:
                        best = gain, left, right
        if best is None:
            leaves.append(rows)
        else:
            opened += [(best[1], level + 1), (best[2], level + 1)]
    return leaves, weight


def few_values(n=120):
    x, y, w = points(n)
    return np.round(np.column_stack([x[:, 0] * 4, x[:, 1], x[:, 2], x[:, 3] * 3])), y, w


@pytest.mark.parametrize("balanced,depth,local", [(False, 4, 0), (True, 3, 2000), (True, 30, 30), (True, 30, 0)])
def test_one_tree_of_classes_equals_a_plain_form(spark, monkeypatch, balanced, depth, local):
    monkeypatch.setattr(bagged_forest, "LOCAL_ROWS", local)
    x, y, w = few_values()
    model = BaggedForest(3, 1, depth, 2, "all", 7, balanced).fit(frame(spark, x, y, w))
    leaves, weight = plain_tree(x, y, w, bag_counts(row_keys(spark, len(x)), 7, 0), "balanced" if balanced else "given", depth)
    got = predictions(model, frame(spark, x, y, w))
    for rows in leaves:
        share = np.array([weight[rows][y[rows] == k].sum() for k in range(3)]) / weight[rows].sum()
        assert all(np.allclose(got[i]["_probability"].toArray(), share, atol=1e-6) for i in rows)


@pytest.mark.parametrize("local", [0, 40, 2000])
def test_one_tree_of_numbers_equals_a_plain_form(spark, monkeypatch, local):
    monkeypatch.setattr(bagged_forest, "LOCAL_ROWS", local)
    x, _, w = few_values()
    y = np.round(1000 + 50 * x[:, 0] - 20 * x[:, 1] ** 2 + 3 * x[:, 3], 2)
    model = BaggedForest(None, 1, 3, 2, "all", 5).fit(frame(spark, x, y, w))
    leaves, weight = plain_tree(x, y, w, bag_counts(row_keys(spark, len(x)), 5, 0), None, 3)
    got = np.array([r["_prediction"] for r in predictions(model, frame(spark, x, y, w))])
    for rows in leaves:
        assert np.allclose(got[rows], (weight[rows] * y[rows]).sum() / weight[rows].sum(), atol=1e-2)


def test_bags_are_poisson_and_independent(spark):
    keys = row_keys(spark, 20_000)
    first, second = bag_counts(keys, 42, 0), bag_counts(keys, 42, 1)
    assert abs(first.mean() - 1) < 0.03 and abs(first.var() - 1) < 0.05 and abs((first == 0).mean() - np.exp(-1)) < 0.02
    assert abs(np.corrcoef(first, second)[0, 1]) < 0.03


def test_classes_of_every_bag_weigh_the_same(spark):
    draw = np.random.default_rng(0)
    rules = Rules(3, 30, 2, 1, 1, True)
    counts = draw.integers(1, 500, (20, 3)).astype(float)
    counts[4, 1] = 0
    roots = np.column_stack([counts.sum(axis=1), counts])
    weighed = counts * rules.class_weights(roots)
    for row, whole in zip(weighed, counts.sum(axis=1)):
        assert np.allclose(row[row > 0], whole / (row > 0).sum())
    # A class of one row in twenty: roots of balanced bags hold each class to the same share.
    x = draw.normal(size=(400, 2))
    y = (np.arange(400) % 20 == 0).astype(int)
    model = BaggedForest(2, 5, 1, balanced=True).fit(frame(spark, x, y, np.ones(400)))
    assert np.allclose(np.array(model.state["values"])[:5], 0.5)
    plain = BaggedForest(2, 5, 1).fit(frame(spark, x, y, np.ones(400)))
    assert np.all(np.array(plain.state["values"])[:5, 1] < 0.15)


@pytest.mark.parametrize("local", [20, 2000])
def test_forests_do_not_depend_on_partitions_or_groups_and_are_saved(spark, tmp_path, monkeypatch, local):
    monkeypatch.setattr(bagged_forest, "LOCAL_ROWS", local)
    x, y, w = points()
    whole = BaggedForest(3, 6, 5).fit(frame(spark, x, y, w, 1))
    monkeypatch.setattr(bagged_forest, "BLOCK_ROWS", 40)
    assert BaggedForest(3, 6, 5).fit(frame(spark, x, y, w, 6)).state == whole.state
    whole.write().overwrite().save(str(tmp_path / "forest"))
    again = RandomTreesModel.read().load(str(tmp_path / "forest"))
    df = frame(spark, x, y, w)
    assert [r["_probability"] for r in predictions(whole, df)] == [r["_probability"] for r in predictions(again, df)]
    assert abs(again.importances().sum() - 1) < 1e-9 and again.importances()[2] == 0
    monkeypatch.setattr(bagged_forest, "CELLS", 700)
    assert BaggedForest(3, 6, 5).fit(frame(spark, x, y, w, 3)).state == whole.state


@pytest.mark.parametrize("balanced", [True, False])
@pytest.mark.parametrize("classes", [3, None])
def test_bags_added_up_by_vector_equal_a_plain_form(spark, monkeypatch, classes, balanced):
    x, y, w = points(1200)
    x = np.round(np.column_stack([x[:, 0], x[:, 1], x[:, 2], np.zeros(1200), x[:, 4] / 40]))
    y = y if classes else np.round(50 * x[:, 0] - 20 * x[:, 1] ** 2 + y, 2)
    monkeypatch.setattr(BaggedForest, "_histograms", lambda *a: pytest.fail("rows are read once, not once a level"))
    df = frame(spark, x, y, w, 5)
    model = BaggedForest(classes, 1, 5, 2, "all", 7, balanced).fit(df)
    kind = classes and ("balanced" if balanced else "given")
    leaves, weight = plain_tree(x, y, w, bag_counts(row_keys(spark, len(x)), 7, 0), kind, 5)
    got = predictions(model, df)
    assert len(leaves) > 10
    for rows in leaves:
        total = weight[rows].sum()
        if classes:
            share = np.array([weight[rows][y[rows] == k].sum() for k in range(3)]) / total
            assert all(np.allclose(got[i]["_probability"].toArray(), share, atol=1e-6) for i in rows)
        else:
            assert np.allclose([got[i]["_prediction"] for i in rows], (weight[rows] * y[rows]).sum() / total, atol=1e-2)
    assert BaggedForest(classes, 4, 5).fit(df).state == BaggedForest(classes, 4, 5).fit(df.repartition(2)).state


def test_a_feature_is_found_among_constant_ones(spark):
    x = np.column_stack([np.ones(80)] * 8 + [np.arange(80)])
    y = (np.arange(80) >= 40).astype(int)
    model = BaggedForest(2, 12, 1).fit(frame(spark, x, y, np.ones(80)))
    assert set(model.state["feature"][:12]) == {8}, "drawn features that do not vary give way to the next ones"


def test_rare_values_are_cut_off_and_many_classes_fit(spark):
    x = np.concatenate([np.zeros(2), np.ones(298)])[:, None]
    model = BaggedForest(2, 30, 1).fit(frame(spark, x, (x[:, 0] == 0).astype(int), np.ones(300)))
    chances = [r["_probability"][1] for r in predictions(model, frame(spark, np.array([[0.0], [1.0]]), [0, 0], [1, 1]))]
    assert chances[0] > 0.6 and chances[1] == 0
    x = np.repeat(np.arange(20), 15)[:, None].astype(float)
    model = BaggedForest(20, 10).fit(frame(spark, x, x[:, 0].astype(int), np.ones(300)))
    assert all(r["_prediction"] == r["_label"] for r in predictions(model, frame(spark, x, x[:, 0], np.ones(300))))


def test_tables_without_a_split(spark):
    same = BaggedForest(2, 3).fit(frame(spark, np.ones((6, 2)), np.array([0, 1] * 3), np.ones(6)))
    assert len(same.state["feature"]) == 3
    one = BaggedForest(2, 9).fit(frame(spark, np.ones((1, 2)), np.ones(1), np.ones(1)))
    assert [list(v) for v in one.state["values"]] == [[0.0, 1.0]] * 9, "empty bags answer with the mean of the others"
    number = BaggedForest(None, 4).fit(frame(spark, np.arange(6.0)[:, None], np.full(6, 3.5), np.ones(6)))
    assert len(number.state["feature"]) == 4 and set(v[0] for v in number.state["values"]) == {3.5}
