"""Extremely randomised trees against a plain form that takes one node at a time, and their behaviour."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabsmith.plans import random_trees
from tabsmith.plans.random_trees import RandomTrees, RandomTreesModel


def points(n=150, seed=3):
    draw = np.random.default_rng(seed)
    x = np.column_stack([draw.normal(size=n), draw.integers(0, 4, n), np.full(n, 2.0), draw.normal(size=n), draw.random(n) * 100])
    y = (x[:, 0] + 0.3 * draw.normal(size=n) > 0).astype(int) + (x[:, 1] == 3)
    return x, y, draw.choice([1.0, 2.0, 0.5], n)


def frame(spark, x, y, w, parts=3):
    rows = [(i, Vectors.dense(v), float(k), float(a)) for i, (v, k, a) in enumerate(zip(x.tolist(), y, w))]
    return spark.createDataFrame(rows, ["_rid", "_features", "_label", "_weight"]).repartition(parts)


def plain_tree(x, y, w, seed, tree, tries, classes, depth=None, least_rows=2):
    """Row sets of a tree grown one level after another: [(rows, feature or None, threshold)] in the order of their opening."""
    done, level, opened = [], 0, [np.arange(len(x))]

    def impurity(rows):
        weight = w[rows].sum()
        if classes:
            return weight * (1 - sum((w[rows][y[rows] == k].sum() / weight) ** 2 for k in range(classes)))
        mean = (w[rows] * y[rows]).sum() / weight
        return (w[rows] * (y[rows] - mean) ** 2).sum()

    while opened:
        able = [r for r in opened if len(r) >= least_rows and len(set(y[r])) > 1 and (depth is None or level < depth)
                and any(x[r, j].min() < x[r, j].max() for j in range(x.shape[1]))]
        luck = np.random.default_rng([seed, tree, level * 1_000_003])
        order, where = luck.random((len(able), x.shape[1])), luck.random((len(able), min(tries, x.shape[1])))
        place, following = 0, []
        for rows in opened:
            if not any(rows is r for r in able):
                done.append((rows, None, None))
                continue
            varying = [j for j in range(x.shape[1]) if x[rows, j].min() < x[rows, j].max()]
            best = None
            for d, j in enumerate(sorted(varying, key=lambda j: order[place, j])[:tries]):
                low, high = x[rows, j].min(), x[rows, j].max()
                cut = low + where[place, d] * (high - low)
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                gain = impurity(rows) - impurity(left) - impurity(right)
                if best is None or gain > best[0] + 1e-7:
                    best = (gain, j, cut, left, right)
            done.append((rows, best[1], best[2]))
            following += [best[3], best[4]]
            place += 1
        opened, level = following, level + 1
    return done


def predictions(model, df):
    rows = {r["_rid"]: r for r in model.transform(df).collect()}
    return [rows[i] for i in range(len(rows))]


@pytest.mark.parametrize("depth,least_rows", [(None, 2), (3, 2), (None, 20)])
def test_one_tree_of_classes_equals_a_plain_form(spark, depth, least_rows):
    x, y, w = points()
    model = RandomTrees(3, 1, depth, least_rows, "sqrt", seed=11).fit(frame(spark, x, y, w))
    plain = plain_tree(x, y, w, 11, 0, 2, 3, depth, least_rows)
    assert [f for _, f, _ in plain] == [f if f >= 0 else None for f in model.state["feature"]]
    assert np.allclose([c for _, f, c in plain if f is not None], [c for f, c in zip(model.state["feature"], model.state["threshold"]) if f >= 0])
    got = predictions(model, frame(spark, x, y, w))
    for rows, feature, _ in plain:
        if feature is None:
            share = np.array([w[rows][y[rows] == k].sum() for k in range(3)]) / w[rows].sum()
            assert all(np.allclose(got[i]["_probability"].toArray(), share, atol=1e-6) for i in rows)


def test_one_tree_of_numbers_equals_a_plain_form(spark):
    x, _, w = points()
    y = np.round(1000 + 50 * x[:, 0] - 20 * x[:, 1], 2)
    model = RandomTrees(None, 1, 4, 2, "all", seed=5).fit(frame(spark, x, y, w))
    plain = plain_tree(x, y, w, 5, 0, 5, None, 4)
    assert [f for _, f, _ in plain] == [f if f >= 0 else None for f in model.state["feature"]]
    got = np.array([r["_prediction"] for r in predictions(model, frame(spark, x, y, w))])
    for rows, feature, _ in plain:
        if feature is None:
            assert np.allclose(got[rows], (w[rows] * y[rows]).sum() / w[rows].sum(), atol=1e-3)


def test_thresholds_lie_between_the_values_of_their_node(spark):
    x, y, w = points(400)
    model = RandomTrees(3, 40, 1, 2, "sqrt").fit(frame(spark, x, y, w))
    cuts = [c for f, c in zip(model.state["feature"], model.state["threshold"]) if f == 4]
    assert len(set(cuts)) == len(cuts) > 3 and not set(cuts) & set(x[:, 4])
    assert max(cuts) - min(cuts) > 30 and 2 not in model.state["feature"]


def test_trees_do_not_depend_on_partitions_and_are_saved(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(random_trees, "BLOCK_ROWS", 40)
    x, y, w = points()
    models = [RandomTrees(3, 6, 5).fit(frame(spark, x, y, w, parts)) for parts in (1, 6)]
    assert models[0].state == models[1].state
    models[0].write().overwrite().save(str(tmp_path / "trees"))
    again = RandomTreesModel.read().load(str(tmp_path / "trees"))
    df = frame(spark, x, y, w)
    assert [r["_probability"] for r in predictions(models[0], df)] == [r["_probability"] for r in predictions(again, df)]
    assert again.getNumTrees == 6 and abs(again.importances().sum() - 1) < 1e-9


@pytest.mark.parametrize("classes", [3, None])
def test_rows_added_up_by_features_give_the_same_trees(spark, monkeypatch, classes):
    x, y, w = points(900)
    x = np.round(np.column_stack([x[:, 0], x[:, 1], x[:, 2], x[:, 4] / 40]))
    df = frame(spark, x, y if classes else y * 7.3 + x[:, 0], w, 5)
    read = []
    plain = RandomTrees._described
    monkeypatch.setattr(RandomTrees, "_described", lambda self, blocks, *a: read.append(blocks.selectExpr("sum(length(low)) / 8").first()[0]) or plain(self, blocks, *a))
    folded = RandomTrees(classes, 4).fit(df)
    assert read[0] == len(np.unique(x + 0.0, axis=0)) < 200, "levels read vectors, not rows"
    monkeypatch.setattr(random_trees, "FOLD_VECTORS", 0)
    assert RandomTrees(classes, 4).fit(df).state == folded.state
    assert read[-1] == 900 and len(folded.state["feature"]) > 20


def test_groups_of_open_nodes_keep_every_node(spark, monkeypatch):
    x, y, w = points()
    monkeypatch.setattr(random_trees, "CELLS", 200)
    model = RandomTrees(3, 3, None).fit(frame(spark, x, y, w))
    rows = predictions(model, frame(spark, x, y, w))
    assert all(r["_prediction"] == k for r, k in zip(rows, y)), "grown to the end, trees know their own rows"


def test_tables_without_a_split(spark):
    same = RandomTrees(2, 3).fit(frame(spark, np.ones((6, 2)), np.array([0, 1] * 3), np.ones(6)))
    assert all(np.allclose(r["_probability"].toArray(), 0.5) for r in predictions(same, frame(spark, np.ones((6, 2)), np.zeros(6), np.ones(6))))
    x, _, _ = points(20)
    pure = RandomTrees(2, 3).fit(frame(spark, x, np.ones(20), np.ones(20)))
    assert len(pure.state["feature"]) == 3 and all(r["_prediction"] == 1 for r in predictions(pure, frame(spark, x, np.ones(20), np.ones(20))))


def test_noted_places_give_the_same_trees_and_the_last_level_costs_no_pass(spark, monkeypatch):
    x, y, w = points(600)
    passes = []
    plain = RandomTrees._described
    monkeypatch.setattr(RandomTrees, "_described", lambda self, blocks, *a: passes.append("noted" in blocks.columns) or plain(self, blocks, *a))
    shallow = RandomTrees(3, 5, 8).fit(frame(spark, x, y, w)).state
    assert passes == [False] * 8, "nodes at the depth asked for are known from their parents"
    monkeypatch.setattr(random_trees, "KEEP_CELLS", 0)
    assert RandomTrees(3, 5, 8).fit(frame(spark, x, y, w)).state == shallow
    assert passes[8:] == [False] * 3 + [True] * 5


@pytest.mark.parametrize("classes,depth", [(3, None), (3, 6), (None, None)])
def test_small_nodes_are_grown_by_tasks_and_kept_in_a_table(spark, tmp_path, monkeypatch, classes, depth):
    """Grown to the end the driver holds the nodes of more than so many rows and their children, not a node per row and tree."""
    monkeypatch.setattr(random_trees, "NODES", 100)
    monkeypatch.setattr(random_trees, "LOCAL_ROWS", 60)
    monkeypatch.setattr(random_trees, "KEEP_CELLS", 0)
    x, y, w = points(900)
    y = y if classes else np.round(1000 + 50 * x[:, 0] - 20 * x[:, 1])
    models = [RandomTrees(classes, 5, depth).fit(frame(spark, x, y, w, parts)) for parts in (1, 6)]
    assert models[0].state == models[1].state and len(models[0].state["feature"]) < 5 * 150 and models[0].state["aside"]
    table = {r["node"]: r for r in models[0].tables["subtrees"].collect()}
    assert sorted(table) == models[0].state["aside"] and table == {r["node"]: r for r in models[1].tables["subtrees"].collect()}
    models[0].write().overwrite().save(str(tmp_path / "trees"))
    again = RandomTreesModel.read().load(str(tmp_path / "trees"))
    monkeypatch.setattr(random_trees, "SALT_PARTS", 2)
    first, second = (predictions(m, frame(spark, x, y, w, 6)) for m in (models[0], again))
    assert first == second
    got = np.array([r["_prediction"] for r in first])
    assert depth is not None or np.allclose(got, y, atol=1e-3), "grown to the end, trees know their own rows"
    if classes:
        assert all(abs(r["_probability"].toArray().sum() - 1) < 1e-9 for r in first) and np.mean(got == y) > 0.8


def test_a_tree_grown_by_a_task_follows_the_rules_of_the_levels():
    x, y, w = points(300)
    parts = RandomTrees(3)._parts(y, w, 0.0, 1.0)
    sums = np.column_stack([np.ones(300), parts])
    feature, threshold, total, gains = random_trees.grown(x, sums, y, y, 2, np.inf, 2, np.random.default_rng(1))
    left = np.where(feature >= 0, 1 + 2 * (np.cumsum(feature >= 0) - 1), -1)
    leaf = random_trees.Grove(np.zeros(1, int), feature, threshold, left).places(x, 0)
    assert set(leaf) == set(np.flatnonzero(feature < 0)) and 2 not in feature and gains.sum() > 0
    for node in set(leaf):
        assert len(set(y[leaf == node])) == 1 and np.array_equal(total[node], sums[leaf == node].sum(axis=0))
    assert len(random_trees.grown(x, sums, y, y, 2, 2, 2, np.random.default_rng(1))[0]) <= 7
