"""Multinomial boosting against a plain NumPy form, and its behaviour in a run."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tabsmith.plans.boosting import MultinomialBoosting, MultinomialBoostingModel


def points(n=240, classes=3, seed=7):
    draw = np.random.default_rng(seed)
    y = draw.integers(0, classes, n)
    x = np.column_stack([y + draw.normal(size=n), np.round(draw.normal(size=n), 1), (y == 1) + 0.4 * draw.normal(size=n), np.zeros(n)])
    return x, y, draw.choice([1.0, 2.0, 0.5], n)


def frame(spark, x, y, w, parts=3):
    rows = [(i, Vectors.dense(v), float(k), float(a)) for i, (v, k, a) in enumerate(zip(x.tolist(), y, w))]
    return spark.createDataFrame(rows, ["_rid", "_features", "_label", "_weight"]).repartition(parts)


def plain_boosting(x, y, w, edges, classes, rounds, rate, depth):
    """One row, node and threshold at a time."""
    prior = np.log(np.array([w[y == k].sum() for k in range(classes)]) / w.sum())
    scores = np.tile(prior, (len(x), 1))

    def fit(rows, residual, level):
        weight, r = w[rows], residual[rows]
        curve = (weight * np.abs(r) * (1 - np.abs(r))).sum()
        value = rate * (classes - 1) / classes * (weight * r).sum() / curve if curve > 1e-9 else 0.0
        best = None
        if level < depth:
            for j, cuts in enumerate(edges):
                for cut in cuts:
                    left = x[rows, j] <= cut
                    a, b = weight[left].sum(), weight[~left].sum()
                    if a > 0 and b > 0:
                        gain = a * b / (a + b) * ((weight * r)[left].sum() / a - (weight * r)[~left].sum() / b) ** 2
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-7):
                            best = (gain, left)
        if best is None:
            return [(rows, value)]
        return fit(rows[best[1]], residual, level + 1) + fit(rows[~best[1]], residual, level + 1)

    for _ in range(rounds):
        p = np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)
        step = np.zeros_like(scores)
        for k in range(classes):
            for rows, value in fit(np.arange(len(x)), (y == k) - p[:, k], 0):
                step[rows, k] = value
        scores = scores + step
    return np.exp(scores) / np.exp(scores).sum(axis=1, keepdims=True)


def chances(model, df):
    rows = {r["_rid"]: r for r in model.transform(df).select("_rid", "_probability", "_prediction").collect()}
    return np.array([rows[i]["_probability"].toArray() for i in range(len(rows))]), np.array([rows[i]["_prediction"] for i in range(len(rows))])


def test_boosting_equals_a_plain_form(spark):
    x, y, w = points()
    df = frame(spark, x, y, w)
    model = MultinomialBoosting(3, rounds=12, rate=0.3, depth=2).fit(df)
    got, classes = chances(model, df)
    expected = plain_boosting(x, y, w, model.state["edges"], 3, 12, 0.3, 2)
    assert np.abs(got - expected).max() < 1e-5
    assert (classes == got.argmax(axis=1)).all() and model.getNumTrees == 36
    share = model.importances()
    assert abs(share.sum() - 1) < 1e-9 and share[3] == 0 and share[0] > share[1]


def test_boosting_does_not_depend_on_partitions_and_is_saved(spark, tmp_path):
    x, y, w = points(150)
    models = [MultinomialBoosting(3, rounds=3).fit(frame(spark, x, y, w, parts)) for parts in (1, 5)]
    assert models[0].state["rounds"] == models[1].state["rounds"]
    models[0].write().overwrite().save(str(tmp_path / "model"))
    again = MultinomialBoostingModel.read().load(str(tmp_path / "model"))
    df = frame(spark, x, y, w)
    assert np.array_equal(chances(models[0], df)[0], chances(again, df)[0])


@pytest.mark.parametrize("labels", ["noise", "signal"])
def test_boosting_stops_when_held_back_rows_no_longer_improve(spark, labels):
    x, y, w = points(400)
    if labels == "noise":
        x = np.random.default_rng(1).normal(size=x.shape)
    model = MultinomialBoosting(3, rounds=25, held_share=0.2, patience=3).fit(frame(spark, x, y, w))
    rounds = len(model.state["rounds"])
    assert rounds < 15 if labels == "noise" else rounds > 8


def test_boosting_of_constant_features_and_absent_classes(spark):
    df = frame(spark, np.ones((20, 2)), np.array([0, 1] * 10), np.ones(20))
    got, _ = chances(MultinomialBoosting(3, rounds=5).fit(df), df)
    assert np.allclose(got, [[0.5, 0.5, 0.0]], atol=1e-6)


@pytest.mark.parametrize("most", [1 << 24, 10])
def test_boosting_passes_over_different_rows_only(spark, monkeypatch, most):
    from tabsmith.plans import boosting

    monkeypatch.setattr(boosting, "MOST_IN_DOUBLES", most)
    x, y, w = points(60)
    x, y, w = (np.concatenate([v] * 20) for v in (x, y, w))
    df = frame(spark, x, y, w)
    seen, blocks = [], MultinomialBoosting._blocks
    monkeypatch.setattr(MultinomialBoosting, "_blocks", lambda *a: seen.append(blocks(*a)) or seen[-1])
    model = MultinomialBoosting(3, rounds=12, rate=0.3, depth=2).fit(df)
    got, _ = chances(model, df)
    assert np.abs(got - plain_boosting(x, y, w, model.state["edges"], 3, 12, 0.3, 2)).max() < 1e-5
    counts = np.concatenate([np.frombuffer(r["n"], np.int64) for r in seen[0].collect()])
    assert counts.sum() == 1200 and len(counts) <= 60, "a pass reads each different row once"


def test_edges_merge_a_bounded_number_of_sketches(spark, monkeypatch):
    from tabsmith.plans import boosting

    monkeypatch.setattr(boosting, "SKETCHES", 1)
    x, y, w = points(200)
    rows = spark.createDataFrame([(v,) for v in x.tolist()], "x array<double>").repartition(6 * spark.sparkContext.defaultParallelism)
    merged, plain = [], type(rows).agg
    monkeypatch.setattr(type(rows), "agg", lambda self, *c: merged.append(self.rdd.getNumPartitions()) or plain(self, *c))
    edges = MultinomialBoosting._edges(rows)
    assert len(edges) == 4 and len(edges[0]) == 31
    assert merged[-1] <= spark.sparkContext.defaultParallelism
