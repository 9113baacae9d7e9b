"""KMeans from joint starts against a plain form."""

from __future__ import annotations

import numpy as np
from pyspark.ml.linalg import Vectors

from tabsmith.plans.clusters import CentresModel, JointKMeans


def blobs(n=300, seed=3):
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.normal(m, 0.3, (n // 3, 2)) for m in ((0, 0), (5, 1), (2, 6))])


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, Vectors.dense(v)) for i, v in enumerate(x.tolist())], ["_rid", "_features"]).repartition(parts)


def cost_of(x, centres):
    return ((x[:, None] - np.array(centres)[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_starts_reach_the_known_clusters_and_the_least_cost_wins(spark):
    x = blobs()
    df = frame(spark, x)
    model = JointKMeans(3, n_init=6).fit(df)
    state = model.state
    assert state["cost"] == min(state["costs"]) and len(state["costs"]) == 6
    assert abs(state["cost"] - cost_of(x, state["centres"])) < 1e-6 * state["cost"]
    # A fixed point: every centre is the mean of its rows, as near as the tolerance asks.
    near = ((x[:, None] - np.array(state["centres"])[None]) ** 2).sum(axis=2).argmin(axis=1)
    for c, centre in enumerate(state["centres"]):
        assert np.abs(x[near == c].mean(axis=0) - centre).max() < 0.05
    assert sorted(np.bincount(near).tolist()) == [100, 100, 100]
    got = {r["_rid"]: r["_prediction"] for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(x))] == near.tolist()


def test_passes_are_those_of_the_longest_start(spark):
    x = np.random.default_rng(2).normal(size=(400, 3))
    df = frame(spark, x)
    alone = [JointKMeans(4, n_init=1, seed=s).fit(df).state["passes"] for s in (42,)]
    joint = JointKMeans(4, n_init=5).fit(df)
    assert alone[0] <= joint.state["passes"] < 5 * max(alone[0], 10)
    assert joint.state["cost"] <= JointKMeans(4, n_init=1).fit(df).state["cost"] + 1e-9, "the first start is among the five"


def test_few_distinct_rows_and_a_saved_model(spark, tmp_path):
    df = frame(spark, np.array([[1.0, 2.0]] * 6 + [[3.0, 4.0]] * 2), 2)
    model = JointKMeans(4, n_init=2).fit(df)
    assert model.state["cost"] == 0.0
    model.write().overwrite().save(str(tmp_path / "m"))
    again = CentresModel.read().load(str(tmp_path / "m"))
    assert [c.tolist() for c in again.clusterCenters()] == model.state["centres"]
    assert again.transform(df).select("_prediction").distinct().count() == 2
