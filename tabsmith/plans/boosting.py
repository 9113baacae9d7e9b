"""Gradient boosting of several classes under one multinomial loss.

Every round fits one small tree per class to the gradients of a shared softmax. A level of all these trees is one pass: tasks add up weights,
gradients and curvatures per (class, node, feature, bin), Spark sums them over the tasks, and the driver, which holds these sums only (classes *
nodes * features * bins, whatever the table), picks the splits. Rows alike in bins, label and weight are counted once and packed in blocks, stored in the checkpoint
folder: a pass reads the different rows. Their scores stand beside them and are renewed every ``RENEWED`` rounds, so that a pass evaluates no more than the rounds since.

Sums are of integers (multiples of 2^-``FRACTION``), so that a model does not depend on the order in which tasks finish.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.stages import ROW_ID, FittedStage
from tabsmith.session import durable, tasks_of

LABEL, WEIGHT = "_label", "_weight"
PREDICTION, PROBABILITY = "_prediction", "_probability"
BINS = 32
RENEWED = 10
FRACTION = 28
UNIT = float(1 << FRACTION)
MOST_IN_DOUBLES = 1 << 24
"""Rows of a block whose sums of units doubles hold exactly."""
LEAST_GAIN = 1e-9
SKETCHES = 64

Tree = dict[str, list]
"""A complete binary tree in heap order: ``feature`` (-1 at a leaf), ``bin`` (rows up to it go left), ``value``."""


def empty_tree(depth: int) -> Tree:
    nodes = (1 << depth + 1) - 1
    return {"feature": [-1] * nodes, "bin": [0] * nodes, "value": [0.0] * nodes}


def places(tree: Tree, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after at most ``levels`` splits."""
    feature, cut = np.array(tree["feature"]), np.array(tree["bin"])
    node = np.zeros(len(bins), np.int64)
    rows = np.arange(len(bins))
    for _ in range(levels):
        f = feature[node]
        right = bins[rows, np.maximum(f, 0)] > cut[node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def depth_of(tree: Tree) -> int:
    return (len(tree["feature"]) + 1).bit_length() - 2


def added_scores(rounds: Sequence[Sequence[Tree]], bins: np.ndarray, n_classes: int) -> np.ndarray:
    out = np.zeros((len(bins), n_classes))
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += np.array(tree["value"])[places(tree, bins, depth_of(tree))]
    return out


def softmax(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=1, keepdims=True))
    return shifted / shifted.sum(axis=1, keepdims=True)


def binned(x: np.ndarray, edges: Sequence[Sequence[float]]) -> np.ndarray:
    """The number of edges below each value."""
    out = np.zeros(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(np.array(e, float), x[:, j], "left")
    return out


def best_split(sums: np.ndarray) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the split that parts gradient means most, from sums[feature, bin, (weight, gradient, ..)]; the first of equals."""
    left = np.cumsum(sums, axis=1)[:, :-1]
    whole = sums.sum(axis=1, keepdims=True)
    right = whole - left
    wl, wr = left[..., 0], right[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = wl * wr / (wl + wr) * (left[..., 1] / wl - right[..., 1] / wr) ** 2
    gain = np.where((wl > 0) & (wr > 0), gain, -1.0)
    if not gain.size or gain.max() <= LEAST_GAIN:
        return None
    feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[feature, cut]), int(feature), int(cut)


def leaf_value(sums: np.ndarray, n_classes: int, rate: float) -> float:
    """One Newton step of the multinomial loss, from (weight, gradient, curvature) of the leaf's rows."""
    return rate * (n_classes - 1) / n_classes * sums[1] / sums[2] if sums[2] > 1e-9 else 0.0


class MultinomialBoosting(Estimator):
    """``rounds`` rounds of one tree of ``depth`` levels per class. With ``held_share`` a share of the rows is held back, and boosting stops
    when their loss has not fallen by ``tolerance`` for ``patience`` rounds."""

    def __init__(self, n_classes: int, rounds: int = 100, rate: float = 0.1, depth: int = 3, held_share: float = 0.0, patience: int = 0,
                 tolerance: float = 1e-4) -> None:
        super().__init__()
        self.n_classes, self.rounds, self.rate, self.depth = n_classes, rounds, rate, depth
        self.held_share, self.patience, self.tolerance = held_share if patience else 0.0, patience, tolerance

    @staticmethod
    def _edges(rows: DataFrame) -> list[list[float]]:
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0
        shares = F.lit([i / BINS for i in range(1, BINS)])
        if not width:
            return []
        # A sketch has a size of its own, and one task merges those of all tasks: their number must not grow with the rows.
        rows = rows.coalesce(max(SKETCHES, rows.sparkSession.sparkContext.defaultParallelism))
        found = rows.agg(*[F.percentile_approx(F.get("x", F.lit(j)), shares, F.lit(100_000)).alias(f"q{j}") for j in range(width)]).first()
        return [sorted(set(q or [])) for q in found]

    def _blocks(self, rows: DataFrame, edges: list[list[float]], prior: list[float]) -> DataFrame:
        """Blocks of the different binned rows, and how often each occurs: rows alike in bins, label and weight share every gradient."""
        n_classes, width = self.n_classes, len(edges)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                bins = binned(np.array(batch.column(0).flatten()).reshape(n, width), edges)
                ends = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
                packed = pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(bins.tobytes())])
                yield pa.RecordBatch.from_arrays([packed, *batch.columns[1:]], ["bins", "label", "weight", "held"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    values = [b"".join(batch.column(0).to_pylist()), np.array(batch.column(1)).astype(np.int32).tobytes(), np.array(batch.column(2), float).tobytes(),
                              np.array(batch.column(3).cast(pa.int8())).astype(np.uint8).tobytes(), np.array(batch.column(4)).astype(np.int64).tobytes(),
                              np.tile(np.array(prior), (batch.num_rows, 1)).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["bins", "label", "weight", "held", "n", "score"])

        kind = ["bins", "label", "weight", "held"]
        counted = rows.mapInArrow(cut, "bins binary, label int, weight double, held boolean").groupBy(*kind).agg(F.count("*").alias("n")).persist()
        dealt = counted.repartition(tasks_of(rows.sparkSession, counted.count()), *kind)
        blocks = durable(dealt.mapInArrow(pack, "bins binary, label binary, weight binary, held binary, n binary, score binary")).persist()
        counted.unpersist()
        return blocks

    @staticmethod
    def _unpacked(batch: pa.RecordBatch, n_classes: int) -> Iterator[tuple[np.ndarray, ...]]:
        for bins, label, weight, held, n, score in zip(*batch.columns[:6]):
            label = np.frombuffer(label.as_buffer(), np.int32)
            yield (np.frombuffer(bins.as_buffer(), np.uint8).reshape(len(label), -1), label, np.frombuffer(weight.as_buffer()),
                   np.frombuffer(held.as_buffer(), np.uint8).astype(bool), np.frombuffer(n.as_buffer(), np.int64),
                   np.frombuffer(score.as_buffer()).reshape(-1, n_classes))

    def _renewed(self, blocks: DataFrame, rounds: list[list[Tree]]) -> DataFrame:
        n_classes, unpacked = self.n_classes, self._unpacked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [(score + added_scores(rounds, bins, n_classes)).tobytes() for bins, *_, score in unpacked(batch, n_classes)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(scores, pa.binary())], batch.schema.names)

        return durable(blocks.mapInArrow(run, blocks.schema)).persist()

    def _level(self, blocks: DataFrame, rounds: list[list[Tree]], trees: list[Tree], level: int, width: int) -> tuple[np.ndarray, float | None]:
        """Sums[class, node of the level, feature, bin, (weight, gradient, curvature)] and the mean loss of the held-back rows."""
        n_classes, unpacked = self.n_classes, self._unpacked
        first, nodes = (1 << level) - 1, 1 << level
        size = nodes * width * BINS

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((n_classes, size, 3), np.int64)
            lost = np.zeros(2, np.int64)
            for batch in batches:
                for bins, label, weight, held, n, score in unpacked(batch, n_classes):
                    chance = softmax(score + added_scores(rounds, bins, n_classes))
                    own = np.maximum(chance[np.arange(len(label)), label], 1e-12)
                    lost += np.rint(np.array([(n * weight * -np.log(own))[held].sum(), (n * weight)[held].sum()]) * UNIT).astype(np.int64)
                    bins, label, weight, n, chance = bins[~held], label[~held], weight[~held], n[~held], chance[~held]
                    exact = n.sum() <= MOST_IN_DOUBLES
                    for k, tree in enumerate(trees):
                        node = places(tree, bins, level) - first
                        inside = node >= 0  # the others stopped at a leaf above
                        residual = (label == k) - chance[:, k]
                        parts = [weight, weight * residual, weight * np.abs(residual) * (1 - np.abs(residual))]
                        parts = [np.rint(part[inside] * UNIT) for part in parts]
                        parts = [part * n[inside] if exact else part.astype(np.int64) * n[inside] for part in parts]
                        for j in range(width):
                            key = (node[inside] * width + j) * BINS + bins[inside, j]
                            for i, part in enumerate(parts):
                                if exact:
                                    sums[k, :, i] += np.rint(np.bincount(key, part, size)).astype(np.int64)
                                else:
                                    np.add.at(sums[k, :, i], key, part)
            k, at = np.nonzero(sums.any(axis=2))
            keys = np.concatenate([k * size + at, [-1]])
            values = np.concatenate([sums[k, at], [[*lost, 0]]])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *[pa.array(np.ascontiguousarray(values[:, i])) for i in range(3)]], ["key", "w", "g", "h"])

        total = blocks.mapInArrow(run, "key long, w long, g long, h long").groupBy("key").agg(*[F.sum(c).alias(c) for c in "wgh"]).collect()
        out, loss = np.zeros((n_classes * size, 3)), None
        for key, w, g, h in total:
            if key < 0:
                loss = w / g if g else None
            else:
                out[key] = w / UNIT, g / UNIT, h / UNIT
        return out.reshape(n_classes, nodes, width, BINS, 3), loss

    def _grown(self, blocks: DataFrame, rounds: list[list[Tree]], width: int, gains: np.ndarray) -> tuple[list[Tree], float | None]:
        trees = [empty_tree(self.depth) for _ in range(self.n_classes)]
        held_loss = None
        for level in range(self.depth):
            sums, loss = self._level(blocks, rounds, trees, level, width)
            held_loss = loss if level == 0 else held_loss
            open_nodes = False
            for k, tree in enumerate(trees):
                for i in range(1 << level):
                    node = (1 << level) - 1 + i
                    if level and tree["feature"][(node - 1) // 2] < 0:
                        continue
                    here = sums[k, i]
                    if width:
                        tree["value"][node] = leaf_value(here[0].sum(axis=0), self.n_classes, self.rate)
                    split = best_split(here)
                    if split is None:
                        continue
                    gain, feature, cut = split
                    gains[feature] += gain
                    tree["feature"][node], tree["bin"][node] = feature, cut
                    left = here[feature, : cut + 1].sum(axis=0)
                    for child, part in ((2 * node + 1, left), (2 * node + 2, here[feature].sum(axis=0) - left)):
                        tree["value"][child] = leaf_value(part, self.n_classes, self.rate)
                    open_nodes = True
            if not open_nodes:
                break
        return trees, held_loss

    def _fit(self, df: DataFrame) -> MultinomialBoostingModel:
        held = F.lit(False)
        if self.held_share:
            held = F.pmod(F.xxhash64(F.lit(42), col(ROW_ID)), F.lit(1000)) < int(self.held_share * 1000)
        rows = df.select(vector_to_array(FEATURES).alias("x"), col(LABEL).cast("int").alias("label"), col(WEIGHT).cast("double").alias("weight"), held.alias("held"))
        edges = self._edges(rows)
        weights = {r["label"]: r["w"] for r in rows.where(~F.col("held")).groupBy("label").agg(F.sum("weight").alias("w")).collect()}
        total = sum(weights.values())
        prior = [math.log(max(weights.get(k, 0.0), 1e-12) / total) if total else 0.0 for k in range(self.n_classes)]
        width, gains = len(edges), np.zeros(max(len(edges), 1))
        blocks = self._blocks(rows, edges, prior)
        rounds: list[list[Tree]] = []
        settled, losses = 0, []
        while len(rounds) < self.rounds:
            trees, loss = self._grown(blocks, rounds[settled:], width, gains)
            if loss is not None:
                losses.append(loss)
                if self.patience and len(losses) > self.patience and min(losses[-self.patience :]) > min(losses[: -self.patience]) - self.tolerance:
                    break
            rounds.append(trees)
            if all(t["feature"][0] < 0 for t in trees):
                break
            if len(rounds) - settled >= RENEWED:
                before, blocks = blocks, self._renewed(blocks, rounds[settled:])
                before.unpersist()
                settled = len(rounds)
        blocks.unpersist()
        share = gains / gains.sum() if gains.sum() else gains
        return MultinomialBoostingModel({"n_classes": self.n_classes, "edges": edges, "prior": prior, "rounds": rounds, "importances": share.tolist()})


class MultinomialBoostingModel(FittedStage):
    def importances(self) -> np.ndarray:
        return np.array(self.state["importances"])

    @property
    def getNumTrees(self) -> int:
        return len(self.state["rounds"]) * self.state["n_classes"]

    def _transform(self, df: DataFrame) -> DataFrame:
        state = self.state

        @F.pandas_udf("array<double>")
        def chances(points: pd.Series) -> pd.Series:
            if not len(points):
                return pd.Series([], dtype=object)
            bins = binned(np.array(points.tolist(), dtype=float).reshape(len(points), -1), state["edges"])
            return pd.Series(list(softmax(np.array(state["prior"]) + added_scores(state["rounds"], bins, state["n_classes"]))))

        out = df.withColumn("_chances", chances(vector_to_array(FEATURES)))
        first = (F.array_position("_chances", F.array_max("_chances")) - 1).cast("double")
        return out.withColumns({PROBABILITY: array_to_vector("_chances"), PREDICTION: first}).drop("_chances")
