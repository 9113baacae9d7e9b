"""KMeans from several starts that share their passes over the table.

Rows are packed in blocks, stored once in the checkpoint folder. The starts draw their first centres together: a centre is a row drawn
with a chance in proportion to its squared distance from the centres before it (k-means++), by the least of -log(u) / distance over all rows, where u is a
hash of row, start and step. So k passes seed all starts on all rows, and repeat exactly. Then one pass a round sums up the members of every cluster
of every start that still moves. A start has settled when the squares of its moves add up to ``tol`` times the mean variance of the features or less, as in
common single-machine libraries, and leaves the rounds. The number of passes is that of the longest start. The driver holds centres only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.stages import FittedStage
from tabsmith.session import durable

PREDICTION = "_prediction"


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers strictly between 0 and 1 from 64-bit keys."""
    x = keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x = x ^ (x >> np.uint64(31))
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances [row, centre]."""
    apart = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.maximum(apart, 0.0)


class JointKMeans(Estimator):
    def __init__(self, k: int, n_init: int = 20, seed: int = 42, max_iter: int = 300, tol: float = 1e-4) -> None:
        super().__init__()
        self.k, self.n_init, self.seed, self.max_iter, self.tol = k, max(n_init, 1), seed, max_iter, tol

    @staticmethod
    def _blocks(df: DataFrame, width: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x, key = np.array(batch.column(0).flatten()).reshape(-1, width), np.array(batch.column(1))
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([key.tobytes()], pa.binary())], ["x", "key"])

        x = vector_to_array(FEATURES)
        # Rows are drawn by content; equal rows draw alike, so a number within the partition tells them apart.
        key = F.xxhash64(x, F.monotonically_increasing_id())
        return df.select(x.alias("x"), key.alias("key")).mapInArrow(run, "x binary, key binary")

    @staticmethod
    def _each(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches:
            for x, key in zip(batch.column(0), batch.column(1)):
                yield np.frombuffer(x.as_buffer()).reshape(-1, width), np.frombuffer(key.as_buffer(), np.uint64)

    def _seeded(self, blocks: DataFrame, width: int) -> np.ndarray:
        """First centres [start, centre, feature]; fewer distinct rows than ``k`` repeat a centre."""
        n_init, seed, each = self.n_init, self.seed, self._each
        centres = np.zeros((n_init, 0, width))
        for step in range(self.k):
            known = centres

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                least, best = np.full(n_init, np.inf), [None] * n_init
                for x, key in each(batches, width):
                    for s in range(n_init):
                        weight = _distances(x, known[s]).min(axis=1) if step else np.ones(len(x))
                        with np.errstate(divide="ignore"):
                            race = -np.log(_uniform(key, seed * 1_000_003 + s * 1_009 + step)) / weight
                        i = int(race.argmin())
                        if best[s] is None or race[i] < least[s]:
                            least[s], best[s] = race[i], x[i].tolist()
                some = [s for s in range(n_init) if best[s] is not None]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([float(least[s]) for s in some], pa.float64()), pa.array([best[s] for s in some], pa.list_(pa.float64()))],
                    ["start", "race", "x"])

            drawn = blocks.mapInArrow(run, "start int, race double, x array<double>").groupBy("start").agg(F.min(F.struct("race", "x")).alias("best")).collect()
            new = {r["start"]: r["best"]["x"] for r in drawn}
            centres = np.concatenate([centres, np.array([new[s] for s in range(n_init)], float).reshape(n_init, 1, width)], axis=1)
        return centres

    def _sums(self, blocks: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums [start, centre, feature], sizes [start, centre] and costs [start] of the clusters around ``centres``."""
        each, (starts, k, width) = self._each, centres.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, sizes, costs = np.zeros((starts, k, width)), np.zeros((starts, k)), np.zeros(starts)
            flipped = np.ascontiguousarray(centres.transpose(2, 1, 0).reshape(width, k * starts))  # centre by centre, all starts of each
            half = (flipped * flipped).sum(axis=0) / 2
            for x, _ in each(batches, width):
                # Squared distances less the square of the row, which decides nothing.
                apart = half - x @ flipped
                near, best = np.zeros((len(x), starts), np.int8 if k < 128 else np.int32), apart[:, :starts].copy()
                for c in range(1, k):
                    one = apart[:, c * starts : (c + 1) * starts]
                    closer = one < best
                    near[closer] = c
                    np.minimum(best, one, out=best)
                costs += 2 * best.sum(axis=0) + (x * x).sum()
                for c in range(k):
                    members = (near == c).astype(float)
                    sizes[:, c] += members.sum(axis=0)
                    sums[:, c] += members.T @ x
            flat = np.concatenate([np.column_stack([sums.reshape(-1, width), sizes.reshape(-1)]).ravel(), costs])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "value"])

        rows = blocks.mapInArrow(run, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        flat = np.zeros(starts * k * (width + 1) + starts)
        for at, value in rows:
            flat[at] = value
        body = flat[:-starts].reshape(starts, k, width + 1)
        return body[..., :-1], body[..., -1], flat[-starts:]

    def _fit(self, df: DataFrame) -> CentresModel:
        first = df.select(vector_to_array(FEATURES)).first()
        if first is None:
            raise ValueError("There are no rows to cluster.")
        width = len(first[0])
        blocks = durable(self._blocks(df, width)).persist()
        centres = self._seeded(blocks, width)
        moments = [F.var_pop(F.get(vector_to_array(FEATURES), F.lit(j))) for j in range(width)]
        limit = self.tol * float(np.mean(df.agg(*moments).first())) if width else 0.0
        moving, passes = np.arange(self.n_init), 0
        while len(moving) and passes < self.max_iter:
            sums, sizes, _ = self._sums(blocks, centres[moving])
            passes += 1
            some = sizes > 0
            moved = np.where(some[..., None], sums / np.maximum(sizes, 1)[..., None], centres[moving])  # an empty cluster stays where it is
            shift = ((moved - centres[moving]) ** 2).sum(axis=(1, 2))
            centres[moving] = moved
            moving = moving[shift > limit]
        costs = np.maximum(self._sums(blocks, centres)[2], 0.0)
        blocks.unpersist()
        best = int(costs.argmin())
        return CentresModel({"centres": centres[best].tolist(), "cost": float(costs[best]), "costs": costs.tolist(), "passes": passes})


class CentresModel(FittedStage):
    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.state["centres"]]

    def _transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(FEATURES)

        def apart(centre: list[float]):
            squares = F.zip_with(x, F.lit(centre), lambda a, b: (a - b) * (a - b))
            return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)

        every = F.array(*[apart(c) for c in self.state["centres"]])
        return df.withColumn("_apart", every).withColumn(PREDICTION, (F.array_position("_apart", F.array_min("_apart")) - 1).cast("int")).drop("_apart")
