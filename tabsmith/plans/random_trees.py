"""Extremely randomised trees, grown level by level for many trees at once.

A node tries ``features`` features, drawn among those that vary in it, each at one threshold drawn evenly between the least and the greatest
value that the feature has in the node, and takes the best of them. A level costs two passes over the packed rows for each group of open nodes: the first
finds the value ranges of every open node that may be split, the second the rows and label sums left of every drawn threshold; those of both children
follow from it, so a level that is not split costs no pass. Tasks add up per node, Spark
adds up over tasks, and the driver, which holds sums of open nodes and the trees only, draws and chooses. Groups are cut so that a task's sums
stay below ``CELLS`` numbers, however many nodes are open.

Draws depend on (seed, tree, level) and the place of the node, sums are of integers, so a model depends on neither partitions nor the order of tasks.
Rows with the same features are always in the same node. Where a table has few different vectors of features, one pass adds its rows up by vector, and the
levels read those sums: whole numbers again, and the least and greatest label, so the model is the same.

A node is a leaf when it has fewer rows than ``least_rows``, one label, no feature that varies, or the depth asked for; without a depth, trees grow to
the end, and then a model has about as many nodes a tree as the table has rows. Where the model may have more than ``NODES`` nodes, those of at most
``LOCAL_ROWS`` rows leave the levels: one shuffle brings the rows of each together, a task grows what is below it, and the subtrees stay in a table, which
rows to be scored are brought to by node. The driver then holds the nodes above them only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.plans.boosting import LABEL, PREDICTION, PROBABILITY, WEIGHT
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.stages import ROW_ID, FittedStage
from tabsmith.session import durable

CELLS = 4_000_000
BLOCK_ROWS = 2_000
CHUNK_ROWS = 8_192
"""Rows that a pass takes at once."""
KINDS = 32
"""Different weights and labels of a chunk up to which rows are counted instead of added."""
KEEP_LEVELS, KEEP_CELLS = 3, 20_000_000
"""Every so many levels the blocks note where each row is in each tree, if rows times trees are as many."""
FRACTION = 24
UNIT = float(1 << FRACTION)
FOLD_VECTORS = 100_000
"""Different vectors of features up to which rows are added up."""
NODES = 2_000_000
"""Nodes of a model up to which the driver holds them all."""
LOCAL_ROWS = 8_000
"""Rows of a node that one task finishes, where the driver does not hold all nodes."""
TASK_ROWS = 500_000
"""Rows of such nodes that a task finishes one after another."""
SALT_PARTS = 32
"""Partitions of rows to be scored that share a copy of the subtrees."""
WHOLE = float(1 << 40)
"""Parts of one in which values of trees are added up over tasks: whole numbers, whose sum has no order."""
SUBTREE = ("feature", "threshold", "values")
SLOTS = 8
"""Numbers that a row of partial sums carries."""
TOTALS, LEAST, MOST = ([f"{c}{i}" for i in range(SLOTS)] for c in "tlm")


def folded(values: np.ndarray, empty: float) -> np.ndarray:
    """[node, value] as rows of ``SLOTS`` values, the last row of a node filled up."""
    short = -values.shape[1] % SLOTS
    return np.column_stack([values, np.full((len(values), short), empty, values.dtype)]).reshape(-1, SLOTS)


def lines_of(width: int) -> int:
    return -(-width // SLOTS)


@dataclass
class Grove:
    """Trees as flat arrays: ``feature`` is -1 at a leaf, rows up to ``threshold`` go to ``left``, the others to ``left + 1``."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray

    @cached_property
    def _loops(self) -> tuple[np.ndarray, ...]:
        """(feature, threshold, next node) where a leaf leads to itself: no value is greater than its threshold. The last node is one more leaf."""
        feature, left = np.append(self.feature, -1).astype(np.intp), np.append(self.left, -1)
        leaf = feature < 0
        return feature, np.where(leaf, np.nan, np.append(self.threshold, 0.0)), np.where(leaf, np.arange(len(leaf)), left)

    def places(self, x: np.ndarray, tree: int, start: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row in one tree, from the root or from the nodes given; NaN must be infinity (``routable``)."""
        feature, threshold, following = self._loops
        node = np.full(len(x), self.roots[tree]) if start is None else start
        values, starts = x.ravel(), np.arange(len(x)) * x.shape[1]
        moving = None
        while True:
            at = node if moving is None else node[moving]
            f = feature.take(at)
            inner = f >= 0
            left = np.count_nonzero(inner)
            if not left:
                return node
            if 2 * left < len(at):  # few rows go on: follow only these
                moving = np.flatnonzero(inner) if moving is None else moving[inner]
                at, f = at[inner], f[inner]
            where = starts if moving is None else starts[moving]
            further = following.take(at) + (values.take(where + f) > threshold.take(at))
            if moving is None:
                node = further
            else:
                node[moving] = further


def routable(x: np.ndarray) -> np.ndarray:
    """Values that lead where missing ones belong: beyond every threshold."""
    gaps = np.isnan(x)
    return np.where(gaps, np.inf, x) if gaps.any() else x


@dataclass
class Kept:
    """How blocks note the places of their rows: numbers among a tree's open nodes of one level, which are ``nodes`` from ``first[tree]`` on; the
    greatest number is none of them."""

    nodes: np.ndarray
    first: np.ndarray
    dtype: type
    outside: int

    @property
    def none(self) -> int:
        return np.iinfo(self.dtype).max

    def read(self, noted: pa.Scalar, rows: int) -> np.ndarray:
        return np.frombuffer(noted.as_buffer(), self.dtype).reshape(-1, rows)

    def start(self, noted: np.ndarray, tree: int) -> np.ndarray:
        """The node of each row; ``outside`` in a tree that had closed the row's node."""
        here = noted[tree].astype(np.intp)
        inside = here != self.none
        return np.where(inside, self.nodes.take(np.where(inside, here + self.first[tree], 0)), self.outside)


def least_and_most(groups: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different groups, least, most) of every column of x."""
    first = groups.min()
    near = groups - first
    order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")  # 16 bits are sorted by digits
    ordered = groups[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=first - 1))
    named = ordered[starts]
    return named, np.minimum.reduceat(x[order], starts, axis=0), np.maximum.reduceat(x[order], starts, axis=0)


def purity(sums: np.ndarray) -> np.ndarray:
    """Squared label sums by weight, for sums[.., (weight, label sums)]: what a split raises most is the best split."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[..., 0] > 0, (sums[..., 1:] ** 2).sum(axis=-1) / sums[..., 0], 0.0)


def drawn(luck: np.random.Generator, least: np.ndarray, most: np.ndarray, draws: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, thresholds)[node, draw] of one tree's open nodes; -1 where fewer features vary."""
    order = np.where(most > least, luck.random(least.shape), np.inf)
    chosen = np.argsort(order, axis=1, kind="stable")[:, :draws]
    rows = np.arange(len(least))[:, None]
    low, high = least[rows, chosen], most[rows, chosen]
    with np.errstate(invalid="ignore"):
        cuts = low + luck.random(chosen.shape) * (high - low)
    cuts = np.where(cuts < high, cuts, low)
    return np.where(np.isfinite(order[rows, chosen]), chosen, -1), cuts


def means(sums: np.ndarray) -> np.ndarray:
    """Label means of nodes from (rows, weight, label sums)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(sums[:, 1:2] > 0, sums[:, 2:] / sums[:, 1:2], 0.0)


def grown(x: np.ndarray, parts: np.ndarray, low: np.ndarray, high: np.ndarray, draws: int, depth: float, least_rows: int,
          luck: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, threshold, sums, gains) of the tree of the rows given, by the rules of the levels; ``depth`` levels at most.

    Nodes are numbered level by level, so the children of the i-th node that is split are 1 + 2i and 2 + 2i.
    """
    width = x.shape[1]
    feature, threshold, sums, gains = [np.full(1, -1)], [np.zeros(1)], [parts.sum(axis=0)[None]], np.zeros(width)
    node, level = np.zeros(len(x), np.intp), 0
    while len(node) and level < depth:
        whole = sums[-1]
        order = np.argsort(node, kind="stable")
        x, parts, low, high, node = x[order], parts[order], low[order], high[order], node[order]
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        named = node[starts]
        least, most = np.fmin.reduceat(x, starts, axis=0), np.fmax.reduceat(x, starts, axis=0)
        split = (np.minimum.reduceat(low, starts) < np.maximum.reduceat(high, starts)) & (most > least).any(axis=1)
        split &= whole[named, 0] >= max(least_rows, 2)
        named, least, most = named[split], least[split], most[split]
        n = len(named)
        if not n:
            break
        place = np.full(len(whole), -1)
        place[named] = np.arange(n)
        node = place[node]
        inside = node >= 0
        x, parts, low, high, node = x[inside], parts[inside], low[inside], high[inside], node[inside]
        chosen, cuts = drawn(luck, least, most, draws)
        rows, below = np.arange(len(x)), np.zeros((n, chosen.shape[1], parts.shape[1]))
        for d in range(chosen.shape[1]):
            f = chosen[node, d]
            left = np.flatnonzero((f >= 0) & (x[rows, f] <= cuts[node, d]))
            for j in range(parts.shape[1]):
                below[:, d, j] = np.bincount(node[left], parts[left, j], n)
        one, two, here = below[..., 1:] / UNIT, (whole[named][:, None] - below)[..., 1:] / UNIT, whole[named]
        gain = purity(one) + purity(two) - purity(here[:, 1:] / UNIT)[:, None]
        best, each = np.where(chosen >= 0, gain, -np.inf).argmax(axis=1), np.arange(n)
        f, cut, left = chosen[each, best], cuts[each, best], below[each, best]
        np.add.at(gains, f, np.maximum(gain[each, best], 0))
        feature[-1][named], threshold[-1][named] = f, cut
        feature.append(np.full(2 * n, -1))
        threshold.append(np.zeros(2 * n))
        sums.append(np.stack([left, here - left], axis=1).reshape(2 * n, -1))
        node = 2 * node + ~(x[rows, f[node]] <= cut[node])
        level += 1
    return np.concatenate(feature), np.concatenate(threshold), np.concatenate(sums), gains


class RandomTrees(Estimator):
    """``features`` of a split: ``sqrt`` or ``all``. Without ``n_classes`` the trees predict numbers."""

    def __init__(self, n_classes: int | None, trees: int = 300, depth: int | None = None, least_rows: int = 2, features: str = "sqrt",
                 seed: int = 42) -> None:
        super().__init__()
        self.n_classes, self.trees, self.depth, self.least_rows, self.features, self.seed = n_classes, trees, depth, least_rows, features, seed

    def _parts(self, label: np.ndarray, weight: np.ndarray, centre: float, scale: float) -> np.ndarray:
        """Integer weight and label sums of every row."""
        if self.n_classes:
            values = (label[:, None] == np.arange(self.n_classes)) * weight[:, None]
        else:
            values = ((label - centre) / scale * weight)[:, None]
        return np.rint(np.column_stack([weight, values]) * UNIT)

    def _blocks(self, df: DataFrame, n_rows: int, norm: tuple) -> DataFrame:
        """(x, parts, low, high) of packed rows: features, (rows, weight, label sums) in whole numbers, least and greatest label."""
        make = self._parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(i, BLOCK_ROWS)
                    label = np.array(part.column(1))
                    sums = np.column_stack([np.ones(len(label)), make(label, np.array(part.column(2)), *norm)])
                    values = [np.array(part.column(0).flatten(), float), sums, label, label]
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["x", "parts", "low", "high"])

        weight = col(WEIGHT).cast("double") if WEIGHT in df.columns else F.lit(1.0)
        rows = df.select(vector_to_array(FEATURES).alias("x"), col(LABEL).cast("double").alias("label"), weight.alias("weight"))
        blocks = rows.mapInArrow(run, "x binary, parts binary, low binary, high binary")
        # Every level passes over the blocks: they are dealt once to as many tasks as there are cores, but to no more than full blocks.
        tasks = max(rows.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        return durable(blocks.repartition(max(1, min(tasks, -(-n_rows // BLOCK_ROWS))))).persist()

    def _folded(self, blocks: DataFrame, n_rows: int, width: int) -> tuple[DataFrame, int]:
        """The blocks with one row per vector of features, or as they are where vectors are many, and their rows."""
        k, most = (self.n_classes or 1) + 2, min(FOLD_VECTORS, n_rows // 4)
        names = [f"t{i}" for i in range(k)]

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                for block in batch.column(0):
                    if len(seen) <= most:
                        rows = np.frombuffer(block.as_buffer()).reshape(-1, width) + 0.0
                        seen.update(v.tobytes() for v in np.unique(rows, axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)[: most + 1], pa.binary())], ["x"])

        found = blocks.select("x").mapInArrow(vectors, "x binary").distinct().limit(most + 1).count()
        if found > most:
            return blocks, n_rows

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in zip(*batch.columns):
                    x, parts, low, high = (np.frombuffer(v.as_buffer()) for v in block)
                    x, at = np.unique(x.reshape(len(low), width) + 0.0, axis=0, return_inverse=True)
                    sums = [np.bincount(at.ravel(), p, len(x)).astype(np.int64) for p in parts.reshape(len(low), k).T]
                    named, least, most = least_and_most(at.ravel(), np.column_stack([low, high]))
                    columns = [pa.array([v.tobytes() for v in x], pa.binary()), *map(pa.array, sums), pa.array(least[:, 0]), pa.array(most[:, 1])]
                    yield pa.RecordBatch.from_arrays(columns, ["x", *names, "low", "high"])

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(i, BLOCK_ROWS)
                    parts = np.column_stack([np.array(part.column(c), float) for c in names])
                    values = [b"".join(part.column("x").to_pylist()), parts.tobytes(), *[np.array(part.column(c), float).tobytes() for c in ("low", "high")]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["x", "parts", "low", "high"])

        schema = ", ".join(["x binary", *[f"{c} long" for c in names], "low double", "high double"])
        merged = [*[F.sum(c).alias(c) for c in names], F.min("low").alias("low"), F.max("high").alias("high")]
        tasks = max(1, min(blocks.sparkSession.sparkContext.defaultParallelism, -(-found // BLOCK_ROWS)))
        summed = blocks.mapInArrow(fold, schema).groupBy("x").agg(*merged).repartition(tasks)
        out = durable(summed.mapInArrow(pack, "x binary, parts binary, low binary, high binary")).persist()
        blocks.unpersist()
        return out, found

    @staticmethod
    def _summed(blocks: DataFrame, kept: Kept | None, width: int, add, flat, merged: dict[str, str]) -> pa.Table:
        """Run ``add(state, x, parts, low, high, start)`` on the rows of a task, some blocks at once, and merge what ``flat(state)`` then yields over all tasks:
        the cell, then the columns of ``merged`` by their function."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            state: dict = {}
            held: list[tuple] = []

            def settle() -> None:
                x, sums, low, high = (np.concatenate(v) for v in list(zip(*held))[:4])
                x = x.reshape(len(low), width)
                noted = np.concatenate([h[4] for h in held], axis=1) if kept else None
                held.clear()
                add(state, x, sums.reshape(len(low), -1), low, high, lambda tree: kept.start(noted, tree) if kept else None)

            size = 0
            for batch in batches:
                for block in zip(*batch.columns):
                    held.append(tuple(np.frombuffer(p.as_buffer()) for p in block[:4]))
                    if kept:
                        held[-1] += (kept.read(block[4], len(held[-1][2])),)
                    size += len(held[-1][2])
                    if size >= CHUNK_ROWS:
                        settle()
                        size = 0
            if held:
                settle()
            if state:
                columns = flat(state)
                for i in range(0, len(columns[0]), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[i : i + 20_000])) for v in columns], ["cell", *merged])

        schema = ", ".join(["cell long", *[f"{c} {'long' if f == 'sum' else 'double'}" for c, f in merged.items()]])
        return blocks.mapInArrow(run, schema).groupBy("cell").agg(*[getattr(F, f)(c).alias(c) for c, f in merged.items()]).toArrow()

    def _noted(self, blocks: DataFrame, kept: Kept | None, grove: Grove, opened: np.ndarray, tree_of: np.ndarray, width: int) -> tuple[DataFrame, Kept]:
        """The blocks with the place of every row in every tree, so that later levels start there."""
        spans, place = self._placed(opened, tree_of, len(grove.feature))
        first = np.zeros(self.trees, np.intp)
        first[[t for t, _, _ in spans]] = [i for _, i, _ in spans]
        most = max(n for _, _, n in spans)
        now = Kept(opened, first, next(t for t in (np.uint8, np.uint16, np.int32) if most < np.iinfo(t).max), len(grove.feature))
        trees = self.trees

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in zip(*batch.columns):
                    x = routable(np.frombuffer(block[0].as_buffer()).reshape(-1, width))
                    before = kept.read(block[4], len(x)) if kept else None
                    noted = np.full((trees, len(x)), now.none, now.dtype)
                    for tree, i, _ in spans:
                        node = place.take(grove.places(x, tree, kept.start(before, tree) if kept else None))
                        noted[tree] = np.where(node >= 0, node - i, now.none)
                    columns = [*block[:4], pa.scalar(noted.tobytes(), pa.binary())]
                    yield pa.RecordBatch.from_arrays([pa.array([c.as_py()], pa.binary()) for c in columns], ["x", "parts", "low", "high", "noted"])

        out = blocks.mapInArrow(run, "x binary, parts binary, low binary, high binary, noted binary").persist()
        out.count()
        blocks.unpersist()
        return out, now

    @staticmethod
    def _stacked(table: pa.Table, names: list[str]) -> np.ndarray:
        return np.column_stack([np.array(table[c], float) for c in names])

    def _whole(self, blocks: DataFrame) -> np.ndarray:
        """(rows, weight, label sums) of all rows, which every root has."""
        parts = (self.n_classes or 1) + 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(parts, np.int64)
            for batch in batches:
                for block in batch.column(0):
                    total += np.frombuffer(block.as_buffer()).reshape(-1, parts).sum(axis=0).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts)), pa.array(total)], ["part", "total"])

        table = blocks.select("parts").mapInArrow(run, "part long, total long").groupBy("part").agg(F.sum("total").alias("total")).toArrow()
        out = np.zeros(parts)
        out[np.array(table["part"])] = np.array(table["total"], float)
        return out

    @staticmethod
    def _spans(owners: np.ndarray) -> list[tuple[int, int, int]]:
        """(tree, first, size) of open nodes in the order of their trees: a tree's open nodes lie together."""
        trees, first, size = np.unique(owners, return_index=True, return_counts=True)
        return list(zip(trees.tolist(), first.tolist(), size.tolist()))

    def _described(self, blocks: DataFrame, kept: Kept | None, grove: Grove, spans: list[tuple[int, int, int]], place: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(least[node, feature or label], most) of the n open nodes; ``place`` is a node's number among them, or -1."""
        columns = width + 1
        lines = lines_of(columns)

        def add(state: dict, x: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, start) -> None:
            if not state:
                state.update(least=np.full((columns, n), np.inf), most=np.full((columns, n), -np.inf))
            ends = [(v, v) for v in np.ascontiguousarray(x.T)] + [(low, high)]
            reached = routable(x)
            for tree, first, size in spans:
                node = place.take(grove.places(reached, tree, start(tree)))
                node = np.where(node >= 0, node - first, size)
                order = np.argsort(node.astype(np.uint16) if size < 1 << 16 else node, kind="stable")  # 16 bits are sorted by digits
                ordered = node.take(order)
                starts = np.flatnonzero(np.diff(ordered, prepend=-1))
                named = ordered.take(starts)
                if named[-1] == size:  # rows of other nodes
                    order, starts, named = order[: starts[-1]], starts[:-1], named[:-1]
                if not len(named):
                    continue
                named = named + first
                for j, (bottom, top) in enumerate(ends):
                    least, most = state["least"][j], state["most"][j]
                    sorted_values = bottom.take(order)
                    least[named] = np.fmin(least[named], np.minimum.reduceat(sorted_values, starts))
                    sorted_values = sorted_values if top is bottom else top.take(order)
                    most[named] = np.fmax(most[named], np.maximum.reduceat(sorted_values, starts))

        def flat(state: dict) -> list[np.ndarray]:
            seen = np.flatnonzero((state["most"] >= state["least"]).any(axis=0))
            cells = (seen[:, None] * lines + np.arange(lines)).ravel()
            return [cells, *folded(state["least"].T[seen], np.inf).T, *folded(state["most"].T[seen], -np.inf).T]

        table = self._summed(blocks, kept, width, add, flat, dict.fromkeys(LEAST, "min") | dict.fromkeys(MOST, "max"))
        cell, out = np.array(table["cell"]), np.zeros((2, n * lines, SLOTS))
        for i, names in enumerate((LEAST, MOST)):
            out[i, cell] = self._stacked(table, names)
        return out[0].reshape(n, -1)[:, :columns], out[1].reshape(n, -1)[:, :columns]

    def _left_of(self, blocks: DataFrame, kept: Kept | None, grove: Grove, spans: list[tuple[int, int, int]], place: np.ndarray, chosen: np.ndarray, cuts: np.ndarray,
                 width: int) -> np.ndarray:
        """Sums[node, draw, part] of the rows up to each drawn threshold, rows first; a feature of -1 is no draw."""
        (n, draws), parts = chosen.shape, (self.n_classes or 1) + 2

        def add(state: dict, x: np.ndarray, values: np.ndarray, low: np.ndarray, high: np.ndarray, start) -> None:
            if not state:
                state["totals"] = np.zeros((draws, n, parts), np.int64)
            kinds, kind = np.unique(values, axis=0, return_inverse=True)
            kind, few, starts, plain = kind.ravel(), len(kinds) <= KINDS, np.arange(len(x)) * width, x.ravel()
            reached = routable(x)
            for tree, first, size in spans:
                node = place.take(grove.places(reached, tree, start(tree)))
                node = np.where(node >= 0, node - first, size)
                for d in range(draws):
                    # Rows of other nodes, and nodes without this draw, are up to no threshold.
                    f, cut = np.append(chosen[first : first + size, d], 0), np.append(cuts[first : first + size, d], np.nan)
                    f, cut = np.where(f < 0, 0, f), np.where(f < 0, np.nan, cut)
                    rows = np.flatnonzero(plain.take(starts + f.take(node)) <= cut.take(node))
                    key, here = node.take(rows), state["totals"][d, first : first + size]
                    if few:
                        counts = np.bincount(key * len(kinds) + kind.take(rows), minlength=size * len(kinds)).reshape(size, -1)
                        here += (counts @ kinds).astype(np.int64)
                    else:
                        for j in range(parts):
                            here[:, j] += np.bincount(key, values[rows, j], size).astype(np.int64)

        def flat(state: dict) -> list[np.ndarray]:
            totals = folded(state["totals"].transpose(1, 0, 2).reshape(n, draws * parts), 0)
            cells = np.flatnonzero(totals.any(axis=1))
            return [cells, *totals[cells].T]

        table = self._summed(blocks, kept, width, add, flat, dict.fromkeys(TOTALS, "sum"))
        out = np.zeros((n * lines_of(draws * parts), SLOTS))
        out[np.array(table["cell"])] = self._stacked(table, TOTALS)
        return out.reshape(n, -1)[:, : draws * parts].reshape(n, draws, parts)

    def _placed(self, group: np.ndarray, tree_of: np.ndarray, nodes: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """The spans of a group of open nodes, and every node's number in it, or -1."""
        place = np.full(nodes + 1, -1)
        place[group] = np.arange(len(group))
        return self._spans(tree_of[group]), place

    def _below(self, blocks: DataFrame, grove: Grove, aside: np.ndarray, levels: np.ndarray, tree_of: np.ndarray, width: int, rows: int,
               draws: int, norm: tuple[float, float]) -> DataFrame:
        """(node, feature, threshold, values, gains) of the subtrees below the nodes set aside, each grown by the task that gets the node's rows."""
        trees, place = np.unique(tree_of[aside]).tolist(), np.full(len(grove.feature) + 1, -1)
        place[aside] = np.arange(len(aside))
        parts, depth, least_rows, seed, (centre, scale) = (self.n_classes or 1) + 2, self.depth, self.least_rows, self.seed, norm
        owners, below = tree_of[aside], [math.inf if depth is None else depth - v for v in levels.tolist()]
        n_classes, names = self.n_classes, ["x", "parts", "low", "high"]

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []

            def settle() -> Iterator[pa.RecordBatch]:
                columns = [np.concatenate(v) for v in zip(*held)]
                columns = [v.reshape(len(columns[2]), -1) for v in columns]
                held.clear()
                reached = routable(columns[0])
                for tree in trees:  # from the roots: noted places know the nodes open at their level only
                    node = place.take(grove.places(reached, tree))
                    order = np.argsort(node, kind="stable")
                    ordered = node[order]
                    starts = np.flatnonzero(np.diff(ordered, prepend=-2))
                    runs = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)]) if ordered[i] >= 0]
                    numbers = [int(v) for v in ordered[starts] if v >= 0]
                    packed = [pa.array([v[r].tobytes() for r in runs], pa.binary()) for v in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *packed], ["node", *names])

            size = 0
            for batch in batches:
                for block in zip(*batch.columns):
                    held.append(tuple(np.frombuffer(p.as_buffer()) for p in block))
                    size += len(held[-1][2])
                    if size >= CHUNK_ROWS:
                        yield from settle()
                        size = 0
            if held:
                yield from settle()

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            i = key[0].as_py()
            x, sums, low, high = (np.frombuffer(b"".join(table[c].to_pylist())) for c in names)
            luck = np.random.default_rng([seed, int(owners[i]), int(aside[i]), 1])
            feature, threshold, sums, gains = grown(x.reshape(len(low), width), sums.reshape(len(low), parts), low, high, draws, below[i], least_rows, luck)
            leaf = feature < 0
            values = means(sums[leaf])
            found = [feature.astype(np.int32), threshold[~leaf], values if n_classes else values * scale + centre, gains]
            return pa.table([pa.array([int(aside[i])]), *[pa.array([v.tobytes()], pa.binary()) for v in found]], names=["node", *SUBTREE, "gains"])

        tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-rows * len(trees) // TASK_ROWS))
        dealt = blocks.select(*names).mapInArrow(deal, ", ".join(["node long", *[f"{c} binary" for c in names]])).repartition(tasks, "node")
        return durable(dealt.groupBy("node").applyInArrow(grow, ", ".join(["node long", *[f"{c} binary" for c in (*SUBTREE, "gains")]])))

    def _fit(self, df: DataFrame) -> RandomTreesModel:
        first = df.select(F.max(F.size(vector_to_array(FEATURES))), F.avg(col(LABEL)), F.max(F.abs(col(LABEL))), F.count("*")).first()
        width = first[0] or 0
        centre, scale = (0.0, 1.0) if self.n_classes or first[1] is None else (float(first[1]), max(float(first[2]) + abs(float(first[1])), 1e-300))
        norm, parts = (centre, scale), (self.n_classes or 1) + 1
        draws = min(width, max(1, int(math.sqrt(width)))) if self.features == "sqrt" else width
        blocks, distinct = self._blocks(df, first[3], norm), first[3]
        if width:
            blocks, distinct = self._folded(blocks, first[3], width)
        most = 2 * distinct if self.depth is None else min(2 * distinct, 1 << min(self.depth + 1, 62))
        local, aside, levels = most * self.trees > NODES, [], []
        tree_of = np.arange(self.trees)
        feature, threshold, left = np.full(self.trees, -1), np.zeros(self.trees), np.full(self.trees, -1)
        gains, level, opened = np.zeros(max(width, 1)), 0, np.arange(self.trees)
        sums, n_rows, kept = np.repeat(self._whole(blocks)[None], self.trees, axis=0), first[3], None
        values = means(sums)
        size = max(1, CELLS // max(2 * (width + 1), draws * (parts + 1), 1))
        while len(opened) and width and (self.depth is None or level < self.depth):
            grove = Grove(np.arange(self.trees), feature, threshold, left)
            able = sums[:, 0] >= max(self.least_rows, 2)
            opened, sums, split_nodes = opened[able], sums[able], []
            if local:
                small = sums[:, 0] <= LOCAL_ROWS
                aside.append(opened[small])
                levels.append(np.full(np.count_nonzero(small), level))
                opened, sums = opened[~small], sums[~small]
            if kept:
                kept.outside = len(feature)
            if level and level % KEEP_LEVELS == 0 and n_rows * self.trees >= KEEP_CELLS and len(opened):
                blocks, kept = self._noted(blocks, kept, grove, opened, tree_of, width)
            for start in range(0, len(opened), size):
                group, whole = opened[start : start + size], sums[start : start + size]
                if level:
                    least, most = self._described(blocks, kept, grove, *self._placed(group, tree_of, len(feature)), len(group), width)
                else:  # all trees have the same root
                    ends = self._described(blocks, kept, grove, *self._placed(group[:1], tree_of, len(feature)), 1, width)
                    least, most = (np.repeat(e, len(group), axis=0) for e in ends)
                split = (least[:, -1] < most[:, -1]) & (most[:, :-1] > least[:, :-1]).any(axis=1)
                group, whole, least, most = group[split], whole[split], least[split, :-1], most[split, :-1]
                if not len(group):
                    continue
                spans, place = self._placed(group, tree_of, len(feature))
                # Numbers are drawn for all open nodes of a tree in their order; ``start`` keeps groups of one tree apart.
                pairs = [drawn(np.random.default_rng([self.seed, t, level * 1_000_003 + start]), least[i : i + n], most[i : i + n], draws) for t, i, n in spans]
                chosen, cuts = (np.concatenate(p) for p in zip(*pairs))
                below = self._left_of(blocks, kept, grove, spans, place, chosen, cuts, width)
                one, two = (v[..., 1:] / UNIT for v in (below, whole[:, None] - below))
                gain = purity(one) + purity(two) - purity(whole[:, 1:] / UNIT)[:, None]
                best = np.where(chosen >= 0, gain, -np.inf).argmax(axis=1)
                rows = np.arange(len(group))
                np.add.at(gains, chosen[rows, best], np.maximum(gain[rows, best], 0))
                split_nodes.append((group, chosen[rows, best], cuts[rows, best], below[rows, best], whole - below[rows, best]))
            level += 1
            if not split_nodes:
                break
            group, f, cut, low, high = (np.concatenate(p) for p in zip(*split_nodes))
            feature[group], threshold[group], left[group] = f, cut, len(feature) + 2 * np.arange(len(group))
            opened = np.arange(len(feature), len(feature) + 2 * len(group))
            sums = np.stack([low, high], axis=1).reshape(len(opened), -1)
            tree_of = np.concatenate([tree_of, np.repeat(tree_of[group], 2)])
            feature, left = np.concatenate([feature, np.full(len(opened), -1)]), np.concatenate([left, np.full(len(opened), -1)])
            threshold, values = np.concatenate([threshold, np.zeros(len(opened))]), np.concatenate([values, means(sums)])
        aside, tables = np.concatenate(aside) if aside else np.zeros(0, int), {}
        if len(aside):
            grove = Grove(np.arange(self.trees), feature, threshold, left)
            found = self._below(blocks, grove, aside, np.concatenate(levels), tree_of, width, first[3], draws, norm)
            shares = found.select("node", "gains").toArrow().sort_by("node")["gains"].to_pylist()
            gains = gains + np.frombuffer(b"".join(shares)).reshape(-1, width).sum(axis=0)
            tables["subtrees"] = found.drop("gains")
        blocks.unpersist()
        if not self.n_classes:
            values = values * scale + centre
        share = gains[:width] / gains.sum() if gains.sum() else gains[:width]
        return RandomTreesModel({"n_classes": self.n_classes, "trees": self.trees, "feature": feature.tolist(), "threshold": threshold.tolist(),
                                 "left": left.tolist(), "values": values.tolist(), "importances": share.tolist(), "aside": np.sort(aside).tolist(),
                                 "norm": norm}, tables)


class RandomTreesModel(FittedStage):
    """Needs the row id column in the rows it scores where it has a table of subtrees."""

    def importances(self) -> np.ndarray:
        return np.array(self.state["importances"])

    @property
    def getNumTrees(self) -> int:
        return self.state["trees"]

    def _joined(self, df: DataFrame) -> DataFrame:
        """Rows go down the upper nodes, are brought to the subtrees by node, and each row's values are added up."""
        trees, n_classes, values, (centre, scale) = self.state["trees"], self.state["n_classes"], np.array(self.state["values"]), self.state["norm"]
        grove = Grove(np.arange(trees), *(np.array(self.state[k]) for k in ("feature", "threshold", "left")))
        outside = np.zeros(len(values), bool)
        outside[self.state["aside"]] = True
        k, salts = values.shape[1], max(1, -(-df.rdd.getNumPartitions() // SALT_PARTS))
        names = [f"v{i}" for i in range(k)]

        def whole(v: np.ndarray) -> np.ndarray:
            return np.rint((v if n_classes else (v - centre) / scale) * WHOLE).astype(np.int64)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                qid, salt = np.array(batch.column(0)), batch.column(2)[0].as_py()
                x = np.array(batch.column(1).flatten(), float).reshape(len(qid), -1)
                reached, known = routable(x), np.zeros((len(qid), k), np.int64)
                for tree in range(trees):
                    node = grove.places(reached, tree)
                    known += np.where(outside[node][:, None], 0, whole(values[node]))
                    rows = np.flatnonzero(outside[node])
                    order = rows[np.argsort(node[rows], kind="stable")]
                    starts = np.flatnonzero(np.diff(node[order], prepend=-1))
                    runs = [order[i:j] for i, j in zip(starts, [*starts[1:], len(order)])]
                    packed = [pa.array([v[r].tobytes() for r in runs], pa.binary()) for v in (qid, reached)]
                    yield pa.RecordBatch.from_arrays([pa.array(node[order[starts]], pa.int64()), pa.array([salt] * len(runs), pa.int32()), *packed],
                                                     ["node", "salt", "qid", "x"])
                # Sums that are known already have keys of their own below zero.
                packed = [pa.array([v.tobytes()], pa.binary()) for v in (qid, known)]
                yield pa.RecordBatch.from_arrays([pa.array([-1 - (int(qid[0]) & (1 << 62) - 1)]), pa.array([salt], pa.int32()), *packed], ["node", "salt", "qid", "x"])

        def answer(key: tuple, rows: pa.Table, subtree: pa.Table) -> pa.Table:
            qid = np.frombuffer(b"".join(rows["qid"].to_pylist()), np.int64)
            blob = b"".join(rows["x"].to_pylist())
            if key[0].as_py() < 0 or not len(qid):
                found = np.frombuffer(blob, np.int64).reshape(len(qid), k)
            else:
                feature, cuts, leaves = (np.frombuffer(subtree[c][0].as_buffer(), t) for c, t in zip(SUBTREE, (np.int32, float, float)))
                leaf = feature < 0
                threshold, left, own = np.zeros(len(feature)), np.full(len(feature), -1), np.zeros((len(feature), k))
                threshold[~leaf], left[~leaf], own[leaf] = cuts, 1 + 2 * np.arange(len(cuts)), leaves.reshape(-1, k)
                below = Grove(np.zeros(1, int), feature, threshold, left)
                found = whole(own[below.places(np.frombuffer(blob).reshape(len(qid), -1), 0)])
            return pa.table([pa.array(qid), *[pa.array(np.ascontiguousarray(v)) for v in found.T]], names=["qid", *names])

        salt = (F.spark_partition_id() % salts).cast("int").alias("salt")
        points = df.select(col(ROW_ID).cast("bigint").alias("qid"), vector_to_array(FEATURES).alias("x"), salt)
        dealt = points.mapInArrow(deal, "node long, salt int, qid binary, x binary")
        subtrees = self.tables["subtrees"].withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        paired = dealt.groupBy("node", "salt").cogroup(subtrees.groupBy("node", "salt"))
        schema = ", ".join(["qid long", *[f"{c} long" for c in names]])
        summed = paired.applyInArrow(answer, schema).groupBy("qid").agg(*[F.sum(c).alias(c) for c in names])
        mean = [F.col(c) / F.lit(WHOLE * trees) for c in names]
        if not n_classes:
            answers = summed.select("qid", (mean[0] * F.lit(scale) + F.lit(centre)).alias(PREDICTION))
        else:
            answers = _best(summed.select("qid", F.array(*mean).alias("_chances")))
        return df.join(answers, col(ROW_ID).cast("bigint") == F.col("qid"), "left").drop("qid")

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.tables:
            return self._joined(df)
        trees, n_classes, values = self.state["trees"], self.state["n_classes"], np.array(self.state["values"])
        grove = Grove(np.arange(trees), *(np.array(self.state[k]) for k in ("feature", "threshold", "left")))

        def mean(points: pd.Series) -> np.ndarray:
            x = routable(np.array(points.tolist(), dtype=float).reshape(len(points), -1))
            return sum(values[grove.places(x, t)] for t in range(trees)) / trees

        if not n_classes:

            @F.pandas_udf("double")
            def number(points: pd.Series) -> pd.Series:
                return pd.Series(mean(points)[:, 0] if len(points) else [], dtype=float)

            return df.withColumn(PREDICTION, number(vector_to_array(FEATURES)))

        @F.pandas_udf("array<double>")
        def chances(points: pd.Series) -> pd.Series:
            return pd.Series(list(mean(points)) if len(points) else [], dtype=object)

        return _best(df.withColumn("_chances", chances(vector_to_array(FEATURES))))


def _best(df: DataFrame) -> DataFrame:
    best = (F.array_position("_chances", F.array_max("_chances")) - 1).cast("double")
    return df.withColumns({PROBABILITY: array_to_vector("_chances"), PREDICTION: best}).drop("_chances")
