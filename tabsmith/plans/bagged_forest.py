"""Random forests whose bags are balanced each on its own, all trees grown level by level.

A row is in the bag of a tree as often as a Poisson draw of mean one says, which follows from the hash of the row's key, the seed and the tree:
no bag is stored, and none depends on partitions. With ``balanced`` the classes of every bag weigh the same in its tree.

A level is one pass over the packed rows for each group of open nodes: tasks count the bag's rows and label sums per (node, drawn feature, bin),
Spark adds up over tasks, and the driver, which holds sums of open nodes and the trees only, takes the best cut of each node. The sums of both
children follow from it. Groups are cut so that a task's sums stay below ``CELLS`` numbers, however many nodes are open. Nodes of at most
``LOCAL_ROWS`` rows leave the levels: in the end one shuffle brings the rows of each such node together, and a task grows what is below it.

Where binned rows repeat, a table has few different vectors of bins, however many rows. One pass then draws all bags and adds each up by vector, and
a task grows a tree from its sums; these are sums of whole numbers, so no cut or value changes by that.

A node whose drawn features do not vary is tried again with the next features of its own order, until none is left. It is a leaf with fewer
than ``least_rows`` different rows, one label, no feature that varies, or the depth asked for. An empty bag answers with the mean of the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.plans.boosting import BINS, LABEL, WEIGHT, binned
from tabsmith.plans.preprocess import FEATURES
from tabsmith.plans.random_trees import BLOCK_ROWS, CELLS, UNIT, Grove, RandomTreesModel, purity
from tabsmith.plans.stages import ROW_ID
from tabsmith.session import durable

PURE = 1e-10
"""Spread of scaled labels (least 0, most 1) below which a node has one label."""
LOCAL_ROWS = 2_000
"""Different rows of a node that one task finishes."""
ROWS_PER_TASK = 200_000
FOLD_CELLS = 16_000_000
"""Numbers that a task may hold to add up all bags by vector of bins."""
FOLD_ROWS = 1 << 16
"""Rows that are added up at once."""
SLOTS = 8
"""Numbers that a row of partial sums carries at most."""
SUBTREE = ["feature", "cut", "left", "value", "gain"]
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def bag_counts(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in the bag of a tree, from 64-bit keys of the rows."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) ^ np.random.default_rng([seed, tree]).integers(0, 2**64, dtype=np.uint64)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
    return np.searchsorted(POISSON, (mixed >> np.uint64(11)) * 2.0**-53, "right")


@dataclass
class Open:
    """Nodes that may be split: their number, tree, own order of the features, and how many of these were tried."""

    node: np.ndarray
    tree: np.ndarray
    order: np.ndarray
    tried: np.ndarray

    def part(self, which) -> Open:
        return Open(self.node[which], self.tree[which], self.order[which], self.tried[which])

    def with_more(self, other: Open) -> Open:
        return Open(*(np.concatenate([a, b]) for a, b in zip(vars(self).values(), vars(other).values())))


class Rules:
    """What a forest asks of its nodes; sums are [.., part]: different rows, then the label sums of classes, or weight, sum and square of numbers."""

    def __init__(self, n_classes: int | None, depth: int, least_rows: int, draws: int, width: int, balanced: bool) -> None:
        self.n_classes, self.depth, self.least_rows, self.draws, self.width, self.balanced = n_classes, depth, least_rows, draws, width, balanced
        self.parts = 1 + (n_classes or 3)

    def add(self, sums: np.ndarray, cell: np.ndarray, label: np.ndarray, unit: np.ndarray) -> None:
        """Add rows to sums[part, cell]: labels are class numbers or scaled numbers, ``unit`` whole weights."""
        cells = sums.shape[1]
        sums[0] += np.bincount(cell, minlength=cells)
        if self.n_classes:
            by_class = np.bincount(cell * self.n_classes + label.astype(np.int64), unit, cells * self.n_classes)
            sums[1:] += by_class.reshape(-1, self.n_classes).T.astype(np.int64)
        else:
            for j in range(3):
                sums[j + 1] += np.bincount(cell, np.rint(unit * label**j), cells).astype(np.int64)

    def add_sums(self, sums: np.ndarray, cell: np.ndarray, values: np.ndarray) -> None:
        """Add sums that were added up before, values[part, row], to sums[part, cell]."""
        for total, value in zip(sums, values):
            total += np.bincount(cell, value, len(total)).astype(np.int64)

    def weighed(self, sums: np.ndarray, class_weights: np.ndarray) -> np.ndarray:
        """(weight, label sums) under the weights of each node's tree, for sums[node, .., part] and class_weights[node, class]."""
        if not self.n_classes:
            return sums[..., 1:3]
        shape = (len(sums), *[1] * (sums.ndim - 2), self.n_classes)
        by_class = sums[..., 1:] * class_weights.reshape(shape)
        return np.concatenate([by_class.sum(axis=-1, keepdims=True), by_class], axis=-1)

    def mixed(self, sums: np.ndarray) -> np.ndarray:
        """Whether the rows behind sums[node, part] have more than one label."""
        if self.n_classes:
            return (sums[:, 1:] > 0).sum(axis=1) > 1
        weight = np.maximum(sums[:, 1], 1e-300)
        return sums[:, 3] / weight - (sums[:, 2] / weight) ** 2 > PURE

    def values(self, sums: np.ndarray, class_weights: np.ndarray) -> np.ndarray:
        weighed = self.weighed(sums, class_weights)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(weighed[:, :1] > 0, weighed[:, 1:] / weighed[:, :1], 0.0)

    def class_weights(self, roots: np.ndarray) -> np.ndarray:
        """[tree, class] from the bags' sums: rows / (classes * rows of the class), 1 where bags are not balanced."""
        if not self.balanced:
            return np.ones((len(roots), self.n_classes or 1))
        counts = roots[:, 1:]
        present = np.maximum((counts > 0).sum(axis=1, keepdims=True), 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(counts > 0, counts.sum(axis=1, keepdims=True) / (present * counts), 0.0)

    def may_split(self, sums: np.ndarray, depth: np.ndarray) -> np.ndarray:
        return self.mixed(sums) & (sums[:, 0] >= max(self.least_rows, 2)) & (depth < self.depth)


class Growth:
    """Trees while they grow. ``luck(level)`` is the generator that orders the features of a level's new nodes, ``set_aside(rows)`` says which
    nodes are left to others."""

    def __init__(self, rules: Rules, trees: int, depth: int, luck, set_aside, weights: np.ndarray | None = None) -> None:
        self.rules, self.luck, self.set_aside = rules, luck, set_aside
        self.grove = Grove(np.arange(trees), np.full(trees, -1), np.zeros(trees), np.full(trees, -1))
        self.values, self.gains = np.zeros((trees, rules.n_classes or 1)), np.zeros((trees, rules.width))
        self.depth, self.level, self.trees = np.full(trees, depth), 0, trees
        self.filled, self.given = np.zeros(trees, bool), weights is not None
        self.weights = weights if self.given else np.ones((trees, rules.n_classes or 1))
        every = np.arange(trees)
        self.opened = Open(every, every, self._ordered(trees), np.zeros(trees, int))
        self.aside = self.opened.part(slice(0, 0))

    def _ordered(self, n: int) -> np.ndarray:
        """An own order of the features for each of n new nodes."""
        return np.argsort(self.luck(self.level).random((n, self.rules.width)), axis=1, kind="stable")

    def _roots(self, group: Open, whole: np.ndarray) -> np.ndarray:
        """Note what the first sums say of the roots in a group; whether each node of it may be split."""
        rules, roots = self.rules, group.node < self.trees
        if not roots.any():
            return ~roots
        self.filled[group.tree[roots]] = whole[roots, 0] > 0
        if not self.given:
            self.weights[group.tree[roots]] = rules.class_weights(whole[roots])
        self.values[group.node[roots]] = rules.values(whole[roots], self.weights[group.tree[roots]])
        return ~roots | rules.may_split(whole, self.depth[group.node])

    def run(self, histograms) -> None:
        """Grow all open nodes; ``histograms(opened, chosen)`` gives sums[node, draw, bin, part] of their rows."""
        rules, draws, width = self.rules, self.rules.draws, self.rules.width
        size = max(1, CELLS // (draws * BINS * rules.parts))
        while len(self.opened.node):
            again, grown = self.opened.part(slice(0, 0)), []
            for start in range(0, len(self.opened.node), size):
                group = self.opened.part(slice(start, start + size))
                at = group.tried[:, None] + np.arange(draws)
                chosen = np.where(at < width, np.take_along_axis(group.order, np.minimum(at, width - 1), axis=1), -1)
                sums = histograms(group, chosen)
                whole = sums[:, 0].sum(axis=1)
                able = self._roots(group, whole)
                group, chosen, sums, whole = group.part(able), chosen[able], sums[able], whole[able]
                if not len(group.node):
                    continue
                left = np.cumsum(sums, axis=2)[:, :, :-1]
                right = whole[:, None, None] - left
                own = self.weights[group.tree]
                gain = purity(rules.weighed(left, own)) + purity(rules.weighed(right, own)) - purity(rules.weighed(whole, own))[:, None, None]
                gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0) & (chosen >= 0)[:, :, None], gain, -np.inf).reshape(len(gain), -1)
                best = gain.argmax(axis=1)
                rows = np.arange(len(best))
                found = np.isfinite(gain[rows, best])
                more = ~found & (group.tried + draws < width)
                again = again.with_more(Open(group.node[more], group.tree[more], group.order[more], group.tried[more] + draws))
                group, rows, best = group.part(found), rows[found], best[found]
                draw, cut = np.divmod(best, BINS - 1)
                feature = chosen[rows, draw]
                np.add.at(self.gains, (group.tree, feature), np.maximum(gain[rows, best], 0.0))
                grown.append((group.node, group.tree, feature, cut, left[rows, draw, cut], right[rows, draw, cut]))
            self.level += 1
            self.opened = again
            if any(len(g[0]) for g in grown):
                self._opened(*(np.concatenate(p) for p in zip(*grown)))

    def _opened(self, node: np.ndarray, tree: np.ndarray, feature: np.ndarray, cut: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Hang the children under the nodes that were split."""
        rules, n = self.rules, len(self.grove.feature)
        self.grove.feature[node], self.grove.threshold[node], self.grove.left[node] = feature, cut, n + 2 * np.arange(len(node))
        children, owners = np.stack([low, high], axis=1).reshape(2 * len(node), -1), np.repeat(tree, 2)
        self.depth = np.concatenate([self.depth, np.repeat(self.depth[node] + 1, 2)])
        self.append(np.full(len(owners), -1), np.zeros(len(owners)), np.full(len(owners), -1), rules.values(children, self.weights[owners]))
        able = rules.may_split(children, self.depth[n:])
        count = int(able.sum())
        new = Open(n + np.flatnonzero(able), owners[able], self._ordered(count), np.zeros(count, int))
        local = self.set_aside(children[able, 0])
        self.aside = self.aside.with_more(new.part(local))
        # A tree's nodes lie together in a group, so that a task's sums for it are one short stretch.
        every = self.opened.with_more(new.part(~local))
        self.opened = every.part(np.argsort(every.tree, kind="stable"))

    def append(self, feature: np.ndarray, threshold: np.ndarray, left: np.ndarray, values: np.ndarray) -> None:
        old = self.grove
        self.grove = Grove(old.roots, np.concatenate([old.feature, feature]), np.concatenate([old.threshold, threshold]), np.concatenate([old.left, left]))
        self.values = np.concatenate([self.values, values])


def counted(rules: Rules, bins: np.ndarray, add, node: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Sums[node, draw, bin, part] of rows held in memory, which ``add(sums, cell, rows)`` adds; ``node`` is -1 for rows in no node."""
    n, draws = chosen.shape
    out = np.zeros((n, draws, BINS, rules.parts))
    inside = np.flatnonzero(node >= 0)
    for d in range(draws):
        f = chosen[node[inside], d]
        rows, f = inside[f >= 0], f[f >= 0]
        sums = np.zeros((rules.parts, n * BINS), np.int64)
        add(sums, node[rows] * BINS + bins[rows, f], rows)
        out[:, d] = sums.T.reshape(n, BINS, rules.parts)
    out[..., 1:] /= UNIT
    return out


class BaggedForest(Estimator):
    """``features`` of a split: ``sqrt`` or ``all``. Without ``n_classes`` the trees predict numbers."""

    def __init__(self, n_classes: int | None, trees: int = 300, depth: int = 30, least_rows: int = 2, features: str = "sqrt", seed: int = 42,
                 balanced: bool = False) -> None:
        super().__init__()
        self.n_classes, self.trees, self.depth, self.least_rows, self.features = n_classes, trees, depth, least_rows, features
        self.seed, self.balanced = seed, balanced and n_classes is not None

    @staticmethod
    def _edges(df: DataFrame) -> list[list[float]]:
        """Cuts of every feature: its values where it has fewer than ``BINS``, else its least value and even quantiles."""
        x = vector_to_array(FEATURES).alias("x")
        width = df.agg(F.max(F.size(x))).first()[0] or 0
        if not width:
            return []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: list[set] = [set() for _ in range(width)]
            for batch in batches:
                rows = np.array(batch.column(0).flatten(), float).reshape(batch.num_rows, width)
                for j, seen in enumerate(found):
                    if len(seen) <= BINS:
                        seen.update(np.unique(rows[:, j])[: BINS + 1].tolist())
            pairs = [(j, v) for j, seen in enumerate(found) for v in sorted(seen)[: BINS + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int32()), pa.array([p[1] for p in pairs], pa.float64())], ["j", "v"])

        values = df.select(x).mapInArrow(run, "j int, v double").groupBy("j").agg(F.array_sort(F.collect_set("v")).alias("v"))
        values = values.select("j", F.slice("v", 1, BINS + 1).alias("v")).collect()
        few = {r["j"]: r["v"][:-1] for r in values if len(r["v"]) <= BINS}
        many = [j for j in range(width) if j not in few]
        shares = F.lit([i / (BINS - 1) for i in range(BINS - 1)])
        few_tasks = df.select(x).coalesce(max(64, df.sparkSession.sparkContext.defaultParallelism))  # one task merges the sketches of all
        cuts = few_tasks.agg(*[F.percentile_approx(F.get("x", F.lit(j)), shares, F.lit(100_000)).alias(f"q{j}") for j in many]).first() if many else ()
        return [few[j] if j in few else sorted(set(cuts[f"q{j}"] or [])) for j in range(width)]

    def _blocks(self, df: DataFrame, edges: list[list[float]], n_rows: int) -> DataFrame:
        width = len(edges)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(i, BLOCK_ROWS)
                    x = np.array(part.column(0).flatten(), float).reshape(part.num_rows, width)
                    values = [binned(x, edges), np.array(part.column(1), float), np.array(part.column(2), float), np.array(part.column(3), np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], ["bins", "label", "weight", "key"])

        # Balanced bags replace the weights that the whole table would give to classes.
        weight = F.lit(1.0) if self.balanced or WEIGHT not in df.columns else col(WEIGHT).cast("double")
        x = vector_to_array(FEATURES)
        key = F.xxhash64(col(ROW_ID)) if ROW_ID in df.columns else F.xxhash64(x, col(LABEL))
        rows = df.select(x.alias("x"), col(LABEL).cast("double").alias("label"), weight.alias("weight"), key.alias("key"))
        blocks = rows.mapInArrow(run, "bins binary, label binary, weight binary, key binary")
        # Every level passes over the blocks: they are dealt once to as many tasks as there are cores, but to no more than full blocks.
        tasks = max(rows.rdd.getNumPartitions(), df.sparkSession.sparkContext.defaultParallelism)
        return durable(blocks.repartition(max(1, min(tasks, -(-n_rows // BLOCK_ROWS))))).persist()

    def _vectors(self, blocks: DataFrame, rules: Rules, n_rows: int) -> np.ndarray | None:
        """The different vectors of bins in order; None where they are too many for the bags to be added up by them."""
        width, most = rules.width, min(FOLD_CELLS // (self.trees * rules.parts), n_rows // 4)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[bytes] = set()
            for batch in batches:
                for block in batch.column(0):
                    if len(seen) <= most:
                        rows = np.frombuffer(block.as_buffer(), np.uint8).reshape(-1, width)
                        seen.update(v.tobytes() for v in np.unique(rows, axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen)[: most + 1], pa.binary())], ["bins"])

        found = blocks.select("bins").mapInArrow(run, "bins binary").distinct().limit(most + 1).toArrow()["bins"].to_pylist()
        return np.sort(np.array(found, f"S{width}")) if 0 < len(found) <= most else None  # of one length, so that ends of zero do not matter

    def _folded(self, blocks: DataFrame, rules: Rules, vectors: np.ndarray, norm: tuple[float, float]) -> DataFrame:
        """(tree, bins, sums): each bag added up by vector of bins, a row per tree."""
        (centre, scale), width, parts, n, trees, seed = norm, rules.width, rules.parts, len(vectors), self.trees, self.seed
        names = [f"t{i}" for i in range(parts)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, held, size = np.zeros((trees, parts, n), np.int64), [], 0

            def settle() -> None:
                bins, label, weight, keys = (np.concatenate(v) for v in zip(*held))
                kind = np.searchsorted(vectors, bins)
                scaled = label if rules.n_classes else (label - centre) / scale
                for tree in range(trees):
                    times = bag_counts(keys, seed, tree)
                    inside = np.flatnonzero(times)
                    rules.add(sums[tree], kind[inside], scaled[inside], np.rint(times[inside] * weight[inside] * UNIT))
                held.clear()

            for batch in batches:
                for block in zip(*batch.columns):
                    held.append([np.frombuffer(v.as_buffer(), k) for v, k in zip(block, (f"S{width}", float, float, np.int64))])
                    size += len(held[-1][1])
                    if size >= FOLD_ROWS:
                        settle()
                        size = 0
            if held:
                settle()
            for tree in range(trees):
                seen = np.flatnonzero(sums[tree, 0])
                columns = [np.full(len(seen), tree), seen, *sums[tree][:, seen]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["tree", "kind", *names])

        def pack(table: pa.Table) -> pa.Table:
            kind = np.array(table["kind"])
            values = np.array([np.array(table[c]) for c in names], np.int64)
            return pa.table([table["tree"][:1], pa.array([vectors[kind].tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["tree", "bins", "sums"])

        schema = ", ".join(["tree long", "kind long", *[f"{c} long" for c in names]])
        tasks = min(trees, blocks.sparkSession.sparkContext.defaultParallelism)
        summed = blocks.mapInArrow(run, schema).groupBy("tree", "kind").agg(*[F.sum(c).alias(c) for c in names])
        packed = summed.repartition(tasks, "tree").groupBy("tree").applyInArrow(pack, "tree long, bins binary, sums binary")
        return durable(packed).persist()

    def _taken(self, norm: tuple[float, float], grove: Grove, place: np.ndarray, trees: list[int]):
        """Function from a block of ``width`` features to its bags' rows in the wanted nodes: (place, bins, scaled label, whole weight) per tree."""
        n_classes, seed, (centre, scale) = self.n_classes, self.seed, norm

        def read(block, width: int) -> Iterator[tuple[np.ndarray, ...]]:
            label, weight = (np.frombuffer(v.as_buffer()) for v in block[1:3])
            keys = np.frombuffer(block[3].as_buffer(), np.int64)
            bins = np.frombuffer(block[0].as_buffer(), np.uint8).reshape(len(label), width)
            scaled = label if n_classes else (label - centre) / scale
            for tree in trees:
                times = bag_counts(keys, seed, tree)
                inside = np.flatnonzero(times)
                node = place[grove.places(bins[inside], tree)]
                inside, node = inside[node >= 0], node[node >= 0]
                if len(inside):
                    yield node, bins[inside], scaled[inside], np.rint(times[inside] * weight[inside] * UNIT)

        return read

    def _histograms(self, blocks: DataFrame, rules: Rules, grove: Grove, opened: Open, chosen: np.ndarray, norm: tuple[float, float]) -> np.ndarray:
        """Sums[node, draw, bin, part] of the bags' rows in the open nodes; a chosen feature of -1 is no draw."""
        (n, draws), parts, width = chosen.shape, rules.parts, rules.width
        place = np.full(len(grove.feature), -1)
        place[opened.node] = np.arange(n)
        read = self._taken(norm, grove, place, np.unique(opened.tree).tolist())
        lines, slots = -(-parts // SLOTS), min(parts, SLOTS)
        names = [f"t{i}" for i in range(slots)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for block in zip(*batch.columns):
                    if sums is None:
                        sums = np.zeros((parts, n * draws * BINS), np.int64)
                    for node, bins, label, unit in read(block, width):
                        first, size = int(node.min()), int(node.max() - node.min()) + 1
                        here = sums[:, first * draws * BINS : (first + size) * draws * BINS]
                        for d in range(draws):
                            f = chosen[node, d]
                            drawn = np.flatnonzero(f >= 0)
                            cell = ((node[drawn] - first) * draws + d) * BINS + bins[drawn, f[drawn]]
                            rules.add(here, cell, label[drawn], unit[drawn])
            if sums is None:
                return
            seen = np.flatnonzero(sums[0])
            for i in range(0, len(seen), 20_000):
                some = seen[i : i + 20_000]
                values = np.zeros((len(some), lines * slots), np.int64)
                values[:, :parts] = sums[:, some].T
                cells = (some[:, None] * lines + np.arange(lines)).ravel()
                columns = [cells, *np.ascontiguousarray(values.reshape(-1, slots).T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", *names])

        schema = ", ".join(["cell long", *[f"{c} long" for c in names]])
        table = blocks.mapInArrow(run, schema).groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        out = np.zeros((n * draws * BINS * lines, slots))
        out[np.array(table["cell"])] = np.column_stack([np.array(table[c], float) for c in names])
        out = out.reshape(n, draws, BINS, lines * slots)[..., :parts]
        out[..., 1:] /= UNIT
        return out

    def _local(self, blocks: DataFrame, rules: Rules, growth: Growth, norm: tuple[float, float], n_rows: int) -> pa.Table:
        """Subtrees below the nodes set aside, each grown by the task that gets the node's rows."""
        grove, aside, width = growth.grove, growth.aside, rules.width
        place = np.full(len(grove.feature), -1)
        place[aside.node] = aside.node
        read, seed, folded = self._taken(norm, grove, place, np.unique(aside.tree).tolist()), self.seed, "tree" in blocks.columns
        owner, depth = dict(zip(aside.node.tolist(), aside.tree.tolist())), dict(zip(aside.node.tolist(), growth.depth[aside.node].tolist()))
        weights, trees = growth.weights, growth.trees
        names = [f"t{i}" for i in range(rules.parts)] if folded else ["label", "unit"]

        def bag(block) -> Iterator[tuple]:
            bins = np.frombuffer(block[1].as_buffer(), np.uint8).reshape(-1, width)
            yield np.full(len(bins), block[0].as_py()), bins, *np.frombuffer(block[2].as_buffer(), np.int64).reshape(len(names), -1)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in zip(*batch.columns):
                    for node, bins, *columns in bag(block) if folded else read(block, width):
                        ends = pa.py_buffer(np.arange(0, (len(node) + 1) * width, width, dtype=np.int32).tobytes())
                        packed = pa.Array.from_buffers(pa.binary(), len(node), [None, ends, pa.py_buffer(np.ascontiguousarray(bins).tobytes())])
                        yield pa.RecordBatch.from_arrays([pa.array(node), packed, *[pa.array(v) for v in columns]], ["node", "bins", *names])

        def grow(key: tuple, table: pa.Table) -> pa.Table:
            node = key[0].as_py()
            bins = np.frombuffer(b"".join(table["bins"].to_pylist()), np.uint8).reshape(table.num_rows, width)
            values = np.array([np.array(table[c]) for c in names])

            def add(sums: np.ndarray, cell: np.ndarray, which: np.ndarray) -> None:
                if folded:
                    rules.add_sums(sums, cell, values[:, which])
                else:
                    rules.add(sums, cell, values[0, which], values[1, which])

            given = None if node < trees else weights[owner[node]][None]
            small = Growth(rules, 1, depth[node], lambda level: np.random.default_rng([seed, level, 2, node]), lambda n: np.zeros(len(n), bool), given)

            def histograms(opened: Open, chosen: np.ndarray) -> np.ndarray:
                where = np.full(len(small.grove.feature), -1)
                where[opened.node] = np.arange(len(opened.node))
                return counted(rules, bins, add, where[small.grove.places(bins, 0)], chosen)

            small.run(histograms)
            found = [small.grove.feature.astype(np.int32), small.grove.threshold.astype(np.int32), small.grove.left.astype(np.int64), small.values, small.gains[0]]
            return pa.table([pa.array([node]), *[pa.array([v.tobytes()], pa.binary()) for v in found]], names=["node", *SUBTREE])

        tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n_rows * self.trees // ROWS_PER_TASK))
        kinds = ", ".join(f"{c} {'long' if folded else 'double'}" for c in names)
        spread = blocks.mapInArrow(rows, f"node long, bins binary, {kinds}").repartition(tasks, "node")
        return spread.groupBy("node").applyInArrow(grow, ", ".join(["node long", *[f"{c} binary" for c in SUBTREE]])).toArrow()

    def _hang(self, growth: Growth, found: pa.Table) -> None:
        """Put the subtrees under their nodes."""
        order = np.argsort(np.array(found["node"]), kind="stable")
        kinds = (np.int32, np.int32, np.int64, float, float)
        tree_of = dict(zip(growth.aside.node.tolist(), growth.aside.tree.tolist()))
        new, base = [], len(growth.grove.feature)
        for row in found.take(pa.array(order)).to_pylist():
            node = row["node"]
            feature, cut, left, values, gains = (np.frombuffer(row[c], k) for c, k in zip(SUBTREE, kinds))
            values, left = values.reshape(len(feature), -1), np.where(left > 0, left + base - 1, -1)
            growth.grove.feature[node], growth.grove.threshold[node], growth.grove.left[node] = feature[0], cut[0], left[0]
            growth.values[node] = values[0]
            growth.gains[tree_of[node]] += gains
            if node < growth.trees:
                growth.filled[node] = True
            new.append((feature[1:], cut[1:].astype(float), left[1:], values[1:]))
            base += len(feature) - 1
        if new:
            growth.append(*(np.concatenate(p) for p in zip(*new)))

    def _fit(self, df: DataFrame) -> RandomTreesModel:
        first = df.agg(F.min(col(LABEL)), F.max(col(LABEL)), F.count("*")).first()
        edges = self._edges(df)
        width, n_rows = len(edges), first[2]
        norm = (0.0, 1.0) if self.n_classes or first[0] is None else (float(first[0]), float(first[1] - first[0]) or 1.0)
        draws = max(1, min(width, int(math.sqrt(width)) if self.features == "sqrt" else width))
        rules = Rules(self.n_classes, self.depth, self.least_rows, draws, width, self.balanced)
        growth = Growth(rules, self.trees, 0, lambda level: np.random.default_rng([self.seed, level, 1]), lambda rows: rows <= LOCAL_ROWS)
        if width and n_rows:
            blocks = self._blocks(df, edges, n_rows)
            vectors = self._vectors(blocks, rules, n_rows)
            if vectors is not None:
                every, blocks, n_rows = blocks, self._folded(blocks, rules, vectors, norm), len(vectors)
                every.unpersist()
            if vectors is not None or n_rows <= LOCAL_ROWS:
                growth.aside, growth.opened = growth.opened, growth.aside
            growth.run(lambda opened, chosen: self._histograms(blocks, rules, growth.grove, opened, chosen, norm))
            if len(growth.aside.node):
                self._hang(growth, self._local(blocks, rules, growth, norm, n_rows))
            blocks.unpersist()
        grove, values, gains, bags = growth.grove, growth.values, growth.gains, growth.filled
        if not bags.all():
            values[: self.trees][~bags] = values[: self.trees][bags].mean(axis=0) if bags.any() else 1.0 / (self.n_classes or 1)
        if not self.n_classes:
            values = values * norm[1] + norm[0]
        inner = grove.feature >= 0
        threshold = np.zeros(len(inner))
        threshold[inner] = [edges[f][int(c)] for f, c in zip(grove.feature[inner], grove.threshold[inner])]
        total = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, total, out=np.zeros_like(gains), where=total > 0).sum(axis=0)[:width]
        shares = shares / shares.sum() if shares.sum() else shares
        return RandomTreesModel({"n_classes": self.n_classes, "trees": self.trees, "feature": grove.feature.tolist(), "threshold": threshold.tolist(),
                                 "left": grove.left.tolist(), "values": values.tolist(), "importances": shares.tolist()})
