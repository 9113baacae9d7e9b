"""Exact nearest neighbours as a partitioned join.

Rows are assigned to the nearest of a bounded number of pivots. A query searches its own cell first, which
bounds its k-th distance; a cell farther away than that bound is skipped without loss (after Lu et al., "Efficient
Processing of k Nearest Neighbor Joins using MapReduce", VLDB 2012). Cells and their queries are cut into blocks of
bounded size, so a dense cell is many tasks, and boxes of close rows are skipped within a block in the same way. A
block keeps at most k rows per query; blocks of one query meet in a window that stops at k. No block of pairs ever
leaves a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.session import durable

BLOCK_ROWS = 8_192
QUERY_ROWS = 8_192
CELL_ROWS = 4_096
MAX_PIVOTS = 1_024
LEAF_ROWS = 64
"""Rows of a block that are skipped or measured together."""
PAIRS_AT_ONCE = 2_000_000_000
"""Pairs of rows and donors that are measured without a search."""
MAX_GAP_SETS = 8
"""Sets of gaps up to which rows are searched set by set."""


def _matrix(points: pd.Series) -> np.ndarray:
    return np.stack(points.to_numpy()).astype(float) if len(points) else np.zeros((0, 0))


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, summed over the coordinates in order, so that the value of a pair does not
    depend on the block it is computed in."""
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1] if len(a) and len(b) else 0):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return out


def smallest(distances: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, columns of the k smallest distances), ties by id."""
    k = min(k, distances.shape[1])
    if k == 0:
        return
    limit = np.partition(distances, k - 1, axis=1)[:, k - 1]
    for i in range(len(distances)):
        near = np.flatnonzero(distances[i] <= limit[i])
        yield i, near[np.lexsort((ids[near], distances[i][near]))][:k]


def _chunks(n: int, size: int) -> Iterator[slice]:
    for start in range(0, n, size):
        yield slice(start, start + size)


def _leaves(points: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions of the rows in groups of at most ``size`` that lie close together: halves along the widest coordinate."""
    done, left = [], [np.arange(len(points))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = points[rows]
        widest = int((part.max(axis=0) - part.min(axis=0)).argmax())
        half = len(rows) // 2
        order = np.argpartition(part[:, widest], half)
        left += [rows[order[:half]], rows[order[half:]]]
    return done


def near_rows(asked: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(row of ``asked``, row of ``points``, squared distance) of the k nearest points each, ties by id, by row and place.

    Points are cut into leaves, and asked rows into tiles, that lie close together; a tile measures the leaves whose box is near enough only.
    Points farther than the square root of ``bounds`` may be left out.
    """
    out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
    if len(asked) and len(points) and k > 0:
        k = min(k, len(points))
        by_id = np.argsort(ids, kind="stable")
        points = points[by_id]
        # Boxes say nothing about infinite numbers.
        plain = not points.shape[1] or not (np.isfinite(points).all() and np.isfinite(asked).all())
        leaves = [np.arange(len(points))] if plain else _leaves(points, LEAF_ROWS)
        size = len(asked) if plain else LEAF_ROWS * len(asked) // len(points)
        size = min(max(size, 8), LEAF_ROWS)
        tiles = [np.arange(len(asked))[part] for part in _chunks(len(asked), size)] if plain else _leaves(asked, size)
        low, high = (np.array([f(points[leaf], axis=0) for leaf in leaves]) for f in (np.min, np.max))
        sizes = np.array([len(leaf) for leaf in leaves])
        for tile in tiles:
            q = asked[tile]
            if plain:
                apart = np.zeros(1)
            else:
                gap = np.maximum(np.maximum(low - q.max(axis=0), q.min(axis=0) - high), 0.0)
                apart = (gap * gap).sum(axis=1)
            order = apart.argsort(kind="stable")
            first = max(int(np.searchsorted(sizes[order].cumsum(), k)) + 1, int((apart == 0).sum()))
            at = np.concatenate([leaves[i] for i in order[:first]])
            d = squared_distances(q, points[at])
            limit = np.partition(d, k - 1, axis=1)[:, k - 1]
            if bounds is not None:
                limit = np.minimum(limit, bounds[tile])
            more = [leaves[i] for i in order[first:] if apart[i] <= limit.max() * (1 + 1e-9)]
            if more:
                rest = np.concatenate(more)
                at, d = np.concatenate([at, rest]), np.concatenate([d, squared_distances(q, points[rest])], axis=1)
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
            row, column = np.nonzero(d <= limit[:, None])
            value, column = d[row, column], at[column]
            best = np.lexsort((column, value, row))
            row, column, value = row[best], column[best], value[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            kept = place < k
            for some, found in zip(out, (tile[row[kept]], by_id[column[kept]], value[kept])):
                some.append(found)
    row, column, value = (np.concatenate(some) for some in out)
    by_row = np.argsort(row, kind="stable")
    return row[by_row], column[by_row], value[by_row]


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    """The matrix of a column of arrays of the same length."""
    values = table.column(name).combine_chunks()
    return np.array(values.flatten(), float).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0))


def _blocks(queries: DataFrame, train: DataFrame, cells: dict[int, int], asked: dict[int, int], block_rows: int, query_rows: int, first_only: bool):
    """``queries(cell, skip, ..)`` and ``train(cell, ..)`` cogrouped by blocks of bounded size: parts of a cell by parts of its queries.

    ``skip`` is the number of first parts a query leaves out; ``first_only`` takes the first part of each cell only.
    """
    spark = queries.sparkSession
    plan = [(int(c), max(1, math.ceil(cells[c] / block_rows)), max(1, math.ceil(asked[c] / query_rows))) for c in sorted(cells) if asked.get(c)]
    layout = F.broadcast(spark.createDataFrame(plan, "cell int, t_parts int, q_parts int"))
    t_part = F.lit(0) if first_only else F.explode(F.when(F.col("skip") < F.col("t_parts"), F.sequence("skip", F.col("t_parts") - 1)))
    left = queries.join(layout, "cell").select(
        *queries.columns, t_part.alias("t_part"), F.pmod(F.xxhash64("qid"), F.col("q_parts")).cast("int").alias("q_part"))
    right = train.join(layout, "cell").select(
        "cell", F.pmod(F.xxhash64("tid"), F.col("t_parts")).cast("int").alias("t_part"),
        F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"), "tid", F.col("x").alias("tx"))
    if first_only:
        right = right.filter(F.col("t_part") == 0)
    keys = ["cell", "t_part", "q_part"]
    # The work of a block is not in its bytes: small shuffles must not be merged into few tasks.
    groups = sum(q * (1 if first_only else t) for _, t, q in plan)
    tasks = max(1, min(groups, max(4 * spark.sparkContext.defaultParallelism, groups // 4)))
    left, right = (side.repartition(tasks, *keys) for side in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _place(rows: DataFrame, name: str, pivots: np.ndarray, numbers: np.ndarray) -> DataFrame:
    """Rows (``name``, x) with the number of the nearest pivot as ``cell``, and their ``gap`` to it."""
    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in _chunks(len(batch), 4096):
                some = batch.iloc[part]
                d = np.sqrt(squared_distances(_matrix(some["x"]), pivots))
                cell = d.argmin(axis=1)
                yield some.assign(cell=numbers[cell].astype("int32"), gap=d[np.arange(len(some)), cell])

    return durable(rows.select(name, "x").mapInPandas(place, f"{name} bigint, x array<double>, cell int, gap double"))


def _in_cells(queries: DataFrame, train: DataFrame, k: int, n_pivots: int, block_rows: int, query_rows: int) -> tuple[DataFrame, DataFrame]:
    """(final rows with place, candidate rows of the queries that more than one block can answer), distances squared.

    A query searches the first block of its own cell, which bounds its k-th distance. Only cells that can hold a nearer row are searched then.
    """
    drawn = train.orderBy(F.xxhash64("tid"), "tid").limit(n_pivots).select("x").collect()
    pivots = np.array([r["x"] for r in drawn], dtype=float)
    placed = _place(train, "tid", pivots, np.arange(len(pivots)))
    by_gap = Window.partitionBy("cell").orderBy("gap")
    inner = placed.withColumn("r", F.row_number().over(by_gap)).filter(F.col("r") <= k)
    size = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("radius"))
    # Pivots times k numbers: bounded by the arguments.
    sizes = {r["cell"]: (int(r["n"]), float(r["radius"])) for r in size.collect()}
    close: dict[int, list[float]] = {}
    for r in inner.select("cell", "gap").collect():
        close.setdefault(r["cell"], []).append(float(r["gap"]))
    used = np.array(sorted(sizes))
    cells = {int(c): sizes[c][0] for c in used}
    centres, radius = pivots[used], np.array([sizes[c][1] for c in used])
    reach = np.full((len(used), k), np.inf)
    for i, c in enumerate(used):
        gaps = sorted(close[c])[:k]
        reach[i, : len(gaps)] = gaps
    parts = np.array([math.ceil(cells[c] / block_rows) for c in used])
    position = {int(c): i for i, c in enumerate(used)}
    homes = _place(queries, "qid", centres, used)
    asked = {r["cell"]: int(r["n"]) for r in homes.groupBy("cell").agg(F.count("*").alias("n")).collect()}

    def needed(x: np.ndarray, home: int, limit: np.ndarray) -> Iterator[np.ndarray]:
        """The cells each row needs besides the first part of its own."""
        between = np.sqrt(squared_distances(centres[home : home + 1], centres))[0]
        for part in _chunks(len(x), 1024):
            d = np.sqrt(squared_distances(x[part], centres))
            far = limit[part]
            short = np.flatnonzero(~np.isfinite(far))
            if len(short):  # fewer than k rows in the block
                ends = (d[short][:, :, None] + reach[None]).reshape(len(short), -1)
                kth = min(k, ends.shape[1]) - 1
                far = far.copy()
                far[short] = np.partition(ends, kth, axis=1)[:, kth]
            # Rows of another cell are nearer to its pivot: they lie behind the plane half way between the two.
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(between > 0, (d * d - d[:, home : home + 1] ** 2) / (2 * between), 0.0)
                slack = np.where(between > 0, d * d / between, 0.0) * 1e-12
            # A little slack keeps rounding from skipping a cell at the very edge of the bound.
            edge = far[:, None] * (1 + 1e-9) + 1e-12
            open_ = (d - radius <= edge) & (plane - slack <= edge)
            open_[:, home] = parts[home] > 1
            for row in open_:
                yield used[np.flatnonzero(row)]

    def first(q: pa.Table, t: pa.Table) -> pa.Table:
        x = _numbers(q, "x")
        row, at, d = near_rows(x, _numbers(t, "tx"), np.array(t.column("tid")), k) if t.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        starts = np.searchsorted(row, np.arange(q.num_rows + 1))
        full = np.diff(starts) >= k
        limit = np.full(q.num_rows, np.inf)
        limit[full] = np.sqrt(d[starts[1:][full] - 1])
        more = list(needed(x, position[q.column("cell")[0].as_py()], limit)) if q.num_rows else []
        ends = np.concatenate([[0], np.cumsum([len(c) for c in more])])
        lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), v) for o, v in (
            (starts, pa.array(np.array(t.column("tid"))[at] if t.num_rows else at, pa.int64())), (starts, pa.array(d, pa.float64())),
            (ends, pa.array(np.concatenate([np.zeros(0, np.int32), *more]).astype(np.int32))))]
        return pa.table([q.column("qid"), q.column("x"), q.column("cell"), pa.array(limit), *lists], ["qid", "x", "cell", "far", "tids", "squares", "more"])

    def second(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["qid", "tid", "distance"])
        bounds = np.array(q.column("far"), float) ** 2 * (1 + 1e-9)
        row, at, d = near_rows(_numbers(q, "x"), _numbers(t, "tx"), np.array(t.column("tid")), k, bounds)
        return pa.table([np.array(q.column("qid"))[row], np.array(t.column("tid"))[at], d], ["qid", "tid", "distance"])

    answers = _blocks(homes.select("qid", "x", "cell", F.lit(0).alias("skip")), placed, cells, asked, block_rows, query_rows, True)
    answers = durable(answers.applyInArrow(
        first, "qid bigint, x array<double>, cell int, far double, tids array<bigint>, squares array<double>, more array<int>"))
    pair = F.posexplode(F.arrays_zip("tids", "squares")).alias("at", "pair")
    found = answers.select("qid", F.size("more").alias("open"), pair).select(
        "qid", F.col("pair.tids").alias("tid"), F.col("pair.squares").alias("distance"), (F.col("at") + 1).alias("place"), "open")
    settled, candidates = found.filter("open = 0").drop("open"), found.filter("open > 0").drop("open", "place")
    routed = answers.select("qid", "x", "far", F.col("cell").alias("home"), F.explode("more").alias("cell"))
    routed = routed.select("qid", "x", "cell", "far", (F.col("home") == F.col("cell")).cast("int").alias("skip"))
    again = {r["cell"]: int(r["n"]) for r in routed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    if again:
        rest = _blocks(routed, placed, cells, again, block_rows, query_rows, False)
        candidates = candidates.unionByName(rest.applyInArrow(second, "qid bigint, tid bigint, distance double"))
    return settled, candidates


def nearest(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    *,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
    cell_rows: int = CELL_ROWS,
    max_pivots: int = MAX_PIVOTS,
    squared: bool = False,
) -> DataFrame:
    """(qid, tid, distance, place): the k nearest ``train(tid, x)`` of each ``queries(qid, x)``; ``squared`` leaves out the root.

    ``x`` is an array of doubles without nulls; ids are bigint and unique. Euclidean distance, ties by
    ``tid``. Exact for any data; how much is skipped depends on how well the pivots separate it.
    """
    n = train.count()
    if n == 0 or k < 1:
        return queries.sparkSession.createDataFrame([], "qid bigint, tid bigint, distance double, place int")
    n_pivots = int(min(max_pivots, max(1, n // cell_rows)))
    if n_pivots == 1:
        one = queries.select("qid", "x", F.lit(0).alias("cell"), F.lit(0).alias("skip"))
        blocks = _blocks(one, train.select("tid", "x", F.lit(0).alias("cell")), {0: n}, {0: max(queries.count(), 1)}, block_rows, query_rows, False)

        def search(q: pa.Table, t: pa.Table) -> pa.Table:
            if not q.num_rows or not t.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["qid", "tid", "distance"])
            row, at, d = near_rows(_numbers(q, "x"), _numbers(t, "tx"), np.array(t.column("tid")), k)
            return pa.table([np.array(q.column("qid"))[row], np.array(t.column("tid"))[at], d], ["qid", "tid", "distance"])

        settled, candidates = None, blocks.applyInArrow(search, "qid bigint, tid bigint, distance double")
    else:
        settled, candidates = _in_cells(queries, train, k, n_pivots, block_rows, query_rows)
    order = Window.partitionBy("qid").orderBy("distance", "tid")
    found = candidates.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    if settled is not None:
        found = found.unionByName(settled)
    return found if squared else found.withColumn("distance", F.sqrt("distance"))


def _gap_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the coordinates both rows have, scaled up to all; NaN with none shared."""
    total, shared = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        both = ~np.isnan(gap)
        total += np.where(both, gap * gap, 0.0)
        shared += both
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shared > 0, total * a.shape[1] / shared, np.nan)


def _gaps(x: str) -> Column:
    """Which entries of an array are missing, as a text of true and false."""
    return F.array_join(F.transform(x, lambda v: (v.isNull() | F.isnan(v)).cast("string")), ",")


def _gap_sets(df: DataFrame) -> list[tuple[bool, ...]]:
    """The sets of gaps that occur, no more than one above ``MAX_GAP_SETS``."""
    found = df.select(_gaps("x").alias("g")).distinct().limit(MAX_GAP_SETS + 1).collect()
    return sorted(tuple(v == "true" for v in r["g"].split(",")) for r in found)


def _donor_means_by_gaps(rows: DataFrame, donors: DataFrame, width: int, k: int, asked: list[tuple[bool, ...]], given: list[tuple[bool, ...]]) -> DataFrame:
    """``donor_means`` by pairs of sets of gaps: a pair has one set of shared coordinates, where exact search applies."""
    def of(df: DataFrame, gaps: tuple[bool, ...], name: str, shared: list[int]) -> DataFrame:
        same = _gaps("x") == ",".join(str(g).lower() for g in gaps)
        points = F.array(*[F.get("x", F.lit(i)).cast("double") for i in shared])
        return df.filter(same).select(F.col("rid").alias(name), points.alias("x"))

    found = []
    for need in asked:
        for have in given:
            shared = [i for i in range(width) if not need[i] and not have[i]]
            fields = [i for i in range(width) if need[i] and not have[i]]
            if not shared or not fields:
                continue
            near = nearest(of(rows, need, "qid", shared), of(donors, have, "tid", shared), k, squared=True)
            scaled = (F.col("distance") * width / len(shared)).alias("distance")
            found.append(near.select("qid", "tid", scaled, F.explode(F.array(*map(F.lit, fields))).alias("field")))
    if not found:
        return rows.sparkSession.createDataFrame([], "rid bigint, field int, value double")
    order = Window.partitionBy("qid", "field").orderBy("distance", "tid")
    best = reduce(DataFrame.unionByName, found).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    values = donors.select(F.col("rid").alias("tid"), F.col("x").alias("donor_x"))
    chosen = best.join(values, "tid").withColumn("value", F.get("donor_x", F.col("field")))
    # In one order, so that a mean does not depend on the order of the join.
    listed = F.sort_array(F.collect_list(F.struct("place", "value")))
    total = F.aggregate(listed, F.lit(0.0), lambda s, v: s + v["value"])
    return chosen.groupBy(F.col("qid").alias("rid"), "field").agg((total / F.count("*")).alias("value"))


def donor_means(
    rows: DataFrame, donors: DataFrame, names: Sequence[str], k: int, *,
    block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(rid, field, value): mean of the k nearest donors for each missing value.

    ``rows(rid, x)`` have at least one null in ``x``, ``donors(rid, x)`` are all rows to learn from. The
    distance uses the coordinates both have; donors of a field must have it. A value without any donor
    at a defined distance gets no row. Distances over changing sets of coordinates obey no triangle
    inequality. Rows and donors of one set of gaps each share one set of coordinates, though, where pivots skip what cannot be
    near: large tables with few sets of gaps are searched pair by pair of these. Otherwise the work is rows with gaps times donors, in bounded blocks.
    """
    n_donors, n_rows = donors.count(), rows.count()
    if n_donors * n_rows > PAIRS_AT_ONCE:
        kinds = [_gap_sets(df) for df in (rows, donors)]
        if all(len(k) <= MAX_GAP_SETS for k in kinds):
            return _donor_means_by_gaps(rows, donors, len(names), k, *kinds)
    t_parts = max(1, math.ceil(n_donors / block_rows))
    q_parts = max(1, math.ceil(n_rows / query_rows))
    width = len(names)
    left = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(t_parts - 1))).alias("t_part"),
        F.pmod(F.xxhash64("rid"), F.lit(q_parts)).cast("int").alias("q_part"), "rid", "x",
    )
    right = donors.select(
        F.pmod(F.xxhash64("rid"), F.lit(t_parts)).cast("int").alias("t_part"),
        F.explode(F.sequence(F.lit(0), F.lit(q_parts - 1))).alias("q_part"),
        F.col("rid").alias("donor_id"), F.col("x").alias("donor_x"),
    )

    def search(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        columns = ("rid", "field", "distance", "donor", "value")
        out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in columns]
        if not q.empty and not t.empty:
            points, ids = _matrix(t["donor_x"]), t["donor_id"].to_numpy()
            asked, qids = _matrix(q["x"]), q["rid"].to_numpy()
            out[0], out[1], out[3] = ([np.zeros(0, dtype="int64")] for _ in range(3))
            for part in _chunks(len(q), 256):
                d = _gap_distances(asked[part], points)
                for f in range(width):
                    need = np.flatnonzero(np.isnan(asked[part][:, f]))
                    have = np.flatnonzero(~np.isnan(points[:, f]))
                    if not len(need) or not len(have):
                        continue
                    sub = d[np.ix_(need, have)]
                    sub = np.where(np.isnan(sub), np.inf, sub)
                    for i, near in smallest(sub, ids[have], k):
                        near = near[np.isfinite(sub[i][near])]
                        cells = (np.full(len(near), qids[part][need[i]]), np.full(len(near), f), sub[i][near],
                                 ids[have][near], points[have[near], f])
                        for column, cell in zip(out, cells):
                            column.append(cell)
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(columns, out)})

    schema = "rid bigint, field int, distance double, donor bigint, value double"
    keys = ["t_part", "q_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(search, schema)
    order = Window.partitionBy("rid", "field").orderBy("distance", "donor")
    near = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return near.groupBy("rid", "field").agg(F.avg("value").alias("value"))
