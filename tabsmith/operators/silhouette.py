"""Silhouette of a clustering."""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.neighbours import _matrix, squared_distances
from tabsmith.session import durable

BLOCK_ROWS, LEAST_BLOCK_ROWS = 65_536, 2_048
"""Rows of a block at most, and rows below which a block more is no use."""
BLOCK_BYTES = 1 << 25
"""Bytes of a block's points, or of its sums, at most."""
TILE = 512
"""Rows of either block that are measured at once."""
SLICE_ROWS = 4_096
"""Rows whose sums over the blocks are added up together."""
NEAR = 1e-6
"""Share of the squared lengths below which a squared distance is not taken from a product."""


def squared_silhouette(df: DataFrame, cluster: str, point: str) -> DataFrame:
    """One row (silhouette_sq): mean silhouette under squared Euclidean distance, in two scans.

    The mean squared distance from a row to a cluster follows from the sum, the squares and the size of the
    cluster, so no pairs are formed. ``point`` is an array of doubles.
    """
    long = df.select(F.col(cluster).alias("c"), F.col(point).alias("x"))
    size = F.size("x")
    width = long.select(size.alias("d")).first()
    schema = "silhouette_sq double"
    if width is None:
        return df.sparkSession.createDataFrame([(None,)], schema)
    sums = long.groupBy("c").agg(
        F.count("*").alias("n"),
        F.sum(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).alias("ss"),
        *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(width["d"])],
    ).collect()
    # One row per cluster.
    if len(sums) < 2:
        return df.sparkSession.createDataFrame([(None,)], schema)
    table = [(r["c"], int(r["n"]), float(r["ss"]), [float(r[f"s{i}"]) for i in range(width["d"])]) for r in sums]
    centres = F.array(*[
        F.struct(F.lit(c).alias("c"), F.lit(n).alias("n"), F.lit(ss).alias("ss"), F.array(*map(F.lit, s)).alias("s"))
        for c, n, ss, s in table
    ])
    own_square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    def total(e):  # sum of squared distances from the row to the cluster
        dot = F.aggregate(F.zip_with("x", e["s"], lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
        return e["n"] * own_square + e["ss"] - 2.0 * dot
    means = F.transform(centres, lambda e: F.struct(e["c"].alias("c"), e["n"].alias("n"), total(e).alias("t")))
    rows = long.withColumn("m", means)
    a = F.aggregate("m", F.lit(0.0), lambda acc, e: acc + F.when(e["c"] == F.col("c"), F.try_divide(e["t"], (e["n"] - 1).cast("double"))).otherwise(0.0))
    b = F.array_min(F.transform(F.filter("m", lambda e: e["c"] != F.col("c")), lambda e: e["t"] / e["n"]))
    alone = F.aggregate("m", F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["c"] == F.col("c"), e["n"].cast("bigint")).otherwise(F.lit(0).cast("bigint"))) <= 1
    a = F.greatest(a, F.lit(0.0))
    b = F.greatest(b, F.lit(0.0))
    value = F.when(alone, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return rows.agg(F.avg(value).alias("silhouette_sq"))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances from one matrix product; pairs so close that it would lose digits are measured coordinate by coordinate."""
    own, other = (a * a).sum(axis=1), (b * b).sum(axis=1)
    scale, squares = own[:, None] + other, a @ b.T
    squares *= -2.0
    squares += scale
    if not (squares > NEAR * (own.max() + other.max())).all():
        row, column = np.nonzero(~(squares > NEAR * scale))
        if len(row) > squares.size // 50:
            return np.sqrt(squared_distances(a, b))
        squares[row, column] = ((a[row] - b[column]) ** 2).sum(axis=1)
    return np.sqrt(squares, out=squares)


def distance_sums(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums[row of a, cluster of b], sums[row of b, cluster of a]) of the distances between two blocks, each distance measured once.

    ``of_a`` and ``of_b`` have a column per cluster, 1 in a row's own. A block and itself: the same array twice.
    """
    same = a is b
    one = np.zeros_like(of_a)
    two = one if same else np.zeros_like(of_b)
    for i in range(0, len(a), TILE):
        left = slice(i, i + TILE)
        for j in range(i if same else 0, len(b), TILE):
            right = slice(j, j + TILE)
            d = distances(a[left], b[right])
            one[left] += d @ of_b[right]
            if not same or j > i:
                two[right] += d.T @ of_a[left]
    return one, two


def euclidean_silhouette(df: DataFrame, key: str, cluster: str, point: str, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row (silhouette): the exact mean silhouette under Euclidean distance.

    The mean distance to a cluster has no closed form, so every pair of rows is measured once, in pairs of blocks of bounded
    size. Blocks are packed and stored once; a task reads two of them and returns one sum per row and cluster, so nothing is
    copied per block. The work grows with the square of the rows: ``squared_silhouette`` is the choice for large tables.
    Null with fewer than two clusters, or as many clusters as rows.
    """
    spark = df.sparkSession
    counted = df.groupBy(F.col(cluster).alias("c")).agg(F.count("*").alias("n"), F.max(F.size(point)).alias("width")).collect()
    sizes = {r["c"]: int(r["n"]) for r in counted}
    n = sum(sizes.values())
    if len(sizes) < 2 or len(sizes) == n:
        return spark.createDataFrame([(None,)], "silhouette double")
    clusters = sorted(sizes)
    code = {c: i for i, c in enumerate(clusters)}
    index = F.element_at(F.create_map(*[F.lit(v) for c, i in code.items() for v in (c, i)]), F.col(cluster))
    k, width = len(clusters), max(r["width"] or 0 for r in counted)
    most = max(1, min(block_rows, BLOCK_BYTES // (8 * max(k, width))))
    cores = spark.sparkContext.defaultParallelism
    blocks = max(math.ceil(n / most), min(math.ceil(n / min(most, LEAST_BLOCK_ROWS)), math.ceil(2 * math.sqrt(cores))))
    rows = df.select(F.col(key).cast("bigint").alias("id"), index.cast("int").alias("c"), F.col(point).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by("id")
        points = _matrix(table["x"].to_pandas())
        if points.shape[1] != width:
            raise ValueError("All points need the same number of coordinates.")
        short = points.astype(np.float32)
        points = short if np.array_equal(short, points) else points
        block = [pa.array([TaskContext.get().partitionId()], pa.int32())]
        lists = [pa.array([table[c].to_pylist()], pa.list_(t)) for c, t in (("id", pa.int64()), ("c", pa.int32()))]
        yield pa.RecordBatch.from_arrays([*block, *lists, pa.array([points.tobytes()], pa.binary())], ["a", "id", "c", "x"])

    packed = durable(rows.repartition(blocks).mapInArrow(pack, "a int, id array<bigint>, c array<int>, x binary"))
    others = packed.select(F.col("a").alias("b"), F.col("c").alias("c2"), F.col("x").alias("x2"))
    # Every task has a block of either side; no block is shuffled or copied for it.
    pairs = packed.join(others.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b"))

    def side(codes: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        codes, data = np.array(codes.values), data.as_buffer()
        member = np.zeros((len(codes), k))
        member[np.arange(len(codes)), codes] = 1.0
        points = np.frombuffer(data, np.float32 if data.size == 4 * width * len(codes) else np.float64)
        return points.reshape(len(codes), width).astype(float), member

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, ids, c, x, b, c2, x2 in zip(*batch.columns):
                left = side(c, x)
                right = left if a == b else side(c2, x2)
                found = distance_sums(*left, *right)
                for mine, partner, sums in [(a, b, found[0]), (b, a, found[1])][: 1 if a == b else 2]:
                    for i in range(0, len(sums), SLICE_ROWS):
                        part = slice(i, i + SLICE_ROWS)
                        names = [v.values[part].to_pylist() if a == b else None for v in (ids, c)]
                        columns = [pa.array([v.as_py()], pa.int32()) for v in (mine, partner)] + [pa.array([i], pa.int32())]
                        columns += [pa.array([v], pa.list_(t)) for v, t in zip(names, (pa.int64(), pa.int32()))]
                        columns.append(pa.array([sums[part].tobytes()], pa.binary()))
                        yield pa.RecordBatch.from_arrays(columns, ["block", "partner", "first", "id", "c", "sums"])

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("partner")
        total = sum(np.frombuffer(v.as_buffer()) for v in table["sums"])
        ids, c = (next(v for v in table[n] if v.is_valid).values for n in ("id", "c"))
        return pa.table([ids, c, pa.ListArray.from_arrays(pa.array(np.arange(0, len(total) + 1, k, dtype=np.int32)), pa.array(total))], names=["id", "c", "sums"])

    measured = pairs.select("a", "id", "c", "x", "b", "c2", "x2").mapInArrow(
        measure, "block int, partner int, first int, id array<bigint>, c array<int>, sums binary")
    part = measured.groupBy("block", "first").applyInArrow(add, "id bigint, c int, sums array<double>")
    cells = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(k)]
    totals = part.groupBy("id", "c").agg(*cells)
    count = F.array(*[F.lit(sizes[c]) for c in clusters])
    total = F.array(*[F.col(f"s{i}") for i in range(k)])
    own = F.get(count, F.col("c"))
    a = F.try_divide(F.get(total, F.col("c")), (own - 1).cast("double"))
    means = F.transform(total, lambda s, i: F.when(i != F.col("c"), s / F.get(count, i)))
    b = F.array_min(means)
    value = F.when(own <= 1, 0.0).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    return totals.agg(F.avg(value).alias("silhouette"))
