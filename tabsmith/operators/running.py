"""Running totals over a global order without sending the order through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000
FINE = 32


def _sortable(values: pa.Array) -> np.ndarray:
    """Values in a form that NumPy orders as Spark does: times as numbers, texts by code points."""
    if pa.types.is_temporal(values.type):
        values = values.cast(pa.int32() if values.type.bit_width == 32 else pa.int64())
    return values.to_numpy(zero_copy_only=False)


def running_totals(
    counts: DataFrame,
    groups: Sequence[str],
    order: str,
    sums: Sequence[str],
    *,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    largest: int | None = None,
) -> DataFrame:
    """Add ``cum_<s>``: the inclusive total of ``s`` in ascending ``order`` per group.

    ``counts`` holds one row per (group, order value), so hot values are already folded; ``groups`` are
    few (classes, columns). A group of at most ``rows_per_bucket`` rows is one window partition. Larger
    groups are cut into buckets of about that size at most, at cuts drawn from the values; each bucket is its own window partition and starts from the total of the buckets before it. The cuts
    are literals, so a lost task recomputes the same buckets. ``largest`` is an upper bound of the
    group size where the caller knows one; otherwise the groups are counted first.
    """
    groups = list(groups)
    if largest is None:
        sizes = counts.groupBy(*groups).agg(F.count("*").alias("rows"))
        largest = sizes.agg(F.max("rows")).first()[0] or 0
    if largest <= rows_per_bucket:
        window = Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return counts.withColumns({f"cum_{s}": F.sum(s).over(window) for s in sums})

    coarse = math.ceil(largest / rows_per_bucket / FINE)
    n_cuts = coarse * FINE - 1
    # The values are distinct within a group, so a hash sample of them yields even cuts, for texts as
    # well as for numbers. Its size follows from the number of cuts; a group too small to be drawn from
    # needs no cut.
    one_in = max(1, largest // (16 * (n_cuts + 1)))
    drawn = counts.select(*groups, order).filter(F.pmod(F.xxhash64(F.lit(7), order), F.lit(one_in)) == 0)
    cuts = drawn.groupBy(*groups).agg(F.array_sort(F.collect_list(order)).alias("_drawn"))
    drawn_rows = F.size("_drawn").cast("bigint")  # times the number of cuts it exceeds an int
    at = lambda i: F.element_at("_drawn", F.floor(i * drawn_rows / (n_cuts + 1)).cast("int") + 1)
    cuts = cuts.withColumn("_cuts", F.transform(F.sequence(F.lit(1), F.lit(n_cuts)), at)).drop("_drawn")
    found = cuts.withColumn("_group", F.row_number().over(Window.orderBy(*groups)) - 1).toArrow()  # a row per group
    edges = {g: _sortable(v) for g, v in zip(found["_group"].to_pylist(), (c.values for c in found["_cuts"]))}
    numbers = counts.sparkSession.createDataFrame(found.drop_columns(["_cuts"]))

    @F.arrow_udf("int")
    def bucket(group: pa.Array, values: pa.Array) -> pa.Array:
        """Cuts of the row's group up to its value."""
        out = np.zeros(len(values), np.int32)
        known = np.flatnonzero(np.array(pc.and_(group.is_valid(), values.is_valid())))
        of, x = np.array(group.take(pa.array(known))), _sortable(values.take(pa.array(known)))
        for g in np.unique(of).tolist():
            out[known[of == g]] = np.searchsorted(edges[g], x[of == g], "right")
        return pa.array(out)

    # The cuts travel with the function and are halved: a row costs their logarithm, and carries none of them.
    placed = counts.join(F.broadcast(numbers), groups, "left").withColumn("_bucket", bucket("_group", order)).drop("_group")

    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(*groups, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    offsets = totals.select(
        *groups, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inner = Window.partitionBy(*groups, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumns({f"cum_{s}": F.sum(s).over(inner) for s in sums})
    out = out.join(F.broadcast(offsets), [*groups, "_bucket"])
    out = out.withColumns({f"cum_{s}": F.col(f"cum_{s}") + F.col(f"_o_{s}") for s in sums})
    return out.drop("_bucket", *[f"_o_{s}" for s in sums])


def number_distinct(df: DataFrame, order: str, *, largest: int | None = None, **limits) -> DataFrame:
    """Add ``position`` 1..n by ascending ``order``; the values of ``order`` are distinct."""
    ones = df.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("bigint")})
    numbered = running_totals(ones, ["_all"], order, ["_one"], largest=largest, **limits)
    return numbered.withColumnRenamed("cum__one", "position").drop("_all", "_one")
