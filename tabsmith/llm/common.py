"""What the corpus operators share: stored intermediate tables, text columns, checked broadcasts, row removal."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.session import ensure_checkpoint_dir

BROADCAST_ROWS = 100_000
"""A side of a join is broadcast only when its rows were counted and are no more than these (fixed-width rows)."""

_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor reaches."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def release_scratch(spark: SparkSession) -> None:
    """Delete the folders made by ``scratch_path``. Call it once their results have been written."""
    while _SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write an intermediate table to the shared folder and read it: later jobs and lost executors start from there."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def text_key(name: str = "text") -> Column:
    """64 bits of a text. Next to the id it tells rows apart that repeat an id or have none."""
    return F.xxhash64(text_or_empty(name))


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True if ``df`` has at most ``rows`` rows. Counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def same_row(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[k].eqNullSafe(right[k])
    return condition


def without(docs: DataFrame, dropped: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text key) is not in ``dropped(doc_id, text_key)``.

    A counted, short list is broadcast, so that texts stay where they are. A long one is joined by a sort and merge.
    """
    keyed = docs.withColumn("__key", text_key(text))
    gone = dropped.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__gone"))
    gone = F.broadcast(gone) if bounded(dropped) else gone.hint("merge")
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone["__id"]) & (keyed["__key"] == gone["__gone"]), "left_anti")
    return kept.drop("__key")
