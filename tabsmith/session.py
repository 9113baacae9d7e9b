"""Session helpers: a session builder for local work and durable materialisation."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import DataFrame, SparkSession

TASK_ROWS, LEAST_ROWS = 100_000, 10_000
"""Rows of a task at most, and rows below which a core more is no use."""


def local_session(cores: int | str = "*", app: str = "tabsmith", memory: str = "12g") -> SparkSession:
    """Session for tests and benches. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, as the session names it in ``spark.checkpoint.dir``.

    Only a local session may fall back on a folder of its own: on a cluster a machine-local folder
    would be lost with the machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
        folder = tempfile.mkdtemp(prefix="tabsmith-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks_of(spark: SparkSession, rows: int) -> int:
    """Tasks for ``rows`` rows: of bounded size, and on all cores where there are rows for these."""
    return max(math.ceil(rows / TASK_ROWS), min(spark.sparkContext.defaultParallelism, rows // LEAST_ROWS), 1)


def spread(df: DataFrame, rows: int, key: str) -> DataFrame:
    """Deal ``rows`` rows out by a unique key: tasks of bounded size, on all cores, in an order that every run has.

    A file of one row group is one task however many rows it holds, and every pass over what follows from it would be one, too.
    """
    tasks = tasks_of(df.sparkSession, rows)
    return df.repartition(tasks, key).sortWithinPartitions(key) if tasks > 1 else df
