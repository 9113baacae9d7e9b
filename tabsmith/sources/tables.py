"""Load a table by its extension; write predictions, scores and run records."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tabsmith.functions.columns import col, nan_to_null
from tabsmith.functions.names import extension_of
from tabsmith.operators.sampling import sample_rows
from tabsmith.plans.fitted import RUN_SCHEMA, metadata_table
from tabsmith.sources.delimited import TableLoadError, read_csv
from tabsmith.sources.workbooks import read_excel

READERS = {
    ".csv": read_csv,
    ".xlsx": read_excel,
    ".parquet": lambda spark, path: spark.read.parquet(*([path] if isinstance(path, str) else path)),
}


def load_table(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    *,
    max_rows: int | None = None,
    sample: int | None = None,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Read CSV, Excel or Parquet with NaN folded into null.

    ``max_rows`` keeps the first rows (by ``key`` if given), ``sample`` draws that many rows by ``key``.
    """
    first = path if isinstance(path, str) else path[0]
    kind = f".{fmt.lower().lstrip('.')}" if fmt else extension_of(first.rstrip("/"))
    if kind not in READERS:
        raise TableLoadError("Unsupported file format.")
    try:
        table = nan_to_null(READERS[kind](spark, path))
    except TableLoadError:
        raise
    except (PySparkException, OSError) as exc:
        raise TableLoadError(f"Could not read dataset: {exc}") from exc
    if max_rows is not None:
        table = (table.orderBy(*[col(k) for k in key]) if key else table).limit(max_rows)
    if sample is not None:
        if not key:
            raise ValueError("A sample needs key columns.")
        table = sample_rows(table, sample, key)
    return table


def write_rows(df: DataFrame, path: str, fmt: str = "csv", mode: str = "error") -> None:
    """Predictions or scored rows as CSV with a header, or Parquet; one file per partition."""
    if fmt not in {"csv", "parquet"}:
        raise ValueError(f"Unknown output format: {fmt}")
    writer = df.write.mode(mode)
    if fmt == "parquet":
        writer.parquet(path)
    else:  # as read_csv reads it; an empty text and a missing one are both empty
        writer.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_runs(spark: SparkSession, records: Sequence[dict[str, Any]], path: str) -> None:
    """Append run records to a JSON run history that stays queryable as a table."""
    metadata_table(spark, records).write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)
