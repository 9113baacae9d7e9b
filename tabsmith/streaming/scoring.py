"""Score a stream with a fitted model: the batch scoring applied to each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabsmith.plans.fitted import FittedModel


def score_stream(
    fitted: FittedModel, rows: DataFrame, output: str, checkpoint: str, *, fmt: str = "parquet", available_now: bool = True
) -> StreamingQuery:
    """Append scored rows to files under ``output``.

    Scoring keeps no state, so there is no watermark; the checkpoint folder makes the output exactly-once.
    """
    writer = fitted.score(rows).writeStream.format(fmt).outputMode("append")
    writer = writer.option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)
