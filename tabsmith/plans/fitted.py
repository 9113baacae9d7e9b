"""A fitted pipeline with what is needed to score, save and load it."""

from __future__ import annotations

import datetime as dt
import platform
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions import jsonio
from tabsmith.functions.columns import col
from tabsmith.plans.estimators import LABEL, PREDICTION, PROBABILITY
from tabsmith.plans.stages import ROW_ID, NeighbourFillModel
from tabsmith.session import durable

RUN_SCHEMA = (
    "schema_version int, saved_at_utc timestamp, model_name string, task string, metrics map<string,double>, "
    "dataset_fingerprint string, features array<string>, preprocessing string, train_seconds double, "
    "runtime map<string,string>"
)


def label_index(target: Column, labels: Sequence[Any], dtype: T.DataType) -> Column:
    """Position of the class in ``labels``; null for other values."""
    listed = F.array(*[F.lit(v).cast(dtype) for v in labels])
    return F.when(F.array_contains(listed, target), F.array_position(listed, target) - 1).cast("double")


def proba_name(label: Any) -> str:
    return f"proba_{label}"


@dataclass
class FittedModel:
    name: str
    task: str
    features: list[str]
    pipeline: PipelineModel
    labels: list[Any] = field(default_factory=list)
    label_type: str = "string"
    metadata: dict[str, Any] = field(default_factory=dict)

    @property
    def needs_row_id(self) -> bool:
        from tabsmith.plans.estimators import NearestRowsModel
        from tabsmith.plans.random_trees import RandomTreesModel

        return any(isinstance(s, (NearestRowsModel, NeighbourFillModel)) or (isinstance(s, RandomTreesModel) and s.tables) for s in self.pipeline.stages)

    def missing_columns(self, df: DataFrame) -> list[str]:
        return [c for c in self.features if c not in df.columns]

    def probability_columns(self) -> dict[Any, str]:
        return {v: proba_name(v) for v in self.labels} if self.task == "Classification" else {}

    def outputs(self, scored: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Columns ``keep``, then ``prediction`` and one ``proba_<class>`` each, or ``cluster``."""
        kept = [col(c) for c in keep]
        if self.task == "Clustering":
            return scored.select(*kept, F.col(PREDICTION).cast("int").alias("cluster"))
        if self.task == "Regression":
            return scored.select(*kept, F.col(PREDICTION).alias("prediction"))
        classes = F.array(*[F.lit(v).cast(self.label_type) for v in self.labels])
        extra = [F.get(classes, F.col(PREDICTION).cast("int")).alias("prediction")]
        if PROBABILITY in scored.columns:
            p = vector_to_array(PROBABILITY)
            extra += [F.get(p, F.lit(i)).alias(proba_name(v)) for i, v in enumerate(self.labels)]
        return scored.select(*kept, *extra)

    def score(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """All input columns plus the outputs. Stateless per row, so it works on streams too, except for
        models that search neighbours or keep subtrees in a table: those need a batch table and a row id (``key``, or a numbering that is
        checkpointed)."""
        gone = self.missing_columns(df)
        if gone:
            raise ValueError(f"Missing required columns: {', '.join(gone)}")
        given = df.columns
        rows = df
        if self.needs_row_id and ROW_ID not in given:
            if df.isStreaming:
                raise ValueError("Models that look rows up in a table cannot score a stream.")
            rows = with_row_id(df, key)
        return self.outputs(self.pipeline.transform(rows), given)

    def save(self, path: str, overwrite: bool = False) -> None:
        """Pipeline under ``pipeline`` and a JSON description under ``model``; no pickles."""
        writer = self.pipeline.write()
        (writer.overwrite() if overwrite else writer).save(f"{path}/pipeline")
        record = {"name": self.name, "task": self.task, "features": self.features, "labels": self.labels,
                  "label_type": self.label_type, "metadata": self.metadata}
        text = jsonio.dumps(record).replace("\n", " ")
        spark = SparkSession.active()
        table = spark.createDataFrame([(text,)], "value string").coalesce(1)
        table.write.mode("overwrite" if overwrite else "error").text(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> FittedModel:
        spark = SparkSession.active()
        record = jsonio.loads(spark.read.text(f"{path}/model").first()["value"])
        return cls(record["name"], record["task"], record["features"], PipelineModel.load(f"{path}/pipeline"),
                   record["labels"], record["label_type"], record["metadata"])


def with_row_id(df: DataFrame, key: str | None) -> DataFrame:
    """Add the row id: an integer key column, or a numbering fixed by a checkpoint."""
    if key is not None:
        if not isinstance(df.schema[key].dataType, T.IntegralType):
            raise ValueError(f"Key column {key!r} must hold integers.")
        return df.withColumn(ROW_ID, col(key).cast("bigint"))
    return durable(df.withColumn(ROW_ID, F.monotonically_increasing_id()))


def run_metadata(model: str, task: str, metrics: dict, features: Sequence[str], preprocessing: dict,
                 train_seconds: float, fingerprint: str | None = None) -> dict[str, Any]:
    return {
        "schema_version": 1,
        "saved_at_utc": dt.datetime.now(dt.timezone.utc),
        "model_name": model,
        "task": task,
        "metrics": dict(metrics),
        "dataset_fingerprint": fingerprint,
        "features": list(features),
        "preprocessing": preprocessing,
        "train_seconds": float(train_seconds),
        "runtime": {
            "python_version": platform.python_version(),
            "platform": platform.platform(),
            "spark_version": pyspark.__version__,
            "pandas_version": pd.__version__,
        },
    }


def metadata_table(spark: SparkSession, records: Sequence[dict[str, Any]]) -> DataFrame:
    """Run records as a table, one row per run, for a run history."""
    rows = [
        (r["schema_version"], r["saved_at_utc"].replace(tzinfo=None), r["model_name"], r["task"],
         {k: v for k, v in r["metrics"].items()}, r["dataset_fingerprint"], r["features"],
         jsonio.dumps(r["preprocessing"]), r["train_seconds"], r["runtime"])
        for r in records
    ]
    return spark.createDataFrame(rows, RUN_SCHEMA)


def label_column(df: DataFrame, target: str, labels: Sequence[Any]) -> DataFrame:
    return df.withColumn(LABEL, label_index(col(target), labels, df.schema[target].dataType))
