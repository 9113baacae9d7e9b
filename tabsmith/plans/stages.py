"""Fitted preprocessing stages: pyspark.ml estimators and models that save their state."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import col, is_numeric, is_text, missing, number, type_of, typed_constant
from tabsmith.operators import encoders
from tabsmith.operators.cleaning import fill_columns
from tabsmith.operators.counts import modes
from tabsmith.operators.lookup import attach
from tabsmith.operators.neighbours import donor_means
from tabsmith.operators.quantiles import quantiles
from tabsmith.operators.scalers import centre_and_scale, degree_two_terms, scaled
from tabsmith.session import durable, spread

PREFIX = "f__"
ROW_ID = "_rid"
LOCAL_CODES = 20_000
LOCAL_BYTES = 16 * 1024 * 1024


class _StageWriter(MLWriter):
    def __init__(self, stage: FittedStage) -> None:
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(
            self.stage, path, self.sparkSession, {"state": self.stage.state, "tables": sorted(self.stage.tables)}
        )
        for name, table in self.stage.tables.items():
            table.write.parquet(f"{path}/{name}")
        self.stage.save_parts(path)


class _StageReader(MLReader):
    def __init__(self, cls: type[FittedStage]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> FittedStage:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        tables = {name: self.sparkSession.read.parquet(f"{path}/{name}") for name in meta["tables"]}
        stage = self.cls(meta["state"], tables)
        stage._resetUid(meta["uid"])
        stage.load_parts(path)
        return stage


class FittedStage(Model, MLReadable, MLWritable):
    """A model that is a JSON state plus tables, and fits into a ``PipelineModel``."""

    def __init__(self, state: dict | None = None, tables: dict[str, DataFrame] | None = None) -> None:
        super().__init__()
        self.state = state or {}
        self.tables = tables or {}

    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)

    def save_parts(self, path: str) -> None:
        """Save nested models, if any."""

    def load_parts(self, path: str) -> None:
        """Load nested models, if any."""


class ValueFill(Estimator):
    """Copy columns under the feature prefix with missing values filled.

    Numbers: Mean, Median, Mode, Constant, or None to fill nothing. Others: Mode, Constant or None. A numeric
    column without any value has nothing to learn from and is left out.
    """

    def __init__(self, columns: Sequence[str], strategy: str, constant: str = "missing", exact: bool = True) -> None:
        super().__init__()
        self.columns, self.strategy, self.constant, self.exact = list(columns), strategy, constant, exact

    def _fit(self, df: DataFrame) -> ValueFillModel:
        values: dict[str, object] = {c: None for c in self.columns}
        if self.strategy == "Mean":
            values = dict(zip(self.columns, df.agg(*[F.avg(number(df, c)) for c in self.columns]).first()))
        elif self.strategy == "Median":
            values = {c: v[0] for c, v in quantiles(df, self.columns, [0.5], exact=self.exact).items()}
        elif self.strategy == "Mode":
            values = {c: _storable(v) for c, v in modes(df, self.columns).items()}
        elif self.strategy == "Constant":
            values = {c: typed_constant(self.constant, type_of(df, c)) if _typed(df, c) else self.constant
                      for c in self.columns}
        kept = [c for c in self.columns if self.strategy in {"None", "Constant"} or values[c] is not None
                or not is_numeric(type_of(df, c))]
        numeric = [c for c in kept if is_numeric(type_of(df, c))]
        return ValueFillModel({"columns": kept, "numeric": numeric, "values": {c: values[c] for c in kept}})


def _typed(df: DataFrame, name: str) -> bool:
    return is_numeric(type_of(df, name)) or type_of(df, name).typeName() == "boolean"


def _storable(value):
    """Value that JSON can hold; times become text, which the fill casts back."""
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return float(value) if hasattr(value, "as_tuple") else str(value)


class ValueFillModel(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        out = {}
        for c in self.state["columns"]:
            value = self.state["values"][c]
            if c in self.state["numeric"]:
                x = number(df, c)
                out[PREFIX + c] = x if value is None else F.coalesce(x, F.lit(float(value)))
            else:
                x = F.when(~missing(df, c), col(c))
                if value is not None and not is_text(type_of(df, c)) and isinstance(value, str):
                    literal = F.lit(value).try_cast(type_of(df, c))
                    if type_of(df, c).typeName() in {"boolean", "date", "timestamp", "timestamp_ntz"} and value == "missing":
                        x, literal = x.cast("string"), F.lit(value)
                    out[PREFIX + c] = F.coalesce(x, literal)
                else:
                    out[PREFIX + c] = x if value is None else F.coalesce(x, F.lit(value))
        return df.withColumns(out)


class NeighbourFill(Estimator):
    """Fill numbers with the mean of the k nearest rows that have the value."""

    def __init__(self, columns: Sequence[str], k: int = 5) -> None:
        super().__init__()
        self.columns, self.k = list(columns), k

    def _fit(self, df: DataFrame) -> NeighbourFillModel:
        means = dict(zip(self.columns, df.agg(*[F.avg(number(df, c)) for c in self.columns]).first()))
        kept = [c for c in self.columns if means[c] is not None]
        donors = df.select(col(ROW_ID).alias("rid"), F.array(*[number(df, c) for c in kept]).alias("x"))
        state = {"columns": kept, "k": self.k, "means": {c: means[c] for c in kept}}
        n_rows = donors.count()
        return NeighbourFillModel(state, {"donors": durable(spread(donors, n_rows, "rid"))})


class NeighbourFillModel(FittedStage):
    """Needs the row id column. Rows without gaps pass through; only rows with gaps are searched for."""

    def _transform(self, df: DataFrame) -> DataFrame:
        names = self.state["columns"]
        x = F.array(*[number(df, c) for c in names])
        gaps = df.select(col(ROW_ID).alias("rid"), x.alias("x")).filter(F.exists("x", lambda v: v.isNull()))
        found = donor_means(gaps, self.tables["donors"], names, self.state["k"])
        cells = [F.max(F.when(F.col("field") == i, F.col("value"))).alias(f"_v{i}") for i in range(len(names))]
        wide = found.groupBy(F.col("rid").alias("_found")).agg(*cells)
        joined = df.join(wide, col(ROW_ID) == F.col("_found"), "left")
        filled = {
            PREFIX + c: F.coalesce(number(df, c), F.col(f"_v{i}"), F.lit(self.state["means"][c]))
            for i, c in enumerate(names)
        }
        return joined.withColumns(filled).drop("_found", *[f"_v{i}" for i in range(len(names))])


def _apply_steps(x: np.ndarray, gaps: np.ndarray, steps: Sequence[tuple[int, list[float]]]) -> np.ndarray:
    """Run the linear fills in order; a step is (column, intercept followed by weights of the others)."""
    for target, weights in steps:
        others = np.delete(x, target, axis=1)
        guess = others @ np.asarray(weights[1:]) + weights[0]
        x[:, target] = np.where(gaps[:, target], guess, x[:, target])
    return x


class ChainedFill(Estimator):
    """Fill numbers by regressing each column with gaps on all others, in turns.

    Starts from the means; columns with fewer gaps go first. The regression of a step is solved from the
    cross products of its rows, which one scan adds up. Earlier steps are replayed on the fly, so
    nothing is stored between scans and no lineage grows.
    """

    def __init__(self, columns: Sequence[str], rounds: int = 10, tolerance: float = 1e-3) -> None:
        super().__init__()
        self.columns, self.rounds, self.tolerance = list(columns), rounds, tolerance

    def _fit(self, df: DataFrame) -> ChainedFillModel:
        aggs = []
        for c in self.columns:
            x = number(df, c)
            aggs += [F.avg(x), F.count_if(x.isNull()), F.max(F.abs(x)), F.stddev_pop(x)]
        got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        stats = {c: got[4 * i : 4 * i + 4] for i, c in enumerate(self.columns)}
        kept = [c for c in self.columns if stats[c][0] is not None]
        means = np.array([stats[c][0] for c in kept])
        scale = np.array([stats[c][3] or 1.0 for c in kept])
        order = sorted((i for i, c in enumerate(kept) if stats[c][1] > 0), key=lambda i: (stats[kept[i]][1], i))
        largest = max((stats[c][2] for c in kept), default=0.0)
        table = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(kept)])
        width, steps = len(kept), []
        if width > 1 and order:
            for _ in range(self.rounds):
                before = list(steps)
                for target in order:
                    steps.append((target, self._solve(table, means, scale, steps, target)))
                if self._change(table, means, before, steps) < self.tolerance * largest:
                    break
        return ChainedFillModel({"columns": kept, "means": means.tolist(), "steps": steps})

    @staticmethod
    def _solve(table: DataFrame, means: np.ndarray, scale: np.ndarray, steps, target: int) -> list[float]:
        width, done = len(means), list(steps)

        def fold(batches):
            xx, xy, n = np.zeros((width, width)), np.zeros(width), 0
            for batch in batches:
                raw = batch.to_numpy(dtype=float, na_value=np.nan)
                gaps = np.isnan(raw)
                x = _apply_steps(np.where(gaps, means, raw), gaps, done)[~gaps[:, target]]
                z = (x - means) / scale
                design = np.column_stack([np.ones(len(z)), np.delete(z, target, axis=1)])
                xx += design.T @ design
                xy += design.T @ z[:, target]
                n += len(z)
            yield pd.DataFrame({"i": np.arange(width), "xx": list(xx), "xy": xy})

        parts = table.mapInPandas(fold, "i int, xx array<double>, xy double")
        sums = [F.sum(F.get("xx", F.lit(j))).alias(f"x{j}") for j in range(width)]
        rows = parts.groupBy("i").agg(*sums, F.sum("xy").alias("xy")).orderBy("i").collect()
        xx = np.array([[r[f"x{j}"] for j in range(width)] for r in rows])
        xy = np.array([r["xy"] for r in rows])
        # A trace of ridge keeps collinear columns solvable.
        weights = np.linalg.solve(xx + np.eye(width) * 1e-8 * max(xx[0, 0], 1.0), xy)
        others_scale, others_mean = np.delete(scale, target), np.delete(means, target)
        slopes = weights[1:] * scale[target] / others_scale
        intercept = means[target] + weights[0] * scale[target] - float(slopes @ others_mean)
        return [float(intercept), *map(float, slopes)]

    @staticmethod
    def _change(table: DataFrame, means: np.ndarray, before, after) -> float:
        """Largest change of a row's fills between two rounds (sum over its columns)."""

        def compare(batches):
            largest = 0.0
            for batch in batches:
                raw = batch.to_numpy(dtype=float, na_value=np.nan)
                gaps = np.isnan(raw)
                start = np.where(gaps, means, raw)
                gap = np.abs(_apply_steps(start.copy(), gaps, before) - _apply_steps(start.copy(), gaps, after))
                largest = max(largest, float(gap.sum(axis=1).max(initial=0.0)))
            yield pd.DataFrame({"change": [largest]})

        return float(table.mapInPandas(compare, "change double").agg(F.max("change")).first()[0] or 0.0)


class ChainedFillModel(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        names, steps = self.state["columns"], [(int(t), list(w)) for t, w in self.state["steps"]]
        means = np.array(self.state["means"])

        @F.pandas_udf("array<double>")
        def complete(points: pd.Series) -> pd.Series:
            raw = np.array(points.tolist(), dtype=float)
            gaps = np.isnan(raw)
            return pd.Series(list(_apply_steps(np.where(gaps, means, raw), gaps, steps)))

        x = F.array(*[number(df, c) for c in names])
        # Complete rows skip the Python side of the expression's result.
        out = df.withColumn("_x", complete(x)) if steps else df.withColumn("_x", x)
        filled = {PREFIX + c: F.coalesce(number(df, c), F.get("_x", F.lit(i)), F.lit(float(means[i])))
                  for i, c in enumerate(names)}
        return out.withColumns(filled).drop("_x")


class DegreeTwo(FittedStage):
    """Add squares and products of the feature columns of one group."""

    def _transform(self, df: DataFrame) -> DataFrame:
        terms = degree_two_terms(self.state["columns"], self.state["interaction_only"])
        return df.withColumns({PREFIX + t: col(PREFIX + a) * col(PREFIX + b) for t, a, b in terms}) if terms else df


class Scale(Estimator):
    def __init__(self, columns: Sequence[str], kind: str, exact: bool = True) -> None:
        super().__init__()
        self.columns, self.kind, self.exact = list(columns), kind, exact

    def _fit(self, df: DataFrame) -> ScaleModel:
        factors = centre_and_scale(df, [PREFIX + c for c in self.columns], self.kind, exact=self.exact)
        return ScaleModel({"factors": {c: list(f) for c, f in factors.items()}})


class ScaleModel(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: scaled(col(c), *f) for c, f in self.state["factors"].items()})


class CategoryEncoder(Estimator):
    """Numbers for categories: onehot, label, frequency, target (smoothing 10) or smoothed_20.

    ``target_col`` names a numeric column for the target kinds. The table of codes is kept on the driver side
    only while it is small (counted first); a larger one is checkpointed.
    """

    SUFFIX = {"onehot": "", "label": "", "frequency": "_freq", "target": "_target_mean", "smoothed_20": "_catboost_enc"}

    def __init__(self, columns: Sequence[str], kind: str, *, inputs: Sequence[str] | None = None,
                 target_col: str | None = None, max_categories: int = 40, prefix: str = PREFIX) -> None:
        super().__init__()
        if kind not in self.SUFFIX:
            raise ValueError(f"Unknown encoding: {kind}")
        self.columns, self.kind, self.target_col, self.max_categories = list(columns), kind, target_col, max_categories
        self.inputs = list(inputs or columns)
        self.prefix = prefix

    def _fit(self, df: DataFrame) -> CategoryEncoderModel:
        target = None
        overall = 0.0
        if self.kind in {"target", "smoothed_20"}:
            if self.target_col is None:
                raise ValueError("The target encodings need a target column.")
            target = col(self.target_col)
            overall = float(df.agg(F.avg(target)).first()[0] or 0.0)
        stats = encoders.category_stats(df, self.inputs, target).persist()
        size = [F.count("*").alias("c"), F.sum("n").alias("t"), F.sum(F.octet_length("value")).alias("b")]
        sizes = {r["column"]: (int(r["c"]), int(r["t"]), int(r["b"])) for r in
                 stats.groupBy("column").agg(*size).collect()}
        largest = max((c for c, _, _ in sizes.values()), default=0)
        defaults = dict.fromkeys(self.inputs, 0.0)
        names: dict[str, list[str]] = {}
        if self.kind == "frequency":
            codes = encoders.frequency_table(stats)
        elif self.kind == "label":
            codes = encoders.label_table(stats, largest)
            defaults = dict.fromkeys(self.inputs, -1.0)
        elif self.kind == "onehot":
            codes = encoders.one_hot_table(stats, self.max_categories, largest)
            kept = codes.select("column", "code", "name").distinct().orderBy("column", "code").collect()
            for r in kept:  # at most ``max_categories`` per column
                names.setdefault(r["column"], []).append(r["name"])
            defaults = {c: float(len(names.get(c, []))) for c in self.inputs}
        else:
            smoothing = encoders.TARGET_SMOOTHING if self.kind == "target" else encoders.STRONG_SMOOTHING
            codes = encoders.target_mean_table(stats, smoothing, overall)
            defaults = dict.fromkeys(self.inputs, overall)
        codes = codes.select("column", "value", "n", "code")
        small = sum(c for c, _, _ in sizes.values()) <= LOCAL_CODES
        if small and sum(b for _, _, b in sizes.values()) <= LOCAL_BYTES:
            codes = df.sparkSession.createDataFrame(codes.collect(), codes.schema)
        else:
            codes = durable(codes)
        stats.unpersist()
        state = {
            "kind": self.kind, "inputs": self.inputs, "defaults": defaults, "names": names,
            "sizes": {c: list(sizes.get(c, (0, 0, 0))) for c in self.inputs},
            "outputs": [f"{self.prefix}{c}{self.SUFFIX[self.kind]}" + ("_index" if self.kind == "onehot" else "")
                        for c in self.columns],
        }
        return CategoryEncoderModel(state, {"codes": codes})


class CategoryEncoderModel(FittedStage):
    def _transform(self, df: DataFrame) -> DataFrame:
        codes, out = self.tables["codes"], df
        for k, (name, output) in enumerate(zip(self.state["inputs"], self.state["outputs"])):
            size, total, volume = self.state["sizes"][name]
            side = codes.filter(F.col("column") == name).select("value", "n", F.col("code").alias(f"_code{k}"))
            text = encoders.category_text(df, name)
            out = attach(out, side, text, [f"_code{k}"], lookup_rows=size, lookup_bytes=volume, total=total or None)
            code = F.coalesce(F.col(f"_code{k}"), F.lit(float(self.state["defaults"][name])))
            if self.state["kind"] == "onehot":
                # One extra value stands for unseen categories; the vector leaves it out.
                values = [*self.state["names"].get(name, []), "__unseen__"]
                code = code.alias(output, metadata={"ml_attr": {"type": "nominal", "vals": values}})
                out = out.select(*[col(c) for c in out.columns if c not in {output, f"_code{k}"}], code)
            else:
                out = out.withColumn(output, code).drop(f"_code{k}")
        return out
