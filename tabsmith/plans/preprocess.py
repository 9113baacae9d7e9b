"""Preprocessing plan: impute, expand and scale numbers, impute and encode categories, assemble a vector."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame

from tabsmith.functions.columns import refuse_nested, split_by_type
from tabsmith.operators.scalers import degree_two_terms
from tabsmith.plans.stages import (
    PREFIX,
    CategoryEncoder,
    ChainedFill,
    DegreeTwo,
    NeighbourFill,
    NeighbourFillModel,
    Scale,
    ValueFill,
)
from tabsmith.session import durable

FEATURES = "_features"

# Option names users choose from.
MISSING_STRATEGIES = [
    "Mean", "Median", "Mode", "Constant", "KNNImputer", "IterativeImputer", "Drop rows", "Drop columns",
]
ENCODINGS = {
    "OneHotEncoder": "onehot", "LabelEncoder": "label", "FrequencyEncoding": "frequency",
    "TargetEncoding": "target", "CatBoostEncoding": "smoothed_20",
}
PER_COLUMN_STRATEGIES = ["Default", "Mean", "Median", "Mode", "Constant"]


@dataclass(frozen=True)
class PreprocessorConfig:
    missing_strategy: str = "Median"
    encoding_strategy: str = "OneHotEncoder"
    scaling_strategy: str = "None"
    constant_fill_value: str = "missing"
    one_hot_max_categories: int = 40
    use_polynomial_features: bool = False
    interaction_only: bool = False
    per_column_missing_strategy: dict[str, str] = field(default_factory=dict)
    exact_quantiles: bool = True

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, record: Mapping) -> PreprocessorConfig:
        known = {f: record[f] for f in cls.__dataclass_fields__ if f in record}
        return cls(**known)


def group_by_strategy(columns: Sequence[str], default: str, overrides: Mapping[str, str]) -> dict[str, list[str]]:
    """Strategy -> columns, in order of first use; an override counts unless it says Default."""
    groups: dict[str, list[str]] = {}
    for c in columns:
        chosen = overrides.get(c, "Default")
        groups.setdefault(default if chosen == "Default" else chosen, []).append(c)
    return groups


def numeric_fill(strategy: str, columns: Sequence[str], config: PreprocessorConfig) -> Estimator:
    if strategy == "KNNImputer":
        return NeighbourFill(columns, k=5)
    if strategy == "IterativeImputer":
        return ChainedFill(columns, rounds=10)
    kind = {"Drop rows": "None", "Drop columns": "Median"}.get(strategy, strategy)
    kind = kind if kind in {"None", "Mean", "Median", "Mode", "Constant"} else "Median"
    return ValueFill(columns, kind, config.constant_fill_value, config.exact_quantiles)


def categorical_fill(strategy: str, columns: Sequence[str], config: PreprocessorConfig) -> Estimator:
    kind = {"Drop rows": "None", "Constant": "Constant"}.get(strategy, "Mode")
    return ValueFill(columns, kind, config.constant_fill_value)


class Preprocessor(Estimator):
    """Fits all stages on one table and returns a ``PipelineModel`` that adds the vector ``_features``.

    Polynomial terms and neighbour or chained filling work within one group of columns that share a
    strategy. ``target_col`` is the numeric target for target encodings.
    """

    def __init__(self, features: Sequence[str], config: PreprocessorConfig, target_col: str | None = None) -> None:
        super().__init__()
        self.features, self.config, self.target_col = list(features), config, target_col

    def _fit(self, df: DataFrame) -> PipelineModel:
        config = self.config
        refuse_nested(df, [c for c in self.features if c in df.columns])
        numeric, categorical = split_by_type(df, self.features)
        if not numeric and not categorical:
            raise ValueError(f"None of {len(self.features)} features can be used as a number or a category.")
        stages, inputs, current = [], [], df

        def add(stage: Estimator | object) -> object:
            nonlocal current
            model = stage.fit(current) if isinstance(stage, Estimator) else stage
            stages.append(model)
            current = model.transform(current)
            if isinstance(model, NeighbourFillModel):
                current = durable(current)  # later stages must not repeat the search
            return model

        overrides = config.per_column_missing_strategy
        for strategy, columns in group_by_strategy(numeric, config.missing_strategy, overrides).items():
            kept = add(numeric_fill(strategy, columns, config)).state["columns"]
            if not kept:
                continue
            if config.use_polynomial_features:
                add(DegreeTwo({"columns": kept, "interaction_only": config.interaction_only}))
                kept = [*kept, *[t for t, _, _ in degree_two_terms(kept, config.interaction_only)]]
            if config.scaling_strategy != "None":
                add(Scale(kept, config.scaling_strategy, config.exact_quantiles))
            inputs += [PREFIX + c for c in kept]
        kind = ENCODINGS.get(config.encoding_strategy, "label")
        for strategy, columns in group_by_strategy(categorical, config.missing_strategy, overrides).items():
            kept = add(categorical_fill(strategy, columns, config)).state["columns"]
            encoder = CategoryEncoder(
                kept, kind, inputs=[PREFIX + c for c in kept], target_col=self.target_col,
                max_categories=config.one_hot_max_categories,
            )
            outputs = add(encoder).state["outputs"]
            if kind == "onehot":
                vectors = [o.removesuffix("_index") + "_onehot" for o in outputs]
                add(OneHotEncoder(inputCols=outputs, outputCols=vectors, dropLast=True))
                outputs = vectors
            inputs += outputs
        if not inputs:
            raise ValueError(f"None of {len(self.features)} features can be used as a number or a category.")
        add(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
        return PipelineModel(stages)


def feature_names(df: DataFrame) -> list[str]:
    """Names of the vector slots, without the internal prefix."""
    attrs = df.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    slots = sorted((a["idx"], a.get("name", str(a["idx"]))) for kind in attrs.values() for a in kind)
    return [n.removeprefix(PREFIX).replace("_onehot_", "_", 1) for _, n in slots]
