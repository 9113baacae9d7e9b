"""Arguments of a run, with their accepted ranges."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any

from tabsmith.operators.cleaning import CleaningRequest
from tabsmith.operators.scalers import SCALERS
from tabsmith.plans.preprocess import ENCODINGS, MISSING_STRATEGIES, PER_COLUMN_STRATEGIES, PreprocessorConfig
from tabsmith.plans.registry import TASKS

# Option names and accepted ranges.
OUTLIERS = ("None", "Clip (Winsorize)", "IQR Removal")
MODES = ("Train/Test Split", "Cross Validation")
RANGES = {
    "drop_column_threshold": (0.3, 0.95),
    "one_hot_max_categories": (5, 200),
    "winsor_lower_quantile": (0.0, 0.1),
    "winsor_upper_quantile": (0.9, 1.0),
    "iqr_multiplier": (1.0, 3.0),
    "train_size": (0.70, 0.95),
    "cv_folds": (2, 10),
    "n_clusters": (2, 12),
    "tuning_iterations": (1, 50),
}
CHOICES = {
    "task": TASKS,
    "missing_strategy": tuple(MISSING_STRATEGIES),
    "encoding_strategy": tuple(ENCODINGS),
    "scaling_strategy": SCALERS,
    "outlier_strategy": OUTLIERS,
    "evaluation_mode": MODES,
}


@dataclass(frozen=True)
class RunSpec:
    """Everything a run of the workbench needs besides the table.

    ``key`` names one integer column that identifies the rows; without it the rows are numbered once and
    checkpointed. ``model_params`` maps a model name to parameters that replace its defaults. Clusterings are ranked by
    the squared silhouette, whatever their size; ``exact_silhouette`` adds the Euclidean one, whose work grows with the
    square of the rows. ``max_classes`` refuses targets with more classes; unset, there is no limit.
    ``early_stopping`` lets boosting stop when a held-back tenth of the training rows no longer improves for
    ``EARLY_ROUNDS`` rounds, unless ``model_params`` say otherwise.
    """

    features: list[str]
    target: str | None = None
    task: str = "Classification"
    key: str | None = None
    models: list[str] = field(default_factory=list)
    model_params: dict[str, dict[str, Any]] = field(default_factory=dict)
    missing_strategy: str = "Median"
    drop_column_threshold: float = 0.7
    constant_fill_value: str = "missing"
    encoding_strategy: str = "OneHotEncoder"
    one_hot_max_categories: int = 40
    scaling_strategy: str = "None"
    remove_duplicates: bool = False
    outlier_strategy: str = "None"
    winsor_lower_quantile: float = 0.01
    winsor_upper_quantile: float = 0.99
    iqr_multiplier: float = 1.5
    use_polynomial_features: bool = False
    interaction_only: bool = False
    per_column_missing_strategy: dict[str, str] = field(default_factory=dict)
    evaluation_mode: str = "Train/Test Split"
    train_size: float = 0.8
    cv_folds: int = 5
    stratify: bool = True
    n_clusters: int = 3
    tuning: bool = False
    tuning_iterations: int = 25
    early_stopping: bool = True
    permutation_importance: bool = False
    seed: int = 42
    exact_quantiles: bool = True
    exact_silhouette: bool = False
    max_classes: int | None = None

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {getattr(self, name)!r}.")
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}; got {getattr(self, name)}.")
        for column, strategy in self.per_column_missing_strategy.items():
            if strategy not in PER_COLUMN_STRATEGIES:
                raise ValueError(f"Unknown strategy {strategy!r} for column {column!r}.")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    @classmethod
    def from_dict(cls, record: dict[str, Any]) -> RunSpec:
        return cls(**record)

    def cleaning(self) -> CleaningRequest:
        names = [f for f in CleaningRequest.__dataclass_fields__ if f in self.__dataclass_fields__ and f != "key"]
        return CleaningRequest(**{n: getattr(self, n) for n in names}, key=[self.key] if self.key else [])

    def preprocessing(self) -> PreprocessorConfig:
        names = [f for f in PreprocessorConfig.__dataclass_fields__ if f in self.__dataclass_fields__]
        return PreprocessorConfig(**{n: getattr(self, n) for n in names})
