"""Per-column centre and scale, and degree-two terms."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations, combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import number
from tabsmith.operators.quantiles import quantiles

SCALERS = ("None", "StandardScaler", "MinMaxScaler", "RobustScaler")


def centre_and_scale(
    df: DataFrame, names: Sequence[str], kind: str, *, exact: bool = True
) -> dict[str, tuple[float, float]]:
    """Column -> (centre, scale); a column without spread gets scale 1, one without values (0, 1).

    StandardScaler: mean and population deviation. MinMaxScaler: minimum and range. RobustScaler:
    median and interquartile range.
    """
    names = list(names)
    if kind not in SCALERS:
        raise ValueError(f"Unknown scaler: {kind}")
    if not names or kind == "None":
        return {c: (0.0, 1.0) for c in names}
    if kind == "RobustScaler":
        cuts = quantiles(df, names, [0.25, 0.5, 0.75], exact=exact)
        pairs = {c: (q[1], None if q[0] is None else q[2] - q[0]) for c, q in cuts.items()}
    else:
        aggs = []
        for c in names:
            x = number(df, c)
            aggs += [F.avg(x), F.stddev_pop(x)] if kind == "StandardScaler" else [F.min(x), F.max(x) - F.min(x)]
        got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
        pairs = {c: (got[2 * i], got[2 * i + 1]) for i, c in enumerate(names)}
    result = {}
    for c, (centre, scale) in pairs.items():
        centre = 0.0 if centre is None else float(centre)
        # A deviation of rounding size around a constant is no spread.
        flat = scale is None or abs(scale) <= 1e-12 * max(abs(centre), 1e-300)
        result[c] = (centre, 1.0 if flat else float(scale))
    return result


def scaled(x: Column, centre: float, scale: float) -> Column:
    return (x - F.lit(centre)) / F.lit(scale)


def scale_columns(df: DataFrame, factors: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: scaled(number(df, c), *f) for c, f in factors.items()}) if factors else df


def degree_two_terms(names: Sequence[str], interaction_only: bool = False) -> list[tuple[str, str, str]]:
    """(term, a, b) in order: ``a^2`` for squares, ``a b`` for products."""
    pairs = combinations(names, 2) if interaction_only else combinations_with_replacement(names, 2)
    return [(f"{a}^2" if a == b else f"{a} {b}", a, b) for a, b in pairs]


def add_degree_two(df: DataFrame, names: Sequence[str], interaction_only: bool = False) -> tuple[DataFrame, list[str]]:
    """(table with the product terms, names of the columns followed by the terms)."""
    terms = degree_two_terms(list(names), interaction_only)
    out = df.withColumns({t: number(df, a) * number(df, b) for t, a, b in terms}) if terms else df
    return out, [*names, *[t for t, _, _ in terms]]


