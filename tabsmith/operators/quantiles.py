"""Exact quantiles (linear interpolation) for every column at once.

Spark's ``percentile`` keeps all distinct values of a column in one buffer. That is the quickest way
while a column has few rows, and it cannot work on a huge continuous column. Above ``direct_rows``
rows the wanted ranks are therefore selected by narrowing: each round scans the table twice, guesses
an interval from the approximate sketch, counts exactly how many rows lie below, on and between its
ends, and keeps the open interval that holds the rank. No round shuffles rows, and the counts make
the result exact whatever the sketch returned.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.columns import number

DIRECT_ROWS = 1_000_000
SKETCH = 10_000


@dataclass
class _Rank:
    """Search state for one rank of one column: the row sits in the open interval (low, high)."""

    column: str
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def within(self, x: Column) -> Column:
        test = x.isNotNull()
        if self.low is not None:
            test = test & (x > self.low)
        if self.high is not None:
            test = test & (x < self.high)
        return test

    @property
    def share(self) -> float:
        return (self.rank - self.below) / (self.inside - 1) if self.inside > 1 else 0.0


def _as_columns(df: DataFrame, columns) -> dict[str, Column]:
    return dict(columns) if isinstance(columns, Mapping) else {c: number(df, c) for c in columns}


def quantiles(
    df: DataFrame,
    columns: Mapping[str, Column] | Sequence[str],
    probabilities: Sequence[float],
    *,
    exact: bool = True,
    direct_rows: int = DIRECT_ROWS,
) -> dict[str, list[float | None]]:
    """Column name -> value per probability, ``None`` for a column without values.

    The answer is small: columns times probabilities. ``exact=False`` takes Spark's sketch.
    """
    exprs = _as_columns(df, columns)
    if not exprs:
        return {}
    probs = [float(p) for p in probabilities]
    names = list(exprs)
    table = df.select(*[exprs[c].alias(f"c{i}") for i, c in enumerate(names)])
    alias = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    if not exact:
        row = table.agg(*[F.percentile_approx(alias[c], probs, SKETCH).alias(f"q{i}") for i, c in enumerate(names)])
        got = row.first()
        return {c: list(got[i] or [None] * len(probs)) for i, c in enumerate(names)}

    counted = table.agg(*[F.count(alias[c]) for c in names]).first()
    rows = {c: int(counted[i]) for i, c in enumerate(names)}
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in names}
    direct = [c for c in names if 0 < rows[c] <= direct_rows]
    if direct:
        got = table.agg(*[F.percentile(alias[c], F.array(*map(F.lit, probs))) for c in direct]).first()
        for i, c in enumerate(direct):
            result[c] = list(got[i])
    large = [c for c in names if rows[c] > direct_rows]
    if large:
        wanted = {(c, r) for c in large for p in probs for r in _ranks(p, rows[c])}
        values = _select_ranks(table, alias, [_Rank(c, r, rows[c]) for c, r in sorted(wanted)], direct_rows)
        for c in large:
            result[c] = [_interpolate(p, rows[c], c, values) for p in probs]
    return result


def _ranks(p: float, n: int) -> tuple[int, int]:
    position = p * (n - 1)
    return math.floor(position), math.ceil(position)


def _interpolate(p: float, n: int, column: str, values: dict[tuple[str, int], float]) -> float:
    low, high = _ranks(p, n)
    a, b = values[column, low], values[column, high]
    weight = p * (n - 1) - low
    return a if a == b else a * (1 - weight) + b * weight


def _select_ranks(
    table: DataFrame, alias: dict[str, Column], ranks: list[_Rank], direct_rows: int
) -> dict[tuple[str, int], float]:
    """Value at each zero-based rank."""
    while True:
        active = [r for r in ranks if r.value is None]
        if not active:
            return {(r.column, r.rank): r.value for r in ranks}
        # Ranks that search the same rows share one sketch, those with the same guess one set of counts.
        searched: dict[tuple, list[_Rank]] = {}
        for r in active:
            searched.setdefault((r.column, r.low, r.high), []).append(r)
        guesses = table.agg(*[_guess(some, alias[key[0]], direct_rows) for key, some in searched.items()]).first()
        open_ones: dict[tuple, list[_Rank]] = {}
        for some, guess in zip(searched.values(), guesses):
            for i, r in enumerate(some):
                if r.inside <= direct_rows:
                    r.value = float(guess[i])
                else:
                    a, b = float(guess[2 * i]), float(guess[2 * i + 1])
                    open_ones.setdefault((r.column, r.low, r.high, a, b), []).append(r)
        if not open_ones:
            continue
        counts = []
        for (column, _, _, a, b), some in open_ones.items():
            x = alias[column]
            inside = some[0].within(x)
            counts += [
                F.count_if(inside & (x < a)),
                F.count_if(inside & (x == a)),
                F.count_if(inside & (x > a) & (x < b)),
                F.count_if(inside & (x == b)) if b > a else F.lit(0).cast("bigint"),
            ]
        got = table.agg(*[c.alias(f"n{i}") for i, c in enumerate(counts)]).first()
        for i, ((_, _, _, a, b), some) in enumerate(open_ones.items()):
            for r in some:
                _narrow(r, a, b, [int(n) for n in got[4 * i : 4 * i + 4]])


def _guess(ranks: list[_Rank], x: Column, direct_rows: int) -> Column:
    """The values of ranks among the same rows, or two ends around each where these are many."""
    inside = F.when(ranks[0].within(x), x)
    if ranks[0].inside <= direct_rows:
        return F.percentile(inside, F.array(*[F.lit(r.share) for r in ranks]))
    slack = 2.0 / SKETCH
    return F.percentile_approx(inside, [end for r in ranks for end in (max(r.share - slack, 0.0), min(r.share + slack, 1.0))], SKETCH)


def _narrow(r: _Rank, a: float, b: float, counts: list[int]) -> None:
    less, at_a, between, at_b = counts
    offset = r.rank - r.below
    if offset < less:
        r.high, r.inside = a, less
    elif offset < less + at_a:
        r.value = a
    elif offset < less + at_a + between:
        r.low, r.high, r.inside, r.below = a, b, between, r.below + less + at_a
    elif offset < less + at_a + between + at_b:
        r.value = b
    else:
        passed = less + at_a + between + at_b
        r.low, r.inside, r.below = b, r.inside - passed, r.below + passed
