"""Column predicates by type and the scalar expressions that the operators share."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """Column by exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and day-time intervals; booleans are not numbers."""
    return isinstance(dtype, (T.NumericType, T.DayTimeIntervalType))


def is_number_or_flag(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.NumericType, T.DayTimeIntervalType, T.BooleanType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, TEMPORAL)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def numeric_columns(df: DataFrame, names: Iterable[str] | None = None) -> list[str]:
    names = df.columns if names is None else names
    return [c for c in names if is_numeric(type_of(df, c))]


def split_by_type(df: DataFrame, features: Iterable[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical) features in the given order; unknown names are left out."""
    present = [f for f in features if f in df.columns]
    numeric = numeric_columns(df, present)
    return numeric, [f for f in present if f not in set(numeric)]


def select_known(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Names that exist in the table, each once, in the given order."""
    known = set(df.columns)
    return [c for c in dict.fromkeys(names) if c in known]


def refuse_nested(df: DataFrame, names: Sequence[str]) -> None:
    bad = [c for c in names if is_nested(type_of(df, c))]
    if bad:
        raise ValueError(f"Nested columns cannot be features: {', '.join(bad)}")


def number(df: DataFrame, name: str) -> Column:
    """The column as a double, NaN as null."""
    dtype = type_of(df, name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        x = col(name).cast("double")
        return F.when(~F.isnan(x), x)
    if isinstance(dtype, T.DayTimeIntervalType):
        parts = {"DAY": 86400.0, "HOUR": 3600.0, "MINUTE": 60.0, "SECOND": 1.0}
        return sum(F.extract(F.lit(unit), col(name)).cast("double") * secs for unit, secs in parts.items())
    return col(name).cast("double")


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Date or timestamp as microseconds since the epoch."""
    return F.unix_micros(col(name).cast("timestamp"))


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    test = col(name).isNull()
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        test = test | F.isnan(col(name))
    return test


def nan_to_null(df: DataFrame) -> DataFrame:
    """Fold NaN into null in every floating column, so one test covers both."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def as_text(df: DataFrame, name: str) -> Column:
    """Text form for counting: one text per distinct value; negative zero reads as zero."""
    if isinstance(type_of(df, name), (T.DoubleType, T.FloatType)):
        x = col(name)
        return F.when(~F.isnan(x), x + F.lit(0.0)).cast("string")
    if is_nested(type_of(df, name)):
        return F.to_json(F.struct(col(name)))
    return col(name).cast("string")


def to_number(x: Column) -> Column:
    """Numeric reading of any column; what does not read as a number becomes null."""
    value = x.try_cast("double")
    return F.when(~F.isnan(value), value)


def clip(x: Column, low, high) -> Column:
    """Bound a value; nulls stay null (``least``/``greatest`` alone would turn them into a bound)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(high)), F.lit(low)))


def fill(x: Column, value) -> Column:
    return x if value is None else F.coalesce(x, F.lit(value))


def typed_constant(text: str, dtype: T.DataType):
    """Fill constant in the type of the column; an error where the text is no such value."""
    try:
        if isinstance(dtype, T.IntegralType):
            return int(text)
        if isinstance(dtype, (T.NumericType, T.DayTimeIntervalType)):
            return float(text)
    except ValueError as exc:
        raise ValueError(f"Fill constant {text!r} is no value of type {dtype.simpleString()}.") from exc
    if isinstance(dtype, T.BooleanType):
        if text.lower() not in {"true", "false"}:
            raise ValueError(f"Fill constant {text!r} is no boolean.")
        return text.lower() == "true"
    return text


def hash_text(key: Sequence[str], seed: int = 42) -> Column:
    """Repeatable pseudo-random text per row key: the order by it is a shuffle of the rows."""
    parts = [F.coalesce(col(k).cast("string"), F.lit("\\0")) for k in key]  # a null marks its place
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


