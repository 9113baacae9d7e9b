"""CSV files of unknown encoding, with short and over-long rows and many spellings of missing."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.columns import col

LOG = logging.getLogger(__name__)

# The texts that read as missing.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)
MAY_BE_NUMBER = r"(?s)^[\x00-\x20]*[+-]?(?:[0-9.]+(?:[eE][+-]?[0-9]+)?[dDfF]?|0[xX].*|[iI][nN][fF].*|[nN][aA][nN].*)[\x00-\x20]*$"
"""Every text that Spark casts to a double, and few others."""
MAY_BE_INTEGER = r"^[\x00-\x20\x7F-\x9F]*[+-]?[0-9]+[\x00-\x20\x7F-\x9F]*$"
"""Every text without a point that Spark casts to a bigint, and few others."""


class TableLoadError(ValueError):
    """The files cannot be read as a table."""


def files_not_utf8(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Files with a line that is no valid UTF-8.

    Files are tested line by line in splits inside the JVM, so a file of any size is read in parallel.
    """
    lines = spark.read.text(list(paths)).filter(~F.is_valid_utf8("value"))
    return sorted(r["path"] for r in lines.select(F.input_file_name().alias("path")).distinct().collect())


def file_encodings(spark: SparkSession, path: str | Sequence[str]) -> dict[str, str]:
    """Encoding -> paths: UTF-8 where every line decodes, otherwise Latin-1, which reads any byte."""
    paths = [path] if isinstance(path, str) else list(path)
    odd = files_not_utf8(spark, paths)
    if not odd:
        return {"UTF-8": paths}
    plain = {unquote(p): p for p in spark.read.text(paths).inputFiles()}
    rest = sorted(p for q, p in plain.items() if q not in {unquote(o) for o in odd})
    return ({"UTF-8": rest} if rest else {}) | {"ISO-8859-1": odd}


def files_with_breaks(spark: SparkSession, paths: Sequence[str]) -> set[str]:
    """Files with a line that a quoted field leaves open. Only these must be read whole, not in splits."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(list(paths)).filter(quotes % 2 == 1)
    return {unquote(r["path"]) for r in lines.select(F.input_file_name().alias("path")).distinct().collect()}


def check_headers(spark: SparkSession, paths: Sequence[str]) -> None:
    """All files begin with the same line."""
    lines = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    first = lines.filter("block = 0").groupBy("path").agg(F.min_by("value", "at").alias("value"))
    first = first.withColumn("value", F.regexp_replace("value", "^\ufeff|\r$", ""))
    found = [r["value"] for r in first.select("value").distinct().limit(2).collect()]
    if len(found) > 1:
        raise TableLoadError(f"The files begin with different headers: {found[0]!r} and {found[1]!r}.")


def _header(spark: SparkSession, path: str, encoding: str, breaks: bool) -> list[str]:
    first = spark.read.csv(path, header=False, encoding=encoding, quote='"', escape='"', multiLine=breaks).limit(1).collect()
    if not first:
        raise TableLoadError(f"Could not parse dataset: no header in {path}")
    names: list[str] = []
    for i, v in enumerate(first[0]):
        name = f"Unnamed: {i}" if v is None or v == "" else str(v).lstrip("﻿")
        seen = sum(1 for n in names if n == name or n.startswith(f"{name}."))
        names.append(f"{name}.{seen}" if name in names else name)
    return names


def _read_texts(spark: SparkSession, paths: Sequence[str], names: Sequence[str], encoding: str, breaks: bool,
                overlong: bool = False) -> DataFrame:
    """All columns as text. Rows with too many fields are left out, short rows are padded.

    ``overlong``: the text of the rows that are left out instead. The reader keeps the text of every row whose length differs from the header; the delimiters
    outside quotes tell the short ones from the long ones.
    """
    fields = [T.StructField(n, T.StringType()) for n in [*names, "_c"]]
    raw = spark.read.csv(
        list(paths), schema=T.StructType(fields), header=True, enforceSchema=True, encoding=encoding, mode="PERMISSIVE",
        columnNameOfCorruptRecord="_c", quote='"', escape='"', multiLine=breaks,
    )
    bare = F.regexp_replace("_c", '"(?:[^"]|"")*"', "")
    delimiters = F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))
    # The reader refuses a query that uses nothing but the text of the row, as a plain count would.
    # It must also use every column: with fewer, the parser stops early and takes a long row for a good one.
    parsed = F.length(F.concat_ws("", *[col(n) for n in names])) >= 0
    if overlong:
        return raw.filter(F.col("_c").isNotNull() & (delimiters >= len(names)) & parsed).select(F.col("_c").alias("row"))
    kept = raw.filter((F.col("_c").isNull() | (delimiters < len(names))) & parsed)
    return kept.select(*[col(n) for n in names])


def infer_types(df: DataFrame) -> DataFrame:
    """Give text columns the narrowest type all their values have: bigint, double, boolean, or text.

    One scan tests every column against every type.
    """
    # A cast that fails costs a Java exception for every value: only what may be a number is cast.
    tests = {
        "bigint": lambda x: F.when(x.rlike(MAY_BE_INTEGER), x.try_cast("bigint").isNotNull()).otherwise(False),
        "double": lambda x: F.when(x.rlike(MAY_BE_NUMBER), x.try_cast("double").isNotNull() & ~F.lower(x).rlike("[df]$")).otherwise(False),
        "boolean": lambda x: x.isin("True", "False", "TRUE", "FALSE", "true", "false"),
    }
    aggs = []
    for c in df.columns:
        aggs.append(F.count(col(c)))
        present = [F.when(col(c).isNotNull(), test(F.trim(col(c)))) for test in tests.values()]
        aggs += [F.coalesce(F.min(p), F.lit(True)) for p in present]
    got = df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    step, out = len(tests) + 1, []
    for i, c in enumerate(df.columns):
        filled, *fits = got[step * i : step * (i + 1)]
        kind = next((k for k, ok in zip(tests, fits) if ok), "string") if filled else "double"
        text = F.trim(col(c))
        out.append((col(c) if kind == "string" else text.try_cast(kind)).alias(c))
    return df.select(*out)


def _groups(spark: SparkSession, path: str | Sequence[str], encoding: str | None) -> list[tuple[str, bool, list[str]]]:
    """(encoding, has line breaks in fields, files) of the files that are read alike."""
    paths = [path] if isinstance(path, str) else list(path)
    groups = file_encodings(spark, paths) if encoding is None else {encoding: paths}
    out = []
    for enc, members in groups.items():
        check_headers(spark, members)
        broken = files_with_breaks(spark, members)
        if not broken:
            out.append((enc, False, members))
            continue
        files = sorted(spark.read.text(members).inputFiles())
        plain = [f for f in files if unquote(f) not in broken]
        out += [(enc, True, [f for f in files if unquote(f) in broken])] + ([(enc, False, plain)] if plain else [])
    return out


def overlong_rows(spark: SparkSession, path: str | Sequence[str], *, encoding: str | None = None) -> DataFrame:
    """(row): the rows that ``read_csv`` leaves out because they have more fields than the header."""
    parts = [_read_texts(spark, m, _header(spark, m[0], enc, breaks), enc, breaks, overlong=True)
             for enc, breaks, m in _groups(spark, path, encoding)]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    return table


def read_csv(
    spark: SparkSession, path: str | Sequence[str], *, infer: bool = True, encoding: str | None = None, report: bool = False
) -> DataFrame:
    """CSV files with one header, as a typed table. Quotes are doubled inside quoted fields, which may hold line breaks.

    ``encoding`` skips the test of the encodings, ``infer=False`` leaves all columns as text; ``report`` counts the rows
    that are left out for too many fields and logs a warning.
    """
    names: list[str] | None = None
    table: DataFrame | None = None
    for enc, breaks, members in _groups(spark, path, encoding):
        header = _header(spark, members[0], enc, breaks)
        if names is not None and header != names:
            raise TableLoadError(f"The files have different headers: {names} and {header}.")
        names = header
        part = _read_texts(spark, members, names, enc, breaks)
        table = part if table is None else table.unionByName(part)
    if report and (skipped := overlong_rows(spark, path, encoding=encoding).count()):
        LOG.warning("%d rows of %s have more fields than the header and were left out", skipped, path)
    missing = [t for t in MISSING_TOKENS]
    table = table.select(*[F.when(~col(c).isin(missing), col(c)).alias(c) for c in names])
    return infer_types(table) if infer else table
