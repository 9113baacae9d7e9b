"""Profiles, correlations and chart data."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tabsmith.functions.columns import numeric_columns
from tabsmith.operators import charts, correlation, counts, profile, quantiles, sampling
from tabsmith.queries.base import (
    CUSTOMER,
    DOCUMENTS,
    EVENTS,
    GAPS,
    GAPS_SQL,
    LINEITEM,
    LINEITEM_NUMBERS,
    ORDERS,
    PART,
    Catalog,
    gappy_lineitem,
    load,
    r,
    rounded,
    union,
)
from tabsmith.session import TASK_ROWS

CATALOG = Catalog()
query = CATALOG.query


def _overview_sql(source: str, columns: list[str]) -> str:
    return union([
        f"SELECT {i}::INT AS position, '{c}' AS \"column\", (count(*) - count({c}))::BIGINT AS missing_values, "
        f"round_even((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_pct, "
        f"count(DISTINCT {c})::BIGINT AS n_unique FROM ({source}) t"
        for i, c in enumerate(columns)
    ])


def _register_overview(name: str, table: str, columns: list[str]) -> None:
    @query(name, _overview_sql(f"SELECT * FROM {table}", columns))
    def run(spark, sf_dir):
        return profile.overview(load(spark, sf_dir, table)).drop("dtype")


for _table, _columns in (("lineitem", LINEITEM), ("orders", ORDERS), ("events", EVENTS), ("documents", DOCUMENTS),
                         ("customer", CUSTOMER), ("part", PART)):
    _register_overview(f"overview_{_table}", _table, _columns)


@query("overview_lineitem_gaps", _overview_sql(GAPS_SQL, list(GAPS)))
def overview_lineitem_gaps(spark, sf_dir):
    return profile.overview(gappy_lineitem(spark, sf_dir)).drop("dtype")


@query("table_shape_lineitem", "SELECT count(*)::BIGINT AS rows, 11::BIGINT AS columns FROM lineitem")
def table_shape_lineitem(spark, sf_dir):
    return profile.table_shape(load(spark, sf_dir, "lineitem"))


@query("column_info_lineitem_gaps", union([
    f"SELECT {i}::INT AS position, '{c}' AS \"column\", count({c})::BIGINT AS non_null FROM ({GAPS_SQL}) t"
    for i, c in enumerate(GAPS)
]))
def column_info_lineitem_gaps(spark, sf_dir):
    return profile.column_info(gappy_lineitem(spark, sf_dir)).drop("dtype")


# Names of the types in SQL's words and in Spark's.
_TYPE_NAMES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "TIMESTAMP": "timestamp_ntz"}
_TYPE_SQL = "CASE any_value(typeof({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPE_NAMES.items()) + " END"


@query("dtype_summary_lineitem", "SELECT dtype, count(*)::BIGINT AS count, sum(n)::BIGINT AS values FROM ("
       + union([f"SELECT {_TYPE_SQL.format(c=c)} AS dtype, count({c}) AS n FROM lineitem" for c in LINEITEM]) + ") t GROUP BY 1")
def dtype_summary_lineitem(spark, sf_dir):
    """Columns of each type, and the values that they hold."""
    df = load(spark, sf_dir, "lineitem")
    held = profile.column_info(df).groupBy("dtype").agg(F.sum("non_null").alias("values"))
    return profile.dtype_summary(df).join(held, "dtype").select("dtype", "count", "values")


_STATS = ["mean", "std", "min", "p25", "p50", "p75", "max"]
_MOMENTS = ["mean_ts", "min_ts", "p25_ts", "p50_ts", "p75_ts", "max_ts"]


def _describe_sql(table: str, numbers: list[str], classes: list[str], times: list[str], order: list[str]) -> str:
    parts = []
    none = ", ".join(f"NULL::DOUBLE AS {s}" for s in _STATS)
    no_times = ", ".join(f"NULL::BIGINT AS {m}" for m in _MOMENTS)
    no_class = "NULL::BIGINT AS \"unique\", NULL::VARCHAR AS top, NULL::BIGINT AS freq"
    for c in order:
        head = f"SELECT {order.index(c)}::INT AS position, '{c}' AS \"column\", count({c})::BIGINT AS count"
        if c in numbers:
            x = f"{c}::DOUBLE"
            cells = [f"avg({x})", f"stddev_samp({x})", f"min({x})", f"quantile_cont({x}, 0.25)", f"quantile_cont({x}, 0.5)",
                     f"quantile_cont({x}, 0.75)", f"max({x})"]
            stats = ", ".join(f"{r(e)} AS {s}" for e, s in zip(cells, _STATS))
            parts.append(f"{head}, {no_class}, {stats}, {no_times} FROM {table}")
        elif c in times:
            x = f"epoch_us({c})"
            cells = [f"avg({x})", f"min({x})", f"quantile_cont({x}::DOUBLE, 0.25)", f"quantile_cont({x}::DOUBLE, 0.5)",
                     f"quantile_cont({x}::DOUBLE, 0.75)", f"max({x})"]
            stats = ", ".join(f"round({e} / 1e6)::BIGINT AS {m}" for e, m in zip(cells, _MOMENTS))
            parts.append(f"{head}, {no_class}, {none}, {stats} FROM {table}")
        else:
            best = f"(SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, v LIMIT 1)"
            parts.append(
                f"{head}, count(DISTINCT {c})::BIGINT AS \"unique\", (SELECT v FROM {best}) AS top, "
                f"(SELECT n FROM {best})::BIGINT AS freq, {none}, {no_times} FROM {table}"
            )
    return union(parts)


def _describe(df):
    seconds = {m: F.round(F.unix_micros(m) / 1e6).cast("bigint") for m in _MOMENTS}
    return rounded(profile.describe(df).withColumns(seconds))


@query("describe_lineitem", _describe_sql("lineitem", LINEITEM_NUMBERS, ["l_returnflag", "l_linestatus"], ["l_shipdate"], LINEITEM))
def describe_lineitem(spark, sf_dir):
    return _describe(load(spark, sf_dir, "lineitem"))


@query("describe_orders", _describe_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"],
                                        ["o_orderstatus", "o_orderpriority"], ["o_orderdate"], ORDERS))
def describe_orders(spark, sf_dir):
    return _describe(load(spark, sf_dir, "orders"))


@query("describe_documents", _describe_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"], [], DOCUMENTS))
def describe_documents(spark, sf_dir):
    return _describe(load(spark, sf_dir, "documents"))


_WIDTHS = {"BIGINT": 8, "INTEGER": 4, "DOUBLE": 8, "TIMESTAMP": 8}
_ORDER_TYPES = ["BIGINT", "BIGINT", "VARCHAR", "DOUBLE", "TIMESTAMP", "VARCHAR"]


@query("memory_estimate_orders", union([
    f"SELECT '{c}' AS \"column\", "
    + (f"(count(*) * {_WIDTHS[t]})::BIGINT" if t in _WIDTHS else f"sum(strlen({c}))::BIGINT") + " AS bytes FROM orders"
    for c, t in zip(ORDERS, _ORDER_TYPES)
]))
def memory_estimate_orders(spark, sf_dir):
    return profile.memory_estimate(load(spark, sf_dir, "orders")).select("column", "bytes")


@query("fingerprint_lineitem", "SELECT count(*)::BIGINT AS rows, true AS same_in_any_order, true AS differs_by_a_cell, true AS differs_by_a_row FROM lineitem")
def fingerprint_lineitem(spark, sf_dir):
    """Equal for the same rows in another order; unequal once a cell or a row differs."""
    df = load(spark, sf_dir, "lineitem")
    text = profile.fingerprint_text(df)
    one = (F.col("l_orderkey") == df.agg(F.min("l_orderkey")).first()[0]) & (F.col("l_linenumber") == 1)
    turned = profile.fingerprint_text(df.repartition(5 + df.count() // TASK_ROWS, "l_partkey"))
    cell = profile.fingerprint_text(df.withColumn("l_tax", F.when(one, F.col("l_tax") + 1).otherwise(F.col("l_tax"))))
    row = profile.fingerprint_text(df.where(~one))
    return df.agg(F.count("*").alias("rows"), F.lit(turned == text).alias("same_in_any_order"),
                  F.lit(cell != text).alias("differs_by_a_cell"), F.lit(row != text).alias("differs_by_a_row"))


def _profile_sql(table: str, numbers: list[str], classes: list[str], columns: list[str]) -> str:
    cell = 'SELECT \'{c}\' AS "column", \'{m}\' AS metric, {t} AS text, {v} AS "value" FROM {f}'

    def row(c: str, m: str, v: str, source: str = table) -> str:
        return cell.format(c=c, m=m, t="NULL::VARCHAR", v=r(f"({v})::DOUBLE"), f=source)

    parts = [row("", "rows", "count(*)"), row("", "columns", f"max({len(columns)})")]
    distinct = f"(SELECT count(*) AS n FROM (SELECT DISTINCT * FROM {table}))"
    parts.append(row("", "duplicate_rows", f"(SELECT count(*) FROM {table}) - max(n)", f"{distinct} d"))
    for c in columns:
        parts.append(row(c, "missing", f"count(*) - count({c})"))
        parts.append(row(c, "n_unique", f"count(DISTINCT {c})"))
    for c in numbers:
        x = f"{c}::DOUBLE"
        mean = f"(SELECT avg({x}) FROM {table})"
        metrics = {
            "mean": f"avg({x})", "std": f"stddev_samp({x})", "min": f"min({x})", "max": f"max({x})", "sum": f"sum({x})",
            "zeros": f"count(*) FILTER ({x} = 0)", "negative": f"count(*) FILTER ({x} < 0)",
            "infinite": f"count(*) FILTER (isinf({x}))",
            "skewness": f"avg(power({x} - {mean}, 3)) / power(var_pop({x}), 1.5)",
            "kurtosis": f"avg(power({x} - {mean}, 4)) / power(var_pop({x}), 2) - 3",
            "cv": f"stddev_samp({x}) / avg({x})",
        }
        metrics |= {f"p{q:02d}": f"quantile_cont({x}, {q / 100})" for q in (5, 25, 50, 75, 95)}
        parts += [row(c, m, v) for m, v in metrics.items()]
    for c in classes:
        top = (f"(SELECT {c}::VARCHAR AS v, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {c}::VARCHAR) AS k "
               f"FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) w WHERE k <= 5")
        parts.append(f"SELECT '{c}' AS \"column\", 'top_' || k AS metric, v AS text, n::DOUBLE AS \"value\" FROM {top}")
    return union(parts)


@query("profile_orders", _profile_sql("orders", ["o_orderkey", "o_custkey", "o_totalprice"],
                                      ["o_orderstatus", "o_orderpriority"], ORDERS))
def profile_orders(spark, sf_dir):
    return rounded(profile.profile(load(spark, sf_dir, "orders")))


@query("profile_events", _profile_sql("events", ["event_id", "user_id", "value"], ["event_type", "props"], EVENTS))
def profile_events(spark, sf_dir):
    return rounded(profile.profile(load(spark, sf_dir, "events")))


@query("duplicate_rows_documents",
       "SELECT count(*)::BIGINT AS rows, count(DISTINCT text)::BIGINT AS distinct_rows, "
       "(count(*) - count(DISTINCT text))::BIGINT AS duplicate_rows FROM documents")
def duplicate_rows_documents(spark, sf_dir):
    return profile.duplicate_rows(load(spark, sf_dir, "documents"), ["text"])


@query("missing_ratios_lineitem_gaps", union([
    f"SELECT '{c}' AS feature, {r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)')} AS missing_ratio, "
    f"{r(f'avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) * 100')} AS missing_pct FROM ({GAPS_SQL}) t"
    for c in GAPS
]))
def missing_ratios_lineitem_gaps(spark, sf_dir):
    return rounded(profile.missing_ratios(gappy_lineitem(spark, sf_dir)))


@query("class_counts_quality",
       "WITH c AS (SELECT quality AS label, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY 1) "
       "SELECT label, n::BIGINT AS n, round_even(n * 100.0 / sum(n) OVER (), 2) AS pct, "
       f"{r('max(n) OVER () * 1.0 / greatest(min(n) OVER (), 1)')} AS ratio FROM c")
def class_counts_quality(spark, sf_dir):
    return rounded(counts.class_counts(load(spark, sf_dir, "labels"), "quality"))


def _top_sql(source: str, column: str, n: int) -> str:
    return (f"SELECT coalesce({column}::VARCHAR, 'NaN') AS \"value\", count(*)::BIGINT AS count FROM ({source}) t "
            f"GROUP BY 1 ORDER BY count DESC, \"value\" LIMIT {n}")


@query("top_values_brand", _top_sql("SELECT * FROM part", "p_brand", 20))
def top_values_brand(spark, sf_dir):
    return counts.top_values(load(spark, sf_dir, "part"), "p_brand")


@query("top_values_flag_gaps", _top_sql(GAPS_SQL, "l_returnflag", 20))
def top_values_flag_gaps(spark, sf_dir):
    return counts.top_values(gappy_lineitem(spark, sf_dir), "l_returnflag")


@query("value_counts_orders", union([
    f"SELECT '{c}' AS \"column\", {c}::VARCHAR AS \"value\", count(*)::BIGINT AS n FROM orders GROUP BY 2"
    for c in ("o_custkey", "o_orderstatus", "o_orderpriority")
]))
def value_counts_orders(spark, sf_dir):
    return counts.value_counts(load(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus", "o_orderpriority"])


def _mode_sql(table: str, c: str) -> str:
    return f"(SELECT {c} FROM {table} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


_MODED = ["p_brand", "p_type", "p_size", "p_name"]


@query("modes_part", "SELECT " + ", ".join(f"{_mode_sql('part', c)} AS {c}" for c in _MODED))
def modes_part(spark, sf_dir):
    df = load(spark, sf_dir, "part").select(*_MODED)
    found = counts.modes(df, _MODED)
    return spark.createDataFrame([tuple(found[c] for c in _MODED)], df.schema)


_PROBS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def _quantile_sql(source: str, columns: list[str]) -> str:
    return union([
        f"SELECT '{c}' AS \"column\", {p}::DOUBLE AS probability, {r(f'quantile_cont({c}::DOUBLE, {p})')} AS \"value\" FROM ({source}) t"
        for c, p in product(columns, _PROBS)
    ])


def _quantile_rows(df, columns, **options):
    got = quantiles.quantiles(df, columns, _PROBS, **options)
    rows = [(c, p, v) for c in columns for p, v in zip(_PROBS, got[c])]
    return rounded(df.sparkSession.createDataFrame(rows, "column string, probability double, value double"))


@query("quantiles_lineitem", _quantile_sql("SELECT * FROM lineitem", ["l_quantity", "l_extendedprice", "l_discount"]))
def quantiles_lineitem(spark, sf_dir):
    return _quantile_rows(load(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("quantiles_lineitem_narrowed", _quantile_sql(GAPS_SQL, ["l_extendedprice", "l_tax"]))
def quantiles_lineitem_narrowed(spark, sf_dir):
    """The way of a huge column, taken at any size: ranks found by narrowing."""
    return _quantile_rows(gappy_lineitem(spark, sf_dir), ["l_extendedprice", "l_tax"], direct_rows=2_000)


@query("quantiles_lineitem_approximate", "SELECT c AS \"column\", count(*)::BIGINT AS marks, true AS within_rank_bound "
       "FROM (SELECT unnest(['l_quantity', 'l_extendedprice']) AS c, unnest([1, 2]) AS i), range(7) GROUP BY 1")
def quantiles_lineitem_approximate(spark, sf_dir):
    """Approximate marks, each within two thousandths of the rows of its rank."""
    df = load(spark, sf_dir, "lineitem")
    marks = _quantile_rows(df, ["l_quantity", "l_extendedprice"], exact=False).collect()
    rows = df.count()
    checks = []
    for i, m in enumerate(marks):
        below, upto = F.count_if(F.col(m["column"]) < m["value"]), F.count_if(F.col(m["column"]) <= m["value"])
        want, slack = F.lit(m["probability"] * rows), 0.002 * rows + 1
        checks.append(((below <= want + slack) & (upto >= want - slack)).alias(f"m{i}"))
    found = df.agg(*checks).first()
    return spark.createDataFrame([(m["column"], bool(found[i])) for i, m in enumerate(marks)], "column string, ok boolean").groupBy("column").agg(
        F.count("*").alias("marks"), F.min("ok").alias("within_rank_bound"))


@query("grouped_target_brand",
       f"SELECT p_brand, {r('avg(p_retailprice)')} AS mean, count(p_retailprice)::BIGINT AS count FROM part GROUP BY 1")
def grouped_target_brand(spark, sf_dir):
    from tabsmith.operators.encoders import category_stats

    stats = category_stats(load(spark, sf_dir, "part"), ["p_brand"], F.col("p_retailprice"))
    return rounded(stats.select(F.col("value").alias("p_brand"), (F.col("total") / F.col("n")).alias("mean"),
                                F.col("n").alias("count")))


# Correlation ---------------------------------------------------------------------------------------------


def _corr_sql(source: str, columns: list[str], pairs=None) -> str:
    pairs = list(product(range(len(columns)), repeat=2)) if pairs is None else pairs
    parts = []
    for i, j in pairs:
        a, b = f"{columns[i]}::DOUBLE", f"{columns[j]}::DOUBLE"
        parts.append(
            f"SELECT {i}::INT AS pos_i, {j}::INT AS pos_j, '{columns[i]}' AS col_i, '{columns[j]}' AS col_j, "
            f"regr_count({a}, {b})::BIGINT AS n, {r(f'corr({a}, {b})')} AS r FROM ({source}) t"
        )
    return union(parts)


def _rank_sql(source: str, columns: list[str]) -> str:
    ranks = ", ".join(
        f"CASE WHEN {c} IS NULL THEN NULL ELSE rank() OVER (ORDER BY {c} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 END AS {c}"
        for c in columns
    )
    return f"SELECT {ranks} FROM ({source}) s"


def _spearman_gaps_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, j in product(range(len(columns)), repeat=2):
        a, b = columns[i], columns[j]
        both = f"SELECT {a} AS a, {b} AS b FROM ({source}) u WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        parts.append(
            f"SELECT {i}::INT AS pos_i, {j}::INT AS pos_j, '{a}' AS col_i, '{b}' AS col_j, count(*)::BIGINT AS n, "
            f"{r('corr(a, b)')} AS r FROM ({_rank_sql(both, ['a', 'b'])}) t"
        )
    return union(parts)


def _matrix(table):
    return rounded(table.drop("method"))


@query("pearson_lineitem", _corr_sql("SELECT * FROM lineitem", LINEITEM_NUMBERS))
def pearson_lineitem(spark, sf_dir):
    return _matrix(correlation.correlation(load(spark, sf_dir, "lineitem")))


_GAP_NUMBERS = ["l_extendedprice", "l_discount", "l_tax", "l_quantity"]


@query("pearson_lineitem_gaps", _corr_sql(GAPS_SQL, _GAP_NUMBERS))
def pearson_lineitem_gaps(spark, sf_dir):
    return _matrix(correlation.correlation(gappy_lineitem(spark, sf_dir), _GAP_NUMBERS))


@query("spearman_lineitem", _corr_sql(_rank_sql("SELECT * FROM lineitem", LINEITEM_NUMBERS), LINEITEM_NUMBERS))
def spearman_lineitem(spark, sf_dir):
    return _matrix(correlation.correlation(load(spark, sf_dir, "lineitem"), method="spearman"))


@query("spearman_part_gaps", _spearman_gaps_sql(
    "SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_size END AS p_size, "
    "CASE WHEN p_partkey % 6 = 2 THEN NULL ELSE p_retailprice END AS p_retailprice FROM part",
    ["p_partkey", "p_size", "p_retailprice"]))
def spearman_part_gaps(spark, sf_dir):
    from tabsmith.queries.base import gappy_part

    df = gappy_part(spark, sf_dir)
    return _matrix(correlation.correlation(df, ["p_partkey", "p_size", "p_retailprice"], "spearman"))


@query("average_ranks_orders",
       f"SELECT o_totalprice_rank, count(*)::BIGINT AS n FROM (SELECT {r('o_totalprice')} AS o_totalprice_rank FROM "
       f"({_rank_sql('SELECT o_totalprice FROM orders', ['o_totalprice'])}) a) b GROUP BY 1")
def average_ranks_orders(spark, sf_dir):
    """Through the bucketed running totals and the shuffled join of large columns."""
    ranks = correlation.average_ranks(load(spark, sf_dir, "orders"), ["o_totalprice"], rows_per_bucket=500, broadcast_rows=100)
    ranks = rounded(ranks.select(F.col("o_totalprice").alias("o_totalprice_rank")))
    return ranks.groupBy("o_totalprice_rank").agg(F.count("*").alias("n"))


def _target_sql(code: str, source: str, features: list[str], spearman: bool = False) -> str:
    coded = f"SELECT *, {code} AS y FROM ({source}) c"
    if spearman:
        coded = _rank_sql(coded, [*features, "y"])
    return union([
        f"SELECT '{c}' AS feature, {i}::INT AS position, regr_count({c}::DOUBLE, y)::BIGINT AS n, "
        f"{r(f'corr({c}::DOUBLE, y::DOUBLE)')} AS r FROM ({coded}) t"
        for i, c in enumerate(features)
    ])


def _dense(c: str) -> str:
    return f"(dense_rank() OVER (ORDER BY {c}) - 1)::DOUBLE"


@query("target_correlation_status", _target_sql(_dense("o_orderstatus"), "SELECT * FROM orders",
                                                ["o_orderkey", "o_custkey", "o_totalprice"]))
def target_correlation_status(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    return rounded(correlation.correlation_with_target(df, "o_orderstatus", df.columns).drop("method"))


@query("target_correlation_flag_gaps", _target_sql(
    "CASE WHEN l_returnflag IS NULL THEN -1.0 WHEN l_returnflag = 'A' THEN 0.0 WHEN l_returnflag = 'N' THEN 1.0 ELSE 2.0 END",
    GAPS_SQL, _GAP_NUMBERS))
def target_correlation_flag_gaps(spark, sf_dir):
    df = gappy_lineitem(spark, sf_dir)
    return rounded(correlation.correlation_with_target(df, "l_returnflag", _GAP_NUMBERS).drop("method"))


@query("target_correlation_first_seen", _target_sql(
    "(SELECT count(*) FROM (SELECT min(o_orderkey) AS f FROM orders GROUP BY o_orderstatus) g "
    "WHERE g.f < (SELECT min(o_orderkey) FROM orders o2 WHERE o2.o_orderstatus = c.o_orderstatus))::DOUBLE",
    "SELECT * FROM orders", ["o_custkey", "o_totalprice"]))
def target_correlation_first_seen(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    table = correlation.correlation_with_target(df, "o_orderstatus", ["o_custkey", "o_totalprice"], order_key="o_orderkey")
    return rounded(table.drop("method"))


@query("target_correlation_price_spearman", _target_sql(
    "l_extendedprice", "SELECT * FROM lineitem", ["l_quantity", "l_discount", "l_tax"], spearman=True))
def target_correlation_price_spearman(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    table = correlation.correlation_with_target(df, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], "spearman")
    return rounded(table.drop("method"))


@query("category_codes_brand",
       "SELECT p_brand AS \"value\", (dense_rank() OVER (ORDER BY p_brand) - 1)::BIGINT AS code, count(*)::BIGINT AS n "
       "FROM part GROUP BY p_brand")
def category_codes_brand(spark, sf_dir):
    return counts.category_codes(load(spark, sf_dir, "part"), "p_brand")


@query("category_codes_customer_names",
       "SELECT c_name AS \"value\", (dense_rank() OVER (ORDER BY c_name) - 1)::BIGINT AS code, count(*)::BIGINT AS n "
       "FROM customer GROUP BY c_name")
def category_codes_customer_names(spark, sf_dir):
    """One category per row: numbered in buckets, not in one task."""
    return counts.category_codes(load(spark, sf_dir, "customer"), "c_name", rows_per_bucket=200)


# Chart data ----------------------------------------------------------------------------------------------


def _histogram_sql(table: str, c: str, bins: int) -> str:
    return f"""
    WITH s AS (SELECT count({c}) AS n, min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM {table}),
    w AS (SELECT *, (hi - lo) / {bins} AS w FROM s),
    b AS (SELECT least(floor(({c} - lo) / w), {bins - 1})::INT AS bin, count(*) AS k FROM {table}, w GROUP BY 1)
    SELECT g::INT AS bin, {r('lo + g * w')} AS low, {r('lo + (g + 1) * w')} AS high, coalesce(k, 0)::BIGINT AS n,
           round(coalesce(k, 0) / (n * w), 9) AS density
    FROM w, range({bins}) t(g) LEFT JOIN b ON b.bin = g"""


@query("histogram_price", _histogram_sql("lineitem", "l_extendedprice", 30))
def histogram_price(spark, sf_dir):
    table = charts.histogram(load(spark, sf_dir, "lineitem"), "l_extendedprice", 30)
    return rounded(table.drop("density")).join(
        table.select("bin", F.round("density", 9).alias("density")), "bin"
    )


@query("histogram_value_default_bins", """
    WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, (ceil(log2(count(value))) + 1)::INT AS bins FROM events),
    c AS (SELECT least(floor((value - lo) / ((hi - lo) / bins)), bins - 1)::INT AS bin, count(*) AS k FROM events, s WHERE value IS NOT NULL GROUP BY 1)
    SELECT b::INT AS bin, round(lo + b * (hi - lo) / bins, 6) + 0.0 AS low, round(lo + (b + 1) * (hi - lo) / bins, 6) + 0.0 AS high,
           coalesce(k, 0)::BIGINT AS n, round(coalesce(k, 0) / (n * (hi - lo) / bins), 9) AS density
    FROM s, range((SELECT bins FROM s)) t(b) LEFT JOIN c ON c.bin = t.b""")
def histogram_value_default_bins(spark, sf_dir):
    """The number of bins follows Sturges' rule."""
    table = charts.histogram(load(spark, sf_dir, "events"), "value")
    return table.select("bin", (F.round("low", 6) + F.lit(0.0)).alias("low"), (F.round("high", 6) + F.lit(0.0)).alias("high"), "n",
                        F.round("density", 9).alias("density"))


@query("density_curve_value", """
    WITH s AS (SELECT count(value) AS n, min(value) AS lo, max(value) AS hi, stddev_samp(value) AS sd FROM events),
    h AS (SELECT *, sd * power(n, -0.2) AS h FROM s),
    v AS (SELECT value, count(*) AS k FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT g::INT AS point, round(lo + g * (hi - lo) / 199, 6) + 0.0 AS x,
           round((SELECT sum(k * exp(-0.5 * power((lo + g * (hi - lo) / 199 - value) / h, 2))) FROM v)
                 / (n * h * sqrt(2 * pi())), 9) AS density
    FROM h, range(200) t(g)""")
def density_curve_value(spark, sf_dir):
    table = charts.density_curve(load(spark, sf_dir, "events"), "value")
    return table.select("point", (F.round("x", 6) + F.lit(0.0)).alias("x"), F.round("density", 9).alias("density"))


# Previews and samples ------------------------------------------------------------------------------------


@query("preview_orders", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_orders(spark, sf_dir):
    return sampling.head(load(spark, sf_dir, "orders"), 10, ["o_orderkey"])


_SAMPLE_SQL = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(concat('42|', o_orderkey)) LIMIT {n}"


@query("sample_orders", _SAMPLE_SQL.format(n=500))
def sample_orders(spark, sf_dir):
    return sampling.sample_rows(load(spark, sf_dir, "orders"), 500, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("sample_if_large_orders", _SAMPLE_SQL.format(n=300))
def sample_if_large_orders(spark, sf_dir):
    df = load(spark, sf_dir, "orders")
    table, _ = sampling.sample_if_large(df, ["o_orderkey"], row_threshold=1_000, sample_size=300)
    return table.select("o_orderkey", "o_totalprice")


@query("sample_if_large_not_large", "SELECT n_nationkey, n_name FROM nation")
def sample_if_large_not_large(spark, sf_dir):
    table, _ = sampling.sample_if_large(load(spark, sf_dir, "nation"), ["n_nationkey"])
    return table.select("n_nationkey", "n_name")


@query("sample_fraction_events", "SELECT count(*)::BIGINT AS rows, true AS near_a_tenth, true AS drawn_once, true AS all_known FROM events")
def sample_fraction_events(spark, sf_dir):
    """About a tenth of the rows (six deviations at most), each at most once, and no others."""
    events = load(spark, sf_dir, "events")
    drawn = sampling.sample_fraction(events, 0.1)
    rows, n = events.count(), drawn.count()
    once = drawn.select("event_id").distinct().count() == n
    known = drawn.join(events, "event_id", "left_anti").count() == 0
    near = abs(n - rows / 10) <= 6 * (rows * 0.09) ** 0.5 + 1
    return events.agg(F.count("*").alias("rows"), F.lit(near).alias("near_a_tenth"), F.lit(once).alias("drawn_once"), F.lit(known).alias("all_known"))


@query("numeric_columns_lineitem", "SELECT unnest([" + ", ".join(f"'{c}'" for c in LINEITEM_NUMBERS)
       + "]) AS feature, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1")
def numeric_columns_lineitem(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem")
    names = numeric_columns(df)
    return df.select(F.explode(F.array(*[F.lit(c) for c in names])).alias("feature")).groupBy("feature").agg(F.count("*").alias("rows"))


@query("profile_documents", _profile_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"], DOCUMENTS))
def profile_documents(spark, sf_dir):
    """Whole texts are profiled by fixed-width keys."""
    return rounded(profile.profile(load(spark, sf_dir, "documents")))
