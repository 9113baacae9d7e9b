"""Cleaning steps and the whole chain."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.functions.columns import to_number
from tabsmith.operators import cleaning
from tabsmith.operators.cleaning import CleaningRequest
from tabsmith.queries.base import GAPS, GAPS_SQL, Catalog, gappy_lineitem, load, r, rounded

CATALOG = Catalog()
query = CATALOG.query
KEY = ["l_orderkey", "l_linenumber"]


@query("project_features", "SELECT l_quantity, l_tax, l_returnflag FROM lineitem")
def project_features(spark, sf_dir):
    request = CleaningRequest(["l_quantity", "l_tax", "unknown", "l_quantity"], "l_returnflag")
    return cleaning.clean(load(spark, sf_dir, "lineitem"), request).frame


@query("target_not_null", f"SELECT * FROM ({GAPS_SQL}) t WHERE l_returnflag IS NOT NULL")
def target_not_null(spark, sf_dir):
    features = [c for c in GAPS if c != "l_returnflag"]
    frame = cleaning.clean(gappy_lineitem(spark, sf_dir), CleaningRequest(features, "l_returnflag")).frame
    return frame.select(*GAPS)


@query("drop_incomplete_rows", f"SELECT * FROM ({GAPS_SQL}) t WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in GAPS))
def drop_incomplete_rows(spark, sf_dir):
    return cleaning.drop_incomplete_rows(gappy_lineitem(spark, sf_dir), list(GAPS))


@query("drop_sparse_columns", f"SELECT l_extendedprice, l_discount, l_tax, l_linestatus FROM ({GAPS_SQL}) t")
def drop_sparse_columns(spark, sf_dir):
    request = CleaningRequest(["l_extendedprice", "l_discount", "l_tax", "l_quantity"], "l_linestatus",
                              missing_strategy="Drop columns", drop_column_threshold=0.65)
    return cleaning.clean(gappy_lineitem(spark, sf_dir), request).frame


@query("sparse_columns_lineitem",
       "SELECT feature FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS feature, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM ({GAPS_SQL}) t" for c in GAPS
       ) + ") u WHERE m >= 0.3")
def sparse_columns_lineitem(spark, sf_dir):
    names = cleaning.sparse_columns(gappy_lineitem(spark, sf_dir), list(GAPS), 0.3)
    return spark.createDataFrame([(c,) for c in names], "feature string")


@query("numeric_target_props",
       "SELECT event_id, target FROM (SELECT event_id, try_cast(CASE WHEN event_id % 3 = 0 THEN event_type ELSE value::VARCHAR END "
       "AS DOUBLE) AS target FROM events) t WHERE target IS NOT NULL")
def numeric_target_props(spark, sf_dir):
    df = load(spark, sf_dir, "events").selectExpr(
        "event_id", "case when event_id % 3 = 0 then event_type else cast(value as string) end as target"
    )
    return cleaning.numeric_target(df, "target")


@query("to_number_event_types",
       "SELECT event_id, try_cast(CASE WHEN event_id % 4 = 0 THEN ' 7 ' WHEN event_id % 4 = 1 THEN '1e3' WHEN event_id % 4 = 2 "
       "THEN 'x' ELSE user_id::VARCHAR END AS DOUBLE) AS number FROM events")
def to_number_event_types(spark, sf_dir):
    text = F.expr("case when event_id % 4 = 0 then ' 7 ' when event_id % 4 = 1 then '1e3' when event_id % 4 = 2 then 'x' "
                  "else cast(user_id as string) end")
    return load(spark, sf_dir, "events").select("event_id", to_number(text).alias("number"))


def _bounds(source: str, columns: list[str], low: float, high: float) -> str:
    cells = ", ".join(f"quantile_cont({c}, {low}) AS {c}_lo, quantile_cont({c}, {high}) AS {c}_hi" for c in columns)
    return f"SELECT {cells} FROM ({source}) b"


_OUT = ["l_extendedprice", "l_discount", "l_tax"]


@query("iqr_filter_lineitem", f"""
    SELECT t.* FROM ({GAPS_SQL}) t, ({_bounds(GAPS_SQL, _OUT, 0.25, 0.75)}) q
    WHERE """ + " AND ".join(
        f"({c} IS NULL OR {c} BETWEEN {c}_lo - 1.0 * ({c}_hi - {c}_lo) * 0.4 AND {c}_hi + 0.4 * ({c}_hi - {c}_lo))" for c in _OUT))
def iqr_filter_lineitem(spark, sf_dir):
    return cleaning.iqr_filter(gappy_lineitem(spark, sf_dir), _OUT, 0.4)


_CLIP_SQL = f"SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CASE WHEN {c} IS NULL THEN NULL ELSE {r(f'greatest(least({c}, {c}_hi), {c}_lo)')} END AS {c}" for c in _OUT
) + f" FROM ({GAPS_SQL}) t, ({_bounds(GAPS_SQL, _OUT, 0.05, 0.95)}) q"


@query("winsorize_lineitem", _CLIP_SQL)
def winsorize_lineitem(spark, sf_dir):
    return rounded(cleaning.winsorize(gappy_lineitem(spark, sf_dir), _OUT, 0.05, 0.95).select(*KEY, *_OUT))


_FILLS = {"l_discount": "Mean", "l_tax": "Median", "l_returnflag": "Mode", "l_quantity": "Constant"}
_FILL_SQL = f"""
    WITH g AS ({GAPS_SQL}),
    s AS (SELECT avg(l_discount) AS m, quantile_cont(l_tax, 0.5) AS d FROM g),
    f AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, {r('coalesce(l_discount, m)')} AS l_discount, {r('coalesce(l_tax, d)')} AS l_tax,
           coalesce(l_returnflag, v) AS l_returnflag, {r('coalesce(l_quantity, 5.0)')} AS l_quantity FROM g, s, f"""


@query("fill_per_column", _FILL_SQL)
def fill_per_column(spark, sf_dir):
    df = gappy_lineitem(spark, sf_dir)
    filled = cleaning.fill_columns(df, cleaning.fill_values(df, _FILLS, "5"))
    return rounded(filled.select(*KEY, *_FILLS))


@query("drop_duplicates_first",
       "SELECT l_quantity, l_discount, l_tax, min(l_orderkey * 10 + l_linenumber)::BIGINT AS k FROM lineitem GROUP BY 1, 2, 3")
def drop_duplicates_first(spark, sf_dir):
    df = load(spark, sf_dir, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return cleaning.drop_duplicates(df, ["l_quantity", "l_discount", "l_tax"], ["k"])


@query("drop_duplicates_texts", "SELECT DISTINCT lang, text FROM documents")
def drop_duplicates_texts(spark, sf_dir):
    return cleaning.drop_duplicates(load(spark, sf_dir, "documents"), ["lang", "text"])


_CHAIN_SQL = f"""
    WITH g AS ({GAPS_SQL}),
    u AS (SELECT l_discount, l_tax, l_extendedprice, l_returnflag FROM g GROUP BY ALL),
    n AS (SELECT * FROM u WHERE l_returnflag IS NOT NULL),
    s AS (SELECT avg(l_discount) AS m, quantile_cont(l_tax, 0.5) AS d FROM n),
    f AS (SELECT coalesce(l_discount, m) AS l_discount, coalesce(l_tax, d) AS l_tax, l_extendedprice, l_returnflag FROM n, s),
    b AS ({_bounds('SELECT * FROM f', _OUT, 0.01, 0.99)})
    SELECT {', '.join(f"{r(f'greatest(least({c}, {c}_hi), {c}_lo)')} AS {c}" for c in _OUT)}, l_returnflag FROM f, b"""
_CHAIN = CleaningRequest(
    ["l_discount", "l_tax", "l_extendedprice"], "l_returnflag", remove_duplicates=True, outlier_strategy="Clip (Winsorize)",
    per_column_missing_strategy={"l_discount": "Mean", "l_tax": "Median"},
)


@query("clean_chain", _CHAIN_SQL)
def clean_chain(spark, sf_dir):
    frame = cleaning.clean(gappy_lineitem(spark, sf_dir), _CHAIN).frame
    return rounded(frame.select(*_OUT, "l_returnflag"))


@query("clean_chain_counts", f"SELECT (SELECT count(*) FROM lineitem)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after, "
       f"((SELECT count(*) FROM lineitem) - count(*))::BIGINT AS dropped_rows FROM ({_CHAIN_SQL}) t")
def clean_chain_counts(spark, sf_dir):
    done = cleaning.clean(gappy_lineitem(spark, sf_dir), _CHAIN)
    return spark.createDataFrame([(done.rows_before, done.rows_after, done.dropped_rows)],
                                 "rows_before bigint, rows_after bigint, dropped_rows bigint")


@query("prepare_regression", f"""
    WITH g AS ({GAPS_SQL}) SELECT l_discount, l_tax, l_extendedprice FROM g
    WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL AND l_extendedprice IS NOT NULL""")
def prepare_regression(spark, sf_dir):
    request = CleaningRequest(["l_discount", "l_tax", "l_extendedprice"], "l_extendedprice", "Regression", missing_strategy="Drop rows")
    return cleaning.prepare(gappy_lineitem(spark, sf_dir), request).frame
