"""Splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import splitting
from tabsmith.queries.base import Catalog, load

CATALOG = Catalog()
query = CATALOG.query
_H = "md5(concat('42|', {k}))"


@query("holdout_orders", f"""
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_H.format(k='o_orderkey')}) AS p, count(*) OVER () AS n FROM orders)
    SELECT o_orderkey, p <= floor(n * 8 / 10) AS is_train FROM r""")
def holdout_orders(spark, sf_dir):
    return splitting.with_holdout(load(spark, sf_dir, "orders"), ["o_orderkey"], 0.8).select("o_orderkey", "is_train")


def _stratified_sql(table: str, key: str, label: str, share: int) -> str:
    return f"""
    WITH c AS (SELECT {label} AS l, count(*) AS n FROM {table} GROUP BY 1),
    t AS (SELECT sum(n) AS rows, floor(sum(n) * {share} / 100) AS want FROM c),
    q AS (SELECT l, floor(n * want / rows) AS q, n * want / rows - floor(n * want / rows) AS rest FROM c, t),
    o AS (SELECT l, q, row_number() OVER (ORDER BY rest DESC, l::VARCHAR) AS place FROM q),
    w AS (SELECT l, q + CASE WHEN place <= (SELECT want FROM t) - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END AS k FROM o),
    r AS (SELECT {key}, {label}, row_number() OVER (PARTITION BY {label} ORDER BY {_H.format(k=key)}) AS p FROM {table})
    SELECT {key}, {label}, p <= k AS is_train FROM r JOIN w ON l = {label}"""


@query("holdout_stratified_orders", _stratified_sql("orders", "o_orderkey", "o_orderstatus", 80))
def holdout_stratified_orders(spark, sf_dir):
    split = splitting.with_holdout(load(spark, sf_dir, "orders"), ["o_orderkey"], 0.8, stratify="o_orderstatus")
    return split.select("o_orderkey", "o_orderstatus", "is_train")


@query("holdout_stratified_labels", _stratified_sql("labels", "doc_id", "quality", 75))
def holdout_stratified_labels(spark, sf_dir):
    split = splitting.with_holdout(load(spark, sf_dir, "labels"), ["doc_id"], 0.75, stratify="quality")
    return split.select("doc_id", "quality", "is_train")


@query("holdout_lineitem", """
    WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY h) AS p, count(*) OVER () AS n FROM (
        SELECT l_orderkey, l_linenumber, md5(concat('42|', l_orderkey, '|', l_linenumber, '|', l_partkey, '|', l_suppkey, '|', l_shipdate)) AS h
        FROM lineitem) s)
    SELECT count(*) FILTER (p <= floor(n * 8 / 10))::BIGINT AS train, count(*) FILTER (p > floor(n * 8 / 10))::BIGINT AS test FROM r""")
def holdout_lineitem(spark, sf_dir):
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    split = splitting.with_holdout(load(spark, sf_dir, "lineitem"), key, 0.8)
    return split.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


def _fold_sql(table: str, key: str, folds: int, label: str | None) -> str:
    part = f"PARTITION BY {label} " if label else ""
    extra = f"{label}, " if label else ""
    return f"""
    WITH r AS (SELECT {key}, {extra}row_number() OVER ({part}ORDER BY {_H.format(k=key)}) - 1 AS p,
                      count(*) OVER ({part}) AS n FROM {table}),
    s AS (SELECT *, n // {folds} AS w, n % {folds} AS x FROM r)
    SELECT {key}, {extra}(CASE WHEN p < x * (w + 1) THEN p // (w + 1) ELSE x + (p - x * (w + 1)) // w END)::INT AS fold FROM s"""


@query("folds_orders", _fold_sql("orders", "o_orderkey", 5, None))
def folds_orders(spark, sf_dir):
    return splitting.with_folds(load(spark, sf_dir, "orders"), ["o_orderkey"], 5).select("o_orderkey", "fold")


@query("folds_stratified_orders", _fold_sql("orders", "o_orderkey", 5, "o_orderstatus"))
def folds_stratified_orders(spark, sf_dir):
    folds = splitting.with_folds(load(spark, sf_dir, "orders"), ["o_orderkey"], 5, target="o_orderstatus")
    return folds.select("o_orderkey", "o_orderstatus", "fold")


@query("folds_stratified_labels", _fold_sql("labels", "doc_id", 10, "toxic"))
def folds_stratified_labels(spark, sf_dir):
    folds = splitting.with_folds(load(spark, sf_dir, "labels"), ["doc_id"], 10, target="toxic")
    return folds.select("doc_id", "toxic", "fold")


@query("shifted_values_part", "SELECT p_size AS value, count(*)::BIGINT AS n FROM part GROUP BY 1")
def shifted_values_part(spark, sf_dir):
    """The permuted column holds the same values as often."""
    moved = splitting.shifted_values(load(spark, sf_dir, "part"), ["p_size"], ["p_partkey"], 4, 42)
    return moved.groupBy(F.col("_moved_0").alias("value")).agg(F.count("*").alias("n"))


@query("holdout_stratified_distributed", _stratified_sql("orders", "o_orderkey", "o_orderpriority", 70))
def holdout_stratified_distributed(spark, sf_dir):
    """The way of very many classes, taken for a few: the class table stays distributed."""
    split = splitting.with_holdout(load(spark, sf_dir, "orders"), ["o_orderkey"], 0.7, stratify="o_orderpriority", listed_classes=2)
    return split.select("o_orderkey", "o_orderpriority", "is_train")


@query("holdout_stratified_suppliers", _stratified_sql("lineitem", "l_orderkey * 10 + l_linenumber", "l_suppkey", 80).replace(
    "SELECT l_orderkey * 10 + l_linenumber, l_suppkey, p", "SELECT k, l_suppkey, p").replace(
    "r AS (SELECT l_orderkey * 10 + l_linenumber, l_suppkey", "r AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_suppkey").replace(
    "SELECT k, l_suppkey, p <= k AS is_train FROM r JOIN w ON l = l_suppkey", "SELECT r.k, l_suppkey, p <= w.k AS is_train FROM r JOIN w ON l = l_suppkey"))
def holdout_stratified_suppliers(spark, sf_dir):
    """A class for every supplier, light classes ranked where they are."""
    lines = load(spark, sf_dir, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber as k", "l_suppkey")
    return splitting.with_holdout(lines, ["k"], 0.8, stratify="l_suppkey", listed_classes=50).select("k", "l_suppkey", "is_train")


@query("folds_stratified_distributed", """
    WITH r AS (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('42|', o_orderkey))) AS p,
                      count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, (CASE WHEN p <= n // 4 + least(1, n % 4) THEN 0 WHEN p <= 2 * (n // 4) + least(2, n % 4) THEN 1
                             WHEN p <= 3 * (n // 4) + least(3, n % 4) THEN 2 ELSE 3 END)::INT AS fold FROM r""")
def folds_stratified_distributed(spark, sf_dir):
    rows = splitting.with_folds(load(spark, sf_dir, "orders"), ["o_orderkey"], 4, target="o_orderpriority", listed_classes=2)
    return rows.select("o_orderkey", "fold")
