"""Identifier columns and warnings."""

from __future__ import annotations

from tabsmith.functions.names import names_an_identifier
from tabsmith.operators import quality
from tabsmith.queries.base import CUSTOMER, DOCUMENTS, EVENTS, GAPS, GAPS_SQL, LINEITEM, Catalog, gappy_lineitem, load, r, rounded, union

CATALOG = Catalog()
query = CATALOG.query


def _identifier_sql(table: str, columns: list[str], texts: list[str]) -> str:
    parts = []
    for i, c in enumerate(columns):
        ratio = f"count(DISTINCT {c}) * 1.0 / greatest(count(*), 1)"
        test = f"{ratio} >= 0.75" if names_an_identifier(c) else "false"
        if c in texts:
            test = f"({test}) OR ({ratio} >= 0.995)"
        parts.append(f"SELECT {i}::INT AS position, '{c}' AS \"column\", count(DISTINCT {c})::BIGINT AS n_unique, "
                     f"{r(ratio)} AS unique_ratio, ({test}) AS id_like FROM {table}")
    return union(parts)


def _register_identifiers(table: str, columns: list[str], texts: list[str]) -> None:
    @query(f"identifiers_{table}", _identifier_sql(table, columns, texts))
    def run(spark, sf_dir):
        return rounded(quality.identifier_scores(load(spark, sf_dir, table)))


_register_identifiers("events", EVENTS, ["event_type", "props"])
_register_identifiers("customer", CUSTOMER, ["c_name", "c_mktsegment"])
_register_identifiers("documents", DOCUMENTS, ["text", "lang", "source"])
_register_identifiers("lineitem", LINEITEM, ["l_returnflag", "l_linestatus"])


def _default_sql(table: str, columns: list[str], texts: list[str], target: str) -> str:
    return (f"SELECT position, \"column\" FROM ({_identifier_sql(table, columns, texts)}) s "
            f"WHERE NOT id_like AND \"column\" <> '{target}'")


@query("default_features_events", _default_sql("events", EVENTS, ["event_type", "props"], "value"))
def default_features_events(spark, sf_dir):
    df = load(spark, sf_dir, "events")
    rows = [(df.columns.index(c), c) for c in quality.default_features(df, "value")]
    return spark.createDataFrame(rows, "position int, column string")


def _warnings(table):
    return rounded(table.select("level", "title", "message", "feature", "other", "value"))


def _missing_sql(columns: list[str]) -> str:
    ratio = "avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)"
    return union([
        f"SELECT 'warning' AS level, 'High missingness' AS title, "
        f"printf('''%s'' is empty in %.1f%% of the rows; leave it out or choose its fill with care.', "
        f"'{c}', ({ratio.format(c=c)} * 100)::DOUBLE) AS message, '{c}' AS feature, NULL::VARCHAR AS other, "
        f"{r(ratio.format(c=c))} AS \"value\" FROM ({GAPS_SQL}) t HAVING {ratio.format(c=c)} >= 0.65"
        for c in columns
    ])


@query("warnings_missingness", _missing_sql(list(GAPS)))
def warnings_missingness(spark, sf_dir):
    return _warnings(quality.missingness_warnings(gappy_lineitem(spark, sf_dir), list(GAPS)))


def _cardinality_sql(table: str, columns: list[str], limit: int) -> str:
    return union([
        f"SELECT 'info' AS level, 'High cardinality categorical feature' AS title, "
        f"'''{c}'' has ' || count(DISTINCT {c}) || ' categories; one column for each would be wide, an encoding by frequency or target is not.' "
        f"AS message, '{c}' AS feature, NULL::VARCHAR AS other, count(DISTINCT {c})::DOUBLE AS \"value\" FROM {table} "
        f"HAVING count(DISTINCT {c}) > {limit}"
        for c in columns
    ])


@query("warnings_cardinality", _cardinality_sql("lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"], 50))
def warnings_cardinality(spark, sf_dir):
    return _warnings(quality.cardinality_warnings(load(spark, sf_dir, "lineitem"), LINEITEM))


@query("warnings_cardinality_documents", _cardinality_sql("documents", ["text", "lang", "source"], 50))
def warnings_cardinality_documents(spark, sf_dir):
    return _warnings(quality.cardinality_warnings(load(spark, sf_dir, "documents"), DOCUMENTS))


_PRICED = "SELECT *, l_extendedprice * (1 - l_discount) AS l_net FROM lineitem"
_PRICED_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_net"]


def _priced(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").selectExpr("*", "l_extendedprice * (1 - l_discount) as l_net")


def _pair_sql(source: str, columns: list[str], threshold: float) -> str:
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    return union([
        f"SELECT 'warning' AS level, 'High feature-feature correlation' AS title, "
        f"printf('''%s'' and ''%s'' move together (r = %.3f); one of them may be enough.', "
        f"'{a}', '{b}', abs(corr({a}, {b}))) AS message, '{a}' AS feature, '{b}' AS other, "
        f"{r(f'abs(corr({a}, {b}))')} AS \"value\" FROM ({source}) t HAVING abs(corr({a}, {b})) >= {threshold}"
        for a, b in pairs
    ])


@query("warnings_pairs", _pair_sql(_PRICED, _PRICED_NUMBERS, 0.95))
def warnings_pairs(spark, sf_dir):
    return _warnings(quality.pair_warnings(_priced(spark, sf_dir), _PRICED_NUMBERS))


def _leak_sql(source: str, target: str, columns: list[str], threshold: float) -> str:
    return union([
        f"SELECT 'error' AS level, 'Potential leakage warning' AS title, "
        f"printf('''%s'' nearly gives the target away (r = %.3f); make sure that it is known before the target is.', "
        f"'{c}', corr({c}, {target})) AS message, "
        f"'{c}' AS feature, NULL::VARCHAR AS other, {r(f'corr({c}, {target})')} AS \"value\" "
        f"FROM ({source}) t HAVING abs(corr({c}, {target})) >= {threshold}"
        for c in columns
    ])


@query("warnings_leakage", _leak_sql(_PRICED, "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_net"], 0.92))
def warnings_leakage(spark, sf_dir):
    df = _priced(spark, sf_dir)
    return _warnings(quality.leakage_warnings(df, "l_extendedprice", _PRICED_NUMBERS))


def _imbalance_sql(table: str, target: str) -> str:
    return f"""
    WITH c AS (SELECT {target}::VARCHAR AS label, count(*) AS n FROM {table} WHERE {target} IS NOT NULL GROUP BY 1),
    p AS (SELECT label, n, round_even(n * 100.0 / (SELECT sum(n) FROM c), 2)::DOUBLE AS pct FROM c),
    s AS (SELECT max(n) * 1.0 / greatest(min(n), 1) AS ratio, count(*) AS k,
                 string_agg(label || ': ' || pct::VARCHAR || '%', ' / ' ORDER BY n DESC, label) AS summary FROM p)
    SELECT CASE WHEN ratio > 5 THEN 'error' ELSE 'warning' END AS level, 'Class imbalance detected' AS title,
           printf('Classes %s: the largest is %.2f times the smallest; weigh them, and read F1 and PR-AUC, not accuracy.',
                  summary, ratio::DOUBLE) AS message,
           '{target}' AS feature, NULL::VARCHAR AS other, {r('ratio::DOUBLE')} AS "value"
    FROM s WHERE k >= 2 AND ratio > 3"""


@query("warnings_imbalance_quality", _imbalance_sql("labels", "quality"))
def warnings_imbalance_quality(spark, sf_dir):
    return _warnings(quality.imbalance_warnings(load(spark, sf_dir, "labels"), "quality"))


@query("warnings_imbalance_toxic", _imbalance_sql("labels", "toxic"))
def warnings_imbalance_toxic(spark, sf_dir):
    return _warnings(quality.imbalance_warnings(load(spark, sf_dir, "labels"), "toxic"))


@query("warnings_imbalance_status", _imbalance_sql("orders", "o_orderstatus"))
def warnings_imbalance_status(spark, sf_dir):
    return _warnings(quality.imbalance_warnings(load(spark, sf_dir, "orders"), "o_orderstatus"))


_ALL_SOURCE = "SELECT *, CASE WHEN l_suppkey % 10 < 7 THEN NULL ELSE l_quantity END AS l_sparse FROM (" + _PRICED + ") p"
_ALL_FEATURES = ["l_sparse", "l_quantity", "l_discount", "l_net", "l_shipdate", "l_linestatus"]
_RANKED = """SELECT (row_number() OVER (ORDER BY severity, kind))::INT AS place, level, title, feature FROM ({parts}) w"""


def _all_sql() -> str:
    sparse = "avg(CASE WHEN l_sparse IS NULL THEN 1.0 ELSE 0.0 END)"
    parts = [
        f"SELECT 1 AS severity, 0 AS kind, 'warning' AS level, 'High missingness' AS title, 'l_sparse' AS feature "
        f"FROM ({_ALL_SOURCE}) t HAVING {sparse} >= 0.65",
        f"SELECT 2, 1, 'info', 'High cardinality categorical feature', 'l_shipdate' FROM ({_ALL_SOURCE}) t "
        "HAVING count(DISTINCT l_shipdate) > 50",
        f"SELECT 0, 3, 'error', 'Potential leakage warning', 'l_net' FROM ({_ALL_SOURCE}) t "
        "HAVING abs(corr(l_net, l_extendedprice)) >= 0.92",
        f"SELECT 1, 2, 'warning', 'High feature-feature correlation', 'l_sparse' FROM ({_ALL_SOURCE}) t "
        "HAVING abs(corr(l_sparse, l_quantity)) >= 0.95",
    ]
    return _RANKED.format(parts=union(parts))


@query("warnings_all", _all_sql())
def warnings_all(spark, sf_dir):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    df = _priced(spark, sf_dir).selectExpr("*", "case when l_suppkey % 10 < 7 then null else l_quantity end as l_sparse")
    table = quality.warnings(df, _ALL_FEATURES, "l_extendedprice", "Regression")
    place = F.row_number().over(Window.orderBy("severity", "kind", "position"))
    return table.withColumn("place", place).select("place", "level", "title", "feature")


_WIDE = [f"f{i:02d}" for i in range(64)]
_WIDE_SQL = "SELECT " + ", ".join(
    [f"(l_partkey * {7 * i + 3} + l_orderkey * {i * i + 1}) % {101 + 2 * i} AS f{i:02d}" for i in range(63)] + ["l_quantity * 2 AS f63, l_quantity"]) + " FROM lineitem"


@query("warnings_pairs_wide", "SELECT 'f63' AS feature, 'l_quantity' AS other, count(*) > 0 AS found FROM lineitem")
def warnings_pairs_wide(spark, sf_dir):
    """Of 65 numeric features the last two move together: no pair is left out for its place."""
    spark_sql = _WIDE_SQL.replace(" FROM lineitem", "").removeprefix("SELECT ").split(", ")
    df = load(spark, sf_dir, "lineitem").selectExpr(*spark_sql)
    return quality.pair_warnings(df, [*_WIDE, "l_quantity"], 0.999).selectExpr("feature", "other", "value > 0.999 as found")


@query("warnings_imbalance_many", """
    WITH c AS (SELECT (o_custkey % 1500) * (o_orderkey % 3)::BIGINT AS l, count(*) AS n FROM orders GROUP BY 1)
    SELECT count(*)::BIGINT - 50 AS others, round(max(n) * 1.0 / min(n), 6) + 0.0 AS ratio FROM c""")
def warnings_imbalance_many(spark, sf_dir):
    """More than a thousand classes: the largest are listed, the others counted, by the rule that holds for few."""
    df = load(spark, sf_dir, "orders").selectExpr("(o_custkey % 1500) * (o_orderkey % 3) as l")
    table = quality.imbalance_warnings(df, "l")
    return table.selectExpr("cast(regexp_extract(message, '([0-9]+) other classes', 1) as bigint) as others", "round(value, 6) + 0.0 as ratio")


@query("warnings_sampled", "SELECT least(5000, count(*))::BIGINT AS scanned, true AS same_titles FROM lineitem")
def warnings_sampled(spark, sf_dir):
    """A scan of an exact sample raises the warnings of the whole table."""
    from pyspark.sql import functions as F

    df = _priced(spark, sf_dir).selectExpr("*", "case when l_suppkey % 10 < 7 then null else l_quantity end as l_sparse")
    limits = quality.WarningLimits(max_rows=5000)
    key = ["l_orderkey", "l_linenumber"]
    titles = [{(r["title"], r["feature"]) for r in quality.warnings(df, _ALL_FEATURES, "l_extendedprice", "Regression", m, key).collect()}
              for m in (limits, None)]
    return quality.sample_rows(df, 5000, key).agg(F.count("*").alias("scanned"), F.lit(titles[0] == titles[1]).alias("same_titles"))
