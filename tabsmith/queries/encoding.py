"""Imputation, polynomial terms, scaling and encoding."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import encoders, scalers
from tabsmith.operators.correlation import coded_target
from tabsmith.operators.lookup import attach
from tabsmith.plans.preprocess import FEATURES, Preprocessor, PreprocessorConfig, feature_names
from tabsmith.plans.stages import PREFIX, ROW_ID, CategoryEncoder, ChainedFill, NeighbourFill, ValueFill
from tabsmith.queries.base import (
    GAPS_SQL,
    PART_GAPS_SQL,
    Catalog,
    gappy_lineitem,
    gappy_part,
    load,
    r,
    rounded,
)

CATALOG = Catalog()
query = CATALOG.query
KEY = ["l_orderkey", "l_linenumber"]
NUMBERS = ["l_discount", "l_tax", "l_extendedprice"]


def _imputed(spark, sf_dir, strategy: str, constant: str = "0"):
    df = gappy_lineitem(spark, sf_dir)
    out = ValueFill(NUMBERS, strategy, constant).fit(df).transform(df)
    return rounded(out.select(*KEY, *[F.col(PREFIX + c).alias(c) for c in NUMBERS]))


def _impute_sql(value: str) -> str:
    cells = ", ".join(f"{r(f'coalesce({c}, ' + value.format(c=c) + ')')} AS {c}" for c in NUMBERS)
    return f"WITH g AS ({GAPS_SQL}) SELECT l_orderkey, l_linenumber, {cells} FROM g"


@query("impute_mean", _impute_sql("(SELECT avg({c}) FROM g)"))
def impute_mean(spark, sf_dir):
    return _imputed(spark, sf_dir, "Mean")


@query("impute_median", _impute_sql("(SELECT quantile_cont({c}, 0.5) FROM g)"))
def impute_median(spark, sf_dir):
    return _imputed(spark, sf_dir, "Median")


@query("impute_mode", _impute_sql("(SELECT {c} FROM g WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"))
def impute_mode(spark, sf_dir):
    return _imputed(spark, sf_dir, "Mode")


@query("impute_constant", _impute_sql("-1.5"))
def impute_constant(spark, sf_dir):
    return _imputed(spark, sf_dir, "Constant", "-1.5")


@query("impute_category", f"""
    WITH g AS ({GAPS_SQL}), m AS (SELECT l_returnflag AS v FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1
                                  ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT l_orderkey, l_linenumber, coalesce(l_returnflag, v) AS most_frequent, coalesce(l_returnflag, 'missing') AS constant
    FROM g, m""")
def impute_category(spark, sf_dir):
    df = gappy_lineitem(spark, sf_dir)
    by_mode = ValueFill(["l_returnflag"], "Mode").fit(df).transform(df).withColumnRenamed(PREFIX + "l_returnflag", "most_frequent")
    both = ValueFill(["l_returnflag"], "Constant", "missing").fit(by_mode).transform(by_mode)
    return both.select(*KEY, "most_frequent", F.col(PREFIX + "l_returnflag").alias("constant"))


_KNN_SQL = f"""
    WITH g AS ({PART_GAPS_SQL}),
    p AS (SELECT a.p_partkey AS q, b.p_partkey AS d, b.p_size AS size, b.p_retailprice AS price, a.p_size AS qs, a.p_retailprice AS qp,
            (coalesce(power(a.p_partkey - b.p_partkey, 2), 0) + coalesce(power(a.p_size - b.p_size, 2), 0)
             + coalesce(power(a.p_retailprice - b.p_retailprice, 2), 0))
            * 3.0 / (1 + (a.p_size - b.p_size IS NOT NULL)::INT + (a.p_retailprice - b.p_retailprice IS NOT NULL)::INT) AS dist
          FROM g a, g b WHERE a.p_size IS NULL OR a.p_retailprice IS NULL),
    s AS (SELECT q, avg(size) AS v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS k FROM p
          WHERE qs IS NULL AND size IS NOT NULL) x WHERE k <= 5 GROUP BY q),
    t AS (SELECT q, avg(price) AS v FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, d) AS k FROM p
          WHERE qp IS NULL AND price IS NOT NULL) x WHERE k <= 5 GROUP BY q)
    SELECT p_partkey, {r('coalesce(p_size, s.v)')} AS p_size, {r('coalesce(p_retailprice, t.v)')} AS p_retailprice
    FROM g LEFT JOIN s ON s.q = p_partkey LEFT JOIN t ON t.q = p_partkey"""


@query("impute_neighbours", _KNN_SQL)
def impute_neighbours(spark, sf_dir):
    df = gappy_part(spark, sf_dir).withColumn(ROW_ID, F.col("p_partkey"))
    out = NeighbourFill(["p_partkey", "p_size", "p_retailprice"]).fit(df).transform(df)
    return rounded(out.select("p_partkey", F.col(PREFIX + "p_size").alias("p_size"),
                              F.col(PREFIX + "p_retailprice").alias("p_retailprice")))


@query("impute_chained", f"SELECT l_orderkey, l_linenumber, {', '.join(f'{r(c)} AS {c}' for c in [*NUMBERS, 'l_quantity'])}, true AS all_filled, true AS in_range FROM ({GAPS_SQL}) t")
def impute_chained(spark, sf_dir):
    """Values that were there are kept; every gap has a value, within three times the spread of its column."""
    df = gappy_lineitem(spark, sf_dir)
    names = [*NUMBERS, "l_quantity"]
    out = ChainedFill(names).fit(df).transform(df)
    ends = df.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("lo", F.min), ("hi", F.max))]).first()
    value = {c: F.col(PREFIX + c) for c in names}
    filled = [value[c].isNotNull() & ~F.isnan(value[c]) for c in names]
    near = [value[c].between(ends[f"lo_{c}"] - (s := ends[f"hi_{c}"] - ends[f"lo_{c}"]), ends[f"hi_{c}"] + s) for c in names]
    kept = [(F.round(F.when(df[c].isNotNull(), value[c]), 6) + F.lit(0.0)).alias(c) for c in names]
    return out.select(*KEY, *kept, reduce(and_, filled).alias("all_filled"), reduce(and_, near).alias("in_range"))


_POLY = ["l_quantity", "l_discount", "l_tax"]


def _poly_sql(only: bool) -> str:
    terms = scalers.degree_two_terms(_POLY, only)
    cells = [f"{r(c)} AS {c}" for c in _POLY] + [f"{r(f'{a} * {b}')} AS \"{t}\"" for t, a, b in terms]
    return f"SELECT l_orderkey, l_linenumber, {', '.join(cells)} FROM lineitem"


@query("polynomial_terms", _poly_sql(False))
def polynomial_terms(spark, sf_dir):
    df, names = scalers.add_degree_two(load(spark, sf_dir, "lineitem"), _POLY)
    return rounded(df.select(*KEY, *names))


@query("polynomial_interactions", _poly_sql(True))
def polynomial_interactions(spark, sf_dir):
    df, names = scalers.add_degree_two(load(spark, sf_dir, "lineitem"), _POLY, interaction_only=True)
    return rounded(df.select(*KEY, *names))


_SCALED = ["l_quantity", "l_extendedprice", "l_discount"]


def _scale_sql(centre: str, scale: str) -> str:
    cells = []
    for c in _SCALED:
        s = f"(SELECT {scale.format(c=c)} FROM g)"
        cells.append(f"{r(f'({c} - (SELECT {centre.format(c=c)} FROM g)) / CASE WHEN {s} = 0 THEN 1 ELSE {s} END')} AS {c}")
    return f"WITH g AS ({GAPS_SQL}) SELECT l_orderkey, l_linenumber, {', '.join(cells)} FROM g"


def _scaled(spark, sf_dir, kind: str):
    df = gappy_lineitem(spark, sf_dir)
    out = scalers.scale_columns(df, scalers.centre_and_scale(df, _SCALED, kind))
    return rounded(out.select(*KEY, *_SCALED))


@query("scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "StandardScaler")


@query("scale_minmax", _scale_sql("min({c})", "max({c}) - min({c})"))
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "MinMaxScaler")


@query("scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"))
def scale_robust(spark, sf_dir):
    return _scaled(spark, sf_dir, "RobustScaler")


# Category tables: fitted on three quarters of the rows, applied to all, so unseen categories occur. -----

_FIT = "p_partkey % 4 <> 0"


def _encoded(spark, sf_dir, kind: str, columns: list[str], target: str | None = None, **options):
    df = gappy_part(spark, sf_dir)
    if target is not None:
        df, code = coded_target(df, target)
        options["target_col"] = code
    model = CategoryEncoder(columns, kind, prefix="", **options).fit(df.filter(_FIT))
    out = model.transform(df)
    return rounded(out.select("p_partkey", *model.state["outputs"]))


def _coded_sql(columns: list[str], table: str, default: str, suffix: str) -> str:
    source = PART_GAPS_SQL.replace("p_type AS p_type", "p_type AS p_type, p_partkey % 11 AS y")
    joins, cells = [], []
    for i, c in enumerate(columns):
        joins.append(f"LEFT JOIN ({table.format(c=c)}) e{i} ON e{i}.v = coalesce(g.{c}, '__MISSING__')")
        cells.append(f"{r(f'coalesce(e{i}.code, {default})')} AS {c}{suffix}")
    return (f"WITH g AS ({source}), f AS (SELECT * FROM g WHERE {_FIT}) "
            f"SELECT g.p_partkey, {', '.join(cells)} FROM g {' '.join(joins)}")


_V = "coalesce({c}, '__MISSING__')"


@query("encode_frequency", _coded_sql(
    ["p_brand", "p_type"], f"SELECT {_V} AS v, count(*) * 1.0 / (SELECT count(*) FROM f) AS code FROM f GROUP BY 1", "0.0", "_freq"))
def encode_frequency(spark, sf_dir):
    return _encoded(spark, sf_dir, "frequency", ["p_brand", "p_type"])


@query("encode_label", _coded_sql(
    ["p_brand", "p_type"], f"SELECT v, (row_number() OVER (ORDER BY v) - 1)::DOUBLE AS code FROM (SELECT DISTINCT {_V} AS v FROM f) d",
    "-1.0", ""))
def encode_label(spark, sf_dir):
    return _encoded(spark, sf_dir, "label", ["p_brand", "p_type"])


def _mean_sql(smoothing: int) -> str:
    m = "(SELECT avg(p_partkey % 11) FROM f)"
    return f"SELECT {_V} AS v, (sum(p_partkey % 11) + {smoothing} * {m}) / (count(*) + {smoothing}) AS code FROM f GROUP BY 1"


def _target_encoded(spark, sf_dir, kind: str):
    df = gappy_part(spark, sf_dir).withColumn("y", (F.col("p_partkey") % 11).cast("double"))
    model = CategoryEncoder(["p_brand", "p_type"], kind, prefix="", target_col="y").fit(df.filter(_FIT))
    return rounded(model.transform(df).select("p_partkey", *model.state["outputs"]))


@query("encode_target_mean", _coded_sql(["p_brand", "p_type"], _mean_sql(10), "(SELECT avg(p_partkey % 11) FROM f)", "_target_mean"))
def encode_target_mean(spark, sf_dir):
    return _target_encoded(spark, sf_dir, "target")


@query("encode_smoothed_20", _coded_sql(["p_brand", "p_type"], _mean_sql(20), "(SELECT avg(p_partkey % 11) FROM f)", "_catboost_enc"))
def encode_smoothed_20(spark, sf_dir):
    return _target_encoded(spark, sf_dir, "smoothed_20")


@query("encode_target_mean_of_classes", """
    WITH o AS (SELECT *, (dense_rank() OVER (ORDER BY o_orderstatus) - 1)::DOUBLE AS y FROM orders),
    e AS (SELECT o_orderpriority AS v, (sum(y) + 10 * (SELECT avg(y) FROM o)) / (count(*) + 10) AS code FROM o GROUP BY 1)
    SELECT o_orderkey, round(code, 6) + 0.0 AS o_orderpriority_target_mean FROM o JOIN e ON v = o_orderpriority""")
def encode_target_mean_of_classes(spark, sf_dir):
    df, code = coded_target(load(spark, sf_dir, "orders"), "o_orderstatus")
    model = CategoryEncoder(["o_orderpriority"], "target", prefix="", target_col=code).fit(df)
    return rounded(model.transform(df).select("o_orderkey", "o_orderpriority_target_mean"))


_HOT = 10
_HOT_SQL = f"""
    WITH c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1),
    k AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v DESC) AS place, count(*) OVER () AS total FROM c)
    SELECT 'p_brand' AS "column", v AS "value", n::BIGINT AS n,
           (CASE WHEN total <= {_HOT} OR place < {_HOT}
                 THEN row_number() OVER (PARTITION BY total <= {_HOT} OR place < {_HOT} ORDER BY v) - 1
                 ELSE {_HOT - 1} END)::DOUBLE AS code,
           CASE WHEN total <= {_HOT} OR place < {_HOT} THEN v ELSE 'infrequent' END AS name
    FROM k"""


@query("one_hot_table_brand", _HOT_SQL)
def one_hot_table_brand(spark, sf_dir):
    return encoders.one_hot_table(encoders.category_stats(load(spark, sf_dir, "part"), ["p_brand"]), _HOT)


@query("one_hot_rows_type", """
    SELECT p_partkey, """ + ", ".join(
        f"(p_type = '{t}')::INT::DOUBLE AS type_{t.lower()}"
        for t in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " FROM part")
def one_hot_rows_type(spark, sf_dir):
    df = load(spark, sf_dir, "part")
    model = Preprocessor(["p_type"], PreprocessorConfig()).fit(df)
    out = model.transform(df)
    names = feature_names(out)
    x = vector_to_array(FEATURES)
    return out.select("p_partkey", *[F.get(x, F.lit(i)).alias(n.replace("p_type_", "type_").lower()) for i, n in enumerate(names)])


@query("lookup_hot_key",
       "SELECT o.o_orderkey, n.n::BIGINT AS n_orders FROM orders o LEFT JOIN (SELECT CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE o_custkey END "
       "AS k, count(*) AS n FROM orders GROUP BY 1) n ON n.k = CASE WHEN o.o_custkey % 3 = 0 THEN 0 ELSE o.o_custkey END")
def lookup_hot_key(spark, sf_dir):
    """A third of the rows share one key: the shuffled form of the lookup, taken at any size."""
    df = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "case when o_custkey % 3 = 0 then 0 else o_custkey end as k")
    table = df.groupBy(F.col("k").alias("value")).agg(F.count("*").alias("n")).withColumn("n_orders", F.col("n"))
    rows = table.count()
    return attach(df, table, "k", ["n_orders"], lookup_rows=rows, broadcast_rows=10).select("o_orderkey", "n_orders")


_PIPE_SQL = f"""
    WITH g AS ({GAPS_SQL}),
    i AS (SELECT l_orderkey, l_linenumber, coalesce(l_discount, (SELECT quantile_cont(l_discount, 0.5) FROM g)) AS a,
                 coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM g)) AS b,
                 coalesce(l_returnflag, (SELECT l_returnflag FROM g WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS c
          FROM g),
    s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM i)
    SELECT l_orderkey, l_linenumber, {r('(a - ma) / sa')} AS x0, {r('(b - mb) / sb')} AS x1, (c = 'A')::INT::DOUBLE AS x2,
           (c = 'N')::INT::DOUBLE AS x3, (c = 'R')::INT::DOUBLE AS x4 FROM i, s"""


@query("preprocess_lineitem", _PIPE_SQL)
def preprocess_lineitem(spark, sf_dir):
    df = gappy_lineitem(spark, sf_dir)
    config = PreprocessorConfig(scaling_strategy="StandardScaler")
    out = Preprocessor(["l_discount", "l_tax", "l_returnflag"], config).fit(df).transform(df)
    x = vector_to_array(FEATURES)
    return rounded(out.select(*KEY, *[F.get(x, F.lit(i)).alias(f"x{i}") for i in range(5)]))
