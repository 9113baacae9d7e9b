"""Registration of queries, and the pieces of SQL they share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.columns import col
from tabsmith.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


class Catalog:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        if name in self.queries:
            raise ValueError(f"Query {name} is registered twice.")

        def register(fn: Query) -> Query:
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return register

    def include(self, other: Catalog) -> None:
        for name, fn in other.queries.items():
            self.query(name, other.sql.get(name))(fn)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, in the folder that all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that both engines print the same digits; negative zero reads as zero."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    return df.select(*[(F.round(col(c), digits) + F.lit(0.0)).alias(c) if c in doubles else col(c) for c in df.columns])


def r(expr: str, digits: int = 6) -> str:
    """SQL: the same rounding."""
    return f"round({expr}, {digits}) + 0.0"


# No test table holds a null. These expressions read alike in both engines and inject them by key.
GAPS = {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "case when l_orderkey % 7 = 0 then null else l_discount end",
    "l_tax": "case when l_partkey % 3 = 0 then null else l_tax end",
    "l_quantity": "case when l_suppkey % 10 < 7 then null else l_quantity end",
    "l_returnflag": "case when l_linenumber = 3 then null else l_returnflag end",
    "l_linestatus": "l_linestatus",
}
GAPS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in GAPS.items()) + " FROM lineitem"

PART_GAPS = {
    "p_partkey": "p_partkey",
    "p_size": "case when p_partkey % 5 = 1 then null else p_size end",
    "p_retailprice": "case when p_partkey % 6 = 2 then null else p_retailprice end",
    "p_brand": "case when p_partkey % 4 = 3 then null else p_brand end",
    "p_type": "p_type",
}
PART_GAPS_SQL = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in PART_GAPS.items()) + " FROM part"


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "lineitem").selectExpr(*[f"{e} as {c}" for c, e in GAPS.items()])


def gappy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(*[f"{e} as {c}" for c, e in PART_GAPS.items()])


def union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# Columns of the test tables by type, as the oracle needs them.
LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUMBERS = LINEITEM[:8]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
EVENTS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
