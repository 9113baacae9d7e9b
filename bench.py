"""Time the headline queries: one JSON line with the seconds of each.

The table is read, spread over the cores and cached once, which is timed as ``load``; the test file has a
single row group and would otherwise be scanned by one task.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per query (the
median counts). Queries other than the model fits run once before, untimed. Every query reads its whole table.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tabsmith.operators import cleaning, correlation, metrics, profile, quality, splitting  # noqa: E402
from tabsmith.operators.cleaning import CleaningRequest, prepare  # noqa: E402
from tabsmith.plans.spec import RunSpec  # noqa: E402
from tabsmith.plans.stages import CategoryEncoder  # noqa: E402
from tabsmith.plans.training import train_models  # noqa: E402
from tabsmith.queries.base import GAPS, load  # noqa: E402
from tabsmith.queries.evaluation import THREE, _scores, made_up  # noqa: E402
from tabsmith.session import local_session  # noqa: E402

FEATURES = ["l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linestatus"]
KEY = ["l_orderkey", "l_linenumber"]
COLD = {"load", "logistic_regression", "random_forest_supplier", "kmeans"}


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def bench_queries(spark: SparkSession, sf: str) -> dict:
    lineitem = load(spark, sf, "lineitem").repartition(spark.sparkContext.defaultParallelism).persist()
    gappy = lineitem.selectExpr(*[f"{e} as {c}" for c, e in GAPS.items()])
    numbered = lineitem.withColumn("k", F.monotonically_increasing_id())
    predicted = made_up(lineitem, THREE)

    def train(spec: RunSpec, table: DataFrame | None = None):
        data = lineitem if table is None else table
        summary = train_models(prepare(data, spec.cleaning()), spec)
        summary.leaderboard.collect()
        return summary

    def supervised(model: str, params: dict):
        spec = RunSpec(FEATURES, "l_returnflag", key="k", models=[model], model_params={model: params}, scaling_strategy="StandardScaler")
        return train(spec, numbered)

    fitted = {}

    def logistic():
        summary = supervised("LogisticRegression", {})
        fitted["model"] = summary.runs["LogisticRegression"].fitted
        summary.release()

    def scoring():
        if "model" not in fitted:
            logistic()
        drain(fitted["model"].score(lineitem))

    def clusters():
        spec = RunSpec(["l_quantity", "l_discount", "l_extendedprice"], None, "Clustering", key="k", models=["KMeans"], scaling_strategy="StandardScaler")
        train(spec, numbered).release()

    def forest():
        spec = RunSpec(["s_suppkey", "s_nationkey"], "s_acctbal", "Regression", key="s_suppkey", models=["RandomForest"])
        train(spec, load(spark, sf, "supplier")).release()

    def target_encoding():
        table = gappy
        encoder = CategoryEncoder(["l_returnflag", "l_linestatus", "l_orderkey"], "target", target_col="l_extendedprice", prefix="e_")
        drain(encoder.fit(table).transform(table))

    return {
        "load": lineitem.count,
        "overview": lambda: profile.overview(lineitem).collect(),
        "describe": lambda: profile.describe(lineitem).collect(),
        "profile": lambda: profile.profile(lineitem).collect(),
        "pearson": lambda: correlation.correlation(lineitem).collect(),
        "spearman": lambda: correlation.correlation(lineitem, method="spearman").collect(),
        "warnings": lambda: quality.warnings(lineitem, lineitem.columns, "l_returnflag").collect(),
        "cleaning_chain": lambda: drain(cleaning.clean(gappy, CleaningRequest(
            ["l_discount", "l_tax", "l_extendedprice", "l_quantity"], "l_returnflag", remove_duplicates=True,
            outlier_strategy="Clip (Winsorize)", per_column_missing_strategy={"l_discount": "Mean", "l_tax": "Median"})).frame),
        "target_encoding": target_encoding,
        "stratified_split": lambda: drain(splitting.with_holdout(lineitem, KEY, 0.8, stratify="l_returnflag")),
        "report_and_areas": lambda: (
            metrics.classification_report(predicted).collect(),
            metrics.classification_metrics(predicted, scores=_scores()).collect(),
        ),
        "logistic_regression": logistic,
        "random_forest_supplier": forest,
        "kmeans": clusters,
        "batch_scoring": scoring,
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, app="tabsmith-bench")
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    every = {n: q for n, q in bench_queries(spark, sf).items() if not only or n in only}
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # starts the executor threads
    seconds = {}
    for name, query in every.items():
        if name not in COLD:
            query()
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            query()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf).name}))
    spark.stop()


if __name__ == "__main__":
    main()
