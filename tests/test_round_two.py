"""Rules that hold at any size, files that survive, and options that do what they say."""

from __future__ import annotations

import collections

import pytest
from pyspark.sql import functions as F

from tabsmith.operators import counts, quality, sampling, splitting
from tabsmith.operators.cleaning import prepare
from tabsmith.plans.spec import RunSpec
from tabsmith.plans.training import run_workbench, train_models
from tabsmith.plans.tuning import RandomSearch, draw
from tabsmith.sources.delimited import TableLoadError, overlong_rows, read_csv
from tabsmith.sources.tables import load_table, write_rows


def test_csv_survives_a_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", then\nbreak', 1.5), (2, "plain", None), (3, 'a,b;"c"\r\nd', -2.0), (4, " spaces  ", 0.0), (5, None, 7.25), (6, '"', 1e300)]
    df = spark.createDataFrame(rows, "k long, text string, x double").repartition(3)
    write_rows(df, f"{tmp_path}/out")
    back = load_table(spark, f"{tmp_path}/out", "csv")
    assert back.dtypes == [("k", "bigint"), ("text", "string"), ("x", "double")]
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_files_with_other_headers_are_refused(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "b.csv").write_text("b,a\n3,4\n")
    with pytest.raises(TableLoadError, match="different headers"):
        read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])


def test_skipped_rows_are_reported(spark, tmp_path, caplog):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3,4,5\n6\n")
    assert read_csv(spark, str(tmp_path / "a.csv"), report=True).count() == 2
    assert [r["row"] for r in overlong_rows(spark, str(tmp_path / "a.csv")).collect()] == ["3,4,5"]
    assert "1 rows" in caplog.text


def test_text_tops_against_brute_force(spark):
    values = ["b"] * 5 + ["a"] * 5 + ["c"] * 2 + [f"u{i:02d}" for i in range(20)] + [None] * 3
    df = spark.createDataFrame([(v, f"x{i:03d}", "same") for i, v in enumerate(values)], "s string, u string, one string").repartition(4)
    unique, table = counts.text_tops(df, ["s", "u", "one"], 4)
    assert unique == {"s": 23, "u": len(values), "one": 1}
    got = collections.defaultdict(list)
    for r in table.orderBy("place").collect():
        got[r["column"]].append((r["value"], r["n"]))
    assert got["s"] == [("a", 5), ("b", 5), ("c", 2), ("u00", 1)]
    assert got["u"] == [(f"x{i:03d}", 1) for i in range(4)] and got["one"] == [("same", len(values))]


def test_sample_is_a_filter(spark):
    df = spark.range(5000).withColumnRenamed("id", "k").repartition(7)
    drawn = sampling.sample_rows(df, 700, ["k"])
    assert drawn.count() == 700 and {r["k"] for r in drawn.collect()} == {r["k"] for r in sampling.sample_rows(df.repartition(2), 700, ["k"]).collect()}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan
    assert sampling.sample_rows(df, 5000, ["k"]).count() == 5000


def test_many_classes_split_like_few(spark):
    df = spark.range(4000).selectExpr("id as k", "case when id % 3 = 0 then 'hot' else concat('c', id % 97) end as y").repartition(5)
    few = splitting.with_holdout(df, ["k"], 0.7, stratify="y")
    many = splitting.with_holdout(df, ["k"], 0.7, stratify="y", listed_classes=10)
    assert few.columns == many.columns
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()}
    few = splitting.with_folds(df, ["k"], 4, target="y")
    many = splitting.with_folds(df, ["k"], 4, target="y", listed_classes=10)
    assert {tuple(r) for r in few.collect()} == {tuple(r) for r in many.collect()}


def test_last_pair_of_many_features_is_found(spark):
    names = [f"f{i}" for i in range(70)]
    df = spark.range(300).selectExpr(*[f"(id * {2 * i + 3}) % {17 + i} as f{i}" for i in range(69)], "((id * 139) % 85) * 2 as f69")
    table = quality.pair_warnings(df.withColumn("f68", F.col("f69") * 3), names, 0.999)
    assert ("f68", "f69") in {(r["feature"], r["other"]) for r in table.collect()}


def test_search_limits_raise():
    with pytest.raises(ValueError, match="at least one draw"):
        draw({"a": [1, 2]}, 0)
    assert len(draw({"a": list(range(80))}, 60)) == 60


def test_search_uses_the_weights_and_rows_of_the_fit(spark):
    rows = spark.range(400).selectExpr("id as k", "cast(id % 20 as double) as x", "cast(id % 20 < 3 as int) as y")
    spec = RunSpec(["x"], "y", key="k", models=["LogisticRegression"], tuning=True, tuning_iterations=2, evaluation_mode="Cross Validation", cv_folds=3)
    search = RandomSearch()
    summary = train_models(prepare(rows, spec.cleaning()), spec, optimizer=search)
    assert len(search.trials) == 2 and summary.runs["LogisticRegression"].predictions.count() == 400


def test_max_classes_is_an_argument(spark):
    rows = spark.range(200).selectExpr("id as k", "cast(id as double) as x", "cast(id % 40 as int) as y")
    with pytest.raises(ValueError, match="max_classes=10"):
        run_workbench(rows, RunSpec(["x"], "y", key="k", models=["KNN"], max_classes=10))
    assert run_workbench(rows, RunSpec(["x"], "y", key="k", models=["KNN"])).labels == list(range(40))


def test_permutation_with_large_keys(spark):
    rows = spark.range(60).selectExpr("id * 150000000000000000 as k", "cast(id as double) as x", "cast(id * 2 as double) as y")
    run = run_workbench(rows, RunSpec(["x"], "y", "Regression", key="k", models=["KNN"], permutation_importance=True)).runs["KNN"]
    assert run.permutation is not None and run.permutation.first()["importance"] > 0
