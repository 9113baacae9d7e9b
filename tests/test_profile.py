from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import charts, correlation, counts, profile, quantiles, sampling
from tabsmith.operators.running import number_distinct, running_totals


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [
        (1, 1.5, "a", True, dt.datetime(2024, 1, 1)),
        (2, float("nan"), "b", None, dt.datetime(2024, 1, 3)),
        (3, None, "b", False, None),
        (4, 1.5, None, True, dt.datetime(2024, 1, 2)),
    ]
    return spark.createDataFrame(rows, "i int, x double, s string, f boolean, t timestamp")


def test_overview_counts_nan_and_null_alike(mixed):
    got = {r["column"]: r for r in profile.overview(mixed).collect()}
    assert got["x"]["missing_values"] == 2 and got["x"]["missing_pct"] == 50.0 and got["x"]["n_unique"] == 1
    assert got["s"]["missing_values"] == 1 and got["s"]["n_unique"] == 2
    assert got["f"]["n_unique"] == 2 and got["t"]["n_unique"] == 3


def test_overview_refuses_distinct_counts_of_nested_columns(spark):
    df = spark.createDataFrame([([1, 2],), (None,)], "a array<int>")
    row = profile.overview(df).first()
    assert row["missing_values"] == 1 and row["n_unique"] is None


def test_overview_of_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    rows = profile.overview(df).collect()
    assert [r["n_unique"] for r in rows] == [0, 0] and all(r["missing_pct"] is None for r in rows)


def test_approximate_distinct_counts_are_close(table):
    df = table("lineitem")
    exact = counts.distinct_count_map(df, ["l_orderkey"])
    rough = counts.distinct_count_map(df, ["l_orderkey"], approximate=True)
    assert rough["l_orderkey"] == pytest.approx(exact["l_orderkey"], rel=0.05)


def test_negative_zero_is_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,)], "x double")
    assert counts.distinct_count_map(df, ["x"]) == {"x": 1}
    assert counts.value_counts(df, ["x"]).collect()[0]["n"] == 2


def test_describe_follows_the_type(mixed):
    got = {r["column"]: r for r in profile.describe(mixed).collect()}
    assert got["i"]["mean"] == 2.5 and got["i"]["p50"] == 2.5 and got["i"]["top"] is None
    assert got["s"]["top"] == "b" and got["s"]["freq"] == 2 and got["s"]["mean"] is None
    assert got["f"]["top"] == "true" and got["f"]["unique"] == 2
    assert got["t"]["min_ts"] == dt.datetime(2024, 1, 1) and got["t"]["p50_ts"] == dt.datetime(2024, 1, 2)


def test_mode_ties_take_the_smallest_value(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (10, "a"), (9, "b"), (None, None)], "n int, s string")
    assert counts.modes(df, ["n", "s"]) == {"n": 9, "s": "a"}


def test_top_values_count_nulls_under_one_name(spark):
    df = spark.createDataFrame([("a",), (None,), (None,)], "s string")
    assert [tuple(r) for r in counts.top_values(df, "s").collect()] == [("NaN", 2), ("a", 1)]


def test_fingerprint_ignores_row_order_but_not_rows(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i int, s string")
    assert profile.fingerprint_text(a) == profile.fingerprint_text(a.orderBy(F.desc("i")).repartition(3))
    assert profile.fingerprint_text(a) != profile.fingerprint_text(a.distinct())
    assert profile.fingerprint_text(a) != profile.fingerprint_text(a.withColumnRenamed("s", "t"))


def test_duplicate_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, 2)], "a int, b int")
    row = profile.duplicate_rows(df).first()
    assert (row["rows"], row["distinct_rows"], row["duplicate_rows"]) == (4, 3, 1)


@pytest.mark.parametrize("direct_rows", [1_000_000, 50, 3])
def test_quantiles_agree_with_numpy(spark, direct_rows):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.normal(size=300), np.full(200, 0.25), rng.integers(0, 4, 100)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = quantiles.quantiles(df, ["x"], probs, direct_rows=direct_rows)["x"]
    assert got == pytest.approx(list(np.quantile(values, probs)), abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.quantiles(df, ["x"], [0.5]) == {"x": [None]}


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 10, 1])
def test_running_totals_in_buckets(spark, rows_per_bucket):
    df = spark.createDataFrame([("g", f"v{i:03}", i) for i in range(150)] + [("h", "only", 7)], "g string, v string, n bigint")
    got = running_totals(df, ["g"], "v", ["n"], rows_per_bucket=rows_per_bucket).collect()
    for row in got:
        want = 7 if row["g"] == "h" else sum(range(int(row["v"][1:]) + 1))
        assert row["cum_n"] == want
    assert len(got) == 151


def test_running_totals_over_very_many_buckets(spark):
    df = spark.range(600_000).selectExpr("0 as g", "id * 3 as v", "cast(1 as bigint) as n")
    got = running_totals(df, ["g"], "v", ["n"], rows_per_bucket=100).agg(F.count_if(F.col("cum_n") == F.col("v") / 3 + 1), F.count("*")).first()
    assert tuple(got) == (600_000, 600_000), "cuts times drawn values exceed an int"


@pytest.mark.parametrize("value", ["cast(id as string)", "timestamp_seconds(id * 77)", "date_add(date'2000-01-01', cast(id as int))", "id / 7",
                                   "cast(id as decimal(12, 2))", "to_binary(lpad(hex(id), 8, '0'), 'hex')"])
def test_buckets_of_every_type_follow_the_order(spark, value):
    df = spark.range(900).selectExpr("id % 2 as g", f"{value} as v", "id as n")
    got = running_totals(df, ["g"], "v", ["n"], rows_per_bucket=20)
    plain = running_totals(df, ["g"], "v", ["n"])
    assert got.count() == 900 and got.exceptAll(plain).count() == 0


def test_running_totals_use_no_single_window_in_buckets(spark):
    df = spark.createDataFrame([(i,) for i in range(200)], "v int")
    plan = number_distinct(df, "v", rows_per_bucket=10)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in text
    assert sorted(r["position"] for r in plan.collect()) == list(range(1, 201))


def _gappy(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.integers(0, 8, 80).astype(float), "b": rng.normal(size=80)})
    frame["c"] = frame["a"] * 2 + rng.normal(size=80)
    frame.loc[::7, "b"] = np.nan
    frame.loc[3::5, "c"] = np.nan
    frame["k"] = 1e9
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "a double, b double, c double, k double")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
def test_correlation_agrees_with_pandas(spark, method):
    frame, df = _gappy(spark)
    ranks = lambda x, y: (x.rank(), y.rank()) if method == "spearman" else (x, y)
    for row in correlation.correlation(df, method=method).collect():
        both = frame[[row["col_i"], row["col_j"]]].dropna()
        x, y = ranks(both.iloc[:, 0], both.iloc[:, 1])
        if "k" in (row["col_i"], row["col_j"]):
            assert row["r"] is None
        else:
            assert row["r"] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
        assert row["n"] == len(both)


def test_correlation_needs_two_columns(spark):
    assert correlation.correlation(spark.createDataFrame([(1, "a")], "x int, s string")).count() == 0


def test_ranks_through_the_shuffled_lookup(spark):
    values = [1.0] * 40 + [float(i) for i in range(60)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 30, "x double")
    got = sorted(r["x"] for r in correlation.average_ranks(df, ["x"], broadcast_rows=5).collect() if r["x"] is not None)
    assert got == sorted(pd.Series(values).rank())


def test_target_correlation_codes_missing_as_minus_one(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, None), (4.0, "b")], "x double, t string")
    row = correlation.correlation_with_target(df, "t", ["x"]).first()
    assert row["r"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [1, 0, -1, 1])[0, 1])
    first_seen = correlation.correlation_with_target(df.withColumn("k", F.col("x")), "t", ["x"], order_key="k").first()
    assert first_seen["r"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [0, 1, -1, 0])[0, 1])


def test_histogram_covers_all_rows_and_has_unit_area(table):
    df = table("lineitem")
    rows = charts.histogram(df, "l_quantity", 7).collect()
    assert sum(r["n"] for r in rows) == df.count() and len(rows) == 7
    assert sum(r["density"] * (r["high"] - r["low"]) for r in rows) == pytest.approx(1.0)


def test_histogram_reads_numbers_from_text(spark):
    df = spark.createDataFrame([("1",), ("x",), ("3",)], "s string")
    assert sum(r["n"] for r in charts.histogram(df, "s", 2).collect()) == 2
    assert charts.histogram(spark.createDataFrame([("x",)], "s string"), "s").count() == 0


def test_density_curve_agrees_with_the_formula(spark):
    values = np.array([1.0, 2.0, 2.0, 5.0, 9.0])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    rows = charts.density_curve(df, "x", 5).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    for r in rows:
        want = np.exp(-0.5 * ((r["x"] - values) / h) ** 2).sum() / (len(values) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(want)
    assert charts.density_curve(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x").count() == 0


def test_large_table_is_sampled_to_size(spark):
    df = spark.range(2000).withColumnRenamed("id", "x")
    sample, was_sampled = sampling.sample_if_large(df, ["x"], row_threshold=1000, memory_threshold_mb=10_000, sample_size=300)
    assert was_sampled and sample.count() == 300
    assert sample.exceptAll(sampling.sample_rows(df.repartition(5), 300, ["x"])).count() == 0


def test_sample_is_exact_where_rows_share_a_key(spark):
    df = spark.range(2000).selectExpr("id % 300 as k", "id as v", "map('a', id) as m", "array(id) as l")
    for n in (100, 101, 500, 1999):
        drawn = sampling.sample_rows(df.repartition(5), n, ["k"])
        assert drawn.count() == n
        assert {r["v"] for r in drawn.collect()} == {r["v"] for r in sampling.sample_rows(df, n, ["k"]).collect()}


def test_small_table_is_not_reported_as_sampled(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert sampling.sample_if_large(df, ["x"]) == (df, False)


def test_profile_totals(spark):
    df = spark.createDataFrame([(1.0, "a"), (0.0, "b"), (-2.0, "a"), (-2.0, "a")], "x double, s string")
    got = {(r["column"], r["metric"]): r for r in profile.profile(df).collect()}
    assert got["", "rows"]["value"] == 4 and got["", "duplicate_rows"]["value"] == 1
    assert got["x", "zeros"]["value"] == 1 and got["x", "negative"]["value"] == 2
    assert got["s", "top_1"]["text"] == "a" and got["s", "top_1"]["value"] == 3


def test_ranks_of_the_same_rows_share_a_sketch(spark, monkeypatch):
    sketches = []
    plain = quantiles.F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: sketches.append(a) or plain(*a))
    df = spark.range(3000).selectExpr("id * 7 % 3000 as a", "id % 5 as b")
    got = quantiles.quantiles(df, ["a", "b"], [0.1, 0.5, 0.9], direct_rows=100)
    assert got["a"] == pytest.approx([299.9, 1499.5, 2699.1]) and got["b"] == [0, 2, 4]
    assert len(sketches) == 2, "one per column, however many ranks are wanted"


def test_fingerprint_query_shuffles_into_more_tasks_as_rows_grow(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from tabsmith.queries import profiling

    parts, plain = [], DataFrame.repartition
    monkeypatch.setattr(profiling, "TASK_ROWS", 1000)
    monkeypatch.setattr(DataFrame, "repartition", lambda self, n, *c: parts.append(n) or plain(self, n, *c))
    row = profiling.fingerprint_lineitem(spark, "/root/testdata/sf0.001").first()
    assert parts == [5 + row["rows"] // 1000] and row["same_in_any_order"]


def test_correlation_takes_one_pass_whatever_the_offsets(spark):
    draw = np.random.default_rng(4)
    x = draw.normal(size=3000)
    data = {"a": 1e9 + x, "b": np.sort(draw.normal(size=3000)) * 1e6, "c": np.full(3000, 0.1), "d": np.where(draw.random(3000) < 0.3, np.nan, 5e8 - x + draw.normal(size=3000)),
            "e": np.arange(3000) * 1000.0}
    plain = pd.DataFrame(data)
    df = spark.createDataFrame(plain).selectExpr("a", "b", "c", "nullif(d, double('nan')) as d", "e").repartitionByRange(7, "e")
    spark.sparkContext.setJobGroup("one pass", "")
    table = correlation.correlation(df)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("one pass"), "no pass finds the means first"
    spark.sparkContext.setJobGroup("", "")
    expected = (plain - plain.median()).corr()  # pandas itself loses digits to an offset
    for row in table.collect():
        want = expected.loc[row["col_i"], row["col_j"]]
        assert row["n"] == (plain[row["col_i"]].notna() & plain[row["col_j"]].notna()).sum()
        assert (row["r"] is None) == ("c" in (row["col_i"], row["col_j"])) and (row["r"] is None or abs(row["r"] - want) < 1e-9)


def test_ranked_columns_are_not_carried_into_the_next_join(spark, monkeypatch):
    from tabsmith.operators import correlation

    carried, plain = [], correlation.attach
    monkeypatch.setattr(correlation, "attach", lambda df, *a, **k: carried.append(df.columns) or plain(df, *a, **k))
    df = spark.createDataFrame([(float(i), float(-i), float(i % 5)) for i in range(40)], "a double, b double, c double")
    ranks = correlation.average_ranks(df, ["a", "b", "c"], broadcast_rows=0)
    assert carried == [["a", "b", "c"], ["b", "c", "_rank0"], ["c", "_rank0", "_rank1"]]
    assert sorted(tuple(r) for r in ranks.collect())[0] == (1.0, 40.0, 4.5)
