from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import scalers, splitting
from tabsmith.operators.lookup import attach
from tabsmith.plans.preprocess import FEATURES, Preprocessor, PreprocessorConfig, feature_names, group_by_strategy
from tabsmith.plans.stages import PREFIX, ROW_ID, CategoryEncoder, ChainedFill, NeighbourFill, ValueFill


def _codes(model, df, column):
    out = model.transform(df)
    return {r["c"]: r[column] for r in out.select("c", column).collect()}


@pytest.fixture(scope="module")
def cats(spark):
    return spark.createDataFrame([("a", 1.0), ("b", 0.0), ("a", 1.0), (None, 0.0)], "c string, y double")


@pytest.fixture(scope="module")
def fresh(spark):
    return spark.createDataFrame([("a",), ("b",), (None,), ("new",)], "c string")


def test_label_codes_follow_value_order_and_unseen_is_minus_one(cats, fresh):
    out = CategoryEncoder(["e"], "label", inputs=["c"], prefix="").fit(cats.filter("c is not null"))
    assert _codes(out, fresh, "e") == {"a": 0.0, "b": 1.0, None: -1.0, "new": -1.0}


def test_frequencies_count_missing_as_a_category(cats, fresh):
    model = CategoryEncoder(["c"], "frequency", prefix="").fit(cats)
    assert _codes(model, fresh, "c_freq") == {"a": 0.5, "b": 0.25, None: 0.25, "new": 0.0}


@pytest.mark.parametrize("kind,weight,column", [("target", 10, "c_target_mean"), ("smoothed_20", 20, "c_catboost_enc")])
def test_target_means_are_smoothed(cats, fresh, kind, weight, column):
    got = _codes(CategoryEncoder(["c"], kind, target_col="y", prefix="").fit(cats), fresh, column)
    assert got["a"] == pytest.approx((2 + weight * 0.5) / (2 + weight))
    assert got["b"] == pytest.approx((0 + weight * 0.5) / (1 + weight))
    assert got["new"] == pytest.approx(0.5)


def test_target_encoding_needs_a_target(cats):
    with pytest.raises(ValueError, match="need a target column"):
        CategoryEncoder(["c"], "target").fit(cats)


def test_one_hot_of_unseen_is_all_zero(cats, fresh):
    config = PreprocessorConfig(missing_strategy="Drop rows")
    model = Preprocessor(["c"], config).fit(cats.filter("c is not null"))
    out = model.transform(fresh.filter("c is not null"))
    got = {r["c"]: list(r["x"]) for r in out.select("c", vector_to_array(FEATURES).alias("x")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 1.0], "new": [0.0, 0.0]}
    assert feature_names(out) == ["c_a", "c_b"]


def test_one_hot_is_capped(spark):
    rows = [(f"v{i:02}",) for i in range(45) for _ in range(i + 1)]
    df = spark.createDataFrame(rows, "c string")
    out = Preprocessor(["c"], PreprocessorConfig(one_hot_max_categories=40)).fit(df).transform(df)
    names = feature_names(out)
    assert len(names) == 40 and names[-1] == "c_infrequent" and names[0] == "c_v06"
    x = vector_to_array(FEATURES)
    assert out.filter(F.get(x, F.lit(39)) == 1.0).select("c").distinct().count() == 6
    assert out.filter(F.aggregate(x, F.lit(0.0), lambda a, v: a + v) != 1.0).count() == 0


def test_lookup_spreads_hot_keys_and_keeps_every_row(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.col("id").cast("string")).alias("k"))
    table = df.filter("k is not null").groupBy(F.col("k").alias("value")).agg(F.count("*").alias("n")).withColumn("v", F.col("n") * 10)
    out = attach(df, table.filter("value <> '1'"), "k", ["v"], lookup_rows=10_000, total=1000, broadcast_rows=10, hot_share=20)
    got = {r["id"]: r["v"] for r in out.collect()}
    assert len(got) == 1000 and got[3] == 3340 and got[2] == 10 and got[1] is None and got[7] is None
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind,expected", [
    ("StandardScaler", [-1.341640786, -0.447213595, 0.447213595, 1.341640786]),
    ("MinMaxScaler", [0.0, 1 / 3, 2 / 3, 1.0]),
    ("RobustScaler", [-1.0, -1 / 3, 1 / 3, 1.0]),
])
def test_scalers(spark, kind, expected):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0), (4.0, 7.0)], "x double, k double")
    out = scalers.scale_columns(df, scalers.centre_and_scale(df, ["x", "k"], kind)).collect()
    assert [r["x"] for r in out] == pytest.approx(expected)
    assert [r["k"] for r in out] == [0.0] * 4


def test_degree_two_order():
    assert [t for t, _, _ in scalers.degree_two_terms(["a", "b"])] == ["a^2", "a b", "b^2"]
    assert [t for t, _, _ in scalers.degree_two_terms(["a", "b"], True)] == ["a b"]


def test_all_missing_column_is_left_out_by_learned_fills(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "x double, gone double")
    for strategy in ("Mean", "Median", "Mode"):
        assert ValueFill(["x", "gone"], strategy).fit(df).state["columns"] == ["x"]
    out = ValueFill(["x", "gone"], "Constant", "3").fit(df).transform(df)
    assert [r[PREFIX + "gone"] for r in out.collect()] == [3.0, 3.0]


def test_text_constant_for_numbers_is_an_error(spark):
    with pytest.raises(ValueError):
        ValueFill(["x"], "Constant", "missing").fit(spark.createDataFrame([(1.0,)], "x double"))


def test_neighbour_fill_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    x[rng.random(x.shape) < 0.25] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, a double, b double, c double")
    out = NeighbourFill(["a", "b", "c"], 4).fit(df).transform(df).orderBy(ROW_ID).collect()
    means = np.nanmean(x, axis=0)
    for i, r in enumerate(out):
        for f, name in enumerate("abc"):
            want = x[i, f]
            if np.isnan(want):
                d = []
                for j in range(len(x)):
                    both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                    if both.any() and not np.isnan(x[j, f]):
                        d.append((((x[i] - x[j])[both] ** 2).sum() * 3 / both.sum(), j))
                want = np.mean([x[j, f] for _, j in sorted(d)[:4]]) if d else means[f]
            assert r[PREFIX + name] == pytest.approx(want)


def test_neighbour_fill_by_sets_of_gaps_measures_few_pairs(spark, monkeypatch):
    from tabsmith.operators import neighbours

    draw = np.random.default_rng(3)
    x = np.column_stack([np.arange(300.0), draw.integers(0, 9, 300), draw.integers(0, 50, 300)])
    x[np.arange(300) % 5 == 1, 1] = np.nan
    x[np.arange(300) % 6 == 2, 2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, f"{ROW_ID} bigint, a double, b double, c double")
    whole = [tuple(r) for r in NeighbourFill(["a", "b", "c"], 4).fit(df).transform(df).orderBy(ROW_ID).collect()]
    searched, plain = [], neighbours.nearest
    monkeypatch.setattr(neighbours, "PAIRS_AT_ONCE", 0, raising=False)
    monkeypatch.setattr(neighbours, "nearest", lambda q, t, *a, **b: searched.append(len(q.first()["x"])) or plain(q, t, *a, cell_rows=20, **b))
    parts = [tuple(r) for r in NeighbourFill(["a", "b", "c"], 4).fit(df).transform(df).orderBy(ROW_ID).collect()]
    assert parts == whole
    assert sorted(searched) == [1, 1, 1, 1, 1, 2, 2], "every pair of sets of gaps over the coordinates it shares"


def test_chained_fill_recovers_a_linear_relation(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=400), rng.normal(size=400)
    c = 2 * a - 3 * b + 1
    rows = [(float(a[i]), float(b[i]) if i % 9 else None, float(c[i]) if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    model = ChainedFill(["a", "b", "c"]).fit(df)
    got = model.transform(df).select(PREFIX + "a", PREFIX + "b", PREFIX + "c").toPandas().to_numpy()
    gaps = np.array([i for i in range(400) if i % 4 == 0 and i % 9])
    mean_error = np.abs(c[gaps] - np.mean(c)).mean()
    assert np.abs(got[gaps, 2] - c[gaps]).mean() < 0.05 * mean_error
    assert np.isfinite(got).all()


@pytest.mark.parametrize("missing", ["Mean", "Median", "Mode", "KNNImputer", "IterativeImputer", "Drop columns"])
@pytest.mark.parametrize("encoding", ["LabelEncoder", "TargetEncoding"])
def test_preprocessor_keeps_rows_and_survives_saving(spark, tmp_path, missing, encoding):
    df = spark.createDataFrame([(0, 1.0, "a", 0.0), (1, 2.0, "b", 1.0), (2, None, "a", 0.0), (3, 4.0, None, 1.0)],
                               f"{ROW_ID} bigint, num double, cat string, label double")
    config = PreprocessorConfig(missing, encoding, "StandardScaler", one_hot_max_categories=30)
    model = Preprocessor(["num", "cat"], config, "label").fit(df)
    rows = model.transform(df).orderBy(ROW_ID).select(FEATURES).collect()
    assert len(rows) == 4 and all(np.isfinite(r[0].toArray()).all() for r in rows)
    path = str(tmp_path / "model")
    model.write().save(path)
    again = PipelineModel.load(path).transform(df).orderBy(ROW_ID).select(FEATURES).collect()
    assert again == rows


def test_config_round_trip():
    config = PreprocessorConfig("Median", "FrequencyEncoding", "RobustScaler", per_column_missing_strategy={"col_a": "Mode"})
    assert PreprocessorConfig.from_dict(config.to_dict()) == config


def test_strategy_groups():
    assert group_by_strategy(["a", "b", "c"], "Median", {"b": "Mode", "c": "Default"}) == {"Median": ["a", "c"], "Mode": ["b"]}


def test_polynomials_stay_within_one_group(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 4.0)], "a double, b double")
    config = PreprocessorConfig(use_polynomial_features=True, per_column_missing_strategy={"b": "Mean"})
    out = Preprocessor(["a", "b"], config).fit(df).transform(df)
    assert feature_names(out) == ["a", "a^2", "b", "b^2"]


def _order(n):
    return sorted(range(n), key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())


@pytest.mark.parametrize("collect", [50_000, 5])
def test_holdout_cuts_at_the_exact_row(spark, monkeypatch, collect):
    monkeypatch.setattr(splitting, "COLLECT", collect)
    df = spark.range(1003).withColumnRenamed("id", "k")
    got = {r["k"] for r in splitting.with_holdout(df, ["k"], 0.8).filter("is_train").collect()}
    assert got == set(_order(1003)[:802])


def test_split_moves_no_rows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("y"))
    plan = splitting.with_holdout(df, ["k"], 0.8, stratify="y")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan and "Sort" not in plan


def test_stratified_shares(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 97 else "c") for i in range(100)], "k int, y string")
    split = splitting.with_holdout(df, ["k"], 0.8, stratify="y")
    got = {r["y"]: r["n"] for r in split.filter("is_train").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 56, "b": 22, "c": 2}


def test_single_member_class_falls_back_to_a_plain_split(spark):
    df = spark.createDataFrame([(i, int(i == 0)) for i in range(50)], "k int, y int")
    assert splitting.with_holdout(df, ["k"], 0.8, stratify="y").filter("is_train").count() == 40


def test_folds_partition_the_rows(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 90 else 2) for i in range(100)], "k int, y int")
    rows = splitting.with_folds(df, ["k"], 5, target="y").collect()
    assert len(rows) == 100 and {r["fold"] for r in rows} == set(range(5))
    for y, size in ((0, 45), (1, 45), (2, 10)):
        counts = [sum(r["y"] == y and r["fold"] == f for r in rows) for f in range(5)]
        assert sum(counts) == size and max(counts) - min(counts) <= 1


def test_folds_are_limited_by_the_smallest_class(spark):
    df = spark.createDataFrame([(i, int(i < 3)) for i in range(30)], "k int, y int")
    assert splitting.with_folds(df, ["k"], 5, target="y").agg(F.max("fold")).first()[0] == 2
    with pytest.raises(ValueError, match="has a single row"):
        splitting.with_folds(df.filter("k >= 2"), ["k"], 5, target="y")
    with pytest.raises(ValueError, match="Folds need two rows"):
        splitting.with_folds(df.limit(1), ["k"], 5)


def test_shift_is_a_permutation_within_blocks(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    moved = splitting.shifted_values(df, ["v", "k"], ["k"], 5, 1).collect()
    assert sorted(r["_moved_0"] for r in moved) == [2 * i for i in range(500)]
    assert all(r["_moved_0"] == 2 * r["_moved_1"] for r in moved)
    assert sum(r["_moved_0"] == r["v"] for r in moved) == 0
