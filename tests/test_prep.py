import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.operators import prep as P


def column(df, c, key="id"):
    return [r[c] for r in df.orderBy(key).select(c).collect()]


def test_constant_columns(spark):
    df = spark.range(4).withColumn("x", F.lit(7.0))
    assert column(P.standard_scale(df, df, ["x"]), "x") == [0.0] * 4
    assert column(P.minmax_scale(df, df, ["x"]), "x") == [-1.0] * 4


def test_nan_is_left_out_of_statistics(spark):
    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, 3.0)], "id int, x double")
    assert column(P.impute_mean(df, df, ["x"]), "x") == [1.0, 2.0, 3.0]


def test_missing_test_value_is_an_error(spark):
    df = spark.createDataFrame([(0, 1.0, "train"), (1, None, "test")], "id int, x double, split string")
    with pytest.raises(Exception, match="missing value in the test part"):
        P.drop_nan_rows(df, ["x"], "split").collect()


def test_quantile_normalize_ties_and_ends(spark):
    values = [float(v) for v in ([0] * 30 + list(range(1, 40)) + [40] * 31)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, x double")
    got = column(P.quantile_normalize(df, df, ["x"]), "x")
    q = np.percentile(values, np.linspace(0, 100, 10))
    up = np.interp(values, q, np.linspace(0, 1, 10))
    down = -np.interp(-np.array(values), -q[::-1], -np.linspace(0, 1, 10)[::-1])
    cdf = 0.5 * (up + down)
    assert got[0] == pytest.approx(-5.1993, abs=1e-3) and got[-1] == pytest.approx(5.1993, abs=1e-3)
    from statistics import NormalDist
    for g, c, v in zip(got, cdf, values):
        if q[0] < v < q[-1]:
            assert g == pytest.approx(NormalDist().inv_cdf(c), abs=1e-6)


@pytest.mark.parametrize("rows_per_range", [10**6, 1])
def test_snap_to_real(spark, monkeypatch, rows_per_range):
    real_bounds = P.ranks.value_bounds
    monkeypatch.setattr(P.ranks, "value_bounds",
                        lambda df, v, rows_per_range=None, _r=rows_per_range: real_bounds(df, v, _r))
    real = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (11.0,)], "x double")
    asked = [0.0, 1.5, 1.6, 3.0, 6.9, 7.1, 99.0, 2.0, 7.0]
    synth = spark.createDataFrame(list(enumerate(asked)), "id int, x double")
    assert column(P.snap_to_real(real, synth, "x"), "x_snapped") == [1.0, 1.0, 2.0, 2.0, 4.0, 10.0, 11.0, 2.0, 4.0]


@pytest.mark.parametrize("dist,factor", [("uniform", 1.0), ("beta", 1.0), ("beta", 3.0), ("beta", 0.7), ("beta", 2.5), ("round", 1.0)])
def test_dequantize_and_back(spark, dist, factor):
    df = spark.range(500).withColumn("x", (F.col("id") % 9).cast("double"))
    noisy = P.dequantize(df, ["x"], "id", dist, factor, 1)
    assert column(P.requantize(noisy, ["x"], dist), "x") == column(df, "x")
    if dist != "round":
        spread = np.array(column(noisy, "x")) - np.array(column(df, "x"))
        assert len(set(spread)) > 400
        assert spread.mean() == pytest.approx(0.5 if dist == "uniform" else 0.0, abs=0.05)


def test_beta_quantiles():
    u = np.array([0.0, 1e-12, 0.001, 0.2, 0.4999, 0.5, 0.77, 0.999999, 1.0])
    assert np.allclose(P.beta_quantile(u, 0.5), np.sin(np.pi * u / 2) ** 2, atol=1e-12)
    assert np.allclose(P.beta_quantile(u, 1.0), u, atol=1e-12)
    x = P.beta_quantile(u, 2.0)
    assert np.allclose(3 * x**2 - 2 * x**3, u, atol=1e-12)
    x = P.beta_quantile(u, 1.5)  # a half circle
    assert np.allclose((2 * (2 * x - 1) * np.sqrt(x * (1 - x)) + np.arcsin(2 * x - 1)) / np.pi + 0.5, u, atol=1e-9)
    big = P.beta_quantile(np.array([0.1, 0.5, 0.9]), 5000.0)
    assert np.allclose(big, 0.5 + np.array([-1.2815515655, 0, 1.2815515655]) * 0.5 / np.sqrt(10001), atol=1e-6)


def test_dequantize_needs_a_factor_above_zero(spark):
    with pytest.raises(ValueError):
        P.dequantize(spark.range(3).withColumn("x", F.lit(1.0)), ["x"], "id", "beta", 0.0)


def test_rare_and_unseen_categories(spark):
    train = spark.createDataFrame([(i, v) for i, v in enumerate("aaaaaabbbc")], "id int, c string")
    test = spark.createDataFrame([(0, "a"), (1, "c"), (2, "z")], "id int, c string")
    # round(10 * 0.25) = 2 keeps a and b
    assert column(P.collapse_rare(train, test, ["c"], 0.25), "c") == ["a", "__rare__", "__rare__"]
    assert column(P.ordinal_encode(train, test, ["c"]), "c") == [0, 2, 3]
    assert column(P.one_hot_encode(train, test, ["c"]), "c_onehot") == [[1, 0, 0], [0, 0, 1], [0, 0, 0]]
    assert column(P.one_hot_drop_first(train, test, ["c"]), "c_dummies") == [[0, 0], [0, 1], [0, 0]]


def test_most_frequent_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "nan"), (3, "nan"), (4, "nan")], "id int, c string")
    assert column(P.impute_most_frequent(df, df, ["c"]), "c") == ["b", "a", "a", "a", "a"]


def test_leave_one_out(spark):
    df = spark.createDataFrame([(0, "a", 1.0), (1, "a", 3.0), (2, "b", 5.0)], "id int, c string, y double")
    out = P.leave_one_out_encode(df, df, "c", "y", F.lit(True))
    assert column(out, "c_loo") == [3.0, 1.0, 3.0]


def test_inverse_normal(spark):
    from statistics import NormalDist
    probs = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in probs], "p double").select(P.inverse_normal(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(p) for p in probs], abs=1e-7)


@pytest.mark.parametrize("norm,enc", [("minmax", "one-hot"), ("quantile", "counter"), ("standard", None)])
def test_transform_dataset_options(spark, norm, enc):
    df = spark.range(400).select(
        "id", (F.col("id") * 7 % 50).cast("double").alias("x"),
        F.when(F.col("id") % 5 == 0, "nan").when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
        (F.col("id") % 13).cast("double").alias("y"),
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))
    spec = P.TransformSpec(num=("x",), cat=("c",), int_cols=("x",), y="y", key=("id",), num_nan="mean",
                           dequant="uniform", normalization=norm, cat_nan="most_frequent", min_frequency=0.1,
                           cat_encoding=enc, target_policy="default")
    out = P.transform_dataset(df, spec)
    assert out.count() == 400
    stats = out.where("split = 'train'").agg(F.avg("y"), F.stddev_pop("y")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)


def test_long_vocabulary_with_one_prefix(spark):
    n = 20_000
    train = spark.range(n).select(F.format_string("customer_%08d", F.col("id") * 7).alias("c"))
    codes = {r["value"]: r["code"] for r in P.vocabulary(train, "c").collect()}
    assert len(codes) == n and all(codes[f"customer_{i * 7:08d}"] == i for i in range(0, n, 97))


def test_one_hot_of_unseen_and_missing(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    df = spark.createDataFrame([("a",), ("c",), ("x",), (None,)], "c string")
    got = {r["c"]: (r["c_onehot"], r["c_dummies"]) for r in P.one_hot_drop_first(train, P.one_hot_encode(train, df, ["c"]), ["c"]).collect()}
    assert got == {"a": ([1, 0, 0], [0, 0]), "c": ([0, 0, 1], [0, 1]), "x": ([0, 0, 0], [0, 0]), None: ([0, 0, 0], [0, 0])}
    empty = train.where("c is null")
    assert P.one_hot_encode(empty, df, ["c"]).first()["c_onehot"] == []
