import random

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import metrics as M, ranks


@pytest.fixture(scope="module")
def tied(spark):
    return spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "score double, label int")


@pytest.mark.parametrize("bounds", [[], [0.2, 0.4], [0.4], [-5.0, 0.35, 9.0]])
def test_auc_and_ap_with_a_tie(tied, bounds):
    assert M.roc_auc(tied, "score", "label", bounds=bounds).first()[0] == pytest.approx(0.75)
    assert M.average_precision(tied, "score", "label", bounds=bounds).first()[0] == pytest.approx(0.805556, abs=1e-6)


def test_auc_of_the_negated_score(tied):
    a = M.roc_auc(tied, "score", "label").first()[0]
    b = M.roc_auc(tied.withColumn("score", -F.col("score")), "score", "label").first()[0]
    assert a + b == pytest.approx(1.0)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 0)], "score double, label int")
    assert M.roc_auc(df, "score", "label").first()[0] is None


@pytest.mark.parametrize("bounds", [[], [2.0, 5.0, 8.5]])
def test_percentiles_interpolate(spark, bounds):
    df = spark.range(10).withColumn("x", F.col("id").cast("double"))
    got = {r["prob"]: r["quantile"] for r in ranks.order_statistics(df, "x", [0.0, 0.975, 0.5, 1.0], bounds=bounds).collect()}
    assert got == {0.0: 0.0, 0.975: pytest.approx(8.775), 0.5: 4.5, 1.0: 9.0}


def test_percentiles_with_a_hot_value_match_numpy(spark):
    import numpy as np

    rng = random.Random(3)
    values = [5.0] * 400 + [round(rng.uniform(0, 10), 1) for _ in range(800)]
    df = spark.createDataFrame([(v, "k") for v in values], "x double, key string")
    probs = [p / 100 for p in M.PERCENTILES]
    for bounds in ([], [2.0, 5.0, 7.5]):
        for keys in ([], ["key"]):
            got = {r["prob"]: r["quantile"] for r in ranks.order_statistics(df, "x", probs, keys, bounds).collect()}
            assert [got[p] for p in probs] == pytest.approx(list(np.percentile(values, [100 * p for p in probs])))


def test_range_bounds_are_used_above_the_row_target(spark):
    df = spark.range(1000).withColumn("x", F.col("id").cast("double"))
    bounds = ranks.value_bounds(df, "x", rows_per_range=100)
    assert 5 <= len(bounds) <= 9 and bounds == sorted(bounds)
    got = {r["x"]: r["avg_rank"] for r in ranks.average_rank(df, "x", bounds=bounds).collect()}
    assert got == {float(i): i + 1.0 for i in range(1000)}


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_threshold_metrics_against_a_loop(spark, keys):
    import numpy as np

    rng = random.Random(5)
    rows = [(round(rng.gauss(0, 1) + y, 2), y, "k") for y in [0] * 300 + [1] * 40]
    df = spark.createDataFrame(rows, "score double, label int, key string")
    got = {r["percentile"]: r for r in M.threshold_metrics(df, "score", "label", keys=keys).collect()}
    s, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    for p in M.PERCENTILES:
        pred = s > np.percentile(s, p)
        assert got[p]["tp"] == int((pred & (y == 1)).sum()) and got[p]["fp"] == int((pred & (y == 0)).sum())
        assert got[p]["tn"] == int((~pred & (y == 0)).sum()) and got[p]["fn"] == int((~pred & (y == 1)).sum())


def test_best_f1_takes_the_first_of_equals_and_none_for_zero(spark):
    df = spark.createDataFrame([(20.0, 1.0, 0.4), (30.0, 2.0, 0.4), (40.0, 3.0, 0.1)], "percentile double, threshold double, f1 double")
    assert M.best_f1(df).first()["best_percentile"] == 20.0
    assert M.best_f1(df.withColumn("f1", F.lit(0.0))).count() == 0


def test_seed_summary_uses_population_std(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 3.0)], "model string, auroc double")
    assert M.seed_mean_std(df, ["model"], ["auroc"]).first().asDict() == {
        "model": "m", "n_seeds": 2, "auroc_mean": 2.0, "auroc_std": 1.0}


def test_scores_and_labels_are_joined_once(spark, sf, monkeypatch):
    """The area under the curve counts, cuts and ranks its rows, each of which joined them anew."""
    from fieldledger.plans import metrics as P

    plans, found = [], P.M.roc_auc

    def seen(df, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return found(df, *args)

    monkeypatch.setattr(P.M, "roc_auc", seen)
    assert P.score_label_join(spark, sf).count() == 1
    assert len(plans) == 1 and "Join" not in plans[0]


def test_packed_keys_are_equal_only_where_keys_are(spark):
    from fieldledger.plans import metrics as P

    keys = ["", "1", "01", "1-2", "01-2", "1--2", "-1-2", "12", "1-2\n", "+12", "f", "aa", "1f2", "é", "123-4-567-89-19950101", None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: r["p"] for r in df.withColumn("p", P.packed("k")).collect()}
    assert len(set(map(lambda x: x and bytes(x), got.values()))) == len(keys) and got[None] is None
    assert len(got["123-4-567-89-19950101"]) == 11
