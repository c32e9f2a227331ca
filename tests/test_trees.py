import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import noise as N
from fieldledger.operators import experiment as X, fields as M, trees as TR
from test_fields import correlated


def rows_of(spark, n=90, seed=3, holes=False):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        x = [float(v) for v in rng.normal(size=3) * [1, 5, 0.2]]
        if holes and i % 7 == 0:
            x[i % 3] = float("nan")
        data.append((i, x, [float(i % 4)], i % 2))
    return spark.createDataFrame(data, "row_id long, features array<double>, covs array<double>, label int")


def copies_of(df, model, spec, level, covs=None, label=0):
    """Bins and targets of all noised copies of a level, in plain numpy."""
    field = M.model_arrays(model)[label]
    got = df.select("row_id", "features", "covs", N.words(F.col("row_id").cast("string"), "fit", str(spec.seed)).alias("w")).orderBy("row_id").collect()
    z = field.unit(np.array([r["features"] for r in got]))
    noise = N.normals(np.array([r["w"]["a"] for r in got]), np.array([r["w"]["b"] for r in got]), spec.copies, z.shape[1]).reshape(-1, z.shape[1])
    z = np.repeat(z, spec.copies, axis=0)
    lv = M.level_weights(spec)[level]
    x = TR.bins_of(lv["a"] * z + lv["b"] * noise, spec.bins, spec.span)
    if covs:
        c = field.beside([r[covs] for r in got], len(got))
        x = np.hstack([x, np.repeat(TR.bins_of(c * spec.span, spec.bins, spec.span), spec.copies, axis=0)])
    return x, (z - noise if spec.kind == "flow" else noise), field


def plain_tree(x, y, trees, depth=0):
    """The tree that looks at all splits of all rows, as nested (input, cut, left, right) and leaf vectors."""
    n = (~np.isnan(y)).sum(0)

    def leaf(v):
        return np.nansum(v, 0) / np.maximum((~np.isnan(v)).sum(0) + trees.ridge, 1e-300)

    def worth(v):
        return (np.nansum(v, 0) * leaf(v)).sum()

    best = (1e-9 * max(1, n.max()), None)
    if depth < trees.max_depth:
        for f in range(x.shape[1]):
            for cut in range(int(x[:, f].max())):
                left = x[:, f] <= cut
                if min((~np.isnan(y[left])).sum(0).max(), (~np.isnan(y[~left])).sum(0).max()) >= trees.least:
                    gain = worth(y[left]) + worth(y[~left]) - worth(y)
                    if gain > best[0] * (1 + 1e-12):
                        best = (gain, (f, cut, left))
    if best[1] is None:
        return leaf(y)
    f, cut, left = best[1]
    return f, cut, plain_tree(x[left], y[left], trees, depth + 1), plain_tree(x[~left], y[~left], trees, depth + 1)


def plain_at(tree, x):
    if not isinstance(tree, tuple):
        return np.repeat(tree[None], len(x), axis=0)
    f, cut, low, high = tree
    return np.where((x[:, f] <= cut)[:, None], plain_at(low, x), plain_at(high, x))


@pytest.mark.parametrize("kind, covs, holes", [("flow", None, False), ("vp", "covs", False), ("flow", "covs", True)])
def test_boosted_trees_are_those_of_a_row_loop(spark, kind, covs, holes):
    df = rows_of(spark, holes=holes)
    trees = TR.TreeSpec("xgboost", n_estimators=3, max_depth=2, eta=0.5, ridge=1.0)
    spec = M.FieldSpec(kind, "trees", n_t=3, copies=2, bins=12, trees=trees)
    model = M.fit_field(df.repartition(5), "row_id", "features", spec, covs=covs)
    for level in (0, 2):
        x, y, field = copies_of(df, model, spec, level, covs)
        want = np.zeros(y.shape)
        for _ in range(3):
            want = want + 0.5 * plain_at(plain_tree(x, y - want, trees), x)
        got = TR.predicted(field.grid[level], x, trees)
        assert np.allclose(got, want, atol=1e-9)


def test_what_is_kept_beside_the_cells_changes_nothing(spark, monkeypatch):
    df = rows_of(spark, 60)
    spec = M.FieldSpec("flow", "trees", n_t=2, copies=2, bins=10, trees=TR.TreeSpec(n_estimators=5, max_depth=2))
    grids = []
    for keep in (2, 100):
        monkeypatch.setattr(TR, "KEEP", keep)
        grids.append(M.model_arrays(M.fit_field(df, "row_id", "features", spec))[0].grid)
    assert np.allclose(*grids, atol=1e-9)


def test_models_do_not_depend_on_partitions(spark, tmp_path):
    df = rows_of(spark)
    for name in ("lgbm", "random_forest"):
        spec = M.FieldSpec("vp", "trees", n_t=3, copies=3, bins=16, trees=TR.TreeSpec(name, n_estimators=9, max_depth=2, subsample=0.7, columns=0.5))
        a, b = (M.model_arrays(M.fit_field(x, "row_id", "features", spec))[0].grid for x in (df.repartition(1), df.repartition(7)))
        assert np.allclose(a, b, atol=1e-9)
        assert len({tuple(v) for v in a[1, 0].reshape(9, -1).tolist()}) > 1  # the trees differ


def test_generates_imputes_scores_and_classifies(spark, tmp_path):
    df = correlated(spark)
    flow = M.FieldSpec("flow", "trees", n_t=8, copies=10, bins=64, trees=TR.TreeSpec(n_estimators=15, max_depth=4))
    model = M.fit_field(df, "row_id", "features", flow, label="label").materialize(str(tmp_path / "m"))
    assert M.classify(df, "row_id", "features", model, n_z=4).where("predicted = label").count() > 0.85 * df.count()
    odd = df.withColumn("features", F.array(F.col("features")[0], -F.col("features")[1], F.col("features")[2]))
    for which in X.SCORES:
        plain, turned = (M.score(x, "row_id", "features", model, which, copies=3, label="label").agg(F.avg("score")).first()[0] for x in (df, odd))
        assert turned > plain > 0
    one = df.where("label = 1")
    made = M.generate(one.select("row_id"), "row_id", M.fit_field(one, "row_id", "features", flow)).collect()
    assert np.corrcoef(np.array([r["generated"] for r in made]).T)[0, 1] > 0.7

    vp = M.FieldSpec("vp", "trees", n_t=20, copies=8, bins=255, trees=TR.TreeSpec(n_estimators=20, max_depth=4))
    model = M.fit_field(one, "row_id", "features", vp)
    holes = one.withColumn("truth", F.col("features")[1]).withColumn(
        "features", F.transform("features", lambda x, i: F.when(i == 1, F.lit(None).cast("double")).otherwise(x)))
    out = M.impute(holes, "row_id", "features", model).collect()
    assert np.corrcoef([r["features"][1] for r in out], [r["truth"] for r in out])[0, 1] > 0.4


@pytest.mark.parametrize("learner", ["affine", "trees"])
def test_covariates_steer_what_is_filled_in_and_generated(spark, learner):
    rng = np.random.default_rng(5)
    data = [(i, [float(c + 0.1 * rng.normal()), float(rng.normal())], [float(c)]) for i, c in enumerate(rng.normal(size=500))]
    df = spark.createDataFrame(data, "row_id long, features array<double>, covs array<double>")
    spec = M.FieldSpec("vp", learner, n_t=20, copies=6, bins=255, trees=TR.TreeSpec(n_estimators=12, max_depth=4))
    least = 0.4 if learner == "trees" else 0.8
    model = M.fit_field(df, "row_id", "features", spec, covs="covs")
    holes = df.withColumn("truth", F.col("features")[0]).withColumn("features", F.array(F.lit(None).cast("double"), F.col("features")[1]))
    out = M.impute(holes, "row_id", "features", model, covs="covs").collect()
    assert np.corrcoef([r["features"][0] for r in out], [r["truth"] for r in out])[0, 1] > least
    made = M.generate(df.select("row_id", "covs"), "row_id", model, covs="covs").collect()
    assert np.corrcoef([r["generated"][0] for r in made], [r["covs"][0] for r in made])[0, 1] > least
    far = df.withColumn("covs", F.array(-F.col("covs")[0]))
    own, other = (M.score(x, "row_id", "features", model, "deviation", copies=3, covs="covs").agg(F.avg("score")).first()[0] for x in (df, far))
    assert other > own
    with pytest.raises(Exception, match="covariates"):
        M.score(df, "row_id", "features", model, "deviation").collect()
    with pytest.raises(ValueError):
        M.fit_field(df, "row_id", "features", M.FieldSpec("flow"), covs="covs")


def test_empty_rows_and_bad_specs(spark):
    df = rows_of(spark).limit(0)
    spec = M.FieldSpec("flow", "trees", trees=TR.TreeSpec(n_estimators=2, max_depth=1))
    assert M.fit_field(df, "row_id", "features", spec).table.count() == 0
    with pytest.raises(ValueError):
        TR.TreeSpec("perceptron")
    with pytest.raises(ValueError):
        M.FieldSpec("flow", "trees", bins=300)


def test_sweep_and_cache_take_trees(spark, tmp_path):
    rng = np.random.default_rng(8)
    data = [(i, [float(v) + 4 * (i % 10 == 0) for v in rng.normal(size=2)], int(i % 10 == 0)) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, features array<double>, label int")
    spec = M.FieldSpec("flow", "trees", n_t=4, copies=2, bins=16, trees=TR.TreeSpec(n_estimators=2, max_depth=2))
    out = X.sweep(df, "row_id", "features", "label", spec, n_levels=2, seeds=(0, 1)).collect()
    assert {(r["score_kind"], r["level_idx"]) for r in out} == {(k, i) for k in X.SCORES for i in range(2)}
    assert all(0 <= r["auroc_mean"] <= 1 and r["n_seeds"] == 2 for r in out)
    calls = []

    def fit(d):
        calls.append(1)
        return M.fit_field(d, "row_id", "features", spec)

    a, b = (X.fit_or_load(df, "row_id", spec, {}, str(tmp_path), fit) for _ in range(2))
    assert len(calls) == 1
    assert M.score(df, "row_id", "features", a, "decision").exceptAll(M.score(df, "row_id", "features", b, "decision")).count() == 0


@pytest.mark.parametrize("depth", [0, 1, 3, 4, 5, 6, 7])
def test_rows_reach_the_same_nodes_through_bits(depth):
    rng = np.random.default_rng(depth)
    trees, nodes, inputs = 5, 2 ** (depth + 1) - 1, 3
    feature, cut = np.full((trees, nodes), -1, np.int16), rng.integers(0, 32, (trees, nodes)).astype(np.int16)
    for node in range(2**depth - 1):  # a node has a split only below one that has
        grown = np.ones(trees, bool) if node == 0 else feature[:, (node - 1) // 2] >= 0
        feature[:, node] = np.where(grown & (rng.random(trees) < 0.8), rng.integers(0, inputs, trees), -1)
    x = rng.integers(0, 33, (700, inputs)).astype(np.uint8)
    want = np.stack([TR.leaves(f, c, x, depth) for f, c in zip(feature, cut)], axis=1)
    np.testing.assert_array_equal(TR.reached(feature, cut, x, depth), want)


def test_tree_queries_deal_a_table_of_one_file(spark, sf, monkeypatch):
    """Their rows cost far more to work on than to move; one file of few row groups was worked on by as few tasks."""
    from fieldledger.plans import learners as P

    class Stop(Exception):
        pass

    def seen(df, *_):
        raise Stop(df.rdd.getNumPartitions())

    monkeypatch.setattr(P.M, "fit_field", seen)
    with pytest.raises(Stop) as found:
        P.fit_regressor_gbt(spark, sf)
    assert found.value.args[0] >= 4 * spark.sparkContext.defaultParallelism
