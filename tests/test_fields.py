import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.functions import noise as N, scalars as S
from fieldledger.operators import experiment as X, fields as M, learners as L, prep


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, [float(v) for v in rng.normal(size=3) * [1, 5, 0.2]], int(i % 20 == 0), i % 2) for i in range(200)]
    data = [(i, [v + 6 * lab for v in f], lab, c) for i, f, lab, c in data]
    return spark.createDataFrame(data, "row_id long, features array<double>, label int, class int").cache()


SPECS = [M.FieldSpec("flow", n_t=5, copies=2, bins=8), M.FieldSpec("vp", n_t=5, copies=2, bins=8),
         M.FieldSpec("contraction", n_t=5, bins=8)]


def scaled(rows, spec):
    return prep.standard_scale_vector(rows, rows, "features", "features") if spec.kind == "contraction" else rows


@pytest.mark.parametrize("spec", SPECS, ids=lambda s: s.kind)
@pytest.mark.parametrize("which", X.SCORES)
def test_scores_are_finite_and_independent_of_partitions(rows, spec, which, tmp_path):
    data = scaled(rows, spec)
    model = M.fit_field(data, "row_id", "features", spec).materialize(str(tmp_path / "m"))
    a = {r["row_id"]: r["score"] for r in M.score(data.repartition(1), "row_id", "features", model, which).collect()}
    b = {r["row_id"]: r["score"] for r in M.score(data.repartition(7), "row_id", "features", model, which).collect()}
    assert a == b and len(a) == 200 and all(v >= 0 and np.isfinite(v) for v in a.values())


def test_scoring_has_no_shuffle(rows, tmp_path):
    model = M.fit_field(rows, "row_id", "features", SPECS[0]).materialize(str(tmp_path / "m"))
    out = M.score(rows, "row_id", "features", model, "deviation").select("row_id", "score")
    main = out._jdf.queryExecution().optimizedPlan().toString().split("Subquery")[0]
    assert "Aggregate" not in main and "Join" not in main and "Window" not in main


def normals(key, purpose, seed, copy, dims):
    """The noise rule with plain integers."""
    import hashlib

    h = hashlib.md5("|".join(map(str, (key, purpose, seed))).encode()).hexdigest()

    def uniform(word, d):
        x = (word + (copy * 65536 + d + 1) * 0x1E3779B9) % 2**32
        for _ in range(2):
            x = ((x >> 16 ^ x) * 0x45D9F3B) % 2**32
        return x >> 16 ^ x

    a, b = int(h[:8], 16), int(h[8:16], 16)
    return np.array([np.sqrt(-2 * np.log((uniform(a, d) + 0.5) / 2**32)) * np.cos(2 * np.pi * uniform(b, d) / 2**32)
                     for d in range(dims)])


def test_flow_scores_against_numpy(rows, tmp_path):
    spec = M.FieldSpec("flow", n_t=6, copies=2, bins=8)
    model = M.fit_field(rows, "row_id", "features", spec).materialize(str(tmp_path / "m"))
    grid = np.array(model.table.first()["grid"])
    data = {r["row_id"]: np.array(r["features"]) for r in rows.collect()}
    x = np.stack(list(data.values()))
    lo, hi = x.min(0), x.max(0)
    times = np.linspace(spec.eps, 1, spec.n_t)

    def field(i, v):
        b = np.clip(np.floor((v + 4.0) * 8 / 8.0), 0, 7).astype(int)
        return grid[i][np.arange(3), b]

    got = {w: {r["row_id"]: r["score"] for r in M.score(rows, "row_id", "features", model, w).collect()} for w in X.SCORES}
    for key in (0, 20, 57):
        z = (data[key] - lo) / (hi - lo) * 2 - 1
        want = dict.fromkeys(X.SCORES, 0.0)
        for k in range(2):
            x0 = normals(key, "score", 0, k, 3)
            for i in range(3, 5):
                xt = times[i] * z + (1 - times[i]) * x0
                gap = ((z - x0 - field(i, xt)) ** 2).sum()
                want["deviation"] += gap / 2
                want["decision"] += gap / 2 if i == 4 else 0.0
                t, y = times[i], xt
                for _ in range(spec.n_t - 1 - i):
                    y = y + field(int(round(t * 5)), y) / 5
                    t += 1 / 5
                back = np.clip((y + 1) / 2 * (hi - lo) + lo, lo, hi)
                want["reconstruction"] += ((data[key] - back) ** 2).sum() / 2
        for w in X.SCORES:
            assert got[w][key] == pytest.approx(want[w], rel=1e-9)


def test_generated_rows_stay_in_the_training_range(rows):
    lo, hi = np.array([r["features"] for r in rows.collect()]).min(0), np.array([r["features"] for r in rows.collect()]).max(0)
    for spec in SPECS[:2]:
        model = M.fit_field(rows, "row_id", "features", spec)
        out = np.array([r["generated"] for r in M.generate(rows.select("row_id"), "row_id", model).collect()])
        assert out.shape == (200, 3) and (out >= lo - 1e-9).all() and (out <= hi + 1e-9).all()
        assert len({tuple(r) for r in out}) > 150


def test_conditional_generation_draws_labels_by_prior(rows):
    skewed = rows.where("class = 0 OR row_id < 50")
    model = M.fit_field(skewed, "row_id", "features", SPECS[0], label="class")
    priors = prep.class_priors(skewed, "class")
    out = M.generate(rows.select("row_id"), "row_id", model, priors=priors, label="class").collect()
    share = sum(r["class"] for r in out) / len(out)
    assert share == pytest.approx(25 / 125, abs=0.1) and all(len(r["generated"]) == 3 for r in out)


def test_impute_keeps_observed_cells(rows):
    model = M.fit_field(rows, "row_id", "features", SPECS[1])
    holes = rows.withColumn("f", F.transform("features", lambda x, d: F.when((F.col("row_id") + d) % 4 == 0, F.lit(float("nan"))).otherwise(x)))
    for repaint in (False, True):
        out = M.impute(holes.drop("features"), "row_id", "f", model, k=2, repaint=repaint, r=3, j=0.5).collect()
        assert len(out) == 400
        true = {r["row_id"]: r["features"] for r in rows.collect()}
        for r in out:
            for d, v in enumerate(r["f"]):
                assert np.isfinite(v)
                if (r["row_id"] + d) % 4:
                    assert v == true[r["row_id"]][d]
    with pytest.raises(ValueError):
        M.impute(holes, "row_id", "f", M.FieldModel(SPECS[0], model.table, model.ranges))


def test_repaint_schedule():
    plain = M.reverse_schedule(SPECS[1])
    assert [(s["i"], s["back"]) for s in plain] == [(4, 0), (3, 0), (2, 0), (1, 0)]
    again = M.reverse_schedule(SPECS[1], repaint=True, r=2, j=0.4)  # stretches of two steps, done twice
    assert [(s["i"], s["back"]) for s in again] == [
        (4, 0), (3, 0), (3, 1), (4, 0), (3, 0), (2, 0), (1, 0), (1, 1), (2, 0), (1, 0)]


def test_classify_recovers_separated_classes(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(rng.normal() * 0.3 + 4 * (i % 2)) for _ in range(4)], i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, features array<double>, class int")
    model = M.fit_field(df, "row_id", "features", M.FieldSpec("flow", n_t=6, copies=5, bins=16), label="class")
    out = M.classify(df, "row_id", "features", model, n_t=5, n_z=3).collect()
    assert np.mean([r["predicted"] == r["class"] for r in out]) > 0.9
    assert all(sum(r["proba"]) == pytest.approx(1.0) for r in out)


def test_bad_specs():
    for bad in (dict(kind="x"), dict(learner="x"), dict(kind="contraction", learner="linear")):
        with pytest.raises(ValueError):
            M.FieldSpec(**bad)


def test_vp_coefficients_and_grid(spark):
    mean, std = S.vp_coefficients(0.5, 0.1, 8.0)
    assert mean**2 + std**2 == pytest.approx(1.0)
    row = spark.range(1).select(S.vp_mean(F.lit(0.5)).alias("m"), S.vp_std(F.lit(0.5)).alias("s"), S.time_grid(5, 0.001).alias("t")).first()
    assert (row["m"], row["s"]) == (pytest.approx(mean), pytest.approx(std))
    assert row["t"] == pytest.approx(list(np.linspace(0.001, 1, 5)))


def test_noise_is_standard_normal_and_the_same_in_columns_and_arrays(spark):
    df = spark.range(4000).withColumn("w", N.words(F.col("id").cast("string"), "t"))
    rows = df.select("w.a", "w.b", N.normal_replicates(F.lit(3), 2, F.col("w")).alias("z")).collect()
    z = np.array([r["z"] for r in rows])
    assert np.allclose(z, N.normals(np.array([r["a"] for r in rows]), np.array([r["b"] for r in rows]), 2, 3))
    assert np.allclose(z[7, 1], normals_of("7|t", 1))
    assert np.abs(z.mean(0)).max() < 0.06 and z.std(0) == pytest.approx(1.0, abs=0.05)
    # cells of a row do not move together
    assert np.abs(np.corrcoef(z.reshape(4000, 6).T) - np.eye(6)).max() < 0.06


def normals_of(text, copy):
    key, purpose = text.split("|")
    import hashlib

    h = hashlib.md5(text.encode()).hexdigest()
    a = np.array([int(h[:8], 16)]), np.array([int(h[8:16], 16)])
    return N.normals(*a, copy + 1, 3)[0, copy]


def test_sweep_by_label_equals_separate_fits(rows, spark):
    """The conditional fit of all levels gives each level the model of its own training set."""
    spec = M.FieldSpec("flow", n_t=4, copies=2, bins=8, seed=1)
    long, _ = X.score_grid(rows, "row_id", "features", "label", spec, ["decision"], 2, [1])
    normal, bad, test = X.study_parts(rows, "row_id", "features", "label")
    from fieldledger.operators import splits
    levels = splits.contamination_levels(normal, bad, 2)
    train = splits.contaminate(normal, bad, levels, "row_id").where("level_idx = 1")
    model = M.fit_field(train, "row_id", "features", spec)
    want = {r["row_id"]: r["score"] for r in M.score(test, "row_id", "features", model, "decision", seed=1).collect()}
    got = {r["row_id"]: r["score"] for r in long.where("level_idx = 1").collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k], rel=1e-9)


def test_network_gradient_matches_differences():
    net = L.Network.create(3, 5, 4, 0)
    rng = np.random.default_rng(0)
    x, t = rng.normal(size=(7, 3)), rng.uniform(size=7)
    grads, loss = net.gradient(x, t)
    for i in range(6):
        at = tuple(0 for _ in net.weights[i].shape)
        keep = net.weights[i][at]
        net.weights[i][at] = keep + 1e-6
        up = net.gradient(x, t)[1]
        net.weights[i][at] = keep
        assert grads[i][at] == pytest.approx((up - loss) / 1e-6, rel=1e-3, abs=1e-6)


def test_network_learns_and_scores(rows):
    data = prep.standard_scale_vector(rows, rows, "features", "features")
    net, losses = L.fit_contraction_network(data, "row_id", "features", 3, epochs=6, n_batch=2, rate=0.02, hidden=16, embed=8)
    assert len(losses) == 12 and losses[-1] < losses[0]
    for which in X.SCORES:
        out = L.score_network(data, "row_id", "features", net, which, n_t=4).collect()
        assert len(out) == 200 and all(np.isfinite(r["score"]) and r["score"] >= 0 for r in out)


def test_a_step_reads_its_batch(rows, monkeypatch):
    data = prep.standard_scale_vector(rows, rows, "features", "features")
    seen, step = [], L._sum_gradients

    def spy(part, net, features, time, **more):
        used = part._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_b" in used and "Window" not in used and "Subquery" not in used
        seen.append(sorted(r["row_id"] for r in part.select("row_id").collect()))
        return step(part, net, features, time, **more)

    monkeypatch.setattr(L, "_sum_gradients", spy)
    L.fit_contraction_network(data, "row_id", "features", 3, epochs=2, n_batch=4, hidden=8, embed=4)
    assert seen[:4] == seen[4:] and sorted(x for s in seen[:4] for x in s) == list(range(200)) and all(seen)


def test_batches_are_those_of_a_plain_loop(rows):
    """The same network as from numpy over the rows of each hash batch."""
    import hashlib

    data = prep.standard_scale_vector(rows, rows, "features", "features")
    net, losses = L.fit_contraction_network(data, "row_id", "features", 3, epochs=2, n_batch=3, rate=0.01, hidden=8, embed=4)
    md5 = lambda text, n: int(hashlib.md5(text.encode()).hexdigest()[:n], 16)
    x = {r["row_id"]: r["features"] for r in data.collect()}
    batch = {k: md5(f"{k}|batch|0", 8) % 3 for k in x}
    want, m, v, step, found = L.Network.create(3, 8, 4, 0), None, None, 0, []
    m, v = [0 * w for w in want.weights], [0 * w for w in want.weights]
    for epoch in range(2):
        for b in range(3):
            step += 1
            keys = [k for k in x if batch[k] == b]
            t = np.array([md5(f"{k}|time|0|{epoch}", 13) / 2**52 for k in keys])
            grads, loss = want.gradient(np.array([x[k] for k in keys]), t)
            found.append(loss / len(keys))
            for i, g in enumerate(grads):
                g = g / len(keys)
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                want.weights[i] = want.weights[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    assert np.allclose(losses, found)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(net.weights, want.weights))


def test_fit_or_load_tells_data_apart(rows, spark, tmp_path):
    spec, calls = SPECS[2], []
    data = prep.standard_scale_vector(rows, rows, "features", "features")

    def fit(d):
        calls.append(1)
        return M.fit_field(d, "row_id", "features", spec)

    for part in (data, data, data.where("row_id < 100"), data):
        X.fit_or_load(part, "row_id", spec, {"name": "t"}, str(tmp_path), fit)
    assert len(calls) == 2


def test_cache_key_and_fingerprint(spark, tmp_path):
    from fieldledger.operators import experiment as X

    frames = [spark.createDataFrame([(v,) for v in values], "x string") for values in ("aabb", "ccdd", "bbaa")]
    prints = [X.data_fingerprint(f, "x") for f in frames]
    assert prints[0] == prints[2] != prints[1]
    assert X.cache_key({}, "d", M.FieldSpec(bins=4)) != X.cache_key({}, "d", M.FieldSpec(bins=32))


def test_reverse_schedule_goes_through_whole_stretches():
    steps = M.reverse_schedule(M.FieldSpec("vp", n_t=10), repaint=True, r=3, j=0.3)
    assert [(s["i"], s["back"]) for s in steps] == [
        (i, b) for first in (9, 6, 3) for i, b in (
            [(first, 0), (first - 1, 0), (first - 2, 0)] + [(first - 2, 1), (first, 0), (first - 1, 0), (first - 2, 0)] * 2)]
    once = M.reverse_schedule(M.FieldSpec("vp", n_t=10), repaint=True, r=2, j=0.4)
    assert [s["back"] for s in once] == [0] * 4 + [1] + [0] * 4 + [0] * 4 + [1] + [0] * 4 + [0]


def correlated(spark, n=800):
    """Two dimensions that move together and one that does not, in two labels with different slopes."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(n):
        label = i % 2
        x, e, free = rng.normal(), rng.normal() * 0.1, rng.normal()
        rows.append((i, [x, (1.0 if label else -1.0) * x + e, free], label))
    return spark.createDataFrame(rows, "row_id long, features array<double>, label int")


def test_affine_cells_are_least_squares(spark):
    df = correlated(spark, 60).where("label = 1")
    spec = M.FieldSpec("vp", "affine", n_t=4, copies=3, ridge=0.0)
    model = M.fit_field(df, "row_id", "features", spec)
    field = next(iter(M.model_arrays(model).values()))
    rows = sorted(df.collect(), key=lambda r: r["row_id"])
    z = field.unit(np.array([r["features"] for r in rows]))
    words = df.orderBy("row_id").select(N.words(F.col("row_id").cast("string"), "fit", str(spec.seed)).alias("w")).select("w.*").collect()
    noise = N.normals(np.array([w["a"] for w in words]), np.array([w["b"] for w in words]), 3, 3).reshape(-1, 3)
    lv = M.level_weights(spec)[2]
    seen = np.hstack([lv["a"] * np.repeat(z, 3, axis=0) + lv["b"] * noise, np.ones((len(noise), 1))])
    assert np.allclose(field.grid[2], np.linalg.lstsq(seen, noise, rcond=None)[0].T, atol=1e-6)


def test_affine_generates_correlated_columns(spark):
    df = correlated(spark).where("label = 1")
    for kind in ("flow", "vp"):
        model = M.fit_field(df, "row_id", "features", M.FieldSpec(kind, "affine", n_t=20, copies=5))
        x = np.array([r["generated"] for r in M.generate(df.select("row_id"), "row_id", model).collect()])
        c = np.corrcoef(x.T)
        assert c[0, 1] > 0.8 and abs(c[0, 2]) < 0.2


def test_affine_imputes_from_the_row_and_its_label(spark):
    df = correlated(spark)
    model = M.fit_field(df, "row_id", "features", M.FieldSpec("vp", "affine", n_t=40, copies=5), label="label")
    holes = df.withColumn("truth", F.col("features")[1]).withColumn(
        "features", F.transform("features", lambda x, i: F.when(i == 1, F.lit(None).cast("double")).otherwise(x)))
    out = M.impute(holes, "row_id", "features", model, label="label").collect()
    got, truth = np.array([r["features"][1] for r in out]), np.array([r["truth"] for r in out])
    for label in (0, 1):
        own = np.array([r["label"] == label for r in out])
        assert np.corrcoef(got[own], truth[own])[0, 1] > 0.8
    unknown = M.impute(holes.limit(1).withColumn("label", F.lit(7)), "row_id", "features", model, label="label").first()
    assert unknown["features"] is None


def test_affine_scores_and_classifies(spark):
    df = correlated(spark)
    spec = M.FieldSpec("flow", "affine", n_t=10, copies=5)
    model = M.fit_field(df, "row_id", "features", spec, label="label")
    right = M.classify(df, "row_id", "features", model).where("predicted = label").count()
    assert right > 0.85 * df.count()
    odd = df.withColumn("features", F.array(F.col("features")[0], -F.col("features")[1], F.col("features")[2])).withColumn("label", F.col("label"))
    for which in ("deviation", "reconstruction", "decision"):
        plain, turned = (M.score(x, "row_id", "features", model, which, label="label").agg(F.avg("score")).first()[0] for x in (df, odd))
        assert turned > plain
    assert M.score(df.limit(3).withColumn("label", F.lit(9)), "row_id", "features", model, "decision", label="label").where("score is null").count() == 3


def test_reconstruction_rounds_integers(spark):
    df = spark.createDataFrame([(i, [float(i % 5), i / 7.0]) for i in range(60)], "row_id long, features array<double>")
    model = M.fit_field(df, "row_id", "features", M.FieldSpec("vp", n_t=6, copies=3))
    out = M.generate(df.select("row_id"), "row_id", model, int_positions=[0]).collect()
    assert all(r["generated"][0] == round(r["generated"][0]) for r in out)


@pytest.mark.parametrize("kind", ["flow", "vp"])
def test_affine_scores_and_moments_of_all_levels_at_once(spark, kind):
    spec = M.FieldSpec(kind, "affine", n_t=6, copies=5)
    rng = np.random.default_rng(3)
    grid, x, c, noise = rng.normal(size=(6, 2, 4)), rng.random((7, 2)), rng.random((7, 1)), rng.normal(size=(7, 5, 2))
    field = M.Arrays(grid, np.array([[0.0, 0.0], [2.0, 1.0], [2.0, 1.0]]))
    z = field.unit(x)[:, None, :]
    for which in ("deviation", "decision"):
        levels, want = M._level_rows(spec, which), 0.0
        for lv in levels:
            guess = field.at(lv["i"], lv["a"] * z + lv["b"] * noise, spec, c)
            want = want + ((z - noise - guess if kind == "flow" else (guess - noise) / lv["b"]) ** 2).sum(2)
        assert np.allclose(M._affine_scores(z[:, 0], noise, field, spec, levels, c), want.mean(1), rtol=1e-12)
        assert np.allclose(M.score_rows(x, noise, field, spec, which, levels, (), c), want.mean(1), rtol=1e-12)
