import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.operators import fields as M, trees as TR
from fieldledger.operators.codec import Codec

COLUMNS = [("price", "numeric"), ("kind", "categorical"), ("n", "integer"), ("flag", "binary"), ("one", "categorical")]


def table(spark, n=400):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        k = int(rng.integers(3))
        rows.append((i, float(10 * k + rng.normal()), "cäb"[k], int(5 * k + rng.integers(2)), int(k == 2), "x", i % 2))
    return spark.createDataFrame(rows, "row_id long, price double, kind string, n int, flag int, one string, label int")


def test_codes_and_back(spark):
    df = table(spark)
    codec = Codec.of(df, COLUMNS)
    assert codec.values == ((), ("b", "c", "ä"), (), (), ("x",)) and Codec.from_json(codec.to_json()) == codec
    odd = spark.createDataFrame([(1.5, "b", 3, 0, "x"), (None, "ä", None, 1, None), (2.0, "new", 4, None, "y"), (0.0, None, 0, 1, "x")],
                                "price double, kind string, n int, flag int, one string")
    got = np.array([[np.nan if v is None else v for v in r["features"]] for r in codec.encode(odd).collect()])
    nan = np.nan
    assert np.array_equal(got, [[1.5, 0, 0, 3, 0], [nan, 0, 1, nan, 1], [2, nan, nan, 4, nan], [0, nan, nan, 0, 1]], equal_nan=True)
    back = codec.decode(got)
    assert np.array_equal(back, [[1.5, 0, 3, 0, 0], [nan, 2, nan, 1, 0], [2, nan, 4, nan, 0], [0, nan, 0, 1, 0]], equal_nan=True)
    loose = codec.decode(np.array([[99.0, 0.4, 0.5, 2.5, 0.7], [-1.0, 0.6, 0.7, 3.5, 0.2]]), np.zeros(5), np.array([50.0, 1, 1, 3, 1]))
    assert np.array_equal(loose, [[50, 0, 2, 1, 0], [0, 2, 3, 0, 0]])
    rows = spark.createDataFrame([([1.5, 2.0, 3.0, 1.0, 0.0],), ([nan, nan, 0.0, 0.0, 0.0],)], "d array<double>")
    out = [tuple(r)[1:] for r in codec.to_columns(rows, "d").collect()]
    assert out == [(1.5, "ä", 3, 1, "x"), (None, None, 0, 0, "x")]


def test_bad_codecs(spark):
    df = table(spark, 10)
    with pytest.raises(ValueError):
        Codec.of(df, [("price", "text")])
    with pytest.raises(ValueError):
        Codec.of(df.where("false"), [("kind", "categorical")])
    with pytest.raises(ValueError):
        Codec(("a",), ("categorical",), (tuple(str(i) for i in range(5000)),))


@pytest.mark.parametrize("learner", ["affine", "trees"])
def test_rows_come_back_as_columns_that_fit_together(spark, tmp_path, learner):
    df = table(spark)
    codec = Codec.of(df, COLUMNS)
    coded = codec.encode(df)
    trees = TR.TreeSpec(n_estimators=15, max_depth=4)
    model = M.fit_field(coded, "row_id", "features", M.FieldSpec("flow", learner, bins=64, copies=8, trees=trees), codec=codec)
    model = model.materialize(str(tmp_path / "m"))
    made = codec.to_columns(M.generate(df.select("row_id"), "row_id", model), "generated").collect()
    assert {r["kind"] for r in made} <= set("cäb") and {r["flag"] for r in made} <= {0, 1} and {r["one"] for r in made} == {"x"}
    if learner == "trees":
        means = {k: np.mean([r["price"] for r in made if r["kind"] == k]) for k in "cäb"}
        assert means["c"] < means["ä"] < means["b"]
    own = M.score(coded, "row_id", "features", model, "reconstruction", copies=3)
    assert own.where("score >= 0").count() == 400

    vp = M.fit_field(coded, "row_id", "features", M.FieldSpec("vp", learner, n_t=20, bins=255, copies=8, trees=trees), codec=codec)
    holes = codec.encode(df.withColumn("truth", F.col("kind")).withColumn("kind", F.lit(None).cast("string")))
    out = codec.to_columns(M.impute(holes, "row_id", "features", vp), "features").collect()
    assert np.mean([r["kind"] == r["truth"] for r in out]) > (0.45 if learner == "trees" else 0.7)  # 15 small trees; a guess has 1/3
    truth = {r["row_id"]: r for r in df.collect()}
    assert all(r["price"] == truth[r["row_id"]]["price"] and r["n"] == truth[r["row_id"]]["n"] for r in out)
