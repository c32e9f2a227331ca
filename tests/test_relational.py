import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldledger.operators import ranks, relational as R
from fieldledger.sources import npz


def rows(seed, n, days=False):
    draw = random.Random(seed)
    value = lambda: None if draw.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(draw.randrange(60)) if days else draw.choice([draw.randrange(30), draw.random() * 30]) * 1.0
    return [(i, draw.choice(["a", "a", "a", "b", None]), value()) for i in range(n)]


def plain(left, right, direction, tolerance):
    out = []
    for i, k, x in left:
        best = None
        for j, kk, y in right:
            if kk != k or x is None or y is None:
                continue
            gap = (y - x).days if isinstance(x, dt.date) else y - x
            if direction == "backward" and gap > 0 or direction == "forward" and gap < 0 or tolerance is not None and abs(gap) > tolerance:
                continue
            order = (abs(gap), gap > 0, -j)
            if best is None or order < best[0]:
                best = (order, j, y)
        out.append((i, k, x, *(best[1:] if best else (None, None))))
    return sorted(out)


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("days, tolerance", [(False, None), (False, 0.4), (True, None), (True, 2)])
def test_nearest_join(spark, monkeypatch, direction, days, tolerance):
    left, right = rows(1, 150, days), rows(2, 60, days)
    kind = "date" if days else "double"
    a = spark.createDataFrame(left, f"i long, k string, x {kind}").repartition(3)
    b = spark.createDataFrame(right, f"j long, kk string, y {kind}")
    for per in (200_000, 20):  # one range, and many
        got = R.nearest_join(a, b, ("x", "y"), [("k", "kk")], {"best": "j", "at": "y"}, direction, tolerance, ["j"], rows_per_range=per)
        assert sorted(map(tuple, got.collect())) == plain(left, right, direction, tolerance)


def test_nearest_join_cases(spark):
    a = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, None)], "i long, x double")
    b = spark.createDataFrame([], "j long, y double")
    assert sorted(map(str, R.nearest_join(a, b, ("x", "y"), [], {"j": "j"}).collect())) == sorted(
        ["Row(i=1, x=1.0, j=None)"] * 2 + ["Row(i=2, x=None, j=None)"])
    assert R.nearest_join(a.limit(0), b, ("x", "y"), [], {"j": "j"}).count() == 0
    with pytest.raises(ValueError):
        R.nearest_join(a, b, ("x", "y"), [], {"j": "j"}, "sideways")


def archive(path, n, compressed=False, order="C", seed=0):
    x = np.asarray(np.random.default_rng(seed).normal(size=(n, 3)), order=order)
    y = np.arange(n) % 2
    (np.savez_compressed if compressed else np.savez)(path, X=x, y=y, other=np.zeros(7))
    return x, y


def test_npz_ranges_of_rows(spark, tmp_path):
    want = {}
    for name, n, more in (("a", 1000, {}), ("b", 7, {}), ("c", 300, {"compressed": True}), ("d", 50, {"order": "F"}), ("e", 0, {})):
        x, y = archive(tmp_path / f"{name}.npz", n, seed=ord(name), **more)
        want.update({(f"{name}.npz", i): (x[i].tolist(), int(y[i])) for i in range(n)})
    df = npz.scan_npz(spark, str(tmp_path), rows=64)
    got = {(r["source"].rsplit("/", 1)[1], r["row_id"]): (r["features"], r["label"]) for r in df.collect()}
    assert got == want
    tasks = df.select("row_id", F.spark_partition_id().alias("p"), "source").groupBy("source").agg(F.count_distinct("p").alias("t")).collect()
    assert sorted(r["t"] for r in tasks) == [1, 1, 1, 16]  # only the stored arrays of 1,000 rows are cut
    assert npz.scan_npz(spark, f"file://{tmp_path}/b.npz").count() == 7


def test_npz_reads_only_the_columns_asked_for(spark, tmp_path, monkeypatch):
    archive(tmp_path / "a.npz", 20)
    out = npz.scan_npz(spark, str(tmp_path), ("label", "row_id"))
    assert out.columns == ["label", "row_id"] and [tuple(r) for r in out.orderBy("row_id").collect()] == [(i % 2, i) for i in range(20)]
    with pytest.raises(Exception, match="unknown columns"):
        npz.scan_npz(spark, str(tmp_path), ("x",)).collect()


def test_npz_bad_archives(spark, tmp_path):
    with pytest.raises(Exception, match="nowhere"):
        npz.scan_npz(spark, str(tmp_path / "nowhere")).collect()
    np.savez(tmp_path / "a.npz", X=np.zeros((3, 2)), y=np.zeros(4))
    with pytest.raises(Exception, match="one length"):
        npz.scan_npz(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert npz.scan_npz(spark, str(tmp_path / "empty")).count() == 0


def test_npz_round_trip(spark, tmp_path):
    df = spark.range(100).select(F.array(F.col("id") * 1.0, F.col("id") / 3.0).alias("x"), (F.col("id") % 4).alias("y")).repartition(3)
    assert npz.write_npz(df, f"{tmp_path}/out", "x", "y").agg(F.sum("n")).first()[0] == 100
    got = npz.scan_npz(spark, f"{tmp_path}/out", ("features", "label")).collect()
    assert sorted((r["features"], r["label"]) for r in got) == sorted((list(r["x"]), r["y"]) for r in df.collect())


def test_keys_of_few_rows_are_not_cut(spark, monkeypatch):
    """Cut into value ranges, the rows of small keys came apart into about one range each."""
    def cut(*_):
        raise AssertionError("cut")

    monkeypatch.setattr(R.ranks, "value_bounds", cut)
    a = spark.createDataFrame([("a", 3.0), (None, 1.0), ("b", 2.0)], "k string, x double")
    b = spark.createDataFrame([("a", 1.0, 1), ("a", 2.5, 2), (None, 0.0, 3)], "k string, y double, j long")
    got = R.nearest_join(a, b, ("x", "y"), [("k", "k")], {"j": "j"}, "backward")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 3.0, 2), ("b", 2.0, None), (None, 1.0, 3)]
    with pytest.raises(AssertionError, match="cut"):
        R.nearest_join(a, b, ("x", "y"), [("k", "k")], {"j": "j"}, "backward", rows_per_range=2)
