import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import splits as P


def digest(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(997).withColumn("label", (F.col("id") % 11 == 0).cast("int"))


def test_half_split_takes_the_smallest_hashes(rows):
    got = {r["id"]: r["split"] for r in P.random_half_split(rows, "id", "label").collect()}
    for lab in (0, 1):
        ids = sorted((i for i in range(997) if (i % 11 == 0) == bool(lab)), key=lambda i: digest(i, 42))
        assert {i for i in ids if got[i] == "train"} == set(ids[:len(ids) // 2])


def test_split_does_not_depend_on_partitions(rows):
    a = P.random_half_split(rows.repartition(1), "id", "label").select("id", "split")
    b = P.random_half_split(rows.repartition(13), "id", "label").select("id", "split")
    assert a.exceptAll(b).count() == 0


def test_contamination_is_nested_and_complete(rows):
    normal, bad = rows.where("label = 0"), rows.where("label = 1")
    levels = P.contamination_levels(normal, bad)
    n_ab = {r["level_idx"]: r["n_ab"] for r in levels.collect()}
    n_bad, n_good = bad.count(), normal.count()
    got = {}
    for r in P.contaminate(normal, bad, levels, "id").collect():
        got.setdefault(r["level_idx"], []).append((r["label"], r["id"]))
    for i in range(10):
        added = {k for lab, k in got[i] if lab == 1}
        assert len(added) == n_ab[i] and len(got[i]) == n_good + n_ab[i]
        if i:
            assert {k for lab, k in got[i - 1] if lab == 1} <= added
    assert n_ab[0] == int(0.001 * n_good / 0.999) and n_ab[9] in (n_bad, n_bad - 1)


@pytest.mark.parametrize("n", [0, 1, 40, 2000])
def test_prefix_take(rows, n):
    got = {r["id"] for r in P.prefix_take(rows, "id", n).collect()}
    assert got == set(sorted(range(997), key=lambda i: digest(i, 42))[:n])


def test_cutoff_is_the_date_at_the_position(spark):
    df = spark.createDataFrame([(d,) for d in ["2024-01-01"] * 5 + ["2024-01-02"] * 2 + ["2024-01-03"] * 3], "d string")
    got = P.chronological_split(df.withColumn("d", F.to_date("d")), "d", 0.5)
    assert got.where("split = 'train'").count() == 7


def test_batches_cover_all_rows(rows):
    sizes = [r["count"] for r in P.batch_assign(rows, "id", 4).groupBy("batch").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 997 and min(sizes) > 150


def test_missing_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, nan]), (2, [nan, nan]), (3, [1.0, 2.0])], "id int, f array<double>")
    assert sorted(r["id"] for r in P.drop_all_missing_rows(df, "f").collect()) == [1, 3]
    assert [r["id"] for r in P.drop_any_missing_rows(df, "f", True).collect()] == [3]
    kept = P.drop_any_missing_rows(df, "f").collect()
    assert len(kept) == 3 and all(r["per_dimension"] for r in kept)


def test_a_large_group_is_not_sent_to_one_task(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).selectExpr("id", "cast(id % 50 = 0 as int) as label")
        out = P.random_half_split(df, "id", "label")
        assert not re.search(r"SortMergeJoin \[label#\d+\],", out._jdf.queryExecution().executedPlan().toString())
        got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
        assert got == {(0, "train"): 490, (0, "test"): 490, (1, "train"): 10, (1, "test"): 10}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
