"""Splits, contamination and row selection.

Random choices are ranks of md5(row key | seed). The k-th smallest hash is found from counts
of hash prefixes plus a rank inside the one prefix that holds it, so no global sort is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.noise import noise_key


def chronological_cutoff(df: DataFrame, date: str, test_size: float = 0.5) -> Column:
    """The date at sorted position int(n * (1 - test_size)), as a scalar subquery.

    Only the per-day counts are ordered; their number is bounded by the calendar."""
    days = df.groupBy(F.col(date).alias("_d")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    days = days.select(
        "_d", F.sum("_c").over(w).alias("_cum"),
        F.sum("_c").over(Window.partitionBy()).alias("_n"),
    )
    position = F.floor(F.col("_n") * F.lit(1.0 - test_size))
    return days.where(F.col("_cum") > position).agg(F.min("_d")).scalar()


def looked_up(spark: SparkSession, value: Column, kind: str) -> Column:
    """A scalar subquery as its value, so that the passes that need it do not each read what it is made from."""
    return F.lit(spark.range(1).select(value.alias("v")).first()[0]).cast(kind)


def chronological_split(df: DataFrame, date: str, test_size: float = 0.5) -> DataFrame:
    """split = train up to and including the cutoff date, test after it."""
    return df.withColumn("_cutoff", chronological_cutoff(df, date, test_size)).withColumn(
        "split", F.when(F.col(date) <= F.col("_cutoff"), "train").otherwise("test")
    ).drop("_cutoff")


def row_hash(key: str | Sequence[str], seed) -> Column:
    keys = [key] if isinstance(key, str) else list(key)
    return F.md5(noise_key(*[F.col(k).cast("string") for k in keys], seed))


def hash_cuts(df: DataFrame, hash_col: str, ranks: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The hash at each wanted rank (from 1) of each group.

    ranks: group columns and `rank`. Returns group columns, rank and `cut`; ranks below 1 give
    no row. Four hex digits make 65,536 prefixes; only the prefixes that hold a wanted rank
    are sorted. The wanted ranks (a few per group) are broadcast: a join on the group would send its rows to one task."""
    group = list(group)
    pre = F.substring(F.col(hash_col), 1, 4)
    counts = df.groupBy(*group, pre.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*group).orderBy("_p")
    counts = counts.withColumn("_cum", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wanted = ranks.groupBy(*group).agg(F.collect_set("rank").alias("_ranks"))
    joined = counts.join(F.broadcast(wanted), group) if group else counts.withColumn("_ranks", wanted.drop(*group).scalar())
    holds = joined.select(
        *group, "_p",
        F.explode(F.filter("_ranks", lambda r: (r > F.col("_cum") - F.col("_c")) & (r <= F.col("_cum"))))
        .alias("rank"),
        (F.col("_cum") - F.col("_c")).alias("_before"),
    )
    inside = (
        df.withColumn("_p", pre)
        .join(F.broadcast(holds.select(*group, "_p").distinct()), [*group, "_p"], "left_semi")
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*group, "_p").orderBy(hash_col)))
        .select(*group, "_p", "_rn", F.col(hash_col).alias("cut"))
    )
    return (
        holds.withColumn("_rn", F.col("rank") - F.col("_before"))
        .join(inside, [*group, "_p", "_rn"]).select(*group, "rank", "cut")
    )


def hash_fraction_split(
    df: DataFrame, key, group: str, seed, first_rows, names=("train", "test"),
) -> DataFrame:
    """Exactly first_rows(n) rows of each group go to the first part. The cuts, one row per group, are broadcast."""
    hashed = df.withColumn("_h", row_hash(key, seed))
    sizes = hashed.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranks = sizes.select(group, first_rows(F.col("_n")).cast("long").alias("rank"))
    cuts = hash_cuts(hashed, "_h", ranks, [group]).select(group, "cut")
    return (
        hashed.join(F.broadcast(cuts), group, "left")
        .withColumn("split", F.when(F.col("_h") <= F.col("cut"), names[0]).otherwise(names[1]))
        .drop("_h", "cut")
    )


def random_half_split(df: DataFrame, key, label: str, seed=42) -> DataFrame:
    """Half of every label, rounded down, to train."""
    return hash_fraction_split(df, key, label, seed, lambda n: F.floor(n / 2))


def stratified_split(df: DataFrame, key, label: str, val_size: float = 0.2, seed=777) -> DataFrame:
    """val_size of every class, rounded up, to val; the rest to train."""
    return hash_fraction_split(
        df, key, label, seed, lambda n: F.ceil(n * F.lit(val_size)), names=("val", "train"))


def contamination_levels(normal: DataFrame, abnormal: DataFrame, n_levels: int = 10,
                         low: float = 0.001) -> DataFrame:
    """level_idx, level, n_ab: anomalies to add so that they make up `level` of the training set."""
    sizes = normal.agg(F.count(F.lit(1)).alias("_nn")).withColumn(
        "_na", abnormal.agg(F.count(F.lit(1))).scalar())
    top = F.col("_na") / (F.col("_na") + F.col("_nn"))
    return (
        sizes.select("_nn", "_na", top.alias("_top"),
                     F.explode(F.sequence(F.lit(0), F.lit(n_levels - 1))).alias("level_idx"))
        .withColumn("level", F.lit(low) + (F.col("_top") - F.lit(low)) * F.col("level_idx") / F.lit(n_levels - 1.0))
        .withColumn("n_ab", F.least(
            F.floor(F.col("level") * F.col("_nn") / (F.lit(1.0) - F.col("level"))), F.col("_na")).cast("long"))
        .select("level_idx", "level", "n_ab")
    )


def contaminate(normal: DataFrame, abnormal: DataFrame, levels: DataFrame, key, seed=42) -> DataFrame:
    """One training set per level: all normal rows plus the first n_ab anomalies in hash order,
    so that the sets are nested. Anomalies meet the levels through an array of cuts, not a join."""
    hashed = abnormal.withColumn("_h", row_hash(key, seed))
    cuts = hash_cuts(hashed, "_h", levels.select(F.col("n_ab").alias("rank")))
    cut_list = (
        levels.join(F.broadcast(cuts), levels["n_ab"] == cuts["rank"], "left")
        .agg(F.array_sort(F.collect_list(F.struct("level_idx", "cut"))).alias("_cuts"))
    )
    bad = (
        hashed.withColumn("_cuts", cut_list.scalar())
        .withColumn("level_idx", F.explode(F.transform(
            F.filter("_cuts", lambda c: F.col("_h") <= c["cut"]), lambda c: c["level_idx"])))
        .drop("_h", "_cuts")
    )
    every = levels.agg(F.array_sort(F.collect_list("level_idx"))).scalar()
    good = normal.withColumn("_l", every).withColumn("level_idx", F.explode("_l")).drop("_l")
    return good.unionByName(bad)


def prefix_take(df: DataFrame, key, n: int, seed=42) -> DataFrame:
    """The n rows that come first in hash order."""
    if n < 1:
        return df.limit(0)
    hashed = df.withColumn("_h", row_hash(key, seed))
    ranks = df.sparkSession.createDataFrame([(n,)], "rank long")
    cut = hash_cuts(hashed, "_h", ranks).select("cut").scalar()
    return hashed.withColumn("_cut", cut).where(
        F.col("_cut").isNull() | (F.col("_h") <= F.col("_cut"))).drop("_h", "_cut")


def drop_all_missing_rows(df: DataFrame, features: str) -> DataFrame:
    return df.where(~F.forall(features, lambda v: v.isNull() | F.isnan(v)))


def has_missing(features: str) -> Column:
    return F.exists(features, lambda v: v.isNull() | F.isnan(v))


def drop_any_missing_rows(df: DataFrame, features: str, remove_missing: bool = False) -> DataFrame:
    """Drop rows with a missing value when asked to; otherwise keep all rows and mark in
    per_dimension whether the fit must run per dimension on its non-missing targets."""
    if remove_missing:
        return df.where(~has_missing(features)).withColumn("per_dimension", F.lit(False))
    return df.withColumn("per_dimension", df.agg(F.bool_or(has_missing(features))).scalar())


def replicate_rows(df: DataFrame, copies: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def batch_assign(df: DataFrame, key, n_batch: int, seed=0) -> DataFrame:
    """Batch number from the row hash: a narrow projection, batches of near-equal size."""
    first = F.conv(F.substring(row_hash(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("batch", (first % n_batch).cast("int"))


def shuffle_rows(df: DataFrame, key, seed=0) -> DataFrame:
    """Random order by row hash: a range-partitioned sort over uniform keys, so no hot task."""
    return df.withColumn("shuffle_key", row_hash(key, seed)).orderBy("shuffle_key")
