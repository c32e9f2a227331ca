"""Ranks and order statistics of a numeric column without a single-task sort.

Values are pre-aggregated, cut into ranges of about ROWS_PER_RANGE rows at approximate
quantiles, and ranked inside each range on top of the totals of the ranges below.
The range bounds only spread the work; results are exact for any bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

ROWS_PER_RANGE = 2_000_000
MAX_RANGES = 10_000


def value_bounds(df: DataFrame, value: str, rows_per_range: int = ROWS_PER_RANGE) -> list[float]:
    """Inner bounds of the ranges; empty when one range is enough. One pass, bounded result."""
    total = df.count()
    ranges = min(MAX_RANGES, total // rows_per_range)
    if ranges < 2:
        return []
    probs = [i / ranges for i in range(1, ranges)]
    found = df.approxQuantile(value, probs, 0.2 / ranges)
    return sorted(set(float(b) for b in found))


def with_range(df: DataFrame, value: str, bounds: Sequence[float]) -> DataFrame:
    """Adds _range, a number that grows with the value."""
    if not bounds:
        return df.withColumn("_range", F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    df = df.withColumn("_v", F.col(value).cast("double"))
    return (
        Bucketizer(splits=splits, inputCol="_v", outputCol="_r", handleInvalid="keep")
        .transform(df).withColumn("_range", F.col("_r").cast("int")).drop("_v", "_r")
    )


def cumulative(
    df: DataFrame, value: str, sums: Sequence[str], keys: Sequence[str] = (),
    bounds: Sequence[float] = (), descending: bool = False,
) -> DataFrame:
    """For rows that are unique per (keys, value): adds <sum>_before, the total of each column
    over the smaller (or larger) values of the same keys."""
    keys = list(keys)
    ranged = with_range(df, value, bounds)

    def towards(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    inside = (
        Window.partitionBy(*keys, "_range").orderBy(towards(value))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    if not bounds:
        out = ranged
        for c in sums:
            out = out.withColumn(f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)))
        return out.drop("_range")
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    across = (
        Window.partitionBy(*keys).orderBy(towards("_range"))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(across), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = ranged.join(offsets, [*keys, "_range"])
    for c in sums:
        out = out.withColumn(
            f"{c}_before", F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}"))
    return out.drop("_range", *[f"_o_{c}" for c in sums])


def average_rank(
    df: DataFrame, value: str, keys: Sequence[str] = (), bounds: Sequence[float] | None = None
) -> DataFrame:
    """Each distinct value with its number of rows and its rank, ties averaged."""
    keys = list(keys)
    if bounds is None:
        bounds = value_bounds(df, value)
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return (
        cumulative(counts, value, ["n"], keys, bounds)
        .withColumn("avg_rank", F.col("n_before") + (F.col("n") + 1) / F.lit(2.0))
        .drop("n_before")
    )


def order_statistics(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation: keys, prob, quantile. prob is in [0, 1]."""
    keys = list(keys)
    if bounds is None:
        bounds = value_bounds(df, value)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    ranked = cumulative(counts, value, ["n"], keys, bounds)

    # the ranks each percentile needs (two per percentile), numbered by block of ranks
    levels = F.split(F.lit(",".join(repr(float(p)) for p in probs)), ",").cast("array<double>")
    grid = F.transform(levels, lambda p, i: F.struct(i.alias("i"), p.alias("p")))
    position = F.col("_g.p") * (F.col("_n") - 1)
    part = position - F.floor(position)
    needed = (
        totals.select(*keys, "_n", F.explode(grid).alias("_g"))
        .select(*keys, "_n", F.col("_g.i").alias("_i"), F.explode(F.array(
            F.struct(F.floor(position).alias("r"), F.lit(False).alias("upper"), part.alias("part")),
            F.struct((F.floor(position) + 1).alias("r"), F.lit(True).alias("upper"), part.alias("part")))).alias("_e"))
        .where(~F.col("_e.upper") | (F.col("_e.part") > 0))
        .select(*keys, "_i", F.col("_e.r").alias("_rank"), F.col("_e.upper").alias("_upper"),
                F.col("_e.part").alias("_part"), _block(F.col("_e.r"), F.col("_n")).alias("_block"))
    )
    # a value holds the sorted rows n_before .. n_before + n - 1, as a rule within one block
    sized = ranked.join(totals, keys) if keys else ranked.withColumn("_n", totals.scalar())
    spread = sized.withColumn("_last", F.col("n_before") + F.col("n") - 1).withColumn(
        "_block", F.explode(F.sequence(_block(F.col("n_before"), F.col("_n")), _block(F.col("_last"), F.col("_n")))))
    low, high = F.max(F.when(~F.col("_upper"), F.col(value))), F.max(F.when(F.col("_upper"), F.col(value)))
    return (
        spread.join(F.broadcast(needed) if not keys else needed, [*keys, "_block"])
        .where((F.col("_rank") >= F.col("n_before")) & (F.col("_rank") <= F.col("_last")))
        # low + (high - low) * part, which is exact where both ranks hold one value
        .groupBy(*keys, "_i").agg((low + F.coalesce((high - low) * F.max("_part"), F.lit(0.0))).alias("quantile"))
        .withColumn("prob", levels[F.col("_i")])
        .select(*keys, "prob", "quantile")
    )


def _block(rank: Column, n: Column) -> Column:
    return F.floor(rank * F.lit(4096) / n).cast("long")
