"""Tabular preprocessing: statistics are fitted on one DataFrame and applied to others.

Fitted numeric statistics are one row, used as a scalar subquery; vocabularies are joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.noise import hash_uniform, noise_key
from ..session import cut_lineage
from . import ranks

# fixed values
CAT_MISSING = "nan"
CAT_RARE = "__rare__"


# numeric columns --------------------------------------------------------------------

def _present(col: Column) -> Column:
    """Null for NaN, so that aggregates skip it."""
    return F.when(~F.isnan(col), col)


def column_stats(df: DataFrame, cols: Sequence[str], **aggregates) -> DataFrame:
    """One row, one struct column per input column."""
    return df.agg(*[
        F.struct(*[fn(_present(F.col(c).cast("double"))).alias(n) for n, fn in aggregates.items()]).alias(c)
        for c in cols
    ])


def with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    packed = stats.select(F.struct(*stats.columns).alias("_stats"))
    return df.withColumn("_stats", packed.scalar())


def standard_scale(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - mean) / population std; a constant column is only centred."""
    stats = column_stats(train, cols, m=F.avg, s=F.stddev_pop, lo=F.min, hi=F.max)
    out = with_stats(df, stats)
    scaled = {
        c: (F.col(c) - F.col(f"_stats.{c}.m"))
        / F.when(F.col(f"_stats.{c}.hi") > F.col(f"_stats.{c}.lo"), F.col(f"_stats.{c}.s")).otherwise(F.lit(1.0))
        for c in cols
    }
    return out.withColumns(scaled).drop("_stats")


def minmax_scale(train: DataFrame, df: DataFrame, cols: Sequence[str], low=-1.0, high=1.0) -> DataFrame:
    """Linear map of the training range to [low, high]; a constant column maps to low."""
    out = with_stats(df, column_stats(train, cols, lo=F.min, hi=F.max))

    def scaled(c: str) -> Column:
        lo, hi = F.col(f"_stats.{c}.lo"), F.col(f"_stats.{c}.hi")
        width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        return (F.col(c) - lo) / width * F.lit(high - low) + F.lit(low)

    return out.withColumns({c: scaled(c) for c in cols}).drop("_stats")


def minmax_unscale(train: DataFrame, df: DataFrame, cols: Sequence[str], low=-1.0, high=1.0) -> DataFrame:
    out = with_stats(df, column_stats(train, cols, lo=F.min, hi=F.max))

    def raw(c: str) -> Column:
        lo, hi = F.col(f"_stats.{c}.lo"), F.col(f"_stats.{c}.hi")
        width = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
        return (F.col(c) - F.lit(low)) / F.lit(high - low) * width + lo

    return out.withColumns({c: raw(c) for c in cols}).drop("_stats")


def impute_mean(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    out = with_stats(df, column_stats(train, cols, m=F.avg))
    return out.withColumns({
        c: F.coalesce(_present(F.col(c).cast("double")), F.col(f"_stats.{c}.m")) for c in cols
    }).drop("_stats")


def drop_nan_rows(df: DataFrame, cols: Sequence[str], split: str | None = None, keep_part="test") -> DataFrame:
    """Drop rows with a missing number; a missing number in the test part is an error."""
    missing = F.lit(False)
    for c in cols:
        missing = missing | F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    if split is None:
        return df.where(~missing)
    bad_test = missing & (F.col(split) == keep_part)
    return df.where(F.when(bad_test, F.raise_error(F.lit("missing value in the test part")).cast("boolean"))
                    .otherwise(~missing))


def vector_stats(df: DataFrame, features: str) -> DataFrame:
    """d, mean, std, lo, hi, n per position of an array column; NaN ignored. Map-side combined:
    every task sends one row per position."""
    long = df.select(F.posexplode(features).alias("d", "v")).where(~F.isnan("v"))
    return long.groupBy("d").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n"))


def _vector(stats: DataFrame, value: Column) -> Column:
    """One array over positions, as a scalar subquery."""
    packed = stats.agg(F.array_sort(F.collect_list(F.struct("d", value.alias("v")))).alias("a"))
    return packed.select(F.transform("a", lambda e: e["v"])).scalar()


def standard_scale_vector(train: DataFrame, df: DataFrame, features: str, out: str = "z") -> DataFrame:
    stats = vector_stats(train, features)
    sd = F.when(F.col("hi") > F.col("lo"), F.col("std")).otherwise(F.lit(1.0))
    return (
        df.withColumn("_st", _vector(stats, F.struct(F.col("mean").alias("m"), sd.alias("s"))))
        .withColumn(out, F.zip_with(features, "_st", lambda x, s: (x - s["m"]) / s["s"])).drop("_st")
    )


def minmax_vector(train: DataFrame, features: str) -> Column:
    """array<struct(lo, w)> of the training range, as a scalar subquery; w = 1 for a constant."""
    w = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    return _vector(vector_stats(train, features),
                   F.struct(F.col("lo").alias("lo"), w.alias("w"), F.col("hi").alias("hi")))


def scale_to_unit(features, ranges) -> Column:
    """[-1, 1] by the training range."""
    return F.zip_with(features, ranges, lambda x, s: (x - s["lo"]) / s["w"] * F.lit(2.0) - F.lit(1.0))


def unscale_from_unit(features, ranges) -> Column:
    return F.zip_with(features, ranges, lambda x, s: (x + F.lit(1.0)) / F.lit(2.0) * s["w"] + s["lo"])


def clip_to_range(features, ranges, int_positions: Sequence[int] = ()) -> Column:
    """Round the integer positions half-even, then clamp to the training range."""
    pairs = F.arrays_zip(F.col(features).alias("x") if isinstance(features, str) else features.alias("x"),
                         F.col(ranges).alias("r") if isinstance(ranges, str) else ranges.alias("r"))

    def one(e: Column, i: Column) -> Column:
        x = e["x"]
        if int_positions:
            x = F.when(i.isin([int(p) for p in int_positions]), F.rint(x)).otherwise(x)
        return F.greatest(F.least(x, e["r"]["hi"]), e["r"]["lo"])

    return F.transform(pairs, one)


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal by Acklam's rational approximation (relative error 1.2e-9).

    The coefficients are the published fixed values."""
    a = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
    b = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)

    def poly(x: Column, coef, tail=None) -> Column:
        out = F.lit(coef[0])
        for k in coef[1:]:
            out = out * x + F.lit(k)
        return out if tail is None else out * x + F.lit(tail)

    def edge(prob: Column) -> Column:
        q = F.sqrt(F.lit(-2.0) * F.log(prob))
        return poly(q, c) / poly(q, d, 1.0)

    mid = p - F.lit(0.5)
    r = mid * mid
    return (
        F.when(p < 0.02425, edge(p))
        .when(p > 1 - 0.02425, -edge(F.lit(1.0) - p))
        .otherwise(poly(r, a) * mid / poly(r, b, 1.0))
    )


def quantile_count(n_rows: int) -> int:
    return max(min(n_rows // 30, 1000), 10)


def quantile_normalize(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Map each column through its piecewise-linear training CDF to a normal quantile.

    The reference points are exact order statistics, at most 1000 per column, and are held by
    the plan; each row finds its segment by binary search. Runs of equal points map to the
    middle of the run, the ends to the ends."""
    n_q = quantile_count(train.count())
    probs = [i / (n_q - 1) for i in range(n_q)]
    low, high = 1e-7, 1.0 - 1e-7
    out = df
    for c in cols:
        points = [
            r["quantile"] for r in ranks.order_statistics(train.where(~F.isnan(c)), c, probs).orderBy("prob").collect()
        ]
        first: dict[float, int] = {}
        last: dict[float, int] = {}
        for i, q in enumerate(points):
            first.setdefault(q, i)
            last[q] = i
        marks = sorted(first)

        # one row per segment between distinct points, at most 1001
        rows = [(0, None, None, None, None, None)]
        for j, m in enumerate(marks):
            up = marks[j + 1] if j + 1 < len(marks) else None
            rows.append((j + 1, m, first[m], last[m], up, None if up is None else first[up]))
        segments = df.sparkSession.createDataFrame(
            rows, "_seg int, _start double, _begin int, _end int, _next double, _next_at int")
        out = out.withColumn("_x", F.col(c).cast("double"))
        out = Bucketizer(splits=[float("-inf"), *marks, float("inf")], inputCol="_x", outputCol="_b",
                         handleInvalid="keep").transform(out)
        out = out.withColumn("_seg", F.col("_b").cast("int")).join(F.broadcast(segments), "_seg", "left")
        x, start, end = F.col(c), F.col("_start"), F.col("_end")
        cdf = (
            F.when(x.isNull() | F.isnan(x), None)
            .when((F.col("_seg") == 0) | ((F.col("_seg") == 1) & (x == start)), F.lit(0.0))
            .when(F.col("_seg") == len(marks), F.lit(1.0))
            .when(x == start, (F.col("_begin") + end) / F.lit(2.0 * (n_q - 1)))
            .otherwise((end + (x - start) / (F.col("_next") - start) * (F.col("_next_at") - end)) / F.lit(n_q - 1.0))
        )
        out = out.withColumn("_p", cdf).withColumn(
            c, inverse_normal(F.greatest(F.least(F.col("_p"), F.lit(high)), F.lit(low)))
        ).drop("_x", "_b", "_seg", "_start", "_begin", "_end", "_next", "_next_at", "_p")
    return out


def standardize_target(train: DataFrame, df: DataFrame, y: str) -> DataFrame:
    """Regression target to zero mean and unit population std of the training part."""
    out = with_stats(df, column_stats(train, [y], m=F.avg, s=F.stddev_pop))
    return out.withColumn(y, (F.col(y) - F.col(f"_stats.{y}.m")) / F.col(f"_stats.{y}.s")).drop("_stats")


def beta_quantile(u: np.ndarray, a: float) -> np.ndarray:
    """Quantiles of Beta(a, a): bisection on the regularized incomplete beta function, whose continued fraction converges fast on
    the lower half; the upper half is its mirror image."""
    low = np.minimum(u, 1.0 - u)
    left, right = np.zeros(len(u)), np.full(len(u), 0.5)
    scale = math.lgamma(2 * a) - 2 * math.lgamma(a) - math.log(a)
    for _ in range(64):
        x = (left + right) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            front = np.exp(scale + a * (np.log(x) + np.log1p(-x)))
        c, d = np.ones(len(x)), 1.0 / np.maximum(1.0 - 2 * a * x / (a + 1.0), 1e-300)
        f = d.copy()
        for m in range(1, 200):
            for top in (m * (a - m) / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (2 * a + m) / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + top * x * d
                d = 1.0 / np.where(np.abs(d) < 1e-300, 1e-300, d)
                c = 1.0 + top * x / c
                c = np.where(np.abs(c) < 1e-300, 1e-300, c)
                step = c * d
                f = f * step
            if np.abs(step - 1.0).max(initial=0.0) < 1e-15:
                break
        below = np.where(x > 0, front * f, 0.0) < low
        left, right = np.where(below, x, left), np.where(below, right, x)
    x = (left + right) / 2
    return np.where(u > 0.5, 1.0 - x, x)


def dequantize(df: DataFrame, cols: Sequence[str], key, dist: str = "uniform", factor: float = 1.0,
               seed=0) -> DataFrame:
    """Spread integers by hash noise. uniform adds U * factor; beta adds Beta(factor, factor) - 0.5 for any factor above 0, drawn for
    whole factors up to 8 as the order statistic of 2 * factor - 1 uniforms, for others as the quantile of one, in Arrow batches."""
    if dist in ("round", "none"):
        return df
    keys = [F.col(k).cast("string") for k in ([key] if isinstance(key, str) else key)]

    def uniform(c: str, i=0) -> Column:
        return hash_uniform(noise_key(*keys, c, seed, i))

    if dist == "uniform":
        return df.withColumns({c: F.col(c) + uniform(c) * F.lit(factor) for c in cols})
    if dist == "beta":
        if not factor > 0:
            raise ValueError("beta dequantization takes a factor above 0")
        a = int(factor)
        if a != factor or a > 8:
            @F.pandas_udf("double")
            def drawn(u: pd.Series) -> pd.Series:
                return pd.Series(beta_quantile(u.to_numpy(), float(factor)))

            return df.withColumns({c: F.col(c) + drawn(uniform(c)) - F.lit(0.5) for c in cols})
        draws = {
            c: F.col(c) + F.array_sort(F.array(*[uniform(c, i) for i in range(2 * a - 1)]))[a - 1] - F.lit(0.5)
            for c in cols
        }
        return df.withColumns(draws)
    raise ValueError(f"unknown distribution {dist}")


def requantize(df: DataFrame, cols: Sequence[str], dist: str = "uniform") -> DataFrame:
    if dist == "none":
        return df
    back = F.floor if dist == "uniform" else F.rint
    return df.withColumns({c: back(F.col(c)).cast("double") for c in cols})


# categorical columns ----------------------------------------------------------------

def category_counts(train: DataFrame, col: str) -> DataFrame:
    return train.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def impute_most_frequent(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """'nan' becomes the most frequent training value; the smallest of equally frequent ones."""
    out = df
    for c in cols:
        mode = (
            category_counts(train.where(F.col(c) != CAT_MISSING), c)
            .agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("value")))["value"]).scalar()
        )
        out = out.withColumn("_mode", mode).withColumn(
            c, F.when(F.col(c) == CAT_MISSING, F.col("_mode")).otherwise(F.col(c))).drop("_mode")
    return out


def collapse_rare(train: DataFrame, df: DataFrame, cols: Sequence[str], min_frequency: float) -> DataFrame:
    """Values seen fewer than round(n * min_frequency) times (half-even) become '__rare__'."""
    if not 0.0 < min_frequency < 1.0:
        raise ValueError("min_frequency must be in (0, 1)")
    least = train.agg(F.rint(F.count(F.lit(1)) * F.lit(min_frequency)).alias("m")).scalar()
    out = df
    for c in cols:
        kept = (
            category_counts(train, c).withColumn("_m", least).where(F.col("n") >= F.col("_m"))
            .select(F.col("value").alias(c), F.lit(True).alias("_keep"))
        )
        out = out.join(kept, c, "left").withColumn(
            c, F.when(F.col("_keep"), F.col(c)).otherwise(F.lit(CAT_RARE))).drop("_keep")
    return out


def vocabulary(train: DataFrame, col: str) -> DataFrame:
    """value, code: the sorted distinct values numbered from 0. Values are dealt out by ranges of whole values (a
    shared beginning does not matter), numbered inside a range and on top of the counts of the ranges below."""
    values = train.where(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    dealt = cut_lineage(values.repartitionByRange("value").withColumn("_range", F.spark_partition_id()), "vocabulary")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    starts = sizes.select("_range", F.coalesce(
        F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_range").orderBy("value")) - 1
    return dealt.withColumn("_rank", rank).join(F.broadcast(starts), "_range").select(
        "value", (F.col("_start") + F.col("_rank")).cast("long").alias("code"))


def ordinal_encode(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Position among the sorted training values; an unseen value gets the largest code + 1."""
    out = df
    for c in cols:
        vocab = vocabulary(train, c)
        size = vocab.agg(F.count(F.lit(1))).scalar()
        out = (
            out.join(vocab.withColumnRenamed("value", c), c, "left").withColumn("_size", size)
            .withColumn(c, F.coalesce(F.col("code"), F.col("_size"))).drop("code", "_size")
        )
    return out


def _indicators(train: DataFrame, df: DataFrame, col: str, out: str, first: int) -> DataFrame:
    """out: one 0/1 entry per training value from position `first` on. The rows get the position by a join; the
    vocabulary itself never meets in one row."""
    vocab = cut_lineage(vocabulary(train, col), "codes").select(F.col("value").alias(col), F.col("code").alias("_code"))
    size = vocab.agg(F.count(F.lit(1)).cast("int")).scalar()
    places = F.slice(F.sequence(F.lit(0), F.greatest("_size", F.lit(1)) - 1), F.lit(first + 1), F.greatest(F.col("_size") - first, F.lit(0)))
    marks = F.transform(places, lambda i: (i == F.coalesce("_code", F.lit(-1))).cast("double"))
    return df.join(vocab, col, "left").withColumn("_size", size).withColumn(out, marks).drop("_code", "_size")


def one_hot_encode(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """<col>_onehot: one 0/1 entry per sorted training value, all zero for an unseen or missing value."""
    for c in cols:
        df = _indicators(train, df, c, f"{c}_onehot", 0)
    return df


def one_hot_drop_first(train: DataFrame, df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """<col>_dummies: as one_hot_encode without the first value, which is all zero."""
    for c in cols:
        df = _indicators(train, df, c, f"{c}_dummies", 1)
    return df


def decode_one_hot(dummies) -> Column:
    """Code of the largest dummy above 0.5, else 0 for the value without a dummy."""
    d = F.col(dummies) if isinstance(dummies, str) else dummies
    with_first = F.concat(F.array(F.lit(0.5)), d)
    return F.array_position(with_first, F.array_max(with_first)) - 1


def leave_one_out_encode(train: DataFrame, df: DataFrame, col: str, y: str, is_train: Column) -> DataFrame:
    """Mean target of the category; a training row leaves its own target out. Values that are
    unseen, or seen once, get the global mean. Categories are summed first, then joined."""
    sums = train.groupBy(col).agg(F.sum(y).alias("_s"), F.count(F.lit(1)).alias("_n"))
    overall = train.agg(F.avg(y)).scalar()
    out = df.join(sums, col, "left").withColumn("_g", overall)
    held_out = F.when(F.col("_n") > 1, (F.col("_s") - F.col(y)) / (F.col("_n") - 1))
    return out.withColumn(
        f"{col}_loo", F.coalesce(F.when(is_train, held_out).otherwise(F.col("_s") / F.col("_n")), F.col("_g"))
    ).drop("_s", "_n", "_g")


def category_sizes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, n: distinct values per categorical column."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "n")


def class_priors(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy()))


def concat_features(num: str, *cats: str) -> Column:
    return F.concat(num, *cats)


def snap_to_real(real: DataFrame, synth: DataFrame, col: str) -> DataFrame:
    """Each synthetic value moves to the nearest value that occurs in real; ties go down.

    Real values (distinct) and synthetic rows are ranked together in value ranges; the nearest
    real value on each side comes from a window inside the range, and from the neighbouring
    ranges where the range has none."""
    values = real.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    # equal synthetic values need one answer: ask once per value
    asked = synth.select(F.col(col).cast("double").alias("_x")).where(F.col("_x").isNotNull()).distinct()
    # ranges of both together: few real values must not send all synthetic ones to one task
    bounds = ranks.value_bounds(values.union(asked), "_x", rows_per_range=200_000)
    marks = values.withColumn("_real", F.col("_x"))
    asked = asked.withColumn("_real", F.lit(None).cast("double"))
    both = ranks.with_range(marks.unionByName(asked), "_x", bounds)
    edges = both.where(F.col("_real").isNotNull()).groupBy("_range").agg(
        F.max("_real").alias("_top"), F.min("_real").alias("_bottom"))
    every = both.select("_range").distinct().join(edges, "_range", "left")
    order = Window.orderBy("_range")
    every = every.select(
        "_range",
        F.max("_top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
        F.min("_bottom").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("_right"))
    # two running frames in opposite orders; a frame that looks forward would be quadratic
    up = Window.partitionBy("_range").orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("_range").orderBy(F.col("_x").desc()).rangeBetween(Window.unboundedPreceding, 0)
    answers = (
        both.join(every, "_range")
        .withColumn("_low", F.coalesce(F.max("_real").over(up), "_left"))
        .withColumn("_high", F.coalesce(F.min("_real").over(down), "_right"))
        .where(F.col("_real").isNull())
        .withColumn("_best", F.when(F.col("_low").isNull(), F.col("_high"))
                    .when(F.col("_high").isNull() | (F.col("_x") - F.col("_low") <= F.col("_high") - F.col("_x")),
                          F.col("_low")).otherwise(F.col("_high")))
        .select(F.col("_x").alias("_ask"), "_best")
    )
    return (
        synth.join(answers, synth[col].cast("double") == answers["_ask"], "left")
        .withColumn(f"{col}_snapped", F.col("_best")).drop("_ask", "_best")
    )


# the whole transformation -----------------------------------------------------------

@dataclass(frozen=True)
class TransformSpec:
    num: tuple[str, ...] = ()
    cat: tuple[str, ...] = ()
    int_cols: tuple[str, ...] = ()
    y: str | None = None
    key: tuple[str, ...] = ()
    num_nan: str | None = None            # mean | drop-rows
    dequant: str = "none"
    dequant_factor: float = 1.0
    normalization: str | None = None      # standard | minmax | quantile
    cat_nan: str | None = None            # most_frequent
    min_frequency: float | None = None
    cat_encoding: str | None = None       # None = ordinal | one-hot | counter
    target_policy: str | None = None      # default
    regression: bool = True
    seed: int = 0


def normalize(train: DataFrame, df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    if kind == "standard":
        return standard_scale(train, df, cols)
    if kind == "minmax":
        return minmax_scale(train, df, cols, 0.0, 1.0)
    if kind == "quantile":
        return quantile_normalize(train, df, cols)
    raise ValueError(f"unknown normalization {kind}")


def transform_dataset(df: DataFrame, spec: TransformSpec, split: str = "split") -> DataFrame:
    """Numeric gaps, dequantization, normalization, categorical gaps, rare values, encoding and
    target, each fitted on split = train as the step before left it."""

    def train(d: DataFrame) -> DataFrame:
        return d.where(F.col(split) == "train")

    if spec.num and spec.num_nan == "mean":
        df = impute_mean(train(df), df, spec.num)
    elif spec.num and spec.num_nan == "drop-rows":
        df = drop_nan_rows(df, spec.num, split)
    if spec.int_cols:
        df = dequantize(df, spec.int_cols, list(spec.key), spec.dequant, spec.dequant_factor, spec.seed)
    if spec.num and spec.normalization:
        df = normalize(train(df), df, spec.num, spec.normalization)
    if spec.cat:
        if spec.cat_nan == "most_frequent":
            df = impute_most_frequent(train(df), df, spec.cat)
        if spec.min_frequency is not None:
            df = collapse_rare(train(df), df, spec.cat, spec.min_frequency)
        if spec.cat_encoding is None:
            df = ordinal_encode(train(df), df, spec.cat)
        elif spec.cat_encoding == "one-hot":
            df = one_hot_encode(train(df), df, spec.cat)
        elif spec.cat_encoding == "counter":
            for c in spec.cat:
                df = leave_one_out_encode(train(df), df, c, spec.y, F.col(split) == "train")
        else:
            raise ValueError(f"unknown encoding {spec.cat_encoding}")
    if spec.y and spec.target_policy == "default" and spec.regression:
        df = standardize_target(train(df), df, spec.y)
    return df
