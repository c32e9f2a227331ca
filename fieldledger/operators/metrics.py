"""Metrics of scored rows, and summaries over seeds and levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import ranks

# fixed values: the percentiles at which scores are cut
PERCENTILES = (20, 25, 30, 35, 40, 45, 50, 60, 70, 80, 90, 95, 97.5, 99, 99.5, 99.9, 99.95, 99.99)


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def score_percentiles(
    df: DataFrame, score: str, percentiles: Sequence[float] = PERCENTILES, keys: Sequence[str] = (),
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """keys, percentile, threshold; linear interpolation, exact."""
    found = ranks.order_statistics(df, score, [p / 100.0 for p in percentiles], keys, bounds)
    names = F.create_map(*[F.lit(x) for p in percentiles for x in (float(p / 100.0), float(p))])
    return found.select(*keys, names[F.col("prob")].alias("percentile"), F.col("quantile").alias("threshold"))


def confusion_counts(df: DataFrame, truth: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    def n(t: int, p: int) -> Column:
        return F.count_if((F.col(truth) == t) & (F.col(pred) == p))

    return df.groupBy(*keys).agg(
        n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))


def precision_recall_f1(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = df.withColumn("precision", _ratio(tp, tp + fp)).withColumn("recall", _ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))).withColumn(
        "accuracy", _ratio(tp + tn, tp + fp + fn + tn))


def threshold_metrics(
    df: DataFrame, score: str, label: str, percentiles: Sequence[float] = PERCENTILES,
    keys: Sequence[str] = (), bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Confusion and P/R/F1/accuracy of score > threshold at each percentile.

    Every row is counted once, under the number of thresholds it exceeds; the counts per
    threshold are running sums over that small histogram."""
    keys = list(keys)
    cuts = score_percentiles(df, score, percentiles, keys, bounds)
    lists = cuts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("percentile", "threshold"))).alias("_cuts"))
    if keys:
        rows = df.join(lists, keys)
    else:
        rows = df.withColumn("_cuts", lists.select("_cuts").scalar())
    passed = F.aggregate("_cuts", F.lit(0), lambda a, c: a + (F.col(score) > c["threshold"]).cast("int"))
    histogram = rows.groupBy(*keys, passed.alias("_i")).agg(
        F.count_if(F.col(label) == 1).alias("_p"), F.count_if(F.col(label) == 0).alias("_q"))
    per_key = histogram.groupBy(*keys).agg(
        F.collect_list(F.struct("_i", "_p", "_q")).alias("_h"), F.sum("_p").alias("_pos"), F.sum("_q").alias("_neg"))
    if keys:
        per_key = per_key.join(lists, keys)
    else:
        per_key = per_key.withColumn("_cuts", lists.select("_cuts").scalar())
    exploded = per_key.select(*keys, "_h", "_pos", "_neg", F.posexplode("_cuts").alias("_j", "_c"))

    def above(field: str) -> Column:
        return F.aggregate("_h", F.lit(0).cast("long"),
                           lambda a, e: a + F.when(e["_i"] > F.col("_j"), e[field]).otherwise(0))

    out = exploded.select(
        *keys, F.col("_c.percentile").alias("percentile"), F.col("_c.threshold").alias("threshold"),
        above("_p").alias("tp"), above("_q").alias("fp"), "_pos", "_neg",
    )
    out = out.withColumn("fn", F.col("_pos") - F.col("tp")).withColumn("tn", F.col("_neg") - F.col("fp"))
    return precision_recall_f1(out.drop("_pos", "_neg"))


def best_f1(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first percentile with the largest F1; no row where every F1 is 0."""
    pick = F.max(F.struct("f1", (-F.col("percentile")).alias("p"), "threshold")).alias("_b")
    return df.where(F.col("f1") > 0).groupBy(*keys).agg(pick).select(
        *keys, F.col("_b.f1").alias("best_f1"), F.col("_b.threshold").alias("best_threshold"),
        (-F.col("_b.p")).alias("best_percentile")).where(F.col("best_f1").isNotNull())


def _score_groups(df, score, label, keys, bounds, descending):
    if bounds is None:
        bounds = ranks.value_bounds(df, score)
    groups = df.groupBy(*keys, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    return ranks.cumulative(groups, score, ["pos", "neg"], keys, bounds, descending)


def roc_auc(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
            bounds: Sequence[float] | None = None) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties half; null for one class."""
    g = _score_groups(df, score, label, list(keys), bounds, False)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / F.lit(2.0)))
    return g.groupBy(*keys).agg(
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auroc"))


def average_precision(df: DataFrame, score: str, label: str, keys: Sequence[str] = (),
                      bounds: Sequence[float] | None = None) -> DataFrame:
    """Sum over distinct scores, from the top, of recall step times precision."""
    g = _score_groups(df, score, label, list(keys), bounds, True)
    tp = F.col("pos_before") + F.col("pos")
    seen = tp + F.col("neg_before") + F.col("neg")
    return g.groupBy(*keys).agg(
        F.try_divide(F.sum(F.col("pos") * (tp / seen.cast("double"))), F.sum("pos").cast("double")).alias("auprc"))


def seed_mean_std(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_seeds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs)


def extreme_cases(df: DataFrame, keys: Sequence[str], level: str = "level_idx") -> DataFrame:
    """Rows of the first and the last level of each key, named by case."""
    ends = df.groupBy(*keys).agg(F.min(level).alias("_lo"), F.max(level).alias("_hi"))
    joined = df.join(ends, list(keys)) if keys else df.withColumn(
        "_e", ends.select(F.struct("_lo", "_hi")).scalar()).withColumn("_lo", F.col("_e._lo")).withColumn(
        "_hi", F.col("_e._hi")).drop("_e")
    return (
        joined.withColumn("case", F.when(F.col(level) == F.col("_lo"), "no_contamination")
                          .when(F.col(level) == F.col("_hi"), "full_contamination"))
        .where(F.col("case").isNotNull()).drop("_lo", "_hi")
    )


def best_percentile_by_mean_f1(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, percentile with the largest f1_mean; the first of equals."""
    return df.groupBy(*keys).agg(F.max(F.struct("f1_mean", (-F.col("percentile")).alias("p"))).alias("_b")).select(
        *keys, (-F.col("_b.p")).alias("percentile"), F.col("_b.f1_mean").alias("f1_mean"))


def classification_report(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """class, precision, recall, f1, support; plus accuracy, macro avg and weighted avg rows."""
    cells = df.groupBy(truth, pred).agg(F.count(F.lit(1)).alias("n"))
    per_class = (
        cells.select(F.explode(F.array(
            F.struct(F.col(truth).cast("string").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                     F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit")),
            F.struct(F.col(pred).cast("string").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                     F.lit(0).cast("long").alias("hit")))).alias("e")).select("e.*")
        .groupBy("class").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
        .withColumn("precision", _ratio(F.col("hit"), F.col("predicted")))
        .withColumn("recall", _ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", _ratio(F.lit(2.0) * F.col("hit"), F.col("support") + F.col("predicted")))
    )
    total = F.sum("support")

    def weighted(c: str) -> Column:
        return F.sum(F.col(c) * F.col("support")) / total

    summary = per_class.agg(
        F.array(
            F.struct(F.lit("accuracy").alias("class"), (F.sum("hit") / total).alias("precision"),
                     (F.sum("hit") / total).alias("recall"), (F.sum("hit") / total).alias("f1"), total.alias("support")),
            F.struct(F.lit("macro avg").alias("class"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), total.alias("support")),
            F.struct(F.lit("weighted avg").alias("class"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), total.alias("support")),
        ).alias("rows")).select(F.explode("rows").alias("e")).select("e.*")
    cols = ["class", "precision", "recall", "f1", "support"]
    return per_class.select(*cols).unionByName(summary.select(*cols))


def regression_metrics(df: DataFrame, truth: str, pred: str, std: float | Column | None = None,
                       keys: Sequence[str] = ()) -> DataFrame:
    """rmse (times the target std) and r2."""
    error = F.col(truth) - F.col(pred)
    scale = F.lit(1.0) if std is None else (std if isinstance(std, Column) else F.lit(std))
    n = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        (F.sqrt(F.avg(error * error)) * scale).alias("rmse"),
        (F.lit(1.0) - F.try_divide(F.sum(error * error), F.var_pop(truth) * n)).alias("r2"))


def signed_score(task: str, df: DataFrame) -> Column:
    """Higher is better: -rmse for regression, accuracy otherwise."""
    return -F.col("rmse") if task == "regression" else F.col("accuracy")


def metrics_transpose(df: DataFrame, part: str, metrics: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row per part and a column per metric becomes one row per metric and a column per part."""
    return df.unpivot([part], list(metrics), "metric", "value").groupBy("metric").pivot(part, list(parts)).agg(
        F.first("value"))


def selection_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """r2 where a part has one, else f1, from long rows (keys, metric, value)."""
    wide = df.groupBy(*keys).pivot("metric", ["r2", "f1"]).agg(F.first("value"))
    return wide.select(*keys, F.coalesce("r2", "f1").alias("selection_score"))


def band(df: DataFrame, keys: Sequence[str], x: str, metric: str) -> DataFrame:
    """keys, x, mean and the band one standard deviation to each side."""
    m, s = F.col(f"{metric}_mean"), F.col(f"{metric}_std")
    return df.select(*keys, x, m.alias("mean"), (m - s).alias("low"), (m + s).alias("high"))


def contamination_curve(df: DataFrame, by: str, metric: str = "auroc") -> DataFrame:
    """Curve of a metric over the contamination level, one series per `by` (model or score)."""
    return band(df, [by], "level", metric)


def percentile_curve(df: DataFrame, by: str, case: str, metric: str = "f1") -> DataFrame:
    return band(df.where(F.col("case") == case), [by], "percentile", metric)


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def anomaly_type_counts(df: DataFrame, split: str, kind: str) -> DataFrame:
    """Rows per (split, type) with all totals."""
    return df.cube(split, kind).agg(F.count(F.lit(1)).alias("n"))


def split_summary(df: DataFrame, split: str, label: str) -> DataFrame:
    return df.groupBy(split).agg(
        F.count_if(F.col(label) == 0).alias("normal"), F.count_if(F.col(label) == 1).alias("abnormal"),
        (F.avg(F.col(label).cast("double")) * 100.0).alias("anomaly_rate_pct"))


def top_anomalies(df: DataFrame, score: str, k: int, ties: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(score).desc(), *ties).limit(k)
