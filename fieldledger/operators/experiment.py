"""Contamination study: fit on training sets with more and more anomalies, score the test part."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import noise as N
from ..session import cut_lineage, scratch_path
from . import fields, metrics, prep, ranks, splits

SCORES = ("deviation", "reconstruction", "decision")


def study_parts(df: DataFrame, key: str, features: str, label: str, seed=42):
    """Half of the normal and half of the abnormal rows to train, the rest to test, all scaled by
    the normal training rows."""
    halves = splits.random_half_split(df, key, label, seed)
    train = halves.where("split = 'train'")
    scaled = prep.standard_scale_vector(train.where(F.col(label) == 0), halves, features, features)
    parts = cut_lineage(scaled, "study")
    train = parts.where("split = 'train'")
    return train.where(F.col(label) == 0), train.where(F.col(label) == 1), parts.where("split = 'test'")


def first_levels(abnormal: DataFrame, levels: DataFrame, key, seed=42) -> DataFrame:
    """abnormal with `first`: the lowest level whose training set holds the row (the sets are nested). Rows in none are left out."""
    hashed = abnormal.withColumn("_h", splits.row_hash(key, seed))
    cuts = splits.hash_cuts(hashed, "_h", levels.select(F.col("n_ab").alias("rank")))
    steps = levels.join(F.broadcast(cuts), levels["n_ab"] == cuts["rank"]).agg(
        F.array_sort(F.collect_list(F.struct("level_idx", "cut"))).alias("c"))
    inside = F.filter("_c", lambda c: F.col("_h") <= c["cut"])
    return hashed.withColumn("_c", steps.scalar()).withColumn("first", F.array_min(F.transform(inside, lambda c: c["level_idx"]))).where(
        "first is not null").drop("_h", "_c")


def range_versions(normal: DataFrame, abnormal: DataFrame, features: str, n_levels: int) -> list[list[dict]]:
    """For every dimension the value ranges that it goes through from level to level, and from which to which level each holds:
    start, end, lo, w, hi. Ranges grow with the levels and rarely change; the driver gets levels x dimensions numbers."""
    rows = normal.select(features, F.lit(0).alias("first")).unionByName(abnormal.select(features, F.col("first").cast("int").alias("first")))
    long = rows.select("first", F.posexplode(features).alias("d", "v")).where(~F.isnan("v"))
    found = long.groupBy("first", "d").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    by_dim: dict[int, dict[int, tuple]] = {}
    for r in found:
        by_dim.setdefault(r["d"], {})[r["first"]] = (r["lo"], r["hi"])
    out = []
    for d in range(max(by_dim, default=-1) + 1):
        versions, lo, hi = [], float("inf"), float("-inf")
        for level in range(n_levels):
            here = by_dim.get(d, {}).get(level, (lo, hi))
            wider = (min(lo, here[0]), max(hi, here[1]))
            if wider != (lo, hi) or not versions:
                lo, hi = wider
                versions.append({"start": level, "lo": lo, "hi": hi, "w": hi - lo if hi > lo else 1.0})
            versions[-1]["end"] = level
        out.append(versions)
    return out


def nested_fit(normal: DataFrame, abnormal: DataFrame, n_levels: int, key: str, features: str, spec: fields.FieldSpec,
               seeds: Sequence[int]) -> fields.FieldModel:
    """A field per (level, seed) on nested training sets: all of normal, and of abnormal the rows whose `first` level is not above.

    No row is copied. Sums are additive: a row counts once in each range version of a dimension, at the step (level) where it
    comes in, and the sums of a level are those of all steps up to it. A new version exists only where the anomalies of a
    level widen a dimension's range; contraction fields have one for all. Tasks hold dimensions x versions x steps x bins sums
    for one seed after the other; the noised copies of a row are drawn once per seed."""
    if spec.learner != "binned":
        raise ValueError("nested fits add up the cells of the binned learner")
    contraction = spec.kind == "contraction"
    rows = normal.select(key, features, F.lit(0).alias("first")).unionByName(abnormal.select(key, features, F.col("first").cast("int").alias("first")))
    if contraction:
        dims = (rows.select(F.size(features)).first() or [0])[0]
        versions = [[{"start": 0, "end": n_levels - 1, "lo": -1.0, "hi": 1.0, "w": 2.0}] for _ in range(dims)]
    else:
        versions = range_versions(normal, abnormal, features, n_levels)
    flat = [(d, v) for d, vs in enumerate(versions) for v in vs]
    dim = np.array([d for d, _ in flat], np.int64)
    start, end, low, width = (np.array([v[k] for _, v in flat]) for k in ("start", "end", "lo", "w"))
    levels, draws = fields.level_weights(spec), [0] if contraction else list(seeds)
    copies = 1 if contraction else spec.copies
    size = len(flat) * n_levels * spec.bins

    def add(totals, x, first, a, b) -> None:
        step = np.maximum(first[:, None], start)              # [rows, columns]
        value = x[:, dim]
        known = ~np.isnan(value) & (first[:, None] <= end)
        data = value if contraction else (value - low) / width * 2.0 - 1.0
        for s, total in enumerate(totals):
            noise = np.zeros((len(x), 1, x.shape[1])) if contraction else N.normals(a[:, s], b[:, s], copies, x.shape[1])
            keep = np.broadcast_to(known[:, None, :], (len(x), copies, len(flat)))
            where = np.broadcast_to(((np.arange(len(flat)) * n_levels + step) * spec.bins)[:, None, :], keep.shape)[keep]
            z = np.broadcast_to(data[:, None, :], keep.shape)[keep]
            x0 = noise[:, :, dim][keep]
            for at, lv in enumerate(levels):
                v = lv["a"] * z + lv["b"] * x0
                y = -v if contraction else z - x0 if spec.kind == "flow" else x0
                cell = where + np.clip((v + spec.span) * (spec.bins / (2.0 * spec.span)), 0, spec.bins - 1).astype(np.int64)
                total[0, at] += np.bincount(cell, y, size)
                total[1, at] += np.bincount(cell, minlength=size)

    def run(batches):
        totals = None
        for pdf in batches:
            totals = [np.zeros((2, len(levels), size)) for _ in draws] if totals is None else totals
            for i in range(0, len(pdf), step_rows):
                part = pdf.iloc[i:i + step_rows]
                a, b = (np.stack(part[c].to_numpy()) for c in ("a", "b"))
                add(totals, fields._matrix(part["x"]), part["first"].to_numpy(), a, b)
        for seed, (s, n) in zip(draws, totals or []):
            t_idx, cell = np.nonzero(n)
            column, step, at = cell // (n_levels * spec.bins), cell // spec.bins % n_levels, cell % spec.bins
            yield pd.DataFrame({"seed": seed, "t_idx": [levels[i]["i"] for i in t_idx], "d": dim[column], "step": step, "end": end[column].astype(int),
                                "bin": at, "s": s[t_idx, cell], "n": n[t_idx, cell].astype("int64")})

    step_rows = max(1, fields.BLOCK // max(1, copies * len(flat)))
    words = [N.words(F.col(key).cast("string"), "fit", str(s)) for s in draws]
    packed = rows.select(F.col(features).alias("x"), "first", F.array(*words).alias("w")).select(
        "x", "first", F.col("w.a").alias("a"), F.col("w.b").alias("b"))
    sums = packed.mapInPandas(run, "seed long, t_idx int, d int, step int, end int, bin int, s double, n long")
    sums = sums.groupBy("seed", "t_idx", "d", "step", "end", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    each = sums.withColumn("level_idx", F.explode(F.sequence("step", "end")))
    each = each.groupBy("seed", "level_idx", "t_idx", "d", "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    if contraction:  # without noise the seeds have one field
        each = each.drop("seed").withColumn("seed", F.explode(F.array(*(F.lit(int(s)) for s in seeds))))
    cells = fields.binned_cells(each.withColumn("label", _case("level_idx", "seed")), spec)
    table = fields.packed_cells(cells)
    if not contraction:
        def ranges_at(level: int) -> list[dict]:
            return [next({k: float(v[k]) for k in ("lo", "w", "hi")} for v in vs if v["start"] <= level <= v["end"]) for vs in versions]

        known = normal.sparkSession.createDataFrame(
            [(f"{level}/{int(s)}", ranges_at(level)) for level in range(n_levels) for s in seeds],
            "label string, ranges array<struct<lo double, w double, hi double>>")
        table = table.join(known, "label")
    return fields.FieldModel(spec, table, None)


def score_cases(test: DataFrame, key: str, features: str, model: fields.FieldModel, scores: Sequence[str], n_levels: int,
                seeds: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """key, keep, level_idx, seed, score_kind, score of every test row under every field. The features of a row go to the task once
    and come back as one array of scores; only the scores are unfolded."""
    spec = model.spec
    plans = {which: fields._level_rows(spec, which) for which in scores}
    shared = test.sparkSession.sparkContext.broadcast(fields.model_arrays(model))
    copies = 1 if spec.kind == "contraction" else spec.copies

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.full((len(x), n_levels, len(seeds), len(scores)), np.nan)
        for s, seed in enumerate(seeds):
            for level in range(n_levels):
                field = shared.value.get(f"{level}/{int(seed)}")
                if field is None:
                    continue
                step = max(1, (fields.BLOCK if spec.learner != "trees" else 1_000_000) // (copies * field.dims(spec)))
                for i in range(0, len(x), step):
                    part = slice(i, i + step)
                    data, noise = fields._matrix(x.iloc[part]), None
                    if spec.kind != "contraction":
                        noise = N.normals(np.array([w[s] for w in a.iloc[part]]), np.array([w[s] for w in b.iloc[part]]), copies, data.shape[1])
                    for k, which in enumerate(scores):
                        out[part, level, s, k] = fields.score_rows(data, noise, field, spec, which, plans[which])
        return pd.Series(list(out.reshape(len(x), -1)))

    words = F.array(*(N.words(F.col(key).cast("string"), "score", str(int(s))) for s in seeds))
    rows = test.select(key, *keep, features, words.alias("_w"))
    rows = rows.select(key, *keep, F.posexplode(run(features, "_w.a", "_w.b")).alias("_i", "score"))
    names, numbers = F.array(*(F.lit(k) for k in scores)), F.array(*(F.lit(int(s)) for s in seeds))
    many = len(scores)
    return rows.where(F.col("score").isNotNull()).select(
        key, *keep, (F.col("_i") / (many * len(seeds))).cast("int").alias("level_idx"),
        F.element_at(numbers, (F.col("_i") / many).cast("int") % len(seeds) + 1).alias("seed"),
        F.element_at(names, F.col("_i") % many + 1).alias("score_kind"), "score")


def score_grid(
    df: DataFrame, key: str, features: str, label: str, spec: fields.FieldSpec,
    scores: Sequence[str] = SCORES, n_levels: int = 10, seeds: Sequence[int] = (0, 1, 2, 3, 4),
) -> tuple[DataFrame, DataFrame]:
    """(scored test rows per level, seed and score; the levels).

    Binned fields of all levels and seeds are fitted by one pass over the rows (nested_fit); other learners take
    the training sets as labels of one conditional fit. The models are broadcast; their size is levels x seeds
    x the cells of one field."""
    normal, abnormal, test = study_parts(df, key, features, label)
    levels = cut_lineage(splits.contamination_levels(normal, abnormal, n_levels), "levels")
    if spec.learner == "binned":
        nested = cut_lineage(first_levels(abnormal, levels, key), "nested")
        model = nested_fit(normal, nested, n_levels, key, features, spec, seeds)
    else:
        train = splits.contaminate(normal, abnormal, levels.drop("level"), key)
        seed_list = F.array(*[F.lit(int(s)) for s in seeds])
        train = train.withColumn("seed", F.explode(seed_list)).withColumn("case", _case("level_idx", "seed"))
        train = cut_lineage(train.select(key, features, "seed", "case"), "train")
        model = fields.fit_field(train, key, features, spec, label="case", scale_by_label=True, seed=F.col("seed"))
    model = model.materialize(scratch_path(df.sparkSession, "model"))
    return score_cases(test, key, features, model, scores, n_levels, seeds, [label]), levels


def _case(level: str, seed: str):
    """The name of a training set: its level and its seed, whatever numbers they are."""
    return F.concat_ws("/", F.col(level).cast("string"), F.col(seed).cast("string"))


def sweep(df: DataFrame, key: str, features: str, label: str, spec: fields.FieldSpec,
          scores: Sequence[str] = SCORES, n_levels: int = 10, seeds: Sequence[int] = (0, 1, 2, 3, 4)) -> DataFrame:
    """score_kind, level_idx, level, mean and std over seeds of AUROC and average precision."""
    scored, levels = score_grid(df, key, features, label, spec, scores, n_levels, seeds)
    return sweep_metrics(cut_lineage(scored, "scored"), levels, label)


def sweep_metrics(scored: DataFrame, levels: DataFrame, label: str) -> DataFrame:
    """The ranking metrics of written scores of a study."""
    bounds = ranks.value_bounds(scored, "score")
    keys = ["score_kind", "level_idx", "seed"]
    both = metrics.roc_auc(scored, "score", label, keys, bounds).join(
        metrics.average_precision(scored, "score", label, keys, bounds), keys)
    out = metrics.seed_mean_std(both, ["score_kind", "level_idx"], ["auroc", "auprc"])
    return out.join(F.broadcast(levels.select("level_idx", "level")), "level_idx")


def sweep_thresholds(scored: DataFrame, label: str) -> DataFrame:
    """score_kind, case, percentile, n_seeds and over the seeds the means and deviations of F1, precision, recall and accuracy at the
    percentile thresholds of each seed's scores, in the least and the most contaminated case of a study; scored: written scores."""
    keys = ["score_kind", "level_idx", "seed"]
    ends = metrics.extreme_cases(scored, ["score_kind"])
    found = metrics.threshold_metrics(ends.drop("case"), "score", label, keys=keys)
    found = metrics.extreme_cases(found, ["score_kind"])
    return metrics.seed_mean_std(found, ["score_kind", "case", "percentile"], ["f1", "precision", "recall", "accuracy"])


def data_fingerprint(df: DataFrame, key: str) -> str:
    """Order-free fingerprint of the rows that a model was fitted on; one aggregate. A sum of row hashes:
    repeated rows add up and do not cancel."""
    total = F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), total.alias("x")).first()
    return f"{','.join(sorted(df.columns))}-{row['n']}-{row['x']}"


def cache_key(config: dict, data: str, spec: fields.FieldSpec) -> str:
    whole = {"config": config, "data": data, "spec": dataclasses.asdict(spec)}
    return hashlib.md5(json.dumps(whole, sort_keys=True).encode()).hexdigest()


def fit_or_load(df: DataFrame, key: str, spec: fields.FieldSpec, config: dict, folder: str,
                fit: Callable[[DataFrame], fields.FieldModel]) -> fields.FieldModel:
    """The saved model of this configuration, spec and data, or a new one that is saved. What a save that broke
    off has left is written anew."""
    spark = df.sparkSession
    path = f"{folder}/{cache_key(config, data_fingerprint(df, key), spec)}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/table/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        return fields.FieldModel.load(spark, path, spec)
    return fit(df).materialize(path)
