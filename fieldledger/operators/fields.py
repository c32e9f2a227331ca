"""Velocity and noise fields fitted on noised copies of the data.

A field answers, per dimension and noise level, which way a noised value should move. Three
kinds: `flow` (straight path from noise to data), `vp` (variance-preserving diffusion, the
field predicts the noise) and `contraction` (data shrinks to the origin). Noise is a hash of
(row key, purpose, seed, copy, dimension), the same at every level.

The fit is one aggregation: every task reduces its noised copies, batch by batch, to one cell
per (level, dimension, bin), so the shuffle does not grow with rows, copies or levels. The fitted
table is bounded by levels x dimensions x bins and is packed into one row for scoring.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import noise as N, scalars as S
from . import prep, trees as TR
from .codec import Codec


def vp_schedule(df: DataFrame, keys, n: str, b0: float = 0.1, b1: float = 8.0) -> DataFrame:
    """Discrete schedule of n steps per key: beta, running product of 1 - beta, and its roots."""
    steps = F.col(n).cast("double")
    grid = df.select(*keys, n, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("i"))
    width = F.when(steps > 1, steps - 1).otherwise(F.lit(1.0))
    beta = F.lit(b0) / steps + F.lit(b1 - b0) / steps * F.col("i") / width
    w = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = grid.withColumn("beta", beta).withColumn("cum", F.exp(F.sum(F.log(F.lit(1.0) - F.col("beta"))).over(w)))
    return out.withColumns({"sqrt_cum": F.sqrt("cum"), "sqrt_1m_cum": F.sqrt(F.lit(1.0) - F.col("cum"))}).drop(n)


@dataclass(frozen=True)
class FieldSpec:
    kind: str = "flow"              # flow | vp | contraction
    learner: str = "binned"         # binned | linear (own value of a dimension), affine | trees (all dimensions, covariates)
    ridge: float = 1e-6             # of the affine learner, as a share of the rows
    n_t: int = 20
    copies: int = 20
    bins: int = 32
    span: float = 4.0               # bins cover [-span, span]; values beyond fall in the end bins
    eps: float = 1e-3
    b0: float = 0.1
    b1: float = 8.0
    seed: int = 666
    trees: TR.TreeSpec = TR.TreeSpec()

    def __post_init__(self):
        if self.kind not in ("flow", "vp", "contraction"):
            raise ValueError(f"unknown kind {self.kind}")
        if self.learner not in ("binned", "linear", "affine", "trees"):
            raise ValueError(f"unknown learner {self.learner}")
        if self.learner == "trees" and not 2 <= self.bins <= 255:
            raise ValueError("trees take 2 to 255 bins")
        if self.kind == "contraction" and self.learner != "binned":
            # the target is -x, which a line fits exactly: every score would be 0
            raise ValueError("a contraction field takes the binned learner")

    @property
    def fit_levels(self) -> list[tuple[int, float]]:
        if self.kind == "contraction":  # the target does not depend on the level
            return [(0, 0.0)]
        return list(enumerate(S.grid_levels(self.n_t, self.eps)))


@dataclass(frozen=True)
class FieldModel:
    """A fitted field. table: one row per label with `grid` = array[level][dimension] of cells (of trees:
    array[level][row of trees.predicted]), `ranges` where the label has its own, and `covs`, the training ranges of the
    covariates, where the field has any, and `codec` where its numbers code typed columns; ranges: one row with the training range of each dimension where all
    labels share it (flow and vp only)."""

    spec: FieldSpec
    table: DataFrame
    ranges: DataFrame | None

    def grid(self) -> Column:
        return self.table.select("grid").scalar()

    def grids_by_label(self) -> Column:
        return self.table.agg(F.array_sort(F.collect_list(F.struct("label", "grid")))).scalar()

    def range_array(self) -> Column:
        return self.ranges.select("ranges").scalar()

    def save(self, path: str) -> None:
        """The table comes last: its marker of success stands for the whole model."""
        if self.ranges is not None:
            self.ranges.write.mode("overwrite").parquet(f"{path}/ranges")
        self.table.write.mode("overwrite").parquet(f"{path}/table")

    @staticmethod
    def load(spark: SparkSession, path: str, spec: FieldSpec) -> "FieldModel":
        table = spark.read.parquet(f"{path}/table")
        shared = spec.kind != "contraction" and "ranges" not in table.columns
        return FieldModel(spec, table, spark.read.parquet(f"{path}/ranges") if shared else None)

    def materialize(self, path: str) -> "FieldModel":
        """Write the model and use the written copy, so that several scores share one fit."""
        self.save(path)
        return FieldModel.load(self.table.sparkSession, path, self.spec)


#: Noised numbers that a task works on at a time; arrays of that size stay in a core's cache.
BLOCK = 32_768


def literal_rows(rows: Sequence[dict], schema: str) -> Column:
    """A constant array of structs; one literal in the plan whatever its length."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")


def bin_of(x: Column, spec: FieldSpec) -> Column:
    pos = F.floor((x + F.lit(spec.span)) * F.lit(spec.bins / (2.0 * spec.span)))
    return F.greatest(F.least(pos, F.lit(spec.bins - 1)), F.lit(0)).cast("int")


def predict(cells: Column, x: Column, spec: FieldSpec) -> Column:
    """Field at x from the cells of one (level, dimension); affine fields and trees need the whole row (Arrays.at)."""
    if spec.learner in ("affine", "trees"):
        raise ValueError("this field is evaluated on whole rows")
    if spec.learner == "linear":
        return cells[0] * x + cells[1]
    return cells[bin_of(x, spec)]


def level_weights(spec: FieldSpec) -> list[dict]:
    """i, a, b of every fitted level: a noised value is a * data + b * noise."""
    rows = []
    for i, t in spec.fit_levels:
        mean, std = S.vp_coefficients(t, spec.b0, spec.b1)
        a, b = {"flow": (t, 1.0 - t), "vp": (mean, std), "contraction": (1.0 - t, 0.0)}[spec.kind]
        rows.append({"i": i, "a": a, "b": b})
    return rows


def noised(
    df: DataFrame, key: str, z: str, spec: FieldSpec, purpose: str = "fit", keep: Sequence[str] = (),
) -> DataFrame:
    """Long form: keep columns, d, copy, t_idx, x_t and the target y of the field.

    Dimensions and copies are exploded before the levels, so the noise of a cell is drawn once
    and shared by its levels."""
    seed = F.col("_seed") if "_seed" in keep else spec.seed
    word = N.words(F.col(key).cast("string"), purpose, seed)
    long = df.withColumn("_w", word).select("_w", *keep, F.posexplode(z).alias("d", "_x1"))
    long = long.where(~F.isnan("_x1"))
    if spec.kind == "contraction":
        steps = long.withColumns({"copy": F.lit(0), "_x0": F.lit(0.0)})
    else:
        steps = long.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(spec.copies - 1)))).withColumn(
            "_x0", N.hash_normal(F.col("_w"), F.col("copy"), F.col("d")))
    steps = steps.withColumn("_l", F.explode(literal_rows(level_weights(spec), "i int, a double, b double")))
    x_t = F.col("_l.a") * F.col("_x1") + F.col("_l.b") * F.col("_x0")
    target = {"flow": F.col("_x1") - F.col("_x0"), "vp": F.col("_x0"), "contraction": -x_t}[spec.kind]
    return steps.select(*keep, "d", "copy", F.col("_l.i").alias("t_idx"), x_t.alias("x_t"), target.alias("y"))


def fit_field(
    df: DataFrame, key: str, features: str, spec: FieldSpec, label: str | None = None,
    scale_by_label: bool = False, seed: Column | None = None, covs: str | None = None,
    codec: Codec | None = None,
) -> FieldModel:
    """Fit one field, or one per value of label. flow and vp scale to [-1, 1] first, over all rows
    or per label; contraction takes features that are standardized already. Missing values are
    skipped per dimension (affine: rows with one are left out). seed: a column that varies the noise, spec.seed by
    default. covs: a column of numbers that the field looks at but does not move (affine and trees), scaled to [-1, 1]
    over all rows. codec: what the features were encoded with; the field then compares, generates and fills in columns."""
    if covs and spec.learner not in ("affine", "trees"):
        raise ValueError("covariates take a learner that looks at whole rows")
    df = df.withColumn("label", F.col(label) if label else F.lit(0))
    if covs:
        beside = df.sparkSession.range(1).select(prep.minmax_vector(df, covs).alias("covs"))
        df = df.withColumn("_cr", beside.select("covs").scalar()).withColumn(
            "_c", prep.scale_to_unit(F.col(covs).cast("array<double>"), F.col("_cr"))).drop("_cr")
    else:
        df = df.withColumn("_c", F.array().cast("array<double>"))
    ranges, by_label = None, None
    if spec.kind == "contraction":
        rows = df.withColumn("_z", F.col(features))
    elif scale_by_label:
        by_label = label_ranges(df, features)
        rows = df.join(by_label, "label").withColumn(
            "_z", prep.scale_to_unit(F.col(features), F.col("ranges"))).drop("ranges")
    else:
        ranges = df.sparkSession.range(1).select(prep.minmax_vector(df, features).alias("ranges"))
        rows = df.withColumn("_r", ranges.select("ranges").scalar()).withColumn(
            "_z", prep.scale_to_unit(F.col(features), F.col("_r"))).drop("_r")
    rows = rows.withColumn("_seed", F.lit(str(spec.seed)) if seed is None else seed.cast("string"))
    by = ["label", "t_idx", "d"]
    if spec.learner == "linear":
        long = noised(rows, key, "_z", spec, keep=["label", "_seed"])
        cells = long.groupBy(*by).agg(F.array(
            F.coalesce(F.regr_slope("y", "x_t"), F.lit(0.0)),
            F.coalesce(F.regr_intercept("y", "x_t"), F.avg("y"))).alias("cells"))
    elif spec.learner == "affine":
        cells = affine_cells(rows, key, "_z", spec)
    elif spec.learner == "trees":
        dims, beside_dims = rows.select(F.size("_z"), F.size("_c")).first() or (0, 0)
        if dims:
            cells = tree_cells(rows, key, "_z", spec, dims, beside_dims)
            table = TR.grow(cells, spec.trees, spec.bins, dims + beside_dims, dims)
        else:  # no rows, no models
            kind = rows.schema["label"].dataType.simpleString()
            table = df.sparkSession.createDataFrame([], f"label {kind}, grid array<array<array<double>>>")
    else:
        cells = binned_cells(cell_sums(rows, key, "_z", spec).groupBy(*by, "bin").agg(F.sum("s").alias("s"), F.sum("n").alias("n")), spec)
    if spec.learner != "trees":
        table = packed_cells(cells)
    if by_label is not None:
        table = table.join(by_label, "label")
    if covs:
        table = table.withColumn("covs", beside.select("covs").scalar())
    if codec:
        table = table.withColumn("codec", F.lit(codec.to_json()))
    return FieldModel(spec, table, ranges)


def binned_cells(sums: DataFrame, spec: FieldSpec) -> DataFrame:
    """label, t_idx, d, cells: the mean target of every bin, of the whole dimension where a bin is empty; from sums (label, t_idx, d,
    bin, s, n)."""
    return (
        sums.groupBy("label", "t_idx", "d").agg(
            F.map_from_entries(F.collect_list(F.struct("bin", F.col("s") / F.col("n")))).alias("m"),
            (F.sum("s") / F.sum("n")).alias("all"))
        .withColumn("cells", F.transform(
            F.sequence(F.lit(0), F.lit(spec.bins - 1)),
            lambda b: F.coalesce(F.try_element_at("m", b), F.col("all"))))
    )


def packed_cells(cells: DataFrame) -> DataFrame:
    """label, grid: the cells (label, t_idx, d, cells) of every label as array[level][dimension]."""
    levels = cells.groupBy("label", "t_idx").agg(F.array_sort(F.collect_list(F.struct("d", "cells"))).alias("a"))
    levels = levels.select("label", "t_idx", F.transform("a", lambda e: e["cells"]).alias("a"))
    table = levels.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("t_idx", "a"))).alias("g"))
    return table.select("label", F.transform("g", lambda e: e["a"]).alias("grid"))


def cell_sums(rows: DataFrame, key: str, z: str, spec: FieldSpec) -> DataFrame:
    """Per task: sum and count of the target in every (label, level, dimension, bin) that occurs.
    The noised copies exist only batch by batch; a task holds and emits at most the cells."""
    levels = level_weights(spec)
    kind = rows.schema["label"].dataType.simpleString()
    copies = 1 if spec.kind == "contraction" else spec.copies

    def add_batch(totals: dict, label, x, a, b) -> None:
        dims = x.shape[1]
        noise = np.zeros((len(x), 1, dims)) if spec.kind == "contraction" else N.normals(a, b, copies, dims)
        data = np.broadcast_to(x[:, None, :], noise.shape)
        known = ~np.isnan(data)
        keep = (lambda v: v.ravel()) if known.all() else (lambda v: v[known])
        data, noise, where = keep(data), keep(noise), keep(np.broadcast_to(np.arange(dims) * spec.bins, noise.shape))
        if label not in totals:
            totals[label] = np.zeros((2, len(levels), dims * spec.bins))
        for at, lv in enumerate(levels):
            v = lv["a"] * data + lv["b"] * noise
            y = {"flow": lambda: data - noise, "vp": lambda: noise, "contraction": lambda: -v}[spec.kind]()
            pos = (v + spec.span) * (spec.bins / (2.0 * spec.span))
            cell = where + np.clip(pos, 0, spec.bins - 1, out=pos).astype(np.int64)
            totals[label][0, at] += np.bincount(cell, y, dims * spec.bins)
            totals[label][1, at] += np.bincount(cell, minlength=dims * spec.bins)

    def run(batches):
        totals: dict = {}
        for pdf in batches:
            for label, part in pdf.groupby("label", sort=False):
                width = len(part[z].iloc[0])
                step = max(1, BLOCK // (copies * width))
                for i in range(0, len(part), step):
                    some = part.iloc[i:i + step]
                    x = np.stack([np.asarray(v, dtype="float64") for v in some[z]])
                    add_batch(totals, label, x, some["a"].to_numpy(), some["b"].to_numpy())
        for label, (s, n) in totals.items():
            t_idx, cell = np.nonzero(n)
            yield pd.DataFrame({
                "label": label, "t_idx": [levels[i]["i"] for i in t_idx], "d": cell // spec.bins,
                "bin": cell % spec.bins, "s": s[t_idx, cell], "n": n[t_idx, cell].astype("int64")})

    word = N.words(F.col(key).cast("string"), "fit", F.col("_seed"))
    packed = rows.withColumn("_w", word).select("label", z, F.col("_w.a").alias("a"), F.col("_w.b").alias("b"))
    return packed.mapInPandas(run, f"label {kind}, t_idx int, d int, bin int, s double, n long")


def affine_cells(rows: DataFrame, key: str, z: str, spec: FieldSpec) -> DataFrame:
    """label, t_idx, d, cells: weights of all noised dimensions, the covariates and a constant, by least squares.

    What a level sees and its target are linear in (data, noise, covariates, constant), so a task adds up the moments of these
    alone, (2 dims + rest) x (2 dims + rest) numbers per label whatever the levels; Spark sums them, and the moments of every
    (label, level) follow from them as one small system. Rows with a missing value are left out."""
    levels = level_weights(spec)
    kind = rows.schema["label"].dataType.simpleString()

    def run(batches):
        totals: dict = {}
        for pdf in batches:
            for label, part in pdf.groupby("label", sort=False):
                dims = len(part[z].iloc[0])
                step = max(1, BLOCK // (spec.copies * dims))
                for i in range(0, len(part), step):
                    some = part.iloc[i:i + step]
                    x, beside = _matrix(some[z]), _matrix(some["_c"])
                    whole = ~np.isnan(x).any(axis=1) & ~np.isnan(beside).any(axis=1)
                    noise = N.normals(some["a"].to_numpy()[whole], some["b"].to_numpy()[whole], spec.copies, dims)
                    fixed = np.hstack([x[whole], beside[whole], np.ones((int(whole.sum()), 1))])
                    cross, flat = fixed.T @ noise.sum(axis=1), noise.reshape(-1, dims)
                    total_ = np.block([[spec.copies * (fixed.T @ fixed), cross], [cross.T, flat.T @ flat]])
                    totals[label] = totals[label] + total_ if label in totals else total_
        for label, sums in totals.items():
            i, j = np.indices(sums.shape)
            dims = len(pdf[z].iloc[0])
            yield pd.DataFrame({"label": label, "dims": dims, "i": i.ravel(), "j": j.ravel(), "v": sums.ravel()})

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        size, dims = int(group["i"].max()) + 1, int(group["dims"].iloc[0])
        moments = np.zeros((size, size))
        moments[group["i"], group["j"]] = group["v"]
        n = size - dims  # inputs and the constant; the noise comes behind them
        out = []
        for lv in levels:
            seen, target = np.zeros((size, n)), np.zeros((size, dims))
            seen[:n] = np.eye(n)
            seen[range(dims), range(dims)] = lv["a"]
            seen[range(n, size), range(dims)] = lv["b"]
            target[range(n, size), range(dims)] = 1.0
            if spec.kind == "flow":
                target *= -1.0
                target[range(dims), range(dims)] = 1.0
            left = seen.T @ moments
            keep = spec.ridge * max(moments[n - 1, n - 1], 1.0) * np.diag(np.append(np.ones(n - 1), 0.0))
            weights = np.linalg.lstsq(left @ seen + keep, left @ target, rcond=None)[0]
            out.append(pd.DataFrame({"label": group["label"].iloc[0], "t_idx": lv["i"], "d": range(dims), "cells": list(weights.T)}))
        return pd.concat(out)

    sums = _packed(rows, key, z).mapInPandas(run, f"label {kind}, dims int, i int, j int, v double")
    sums = sums.groupBy("label", "dims", "i", "j").agg(F.sum("v").alias("v"))
    return sums.groupBy("label").applyInPandas(solve, f"label {kind}, t_idx int, d int, cells array<double>")


def _packed(rows: DataFrame, key: str, z: str) -> DataFrame:
    """label, z, _c, a, b: what the fits over whole rows read, with the noise words of the row."""
    word = N.words(F.col(key).cast("string"), "fit", F.col("_seed"))
    return rows.withColumn("_w", word).select("label", z, "_c", F.col("_w.a").alias("a"), F.col("_w.b").alias("b"))


def tree_cells(rows: DataFrame, key: str, z: str, spec: FieldSpec, dims: int, beside: int) -> DataFrame:
    """label, t_idx, x, s, n: the noised copies counted by the bins of all inputs (x: noised dimensions, then covariates), with
    the sum and the number of each dimension's target. Copies exist only batch by batch; cells are merged in the task and by Spark."""
    levels = level_weights(spec)
    kind = rows.schema["label"].dataType.simpleString()
    names = [*(f"s{d}" for d in range(dims)), *(f"n{d}" for d in range(dims))]

    inputs = dims + beside
    width = spec.bins + 1 if (spec.bins + 1) ** inputs < 2**62 else 256
    places = width ** np.arange(inputs) if inputs <= 8 else None
    kinds = [pa.binary(), *[pa.float64()] * dims, *[pa.int64()] * dims]

    def merged(x: np.ndarray, y: np.ndarray, known: np.ndarray):
        if places is None:  # that many inputs hardly ever fall into one cell twice
            return x, [np.where(known[:, d], y[:, d], 0.0) for d in range(dims)], [known[:, d].astype(np.int64) for d in range(dims)]
        code = x @ places
        if width ** inputs <= 8 * len(x):  # cells are counted in place
            size = width ** inputs
        else:
            found, code = np.unique(code, return_inverse=True)
            size = len(found)
        count = np.bincount(code, minlength=size)
        at = np.flatnonzero(count)
        whole = bool(known.all())
        sums = [np.bincount(code, y[:, d] if whole else np.where(known[:, d], y[:, d], 0.0), size)[at] for d in range(dims)]
        counts = [count[at] if whole else np.bincount(code[known[:, d]], minlength=size)[at] for d in range(dims)]
        cells = at if size == width ** inputs else found
        return (cells[:, None] // places % width).astype(np.uint8), sums, counts

    def table(label, level: int, x: np.ndarray, numbers: list, kind) -> pa.RecordBatch:
        ends = np.arange(0, len(x) * inputs + 1, inputs, dtype=np.int32) if inputs else np.zeros(len(x) + 1, np.int32)
        cells = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])
        return pa.RecordBatch.from_arrays(
            [pa.array([label] * len(x), kind), pa.array(np.full(len(x), level, np.int32)), cells, *(pa.array(v, k) for v, k in zip(numbers, kinds[1:]))],
            names=["label", "t_idx", "x", *names])

    def run(batches):
        for batch in batches:
            kind = batch.schema.field("label").type
            pdf = batch.to_pandas()
            pdf["label"] = pd.Series(batch.column("label").to_pylist(), dtype=object)
            for label, part in pdf.groupby("label", sort=False):
                step = max(1, 2_000_000 // (spec.copies * max(1, dims)))
                for i in range(0, len(part), step):
                    some = part.iloc[i:i + step]
                    data = np.repeat(_matrix(some[z]), spec.copies, axis=0)
                    noise = N.normals(some["a"].to_numpy(), some["b"].to_numpy(), spec.copies, dims).reshape(-1, dims)
                    covs = np.repeat(TR.bins_of(_matrix(some["_c"]) * spec.span, spec.bins, spec.span), spec.copies, axis=0)
                    target, known = (data - noise if spec.kind == "flow" else noise), ~np.isnan(data)
                    for lv in levels:
                        x = np.hstack([TR.bins_of(lv["a"] * data + lv["b"] * noise, spec.bins, spec.span), covs])
                        x, sums, counts = merged(x, target, known)
                        yield table(label, lv["i"], x, sums + counts, kind)

    fields = ", ".join([*(f"s{d} double" for d in range(dims)), *(f"n{d} long" for d in range(dims))])
    long = _packed(rows, key, z).mapInArrow(run, f"label {kind}, t_idx int, x binary{', ' * bool(fields)}{fields}")
    sums = long.groupBy("label", "t_idx", "x").agg(*(F.sum(c).alias(c) for c in names))
    return sums.select("label", "t_idx", "x", F.array(*names[:dims]).cast("array<double>").alias("s"),
                       F.array(*names[dims:]).cast("array<long>").alias("n"))


def label_ranges(df: DataFrame, features: str) -> DataFrame:
    """label, ranges: the value range of every dimension within the label."""
    long = df.select("label", F.posexplode(features).alias("d", "v")).where(~F.isnan("v"))
    stats = long.groupBy("label", "d").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    w = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    packed = stats.groupBy("label").agg(F.array_sort(F.collect_list(
        F.struct("d", F.struct(F.col("lo").alias("lo"), w.alias("w"), F.col("hi").alias("hi")).alias("r")))).alias("a"))
    return packed.select("label", F.transform("a", lambda e: e["r"]).alias("ranges"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("n")))


def euler_rows(spec: FieldSpec, start_idx: int, start_t: float, steps: int) -> list[dict]:
    """The field level used at each step of width 1 / (n_t - 1): half-even rounding of t (n_t - 1)."""
    h = 1.0 / (spec.n_t - 1)
    rows, t = [], start_t
    for _ in range(steps):
        i = 0 if spec.kind == "contraction" else int(round(t * (spec.n_t - 1)))
        rows.append({"i": i, "h": h})
        t += h
    return rows


def score_levels(spec: FieldSpec, which: str) -> list[int]:
    """Noise levels that enter a score."""
    half = spec.n_t // 2
    if which not in ("deviation", "reconstruction", "decision"):
        raise ValueError(f"unknown score {which}")
    if spec.kind == "flow":
        return [spec.n_t - 2] if which == "decision" else list(range(half, spec.n_t - 1))
    if spec.kind == "vp":
        return [1] if which == "decision" else list(range(1, half + 1))
    return list(range(0, half))


def _level_rows(spec: FieldSpec, which: str) -> list[dict]:
    rows = []
    for i in score_levels(spec, which):
        if spec.kind == "contraction":
            t = i / (spec.n_t - 1)
            a, b = 1.0 - t, 0.0
        else:
            t = S.grid_levels(spec.n_t, spec.eps)[i]
            a, b = (t, 1.0 - t) if spec.kind == "flow" else S.vp_coefficients(t, spec.b0, spec.b1)
        steps = [] if spec.kind == "vp" or which != "reconstruction" else euler_rows(spec, i, t, spec.n_t - 1 - i)
        rows.append({"i": i, "a": a, "b": b, "t": t, "steps": steps})
    return rows


@dataclass(frozen=True)
class Arrays:
    """A fitted field as numpy arrays: grid [levels, dimensions, cells]; low, width, high of the
    training range (None for contraction); low, width, high of the covariates (None without); the codec (None without)."""

    grid: object
    ranges: object
    covs: object = None
    codec: Codec | None = None

    def dims(self, spec: FieldSpec) -> int:
        return self.grid.shape[1] - (2 if spec.learner == "trees" else 0)

    def beside(self, c, rows: int):
        """Scaled covariates of the rows [rows, covariates], from their values."""
        if (c is None) != (self.covs is None):
            raise ValueError("a field fitted with covariates is used with covariates, one without is not")
        if c is None:
            return np.zeros((rows, 0))
        low, width, _ = self.covs
        return (_matrix(c) - low) / width * 2.0 - 1.0

    def at(self, level: int, v, spec: FieldSpec, c=None):
        """The field at v [rows, ..., dims], beside scaled covariates c [rows, covariates]."""
        cells = self.grid[level]
        if spec.learner in ("affine", "trees"):
            c = np.zeros((len(v), 0)) if c is None else c
            c = np.broadcast_to(c.reshape(len(v), *[1] * (v.ndim - 2), c.shape[1]), (*v.shape[:-1], c.shape[1]))
        if spec.learner == "affine":
            return np.concatenate([v, c], axis=-1) @ cells[:, :-1].T + cells[:, -1]
        if spec.learner == "trees":
            x = np.concatenate([TR.bins_of(v, spec.bins, spec.span), TR.bins_of(c * spec.span, spec.bins, spec.span)], axis=-1)
            return TR.predicted(cells, x.reshape(-1, x.shape[-1]), spec.trees).reshape(v.shape)
        if spec.learner == "linear":
            return cells[:, 0] * v + cells[:, 1]
        pos = v + spec.span
        pos *= spec.bins / (2.0 * spec.span)
        cell = np.clip(pos, 0, spec.bins - 1, out=pos).astype(np.int64)  # cut off, not rounded
        cell += np.arange(v.shape[-1]) * cells.shape[1]
        return np.take(cells, cell)

    def follow(self, v, steps: list[dict], spec: FieldSpec, c=None):
        for s in steps:
            v = v + s["h"] * self.at(s["i"], v, spec, c)
        return v

    def unit(self, x):
        low, width, _ = self.ranges
        return (x - low) / width * 2.0 - 1.0

    def raw(self, v, int_positions: Sequence[int] = ()):
        """Back to the training range; integer positions are rounded half-even, then all are clamped. With a codec, back
        to the numbers of the columns."""
        low, width, high = self.ranges
        x = (v + 1.0) / 2.0 * width + low
        if self.codec is not None:
            return self.codec.decode(x, low, high)
        if len(int_positions):
            x[..., list(int_positions)] = np.rint(x[..., list(int_positions)])
        return np.clip(x, low, high)


def model_arrays(model: FieldModel) -> dict:
    """label -> Arrays on the driver. The size is labels x levels x dimensions x bins, fixed by the
    spec and not by the rows."""
    shared = None if model.ranges is None else model.ranges.first()["ranges"]
    out = {}
    for r in model.table.collect():
        own = r["ranges"] if "ranges" in model.table.columns else shared
        beside = r["covs"] if "covs" in model.table.columns else None
        ranges, covs = (None if x is None else np.array([[e["lo"], e["w"], e["hi"]] for e in x]).T for x in (own, beside))
        codec = Codec.from_json(r["codec"]) if "codec" in model.table.columns else None
        out[r["label"]] = Arrays(np.array(r["grid"], dtype="float64"), ranges, covs, codec)
    return out


def score(
    df: DataFrame, key: str, features: str, model: FieldModel, which: str,
    copies: int | None = None, seed: int | Column = 0, out: str = "score", label: str | None = None,
    int_positions: Sequence[int] = (), covs: str | None = None,
) -> DataFrame:
    """Adds the anomaly score, with the field of the row's own label where one is given; a label without a
    field has no score. int_positions: dimensions that reconstruction rounds. covs: the column of covariates, for a
    field that was fitted with them.

    A projection: the model is broadcast, Arrow batches of (features, noise words) go through one
    vectorized expression, and nothing is shuffled."""
    spec = model.spec
    levels = _level_rows(spec, which)
    copies = 1 if spec.kind == "contraction" else (copies or spec.copies)
    shared = df.sparkSession.sparkContext.broadcast(model_arrays(model))

    @F.pandas_udf("double")
    def run(x: pd.Series, a: pd.Series, b: pd.Series, case: pd.Series, beside: pd.Series) -> pd.Series:
        result = np.full(len(x), np.nan)
        for c in case.unique():
            at = np.flatnonzero((case == c).to_numpy())
            field = shared.value.get(c)
            if field is None:  # a label without a model has no score
                continue
            step = max(1, (BLOCK if spec.learner != "trees" else 8 * BLOCK) // (copies * field.dims(spec)))
            for i in range(0, len(at), step):
                part = at[i:i + step]
                data = np.stack([np.asarray(v, dtype="float64") for v in x.iloc[part]])
                noise = None
                if spec.kind != "contraction":
                    noise = N.normals(a.iloc[part].to_numpy(), b.iloc[part].to_numpy(), copies, data.shape[1])
                c = field.beside(beside.iloc[part] if covs else None, len(part))
                result[part] = score_rows(data, noise, field, spec, which, levels, int_positions, c)
        return pd.Series(result)

    word = N.words(F.col(key).cast("string"), "score", seed if isinstance(seed, Column) else str(seed))
    case = F.col(label) if label else F.lit(next(iter(shared.value)))
    return (
        df.withColumn("_w", word)
        .withColumn(out, run(F.col(features), F.col("_w.a"), F.col("_w.b"), case, _beside(covs))).drop("_w")
    )


def _beside(covs: str | None) -> Column:
    return (F.col(covs) if covs else F.array()).cast("array<double>")


def score_rows(x, noise, field: Arrays, spec: FieldSpec, which: str, levels: list[dict], int_positions: Sequence[int] = (), c=None):
    """Scores of a batch: x [rows, dims], noise [rows, copies, dims], c: scaled covariates [rows, covariates]."""
    if spec.kind == "contraction":
        if which == "decision":
            return np.sqrt(((field.at(0, x, spec) + x) ** 2).sum(1))
        total_ = np.zeros(len(x))
        for lv in levels:
            v = lv["a"] * x
            end = field.follow(v, lv["steps"], spec) if which == "reconstruction" else v + field.at(0, v, spec)
            total_ += (end ** 2).sum(1)
        return total_

    z = field.unit(x)[:, None, :]
    if spec.learner == "affine" and which != "reconstruction":
        return _affine_scores(z[:, 0], noise, field, spec, levels, c)
    seen = field.raw(z, int_positions)
    total_ = np.zeros(noise.shape[:2])
    for lv in levels:
        v = lv["a"] * z + lv["b"] * noise
        if which != "reconstruction":
            guess = field.at(lv["i"], v, spec, c)
            # both vp scores carry -1 / std
            gap = z - noise - guess if spec.kind == "flow" else (guess - noise) / lv["b"]
        elif spec.kind == "flow":
            gap = seen - field.raw(field.follow(v, lv["steps"], spec, c), int_positions)
        else:  # denoised estimate (x_t + std^2 * score) / mean, with score = -guess / std
            gap = seen - field.raw((v - lv["b"] * field.at(lv["i"], v, spec, c)) / lv["a"], int_positions)
        total_ += (gap ** 2).sum(2)
    return total_.mean(1)


def _affine_scores(z, noise, field: Arrays, spec: FieldSpec, levels: list[dict], c=None):
    """Deviation and decision of an affine field. The gaps of all levels are linear in (data, covariates, constant, noise), so their
    squares add up to the squared length of one triangular map of these, which has the length of all levels together."""
    dims = z.shape[1]
    fixed = np.hstack([z, np.zeros((len(z), 0)) if c is None else c, np.ones((len(z), 1))])
    parts = []
    for lv in levels:
        cells, unit = field.grid[lv["i"]], np.eye(dims)
        on_fixed, on_noise = cells.copy(), lv["b"] * cells[:, :dims]
        on_fixed[:, :dims] *= lv["a"]
        if spec.kind == "flow":
            on_fixed[:, :dims] -= unit
            parts.append(np.hstack([on_fixed, on_noise + unit]))
        else:  # both scores carry -1 / std
            parts.append(np.hstack([on_fixed, on_noise - unit]) / lv["b"])
    r = np.linalg.qr(np.vstack(parts), mode="r")
    gap = (fixed @ r[:, :fixed.shape[1]].T)[:, None, :] + noise @ r[:, fixed.shape[1]:].T
    return (gap ** 2).sum(2).mean(1)


# generation, imputation, classification ------------------------------------------------

def draw_label(df: DataFrame, priors: DataFrame, label: str, key: Column) -> DataFrame:
    """Adds a label per row by inverse CDF of the priors at a hash uniform."""
    cdf = priors.agg(F.array_sort(F.collect_list(F.struct(F.col(label).alias("l"), "prob"))))
    kind = priors.schema[label].dataType

    def pick(u: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast(kind).alias("l"))
        return F.aggregate("_cdf", start, lambda a, e: F.struct(
            (a["cum"] + e["prob"]).alias("cum"),
            F.when(a["l"].isNull() & (u < a["cum"] + e["prob"]), e["l"]).otherwise(a["l"]).alias("l")))["l"]

    drawn = N.let(N.hash_uniform(key), pick)
    return df.withColumn("_cdf", cdf.scalar()).withColumn(
        label, F.coalesce(drawn, F.element_at("_cdf", -1)["l"])).drop("_cdf")


def reverse_schedule(spec: FieldSpec, n_steps: int | None = None, repaint: bool = False,
                     r: int = 5, j: float = 0.1) -> list[dict]:
    """Steps of the reverse SDE from t = 1 to eps: stretches of j * n steps, each gone through r times with
    a jump back to its start in between (back = 1: diffused again in one step), then the steps that are left
    over, once. Without repaint every step is done once."""
    n = n_steps or spec.n_t
    times = np.linspace(1.0, spec.eps, n)
    widths = times - np.append(times[1:], 0.0)
    hop = math.ceil(j * n)
    whole = (n - 1) // hop * hop if repaint else 0
    plan: list[tuple[int, float, int]] = []
    for first in range(0, whole, hop):
        stretch = [(i, widths[i], 0) for i in range(first, first + hop)]
        jump = (first + hop - 1, widths[first:first + hop].sum(), 1)
        plan += stretch + [jump, *stretch] * (r - 1)
    plan += [(i, widths[i], 0) for i in range(whole, n - 1)]
    return [
        {"s": s, "i": int(round(times[i] * (spec.n_t - 1))), "h": float(h), "back": back,
         "beta": float(spec.b0 + times[i] * (spec.b1 - spec.b0)),
         "std": float(S.vp_coefficients(float(times[i]), spec.b0, spec.b1)[1])}
        for s, (i, h, back) in enumerate(plan)]


def reverse_diffuse(x, field: Arrays, spec: FieldSpec, schedule: list[dict], a, b, known=None, start=None, c=None):
    """Euler-Maruyama through the schedule from x [rows, dims], new noise per step, then one denoising move at
    eps. known: rows with their observed cells, nan elsewhere; at every step these follow their own way from
    the noise `start` to the data, so that the cells to be filled move next to them."""
    for s in schedule:
        if known is not None:
            x = np.where(np.isnan(known), x, np.sqrt(max(0.0, 1.0 - s["std"] ** 2)) * known + s["std"] * start)
        drift = -0.5 * s["beta"] * x
        shake = np.sqrt(s["beta"] * s["h"]) * N.normals(a, b, 1, x.shape[1], s["s"])[:, 0]
        if s["back"]:
            x = x + drift * s["h"] + shake
        else:
            x = x - (drift + s["beta"] * field.at(s["i"], x, spec, c) / s["std"]) * s["h"] + shake
    _, std = S.vp_coefficients(spec.eps, spec.b0, spec.b1)
    if known is not None:
        x = np.where(np.isnan(known), x, np.sqrt(1.0 - std**2) * known + std * start)
    return x - std * field.at(int(round(spec.eps * (spec.n_t - 1))), x, spec, c)


def _by_field(model: FieldModel, session: SparkSession, work, kind: str = "array<double>"):
    """A function of columns (label, then others) for `work(field, *columns)` over the rows of one label at a
    time; rows whose label has no field get null. Second result: the only label of a model without labels."""
    shared = session.sparkContext.broadcast(model_arrays(model))

    @F.pandas_udf(kind)
    def run(case: pd.Series, *columns: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(case), dtype="object")
        for c in case.unique():
            field = shared.value.get(c)
            at = np.flatnonzero((case == c).to_numpy())
            if field is None:
                continue
            for i in range(0, len(at), 2_000):
                part = at[i:i + 2_000]
                out.iloc[part] = pd.Series(list(work(field, *(x.iloc[part] for x in columns))), index=out.index[part])
        return out

    return run, F.lit(next(iter(shared.value), None))


def _matrix(x: pd.Series):
    rows = list(x)
    if len(rows) and all(isinstance(v, np.ndarray) and v.dtype == np.float64 for v in rows):
        return np.stack(rows)
    return np.stack([np.asarray([np.nan if e is None else e for e in v], dtype="float64") for v in x])


def generate(keys: DataFrame, key: str, model: FieldModel, seed: int = 0, priors: DataFrame | None = None,
             label: str = "label", int_positions: Sequence[int] = (), out: str = "generated", covs: str | None = None) -> DataFrame:
    """One synthetic row per key. With priors and a label-conditional model, a label is drawn first; of a field with a
    codec the numbers of its columns (Codec.to_columns). covs: the column of covariates
    that a row is generated beside, for a field that was fitted with them."""
    spec = model.spec
    if spec.kind == "contraction":
        raise ValueError("a contraction field does not generate")
    key_text = F.col(key).cast("string")
    steps = euler_rows(spec, 0, 0.0, spec.n_t - 1) if spec.kind == "flow" else reverse_schedule(spec)

    def work(field, a, b, sa, sb, beside):
        x = N.normals(a.to_numpy(), b.to_numpy(), 1, field.dims(spec))[:, 0]
        c = field.beside(beside if covs else None, len(x))
        if spec.kind == "flow":
            x = field.follow(x, steps, spec, c)
        else:
            x = reverse_diffuse(x, field, spec, steps, sa.to_numpy(), sb.to_numpy(), c=c)
        return field.raw(x, int_positions)

    run, only = _by_field(model, keys.sparkSession, work)
    df = keys if priors is None else draw_label(keys, priors, label, N.noise_key(key_text, "label", seed))
    df = df.withColumns({"_w": N.words(key_text, "generate", seed), "_ws": N.words(key_text, "step", seed)})
    case = only if priors is None else F.col(label)
    return df.withColumn(out, run(case, "_w.a", "_w.b", "_ws.a", "_ws.b", _beside(covs))).drop("_w", "_ws")


def impute(df: DataFrame, key: str, features: str, model: FieldModel, k: int = 1, repaint: bool = False,
           r: int = 5, j: float = 0.1, seed: int = 0, int_positions: Sequence[int] = (), label: str | None = None,
           covs: str | None = None) -> DataFrame:
    """k completed copies of each row (column `imputation`), with the field of the row's label where one is given; of a field
    with a codec the numbers of its columns (Codec.to_columns).
    Observed cells are kept; a missing cell follows the reverse SDE, next to the observed cells on theirs. An
    affine or tree field looks at the whole row (and the covariates in covs), so a filled cell depends on the others; binned and
    linear ones do not."""
    spec = model.spec
    if spec.kind != "vp":
        raise ValueError("imputation takes a vp field")
    key_text = F.col(key).cast("string")
    schedule = reverse_schedule(spec, repaint=repaint, r=r, j=j)

    def work(field, x, a, b, sa, sb, beside):
        x = _matrix(x)
        c = field.beside(beside if covs else None, len(x))
        start = N.normals(a.to_numpy(), b.to_numpy(), 1, x.shape[1])[:, 0]
        drawn = reverse_diffuse(start, field, spec, schedule, sa.to_numpy(), sb.to_numpy(), field.unit(x), start, c)
        own = x if field.codec is None else field.codec.decode(x)
        return np.where(np.isnan(own), field.raw(drawn, int_positions), own)

    run, only = _by_field(model, df.sparkSession, work)
    rows = df.withColumn("imputation", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    turn = F.col("imputation").cast("string")
    rows = rows.withColumns({"_w": N.words(key_text, "impute", seed, turn),
                             "_ws": N.words(key_text, "impute-step", seed, turn)})
    filled = run(F.col(label) if label else only, features, "_w.a", "_w.b", "_ws.a", "_ws.b", _beside(covs))
    # rows without a gap come out as they are
    return rows.withColumn(features, filled).drop("_w", "_ws")


def classify(df: DataFrame, key: str, features: str, model: FieldModel, n_t: int = 10, n_z: int = 10,
             seed: int = 0) -> DataFrame:
    """predicted: the label whose field best explains the noise added to the row; distances: mean
    squared error per label; proba: softmax of the negative distances, in label order."""
    spec = model.spec
    looks, t = [], 0.0
    for step in range(n_t - 1):
        t += 1.0 / n_t
        a, b = (t, 1.0 - t) if spec.kind == "flow" else S.vp_coefficients(t, spec.b0, spec.b1)
        for z in range(n_z):
            looks.append((int(round(t * (spec.n_t - 1))), a, b, step * n_z + z))
    fields = model_arrays(model)
    if any(f.covs is not None for f in fields.values()):
        raise ValueError("classification takes fields without covariates")
    names = sorted(fields)
    shared = df.sparkSession.sparkContext.broadcast([fields[n] for n in names])

    @F.pandas_udf("array<double>")
    def distances(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for i in range(0, len(x), 1_000):
            part = slice(i, i + 1_000)
            data = _matrix(x.iloc[part])
            noise = N.normals(a.iloc[part].to_numpy(), b.iloc[part].to_numpy(), len(looks), data.shape[1])
            per_label = []
            for field in shared.value:
                z, total_ = field.unit(data), 0.0
                for level, wa, wb, slot in looks:
                    n = noise[:, slot]
                    guess = field.at(level, wa * z + wb * n, spec)
                    gap = z - guess - n if spec.kind == "flow" else guess - n
                    total_ = total_ + (gap**2).sum(1)
                per_label.append(total_ / len(looks))
            out += list(np.stack(per_label, axis=1))
        return pd.Series(out)

    word = N.words(F.col(key).cast("string"), "classify", seed)
    labels = F.array(*[F.lit(n) for n in names])
    rows = df.withColumn("_w", word).withColumn("_d", distances(F.col(features), "_w.a", "_w.b"))
    rows = rows.withColumn("distances", F.zip_with("_d", labels, lambda d, n: F.struct(d.alias("distance"), n.alias("label"))))
    return rows.withColumns({
        "predicted": F.array_min("distances")["label"],
        "proba": S.softmax(F.transform("distances", lambda e: -e["distance"])),
    }).drop("_d", "_w")
