"""Tree ensembles as the learner of a field: histogram trees with one vector per leaf.

The rows are cells: the bins of all inputs with the sums and counts of the targets of what fell there. Trees look at
bins only, so a cell holds all that they can know of its rows, and the cells of all (label, level) models are counted
once, and written in blocks of CELLS that tasks read as arrays. All models grow together. A step of the depth is one aggregation: tasks add up, per model and node, the sums by
(input, bin), Spark adds these up, and every (model, tree) takes its best splits. Boosted trees follow each other; the trees
of a forest do not depend on each other and grow TOGETHER at a time. What a cell is predicted by trees that are done is
written beside it every KEEP trees, and looked up in the trees since.

What reaches the driver and goes back to the tasks are the trees, labels x levels x trees x nodes x (targets + 2) numbers,
whatever the rows. A missing input is in a bin of its own, above the others; a missing target counts in no sum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import cut_lineage

#: Names of the reference learners and what grows in their place.
ALIASES = {"xgboost": "gbt", "lgbm": "gbt", "catboost": "gbt", "gbt": "gbt", "random_forest": "random_forest"}
KEEP, TOGETHER = 10, 8
#: Cells of a block, at most.
CELLS = 16_384


@dataclass(frozen=True)
class TreeSpec:
    """subsample: share of the rows a tree sees (a forest draws with replacement); columns: share of the inputs tried at a node."""

    name: str = "gbt"
    n_estimators: int = 100
    max_depth: int = 7
    eta: float = 0.3                # of boosted trees
    ridge: float = 1.0              # added to the counts in leaf values and gains of boosted trees
    least: float = 1.0              # rows on both sides of a split
    subsample: float = 1.0
    columns: float = 1.0
    seed: int = 666

    def __post_init__(self):
        if self.name not in ALIASES:
            raise ValueError(f"unknown learner {self.name}")

    @property
    def forest(self) -> bool:
        return ALIASES[self.name] == "random_forest"

    @property
    def nodes(self) -> int:
        return 2 ** (self.max_depth + 1) - 1

    @property
    def shrink(self) -> float:
        """What a leaf value is multiplied by in the sum over all trees."""
        return 1.0 / self.n_estimators if self.forest else self.eta


def bins_of(x: np.ndarray, bins: int, span: float) -> np.ndarray:
    """Bins of equal width over [-span, span], values beyond in the end bins, missing ones in bin `bins`."""
    with np.errstate(invalid="ignore"):
        at = np.clip(np.floor((x + span) * (bins / (2.0 * span))), 0, bins - 1)
    return np.where(np.isnan(x), bins, at).astype(np.uint8)


def leaves(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, steps: int) -> np.ndarray:
    """The node that each row of bins reaches in one tree after at most `steps` splits."""
    node, every = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(steps):
        f = feature[node]
        inner = f >= 0
        if not inner.any():
            break
        node = np.where(inner, 2 * node + 1 + (x[every, np.maximum(f, 0)] > cut[node]), node)
    return node


def reached(feature: np.ndarray, cut: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """The nodes [rows, trees] that rows of bins reach in trees (feature, cut: [trees, nodes]), as `leaves` finds them one tree at a time.

    A tree has one bit per leaf, from the left. A split that sends a row to the right clears the leaves to its left; of the bits
    that are left the lowest is the row's leaf, so a row takes one table entry per input instead of one per level."""
    many, size = len(feature), 2**depth
    if depth > 6:
        return np.stack([leaves(f, c, x, depth) for f, c in zip(feature, cut)], axis=1)
    kind = next(k for k, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32), (np.uint64, 64)) if bits >= size)
    kept = np.full((x.shape[1], 256, many), (1 << size) - 1, kind)
    ends = np.zeros((many, size), np.int64)
    for t in range(many):
        open_nodes = [(0, 0, size)]
        while open_nodes:
            node, low, high = open_nodes.pop()
            if high - low == 1 or feature[t, node] < 0:
                ends[t, low:high] = node
                continue
            middle = (low + high) // 2
            kept[feature[t, node], cut[t, node] + 1:, t] &= kind(~(((1 << (middle - low)) - 1) << low) & ((1 << size) - 1))
            open_nodes += [(2 * node + 1, low, middle), (2 * node + 2, middle, high)]
    left = kept[0].take(x[:, 0], axis=0)
    for d in range(1, x.shape[1]):
        left &= kept[d].take(x[:, d], axis=0)
    lowest = (left & (~left + kind(1))).astype(np.float64).view(np.int64)  # a power of two: its exponent is the place
    place = (lowest >> 52) - 1023
    place += np.arange(many) * size
    return ends.ravel().take(place)


def summed(feature: np.ndarray, cut: np.ndarray, value: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Sum over trees of the values [trees, nodes, targets] of the nodes that rows of bins reach."""
    out = np.zeros((len(x), value.shape[-1]))
    for i in range(0, len(x), 16_384):
        part = x[i:i + 16_384]
        node = reached(feature, cut, part, depth)
        for t in range(len(feature)):
            out[i:i + 16_384] += value[t].take(node[:, t], axis=0)
    return out


def predicted(model: np.ndarray, x: np.ndarray, trees: TreeSpec) -> np.ndarray:
    """Sum over the trees of one model, [feature, cut, value of each target] x (trees * nodes), at rows of bins."""
    shape = (trees.n_estimators, trees.nodes)
    feature, cut = model[0].astype(np.int64).reshape(shape), model[1].astype(np.int64).reshape(shape)
    value = np.ascontiguousarray(model[2:].T).reshape(*shape, -1)
    return summed(feature, cut, value, x, trees.max_depth)


class _Model:
    """The trees of one (label, level) as far as they have grown."""

    def __init__(self, trees: TreeSpec, targets: int):
        self.feature = np.full((trees.n_estimators, trees.nodes), -1, np.int16)
        self.cut = np.zeros((trees.n_estimators, trees.nodes), np.int16)
        self.value = np.zeros((trees.n_estimators, trees.nodes, targets))

    def flat(self) -> np.ndarray:
        return np.vstack([self.feature.ravel(), self.cut.ravel(), self.value.reshape(-1, self.value.shape[-1]).T])

    def some(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.feature[first:last], self.cut[first:last], self.value[first:last]


def _bytes_matrix(column: pa.Array, width: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, width)


def _packed(cells: DataFrame, inputs: int, targets: int) -> DataFrame:
    """Blocks of neighbouring cells of one model, their bins, sums, counts and predicted values as the bytes of arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").dictionary_encode()
            code, level = label.indices.fill_null(-1).to_numpy(), batch.column("t_idx").to_numpy()
            edge = np.flatnonzero((code[1:] != code[:-1]) | (level[1:] != level[:-1])) + 1
            x = _bytes_matrix(batch.column("x"), inputs)
            s, n = (batch.column(c).flatten().to_numpy().reshape(-1, targets) for c in ("s", "n"))
            cuts = sorted({0, batch.num_rows, *edge.tolist(), *range(0, batch.num_rows, CELLS)})
            parts = [(a, x[a:b].tobytes(), s[a:b].tobytes(), n[a:b].astype(np.int64).tobytes(), np.zeros((b - a, targets)).tobytes())
                     for a, b in zip(cuts, cuts[1:])]
            first = pa.array([p[0] for p in parts])
            yield pa.RecordBatch.from_arrays(
                [batch.column("label").take(first), batch.column("t_idx").take(first), *(pa.array([p[i] for p in parts], pa.binary()) for i in range(1, 5))],
                names=["label", "t_idx", "x", "s", "n", "f"])

    name = cells.schema["label"].dataType.simpleString()
    return cells.select("label", "t_idx", "x", "s", "n").mapInArrow(run, f"label {name}, t_idx int, x binary, s binary, n binary, f binary")


def _blocks(batch: pa.RecordBatch, inputs: int, targets: int) -> Iterator[tuple]:
    """(label, level, bins, sums, counts, predicted) of every block."""
    for label, level, x, s, n, f in zip(batch.column("label").to_pylist(), batch.column("t_idx").to_pylist(),
                                        *(batch.column(c) for c in ("x", "s", "n", "f"))):
        s, n, f = (np.frombuffer(v.as_buffer(), k).reshape(-1, targets) for v, k in ((s, np.float64), (n, np.int64), (f, np.float64)))
        yield label, level, np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, inputs), s, n, f


def _weights(x: np.ndarray, n: np.ndarray, tree: int, trees: TreeSpec) -> np.ndarray:
    """How much of a cell a tree sees: around `subsample`, with the spread that a draw of its rows has."""
    mix = np.random.Generator(np.random.Philox(key=[trees.seed % 2**32, tree])).integers(1, 2**63, x.shape[1], np.uint64) | np.uint64(1)
    h = (x.astype(np.uint64) * mix).sum(axis=1)
    u = []
    for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        v = (h ^ np.uint64(k)) * np.uint64(0xBF58476D1CE4E5B9)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        u.append(((v ^ (v >> np.uint64(32))) >> np.uint64(11)).astype(float) * 2.0**-53)
    rate = trees.subsample
    spread = rate if trees.forest else rate * (1.0 - rate)
    draw = np.sqrt(-2.0 * np.log1p(-u[0])) * np.cos(2.0 * np.pi * u[1])
    return np.maximum(0.0, rate + draw * np.sqrt(spread / np.maximum(n, 1)))


def _histograms(cells: DataFrame, trees: TreeSpec, bins: int, inputs: int, targets: int, models: dict, done: int, first: int,
                last: int, depth: int) -> DataFrame:
    """label, t_idx, tree, node, h: sums and counts by (input, bin) in every node at this depth of trees first .. last - 1."""
    state = cells.sparkSession.sparkContext.broadcast(
        {k: (m.some(done, first) if not trees.forest else None, m.some(first, last)) for k, m in models.items()})
    width, base, size = bins + 1, 2**depth - 1, 2**depth
    drawn = trees.subsample < 1 or trees.forest

    def add(sums: dict, key: tuple, x, s, n, f) -> None:
        before, growing = state.value.get(key, (None, None))
        guess = f
        if before is not None:
            guess = f + summed(before[0], before[1], before[2] * trees.eta, x, trees.max_depth)
        rest = s - n * guess
        alike = bool((n == n[:, :1]).all())
        nodes = reached(growing[0], growing[1], x, depth) - base if growing is not None else None
        for tree in range(first, last):
            node = nodes[:, tree - first] if nodes is not None else np.zeros(len(x), np.int64)
            here = node >= 0
            if not here.any():
                continue
            at = ((node[here, None] * inputs + np.arange(inputs)) * width + x[here]).ravel()
            w = _weights(x, n[:, 0], tree, trees)[here, None] if drawn else 1.0
            g, c = rest[here] * w, n[here] * w
            h = sums.setdefault(tree, np.zeros((2, targets, size * inputs * width)))
            for t in range(targets):
                h[0, t] += np.bincount(at, np.repeat(g[:, t], inputs), h.shape[2])
                if t == 0 or not alike:
                    counts = np.bincount(at, np.repeat(c[:, t], inputs), h.shape[2])
                h[1, t] += counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sums = None, {}

        def flush():
            rows = [(tree, node, h.reshape(2, targets, size, -1)[:, :, node]) for tree, h in sums.items() for node in range(size)]
            rows = [(tree, node, h.tobytes()) for tree, node, h in rows if h[1].any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * len(rows), kind), pa.array([key[1]] * len(rows), pa.int32()),
                 pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
                names=["label", "t_idx", "tree", "node", "h"])

        for batch in batches:
            kind = batch.schema.field("label").type
            for label, level, x, s, n, f in _blocks(batch, inputs, targets):
                if key is not None and key != (label, level):
                    yield flush()
                    sums = {}
                key = (label, level)
                add(sums, key, x, s, n, f)
        if sums:
            yield flush()

    name = cells.schema["label"].dataType.simpleString()
    return cells.mapInArrow(run, f"label {name}, t_idx int, tree int, node int, h binary")


def best_split(h: np.ndarray, trees: TreeSpec, tried: np.ndarray | None = None) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """(input or -1, cut, value, value left, value right) from h [2 (sum, count), targets, inputs, bins]; rows up to the cut go left.
    Of equal gains the first input and the lowest cut."""
    ridge = 0.0 if trees.forest else trees.ridge

    def value(g, n):
        return np.divide(g, n + ridge, out=np.zeros_like(g), where=n + ridge > 0)

    g, n = h
    all_g, all_n = g[:, 0].sum(axis=-1), n[:, 0].sum(axis=-1)
    left_g, left_n = np.cumsum(g, axis=2)[:, :, :-1], np.cumsum(n, axis=2)[:, :, :-1]
    right_g, right_n = all_g[:, None, None] - left_g, all_n[:, None, None] - left_n
    gain = (value(left_g, left_n) * left_g + value(right_g, right_n) * right_g).sum(axis=0) - (value(all_g, all_n) * all_g).sum()
    allowed = (left_n.max(axis=0) >= trees.least) & (right_n.max(axis=0) >= trees.least)
    if tried is not None:
        allowed &= tried[:, None]
    gain = np.where(allowed, gain, -np.inf)
    at = np.unravel_index(int(np.argmax(gain)), gain.shape)
    whole = value(all_g, all_n)
    if not gain[at] > 1e-9 * max(1.0, float(all_n.max())):
        return -1, 0, whole, whole, whole
    feature, cut = int(at[0]), int(at[1])
    return feature, cut, whole, *(value(x[:, feature, cut], y[:, feature, cut]) for x, y in ((left_g, left_n), (right_g, right_n)))


def _splits(histograms: DataFrame, trees: TreeSpec, bins: int, inputs: int, targets: int, depth: int) -> pa.Table:
    many = max(1, math.ceil(trees.columns * inputs))

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for node, some in rows.groupby("node", sort=True):
            h = np.sum([np.frombuffer(v) for v in some["h"]], axis=0).reshape(2, targets, inputs, bins + 1)
            tried = None
            if many < inputs:
                draw = np.random.Generator(np.random.Philox(key=[trees.seed % 2**32, (key[1] << 40) + (key[2] << 20) + (1 << depth) + node]))
                tried = np.isin(np.arange(inputs), draw.permutation(inputs)[:many])
            out.append((key[0], key[1], key[2], node, *best_split(h, trees, tried)))
        return pd.DataFrame(out, columns=["label", "t_idx", "tree", "node", "feature", "cut", "value", "low", "high"])

    name = histograms.schema["label"].dataType.simpleString()
    return histograms.groupBy("label", "t_idx", "tree").applyInPandas(
        choose, f"label {name}, t_idx int, tree int, node int, feature int, cut int, value array<double>, low array<double>,"
                " high array<double>").toArrow()


def _with_predicted(cells: DataFrame, trees: TreeSpec, inputs: int, targets: int, models: dict, first: int, last: int) -> DataFrame:
    state = cells.sparkSession.sparkContext.broadcast({k: m.some(first, last) for k, m in models.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for label, level, x, _, _, before in _blocks(batch, inputs, targets):
                feature, cut, value = state.value[label, level]
                made.append((before + summed(feature, cut, value * trees.eta, x, trees.max_depth)).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("label", "t_idx", "x", "s", "n")), pa.array(made, pa.binary())],
                                             names=["label", "t_idx", "x", "s", "n", "f"])

    return cells.mapInArrow(run, cells.schema)


def grow(cells: DataFrame, trees: TreeSpec, bins: int, inputs: int, targets: int) -> DataFrame:
    """(label, grid) from cells (label, t_idx, x: the bins as bytes, s, n: sums and counts of each target): grid holds for every level
    the rows [feature, cut, value of each target] of all its trees' nodes, as `predicted` takes them."""
    spark = cells.sparkSession
    schema = cells.schema["label"].dataType
    cells = cells.repartition(spark.sparkContext.defaultParallelism, "label", "t_idx", "x").sortWithinPartitions("label", "t_idx")
    cells = cut_lineage(_packed(cells, inputs, targets), "cells")
    models: dict[tuple, _Model] = {}
    done, first = 0, 0
    while first < trees.n_estimators:
        last = min(first + (TOGETHER if trees.forest else 1), trees.n_estimators)
        for depth in range(trees.max_depth):
            found = _splits(_histograms(cells, trees, bins, inputs, targets, models, done, first, last, depth), trees, bins, inputs, targets, depth)
            base, split = 2**depth - 1, False
            for r in found.to_pylist():
                model = models.setdefault((r["label"], r["t_idx"]), _Model(trees, targets))
                node, tree = base + r["node"], r["tree"]
                if depth == 0:
                    model.value[tree, 0] = r["value"]
                if r["feature"] >= 0:
                    split = True
                    model.feature[tree, node], model.cut[tree, node] = r["feature"], r["cut"]
                    model.value[tree, 2 * node + 1], model.value[tree, 2 * node + 2] = r["low"], r["high"]
            if not split:
                break
        first = last
        if not trees.forest and first - done >= KEEP and first < trees.n_estimators:
            cells = cut_lineage(_with_predicted(cells, trees, inputs, targets, models, done, first), "cells")
            done = first
    by_label: dict = {}
    for (label, _), m in sorted(models.items(), key=lambda e: e[0][1]):
        m.value *= trees.shrink
        by_label.setdefault(label, []).append(m.flat())
    return spark.createDataFrame([(label, [[row.tolist() for row in level] for level in grid]) for label, grid in by_label.items()],
                                 f"label {schema.simpleString()}, grid array<array<array<double>>>")
