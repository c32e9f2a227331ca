"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class. Splits part members of a dense group almost independently of their cosine, so
dense groups are compared first, in full: their centres are found on a sample of at most SAMPLE classes. A
class within the angle of `least` of a centre is at home there, and a link of it can only lead to a class
within twice that angle, so the home classes are compared with all of those, in tiles. A tile passes on sums
and one link to a root for each member, never pairs. Every link with an end at home somewhere is found.

The other classes go to the trees. Each tree splits them by random directions at the median, again and
again, until a leaf holds about LEAF of them; a vector whose projection lies within SPILL of the median
(as a share of the node) goes to both sides. Vectors that share a leaf of any tree are compared by cosine
in double precision, and the links of all trees are put together. There are TREES trees, and more until
pairs of the sample, and pairs made up at a cosine of `least`, meet in a leaf but for a share of MISS.

The upper splits are fitted on a sample too, which the driver holds; every class is routed. Leaves that are
still larger than LARGEST are split further in rounds over all their rows, by quantiles that Spark computes,
unless a sample of the leaf shows a dense group; such a leaf, or one that cannot be split, is compared in tiles.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of
different lengths are never compared. Repeated rows are copies of each other. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import with_fields, written
from .components import connected_components

TREES = 8
LEAF = 256
LARGEST = 1024
SPILL = 0.05
SAMPLE = 20_000
#: A node of the sample with fewer classes is not split on the driver.
FEWEST = 40
ROUNDS = 30
#: So many near classes of the sample are a dense group; in a sample of a leaf, one part in DENSE_SHARE.
DENSE, DENSE_SHARE, LEAF_SAMPLE = 16, 8, 256
#: Rows of a dense group that are compared at once, about.
TILE = 2048
#: Share of the pairs of cosine `least` that no tree brings together, at most; pairs tried; trees, at most.
MISS, PROBES, MOST_TREES = 0.01, 1000, 64


def direction(tree: int, node: int, size: int) -> np.ndarray:
    draw = np.random.Generator(np.random.Philox(key=[tree + 1, node % (1 << 64)]))
    return draw.standard_normal(size)


def classes(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, class (hash of the vector, null if it cannot link), vec (unit vector, doubles as binary)."""
    rows = rows.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, units = [], []
            for x in batch.column("v"):
                v = np.array(x.as_py() or [], float)  # a null component becomes nan
                top = np.abs(v).max() if len(v) else 0.0
                if not len(v) or not np.isfinite(v).all() or not top:
                    names.append(None)
                    units.append(None)
                    continue
                v = v + 0.0  # -0.0 equals 0.0
                names.append(xxhash.xxh3_64_intdigest(v.tobytes()) - (1 << 63))
                scaled = v / top  # keeps the squares in range
                units.append((scaled / np.sqrt(scaled @ scaled)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(names, pa.int64()), pa.array(units, pa.binary())],
                names=["vec_id", "class", "vec"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, class long, vec binary")


def matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units)).reshape(len(units), -1)


def fit_tree(points: np.ndarray, tree: int, depth: int) -> dict[int, tuple[float, float]]:
    """node -> (low, high): projections up to high go left (2 node + 1), from low on right (2 node + 2)."""
    bounds, todo = {}, [(0, np.arange(len(points)), 0)]
    while todo:
        node, rows, level = todo.pop()
        if level >= depth or len(rows) < FEWEST:
            continue
        p = points[rows] @ direction(tree, node, points.shape[1])
        low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
        bounds[node] = (float(low), float(high))
        middle = np.median(p)
        todo += [(2 * node + 1, rows[p <= middle], level + 1), (2 * node + 2, rows[p > middle], level + 1)]
    return bounds


def route(points: np.ndarray, tree: int, bounds: dict[int, tuple[float, float]]) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows in it)."""
    todo = [(0, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node not in bounds:
            yield node, rows
            continue
        low, high = bounds[node]
        p = points[rows] @ direction(tree, node, points.shape[1])
        todo += [(2 * node + 1, rows[p <= high]), (2 * node + 2, rows[p >= low])]


def sampled(distinct: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Size in bytes -> unit vectors of at most about SAMPLE classes."""
    draw = F.pmod(F.xxhash64("class", F.lit(29)), F.lit(1 << 30))
    share = min(1 << 30, (SAMPLE << 30) // max(1, total))
    drawn = sorted((r[0], r[1]) for r in distinct.where(draw < share).select("class", "vec").limit(2 * SAMPLE).collect())
    by_size: dict[int, list] = {}
    for _, unit in drawn:
        by_size.setdefault(len(unit), []).append(unit)
    return {size: matrix(units) for size, units in by_size.items()}


def near_counts(points: np.ndarray, least: float) -> np.ndarray:
    """How many of the points, itself included, have a cosine >= least to each."""
    return np.concatenate([np.zeros(0, np.int64), *((points[k:k + 512] @ points.T >= least).sum(axis=1)
                                                    for k in range(0, len(points), 512))])


def centres(points: np.ndarray, least: float) -> np.ndarray:
    """Unit vectors in the middle of the dense groups: each has DENSE points or more of its own within `least`."""
    found, free = [], np.ones(len(points), bool)
    counts = near_counts(points, least)
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] < DENSE:
            break
        if not free[k]:
            continue
        near = free & (points @ points[k] >= least)
        if near.sum() < DENSE:
            continue
        middle, taken = points[k], near
        mean = points[near].sum(axis=0)
        if np.linalg.norm(mean) > 1e-6:
            mean /= np.linalg.norm(mean)
            around = free & (points @ mean >= least)
            if around.sum() > near.sum():
                middle, taken = mean, around
        found.append(middle)
        free &= ~taken
    return np.array(found).reshape(len(found), points.shape[1])


def grouped(distinct: DataFrame, found: dict[int, np.ndarray], least: float) -> DataFrame:
    """size, class, copies, vec, home, centre: a class under every centre that a link from a class at home there can
    reach. home is the nearest centre if it is within `least`; a class without a home is there under centre -1 too."""
    wide = 2 * least * least - 1 - 1e-9 if least > 0 else -2.0
    shared = distinct.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                units = batch.column("vec").to_pylist()
                sizes = np.array([len(u) for u in units])
                for size in np.unique(sizes):
                    own = np.flatnonzero(sizes == size)
                    middles = shared.value.get(int(size))
                    home, row, centre = np.full(len(own), -1), np.zeros(0, np.int64), np.zeros(0, np.int64)
                    if middles is not None and len(middles):
                        near = matrix([units[i] for i in own]) @ middles.T
                        home = np.where(near.max(axis=1) >= least, near.argmax(axis=1), -1)
                        row, centre = np.nonzero(near >= wide)
                    homeless = np.flatnonzero(home < 0)
                    row, centre = np.append(row, homeless), np.append(centre, np.full(len(homeless), -1))
                    rows = pa.array(own[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row), size), pa.int32()), batch.column("class").take(rows),
                         batch.column("copies").take(rows), batch.column("vec").take(rows),
                         pa.array(home[row], pa.int32()), pa.array(centre, pa.int32())],
                        names=["size", "class", "copies", "vec", "home", "centre"])

    return distinct.select("class", "copies", "vec").mapInArrow(
        run, "size int, class long, copies long, vec binary, home int, centre int")


def _trees_of(linked: np.ndarray) -> np.ndarray:
    """The first row of each row's component of a symmetric boolean matrix."""
    root = np.arange(len(linked))
    free = linked.any(axis=1)
    for k in range(len(linked)):
        if free[k]:
            front = np.array([k])
            free[k] = False
            while len(front):
                root[front] = k
                front = np.flatnonzero(linked[front].any(axis=0) & free)
                free[front] = False
    return root


def group_links(groups: DataFrame, least: float, tile: int) -> DataFrame:
    """class, linked (copies of the classes linked), root (a class in its component), from all pairs in a group with
    an end at home there; a pair with two homes counts under the first of them."""
    keys = ["size", "centre"]
    blocks = groups.groupBy(*keys).agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"))
    rows = groups.join(F.broadcast(blocks), keys).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "copies",
                       "home", "vec")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        points, names, copies = matrix(list(group["vec"])), group["class"].to_numpy(), group["copies"].to_numpy()
        centre, home = int(group["centre"].iloc[0]), group["home"].to_numpy()
        home = np.where(home < 0, np.iinfo(np.int32).max, home)
        left = np.flatnonzero(group["own"] == group["i"])
        right = np.flatnonzero(group["own"] == group["j"])
        linked = np.zeros((len(group), len(group)), bool)
        for k in range(0, len(left), 512):
            part = left[k:k + 512]
            linked[np.ix_(part, right)] = (points[part] @ points[right].T >= least) & (
                np.minimum.outer(home[part], home[right]) == centre)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        many = np.concatenate([np.zeros(0, np.int64), *(linked[k:k + 512] @ copies for k in range(0, len(linked), 512))])
        some = many > 0
        return pd.DataFrame({"class": names, "linked": many, "root": names[_trees_of(linked)]})[some]

    return rows.groupBy(*keys, "i", "j").applyInPandas(compare, "class long, linked long, root long")


def probes(points: np.ndarray, least: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs to measure the trees by: made up at a cosine of `least`, and linked ones of the sample if there are enough."""
    draw = np.random.Generator(np.random.Philox(key=[0, 7]))
    out = []
    if 0 < least < 1 and points.shape[1] > 1 and len(points):
        x = points[draw.choice(len(points), min(PROBES, len(points)), replace=False)]
        side = draw.standard_normal(x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        out.append((x, least * x + np.sqrt(1 - least * least) * side))
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    for k in range(0, len(points), 512):
        x, y = np.nonzero(points[k:k + 512] @ points[k:].T >= least)
        apart = np.flatnonzero(y > x)[:2 * PROBES]
        a.append(k + x[apart])
        b.append(k + y[apart])
    a, b = np.concatenate(a), np.concatenate(b)
    if len(a) >= 100:
        some = draw.choice(len(a), min(PROBES, len(a)), replace=False)
        out.append((points[a[some]], points[b[some]]))
    return out


def fit_forest(points: np.ndarray, trees: int, depth: int, least: float, total: int, largest: int) -> list[dict]:
    """At least `trees` trees, more until the probes meet but for MISS, the rounds still to come included."""
    pairs = probes(points, least)
    missed = [np.ones(len(x)) for x, _ in pairs]
    u, v = np.random.Generator(np.random.Philox(key=[0, 8])).standard_normal((2, 100_000))
    v = least * u + np.sqrt(max(0.0, 1 - least * least)) * v
    low, high = np.quantile(u, [0.5 - SPILL, 0.5 + SPILL])
    stays = 1 - ((u < low) & (v > high)).mean() - ((v < low) & (u > high)).mean()  # both in one side of a split
    forest: list[dict] = []
    while len(forest) < trees or (len(forest) < MOST_TREES and any(m.mean() > MISS for m in missed)):
        tree = len(forest)
        forest.append(fit_tree(points, tree, depth))
        size = np.mean([len(r) for _, r in route(points, tree, forest[-1])]) * total / max(1, len(points))
        rounds = max(0, int(np.ceil(np.log(max(size, 1) / largest) / -np.log(0.5 + SPILL))))
        for (x, y), m in zip(pairs, missed):
            met = np.zeros(len(x), bool)
            for _, rows in route(np.vstack([x, y]), tree, forest[-1]):
                inside = np.zeros(2 * len(x), bool)
                inside[rows] = True
                met |= inside[:len(x)] & inside[len(x):]
            m *= 1 - met * stays**rounds
    return forest


def plant(distinct: DataFrame, trees: int, leaf: int, least: float = 0.9, largest: int = LARGEST) -> DataFrame:
    """tree, leaf, size (the vector's length), class, vec: every class in one or more leaves of every tree."""
    total = distinct.count()
    depth = int(np.ceil(np.log2(max(1, total / leaf))))
    by_size = sampled(distinct, total)
    drawn = sum(map(len, by_size.values()))
    forest = {size: fit_forest(points, trees, depth, least, total * len(points) // drawn, largest)
              for size, points in by_size.items()}
    shared = distinct.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("vec").to_pylist()
            sizes = np.array([len(u) for u in units])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                points = matrix([units[i] for i in own])
                for tree, bounds in enumerate(shared.value.get(int(size), [{}])):
                    found = list(route(points, tree, bounds))
                    rows = pa.array(own[np.concatenate([r for _, r in found])])
                    leaves = np.repeat([n for n, _ in found], [len(r) for _, r in found])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(leaves), tree), pa.int32()), pa.array(leaves, pa.int64()),
                         pa.array(np.full(len(leaves), size), pa.int32()),
                         batch.column("class").take(rows), batch.column("vec").take(rows)],
                        names=["tree", "leaf", "size", "class", "vec"])

    return distinct.select("class", "vec").mapInArrow(run, "tree int, leaf long, size int, class long, vec binary")


def dense_leaves(mine: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """tree, leaf, size of the leaves of `mine` whose sample holds a dense group. sizes: their rows (count)."""
    keys = ["tree", "leaf", "size"]
    draw = F.pmod(F.xxhash64("class", F.lit(31)), F.lit(1 << 30))
    some = mine.join(sizes, keys).where(draw * F.col("count") < (LEAF_SAMPLE << 30)).select(*keys, "vec")

    def judge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        points = matrix(list(group["vec"][:4 * LEAF_SAMPLE]))
        dense = near_counts(points, least).max() > max(4, len(points) / DENSE_SHARE)
        return pd.DataFrame([key] * int(dense), columns=keys)

    return some.groupBy(*keys).applyInPandas(judge, "tree int, leaf long, size int")


def split_large(placed: DataFrame, largest: int, rounds: int = ROUNDS, least: float = 0.9) -> DataFrame:
    """placed with leaves above `largest` split by further random directions, but for those with a dense group."""
    keys = ["tree", "leaf", "size"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [float(np.frombuffer(x.as_buffer()) @ direction(t.as_py(), n.as_py(), s.as_py() // 8))
                 for t, n, s, x in zip(*(batch.column(c) for c in ("tree", "leaf", "size", "vec")))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[*batch.schema.names, "p"])

    ready = []
    for _ in range(rounds):
        sizes = placed.groupBy(*keys).count().where(f"count > {largest}")
        if sizes.isEmpty():
            break
        mine = placed.join(sizes.drop("count"), keys, "left_semi")
        large = written(sizes.drop("count").join(dense_leaves(mine, sizes, least), keys, "left_anti"), "large")
        ready.append(placed.join(large, keys, "left_anti"))
        mine = placed.join(large, keys, "left_semi")
        mine = mine.mapInArrow(project, with_fields(mine.schema, "p double"))
        cuts = mine.groupBy(*keys).agg(F.percentile_approx("p", [0.5 - SPILL, 0.5 + SPILL], 1000).alias("q"))
        sides = F.array_compact(F.array(F.when(F.expr("p <= q[1]"), F.lit(1)), F.when(F.expr("p >= q[0]"), F.lit(2))))
        moved = mine.join(cuts, keys).select("tree", F.explode(sides).alias("side"), "leaf", "size", "class", "vec")
        placed = written(moved.select("tree", F.xxhash64("leaf", "side").alias("leaf"), "size", "class", "vec"), "leaves")
    for part in ready:
        placed = placed.unionByName(part)
    return placed


def links(placed: DataFrame, least: float, largest: int) -> DataFrame:
    """(a, b), a < b: distinct pairs of classes that share a leaf and have cosine >= least."""
    keys = ["tree", "leaf", "size"]
    blocks = placed.groupBy(*keys).agg(F.ceil(F.count("*") / largest).cast("int").alias("blocks"))
    rows = placed.join(blocks, keys).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.select(*keys, "class", "vec", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(*keys, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "class", "vec")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        points, names = matrix(list(group["vec"])), group["class"].to_numpy()
        left = np.flatnonzero(group["own"] == group["i"])
        right = np.flatnonzero(group["own"] == group["j"])
        a, b = [], []
        for k in range(0, len(left), 512):
            part = left[k:k + 512]
            x, y = np.nonzero(points[part] @ points[right].T >= least)
            a.append(names[part[x]])
            b.append(names[right[y]])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        low, high = np.minimum(a, b), np.maximum(a, b)
        return pd.DataFrame({"a": low, "b": high})[low < high].drop_duplicates()

    return rows.groupBy(*keys, "i", "j").applyInPandas(compare, "a long, b long").distinct()


def near_vectors(rows: DataFrame, least: float = 0.9, key: str = "vec_id", vector: str = "embedding", trees: int = TREES,
                 leaf: int = LEAF, largest: int = LARGEST) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest key that links reach), kept: one row per
    row. Links are those found in dense groups and by the forest, each with cosine >= least."""
    base = written(classes(rows, key, vector), "vectors")
    distinct = base.where("class is not null").groupBy("class").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"))
    distinct = written(distinct, "distinct")
    found = {size: centres(points, least) for size, points in sampled(distinct, distinct.count()).items()}
    rest, dense = distinct, None
    if any(map(len, found.values())):
        groups = written(grouped(distinct, found, least), "groups")
        dense = written(group_links(groups.where("centre >= 0"), least, TILE), "dense")
        rest = groups.where("centre = -1").select("class", "vec", "copies")
    placed = split_large(written(plant(rest, trees, leaf, least, largest), "leaves"), largest, ROUNDS, least)
    found = written(links(placed, least, largest), "links")
    sizes = distinct.select("class", "copies")
    both = found.union(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, both["b"] == sizes["class"]).select("a", F.col("copies").alias("linked"))
    if dense is not None:
        others = others.union(dense.select("class", "linked"))
        found = found.union(dense.select("class", "root"))
    others = others.groupBy("a").agg(F.sum("linked").alias("linked"))
    comps = connected_components(found)
    known = sizes.join(others, sizes["class"] == others["a"], "left").join(comps, F.col("class") == F.col("node"), "left").select(
        "class", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "class").alias("comp"))
    members = written(base.select("vec_id", "class").join(known, "class", "left"), "members")
    smallest = members.where("comp is not null").groupBy("comp").agg(F.min("vec_id").alias("component_id"))
    return members.join(smallest, "comp", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
