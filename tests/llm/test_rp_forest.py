import math

import numpy as np

from fieldledger.llm import rp_forest as R


def plain(rows, least=.9):
    good = [(k, np.array(v, float) / max(map(abs, v))) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    linked = {k: set() for k, _ in rows}
    for i, (a, x) in enumerate(good):
        for b, y in good[i + 1:]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                linked[a].add(b)
                linked[b].add(a)
    comp = {k: k for k in linked}
    for _ in range(60):
        for a, others in linked.items():
            for b in others:
                comp[a] = comp[b] = min(comp[a], comp[b])
    return sorted((k, len(linked[k]), comp[k], comp[k] == k) for k in linked)


def vectors(n=400, size=16, seed=2):
    draw = np.random.default_rng(seed)
    out = [draw.normal(size=size) for _ in range(n)]
    for i in range(0, 60):
        out.append(out[i] + draw.normal(size=size) * .1)
    base = draw.normal(size=size)
    out += [base + draw.normal(size=size) * .15 for _ in range(50)] + [base] * 40
    rows = [(100 + i, [float(x) for x in v]) for i, v in enumerate(out)]
    rows += [(1, None), (2, []), (3, [0.0] * size), (4, [1.0, None] * (size // 2)), (5, [float("nan")] * size), (6, [1.0, 2.0]),
             (7, [2.0, 4.0]), (8, [1e200] * size), (9, [1e-200] * size), (10, [-0.0, 1.0]), (11, [0.0, 1.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<double>, class int").repartition(3)


def test_one_leaf_finds_all(spark):
    rows = vectors()
    assert sorted(map(tuple, R.near_vectors(frame(spark, rows)).collect())) == plain(rows)


def test_recall_with_small_leaves_and_rounds(spark):
    rows = vectors(1500)
    want = {k: n for k, n, _, _ in plain(rows)}
    for options in ({"leaf": 48}, {"leaf": 4000, "largest": 64}):  # splits on the driver, splits in rounds
        got = {r["vec_id"]: r["n_links"] for r in R.near_vectors(frame(spark, rows), **options).collect()}
        assert all(got[k] <= n for k, n in want.items())
        assert sum(got.values()) >= .9 * sum(want.values())


def test_tiles(spark):
    rows = vectors(100)
    placed = R.plant(R.classes(frame(spark, rows), "vec_id", "embedding").where("class is not null").dropDuplicates(["class"]), 1, 10**6)
    small, large = (set(map(tuple, R.links(placed, .9, n).collect())) for n in (16, 10**6))
    assert small == large and small


def test_empty_table_and_floats(spark):
    assert R.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])] * 2, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, R.near_vectors(docs).collect())) == [(1, 3, 1, True)] * 2 + [(2, 3, 1, False)] * 2


def test_recall_at_the_threshold():
    """Pairs of cosine 0.9 among 12,000 vectors in leaves of the size that queries use: share that meet in a leaf."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.normal(size=(2_000, 64))
    side -= (side * x[:2_000]).sum(1, keepdims=True) * x[:2_000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    x = np.vstack([x, .9 * x[:2_000] + math.sqrt(1 - .81) * side])
    depth = math.ceil(math.log2(len(x) / R.LEAF))
    met = np.zeros(2_000, bool)
    for tree in range(R.TREES):
        for _, rows in R.route(x, tree, R.fit_tree(x, tree, depth)):
            inside = np.zeros(len(x), bool)
            inside[rows] = True
            met |= inside[:2_000] & inside[10_000:]
    assert met.mean() > .97


def test_recall_on_the_table(spark, sf):
    rows = [(r[0], [float(v) for v in r[1]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = {k: n for k, n, _, _ in plain(rows)}
    got = {r["vec_id"]: r["n_links"] for r in R.near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"), leaf=64).collect()}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= .9 * sum(want.values())


def dense_third(n, seed=5, size=64):
    """n unit vectors, a third of them in one group around the threshold, and the number of links of each."""
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, size))
    x[:n // 3] = draw.normal(size=size) + draw.normal(size=(n // 3, size)) * .33
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x, np.concatenate([(x[k:k + 500] @ x.T >= .9).sum(axis=1) - 1 for k in range(0, n, 500)])


def test_recall_in_a_large_group(spark):
    """A group of a third of the rows, at the settings that queries use."""
    x, want = dense_third(6000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([n for _, n in sorted((r["vec_id"], r["n_links"]) for r in R.near_vectors(rows).collect())])
    assert want.sum() > 1_000_000 and (got <= want).all() and got.sum() >= .99 * want.sum()


def test_large_leaf_with_a_group_stays_whole(spark):
    x, want = dense_third(1500)
    rows = spark.createDataFrame([(0, i, 64 * 8, i, v.tobytes()) for i, v in enumerate(x[:500])],
                                 "tree int, row long, size int, class long, vec binary")
    placed = rows.selectExpr("tree", "0L AS leaf", "size", "class", "vec")
    assert R.split_large(placed, 64).select("leaf").distinct().count() == 1
    assert 2 * R.links(R.split_large(placed, 64), .9, 64).count() == want[:500].sum()


def test_more_trees_for_a_deep_forest():
    points = np.random.default_rng(8).normal(size=(4000, 32))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    assert len(R.fit_forest(points, R.TREES, 2, .9, len(points), R.LARGEST)) == R.TREES
    assert len(R.fit_forest(points, R.TREES, 4, .9, 10**7, R.LARGEST)) > R.TREES
