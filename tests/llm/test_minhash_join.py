import itertools
import random

import numpy as np

from fieldledger.llm import minhash_join as M
from fieldledger.llm.components import connected_components


def words_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def plain(rows, percent=85):
    sets = [words_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), key), key)
    return sorted((key, len(sets[i]), least[find(i)], key == least[find(i)]) for i, (key, _) in enumerate(rows))


def corpus(seed=3):
    draw = random.Random(seed)
    make = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]
    shared = make(60)
    texts = [" ".join(make(draw.randrange(1, 200))) for _ in range(60)]
    for size, edits in ((25, 3), (12, 8), (140, 2)):
        base = make(160)
        for _ in range(size):
            copy = list(base)
            for _ in range(draw.randrange(edits + 1)):
                copy[draw.randrange(len(copy))] = f"e{draw.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(shared + make(40)) for _ in range(90)]      # a passage that many share, too little for a link
    texts += [" ".join(shared + make(4)) for _ in range(20)]       # and here enough
    texts += ["exact copy of a text with some words"] * 30 + ["Exact  COPY of a text\nwith some words"] * 3
    texts += [None, "", " \n", "one", "one", "two words", "long " * 5000, "long " * 5001]
    draw.shuffle(texts)
    return [(1000 + i, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == plain(rows)


def test_tiles_find_what_lists_find(spark, monkeypatch):
    monkeypatch.setattr(M, "TILE", 8)
    monkeypatch.setattr(M, "SHORT", 2)
    monkeypatch.setattr(M, "WIDE_TILE", 8)
    monkeypatch.setattr(M, "_pivot_pairs", lambda lists: lists.select(lists["class"].alias("a"), lists["class"].alias("b")))
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == plain(rows)


def test_empty_table_extra_columns_repeated_rows(spark):
    schema = "doc_id long, text string, class string, sig int"
    assert M.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", "x", 1)] * 2 + [(2, None, None, None), (3, "a b c d e f", "x", 1)], schema)
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False)]


def test_rows_without_a_key(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(None, words), (2, words + " x"), (None, "only nulls have this text"), (None, "only nulls have this text"), (5, "another text of five words")]
    got = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == [
        ("2", 57, "2", True), ("5", 1, "5", True), ("None", 1, "None", True), ("None", 1, "None", True), ("None", 56, "2", False)]


def near_copies(count, seed=1):
    draw = random.Random(seed)
    base = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(count):
        copy = list(base)
        for at in draw.sample(range(400), 4):
            copy[at] = f"e{draw.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


def test_what_tiles_pass_on_grows_with_the_rows(spark, monkeypatch):
    """Copies that are near each other, most of them not linked: pairs must not grow with the square of their number."""
    made = []
    keep = M.written
    monkeypatch.setattr(M, "written", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    for n in (200, 400, 800):
        made.clear()
        rows = list(enumerate(near_copies(n)))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = sorted(map(tuple, M.near_duplicates(docs).collect()))
        if n == 200:
            assert got == plain(rows)
        for name, df in made:
            if name in ("confirmed", "candidates", "tiled", "differences"):
                assert df.count() <= 20 * n, (n, name)


def test_links_from_differences():
    draw = random.Random(4)
    for percent in (50, 85):
        sets = [np.array(sorted(draw.sample(range(100), draw.randrange(30, 60))), np.uint64) for _ in range(40)]
        pivot = sets[0]
        gone = [np.setdiff1d(pivot, s) for s in sets]
        deltas = [np.concatenate([g, np.setdiff1d(s, pivot)]) for g, s in zip(gone, sets)]
        left, right = np.arange(0, 25), np.arange(15, 40)
        got = M.linked_pairs(len(pivot), np.array([len(g) for g in gone]), deltas, left, right, percent)
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                assert got[i, j] == (100 * len(x & y) >= percent * len(x | y))


def test_components(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 560)] + [(draw.randrange(1000, 1080), draw.randrange(1000, 1080)) for _ in range(50)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    alone = {n for n in root if all(a == b for a, b in edges if n in (a, b))}
    assert got == {n: r for n, r in root.items() if n not in alone}


def test_matches_follow_from_the_percent(spark):
    assert (M.matches_wanted(M.COARSE, 85, M.COARSE_MISS), M.matches_wanted(M.FINE, 85, M.FINE_MISS)) == (17, 297)
    rows = []
    for i in range(100):  # 400 shingles each, 356 shared: similarity 0.802
        words = [f"w{i}x{k}" for k in range(448)]
        rows += [(2 * i, " ".join(words[:404])), (2 * i + 1, " ".join(words[44:]))]
    found = M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 80)
    assert found.where("kept").count() == 100
