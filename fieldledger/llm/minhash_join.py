"""Near-duplicate documents by an inverted join on signature coordinates.

Documents with the same shingle set are one class. Each class has a signature of minima and is posted
under coordinate values. Two classes with at least t of k equal coordinates must meet in a list even if
each posts only its k - t + 1 rarest values (prefix), and values that no other class has need not be
posted at all (skip). Values that thousands of documents share are common, so they stay out of the prefix
of every document that has rarer ones, and a document with more than k - t values of its own has no partner.

This is done twice: a COARSE signature of all classes tells which can have a partner at all; only those
get a FINE one, whose lists are compared. Long lists come from groups of near copies. They are not
expanded into pairs: first every list links its members to one pivot, the member with the fewest values of
its own, and these pairs are confirmed on the full sets. Members that this has not brought into one component are
compared in tiles: one finds the members that have a partner with enough equal coordinates at all, another compares
those on their full sets, given as differences from the pivot's, and passes on links that join components, fewer than
it has rows. So what is passed on grows with the rows of a group, also where its pairs are near but not linked.

The matches wanted follow from the similarity asked for: a pair that has it is missed with probability below 5e-5.
For 0.85 they are 17 of 32 (COARSE) and 297 of 384 (FINE).

Null and empty texts have no shingles and are linked with nothing. Texts with fewer words than a shingle
are one shingle. Repeated rows are copies of each other. Other columns are ignored. A row without a key takes part in links
like any other; it is kept only if no row of its component has a key, and then the component has none either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WordHashes, having, mixed, slices, written
from .components import connected_components

WORDS = 5
COARSE, FINE = 32, 384
#: Probability that a pair of the similarity asked for has too few equal coordinates, at most.
COARSE_MISS, FINE_MISS = 5e-6, 4.5e-5
#: Lists of up to SHORT classes are joined with themselves, longer ones in tiles of about TILE rows.
SHORT, TILE = 6, 256
#: Rows, and bytes of differences, of a block in which sets are compared.
WIDE_TILE, TILE_BYTES = 2048, 16 << 20

_ODD = mixed(np.arange(1, 1000, dtype=np.uint64)) | np.uint64(1)
_XOR = mixed(np.arange(1001, 2000, dtype=np.uint64))


def matches_wanted(count: int, percent: int, miss: float) -> int:
    """The most equal coordinates of `count` that a pair of that similarity falls short of with probability <= miss."""
    p, below = percent / 100, 0.0
    for t in range(count):
        below += math.comb(count, t) * p**t * (1 - p)**(count - t)
        if below > miss:
            return max(1, t)
    return count


def shingles(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit shingles of a sequence of word hashes."""
    if len(hashes) < words:
        if not len(hashes):
            return hashes
        short = np.uint64(len(hashes)) + (hashes * _ODD[words:words + len(hashes)]).sum(dtype=np.uint64)
        return mixed(np.array([short], np.uint64))
    n = len(hashes) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += hashes[i:i + n] * _ODD[i]
    return np.unique(mixed(total))


def signature(elements: np.ndarray, first: int, count: int) -> np.ndarray:
    """Minima of the elements under the hash functions first .. first + count - 1, their upper 32 bits."""
    least = np.full(count, np.uint64(2**64 - 1))
    odd, flip = _ODD[first:first + count], _XOR[first:first + count]
    for i in range(0, len(elements), 1 << 12):
        np.minimum(least, ((elements[i:i + (1 << 12), None] ^ flip) * odd).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    known = WordHashes()
    for batch in batches:
        for rows in slices(batch, "text"):
            yield rows, [shingles(known.of((t or "").encode().lower().split())) for t in rows.column("text").to_pylist()]


def _class_of(elements: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(elements.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc_id, n_shingles, class (hash of the set, null if empty), sig (the coarse signature as binary)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_of(s) if len(s) else None for s in sets], pa.int64()),
                 pa.array([signature(s, 0, COARSE).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "class", "sig"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_shingles long, class long, sig binary")


def full_sets(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """class, n_shingles, sig (fine, binary), elements (binary) of the documents whose key is in wanted.doc_id, or null."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    rows = having(rows, wanted.where("doc_id is not null"), "doc_id").union(rows.where("doc_id is null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            sets = [s for s in sets if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([_class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([signature(s, COARSE, FINE).tobytes() for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())], names=["class", "n_shingles", "sig", "elements"])

    return rows.mapInArrow(run, "class long, n_shingles long, sig binary, elements binary")


def _posted(classes: DataFrame, count: int) -> DataFrame:
    """class, i (coordinate), v (coordinate and value as one key), f (classes that share it), for shared values only."""
    values = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(
        i.alias("i"), F.xxhash64(i, F.substr("sig", i * 4 + 1, F.lit(4))).alias("v")))
    posted = classes.select("class", F.inline(values))
    shared = posted.groupBy("v").agg(F.count("*").alias("f")).where("f > 1")
    return posted.join(shared, "v")


def partners_possible(classes: DataFrame, matches: int) -> DataFrame:
    """The classes that share enough coarse values with others to have a partner."""
    return _posted(classes, COARSE).groupBy("class").count().where(F.col("count") >= matches).select("class")


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """class, shared (number of its fine values that others have), prefix: array of (i, v), its rarest shared values,
    as many as a partner must meet at least one of."""
    every = _posted(classes, FINE).groupBy("class").agg(F.sort_array(F.collect_list(F.struct("f", "v", "i"))).alias("all"))
    return every.where(F.size("all") >= matches).select(
        "class", F.size("all").alias("shared"),
        F.transform(F.slice("all", F.lit(1), F.size("all") - (matches - 1)), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v")))
        .alias("prefix"))


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, FINE)


def _enough(pairs: DataFrame, posted: DataFrame, tested: DataFrame | None, percent: int, matches: int) -> DataFrame:
    """Pairs (a, b) not tested before whose signatures and set sizes allow the similarity."""
    side = lambda x: posted.select(F.col("class").alias(x), F.col("sig").alias(f"s{x}"), F.col("n_shingles").alias(f"n{x}"))
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    if tested is not None:
        pairs = pairs.join(tested, ["a", "b"], "left_anti")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"100 * least(na, nb) >= {percent} * greatest(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_matrix(batch.column(c).to_pylist()) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= matches))

    return pairs.mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked): 100 * intersection >= percent * union on the full sets."""
    right = sets.select(F.col("class").alias("b"), F.col("elements").alias("eb"))
    left = sets.select(F.col("class").alias("a"), F.col("elements").alias("ea"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("ea"), batch.column("eb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())],
                                             names=["a", "b", "linked"])

    return both.mapInArrow(run, "a long, b long, linked boolean")


def _dealt(lists: DataFrame, blocks) -> DataFrame:
    """lists with own (the block of a row) and one copy for every block that its block meets, as the group (v, x, y)."""
    rows = lists.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("blocks", "other")


def _candidates(lists: DataFrame, posted: DataFrame, matches: int) -> DataFrame:
    """(v, class) of the rows of lists (v, i, class, comp, f) that have a partner with enough matches and another component.
    A list is dealt into blocks of about TILE rows and every two blocks meet in one group; a pair counts in the list of the first
    coordinate that both prefixes have in common. A group passes on each of its rows once, however many partners it has."""
    import pandas as pd

    rows = lists.join(posted.select("class", "sig", F.transform("prefix.i", lambda i: i.cast("smallint")).alias("places")), "class")
    rows = _dealt(rows, F.ceil(F.col("f") / TILE))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        sig, comp, at = _matrix(group["sig"]), group["comp"].to_numpy(), group["class"].to_numpy()
        posted_at = np.zeros(sig.shape, bool)
        for k, places in enumerate(group["places"]):
            posted_at[k, places] = True
        left, right = np.flatnonzero(group["own"] == group["x"]), np.flatnonzero(group["own"] == group["y"])
        place, found = int(group["i"].iloc[0]), np.zeros(len(group), bool)
        for k in left:
            equal = sig[right] == sig[k]
            hit = np.flatnonzero((equal.sum(axis=1) >= matches) & (comp[right] != comp[k]))
            both = equal[hit] & posted_at[right[hit]] & posted_at[k]
            hit = right[hit[both.argmax(axis=1) == place]]
            found[hit] = True
            found[k] |= len(hit) > 0
        return pd.DataFrame({"v": group["v"].to_numpy()[found], "class": at[found]})

    return rows.groupBy("v", "x", "y").applyInPandas(meet, "v long, class long").distinct()


def _differences(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pivot, class, n_pivot, n_missing, delta: how the class's set differs from its pivot's, as the elements that only one has;
    n_missing of them are the pivot's."""
    every = sets.dropDuplicates(["class"]).select("class", "elements")
    both = pairs.join(every.select(F.col("class").alias("pivot"), F.col("elements").alias("ep")), "pivot").join(every, "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivots, missing, delta = [], [], []
            for p, e in zip(batch.column("ep"), batch.column("elements")):
                p, e = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(e.as_buffer(), np.uint64)
                gone = np.setdiff1d(p, e, assume_unique=True)
                pivots.append(len(p))
                missing.append(len(gone))
                delta.append(np.concatenate([gone, np.setdiff1d(e, p, assume_unique=True)]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("pivot"), batch.column("class"), pa.array(pivots, pa.int64()),
                                              pa.array(missing, pa.int64()), pa.array(delta, pa.binary())],
                                             names=["pivot", "class", "n_pivot", "n_missing", "delta"])

    return both.select("pivot", "class", "ep", "elements").mapInArrow(
        run, "pivot long, class long, n_pivot long, n_missing long, delta binary")


def linked_pairs(n_pivot: int, missing: np.ndarray, deltas: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Whether each of the rows `left` is linked to each of `right`, exactly. Sets A and B that differ from a set P by what is missing
    and what is added share |P| - |P \\ A| - |P \\ B| + |what both miss| + |what both add| elements."""
    size = np.array([len(d) for d in deltas], np.int64)
    owner = np.repeat(np.arange(len(deltas)), size)
    _, column, count = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    many = count[column] > 1  # what one row alone has is in no intersection
    owner, column = owner[many], column[many]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    column = np.cumsum(np.append(False, column[1:] != column[:-1])) if len(column) else column
    shared = np.zeros((len(left), len(right)), np.float32)  # whole numbers, exact up to 2^24 elements a step
    total = np.zeros(shared.shape, np.int64)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        part = np.zeros((len(deltas), 4096), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        np.matmul(part[left], part[right].T, out=shared)
        total += shared.astype(np.int64)
    n = n_pivot - 2 * missing + size  # of each set
    inside = n_pivot - missing[left][:, None] - missing[right][None, :] + total
    return 100 * inside >= percent * (n[left][:, None] + n[right][None, :] - inside)


def spanning_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray, comp: np.ndarray) -> list[tuple[int, int]]:
    """Links, as pairs of rows, that join all components that any link joins; fewer than there are components."""
    names, at = np.unique(comp, return_inverse=True)
    i, j = np.nonzero(linked & (at[left][:, None] != at[right][None, :]))
    if not len(i):
        return []
    a, b = at[left[i]], at[right[j]]
    _, first = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_index=True)
    root, out = list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for k in first.tolist():
        x, y = find(int(a[k])), find(int(b[k]))
        if x != y:
            root[x] = y
            out.append((int(left[i[k]]), int(right[j[k]])))
    return out


def _tile_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) that join the components of rows (v, pivot, class, comp) linked inside a list, by comparison on the full sets in blocks;
    a group passes on fewer pairs than it has rows."""
    import pandas as pd

    far = written(_differences(rows.select("pivot", "class").distinct(), sets), "differences")
    rows = rows.join(far, ["pivot", "class"])
    sizes = rows.groupBy("v").agg(F.count("*").alias("f"), F.sum(F.octet_length("delta").cast("long")).alias("bytes"))
    rows = _dealt(rows.join(sizes, "v"), F.greatest(F.ceil(F.col("f") / WIDE_TILE), F.ceil(F.col("bytes") / TILE_BYTES), F.lit(1)))

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        deltas = [np.frombuffer(d, np.uint64) for d in group["delta"]]
        left, right = np.flatnonzero(group["own"] == group["x"]), np.flatnonzero(group["own"] == group["y"])
        linked = linked_pairs(int(group["n_pivot"].iloc[0]), group["n_missing"].to_numpy(), deltas, left, right, percent)
        found = spanning_links(linked, left, right, group["comp"].to_numpy())
        names = group["class"].to_numpy()
        return pd.DataFrame({"a": names[[i for i, _ in found]], "b": names[[j for _, j in found]]}, dtype=np.int64)

    kept = rows.select("v", "x", "y", "own", "class", "comp", "n_pivot", "n_missing", "delta")
    return kept.groupBy("v", "x", "y").applyInPandas(meet, "a long, b long")


def _pivots(lists: DataFrame) -> DataFrame:
    """v, pivot: the member with the fewest values of its own, which in a group of near copies is closest to all others."""
    return lists.groupBy("v").agg(F.min_by("class", F.struct(-F.col("shared"), F.xxhash64("class"))).alias("pivot"))


def _pivot_pairs(lists: DataFrame) -> DataFrame:
    """(pivot, member) of every list."""
    return lists.join(_pivots(lists), "v").select(F.col("pivot").alias("a"), F.col("class").alias("b"))


def _open(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """v, i, class, comp, f of the lists that hold more than one component; labels: node, component. f is the length."""
    labels = labels.select(F.col("node").alias("class"), "component")
    rows = lists.join(labels, "class", "left").select("v", "i", "class", F.coalesce("component", "class").alias("comp"))
    several = rows.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("f")).where("lo <> hi")
    return rows.join(several.select("v", "f"), "v")


def near_duplicates(docs: DataFrame, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs. component_id is the smallest key that links
    reach; kept marks the rows whose key it is."""
    if percent < 80:
        raise ValueError("the signatures are made for similarities of 0.8 or more")
    coarse, enough = matches_wanted(COARSE, percent, COARSE_MISS), matches_wanted(FINE, percent, FINE_MISS)
    base = written(signatures(docs, key, text), "signatures")
    classes = base.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig"))
    wanted = written(partners_possible(classes, coarse).join(classes.select("class", "doc_id"), "class"), "wanted")
    sets = written(full_sets(docs, wanted.select("doc_id"), key, text), "sets")
    fine = sets.groupBy("class").agg(F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    posted = written(postings(fine, enough).join(fine, "class"), "postings")
    lists = posted.select("class", "shared", F.inline("prefix"))

    first = written(confirmed(_enough(_pivot_pairs(lists), posted, None, percent, enough), sets, percent), "confirmed")
    labels = written(connected_components(first.where("linked").select("a", "b")), "labels")
    rows = written(_open(lists, labels), "open")
    short = rows.where(f"f <= {SHORT}").select("v", "class", "comp")
    other = short.select("v", F.col("class").alias("b"), F.col("comp").alias("comp_b"))
    pairs = short.withColumnRenamed("class", "a").join(other, "v").where("a < b and comp <> comp_b").select("a", "b")
    rest = written(confirmed(_enough(pairs, posted, first.select("a", "b"), percent, enough), sets, percent), "confirmed")
    wide = rows.where(f"f > {SHORT}")
    near = written(_candidates(wide, posted, enough), "candidates")
    tiled = written(_tile_links(wide.join(near, ["v", "class"]).join(_pivots(lists), "v").select("v", "pivot", "class", "comp"), sets, percent),
                    "tiled")
    links = labels.select(F.col("node").alias("a"), F.col("component").alias("b")).union(rest.where("linked").select("a", "b")).union(tiled)
    comps = connected_components(links)
    members = base.join(comps, base["class"] == comps["node"], "left").select(
        "doc_id", "n_shingles", "class", F.coalesce("component", "class").alias("comp"))
    members = written(members, "members")
    least = members.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    out = members.join(least, "comp", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
