"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-cased words (A-Z only) joined by single spaces, and one end byte. Each byte
is eight binary decisions, each with a context tree of its own over the DEPTH bytes before: a node holds
how often 0 and 1 came, gives the Krichevsky-Trofimov estimate, and the tree weights all depths by their
evidence in the training texts. The model does not move while it scores, so the probability of a byte in
a context is fixed, and a text's score is a sum over its grams (context and byte).

Counting: tasks count grams and words of their texts, Spark adds them up. Building: from the deepest
nodes to the root evidence is added up, from the root down the weights are multiplied; the deepest level
exists only inside tasks that hold all grams of a context. Scoring: the probabilities of frequent grams
and counts of frequent words, of a fixed number at most, are broadcast; what is left of each text is
counted and joined. Frequent keys never reach a join, and rare ones have few rows.

Texts are scored whole. A null text counts as empty: one end token, one end byte. Repeated rows are
scored (and learned from) one by one; other columns are ignored. Without training rows every decision has
probability 1/2.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mixed, slices, written

DEPTH = 5
END = b"\n"
#: Frequent words and grams that are broadcast, at most.
HOT_WORDS = 1 << 18
HOT_GRAMS = 1 << 19
SLOTS = 20
#: Distinct grams and words a counting task holds before it passes them on.
HELD = 1_500_000
LN_PI = math.log(math.pi)


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + END


def grams(parts: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """For every byte of all parts in order: the depth bytes before it and the byte itself, as one integer."""
    if not parts:
        return np.zeros(0, np.uint64)
    buffer = np.frombuffer(b"".join(END * depth + p for p in parts), np.uint8).astype(np.uint64)
    n = len(buffer) - depth
    gram = np.zeros(n, np.uint64)
    for j in range(depth + 1):
        gram = (gram << np.uint64(8)) | buffer[j:j + n]
    ends = np.cumsum([len(p) + depth for p in parts])
    inside = np.ones(n, bool)
    for j in range(1, depth + 1):
        inside[ends[:-1] - j] = False
    return gram[inside]


def log_gamma(x: np.ndarray) -> np.ndarray:
    z = x + 6
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - LN_PI


def _log_gamma(x: Column) -> Column:
    z = x + 6
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (
        1260 * z * z * z * z * z)
    return series - F.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5))


def _log_kt(zeros: Column, ones: Column) -> Column:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - LN_PI


class Numbers(dict):
    """Words numbered as they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class _Tally:
    """Grams with (training, all) counts and training words, of one task."""

    def __init__(self):
        self.words: Counter = Counter()
        self.empty()

    def empty(self) -> None:
        self.keys, self.train, self.every = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, found: np.ndarray, train: bool) -> None:
        keys, counts = np.unique(found, return_counts=True)
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both = both[order]
        head = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        if len(head):
            self.train = np.add.reduceat(np.concatenate([self.train, counts * train])[order], head)
            self.every = np.add.reduceat(np.concatenate([self.every, counts])[order], head)
            self.keys = both[head]

    def batches(self, words: bool, most: int = 100_000) -> Iterator[pa.RecordBatch]:
        names = ["word", "gram", "train", "every"]
        for a in range(0, len(self.keys), most):
            n = len(self.keys[a:a + most])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.binary()), pa.array(self.keys[a:a + most].astype(np.int64)), pa.array(self.train[a:a + most]),
                 pa.array(self.every[a:a + most])], names=names)
        self.empty()
        if words:
            items = list(self.words.items())
            for a in range(0, len(items), most):
                part = items[a:a + most]
                counts = pa.array([n for _, n in part], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.nulls(len(part), pa.int64()),
                                                  counts, counts], names=names)
            self.words.clear()


def gathered(docs: DataFrame, depth: int) -> DataFrame:
    """word or gram, train, every: counts over the training texts and over all. docs: text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [normal(t) for t in part.column("text").to_pylist()]
                train = part.column("train").to_pylist()
                learned = [t for t, y in zip(texts, train) if y]
                for t in learned:
                    tally.words.update(t.split())
                tally.words[END] += len(learned)
                tally.add(grams(learned, depth), True)
                tally.add(grams([t for t, y in zip(texts, train) if not y], depth), False)
                if len(tally.keys) > HELD or len(tally.words) > HELD // 3:
                    yield from tally.batches(len(tally.words) > HELD // 3)
        yield from tally.batches(True)

    found = docs.select("text", "train").mapInArrow(run, "word binary, gram long, train long, every long")
    return found.groupBy("word", "gram").agg(F.sum("train").alias("train"), F.sum("every").alias("every")).where(
        "gram is not null or train > 0")


def _blocks(batches: Iterator[pa.RecordBatch], column: str, least: int = 100_000) -> Iterator[pa.Table]:
    """The rows of a partition sorted by `column` in blocks that hold all rows of each of its values."""
    held: list = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            whole = pa.Table.from_batches(held)
            names = whole.column(column).to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield whole.slice(0, cut)
            held, rows = whole.slice(cut).to_batches(), whole.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)


def _decisions(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grams x 8): the node of each binary decision (context, then the bits so far after a leading 1), and its bit."""
    byte = (gram & 0xFF).astype(np.int64)[:, None]
    k = np.arange(8)
    node = ((gram >> 8).astype(np.int64)[:, None] << 8) | (1 << k) | (byte >> (8 - k))
    return node, (byte >> (7 - k)) & 1


def _deepest(gram: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct nodes of the deepest level, zeros and ones there, and the decisions' nodes (as index) and bits."""
    node, bit = _decisions(gram)
    names, index = np.unique(node, return_inverse=True)
    index = index.reshape(node.shape)
    counts = np.broadcast_to(train[:, None], node.shape)
    ones = np.bincount(index.ravel(), (counts * bit).ravel(), len(names))
    zeros = np.bincount(index.ravel(), (counts * (1 - bit)).ravel(), len(names))
    return names, zeros, ones, index, bit


def _shallower(depth: int) -> int:
    """Mask of a node's name one level above the deepest: depth - 1 bytes of context and the bits so far."""
    return (1 << (8 * depth)) - 1


def gram_scores(counts: DataFrame, depth: int) -> DataFrame:
    """gram, every, value: log10 probability of the byte in its context, for every gram counted."""
    above = _shallower(depth)
    parent = F.col("gram").bitwiseAND(F.lit(above).cast("long"))  # byte and depth - 1 bytes of context
    rows = counts.select("gram", "train", "every", F.shiftright(parent, 8).alias("context"))

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "context"):
            names, zeros, ones, _, _ = _deepest(block.column("gram").to_numpy(), block.column("train").to_numpy())
            upper, index = np.unique(names & above, return_inverse=True)
            sums = [np.bincount(index, x, len(upper)) for x in (zeros, ones, log_kt(zeros, ones))]
            yield pa.RecordBatch.from_arrays([pa.array(upper), *map(pa.array, sums)], names=["node", "zeros", "ones", "below"])

    nodes = rows.repartition("context").sortWithinPartitions("context").mapInArrow(
        up, "node long, zeros double, ones double, below double")
    levels = []
    for level in range(depth - 1, -1, -1):
        own = _log_kt(F.col("zeros"), F.col("ones"))
        nodes = nodes.select("node", "zeros", "ones", "below", own.alias("own"))
        top = F.greatest("own", "below")
        weighted = top + F.log(F.exp(F.col("own") - top) + F.exp(F.col("below") - top)) - math.log(2)
        nodes = written(nodes.select(
            "node", "zeros", "ones", weighted.alias("weighted"), (1 / (1 + F.exp(F.col("below") - F.col("own")))).alias("stop"),
            ((F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1)).alias("one")), f"level{level}")
        levels.append(nodes)
        if level:
            mask = F.lit((1 << (8 * level)) - 1).cast("long")
            nodes = nodes.groupBy(F.col("node").bitwiseAND(mask).alias("node")).agg(
                F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("below"))
    state = None
    for level, nodes in enumerate(reversed(levels)):
        if state is None:
            state = nodes.select("node", (F.col("stop") * F.col("one")).alias("sure"), (1 - F.col("stop")).alias("rest"))
        else:
            mask = F.lit((1 << (8 * level)) - 1).cast("long")
            state = nodes.withColumn("up", F.col("node").bitwiseAND(mask)).join(
                state.withColumnRenamed("node", "up"), "up").select(
                "node", (F.col("sure") + F.col("rest") * F.col("stop") * F.col("one")).alias("sure"),
                (F.col("rest") * (1 - F.col("stop"))).alias("rest"))

    both = rows.select("context", "gram", "train", "every", F.lit(None).cast("long").alias("node"),
                       F.lit(None).cast("double").alias("sure"), F.lit(None).cast("double").alias("rest")).unionByName(
        state.select(F.shiftright("node", 8).alias("context"), F.lit(None).cast("long").alias("gram"),
                     F.lit(0).cast("long").alias("train"), F.lit(0).cast("long").alias("every"), "node", "sure", "rest"))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, "context"):
            grams_of = block.filter(block.column("gram").is_valid())
            if not grams_of.num_rows:
                continue
            uppers = block.filter(block.column("node").is_valid()).sort_by("node")
            gram = grams_of.column("gram").to_numpy()
            names, zeros, ones, index, bit = _deepest(gram, grams_of.column("train").to_numpy())
            at = np.searchsorted(uppers.column("node").to_numpy(), names & above)
            one = uppers.column("sure").to_numpy()[at] + uppers.column("rest").to_numpy()[at] * (ones + 0.5) / (zeros + ones + 1)
            p = np.where(bit == 1, one[index], 1 - one[index])
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram), grams_of.column("every").combine_chunks(), pa.array(np.log10(p).sum(axis=1))],
                names=["gram", "every", "value"])

    return both.repartition("context").sortWithinPartitions("context").mapInArrow(down, "gram long, every long, value double")


def most_frequent(rows: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most `most`: all rows from a bound on that few enough reach."""
    step = F.floor(F.log2(count) * 8)
    reach, bound = 0, None
    for r in sorted(rows.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r["s"]):
        reach += r["n"]
        if reach > most:
            break
        bound = r["s"]
    return rows.where(F.lit(False) if bound is None else step >= bound)


EMPTY = np.uint64(2**64 - 1)


def _slot(gram: np.ndarray, turn: int) -> np.ndarray:
    """The gram's first or second place in the table."""
    return (mixed(gram + np.uint64(turn << 56)) >> np.uint64(64 - SLOTS)).astype(np.int64)


def hot_table(gram: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams, most frequent first, and values in a table of 2^SLOTS places. A gram takes its first place, else its
    second; the few that find both taken, rare ones as a rule, are looked up with the rare grams."""
    keys, values = np.full(1 << SLOTS, EMPTY), np.zeros(1 << SLOTS)
    for part in np.array_split(np.arange(len(gram)), 64):
        for turn in (0, 1):
            slot = _slot(gram[part], turn)
            first = np.zeros(len(part), bool)
            first[np.unique(slot, return_index=True)[1]] = True
            took = first & (keys[slot] == EMPTY)
            keys[slot[took]], values[slot[took]] = gram[part[took]], value[part[took]]
            part = part[~took]
    return keys, values


def looked_up(gram: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether each gram is in the table, its value or 0)."""
    slot = _slot(gram, 0)
    hit = keys[slot] == gram
    found = np.where(hit, values[slot], 0.0)
    rest = np.flatnonzero(~hit)
    slot = _slot(gram[rest], 1)
    second = keys[slot] == gram[rest]
    hit[rest[second]], found[rest[second]] = True, values[slot[second]]
    return hit, found


def per_text(gram: np.ndarray, owner: np.ndarray, texts: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (gram of `bits` bits, owner) in order of owner and gram, and how often each comes. Where both fit, one number of 64
    bits stands for them; owners beyond that are worked on in runs."""
    run = 1 << max(0, 64 - bits)
    edges = np.searchsorted(owner, np.arange(0, texts + run, run)) if texts > run else [0, len(owner)]
    found = [np.unique(((owner[a:b] % run).astype(np.uint64) << np.uint64(bits % 64)) | gram[a:b], return_counts=True)
             for a, b in zip(edges[:-1], edges[1:])]
    part = np.repeat(np.arange(len(found)) * run, [len(keys) for keys, _ in found])
    keys = np.concatenate([keys for keys, _ in found])
    return (keys & np.uint64((1 << bits) - 1), part + (keys >> np.uint64(bits)).astype(np.int64) if bits < 64 else part,
            np.concatenate([n for _, n in found]))


def scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte (code length; null for no
    bytes): one row per row of docs."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    counts = written(gathered(rows, depth), "counts")
    words = counts.where("word is not null").select("word", F.col("train").alias("c"))
    valued = written(gram_scores(counts.where("gram is not null"), depth), "grams")
    total, kinds = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    below = total + 0.1 * (kinds + 1)

    found = most_frequent(words, "c", HOT_WORDS).toArrow()
    shares = np.log10((found.column("c").to_numpy() + 0.1) / below).tolist()
    hot_words = dict(zip(found.column("word").to_pylist(), shares))
    found = most_frequent(valued, "every", HOT_GRAMS).toArrow().sort_by([("every", "descending"), ("gram", "ascending")])
    keys, values = hot_table(found.column("gram").to_numpy().astype(np.uint64), found.column("value").to_numpy())
    del found
    shared = rows.sparkSession.sparkContext.broadcast((hot_words, keys, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        hot_words, keys, values = shared.value
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [normal(t) for t in part.column("text").to_pylist()]
                n = len(texts)
                at, lists = Numbers(), [t.split() for t in texts]
                for words in lists:
                    words.append(END)
                sizes = np.array([len(words) for words in lists])
                index = np.fromiter(map(at.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
                owner = np.repeat(np.arange(n), sizes)
                # a logarithm of a share is never above 0
                value = np.fromiter(map(hot_words.get, at, repeat(1.0)), np.float64, len(at))
                warm = value[index] <= 0
                base = np.bincount(owner[warm], value[index[warm]], n)
                known = np.bincount(owner[warm], minlength=n)
                gram = grams(texts, depth)
                gram_owner = np.repeat(np.arange(n), [len(t) for t in texts])
                hit, found = looked_up(gram, keys, values)
                score = np.bincount(gram_owner, found, n)
                ids = row + np.arange(n)
                row += n

                cold, many = np.unique(owner[~warm] * max(1, len(at)) + index[~warm], return_counts=True)
                names = list(at)
                word = pa.array([names[i] for i in cold % max(1, len(at))], pa.binary())
                g, o, repeats = per_text(gram[~hit], gram_owner[~hit], n, 8 * (depth + 1))

                def made(ids, doc=None, train=None, tokens=None, size=None, known=None, base=None, score=None, word=None, gram=None, n=None):
                    columns = ((doc, kind), (train, pa.bool_()), (tokens, pa.int64()), (size, pa.int64()), (known, pa.int64()),
                               (base, pa.float64()), (score, pa.float64()), (word, pa.binary()), (gram, pa.int64()), (n, pa.int64()))
                    return pa.RecordBatch.from_arrays(
                        [pa.array(ids), *(pa.nulls(len(ids), t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t)
                                          for c, t in columns)],
                        names=["row", "doc_id", "train", "n_tokens", "n_bytes", "n_known", "base_score", "score", "word", "gram", "n"])

                kind = part.schema.field("doc_id").type
                yield made(ids, part.column("doc_id"), part.column("train"), sizes, np.array([len(t) for t in texts]), known, base, score)
                if len(cold):
                    yield made(ids[cold // len(at)], word=word, n=many)
                if len(g):
                    yield made(ids[o], gram=g.astype(np.int64), n=repeats)

    kind = rows.schema["doc_id"].dataType.simpleString()
    passed = written(rows.mapInArrow(
        run, f"row long, doc_id {kind}, train boolean, n_tokens long, n_bytes long, n_known long, base_score double, score double,"
             " word binary, gram long, n long"), "passed")
    whole = passed.where("n_tokens is not null").select("row", "doc_id", "train", "n_tokens", "n_bytes", "n_known", "base_score", "score")
    count = F.coalesce("c", F.lit(0))
    by_word = passed.where("word is not null").select("row", "word", "n").join(words, "word", "left").select(
        "row", F.when(count > 0, F.col("n")).alias("n_known"), (F.col("n") * F.log10((count + 0.1) / below)).alias("base_score"))
    by_gram = passed.where("gram is not null").select("row", "gram", "n").join(valued, "gram").select(
        "row", (F.col("n") * F.col("value")).alias("score"))
    every = whole.unionByName(by_word, allowMissingColumns=True).unionByName(by_gram, allowMissingColumns=True)
    return every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), (~F.max("train")).alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        F.sum("base_score").alias("base_score"), F.sum("score").alias("score"), F.sum("n_bytes").alias("n_bytes")).drop("row").withColumn(
        "bits_per_byte", F.when(F.col("n_bytes") > 0, -F.col("score") / (F.log10(F.lit(2.0)) * F.col("n_bytes"))))
