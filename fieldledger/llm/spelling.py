"""Spelling variants: words one edit apart, found through one-edit neighbourhoods in a reduced alphabet.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z in lower case. A run whose hash (crc32 of "key:run") is a
multiple of `noise` loses the code point at hash mod length, in all its occurrences under that key. Words of at
least LEAST_LENGTH code points and LEAST_COUNT occurrences overall make the vocabulary.

Each letter is hashed to one of SYMBOLS symbols. Words one edit apart have reduced words at most one edit apart, so every
word generates the full one-edit neighbourhood of its reduced word (itself, all deletions, replacements and insertions,
each string once), the keys that the reduced vocabulary does not hold are dropped by a bitmap of fixed size, and the rest
is joined with the reduced vocabulary. What meets is verified on the original strings. Reduced words travel as 64-bit
hashes, whose collisions only add pairs to verify.

Null and empty texts have no words; a null key counts as the empty text before the colon. Repeated rows count each
time; other columns are not read. Ties for the largest n go to the smallest word in code-point order. No rows give no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bitmap import bitmap, has
from .common import apart, mixed, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs at least so many times as often as its variant.
TIMES = 5
NOISE = 199
SYMBOLS = 6
BITS = 28
#: Distinct words that a task counts before it hands them on, and numbers in one array of neighbours.
TALLY, CELLS = 400_000, 1 << 21

_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_STEP = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_STEP, -1, 2**64))
#: The symbol of every code point of one byte.
_SYMBOL = (mixed(np.arange(256, dtype=np.uint64) + np.uint64(77)) % np.uint64(SYMBOLS)).astype(np.uint8)


def _counted(batches: Iterator[pa.RecordBatch], noise: int, least: int) -> Iterator[pa.RecordBatch]:
    tally: Counter[str] = Counter()

    def flush():
        out = pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array(list(tally.values()), pa.int64())],
                                         names=["word", "n"])
        tally.clear()
        return out

    for batch in batches:
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
            if not text.is_valid:
                continue
            prefix = zlib.crc32(key.encode() + b":")
            for run, n in Counter(_RUN.findall(text.as_buffer().to_pybytes().translate(_LOWER))).items():
                word, h = run.decode(), zlib.crc32(run, prefix)
                if h % noise == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1:]
                if len(word) >= least:
                    tally[word] += n
            if len(tally) >= TALLY:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("binary").alias("text"))
    counts = rows.mapInArrow(lambda batches: _counted(batches, noise, LEAST_LENGTH), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(count: int) -> np.ndarray:
    out = np.ones(count, np.uint64)
    out[1:] = np.uint64(_STEP)
    return np.multiply.accumulate(out)


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return mixed(total ^ np.uint64(length * 0xD6E8FEB86659FD93 % 2**64))


def _sums(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of words of one length (rows of code points), the powers, and the sums of symbol * power before each place."""
    symbols = _SYMBOL[words].astype(np.uint64) + np.uint64(1)
    powers = _powers(words.shape[1] + 1)
    before = np.zeros((len(words), words.shape[1] + 1), np.uint64)
    np.cumsum(symbols * powers[:-1], axis=1, out=before[:, 1:])
    return symbols, powers, before


def reduced(words: np.ndarray) -> np.ndarray:
    """The key of the reduced word of each row."""
    return _key(_sums(words)[2][:, -1], words.shape[1])


def neighbourhood(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, keys) of all strings at most one edit from the reduced word of each row, each string once."""
    symbols, powers, before = _sums(words)
    total, length = before[:, -1:], words.shape[1]
    every = np.arange(len(words))
    yield every, _key(total[:, 0], length)
    # a deletion inside a run of equal symbols is the same at each of its places: the first
    first = np.ones(symbols.shape, bool)
    first[:, 1:] = symbols[:, 1:] != symbols[:, :-1]
    yield np.nonzero(first)[0], _key(before[:, :-1] + (total - before[:, 1:]) * _BACK, length - 1)[first]
    for s in range(1, SYMBOLS + 1):
        other = symbols != np.uint64(s)
        yield np.nonzero(other)[0], _key(total + (np.uint64(s) - symbols) * powers[:-1], length)[other]
        # an insertion before an equal symbol is the same as behind it: the last place
        last = np.ones(before.shape, bool)
        last[:, :-1] = other
        yield np.nonzero(last)[0], _key(before + np.uint64(s) * powers + (total - before) * np.uint64(_STEP), length + 1)[last]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, code points) of its words, length by length, at most CELLS code points at once."""
    words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (length + 1))
        for i in range(0, len(places), step):
            part = places[i:i + step]
            yield part, np.frombuffer(b"".join(words[j] for j in part), np.uint8).reshape(len(part), length)


def _with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for places, words in _by_length(batch):
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(places)).columns, pa.array(reduced(words).view(np.int64))],
                                             names=["word", "n", "key"])


def near_pairs(vocab: DataFrame) -> DataFrame:
    """word, n, near, near_n of every two words of vocab (word, n, key; a written table) one edit apart, both ways."""
    known = vocab.sparkSession.sparkContext.broadcast(bitmap(vocab, "key", BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, words in _by_length(batch):
                for rows, keys in neighbourhood(words):
                    there = has(known.value, keys)
                    hits = pa.array(places[rows[there]])
                    yield pa.RecordBatch.from_arrays([batch.column("word").take(hits), batch.column("n").take(hits),
                                                      pa.array(keys[there].view(np.int64))], names=["word", "n", "key"])

    around = vocab.mapInArrow(run, "word string, n long, key long")
    other = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"), "key")
    return around.join(apart(other), "key").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form, form_n) of a written table: the last word that forms lead to. A form occurs TIMES as often
    as its word, so the largest form_n bounds the steps; each round doubles those taken."""
    largest = forms.agg(F.max("form_n")).first()[0]
    ends = forms.select("word", F.col("form").alias("root"))
    steps = 1
    while largest is not None and steps < math.log(largest / LEAST_COUNT, TIMES) + 1e-9:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        ends = written(ends.join(apart(ahead), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        steps *= 2
    return ends


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the vocabulary."""
    vocab = written(vocabulary(docs, key, text, noise).mapInArrow(_with_key, "word string, n long, key long"), "vocabulary")
    near = near_pairs(vocab).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("x"))
    near = near.select("word", "n_near", F.col("x.near").alias("near"), (-F.col("x.col1")).alias("near_n"))
    far = F.col("near_n") >= TIMES * F.col("n")
    rows = written(vocab.join(apart(near), "word", "left").select(
        "word", F.when(far, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("near_n")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(apart(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
