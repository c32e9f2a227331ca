"""Collocations of 2 to 4 words per language, by the SON scheme: shards are mined at a lowered support, the union is counted.

Documents belong to one of SHARDS shards, by the partition they are read in. A phrase with `support` occurrences in a language
has at least the shard's part of it, rounded up, in one shard: if it had less in all, the parts would sum up to less
than the support. So every shard is mined completely at that local support, which follows from the shard's share of
the language's words, and the union of what is frequent in a shard holds every frequent phrase. Mining is by level: words,
then pairs of words that can be frequent, then triples and quadruples all of whose pairs can be. It works on 64-bit keys
of (language, phrase): tasks add up a block of text at a time, Spark adds up by (language, shard, key). Keys that meet only
make more candidates. The candidates go to the tasks as bitmaps of fixed size, and a last pass over all texts counts
their phrases as texts, over all shards, exactly.

Texts are bytes with A-Z in lower case, cut into pieces at `. , ; : ! ?` and line ends (\\n \\v \\f \\r) and pieces into words
at spaces and tabs. Null and empty texts have no words; a null language is `und`, and the empty language is one of its own. A
null key is a row like any other: only text and language are read, so repeated rows count each time and other columns, of
whatever name, do not matter. A text above SEGMENT bytes is worked on in segments cut at piece borders, which no phrase
crosses. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bitmap import bitmap, has
from .common import mixed, release, written

UNKNOWN = "und"
LONGEST = 4
SHARDS = 5
#: A candidate goes if its words lie in a longer one with so many hundredths of its occurrences.
ABSORBED = 80
#: log2 of the bits of the bitmaps of words, and of phrases (8 and 32 MB).
WORD_BITS, PHRASE_BITS = 26, 28
#: Tokens of a block inside a task, and bytes of a text made into tokens at once; a block ends at four times these bytes.
BLOCK, SEGMENT = 1_000_000, 4 << 20
#: Bytes in which words are looked for at once, so that arrays stay in cache.
LOCATED = 1 << 18
#: Rows of a batch that leaves a task, and bytes of a string above which it is hashed and compared by itself.
ROWS, LONG_WORD = 100_000, 512
#: Parts in which a language is ranked before its best are ranked together.
RANK_PARTS = 64

#: A byte that no UTF-8 text holds: marks rows that count all words.
BORDER = b"\xff"
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the lowest bytes, by their number.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _table() -> bytes:
    table = bytearray(range(256))
    for i in range(ord("A"), ord("Z") + 1):
        table[i] = i + 32
    for c in b".,;:!?\n\x0b\x0c\r":
        table[c] = ord("\n")
    table[ord("\t")] = ord(" ")
    return bytes(table)


_TABLE = _table()


def segments(text: bytes) -> Iterator[bytes]:
    """A text with A-Z in lower case, a space between words and a line feed between pieces, in runs of about SEGMENT bytes that end
    at a border."""
    text = text.translate(_TABLE)
    start = 0
    while start < len(text):
        end = text.find(b"\n", start + SEGMENT) if len(text) - start > SEGMENT else -1
        end = len(text) if end < 0 else end + 1
        yield text[start:end]
        start = end


def _words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as a number; data ends in eight bytes that belong to nothing."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings at `start`; the same string has the same hash wherever it lies."""
    eight, left = _words_at(data), length
    total = mixed(length.astype(np.uint64) * _STEP ^ (eight[start] & _LOW[np.minimum(length, 8)]))
    at = np.flatnonzero(length > 8)
    for word in at[length[at] > LONG_WORD].tolist():
        total[word] = xxhash.xxh3_64_intdigest(data[start[word]:start[word] + length[word]].tobytes())
    at = at[length[at] <= LONG_WORD]
    for place in range(8, LONG_WORD, 8):
        at = at[length[at] > place]
        if not len(at):
            break
        left = np.minimum(length[at] - place, 8)
        total[at] = mixed(total[at] * _STEP ^ (eight[start[at] + place] & _LOW[left]))
    return total


def repeats(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each byte string is, byte for byte, the one before it in the arrays."""
    out = np.zeros(len(start), bool)
    if len(start) < 2:
        return out
    eight = _words_at(data)
    out[1:] = length[1:] == length[:-1]
    at = np.flatnonzero(out)
    long = at[length[at] > LONG_WORD]
    out[long] = [data[start[i]:start[i] + length[i]].tobytes() == data[start[i - 1]:start[i - 1] + length[i]].tobytes() for i in long.tolist()]
    at = at[length[at] <= LONG_WORD]
    for place in range(0, LONG_WORD, 8):
        at = at[length[at] > place]
        if not len(at):
            break
        low = _LOW[np.minimum(length[at] - place, 8)]
        same = (eight[start[at] + place] ^ eight[start[at - 1] + place]) & low == 0
        out[at[~same]] = False
        at = at[same]
    return out


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The byte strings as an Arrow array."""
    ends = np.cumsum(length)
    flat = data[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _parts(length: np.ndarray) -> Iterator[slice]:
    """Cuts of at most ROWS strings and about SEGMENT bytes."""
    ends, a = np.cumsum(length), 0
    while a < len(length):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + SEGMENT, "right"))
        b = min(max(b, a + 1), a + ROWS)
        yield slice(a, b)
        a = b


def _located(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(data, start, length, word) of some texts at a time: their bytes with one space between words, so that a phrase is one run of
    bytes, and eight bytes behind them, the places of words and borders, and which are words."""
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= LOCATED:
            size, b = size + len(texts[b]), b + 1
        data = np.frombuffer(b"\n".join(texts[a:b]) + b"\n", np.uint8)
        space = data == 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        data = np.concatenate([data[keep], np.zeros(8, np.uint8)])
        border = data[:-8] == 10
        gap = border | (data[:-8] == 32)
        head, tail = ~gap, ~gap
        head[1:] &= gap[:-1]
        tail[:-1] &= gap[1:]
        start = np.flatnonzero(head | border)
        word = ~border[start]
        length = np.zeros(len(start), np.int64)
        length[word] = np.flatnonzero(tail) + 1 - start[word]
        yield data, start, length, word
        a = b


class Block:
    """Words of whole segments, one language after the other, as places in one buffer, with a border behind each piece."""

    def __init__(self):
        self.texts: dict[str, list[bytes]] = {}
        self.size = self.bytes = 0

    def add(self, language: str, text: bytes) -> None:
        self.texts.setdefault(language, []).append(text)
        self.bytes += len(text)
        self.size += text.count(b" ") + text.count(b"\n") + 1

    def close(self) -> Block:
        self.names, pieces, ends, n, base = list(self.texts), [], [], 0, 0
        self.seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in self.names], np.uint64)
        for seed, texts in zip(self.seeds, self.texts.values()):
            for data, start, length, word in _located(texts):
                pieces.append((data[:-8], start + base, length, word, mixed(hashes(data, start, length) ^ seed)))
                n, base = n + len(start), base + len(data) - 8
            ends.append(n)
        self.texts, self.ends = {}, np.array(ends)  # of the languages, in tokens
        data, start, length, word, key = zip(*pieces)
        del pieces
        self.data = np.concatenate([*data, np.zeros(8, np.uint8)])
        del data
        self.start, self.length, self.word, self.key = map(np.concatenate, (start, length, word, key))
        return self

    def by_language(self, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(language, places) of ascending places."""
        ends = np.searchsorted(at, self.ends)
        for language, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            if a < b:
                yield language, at[a:b]

    def texts_of(self, at: np.ndarray, keys: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, occurrences) of the texts of `words` words at these places with these keys; a text may come twice
        where others share its key."""
        low = np.uint64(len(at).bit_length())
        order = np.sort(keys >> low << low | np.arange(len(at), dtype=np.uint64))  # place and key in one number: sorted many times as fast
        at = at[(order & np.uint64((1 << int(low)) - 1)).astype(np.int64)]
        start, last = self.start[at], at + words - 1
        length = self.start[last] + self.length[last] - start
        first = np.flatnonzero(~repeats(self.data, start, length))
        return start[first], length[first], np.diff(np.append(first, len(at)))

    def grams(self, words: int) -> np.ndarray:
        """Keys of the runs of `words` tokens, whatever they hold."""
        n = len(self.key) - words + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        total = self.key[:n]
        for i in range(1, words):
            total = mixed(total * _STEP + self.key[i:n + i])
        return total

    def allowed(self, word_bits: np.ndarray, pair_bits: np.ndarray | None = None) -> list[np.ndarray]:
        """By number of words less one: where all words, and all pairs if given, can be frequent."""
        single = _has_where(word_bits, self.key, self.word)
        out = [single, single[:-1] & single[1:]]
        if pair_bits is not None:
            out[1] = out[1] & _has_where(pair_bits, self.grams(2), out[1])
        for words in range(3, LONGEST + 1):
            out.append(out[-1][:-1] & out[1][words - 2:])
        return out


def _has_where(whole: np.ndarray, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    at = np.flatnonzero(wanted)
    out[at] = has(whole, keys[at])
    return out


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    block = Block()
    for batch in batches:
        for text, language in zip(batch.column("text"), batch.column("lang")):
            if not text.is_valid:
                continue
            for segment in segments(text.as_buffer().to_pybytes()):
                block.add(language.as_py(), segment)
                if block.size >= BLOCK or block.bytes >= 4 * SEGMENT:
                    yield block.close()
                    block = Block()
    if block.size:
        yield block.close()


def _tasks(docs: DataFrame, run: Callable[[Block, int], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """run(block, shard) over the blocks of all partitions of docs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() % SHARDS
        for block in blocks(batches):
            yield from run(block, shard)

    return docs.mapInArrow(task, schema)


def _word_counts(block: Block, shard: int) -> Iterator[pa.RecordBatch]:
    for language, at in block.by_language(np.flatnonzero(block.word)):
        name = block.names[language]
        yield pa.RecordBatch.from_arrays(  # in place of a word: all words of the language
            [pa.array([name]), pa.array([BORDER + bytes([shard])], pa.binary()), pa.array([len(at)])], names=["lang", "word", "n"])
        start, length, n = block.texts_of(at, block.key[at], 1)
        for part in _parts(length):
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(name, pa.string()), len(n[part])), gathered(block.data, start[part], length[part]), pa.array(n[part])],
                names=["lang", "word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary), f: the occurrences of every word, and under BORDER and the shard's number those of all words of a shard."""
    rows = _tasks(docs, _word_counts, "lang string, word binary, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("f"))


def _is_total() -> Column:
    return F.col("word").startswith(F.lit(bytearray(BORDER)))


def word_keys(words: DataFrame) -> DataFrame:
    """key of every (lang, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in batch.column("lang").to_pylist()], np.uint64)
            words = batch.column("word").to_pylist()
            length = np.fromiter(map(len, words), np.int64, len(words))
            flat = hashes(np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.cumsum(length) - length, length) ^ seeds
            yield pa.RecordBatch.from_arrays([pa.array(mixed(flat).view(np.int64))], names=["key"])

    return words.select("lang", "word").mapInArrow(run, "key long")


def _cell(seed: int, shard: int) -> int:
    """Language and shard as one number; languages that share the upper 56 bits of their hash share cells."""
    return (seed >> 8 << 8 | shard) - (1 << 63)


def local_supports(totals: DataFrame, support: int) -> DataFrame:
    """cell, least: the occurrences in a shard of a language that make a phrase locally frequent, from (lang, shard, f). Over the
    shards of a language (least - 1) sums up to less than `support`."""

    @F.udf("long")
    def cell(lang, shard):
        return _cell(xxhash.xxh3_64_intdigest(lang.encode()), shard)

    whole = totals.groupBy("lang").agg(F.sum("f").alias("n"))
    share = F.ceil(F.lit(support) * F.col("f").cast("decimal(20,0)") / F.col("n")).cast("long")
    rows = totals.join(whole, "lang").select(cell("lang", "shard").alias("cell"), share.alias("least"))
    return rows.groupBy("cell").agg(F.greatest(F.min("least"), F.lit(1)).alias("least"))


def mined(docs: DataFrame, supports: DataFrame, sizes: tuple[int, ...], word_bits, pair_bits=None) -> DataFrame:
    """key: the phrases of these numbers of words that are frequent in at least one shard, as keys."""

    def run(block: Block, shard: int) -> Iterator[pa.RecordBatch]:
        allowed = block.allowed(word_bits.value, pair_bits.value if pair_bits is not None else None)
        cells = np.array([_cell(int(s), shard) for s in block.seeds], np.int64)
        for words in sizes:
            keys = block.grams(words)
            for language, at in block.by_language(np.flatnonzero(allowed[words - 1])):
                mine = np.sort(keys[at])
                first = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
                n = np.diff(np.append(first, len(mine)))
                for a in range(0, len(n), ROWS):
                    b = min(len(n), a + ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(b - a, cells[language])), pa.array(mine[first[a:b]].view(np.int64)),
                                                      pa.array(n[a:b])], names=["cell", "key", "n"])

    rows = _tasks(docs, run, "cell long, key long, n long")
    local = rows.groupBy("cell", "key").agg(F.sum("n").alias("n"))
    return local.join(supports, "cell").where("n >= least").select("key")


def phrase_counts(docs: DataFrame, word_bits, pair_bits, long_bits) -> DataFrame:
    """lang, phrase (binary), words, a: all occurrences of every candidate, counted as texts."""

    def run(block: Block, shard: int) -> Iterator[pa.RecordBatch]:
        allowed = block.allowed(word_bits.value, pair_bits.value)
        for words in range(2, LONGEST + 1):
            keys, ok = block.grams(words), allowed[words - 1]
            every = np.flatnonzero(_has_where(long_bits.value, keys, ok) if words > 2 else ok)
            for language, at in block.by_language(every):
                start, length, n = block.texts_of(at, keys[at], words)
                for part in _parts(length):
                    size = len(n[part])
                    yield pa.RecordBatch.from_arrays(
                        [pa.repeat(pa.scalar(block.names[language], pa.string()), size), gathered(block.data, start[part], length[part]),
                         pa.array(np.full(size, words, np.int32)), pa.array(n[part])], names=["lang", "phrase", "words", "a"])

    rows = _tasks(docs, run, "lang string, phrase binary, words int, a long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))


def frequent_phrases(docs: DataFrame, support: int = 30, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(words, phrases), written: words has lang, word, f of every word; phrases has lang, phrase, words, a of all
    phrases of 2 to 4 words with a >= support. Words and phrases are binary (UTF-8)."""
    if support < 1:
        raise ValueError("support must be at least 1")
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    send = docs.sparkSession.sparkContext.broadcast
    counts = written(word_counts(rows), "words")
    words = counts.where(~_is_total())
    shard = F.conv(F.hex(F.substr("word", F.lit(2))), 16, 10).cast("int")
    supports = written(local_supports(counts.where(_is_total()).select("lang", shard.alias("shard"), "f"), support), "supports")
    word_bits = send(bitmap(word_keys(words.where(F.col("f") >= support)), "key", WORD_BITS))
    release(docs.sparkSession)
    pair_bits = send(bitmap(mined(rows, supports, (2,), word_bits), "key", PHRASE_BITS))
    release(docs.sparkSession)
    long_bits = send(bitmap(mined(rows, supports, tuple(range(3, LONGEST + 1)), word_bits, pair_bits), "key", PHRASE_BITS))
    release(docs.sparkSession)
    phrases = phrase_counts(rows, word_bits, pair_bits, long_bits).where(F.col("a") >= support)
    return words, written(phrases, "phrases")


def scored(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, words, a, l, r, score of the phrases: the cut with the lowest score, of equal ones the first."""
    known = words.select("lang", F.col("word").alias("part"), "f").union(phrases.select("lang", "phrase", "a"))
    pieces = F.split(F.col("phrase").cast("string"), " ")
    join = lambda p: F.array_join(p, " ").cast("binary")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), join(F.slice(pieces, F.lit(1), k)).alias("left"), join(F.slice(pieces, k + 1, F.col("words") - k)).alias("right")))
    rows = phrases.select("lang", "phrase", "words", "a", F.inline(cuts))
    side = lambda part, f: known.select("lang", F.col("part").alias(part), F.col("f").alias(f))
    rows = rows.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("cast(cast(2000000 as decimal(20,0)) * cast(a as decimal(18,0)) div (cast(l as decimal(20,0)) + r) as bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return rows.groupBy("lang", "phrase", "words").agg(F.first("a").alias("a"), best.alias("x")).select(
        "lang", "phrase", "words", "a", "x.l", "x.r", "x.score")


def absorbed(phrases: DataFrame, percent: int = ABSORBED) -> DataFrame:
    """lang, phrase of those whose words lie in a longer phrase with at least `percent` hundredths of their occurrences."""
    pieces = F.split(F.col("phrase").cast("string"), " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(
        F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: F.array_join(F.slice(pieces, i, n), " ").cast("binary"))))
    around = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("f"))
    around = around.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    return phrases.join(around, ["lang", "phrase"]).where(
        F.col("f").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * percent).select("lang", "phrase")


def _best(rows: DataFrame, by: list[str], order: list[Column], most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(docs: DataFrame, support: int = 30, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `most` phrases by score descending, a descending, phrase.

    Ranked in RANK_PARTS parts per language first, so that one task gets at most RANK_PARTS * most rows of a language."""
    words, phrases = frequent_phrases(docs, support, text, lang)
    rows = scored(words, phrases).join(absorbed(phrases), ["lang", "phrase"], "left_anti")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rows = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    rows = _best(_best(rows, ["lang", "part"], order, most), ["lang"], order, most)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return rows.join(totals, "lang").select("lang", "rank", F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")
