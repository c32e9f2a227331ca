"""Concatenate and cut: documents as one token stream, cut into windows of fixed length.

Pass 1 tokenizes each partition once, writes ids with their start inside the partition to the shared
folder, and sums tokens per partition. Prefix sums of these totals give every partition its global
offset; pass 2 cuts each document at the multiples of the window, which needs no neighbour. Only the
last window can have padding.

Null texts count as empty; an empty text is the separator alone. Rows with equal ids are packed one by
one. Columns of the input other than the key are not carried on; join them by the key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, written

SEPARATOR = 0
WINDOW = 1024

_ENCODERS: dict = {}


def encoder(path: str):
    """The byte-level BPE of `path`, once per worker. The file next to it holds the same vocabulary as ranks,
    which tiktoken encodes to the same ids about five times as fast; without it the tokenizer's own file is used."""
    import base64
    import os

    if path not in _ENCODERS:
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks_path):
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                    special_tokens={"<|endoftext|>": len(ranks)})
            _ENCODERS[path] = lambda texts: [own.encode(t, allowed_special="all") for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _ENCODERS[path] = lambda texts: [
                e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenize(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, part, start (tokens before it in its partition), n, ids (16-bit little-endian, separator included)."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for rows in slices(batch, "text"):
                packed, counts = [], []
                for text in rows.column("text").to_pylist():
                    ids = encode([text])[0] if text else []
                    packed.append(np.array([*ids, SEPARATOR], "<u2").tobytes())
                    counts.append(len(ids) + 1)
                ends = start + np.cumsum(np.array(counts, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(np.full(len(counts), part), pa.int64()),
                     pa.array(ends - counts), pa.array(counts, pa.int64()), pa.array(packed, pa.binary())],
                    names=["doc_id", "part", "start", "n", "ids"])
                start = int(ends[-1])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, part long, start long, n long, ids binary")


def global_starts(tokens: DataFrame) -> DataFrame:
    """tokens with `start` in the whole stream: one total per partition, prefix sums over the totals."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    return tokens.join(F.broadcast(bases), "part").withColumn("start", F.col("start") + F.col("base")).drop("part", "base")


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Boundary records: per piece its document, place, length, sequence, and its ids (32-bit little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "ids", 1 << 20):
                begin = rows.column("start").to_numpy(zero_copy_only=False)
                count = rows.column("n").to_numpy(zero_copy_only=False)
                first, last = begin // window, (begin + count - 1) // window
                pieces = last - first + 1
                row = np.repeat(np.arange(len(count)), pieces)
                ahead = np.cumsum(pieces) - pieces
                sequence = first[row] + np.arange(len(row)) - ahead[row]
                left = np.maximum(sequence * window, begin[row])
                right = np.minimum((sequence + 1) * window, (begin + count)[row])
                ids = [np.frombuffer(x, "<u2").astype("<u4") for x in rows.column("ids").to_pylist()]
                cuts = [ids[r][a:b].tobytes() for r, a, b in zip(row, left - begin[row], right - begin[row])]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id").take(pa.array(row)), pa.array(left - begin[row]), pa.array(right - left),
                     pa.array(count[row]), pa.array(sequence), pa.array(left - sequence * window),
                     pa.array(cuts, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "start", "n", "ids").mapInArrow(
        run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def padded_length(total: int, window: int = WINDOW) -> int:
    """Length of a sequence with `total` ids after padding: a power of two stays, all else goes to the window."""
    return total if total & (total - 1) == 0 else window


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """All pieces of all documents. Sequences are the windows of one stream: offsets are gapless."""
    tokens = written(tokenize(docs, tokenizer or default_tokenizer(), key, text), "tokens")
    return cut(global_starts(tokens), window)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 (unsigned, over 32-bit little-endian ids) in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")
