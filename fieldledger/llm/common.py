"""What several operators share: tables, folds, written stages, Arrow slices, word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..session import cut_lineage, release  # noqa: F401

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def written(df: DataFrame, name: str) -> DataFrame:
    """df from a table in the shared folder: computed once, safe against lost executors."""
    return cut_lineage(df, f"llm-{name}")


def apart(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled, never sent whole to the driver and all tasks. Spark sizes a table by its compressed
    files, and what tasks make of its rows by the rows they get, so it would broadcast what is many times as large in memory."""
    return df.hint("merge")


def with_fields(schema: StructType, fields: str) -> StructType:
    """A new schema with more fields, given as "name type, ..."; the schema itself stays as it is."""
    return StructType(schema.fields + StructType.fromDDL(fields).fields)


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows that hold about `limit` bytes of `column`, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


#: Up to so many integer keys (16 MB) are sent to the rows instead of the rows to the keys.
FEW_KEYS = 2_000_000


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in keys, a written table of one column. Long rows stay where they are while the keys
    are few enough to be broadcast, which is checked; beyond that both sides are shuffled."""
    integral = keys.schema[key].dataType.simpleString() in ("int", "bigint")
    few = integral and keys.count() <= FEW_KEYS
    return rows.join(F.broadcast(keys) if few else keys, key, "left_semi")


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds `most` words, so a task's memory stays bounded."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose output bits depend on all input bits (splitmix64's last step)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
