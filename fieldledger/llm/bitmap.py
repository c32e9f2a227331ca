"""Sets of 64-bit keys as a bitmap of fixed size: a filter that never misses a key, whatever their number.

A key holds bit `key mod 2^bits`. Tasks build the bitmap with Spark's bitmap aggregate, so the driver gets at most
2^bits / 8 bytes; this size is the bound of the broadcast. The more keys, the more others pass too: users of the filter
decide by something exact behind it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

#: Bits of one piece of the bitmap aggregate: a fixed value of Spark.
PIECE = 8 * 4096


def bitmap(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """The bitmap (uint8) of a long column, of at least one piece. Null keys are not in it; no rows give an empty one."""
    bits = max(bits, PIECE.bit_length() - 1)
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + 1
    pieces = keys.where(F.col(key).isNotNull()).groupBy(F.bitmap_bucket_number(slot).alias("piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).toArrow()
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for piece, bits_of in zip(pieces.column("piece").to_pylist(), pieces.column("bits").to_pylist()):
        start = (piece - 1) * PIECE // 8
        whole[start:start + PIECE // 8] = np.frombuffer(bits_of, np.uint8)
    return whole


def has(whole: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (uint64) may be in the bitmap; false only for keys that are not."""
    slot = keys & np.uint64(len(whole) * 8 - 1)
    return (whole[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 != 0
