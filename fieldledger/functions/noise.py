"""Seeded noise that is a function of the row key, not of task or partition.

A retried task, another partition count or another engine gives the same numbers. A row takes
one digest of its key; every (slot, dimension) of the row then comes from integer arithmetic
on it: a counter with a fixed stride through a 32-bit mixing function, twice per normal. That
stays in generated code, and runs vectorized where a task works on Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: multiplier of the mixing function, counter stride, dimensions per slot
MIX, STRIDE, SLOT = 0x45D9F3B, 0x1E3779B9, 65536
MASK, TWO_32, TWO_52 = 0xFFFFFFFF, float(2**32), float(2**52)


def let(value: Column, body) -> Column:
    """Bind value once inside an expression."""
    return F.transform(F.array(value), body)[0]


def noise_key(*parts) -> Column:
    return F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def _hex(digest: Column, start: int, digits: int) -> Column:
    return F.conv(F.substring(digest, start, digits), 16, 10)


def hash_uniform(key: Column) -> Column:
    """Uniform on [0, 1) from the first 52 bits of md5(key)."""
    return _hex(F.md5(key), 1, 13).cast("double") / F.lit(TWO_52)


def words(*parts) -> Column:
    """The row's start value: the first two 32-bit words of the md5 of the parts."""
    def split(h: Column) -> Column:
        return F.struct(_hex(h, 1, 8).cast("long").alias("a"), _hex(h, 9, 8).cast("long").alias("b"))

    return let(F.md5(noise_key(*parts)), split)


def _mix(x: Column) -> Column:
    def turn(v: Column) -> Column:
        return F.shiftright(v, 16).bitwiseXOR(v)

    x = (turn(x) * F.lit(MIX)).bitwiseAND(F.lit(MASK))
    x = (turn(x) * F.lit(MIX)).bitwiseAND(F.lit(MASK))
    return turn(x)


def hash_normal(word: Column, slot: Column, d: Column) -> Column:
    """Standard normal of one (slot, dimension) of a row, by Box-Muller."""
    count = (slot.cast("long") * F.lit(SLOT) + d.cast("long") + F.lit(1)) * F.lit(STRIDE)

    def uniform(w: Column) -> Column:
        return _mix((w + count).bitwiseAND(F.lit(MASK))).cast("double")

    return F.sqrt(F.lit(-2.0) * F.log((uniform(word["a"]) + F.lit(0.5)) / F.lit(TWO_32))) * F.cos(
        F.lit(2.0) * F.pi() * (uniform(word["b"]) / F.lit(TWO_32)))


def normal_vector(size: Column, word: Column, slot) -> Column:
    """array<double> of iid normals for one slot of the row. A row wider than a slot is an error."""
    at = slot if isinstance(slot, Column) else F.lit(slot)
    size = F.when(size <= SLOT, size).otherwise(F.raise_error(F.lit(f"noise has {SLOT} dimensions per row at most")).cast("int"))
    return let(word, lambda w: F.transform(F.sequence(F.lit(0), size - 1), lambda d: hash_normal(w, at, d)))


def normal_replicates(size: Column, copies: int, word: Column) -> Column:
    """array<array<double>>: one normal vector for each of the copies."""
    return let(word, lambda w: F.transform(
        F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: normal_vector(size, w, k)))


def normals(a, b, slots: int, dims: int, first: int = 0):
    """numpy form of hash_normal: a, b arrays of words; returns [rows, slots, dims], slots counted from `first`."""
    import numpy as np

    if dims > SLOT or first + slots > SLOT:
        raise ValueError(f"noise has {SLOT} slots of {SLOT} dimensions per row at most")

    def uniform(w):
        x = (w.astype(np.uint64)[:, None, None] + count) & np.uint64(MASK)
        for _ in range(2):
            x = (((x >> np.uint64(16)) ^ x) * np.uint64(MIX)) & np.uint64(MASK)
        return ((x >> np.uint64(16)) ^ x).astype(np.float64)

    at = np.arange(first, first + slots, dtype=np.uint64)[:, None] * np.uint64(SLOT) + np.arange(dims, dtype=np.uint64)[None, :]
    count = ((at + np.uint64(1)) * np.uint64(STRIDE))[None]
    radius = np.sqrt(-2.0 * np.log((uniform(a) + 0.5) / TWO_32))
    return radius * np.cos(2.0 * np.pi * (uniform(b) / TWO_32))
