"""Relational operators: result merging, set operations, membership, fingerprints, nearest rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..session import cut_lineage
from . import ranks
from .prior import present


def merge_results(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of result tables; for each key the rows of the last table that has it win."""
    tagged = [p.withColumn("_file", F.lit(i)) for i, p in enumerate(parts)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    latest = both.groupBy(*keys).agg(F.max("_file").alias("_last"))
    return (
        both.join(latest, list(keys)).where(F.col("_file") == F.col("_last")).drop("_file", "_last")
    )


def filter_models(df: DataFrame, model: str, allow: Sequence[str]) -> DataFrame:
    """Distinct models that are on the allow list, sorted; all models for an empty list."""
    names = df.select(model).distinct()
    return (names.where(F.col(model).isin(list(allow))) if allow else names).orderBy(model)


def replace_strings(df: DataFrame, fn) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({c: fn(c) for c in text})


def unpack_none_sentinel(df: DataFrame) -> DataFrame:
    return replace_strings(df, S.unpack_none)


def pack_none_sentinel(df: DataFrame) -> DataFrame:
    return replace_strings(df, S.pack_none)


def config_fingerprint(*cols: str) -> Column:
    """md5 of the key-sorted JSON of the columns, nulls kept out as JSON does."""
    return F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)])))


def state_left_join(df: DataFrame, state: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Attach per-key state; keys without state get the defaults."""
    out = df.join(state, list(keys), "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def seen(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), list(keys), "left_semi")


def unseen(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), list(keys), "left_anti")


def grid(df: DataFrame, **values) -> DataFrame:
    """Every row once per combination of the given lists; a chain of explodes, no join."""
    for name, items in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in items])))
    return df


def first_rows(df: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def intersect_models(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def _position(df: DataFrame, column: str) -> Column:
    """Where a value stands, as a number: days of a date, seconds of a timestamp, the value itself otherwise."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "date":
        return F.unix_date(column).cast("double")
    return (F.unix_micros(column) / F.lit(1e6)) if kind == "timestamp" else F.col(column).cast("double")


def nearest_join(left: DataFrame, right: DataFrame, on: tuple[str, str], keys: Sequence[tuple[str, str]], take: dict[str, str],
                 direction: str = "nearest", tolerance: float | None = None, ties: Sequence[str] = (), rows_per_range: int = 200_000) -> DataFrame:
    """Every row of left with columns (take: name -> column of right) of the row of right that has the same keys and the nearest value.

    on, keys: (left column, right column). direction: `backward` (values up to the own), `forward` (from the own on) or
    `nearest`, where the lower of two equally near ones counts. tolerance: largest distance, in days for dates and seconds for
    timestamps. Of right rows with equal keys and value the one with the largest `ties` counts. Missing keys are keys like any
    other; a missing value meets nothing; rows without a partner get nulls.

    Both sides are asked once per key and value. A key with more than rows_per_range rows is cut into value ranges, so that it is
    spread over tasks; what a range does not hold itself comes from the edges of the ranges beside it. All others stay whole."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    names = [f"_k{i}" for i in range(len(keys))]
    mine = left.withColumns({n: present(k) for n, (k, _) in zip(names, keys)}).withColumn("_x", _position(left, on[0]))
    theirs = right.withColumns({n: present(k) for n, (_, k) in zip(names, keys)}).withColumn("_x", _position(right, on[1]))
    payload = F.struct(*(F.col(c).alias(f"_t{i}") for i, c in enumerate(take.values())))
    order = F.struct(*ties) if ties else payload
    marks = theirs.where(F.col("_x").isNotNull()).groupBy(*names, "_x").agg(F.max_by(payload, order).alias("_p"))
    asked = mine.where(F.col("_x").isNotNull()).select(*names, "_x").distinct()
    marks = marks.withColumn("_m", F.struct("_x", "_p")).drop("_p")
    both = marks.withColumn("_ask", F.lit(False)).unionByName(asked.withColumn("_ask", F.lit(True)), allowMissingColumns=True)

    def beside(rows: DataFrame, chunk: list[str]) -> DataFrame:
        up = Window.partitionBy(*chunk).orderBy("_x").rangeBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*chunk).orderBy(F.desc("_x")).rangeBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("_low", F.max("_m").over(up)).withColumn("_high", F.min("_m").over(down)).where("_ask")

    def cut(rows: DataFrame) -> DataFrame:
        rows = ranks.with_range(rows, "_x", ranks.value_bounds(rows.select("_x"), "_x", rows_per_range))
        chunk = [*names, "_range"]
        edges = rows.groupBy(*chunk).agg(F.max("_m").alias("_top"), F.min("_m").alias("_bottom"))
        across = Window.partitionBy(*names).orderBy("_range")
        edges = edges.select(*chunk, F.max("_top").over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_left"),
                             F.min("_bottom").over(Window.partitionBy(*names).orderBy(F.desc("_range")).rowsBetween(
                                 Window.unboundedPreceding, -1)).alias("_right"))
        return beside(rows, chunk).join(edges, chunk).withColumns(
            {"_low": F.coalesce("_low", "_left"), "_high": F.coalesce("_high", "_right")})

    if not names:
        found = cut(both)
    else:
        sizes = mine.select(*names).unionByName(theirs.select(*names)).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
        large = cut_lineage(sizes.where(F.col("_n") > rows_per_range).select(*names), "large-keys")  # each holds that many rows: few
        found = beside(both, names)
        if not large.isEmpty():
            kept = [*names, "_x", "_low", "_high"]
            found = beside(both.join(large, names, "left_anti"), names).select(*kept).unionByName(
                cut(both.join(large, names, "left_semi")).select(*kept))
    low, high = F.col("_low"), F.col("_high")
    before, after = F.col("_x") - low["_x"], high["_x"] - F.col("_x")
    best = {"backward": low, "forward": high,
            "nearest": F.when(low.isNull() | (after < before), high).otherwise(low)}[direction]
    found = found.select(*names, "_x", best.alias("_best"))
    if tolerance is not None:
        found = found.where(F.abs(F.col("_best._x") - F.col("_x")) <= tolerance)
    out = mine.join(found, [*names, "_x"], "left")
    return out.select(*left.columns, *(F.col(f"_best._p._t{i}").alias(c) for i, c in enumerate(take)))
