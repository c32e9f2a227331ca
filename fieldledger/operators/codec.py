"""Typed columns as the numbers of a field, and back.

A column is numeric, integer, binary (two whole numbers) or categorical. Categories become one 0/1 number for each value but the
first; back, the largest of these wins if it is above 0.5, else the first value does. Integers and binaries come back
rounded, all numbers clamped to the training range. Inside a field a row is compared in these units: a category counts as the
place of its value in the sorted vocabulary. A missing value makes all numbers of its column missing, and so does a
value that the vocabulary does not hold."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

KINDS = ("numeric", "integer", "binary", "categorical")


@dataclass(frozen=True)
class Codec:
    """names, kinds and, for categories, the sorted values of the columns in order."""

    names: tuple[str, ...]
    kinds: tuple[str, ...]
    values: tuple[tuple[str, ...], ...]

    #: A vocabulary is part of the model and sent with it: more values than these are an error, not cut off.
    MOST_VALUES = 4096

    def __post_init__(self):
        if not len(self.names) == len(self.kinds) == len(self.values):
            raise ValueError("names, kinds and values do not match")
        for name, kind, values in zip(self.names, self.kinds, self.values):
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind}")
            if kind == "categorical" and not 1 <= len(values) <= self.MOST_VALUES:
                raise ValueError(f"{name} has {len(values)} values; 1 to {self.MOST_VALUES} can be coded")

    @staticmethod
    def of(train: DataFrame, columns: Sequence[tuple[str, str]]) -> Codec:
        """The codec of (name, kind) columns, with the vocabularies of the training rows; one aggregation for all."""
        for _, kind in columns:
            if kind not in KINDS:
                raise ValueError(f"unknown kind {kind}")
        cats = [c for c, kind in columns if kind == "categorical"]
        found = {}
        if cats:
            long = train.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cats))).alias("e"))
            distinct = long.select("e.c", "e.v").where("v is not null").distinct()
            for r in distinct.limit(len(cats) * (Codec.MOST_VALUES + 1)).collect():
                found.setdefault(r["c"], []).append(r["v"])
        return Codec(tuple(c for c, _ in columns), tuple(k for _, k in columns),
                     tuple(tuple(sorted(found.get(c, ()), key=str.encode)) if k == "categorical" else () for c, k in columns))

    @property
    def places(self) -> list[tuple[int, int]]:
        """(first, number) of the numbers of every column."""
        out, at = [], 0
        for kind, values in zip(self.kinds, self.values):
            size = len(values) - 1 if kind == "categorical" else 1
            out.append((at, size))
            at += size
        return out

    def encode(self, df: DataFrame, out: str = "features") -> DataFrame:
        """df with the numbers of its columns in one array."""
        missing, parts = F.lit(float("nan")), []
        for name, kind, values in zip(self.names, self.kinds, self.values):
            if kind != "categorical":
                parts.append(F.coalesce(F.col(name).cast("double"), missing))
                continue
            text, known = F.col(name).cast("string"), F.array(*(F.lit(v) for v in values))
            at = F.array_position(known, text)
            parts += [F.when(F.coalesce(at, F.lit(0)) == 0, missing).otherwise((at == i + 2).cast("double")) for i in range(len(values) - 1)]
        return df.withColumn(out, F.array(*parts) if parts else F.array().cast("array<double>"))

    def decode(self, x: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
        """[..., numbers] -> [..., columns]; rounded and, where a range is given, clamped to it. Missing stays missing."""
        out = []
        for kind, (first, size) in zip(self.kinds, self.places):
            part = x[..., first:first + size]
            if kind == "categorical":
                code = np.concatenate([np.full((*part.shape[:-1], 1), 0.5), np.nan_to_num(part, nan=-np.inf)], axis=-1).argmax(axis=-1).astype(float)
                out.append(np.where(np.isnan(part).any(axis=-1), np.nan, code))
                continue
            value = part[..., 0] if kind == "numeric" else np.rint(part[..., 0])
            out.append(value if low is None else np.clip(value, low[first], high[first]))
        return np.stack(out, axis=-1)

    def to_columns(self, df: DataFrame, decoded: str) -> DataFrame:
        """df with the columns from an array of decoded numbers; categories as their values, integers as whole numbers."""
        made = {}
        for i, (name, kind, values) in enumerate(zip(self.names, self.kinds, self.values)):
            number = F.when(~F.isnan(F.col(decoded)[i]), F.col(decoded)[i])
            if kind == "categorical":
                made[name] = F.try_element_at(F.array(*(F.lit(v) for v in values)), number.cast("int") + 1)
            else:
                made[name] = number if kind == "numeric" else number.cast("long")
        return df.withColumns(made)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Codec:
        d = json.loads(text)
        return Codec(tuple(d["names"]), tuple(d["kinds"]), tuple(tuple(v) for v in d["values"]))
