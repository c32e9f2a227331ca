"""Numpy archives (X, y) as a data source: spark.read.format("npz").

An archive is a zip file of arrays. Arrays that are stored as they are (numpy.savez) are planned in ranges of rows, and a
task reads only the bytes of its rows; compressed ones (savez_compressed) can only be read from the start, so each is one
task. Files are found and read through Arrow's file systems, wherever the path leads; the driver reads headers only.

Options: path (an archive or a folder of them), rows (rows of a range at most), columns (any of source, row_id, features,
label; an array whose column is not asked for is not read).
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = {"source": "string", "row_id": "long", "features": "array<double>", "label": "long"}
ROWS = 1_000_000
#: Rows of a record batch.
BATCH = 10_000


@dataclass(frozen=True)
class Member:
    """An array inside an archive: where its numbers begin (-1: compressed), their type and shape."""

    name: str
    offset: int
    kind: str
    shape: tuple[int, ...]


@dataclass
class Rows(InputPartition):
    path: str
    first: int
    last: int
    members: tuple[Member, ...]


def opened(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (files.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The archives at a path, sorted."""
    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == files.FileType.File:
        return [path]
    found = system.get_file_info(files.FileSelector(inner, recursive=True))
    head = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(head + f.path for f in found if f.type == files.FileType.File and f.path.endswith(".npz"))


def members(path: str) -> dict[str, Member]:
    """The arrays of an archive, from its directory and their headers."""
    system, inner = opened(path)
    out = {}
    with system.open_input_file(inner) as raw, zipfile.ZipFile(raw) as z:
        for entry in z.infolist():
            with z.open(entry) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                header = f.tell()
            if kind.hasobject:
                raise ValueError(f"{entry.filename} in {path} holds objects")
            offset = -1
            if entry.compress_type == zipfile.ZIP_STORED and not (fortran and len(shape) > 1):
                raw.seek(entry.header_offset + 26)
                name, extra = struct.unpack("<HH", raw.read(4))
                offset = entry.header_offset + 30 + name + extra + header
            out[entry.filename.removesuffix(".npy")] = Member(entry.filename, offset, kind.str, tuple(shape))
    return out


def rows_of(path: str, member: Member, first: int, last: int) -> np.ndarray:
    """Rows first .. last - 1 of an array."""
    system, inner = opened(path)
    kind, width = np.dtype(member.kind), int(np.prod(member.shape[1:], dtype=np.int64))
    with system.open_input_file(inner) as raw:
        if member.offset < 0:
            with zipfile.ZipFile(raw) as z, z.open(member.name) as f:
                return np.load(io.BytesIO(f.read()), allow_pickle=False)[first:last]
        raw.seek(member.offset + first * width * kind.itemsize)
        data = raw.read((last - first) * width * kind.itemsize)
    return np.frombuffer(data, kind).reshape(last - first, *member.shape[1:])


class NpzReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path, self.rows = schema.names, options["path"], int(options.get("rows", ROWS))

    def partitions(self) -> list[Rows]:
        out = []
        for path in archives(self.path):
            found = members(path)
            if "X" not in found or "y" not in found or found["X"].shape[:1] != found["y"].shape[:1]:
                raise ValueError(f"{path} has no arrays X and y of one length")
            kept = tuple(found[n] for n in ("X", "y"))
            total = kept[0].shape[0]
            step = total if any(m.offset < 0 for m in kept) else self.rows
            out += [Rows(path, i, min(i + step, total), kept) for i in range(0, total, max(1, step))]
        return out or [Rows("", 0, 0, ())]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        x_at, y_at = partition.members or (None, None)
        whole = x_at is not None and min(x_at.offset, y_at.offset) < 0  # read once, not once per batch
        step = partition.last - partition.first if whole else BATCH
        for i in range(partition.first, partition.last, max(1, step)):
            last = min(i + step, partition.last)
            made = {}
            if "features" in self.names:
                made["features"] = rows_of(partition.path, x_at, i, last).astype("float64").reshape(last - i, -1)
            if "label" in self.names:
                made["label"] = rows_of(partition.path, y_at, i, last).astype("int64")
            for a in range(0, last - i, BATCH):
                b = min(a + BATCH, last - i)
                yield pa.RecordBatch.from_arrays([self._column(n, made, partition, i, a, b) for n in self.names], names=self.names)

    def _column(self, name: str, made: dict, partition: Rows, first: int, a: int, b: int) -> pa.Array:
        if name == "source":
            return pa.array([partition.path] * (b - a), pa.string())
        if name == "row_id":
            return pa.array(np.arange(first + a, first + b))
        if name == "label":
            return pa.array(made["label"][a:b])
        part = made["features"][a:b]
        ends = np.arange(0, part.size + 1, part.shape[1], dtype=np.int32) if part.shape[1] else np.zeros(b - a + 1, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(part).ravel()))


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        names = [c.strip() for c in self.options.get("columns", ",".join(SCHEMA)).split(",")]
        if unknown := set(names) - set(SCHEMA):
            raise ValueError(f"unknown columns {sorted(unknown)}")
        return ", ".join(f"{n} {SCHEMA[n]}" for n in names)

    def reader(self, schema: StructType) -> NpzReader:
        return NpzReader(schema, dict(self.options))


def scan_npz(spark: SparkSession, path: str, columns: tuple[str, ...] = tuple(SCHEMA), rows: int = ROWS) -> DataFrame:
    """The rows of numpy archives with X and y, in ranges of at most `rows` rows per task."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("columns", ",".join(columns)).option("rows", rows).load(path)


def write_npz(df: DataFrame, path: str, features: str, label: str) -> DataFrame:
    """One archive per partition of df below path; returns the names and row counts. A task that runs again writes its file anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = pa.Table.from_batches(list(batches)) if batches else None
        if whole is None or not whole.num_rows:
            return
        x = np.array(whole.column(features).to_pylist(), float)
        name = f"{path.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.npz"
        held = io.BytesIO()
        np.savez(held, X=x, y=whole.column(label).to_numpy().astype("int64"))
        system, inner = opened(name)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as f:
            f.write(held.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(x)])], names=["source", "n"])

    return df.select(features, label).mapInArrow(run, "source string, n long")
