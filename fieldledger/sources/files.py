"""Readers and writers."""

from __future__ import annotations

import io
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

TRANSACTION_SCHEMA = (
    "bank_account_uuid string, business_partner_name string, date_post string, amount double, currency string, "
    "ref_name string, ref_iban string, ref_swift string, ref_bank string, paym_note string, trns_type string, "
    "pay_method string, channel string, anomaly_description string"
)
TRANSACTION_COLUMNS = [c.split()[0] for c in TRANSACTION_SCHEMA.split(", ")]


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first path that exists, on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def read_transactions(spark: SparkSession, *paths: str) -> DataFrame:
    """Transactions from the first path that exists. Dates are yyyyMMdd. Columns are found by the names in the
    header, in whatever order; only the header is read to learn them. A missing column is an error."""
    raw = spark.read.csv(first_existing(spark, paths), header=True)
    kinds = dict(c.split() for c in TRANSACTION_SCHEMA.split(", "))
    raw = raw.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    return raw.withColumn("date_post", F.to_date("date_post", "yyyyMMdd"))


def date_range(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> str:
    """Fixed column order, with a header. Directory of part files, written in parallel."""
    df.select(*columns).write.csv(path, header=True)
    return path


def ingest_npz(spark: SparkSession, path: str) -> DataFrame:
    """row_id, features, label from numpy archives with X and y, one archive per task.

    Rows come in Arrow batches. Many archives are read in parallel; write the result once as
    parquet and read that afterwards."""
    def load(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x, y = z["X"].astype("float64"), z["y"].astype("int64")
                for start in range(0, len(x), 10_000):
                    part = x[start:start + 10_000]
                    yield pd.DataFrame({
                        "source": name, "row_id": range(start, start + len(part)),
                        "features": list(part), "label": y[start:start + 10_000]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(load, "source string, row_id long, features array<double>, label long")


def write_split_dataset(df: DataFrame, path: str) -> str:
    """One directory per split, so that a filter on split reads only its files."""
    df.write.partitionBy("split").parquet(path)
    return path


def read_split_dataset(spark: SparkSession, path: str, parts: Sequence[str] | None = None) -> DataFrame:
    """All splits that are present, or those named."""
    df = spark.read.parquet(path)
    return df.where(F.col("split").isin(list(parts))) if parts else df


def read_csv_roles(spark: SparkSession, paths: dict[str, str], cat: Sequence[str], target: str) -> DataFrame:
    """One CSV per split; categorical columns as text, the other features and the target as double."""
    out = None
    for split, path in paths.items():
        raw = spark.read.csv(path, header=True)
        cols = [
            F.col(c).cast("string" if c in cat and c != target else "double").alias(c) for c in raw.columns
        ]
        part = raw.select(*cols, F.lit(split).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


def dataset_info(df: DataFrame, n_features: int) -> DataFrame:
    """part, size for each split and for all of them, with the feature count."""
    sizes = df.rollup("split").agg(F.count(F.lit(1)).alias("size"))
    return sizes.select(F.coalesce("split", F.lit("all")).alias("part"), "size", F.lit(n_features).alias("n_features"))


def write_results(df: DataFrame, path: str) -> str:
    """Full result set, one directory per data set, model and score."""
    df.write.partitionBy("dataset", "model", "score").parquet(path)
    return path


def read_results(spark: SparkSession, paths: Sequence[str]) -> list[DataFrame]:
    """The result tables that exist; missing ones are skipped. A table that cannot be read is an error."""
    found = []
    for p in paths:
        try:
            found.append(spark.read.parquet(p))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return found


def write_report(df: DataFrame, path: str, kind: str) -> str:
    """kind: json for reports and metrics, parquet for predictions."""
    getattr(df.write, kind)(path)
    return path


def read_report(spark: SparkSession, path: str, kind: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return getattr(reader, kind)(path)
