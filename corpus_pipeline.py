"""Corpus pipeline: language, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
rows with the columns of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fieldledger.llm import minhash_join, packing, quality_rules, string_kernel
from fieldledger.llm.common import fold, having, written

#: The language kernel, the shingle join and the tokenizer have no SQL form; tests/llm compares stages with plain versions.
ORACLE_SQL = None

#: A document whose best language scores less is in none of the languages known.
LEAST_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts that are null, without a letter, or like no language go."""
    model = string_kernel.train(docs, fold(F.col("doc_id"), 4) != 2)
    rows = string_kernel.predict(docs, model)
    return rows.where((F.col("lang_pred") != string_kernel.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of policy 2."""
    return quality_rules.ledger(docs).where(~quality_rules.fails("2")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest key.

    Rows are told apart by key and text. Equal rows count as one document; different texts under one key stay or go together, and
    stay if any of them is the one of its group. Rows without a key take part in links and are all kept: nothing names the one to keep."""
    kept = minhash_join.near_duplicates(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = written(kept, "kept")
    once = having(docs, kept.where("n = 1").select("doc_id"), "doc_id")
    repeated = having(docs, kept.where("n > 1").select("doc_id"), "doc_id").dropDuplicates(["doc_id", "text"])
    return once.union(repeated).union(docs.where("doc_id is null")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with a digest of their ids."""
    return packing.digests(packing.pack(docs))


STAGES = [("language", language), ("quality_rules", quality), ("near_duplicates", near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents; every stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
