"""Bindings of the shared parquet tables to the shapes the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.prior import TransactionColumns
from ..session import spread

TX = TransactionColumns(
    account="bank_account_uuid",
    name="ref_name",
    iban="ref_iban",
    swift="ref_swift",
    method="pay_method",
    channel="channel",
    date="date_post",
    amount="amount",
    ties=("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"),
)
TX_KEY = ["date_post", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "amount"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def transactions(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem joined to part, read as payments; ordered by TX_KEY, which is unique."""
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_shipdate").cast("date").alias("date_post"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_extendedprice").alias("amount"),
        F.col("l_suppkey").cast("string").alias("bank_account_uuid"),
        F.col("p_brand").alias("ref_name"),
        F.col("p_type").alias("ref_iban"),
        (F.col("p_size") % 4).cast("string").alias("ref_swift"),
        F.when(F.col("l_returnflag") == "A", "ACH").when(F.col("l_returnflag") == "N", "CARD")
        .otherwise("WIRE").alias("pay_method"),
        F.when(F.col("l_linestatus") == "F", "MOBILE_APP").otherwise("API").alias("channel"),
        F.when(F.col("l_quantity") >= 50, "AMOUNT_ANOMALY: quantity")
        .when((F.col("l_discount") >= 0.1) & (F.col("l_tax") == 0), "CHANNEL_ANOMALY: discount")
        .alias("anomaly_description"),
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """row_id, features array<double>, label (1 = anomaly), class (0..9)."""
    return spread(table(spark, sf, "embeddings")).select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") == 9).cast("int").alias("label"),
        F.col("label").cast("int").alias("class"),
    )


def line_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Four numeric columns of lineitem as features, with a text row key."""
    return spread(table(spark, sf, "lineitem")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.date_format("l_shipdate", "yyyyMMdd")).alias("row_id"),
        F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax").alias("features"),
        (F.col("l_quantity") >= 50).cast("int").alias("label"),
    )


def categorical(spark: SparkSession, sf: str) -> DataFrame:
    """Three text columns of orders and customer, with the missing-value sentinel put in."""
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 17 == 0, "nan").otherwise(F.col("o_orderstatus")).alias("c0"),
        F.col("o_orderpriority").alias("c1"),
        F.col("c_mktsegment").alias("c2"),
        F.col("o_totalprice").alias("y"),
        F.when(F.col("o_orderkey") % 10 < 6, "train").when(F.col("o_orderkey") % 10 < 8, "val")
        .otherwise("test").alias("split"),
    )


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """labels joined to documents: truth, and a score from the document length."""
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return lab.join(doc, "doc_id").select(
        "doc_id", "lang", "source",
        F.col("quality").cast("int").alias("truth"),
        F.col("toxic").cast("int").alias("toxic"),
        (F.col("n_chars") / F.lit(1000.0)).alias("score"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")
