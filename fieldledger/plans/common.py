"""Shared pieces of the registered queries and of their check SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def row_key(date: str = "date_post") -> Column:
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                       F.date_format(date, "yyyyMMdd"))


def shape(df: DataFrame, strings: Sequence[str] = (), ints: Sequence[str] = (),
          floats: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Output columns with fixed types; floats rounded."""
    # adding 0.0 turns a negative zero into zero
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in strings],
        *[F.col(c).cast("long").alias(c) for c in ints],
        *[(F.round(F.col(c).cast("double"), digits) + F.lit(0.0)).alias(c) for c in floats],
    )


def txt(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS VARCHAR) AS {name or expr}"


def num(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def flt(expr: str, name: str | None = None, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0::DOUBLE AS {name or expr}"


KEY_SQL = ("concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, "
           "strftime(date_post, '%Y%m%d'))")

LINE_KEY_SQL = KEY_SQL.replace("date_post", "l_shipdate")

TX_SQL = """tx AS (
  SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
                            l_extendedprice) AS tx_id,
    CAST(l_shipdate AS DATE) AS date_post, l_orderkey, l_linenumber, l_partkey, l_suppkey,
    l_extendedprice AS amount, CAST(l_suppkey AS VARCHAR) AS bank_account_uuid,
    p_brand AS ref_name, p_type AS ref_iban, CAST(p_size % 4 AS VARCHAR) AS ref_swift,
    CASE l_returnflag WHEN 'A' THEN 'ACH' WHEN 'N' THEN 'CARD' ELSE 'WIRE' END AS pay_method,
    CASE l_linestatus WHEN 'F' THEN 'MOBILE_APP' ELSE 'API' END AS channel,
    CASE WHEN l_quantity >= 50 THEN 'AMOUNT_ANOMALY: quantity'
         WHEN l_discount >= 0.1 AND l_tax = 0 THEN 'CHANNEL_ANOMALY: discount' END AS anomaly_description
  FROM lineitem JOIN part ON l_partkey = p_partkey),
cut AS (SELECT date_post AS cutoff FROM tx
        WHERE tx_id = (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) + 1 FROM tx))"""

# every strictly-prior feature as plain windows over the total order tx_id
FEATURES_SQL = TX_SQL + """,
base AS (
  SELECT *, date_post > (SELECT cutoff FROM cut) AS late,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name ORDER BY tx_id) AS pos
  FROM tx),
counted AS (
  SELECT *,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name, ref_iban ORDER BY tx_id) AS ci,
    min(pos) OVER (PARTITION BY bank_account_uuid, ref_name, ref_iban) AS fi,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name, ref_swift ORDER BY tx_id) AS cs,
    min(pos) OVER (PARTITION BY bank_account_uuid, ref_name, ref_swift) AS fs,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name, pay_method ORDER BY tx_id) AS cm,
    min(pos) OVER (PARTITION BY bank_account_uuid, ref_name, pay_method) AS fm,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name, channel ORDER BY tx_id) AS cc,
    min(pos) OVER (PARTITION BY bank_account_uuid, ref_name, channel) AS fc
  FROM base),
prior AS (
  SELECT *,
    count(*) OVER p AS n, avg(amount) OVER p AS mean, stddev_pop(amount) OVER p AS sd,
    min(amount) OVER p AS lo, max(amount) OVER p AS hi,
    quantile_cont(day(date_post), 0.5) OVER p AS usual_day,
    (max({'c': ci, 'f': -fi, 'v': ref_iban}) OVER p).v AS usual_iban,
    (max({'c': cs, 'f': -fs, 'v': ref_swift}) OVER p).v AS usual_swift,
    (max({'c': cm, 'f': -fm, 'v': pay_method}) OVER p).v AS usual_method,
    (max({'c': cc, 'f': -fc, 'v': channel}) OVER p).v AS usual_channel,
    row_number() OVER (PARTITION BY bank_account_uuid, ref_name, date_trunc('month', date_post)
                       ORDER BY tx_id) AS month_n,
    row_number() OVER (PARTITION BY ref_name ORDER BY tx_id) AS name_n,
    row_number() OVER (PARTITION BY ref_iban ORDER BY tx_id) AS iban_n,
    row_number() OVER (PARTITION BY ref_name, ref_iban ORDER BY tx_id) AS pair_n,
    row_number() OVER (PARTITION BY ref_name, late ORDER BY tx_id) - 1 AS name_before,
    row_number() OVER (PARTITION BY ref_iban, late ORDER BY tx_id) - 1 AS iban_before,
    lag(date_post) OVER (PARTITION BY bank_account_uuid, ref_name, late ORDER BY tx_id) AS last_date
  FROM counted
  WINDOW p AS (PARTITION BY bank_account_uuid, ref_name ORDER BY tx_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dev AS (
  SELECT *, CASE WHEN n = 1 THEN 0.1 * mean WHEN hi > lo THEN sd ELSE 0 END AS spread FROM prior),
feat AS (
  SELECT *,
    CASE WHEN spread > 0 THEN greatest(-10, least(10, (amount - mean) / spread)) ELSE 0 END
      AS amount_zscore_series,
    CASE WHEN mean > 0 THEN greatest(0, least(10, amount / mean)) ELSE 1 END AS amount_ratio_to_mean,
    coalesce(abs(day(date_post) - usual_day), 0) AS day_deviation_from_usual,
    CASE WHEN n > 0 AND ref_iban <> usual_iban THEN 1 ELSE 0 END AS iban_mismatch,
    CASE WHEN n > 0 AND ref_swift <> usual_swift THEN 1 ELSE 0 END AS swift_mismatch,
    CASE WHEN name_n > 1 AND pair_n = 1 THEN 1 ELSE 0 END AS known_name_new_iban,
    CASE WHEN n > 0 AND pay_method <> usual_method THEN 1 ELSE 0 END AS method_mismatch,
    CASE WHEN n > 0 AND channel <> usual_channel THEN 1 ELSE 0 END AS channel_mismatch,
    CASE WHEN pay_method = 'CARD' AND channel = 'MOBILE_APP' THEN 1 ELSE 0 END AS is_card_mobile,
    month_n AS tx_count_this_month_so_far,
    CASE WHEN n = 0 THEN 1 ELSE 0 END AS is_new_series,
    CASE WHEN name_n = 1 THEN 1 ELSE 0 END AS is_new_ref_name,
    CASE WHEN iban_n = 1 THEN 1 ELSE 0 END AS is_new_iban,
    n AS series_tx_count_before, name_before AS ref_name_count_before, iban_before AS iban_count_before,
    ln(1 + n) AS series_tx_count_before_log, ln(1 + name_before) AS ref_name_count_before_log,
    ln(1 + iban_before) AS iban_count_before_log,
    day(date_post) AS day_of_month, isodow(date_post) - 1 AS day_of_week, month(date_post) AS month,
    coalesce(date_diff('day', last_date, date_post), 30) AS days_since_last_in_series
  FROM dev)"""

INT_FEATURES = [
    "iban_mismatch", "swift_mismatch", "known_name_new_iban", "method_mismatch", "channel_mismatch",
    "is_card_mobile", "tx_count_this_month_so_far", "is_new_series", "is_new_ref_name", "is_new_iban",
    "day_of_month", "day_of_week", "month", "days_since_last_in_series",
]
FLOAT_FEATURES = [
    "amount_zscore_series", "amount_ratio_to_mean", "day_deviation_from_usual",
    "series_tx_count_before_log", "ref_name_count_before_log", "iban_count_before_log", "amount",
]


def tx_sql(body: str) -> str:
    return f"WITH {TX_SQL}\n{body}"


def features_sql(body: str) -> str:
    return f"WITH {FEATURES_SQL}\n{body}"
