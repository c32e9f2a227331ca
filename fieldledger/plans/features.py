"""Queries over the strictly-prior transaction features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prior, splits
from ..sources.tables import TX, transactions
from .common import (FLOAT_FEATURES, INT_FEATURES, KEY_SQL, features_sql, flt, num, row_key, shape, txt)
from .registry import query


def all_features(spark, sf, hot_rows=prior.HOT_ROWS):
    tx = transactions(spark, sf)
    cutoff = splits.looked_up(spark, splits.chronological_cutoff(tx, TX.date), "date")
    return prior.transaction_features(tx, TX, cutoff, hot_rows=hot_rows)


def _keyed(df):
    return df.withColumn("row_key", row_key())


def _sql(strings=(), ints=(), floats=(), where=""):
    cols = [f"{KEY_SQL} AS row_key", *[txt(c) for c in strings], *[num(c) for c in ints],
            *[flt(c) for c in floats]]
    return features_sql(f"SELECT {', '.join(cols)} FROM feat {where}")


@query("transaction_features", _sql((), INT_FEATURES, FLOAT_FEATURES))
def transaction_features(spark, sf):
    return shape(_keyed(all_features(spark, sf)), ["row_key"], INT_FEATURES, FLOAT_FEATURES)


@query("carry_over_state", _sql((), INT_FEATURES, FLOAT_FEATURES, "WHERE late"))
def carry_over_state(spark, sf):
    """Features of the test part, started from the state the training part leaves; every series
    with more than 20 rows goes through the per-day chunks."""
    tx = transactions(spark, sf)
    cutoff = splits.looked_up(spark, splits.chronological_cutoff(tx, TX.date), "date")
    out = prior.transaction_features(tx, TX, cutoff, hot_rows=20)
    out = out.withColumn("_cut", cutoff).where(F.col("date_post") > F.col("_cut"))
    return shape(_keyed(out), ["row_key"], INT_FEATURES, FLOAT_FEATURES)


def _series(name, ints=(), floats=(), strings=(), modes=(), where_cutoff=False):
    @query(name, _sql(strings, ints, floats))
    def run(spark, sf):
        tx = transactions(spark, sf)
        cutoff = splits.chronological_cutoff(tx, TX.date) if where_cutoff else None
        hot = prior.hot_keys(tx, TX.series, TX.amount, prior.HOT_ROWS)
        out = prior.series_features(tx, TX, cutoff, modes=modes, hot=hot)
        return shape(_keyed(out), ["row_key", *strings], ints, floats)

    return run


_series("amount_zscore_series", floats=["amount_zscore_series"])
_series("amount_ratio_to_mean", floats=["amount_ratio_to_mean"])
_series("day_deviation_from_usual", floats=["day_deviation_from_usual"])
_series("iban_mismatch", ints=["iban_mismatch"], modes=["iban"])
_series("swift_mismatch", ints=["swift_mismatch"], modes=["swift"])
_series("method_mismatch", ints=["method_mismatch"], modes=["method"])
_series("channel_mismatch", ints=["channel_mismatch"], modes=["channel"])
_series("running_mode", strings=["usual_iban", "usual_swift", "usual_method", "usual_channel"],
        modes=["iban", "swift", "method", "channel"])
_series("tx_count_this_month_so_far", ints=["tx_count_this_month_so_far"])
_series("is_new_series", ints=["is_new_series"])
_series("series_tx_count_before", ints=["series_tx_count_before"], floats=["series_tx_count_before_log"])
_series("days_since_last_in_series", ints=["days_since_last_in_series"], where_cutoff=True)


def _global(name, key, prefix, ints, floats=()):
    @query(name, _sql((), ints, floats))
    def run(spark, sf):
        tx = transactions(spark, sf)
        cutoff = splits.chronological_cutoff(tx, TX.date)
        return shape(_keyed(prior.key_counts(tx, TX, key, prefix, cutoff)), ["row_key"], ints, floats)

    return run


_global("is_new_ref_name", TX.name, "ref_name", ["is_new_ref_name"])
_global("is_new_iban", TX.iban, "iban", ["is_new_iban"])
_global("ref_name_count_before", TX.name, "ref_name", ["ref_name_count_before"], ["ref_name_count_before_log"])
_global("iban_count_before", TX.iban, "iban", ["iban_count_before"], ["iban_count_before_log"])


@query("known_name_new_iban", _sql((), ["known_name_new_iban"]))
def known_name_new_iban(spark, sf):
    out = prior.counterparty_features(transactions(spark, sf), TX)
    return shape(_keyed(out), ["row_key"], ["known_name_new_iban"])


@query("select_features", features_sql(
    f"SELECT {KEY_SQL} AS row_key, " + ", ".join(flt(c, f"f{i}") for i, c in enumerate(prior.FEATURE_COLUMNS))
    + " FROM feat"))
def select_features(spark, sf):
    out = _keyed(all_features(spark, sf)).withColumn("v", prior.select_features(None))
    names = [f"f{i}" for i in range(len(prior.FEATURE_COLUMNS))]
    return shape(out.select("row_key", *[F.col("v")[i].alias(n) for i, n in enumerate(names)]),
                 ["row_key"], (), names)
