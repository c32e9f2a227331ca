"""Labelled corruption of a ledger: one row of every series, chosen by hash, becomes an anomaly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.noise import noise_key
from .prior import TransactionColumns

KINDS = ("amount", "frequency", "payee", "timing", "channel", "iban_mismatch", "subtle_payee")
# fixed values: the factors here, and the notes and description texts in inject()
FACTORS = (1.5, 1.8, 2.0)
HEX, LETTERS, DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOP", "0123456789012345"


def mark_picks(df: DataFrame, tx: TransactionColumns, key: str, seed) -> DataFrame:
    """_pick: the row has the smallest hash of its series. The smallest hash per series is a
    map-side aggregate; it joins back on (series, hash), which no two rows share, so a hot
    series is not gathered."""
    hashed = df.withColumn("_h", F.md5(noise_key(F.col(key), "inject", seed)))
    first = hashed.groupBy(*tx.series).agg(F.min("_h").alias("_h")).withColumn("_pick", F.lit(True))
    return hashed.join(first, [*tx.series, "_h"], "left").withColumn("_pick", F.coalesce("_pick", F.lit(False)))


def _hash_number(start: int, n: int) -> Column:
    """0 .. n - 1 from eight hex digits of the row hash."""
    return (F.conv(F.substring("_h", start, 8), 16, 10).cast("long") % n).cast("int")


def _letters(start: int, length: int) -> Column:
    return F.translate(F.substring("_h", start, length), HEX, LETTERS)


def new_iban() -> Column:
    return F.concat(F.lit("GB"), F.translate(F.substring("_h", 1, 20), HEX, DIGITS))


def inject(df: DataFrame, kind: str, tx: TransactionColumns, key: str, seed=0,
           note: str = "paym_note", bank: str = "ref_bank", description: str = "anomaly_description") -> DataFrame:
    """df with one row per series changed, or added for `frequency`, and described."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind {kind}")
    rows = mark_picks(df, tx, key, seed)
    day, date = F.dayofmonth(tx.date), F.col(tx.date)

    def on_day(d: Column) -> Column:
        return F.make_date(F.year(date), F.month(date), d)

    if kind == "frequency":
        extra = rows.where("_pick")
        extra = extra.withColumns({
            tx.date: on_day((day + F.lit(7) + _hash_number(1, 9)) % 28 + 1),
            note: F.lit("REPAYMENT-URGENT"),
            description: F.lit("FREQUENCY_ANOMALY: Duplicate monthly payment"),
        })
        return rows.unionByName(extra).drop("_h", "_pick")

    name, iban = F.col(tx.name), F.col(tx.iban)
    if kind == "amount":
        factor = F.array(*[F.lit(f) for f in FACTORS])[_hash_number(1, 3)]
        changes = {
            tx.amount: F.rint(F.col(tx.amount) * factor * 100) / 100,
            description: F.concat(F.lit("AMOUNT_ANOMALY: Amount changed from ~"), F.rint(tx.amount).cast("long")),
        }
    elif kind == "payee":
        changes = {
            tx.name: F.concat(F.lit("Payee "), _letters(1, 8), F.lit(" Ltd.")), bank: _letters(9, 2),
            tx.iban: new_iban(), tx.swift: _letters(11, 11),
            description: F.concat(F.lit("PAYEE_ANOMALY: Payee changed from "), name),
        }
    elif kind == "timing":
        new_day = (day + 10) % 28 + 1
        changes = {
            tx.date: on_day(new_day),
            description: F.concat(F.lit("TIMING_ANOMALY: Payment date shifted from day ~"), day, F.lit(" to "), new_day),
        }
    elif kind == "channel":
        changes = {
            tx.method: F.lit("CARD"), tx.channel: F.lit("MOBILE_APP"),
            description: F.concat(F.lit("CHANNEL_ANOMALY: Payment made via CARD/MOBILE_APP instead of "),
                                  F.col(tx.method), F.lit("/"), F.col(tx.channel)),
        }
    elif kind == "iban_mismatch":
        changes = {
            tx.iban: new_iban(),
            description: F.concat(F.lit("IBAN_MISMATCH_ANOMALY: IBAN changed from "), F.substring(iban, 1, 10),
                                  F.lit("... to "), F.substring(new_iban(), 1, 10), F.lit("...")),
        }
    else:
        renamed = subtle_name(name)
        changes = {
            tx.name: renamed, tx.iban: new_iban(),
            description: F.concat(F.lit("SUBTLE_PAYEE_MISMATCH: Payee changed from '"), name, F.lit("' to '"),
                                  renamed, F.lit("'")),
        }
    picked = {c: F.when(F.col("_pick"), v).otherwise(F.col(c)) for c, v in changes.items()}
    return rows.withColumns(picked).drop("_h", "_pick")


def subtle_name(name: Column) -> Column:
    return (
        F.when(name.contains("Solutions"), F.replace(name, F.lit("Solutions"), F.lit("Systems")))
        .when(name.contains("Cloud"), F.replace(name, F.lit("Cloud"), F.lit("Core")))
        .otherwise(F.concat(F.split_part(name, F.lit(" "), F.lit(1)), F.lit(" Ventures")))
    )
