"""Analyst reports over a ledger, one result for all accounts.

Series totals are aggregates joined back where rows need them. The previous row of a series
comes from per-day chunks, so no series is gathered into one task. A missing account or recipient is a key like any other.
Columns of the ledger with the name of a result column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from . import ranks
from .prior import TransactionColumns, day_key, present, series_keys


def previous_in_series(df: DataFrame, tx: TransactionColumns, value: str, out: str,
                       keys: Sequence[str] | None = None) -> DataFrame:
    """The value on the row before, in (date, ties) order. Rows are spread over (series, day);
    the first row of a day takes the last value of the day before."""
    made = series_keys(list(keys or tx.series))
    keys, chunk = list(made), [*made, "_day"]
    df = df.withColumns({**made, "_day": day_key(tx)})
    # a struct around the value: max_by would skip a last row whose value is missing
    last = df.groupBy(*chunk).agg(F.max_by(F.struct(value), F.struct(*tx.ties)).alias("_last"))
    carried = last.select(*chunk, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day"))[value].alias("_carry"))
    w = Window.partitionBy(*chunk).orderBy(*tx.ties)
    return (
        df.withColumn("_rn", F.row_number().over(w)).withColumn("_lag", F.lag(value).over(w))
        .join(carried, chunk)
        .withColumn(out, F.when(F.col("_rn") > 1, F.col("_lag")).otherwise(F.col("_carry")))
        .drop("_rn", "_lag", "_carry", *chunk)
    )


def runs_in_series(df: DataFrame, tx: TransactionColumns, flag: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Runs of consecutive rows with flag = 1 in (date, ties) order: keys, run (from 1 within the series), start_date, end_date,
    length, kind (persistent from two rows on, else one-off). A row without the flag, or with a missing one, ends a run.

    A run is the flagged rows with equally many other rows before them. These are counted per (series, day), added up over
    the days before, and counted on within the day, so a run that spans days is put together from counts and no series is
    gathered; what a day holds of a run is one row before the runs are."""
    names = list(keys or tx.series)
    made = series_keys(names)
    chunk = [*made, "_day"]
    on = F.coalesce(F.col(flag) == 1, F.lit(False))
    rows = df.withColumns({**made, "_day": day_key(tx), "_off": (~on).cast("long")})
    days = rows.groupBy(*chunk).agg(F.sum("_off").alias("_o"))
    days = days.select(*chunk, (F.sum("_o").over(Window.partitionBy(*made).orderBy("_day")) - F.col("_o")).alias("_before"))
    inside = Window.partitionBy(*chunk).orderBy(*tx.ties)
    rows = rows.withColumn("_inside", F.sum("_off").over(inside.rowsBetween(Window.unboundedPreceding, 0))).where("_off = 0")
    parts = rows.groupBy(*chunk, "_inside").agg(*(F.first(c).alias(c) for c in names), F.count(F.lit(1)).alias("_n"),
                                                F.min(tx.date).alias("_first"), F.max(tx.date).alias("_last"))
    parts = parts.join(days, chunk).withColumn("_island", F.col("_before") + F.col("_inside"))
    found = parts.groupBy(*made, "_island").agg(*(F.first(c).alias(c) for c in names), F.min("_first").alias("start_date"),
                                                F.max("_last").alias("end_date"), F.sum("_n").alias("length"))
    order = Window.partitionBy(*made).orderBy("_island")
    return found.withColumn("run", F.row_number().over(order)).select(
        *names, "run", "start_date", "end_date", "length", F.when(F.col("length") > 1, "persistent").otherwise("one-off").alias("kind"))


def day_shift_runs(df: DataFrame, tx: TransactionColumns, days: int = 7) -> DataFrame:
    """Runs of payments further than `days` from the median day of their series, as runs_in_series has them. The payments of a day
    are shifted or not together, so runs are put together from days."""
    made = series_keys(tx.series)
    order = Window.partitionBy(*made).orderBy("_date")
    off = F.coalesce(F.col("shifted") != 1, F.lit(True)).cast("long")
    rows = _shifted_days(df, tx, days).withColumn("_island", F.sum(off).over(order)).where("shifted = 1")
    found = rows.groupBy(*made, "_island").agg(*(F.first(c).alias(c) for c in tx.series), F.min("_date").alias("start_date"),
                                               F.max("_date").alias("end_date"), F.sum("_c").alias("length"))
    return found.withColumn("run", F.row_number().over(Window.partitionBy(*made).orderBy("_island"))).select(
        *tx.series, "run", "start_date", "end_date", "length", F.when(F.col("length") > 1, "persistent").otherwise("one-off").alias("kind"))


def small_payment_runs(df: DataFrame, tx: TransactionColumns, prob: float = 0.1) -> DataFrame:
    """Runs of payments of a series at or below the account's low percentile."""
    cut = ranks.order_statistics(df.withColumn("_acc", present(tx.account)), tx.amount, [prob], ["_acc"])
    rows = df.withColumn("_acc", present(tx.account)).join(cut.select("_acc", F.col("quantile").alias("_cut")), "_acc", "left")
    return runs_in_series(rows.withColumn("_small", (F.col(tx.amount) <= F.col("_cut")).cast("int")).drop("_acc", "_cut"), tx, "_small")


def customer_overview(df: DataFrame, tx: TransactionColumns) -> DataFrame:
    return df.groupBy(tx.account).agg(
        F.count(F.lit(1)).alias("n"), F.sum(tx.amount).alias("total"),
        F.min(tx.date).alias("first_date"), F.max(tx.date).alias("last_date"),
        F.count_distinct(tx.name).alias("recipients"), F.count_distinct(tx.channel).alias("channels"))


def recurring_amount_change(df: DataFrame, tx: TransactionColumns, k: float = 2.0) -> DataFrame:
    """Payments to recurring recipients further than k standard deviations from the series mean."""
    made = series_keys(tx.series)
    df = df.drop("n", "mean", "sd", "deviation").withColumns(made)
    stats = (
        df.groupBy(*made).agg(F.count(F.lit(1)).alias("n"), F.avg(tx.amount).alias("mean"),
                              F.stddev_pop(tx.amount).alias("sd"))
        .where((F.col("n") > 1) & (F.col("sd") > 0))
    )
    return df.join(stats, list(made)).drop(*made).withColumn("deviation", (F.col(tx.amount) - F.col("mean")) / F.col("sd")).where(
        F.abs("deviation") > k)


def payment_frequency_change(df: DataFrame, tx: TransactionColumns, spill_days: int = 3) -> DataFrame:
    """Series whose number of payments differs from the months they span. A payment in the first
    days of a month counts for the month before."""
    month = F.trunc(F.when(F.dayofmonth(tx.date) <= spill_days, F.date_sub(tx.date, spill_days))
                    .otherwise(F.col(tx.date)), "month")
    monthly = df.groupBy(*tx.series, month.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    out = monthly.groupBy(*tx.series).agg(
        F.sum("_n").alias("payments"), F.count(F.lit(1)).alias("active_months"),
        (F.months_between(F.max("_m"), F.min("_m")) + 1).cast("long").alias("span_months"),
        F.count_if(F.col("_n") > 1).alias("duplicate_months"), F.max("_n").alias("most_in_month"))
    return out.where((F.col("payments") > 1) & (F.col("payments") != F.col("span_months")))


def small_payment_patterns(df: DataFrame, tx: TransactionColumns, prob: float = 0.1) -> DataFrame:
    """Per series: payments at or below the account's low percentile, whether there are only such
    payments, whether one month has a surge of them, and how many repeat or follow on the one
    before in the same month."""
    made = series_keys(tx.series)
    df = df.withColumns({"_acc": present(tx.account), **made})
    cut = ranks.order_statistics(df, tx.amount, [prob], ["_acc"]).select("_acc", F.col("quantile").alias("_cut"))
    rows = df.join(cut, "_acc").withColumn("_small", F.col(tx.amount) <= F.col("_cut")).withColumn(
        "_m", F.trunc(tx.date, "month"))
    small = previous_in_series(rows.where("_small").drop(*made), tx, tx.amount, "_prev", [*tx.series, "_m"]).withColumns(made)
    runs = (
        small.groupBy(*made, "_m").agg(
            F.count(F.lit(1)).alias("_ns"),
            F.count_if(F.abs(F.col(tx.amount) - F.col("_prev")) <= 1).alias("_seq"))
        .groupBy(*made).agg(
            F.sum("_ns").alias("small"), F.max("_ns").alias("most_small_in_month"),
            F.avg("_ns").alias("_avg"), F.sum("_seq").alias("sequential"))
    )
    totals = df.groupBy(*made).agg(*(F.first(c).alias(c) for c in tx.series), F.count(F.lit(1)).alias("payments"))
    return runs.join(totals, list(made)).select(
        *tx.series, "payments", "small", "most_small_in_month", "sequential",
        (F.col("small") == F.col("payments")).cast("int").alias("only_small"),
        ((F.col("most_small_in_month") >= 2) & (F.col("most_small_in_month") > 1.5 * F.col("_avg")))
        .cast("int").alias("surge"))


def rare_payment_channels(df: DataFrame, tx: TransactionColumns, share: float = 0.05) -> DataFrame:
    """Share of each (method, channel) within the account; rare below the given share."""
    counts = df.groupBy(tx.account, tx.method, tx.channel).agg(F.count(F.lit(1)).alias("n"))
    part = F.col("n") / F.sum("n").over(Window.partitionBy(tx.account))
    return counts.withColumn("share", part).withColumn("rare", (F.col("share") < share).cast("int"))


def iban_changes(df: DataFrame, tx: TransactionColumns) -> DataFrame:
    """Payments whose iban differs from the one before in the series, with the edit distance."""
    out = previous_in_series(df, tx, tx.iban, "previous_iban")
    return out.where(F.col("previous_iban") != F.col(tx.iban)).withColumn(
        "distance", F.levenshtein("previous_iban", tx.iban))


def _with_deletions(name: Column, edits: int) -> Column:
    """The name and every string with up to `edits` characters left out. Two names within that many
    edits of each other share an entry, so they meet in an equi join."""

    def shorter(text: Column) -> Column:
        # no sequence from 1 down to 0 for an empty text
        places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda i: i <= F.length(text))
        return F.transform(places, lambda i: F.concat(
            F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))

    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, shorter))))
    return out


def new_recipient_similar_name(df: DataFrame, tx: TransactionColumns, edits: int = 1) -> DataFrame:
    """One-off recipients of an account whose name is at most `edits` edits away from a recurring
    recipient. The number of variants of a name grows with its length to that power. Names meet once for all accounts; accounts
    then meet the pairs of similar names."""
    # read for the distinct names and for both sides of the accounts
    names = cut_lineage(df.groupBy(tx.account, tx.name).agg(F.count(F.lit(1)).alias("_n")), "names")
    near = _similar_pairs(names.select(tx.name, (F.col("_n") == 1).alias("_once")), tx.name, edits)
    once = names.where("_n = 1").select(tx.account, F.col(tx.name).alias("one_off"))
    often = names.where("_n > 1").select(tx.account, F.col(tx.name).alias("recurring"))
    return once.join(near, "one_off").join(often, [tx.account, "recurring"]).select(tx.account, "one_off", "recurring")


def _similar_pairs(names: DataFrame, name: str, edits: int) -> DataFrame:
    """one_off, recurring: distinct names within 1 to `edits` edits, the first _once somewhere and the second not. A name that many
    accounts share is spelt out and compared once, not once per account."""
    kinds = names.groupBy(name).agg(F.max("_once").alias("_o"), F.min("_once").alias("_a"))
    variants = kinds.select(F.col(name), "_o", (~F.col("_a")).alias("_r")).withColumn("_v", F.explode(_with_deletions(F.col(name), edits)))
    once = variants.where("_o").select(F.col(name).alias("one_off"), "_v")
    often = variants.where("_r").select(F.col(name).alias("recurring"), "_v")
    pairs = once.join(often, "_v").where(F.levenshtein("one_off", "recurring").between(1, edits))
    return cut_lineage(pairs.select("one_off", "recurring").distinct(), "similar")


def _shifted_days(df: DataFrame, tx: TransactionColumns, days: int) -> DataFrame:
    """The days (_date, _c payments) of series with several payments, with the columns and keys of the series, median_day, payments
    and shifted: whether the day is further than `days` from the median. All payments of a day are shifted or none, so days do for rows."""
    made = series_keys(tx.series)
    rows = df.withColumns(made).groupBy(*made, F.col(tx.date).alias("_date")).agg(
        *(F.first(c).alias(c) for c in tx.series), F.count(F.lit(1)).alias("_c"))
    day = F.dayofmonth("_date")
    whole = Window.partitionBy(*made)
    # the frame holds all rows up to the day of the month
    rows = rows.withColumns({"_cum": F.sum("_c").over(whole.orderBy(day)), "payments": F.sum("_c").over(whole)})
    low = F.min(F.when(F.col("_cum") > F.floor((F.col("payments") - 1) / 2), day)).over(whole)
    high = F.min(F.when(F.col("_cum") > F.floor(F.col("payments") / 2), day)).over(whole)
    return rows.withColumn("median_day", (low + high) / 2).where("payments > 1").drop("_cum").withColumn(
        "shifted", (F.abs(day - F.col("median_day")) > days).cast("int"))


def payment_day_shift(df: DataFrame, tx: TransactionColumns, days: int = 7) -> DataFrame:
    """Payments further than `days` from the median day of their series; persistent when the payment
    before was shifted too. That one is of the same day, which is shifted as a whole, or of the day before it in the series."""
    made = series_keys(tx.series)
    found = _shifted_days(df, tx, days).withColumn("_before", F.lag("shifted").over(Window.partitionBy(*made).orderBy("_date")))
    chunk = [*made, "_date"]
    found = found.where("shifted = 1").select(*chunk, "median_day", "payments", "shifted", "_before")
    rows = df.drop("median_day", "payments", "shifted", "kind").withColumns({**made, "_date": F.col(tx.date)}).join(found, chunk)
    first = F.row_number().over(Window.partitionBy(*chunk).orderBy(*tx.ties)) == 1
    kind = F.when(~first | (F.col("_before") == 1), "persistent").otherwise("one-off")
    return rows.withColumn("kind", kind).drop("_before", *chunk)


def invoice_period_mismatch(df: DataFrame, posted: str, parts: dict[str, Column]) -> DataFrame:
    """Payments whose invoice month is not the month of the posting date less the term."""
    rows = df.withColumns(parts).where(F.col("inv_year").isNotNull())
    due = F.trunc(F.date_sub(posted, F.col("inv_term")), "month")
    invoiced = F.make_date("inv_year", "inv_month", F.lit(1))
    return rows.withColumn("months_off", F.months_between(due, invoiced).cast("long")).where("months_off <> 0")
