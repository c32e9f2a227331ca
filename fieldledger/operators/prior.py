"""Strictly-prior features of a transaction ledger.

A row sees only the rows before it in the total order (date, ties). Per-series features run
as windows over (account, recipient). A series too large for one task is cut into one chunk
per day (or finer, see sub_day): each chunk is windowed on its own and starts from the state
of the chunks before it, which comes from pre-aggregated per-chunk totals. Global keys
(recipient, iban) are always handled that way, since a few of them hold most rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from ..session import cut_lineage, passed, release

# fixed values: the columns of the feature vector, in their order
FEATURE_COLUMNS = (
    "amount_zscore_series", "amount_ratio_to_mean",
    "day_deviation_from_usual",
    "iban_mismatch", "swift_mismatch", "known_name_new_iban",
    "method_mismatch", "channel_mismatch", "is_card_mobile",
    "tx_count_this_month_so_far",
    "is_new_series", "is_new_ref_name", "is_new_iban",
    "series_tx_count_before_log", "ref_name_count_before_log", "iban_count_before_log",
    "day_of_month", "day_of_week", "month", "days_since_last_in_series",
    "amount",
)
DEFAULT_GAP_DAYS = 30
HOT_ROWS = 20_000_000
# ledgers of more rows are worked on in passes that are written, so that the disk holds the shuffle files of one at a time
PASS_ROWS = 2_000_000
# stands for a missing date in the keys of chunks; it sorts where nulls do
NO_DAY = "0001-01-01"


@dataclass(frozen=True)
class TransactionColumns:
    account: str
    name: str
    iban: str
    swift: str
    method: str
    channel: str
    date: str
    amount: str
    ties: tuple[str, ...]

    @property
    def series(self) -> list[str]:
        return [self.account, self.name]

    @property
    def modes(self) -> dict[str, str]:
        return {"iban": self.iban, "swift": self.swift, "method": self.method, "channel": self.channel}


def present(column: str) -> Column:
    """A text that is never null and tells a missing value from all others: null is a key like any other."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def day_key(tx: TransactionColumns) -> Column:
    return F.coalesce(F.col(tx.date), F.lit(NO_DAY).cast("date"))


def series_keys(keys: Sequence[str]) -> dict[str, Column]:
    return {f"_k{i}": present(k) for i, k in enumerate(keys)}


def hot_keys(df: DataFrame, keys: Sequence[str], value: str, min_rows: int) -> DataFrame | None:
    """Keys with more than min_rows rows (missing keys too), their rows and mean value, as a written table that is
    joined and not broadcast: their number may grow with the data. None when there is no such key."""
    made = series_keys(keys)
    found = cut_lineage(
        df.groupBy(*[c.alias(k) for k, c in made.items()])
        .agg(F.count(F.lit(1)).alias("_rows"), F.coalesce(F.avg(value), F.lit(0.0)).alias("_center"))
        .where(F.col("_rows") > min_rows), "hot-keys")
    return None if found.isEmpty() else found


def _before(*keys, order) -> object:
    return (
        Window.partitionBy(*keys).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def _whole_series_state(df: DataFrame, tx: TransactionColumns, modes: Sequence[str]) -> DataFrame:
    """State before each row from plain windows; every series fits one task."""
    order = [tx.date, *tx.ties]
    w = Window.partitionBy(*tx.series).orderBy(*order)
    prior = _before(*tx.series, order=order)
    amount = F.col(tx.amount)
    month = F.trunc(tx.date, "month")
    out = df.withColumns({"_pos": F.row_number().over(w).cast("long"), "_last": F.lag(tx.date).over(w)})
    # rank within the value and first position of the value: one sort per value column
    for m in modes:
        by_value = Window.partitionBy(*tx.series, tx.modes[m])
        out = out.withColumns({
            f"_c_{m}": F.row_number().over(by_value.orderBy(*order)).cast("long"),
            f"_f_{m}": -F.min("_pos").over(by_value),
        })
    # everything else shares one more sort
    month_start = F.when((F.col("_pos") == 1) | ~F.trunc("_last", "month").eqNullSafe(month), F.col("_pos"))
    state = {
        "_n": F.count(F.lit(1)).over(prior),
        "_mean": F.avg(amount).over(prior),
        "_sd": F.stddev_pop(amount).over(prior),
        "_lo": F.min(amount).over(prior),
        "_hi": F.max(amount).over(prior),
        "_usual_day": F.percentile(F.dayofmonth(tx.date), F.lit(0.5)).over(prior),
        "_month_n": F.col("_pos") - F.max(month_start).over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    }
    for m in modes:
        # the value with the most rows so far has its count on its latest row; of equally
        # frequent values the one seen first wins
        state[f"_mode_{m}"] = F.max(F.struct(
            F.col(f"_c_{m}").alias("c"), F.col(f"_f_{m}").alias("f"), F.col(tx.modes[m]).alias("v"),
        )).over(prior)["v"]
    return out.withColumns(state).drop("_pos", *[f"_c_{m}" for m in modes], *[f"_f_{m}" for m in modes])


def _median_day(cum: Column, today: Column, n: Column) -> dict[str, Column]:
    """Steps to the exact median of days, _usual_day: of the days counted up to each of 1..31 in cum, and n times the day today."""
    t, low, high, extra = F.col("_t"), F.col("_low"), F.col("_high"), F.col("_extra")
    below, upto = F.coalesce(F.get(cum, today - 2), F.lit(0)), F.get(cum, today - 1) + extra

    def earlier(rank: Column) -> Column:
        return F.size(F.filter(cum, lambda c: c <= rank)) + 1

    def day_at(rank: Column) -> Column:
        return F.when(today.isNull() | (rank < below), earlier(rank)).when(rank < upto, today).otherwise(earlier(rank - extra))

    return {"_extra": F.when(today.isNull(), F.lit(0)).otherwise(n).cast("long"), "_t": F.get(cum, F.lit(30)) + extra,
            "_low": F.floor((t - 1) / 2), "_high": F.floor(t / 2),
            "_usual_day": F.when(t > 0, (day_at(low).cast("double") + day_at(high)) / 2)}


def _chunk_markers(parts: DataFrame, tx: TransactionColumns, modes: Sequence[str], chunk: Sequence[str], gathered: bool) -> DataFrame:
    """What a chunk must know of the chunks before it, as rows that are put among its own: the first has _state, the totals before and
    the best value so far of each mode. One row holds a value of the chunk for each mode, in the mode's column, with its count
    (_c0) and first row (_f0) before the chunk. A written table.

    parts: rows of the series with their _center, keys and _day. They are shuffled once by chunk, for all that is counted in it, and
    the counts once by series if they may be `gathered` there; else as each step needs it, so that no task gets a whole series."""
    series = list(series_keys(tx.series))
    key = [*series, *chunk]
    kinds = {m: parts.schema[tx.modes[m]].dataType for m in modes}
    parts = parts.select(*dict.fromkeys([*key, *tx.ties, tx.date, tx.amount, "_center", *(tx.modes[m] for m in modes)])).repartition(*key)
    parts = parts.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy(*tx.ties)))
    x = F.col(tx.amount) - F.col("_center")
    names = ("m", "_v", "x", "xx", "a", "d")
    whole = [F.lit(-1), F.lit(""), x, x * x, F.col(tx.amount), F.col(tx.date)]
    none = [F.lit(None).cast(k) for k in ("double", "double", parts.schema[tx.amount].dataType, parts.schema[tx.date].dataType)]
    entries = [whole, *([F.lit(i), present(tx.modes[m]), *none] for i, m in enumerate(modes))]
    counts = parts.select(*key, "_r", F.inline(F.array(*(F.struct(*(c.alias(n) for c, n in zip(e, names))) for e in entries))))
    counts = counts.groupBy(*key, "m", "_v").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r"), F.sum("x").alias("_s"), F.sum("xx").alias("_ss"),
        F.min("a").alias("_lo"), F.max("a").alias("_hi"), F.count("a").alias("_a"), F.max("d").alias("_d"))
    if gathered:
        counts = counts.repartition(*series)
    by_value = _before(*series, "m", "_v", order=chunk)
    first = F.struct(*chunk, "_r")
    counts = counts.withColumns({"_c0": F.sum("_n").over(by_value), "_f0": F.min(first).over(by_value),
                                 "_j": F.row_number().over(Window.partitionBy(*key, "m").orderBy("_v"))})
    # the j-th values of all modes in one row, the totals beside the first
    is_mode = [F.col("m") == i for i in range(-1, len(modes))]
    made = [F.max(F.when(is_mode[0], F.struct("_n", "_s", "_ss", "_lo", "_hi", "_a", "_d"))).alias("_x")]
    for m, here in zip(modes, is_mode[1:]):
        best = F.struct((-F.coalesce("_c0", F.lit(0)) - F.col("_n")).alias("c"), F.coalesce("_f0", first).alias("f"), F.col("_v").alias("v"))
        made += [F.min(F.when(here, best)).alias(f"_b_{m}"), F.max(F.when(here, F.struct("_v", "_c0", "_f0"))).alias(f"_y_{m}")]
    rows = counts.groupBy(*key, "_j").agg(*made)
    rows = rows.withColumns({f"_b_{m}": F.min(f"_b_{m}").over(Window.partitionBy(*key)) for m in modes})
    rows = rows.select("*", "_x.*").drop("_x").withColumn("_ym", F.trunc("_d", "month"))
    wd, day = _before(*series, "_j", order=chunk), F.dayofmonth("_d")
    zero = F.lit(0).cast("long")

    def value(text: Column, m: str) -> Column:
        return F.when(text != "", F.substring(text, 2, 2**31 - 1)).cast(kinds[m])

    state = {
        "n": F.coalesce(F.sum("_n").over(wd), zero), "s": F.coalesce(F.sum("_s").over(wd), F.lit(0.0)),
        "ss": F.coalesce(F.sum("_ss").over(wd), F.lit(0.0)), "lo": F.min("_lo").over(wd), "hi": F.max("_hi").over(wd),
        "a": F.coalesce(F.sum("_a").over(wd), zero), "last": F.max("_d").over(wd),
        "m": F.coalesce(F.sum("_n").over(_before(*series, "_j", "_ym", order=chunk)), zero),
        "cum": F.array(*[F.coalesce(F.sum(F.when(day <= d, F.col("_n"))).over(wd), zero) for d in range(1, 32)])}
    rows = rows.withColumns({f"_0{k}": c for k, c in state.items()} | {f"_b_{m}": F.min(f"_b_{m}").over(wd) for m in modes})
    best = [F.when(F.col(f"_b_{m}").isNotNull(), F.struct(F.col(f"_b_{m}.c").alias("c"), F.col(f"_b_{m}.f").alias("f"),
                                                          value(F.col(f"_b_{m}.v"), m).alias("v"))).alias(f"best_{m}") for m in modes]
    out = rows.select(*key, F.when(F.col("_j") == 1, F.struct(*(F.col(f"_0{k}").alias(k) for k in state), *best)).alias("_state"),
                      *(value(F.col(f"_y_{m}._v"), m).alias(tx.modes[m]) for m in modes),
                      *(F.col(f"_y_{m}.{c}").alias(f"{c}_{m}") for m in modes for c in ("_c0", "_f0")))
    kept = F.col("_state").isNotNull()
    for m in modes:
        kept = kept | F.col(f"_c0_{m}").isNotNull()
    return cut_lineage(out.where(kept).withColumn("_mark", F.lit(True)), "chunks")


def _chunked_series_state(
    df: DataFrame, tx: TransactionColumns, modes: Sequence[str], sub_day: str | None, then: Sequence[str] = (), gathered: bool = True,
) -> DataFrame:
    """The same state for series cut into chunks. df is a written table, with _center per series and its keys; sub_day holds no null."""
    series = list(series_keys(tx.series))
    chunk = ["_day"] + ([sub_day] if sub_day else [])
    key = [*series, *chunk]
    df = df.withColumn("_day", day_key(tx))
    ties = [*tx.ties, *then]
    inside = _before(*key, order=ties)
    markers = _chunk_markers(df, tx, modes, chunk, gathered)
    release(df.sparkSession)

    # usual values: the least (-count, first row, value); rows and what their chunk must know are shuffled once
    out = df.withColumn("_mark", F.lit(None).cast("boolean")).unionByName(markers, allowMissingColumns=True).repartition(*key)
    last_marks = F.col("_mark").isNotNull()
    out = out.withColumn("_r", F.rank().over(Window.partitionBy(*key).orderBy(last_marks, *tx.ties)))
    for m in modes:
        v = tx.modes[m]
        out = out.withColumn("_v", F.when(F.col("_mark").isNull() | F.col(f"_c0_{m}").isNotNull(), present(v)))
        own = Window.partitionBy(*key, "_v")
        ordered = own.orderBy(last_marks, *ties)
        whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        count_now = F.coalesce(F.max(f"_c0_{m}").over(whole), F.lit(0)) + F.row_number().over(ordered)
        seen_first = F.coalesce(F.min(f"_f0_{m}").over(whole), F.min(F.when(~last_marks, F.struct(*chunk, "_r"))).over(whole))
        out = out.withColumn(f"_cand_{m}", F.struct(
            (-count_now).cast("long").alias("c"), seen_first.alias("f"), F.col(v).alias("v"))).drop("_v", f"_c0_{m}", f"_f0_{m}")
    out = out.withColumn("_state", F.first("_state", ignorenulls=True).over(Window.partitionBy(*key))).where("_mark is null").drop("_mark", "_r")
    out = out.withColumn("_n1", (F.row_number().over(Window.partitionBy(*key).orderBy(*ties)) - 1).cast("long"))
    for m in modes:
        out = out.withColumn(f"_mode_{m}", F.least(f"_state.best_{m}", F.min(f"_cand_{m}").over(inside))["v"])
    out = out.drop(*(f"_cand_{m}" for m in modes))

    x = F.col(tx.amount) - F.col("_center")
    out = out.withColumns({
        "_n": F.col("_state.n") + F.col("_n1"),
        "_a": F.col("_state.a") + F.coalesce(F.count(tx.amount).over(inside), F.lit(0)),
        "_s": F.col("_state.s") + F.coalesce(F.sum(x).over(inside), F.lit(0.0)),
        "_ss": F.col("_state.ss") + F.coalesce(F.sum(x * x).over(inside), F.lit(0.0)),
        "_lo": F.least("_state.lo", F.min(tx.amount).over(inside)),
        "_hi": F.greatest("_state.hi", F.max(tx.amount).over(inside))})
    shift = F.try_divide("_s", "_a")
    out = (
        out.withColumn("_mean", F.col("_center") + shift)
        .withColumn("_sd", F.sqrt(F.greatest(F.try_divide("_ss", "_a") - shift * shift, F.lit(0.0))))
        .withColumn("_last", F.when(F.col("_n1") > 0, F.col(tx.date)).otherwise(F.col("_state.last")))
        .withColumn("_month_n", F.col("_state.m") + F.col("_n1"))
        .withColumn("_cum", F.col("_state.cum")).withColumn("_today", F.dayofmonth(tx.date))
    )
    for name, c in _median_day(F.col("_cum"), F.col("_today"), F.col("_n1")).items():
        out = out.withColumn(name, c)
    return out.drop("_center", "_state", "_n1", "_s", "_ss", "_a", "_day", "_cum", "_today", "_extra", "_t", "_low", "_high")


def series_state(
    df: DataFrame, tx: TransactionColumns, modes: Sequence[str] = ("iban", "swift", "method", "channel"),
    hot: DataFrame | None = None, sub_day: str | None = None, then: Sequence[str] = (), own: Sequence[DataFrame] = (),
) -> DataFrame:
    """df plus the state of its series before each row, in columns that begin with '_'.

    hot: the series to cut into chunks, from hot_keys; then: columns of df that order rows with equal ties in a chunk, as they were
    ordered before. With hot series df is written, and the tables that it is made from and that nothing else reads (own) are removed."""
    if hot is None:
        return _whole_series_state(df, tx, modes)
    keys = series_keys(tx.series)
    gathered = hot.agg(F.max("_rows")).first()[0] <= HOT_ROWS
    rows = passed(df.withColumns(keys).join(hot.drop("_rows"), list(keys), "left"), "series", *own)
    small, large = rows.where("_center is null").drop("_center", *keys), rows.where("_center is not null")
    return _whole_series_state(small, tx, modes).unionByName(_chunked_series_state(large, tx, modes, sub_day, then, gathered).drop(*keys))


def series_features(
    df: DataFrame, tx: TransactionColumns, cutoff: Column | None = None,
    modes: Sequence[str] = ("iban", "swift", "method", "channel"),
    hot: DataFrame | None = None, sub_day: str | None = None, then: Sequence[str] = (), own: Sequence[DataFrame] = (),
) -> DataFrame:
    """Features of the row against the earlier rows of its (account, recipient) series.

    Rows after the cutoff date form a second pass: only the gap since the last payment
    starts anew there, all other state carries over.
    """
    state = series_state(df, tx, modes, hot, sub_day, then, own)
    if cutoff is not None:
        state = state.withColumn("_cutoff", cutoff)
    amount, n, mean = F.col(tx.amount), F.col("_n"), F.col("_mean")
    sd = F.when(n == 1, mean * F.lit(0.1)).when(F.col("_hi") > F.col("_lo"), F.col("_sd")).otherwise(F.lit(0.0))
    z = F.when(sd > 0, (amount - mean) / sd).otherwise(F.lit(0.0))
    ratio = F.when(mean > 0, amount / mean).otherwise(F.lit(1.0))
    gap = F.datediff(tx.date, "_last")
    if cutoff is not None:
        gap = F.when((F.col(tx.date) > F.col("_cutoff")) & (F.col("_last") <= F.col("_cutoff")), None).otherwise(gap)
    features = {
        "amount_zscore_series": S.clip_range(z, -10, 10),
        "amount_ratio_to_mean": S.clip_range(ratio, 0, 10),
        "day_deviation_from_usual":
            F.coalesce(F.abs(F.dayofmonth(tx.date) - F.col("_usual_day")), F.lit(0.0)),
        "tx_count_this_month_so_far": (F.col("_month_n") + 1).cast("long"),
        "is_new_series": (n == 0).cast("int"),
        "series_tx_count_before": n.cast("long"),
        "series_tx_count_before_log": F.log1p(n),
        "days_since_last_in_series": F.coalesce(gap, F.lit(DEFAULT_GAP_DAYS)).cast("int"),
    }
    for m in modes:
        features[f"usual_{m}"] = F.col(f"_mode_{m}")
        features[f"{m}_mismatch"] = F.when(
            (n > 0) & ~F.col(tx.modes[m]).eqNullSafe(F.col(f"_mode_{m}")), 1).otherwise(0)
    out = state.withColumns(features)
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def key_counts(
    df: DataFrame, tx: TransactionColumns, key: str, prefix: str,
    cutoff: Column | None = None, sub_day: str | None = None, base: DataFrame | None = None, pair: str | None = None,
) -> DataFrame:
    """Earlier rows of a global key (a missing key is a key): is_new_<prefix> over all rows,
    <prefix>_count_before restarting after the cutoff. Rows are spread over (key, day); the days
    before come from per-day totals of base, which is df or what df was made from.

    pair: a second column; _first_pair then tells whether the row is the first of its (key, pair). The chunk of that row comes as a
    marker row (_hit) that sorts behind the others, so rows are not shuffled by (key, pair, day) as well."""
    chunk = ["_day"] + ([sub_day] if sub_day else [])
    names = {"_key": present(key), "_day": day_key(tx)}
    source = (df if base is None else base).withColumns(names)
    days = source.groupBy("_key", *chunk).agg(F.count(F.lit(1)).alias("_t"))
    if cutoff is not None:
        days = days.withColumn("_cutoff", cutoff)
        after = F.coalesce(F.col("_day") > F.col("_cutoff"), F.lit(False))
    else:
        after = F.lit(False)
    days = days.withColumn("_after", after).select(
        "_key", *chunk,
        F.coalesce(F.sum("_t").over(_before("_key", order=chunk)), F.lit(0)).alias("_all0"),
        F.coalesce(F.sum("_t").over(_before("_key", "_after", order=chunk)), F.lit(0)).alias("_split0"),
    )
    out = df.withColumns(names)
    if pair:
        firsts = source.groupBy("_key", present(pair).alias("_pair")).agg(F.min(F.struct(*chunk)).alias("_f"), F.max(pair).alias(pair))
        marks = firsts.select("_key", *[F.col(f"_f.{c}").alias(c) for c in chunk], pair, F.lit(True).alias("_hit"))
        out = out.withColumn("_hit", F.lit(None).cast("boolean")).unionByName(marks, allowMissingColumns=True)
        out = out.repartition("_key", *chunk).withColumn("_pair", present(pair))
        ordered = Window.partitionBy("_key", *chunk, "_pair").orderBy(F.col("_hit").isNotNull(), *tx.ties)
        hit = F.max("_hit").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        out = out.withColumn("_first_pair", F.coalesce(hit, F.lit(False)) & (F.row_number().over(ordered) == 1))
        out = out.where("_hit is null").drop("_hit", "_pair")
    rank = F.row_number().over(Window.partitionBy("_key", *chunk).orderBy(*tx.ties)) - 1
    before = F.col("_split0") + F.col("_r")
    return (
        out.withColumn("_r", rank).join(days, ["_key", *chunk], "left")
        .withColumn(f"is_new_{prefix}", (F.col("_all0") + F.col("_r") == 0).cast("int"))
        .withColumn(f"{prefix}_count_before", before.cast("long"))
        .withColumn(f"{prefix}_count_before_log", F.log1p(before))
        .drop("_r", "_all0", "_split0", *names)
    )


def counterparty_features(
    df: DataFrame, tx: TransactionColumns, cutoff: Column | None = None, sub_day: str | None = None, own: list[DataFrame] | None = None,
) -> DataFrame:
    """Features of the recipient and the iban over all accounts. All totals come from df itself, not from the
    frames that the joins before have made of it. own: if given, what the recipient gives is written first, to a table put into it."""
    out = key_counts(df, tx, tx.name, "ref_name", cutoff, sub_day, df, tx.iban)
    if own is not None:
        out = passed(out.drop("ref_name_count_before_log"), "recipients")
        own.append(out)
        out = out.withColumn("ref_name_count_before_log", F.log1p("ref_name_count_before"))
    out = key_counts(out, tx, tx.iban, "iban", cutoff, sub_day, df)
    return out.withColumn(
        "known_name_new_iban",
        (F.col("_first_pair") & (F.col("is_new_ref_name") == 0)).cast("int"),
    ).drop("_first_pair")


def row_features(df: DataFrame, tx: TransactionColumns) -> DataFrame:
    """Features that need no other row."""
    return (
        df.withColumns({
            "is_card_mobile": S.is_card_mobile(tx.method, tx.channel),
            "day_of_month": F.dayofmonth(tx.date),
            "day_of_week": S.day_of_week(tx.date),
            "month": F.month(tx.date),
        })
    )


def transaction_features(
    df: DataFrame, tx: TransactionColumns, cutoff: Column | None = None,
    hot_rows: int = HOT_ROWS, sub_day: str | None = None, pass_rows: int = PASS_ROWS,
) -> DataFrame:
    """All 21 features, strictly prior, one row per transaction. The ledger is read once and written; counts
    and features read the copy. Above pass_rows rows the recipients, the ibans and the series are passes of their own: each is
    written, then the files of the one before are removed. What the result reads and nothing else is in its _fieldledger_own."""
    df = passed(df, "ledger")
    passes = df.count() > pass_rows
    hot = hot_keys(df, tx.series, tx.amount, hot_rows)
    own = [df]
    out = counterparty_features(df, tx, cutoff, sub_day, own if passes else None)
    logs = [f"{c}_count_before" for c in ("ref_name", "iban")]
    out = out.drop(*(f"{c}_log" for c in logs))
    if passes and hot is None:
        out = passed(out, "counterparties", *own)
        own = [out]
    out = series_features(out, tx, cutoff, hot=hot, sub_day=sub_day, then=["iban_count_before"], own=own if hot is not None else ())
    # logarithms are taken behind the shuffles, where counts take a third of the bytes
    out = row_features(out.withColumns({f"{c}_log": F.log1p(c) for c in logs}), tx)
    if hot is None:
        out._fieldledger_own = own
    return out


def select_features(df: DataFrame, columns: Sequence[str] = FEATURE_COLUMNS) -> Column:
    """The ordered features as one array<double>, NaN and infinities replaced."""
    return F.array(*[S.nan_to_num(F.col(c).cast("double")) for c in columns])
