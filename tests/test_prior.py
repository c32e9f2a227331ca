"""Strictly-prior features: hand cases and a row loop as twin, on plain and on chunked series."""

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from fieldledger.operators import prior
from fieldledger.streaming import features as stream

TX = prior.TransactionColumns(
    account="acc", name="name", iban="iban", swift="swift", method="method", channel="channel",
    date="d", amount="amount", ties=("k",))
SCHEMA = ("k long, acc string, name string, iban string, swift string, method string, channel string, "
          "d date, amount double, part int")


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(k, day, amount=100.0, acc="a", name="n", iban="i", swift="s", method="ACH", channel="API", month=1, part=0):
    return (k, acc, name, iban, swift, method, channel, dt.date(2024, month, day), float(amount), part)


def features(spark, rows, hot_rows, cutoff=None, sub_day=None):
    df = frame(spark, rows)
    hot = prior.hot_keys(df, TX.series, TX.amount, hot_rows)
    assert (hot is None) == (hot_rows > len(rows))
    out = prior.series_features(df, TX, cutoff, hot=hot, sub_day=sub_day)
    return {r["k"]: r.asDict() for r in out.collect()}


@pytest.mark.parametrize("hot_rows", [10**9, 1])
class TestSeries:
    def test_running_mode_tie_goes_to_the_value_seen_first(self, spark, hot_rows):
        got = features(spark, [row(i, i + 1, iban=v) for i, v in enumerate("ABBACA")], hot_rows)
        assert [got[i]["usual_iban"] for i in range(6)] == [None, "A", "A", "B", "A", "A"]

    def test_mode_within_one_day(self, spark, hot_rows):
        got = features(spark, [row(i, 5, iban=v) for i, v in enumerate("ABBACA")], hot_rows)
        assert [got[i]["usual_iban"] for i in range(6)] == [None, "A", "A", "B", "A", "A"]

    def test_prior_median_of_days(self, spark, hot_rows):
        # days in the order of payment, one month each
        days = [5, 6, 9, 1, 2, 3]
        got = features(spark, [row(i, d, month=i + 1) for i, d in enumerate(days)], hot_rows)
        medians = [None, 5, 5.5, 6, 5.5, 5]
        want = [0.0] + [abs(d - m) for d, m in zip(days[1:], medians[1:])]
        assert [got[i]["day_deviation_from_usual"] for i in range(6)] == want

    def test_one_prior_row_uses_a_tenth_of_the_mean(self, spark, hot_rows):
        got = features(spark, [row(0, 1, 100), row(1, 2, 120)], hot_rows)
        assert got[1]["amount_zscore_series"] == pytest.approx(2.0)
        assert got[1]["amount_ratio_to_mean"] == pytest.approx(1.2)

    def test_mean_of_zero_or_less(self, spark, hot_rows):
        got = features(spark, [row(0, 1, -100), row(1, 2, 50)], hot_rows)
        assert (got[1]["amount_zscore_series"], got[1]["amount_ratio_to_mean"]) == (0.0, 1.0)

    def test_equal_amounts_give_zero(self, spark, hot_rows):
        got = features(spark, [row(i, i + 1, 0.1) for i in range(5)] + [row(9, 20, 7.0)], hot_rows)
        assert got[9]["amount_zscore_series"] == 0.0

    def test_gap_restarts_after_the_cutoff(self, spark, hot_rows):
        rows = [row(0, 1), row(1, 4), row(2, 10), row(3, 11)]
        got = features(spark, rows, hot_rows, F.lit(dt.date(2024, 1, 4)))
        assert [got[i]["days_since_last_in_series"] for i in range(4)] == [30, 3, 30, 1]


def test_population_std_of_the_rows_before(spark):
    got = features(spark, [row(i, i + 1, a) for i, a in enumerate([5, 6, 9, 1, 2, 3])], 10**9)
    mean, sd = 20 / 3, 1.6997
    assert got[3]["amount_zscore_series"] == pytest.approx((1 - mean) / sd, rel=1e-4)


def random_rows(seed, n=150):
    rng = random.Random(seed)
    return [
        row(k, rng.randint(1, 28), round(rng.uniform(-5, 60), 2), rng.choice("ab"), rng.choice("nmo"),
            rng.choice("xyz"), rng.choice("pq"), rng.choice(["ACH", "CARD"]), rng.choice(["API", "MOBILE_APP"]),
            rng.randint(1, 3), 0)
        for k in range(n)
    ]


def loop(rows):
    """The features one row at a time."""
    states, names, ibans, pairs = {}, {}, {}, set()
    out = {}
    for r in sorted(rows, key=lambda r: (r[7], r[0])):
        k, acc, name, iban = r[:4]
        state = states.setdefault((acc, name), json.loads(stream.EMPTY))
        _, z, ratio, dev, mi, ms, mm, mc, month_n, new, n, gap = stream.advance(
            state, (k, r[7], r[8], iban, r[4], r[5], r[6]))
        out[k] = {
            "amount_zscore_series": z, "amount_ratio_to_mean": ratio, "day_deviation_from_usual": dev,
            "iban_mismatch": mi, "swift_mismatch": ms, "method_mismatch": mm, "channel_mismatch": mc,
            "tx_count_this_month_so_far": month_n, "is_new_series": new, "series_tx_count_before": n,
            "days_since_last_in_series": gap, "ref_name_count_before": names.get(name, 0),
            "iban_count_before": ibans.get(iban, 0), "is_new_ref_name": int(name not in names),
            "is_new_iban": int(iban not in ibans),
            "known_name_new_iban": int(name in names and (name, iban) not in pairs)}
        names[name] = names.get(name, 0) + 1
        ibans[iban] = ibans.get(iban, 0) + 1
        pairs.add((name, iban))
    return out


@pytest.mark.parametrize("seed,hot_rows,sub_day", [(1, 10**9, None), (2, 20, None), (3, 25, None), (4, 20, "sub")])
def test_against_the_row_loop(spark, seed, hot_rows, sub_day):
    rows = random_rows(seed)
    df = frame(spark, rows).repartition(5)
    if sub_day:  # finer chunks than a day, in the order of the tie key
        df = df.withColumn("sub", F.floor(F.col("k") / 40))
    got = prior.transaction_features(df, TX, None, hot_rows, sub_day)
    want = loop(rows)
    names = list(next(iter(want.values())))
    seen = 0
    for r in got.select("k", *names).collect():
        seen += 1
        for n in names:
            assert r[n] == pytest.approx(want[r["k"]][n], abs=1e-6), (r["k"], n)
    assert seen == len(rows)


def test_features_do_not_look_ahead(spark):
    rows = random_rows(7)
    cut = dt.date(2024, 2, 15)
    early = [r for r in rows if r[7] <= cut]
    full = prior.transaction_features(frame(spark, rows), TX).where(F.col("d") <= F.lit(cut))
    part = prior.transaction_features(frame(spark, early), TX)
    cols = ["k", *prior.FEATURE_COLUMNS]
    assert sorted(map(tuple, full.select(cols).collect())) == sorted(map(tuple, part.select(cols).collect()))


def test_missing_keys_can_be_hot(spark):
    df = frame(spark, [row(i, 1, name="n" if i % 2 else None) for i in range(20)] + [row(50, 1, name="rare")])
    hot = prior.hot_keys(df, TX.series, TX.amount, 3)
    assert sorted(r["_k1"] for r in hot.collect()) == ["", "=n"]
    assert prior.hot_keys(df, TX.series, TX.amount, 30) is None


def test_whole_and_chunked_series_agree_on_missing_values(spark):
    rng = random.Random(11)

    def maybe(value, odds=0.2):
        return None if rng.random() < odds else value

    rows = []
    for r in random_rows(12, 200):
        r = list(r)
        for i in (1, 2, 3, 4, 5, 6):
            r[i] = maybe(r[i])
        r[7], r[8] = maybe(r[7], 0.15), maybe(r[8])
        rows.append(tuple(r))
    df = frame(spark, rows).repartition(4)
    cut = F.lit(dt.date(2024, 2, 10))
    usual = [f"usual_{m}" for m in TX.modes]
    names = ["k", *prior.FEATURE_COLUMNS, *usual, "ref_name_count_before", "iban_count_before"]
    whole, chunked = (
        {r["k"]: r for r in prior.transaction_features(df, TX, cut, hot_rows).select(names).collect()} for hot_rows in (10**9, 1))
    assert len(whole) == len(chunked) == len(rows)
    for k, r in whole.items():
        for n in names:
            assert chunked[k][n] == (pytest.approx(r[n], abs=1e-9) if isinstance(r[n], float) else r[n]), (k, n)
    assert all(r["ref_name_count_before"] is not None and r["is_new_iban"] is not None for r in whole.values())


def test_stream_state_with_missing_values():
    rng = random.Random(5)
    rows = []
    for k, r in enumerate(random_rows(3, 40)):
        r = list(r)
        for i in (3, 4, 5, 6, 8):
            r[i] = None if rng.random() < 0.3 else r[i]
        rows.append((k, r[7], r[8], *r[3:7]))
    whole, saved, seen = json.loads(stream.EMPTY), stream.EMPTY, []
    for row in rows:
        state = json.loads(saved)  # every row after a reload
        one, two = stream.advance(whole, row), stream.advance(state, row)
        saved = json.dumps(state)
        assert one == two and json.loads(saved) == json.loads(json.dumps(whole))
        for mismatch, place, mode in zip(two[4:8], range(3, 7), range(4)):
            counts = {}
            for i, r in enumerate(seen):
                counts.setdefault(r[place], [0, -i])[0] += 1
            usual = max(counts, key=lambda v: counts[v]) if counts else None
            assert mismatch == int(bool(seen) and row[place] != usual)
        seen.append(row)


def test_stream_equals_batch_on_missing_values(spark):
    rng = random.Random(21)
    rows = []
    for r in random_rows(8, 60):
        r = list(r)
        for i in (3, 5, 8):
            r[i] = None if rng.random() < 0.25 else r[i]
        rows.append(tuple(r))
    got = prior.series_features(frame(spark, rows), TX).collect()
    names = ["amount_zscore_series", "amount_ratio_to_mean", "day_deviation_from_usual", "iban_mismatch", "swift_mismatch",
             "method_mismatch", "channel_mismatch", "tx_count_this_month_so_far", "is_new_series", "series_tx_count_before",
             "days_since_last_in_series"]
    states = {}
    for r in sorted(got, key=lambda r: (r["d"], r["k"])):
        state = states.setdefault((r["acc"], r["name"]), json.loads(stream.EMPTY))
        out = stream.advance(state, (r["k"], r["d"], r["amount"], r["iban"], r["swift"], r["method"], r["channel"]))
        for n, v in zip(names, out[1:]):
            assert (v is None) == (r[n] is None) and (v is None or r[n] == pytest.approx(v, abs=1e-6)), (r["k"], n)


def wide_exchanges(df) -> int:
    """Shuffles that carry the rows themselves: their input holds a column that no total has."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum("part#" in columns for columns in re.findall(r"Exchange *\nInput \[\d+\]: \[([^\]]*)\]", plan))


def test_rows_are_shuffled_once_per_kind_of_key(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = prior.cut_lineage(frame(spark, [row(i, i % 28 + 1, iban=f"i{i % 3}") for i in range(40)]))
        assert wide_exchanges(prior.counterparty_features(df, TX)) == 2
        hot = prior.hot_keys(df, TX.series, TX.amount, 3)
        # joined to the large series, for small and large ones; then by series or by chunk
        assert wide_exchanges(prior.series_state(df, TX, hot=hot)) <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_passes_give_the_same_rows_and_remove_what_they_read(spark):
    from fieldledger import session

    rows = random_rows(31, 120)
    df = frame(spark, rows + rows[:5])  # some rows come twice
    names = ["k", *prior.FEATURE_COLUMNS]
    want = sorted(map(tuple, prior.transaction_features(df, TX).select(names).collect()))
    for hot_rows, left in ((10**9, ["counterparties", "hot-keys"]), (1, ["chunks", "hot-keys", "series"])):
        before = len(session._WRITTEN)
        out = prior.transaction_features(df, TX, None, hot_rows, pass_rows=0)
        assert sorted(re.sub("-[0-9a-f]{32}$", "", path.rsplit("/", 1)[1]) for _, path in session._WRITTEN[before:]) == left
        got = sorted(map(tuple, out.select(names).collect()))
        assert len(got) == len(want) and all(a == pytest.approx(b, abs=1e-9) for a, b in zip(got, want))


@pytest.mark.parametrize("gathered", [True, False])
def test_rows_of_chunks_are_shuffled_once(spark, gathered, monkeypatch):
    """Whether or not a series is too large for its counts to be put together in one task."""
    monkeypatch.setattr(prior, "HOT_ROWS", 10**9 if gathered else 1)
    df = frame(spark, random_rows(32, 90))
    hot = prior.hot_keys(df, TX.series, TX.amount, 1)
    out = prior.series_features(df, TX, hot=hot)
    want = {r["k"]: r for r in prior.series_features(df, TX).collect()}
    assert wide_exchanges(out) <= 2  # by chunk, and the small series by series
    for r in out.collect():
        for n in ("usual_iban", "usual_channel", "day_deviation_from_usual", "days_since_last_in_series", "series_tx_count_before"):
            assert r[n] == want[r["k"]][n], (r["k"], n)
