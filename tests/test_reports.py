import datetime as dt
import random

import pytest

from fieldledger.operators import reports as R
from fieldledger.operators.prior import TransactionColumns

TX = TransactionColumns(account="acc", name="name", iban="iban", swift="swift", method="method", channel="channel", date="date",
                        amount="amount", ties=("id",))
SCHEMA = "id long, acc string, name string, iban string, swift string, method string, channel string, date date, amount double, n long, mean string, kind string"
SERIES = [("a", "x"), ("a", None), (None, "x"), (None, None), ("b", "y")]


def ledger(spark, seed=1, per=40):
    draw, rows, at = random.Random(seed), [], 0
    for acc, name in SERIES:
        day = dt.date(2024, 1, 5)
        for i in range(per):
            day += dt.timedelta(days=draw.choice([0, 0, 1, 9, 28, 31]))
            amount = 1000.0 if i % 17 == 3 else draw.choice([1.0, 2.0, 50.0, 60.0, 70.0, 80.0, 90.0])
            rows.append((at, acc, name, "i", "s", "m", "c", day, amount, 7, "u", "u"))
            at += 1
    draw.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4), sorted(rows, key=lambda r: (r[7], r[0]))


def by_series(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1:3], []).append(r)
    return out


def test_amount_changes_keep_missing_keys_and_own_names(spark):
    df, rows = ledger(spark)
    want = set()
    for own in by_series(rows).values():
        a = [r[8] for r in own]
        m = sum(a) / len(a)
        s = (sum((x - m) ** 2 for x in a) / len(a)) ** 0.5
        want |= {r[0] for r in own if abs(r[8] - m) > 2 * s}
    got = R.recurring_amount_change(df, TX)
    assert {r["id"] for r in got.collect()} == want and got.columns.count("n") == 1
    assert {(r["acc"], r["name"]) for r in got.collect()} == set(SERIES)


def median(v):
    v = sorted(v)
    return (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def runs(flags):
    """(first, last) of the runs of true flags."""
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        if not f and start is not None:
            out.append((start, i - 1))
            start = None
    return out


def test_day_shifts_and_their_runs(spark):
    df, rows = ledger(spark, 2)
    want, want_runs = {}, []
    for key, own in by_series(rows).items():
        m = median([r[7].day for r in own])
        shifted = [abs(r[7].day - m) > 7 for r in own]
        for i, r in enumerate(own):
            if shifted[i]:
                want[r[0]] = "persistent" if i and shifted[i - 1] else "one-off"
        want_runs += [(*key, n, own[a][7], own[b][7], b - a + 1, "persistent" if b > a else "one-off") for n, (a, b) in enumerate(runs(shifted), 1)]
    assert {r["id"]: r["kind"] for r in R.payment_day_shift(df, TX).collect()} == want
    assert sorted(map(str, map(tuple, R.day_shift_runs(df, TX).collect()))) == sorted(map(str, want_runs))


def test_small_payments_and_their_runs(spark):
    df, rows = ledger(spark, 3)
    cuts = {}
    for acc in {r[1] for r in rows}:
        a = sorted(r[8] for r in rows if r[1] == acc)
        h = 0.1 * (len(a) - 1)
        cuts[acc] = a[int(h)] + (a[min(int(h) + 1, len(a) - 1)] - a[int(h)]) * (h - int(h))
    want, want_runs = {}, []
    for key, own in by_series(rows).items():
        small = [r[8] <= cuts[r[1]] for r in own]
        if any(small):
            want[key] = (len(own), sum(small))
        want_runs += [(*key, n, own[a][7], own[b][7], b - a + 1, "persistent" if b > a else "one-off") for n, (a, b) in enumerate(runs(small), 1)]
    got = R.small_payment_patterns(df, TX).collect()
    assert {(r["acc"], r["name"]): (r["payments"], r["small"]) for r in got} == want and len(want) == 5
    assert sorted(map(str, map(tuple, R.small_payment_runs(df, TX).collect()))) == sorted(map(str, want_runs))


@pytest.mark.parametrize("report", [R.recurring_amount_change, R.small_payment_patterns, R.payment_day_shift, R.day_shift_runs, R.small_payment_runs])
def test_empty_ledger(spark, report):
    assert report(spark.createDataFrame([], SCHEMA), TX).count() == 0


def test_day_shift_by_days_equals_a_row_loop(spark):
    """Missing names, dates, several payments a day; the ledger is read twice, for its days and for its rows."""
    import datetime as dt
    import random
    import statistics

    from fieldledger.operators.prior import TransactionColumns

    tx = TransactionColumns(account="acc", name="name", iban="name", swift="name", method="name", channel="name", date="date", amount="amount", ties=("id",))
    draw = random.Random(5)
    rows = [(i, draw.choice("ab"), draw.choice(["x", "y", None]), None if draw.random() < 0.1 else dt.date(2024, draw.randint(1, 3), draw.choice(
        [1, 2, 14, 15, 16, 28])), 1.0) for i in range(150)] + [(900, "c", "x", dt.date(2024, 1, 1), 1.0)]
    want, runs, series = [], [], {}
    for r in rows:
        series.setdefault((r[1], r[2]), []).append(r)
    for (acc, name), own in series.items():
        own.sort(key=lambda r: (r[3] is not None, r[3] or dt.date.min, r[0]))
        days = [r[3].day for r in own if r[3] is not None]
        before, run = 0, None
        for r in own:
            shifted = int(len(own) > 1 and r[3] is not None and abs(r[3].day - middle(days, own)) > 7)
            if shifted:
                want.append((r[0], "persistent" if before else "one-off"))
                if not before:
                    run = [acc, name, sum(x[:2] == [acc, name] for x in runs) + 1, r[3], r[3], 0]
                    runs.append(run)
                run[4], run[5] = r[3], run[5] + 1
            before = shifted
    assert statistics.mean(len(v) for v in series.values()) > 10
    df = spark.createDataFrame(rows, "id long, acc string, name string, date date, amount double").repartition(3)
    out = R.payment_day_shift(df, tx)
    assert sorted((r["id"], r["kind"]) for r in out.collect()) == sorted(want)
    assert out.select("id", "kind")._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") <= 2
    got = [tuple(r) for r in R.day_shift_runs(df, tx).collect()]
    assert sorted(got, key=str) == sorted([(*r, "persistent" if r[5] > 1 else "one-off") for r in runs], key=str)


def middle(days, own):
    """The median by ranks over all rows of the series, of which those without a date come first and have no day."""
    order = [None] * (len(own) - len(days)) + sorted(days)

    def at(rank):
        return order[rank] if order[rank] is not None else sorted(days)[0]

    return (at((len(own) - 1) // 2) + at(len(own) // 2)) / 2
