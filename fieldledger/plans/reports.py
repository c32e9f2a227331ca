"""Queries over anomaly injection and the analyst reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import inject as J, reports as R
from ..sources import tables as T
from .common import KEY_SQL, flt, num, row_key, shape, tx_sql, txt
from .registry import query
from .scalars import NOTES_SQL, invoice_notes, note_part


def ledger(spark, sf):
    return T.transactions(spark, sf).withColumns({
        "row_key": row_key(), "paym_note": F.lit("regular"), "ref_bank": F.lit("US")})


PICK_SQL = f"""hx AS (SELECT *, {KEY_SQL} AS row_key, 'regular' AS paym_note, 'US' AS ref_bank,
    md5(concat_ws('|', {KEY_SQL}, 'inject', 0)) AS h FROM tx),
pk AS (SELECT *, h = min(h) OVER (PARTITION BY bank_account_uuid, ref_name) AS pick FROM hx)"""
OUT = ["row_key", "date_post", "ref_name", "ref_iban", "ref_swift", "ref_bank", "pay_method", "channel", "paym_note",
       "anomaly_description"]
IBAN = "'GB' || translate(substr(h, 1, 20), '0123456789abcdef', '0123456789012345')"


def letters(start, n):
    return f"translate(substr(h, {start}, {n}), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"


def number(n):
    return f"CAST('0x' || substr(h, 1, 8) AS BIGINT) % {n}"


SUBTLE = ("(CASE WHEN contains(ref_name, 'Solutions') THEN replace(ref_name, 'Solutions', 'Systems') "
          "WHEN contains(ref_name, 'Cloud') THEN replace(ref_name, 'Cloud', 'Core') "
          "ELSE split_part(ref_name, ' ', 1) || ' Ventures' END)")
CHANGES = {
    "amount": {"amount": f"round_even(amount * ([1.5::DOUBLE, 1.8::DOUBLE, 2.0::DOUBLE])[{number(3)} + 1] * 100, 0) / 100",
               "anomaly_description": "'AMOUNT_ANOMALY: Amount changed from ~' || CAST(round_even(amount, 0) AS BIGINT)"},
    "payee": {"ref_name": f"'Payee ' || {letters(1, 8)} || ' Ltd.'", "ref_bank": letters(9, 2), "ref_iban": IBAN,
              "ref_swift": letters(11, 11), "anomaly_description": "'PAYEE_ANOMALY: Payee changed from ' || ref_name"},
    "timing": {"date_post": "make_date(year(date_post), month(date_post), (day(date_post) + 10) % 28 + 1)",
               "anomaly_description": "'TIMING_ANOMALY: Payment date shifted from day ~' || day(date_post) || ' to ' || ((day(date_post) + 10) % 28 + 1)"},
    "channel": {"pay_method": "'CARD'", "channel": "'MOBILE_APP'",
                "anomaly_description": "'CHANNEL_ANOMALY: Payment made via CARD/MOBILE_APP instead of ' || pay_method || '/' || channel"},
    "iban_mismatch": {"ref_iban": IBAN,
                      "anomaly_description": f"'IBAN_MISMATCH_ANOMALY: IBAN changed from ' || substr(ref_iban, 1, 10) || '... to ' || substr({IBAN}, 1, 10) || '...'"},
    "subtle_payee": {"ref_name": SUBTLE, "ref_iban": IBAN,
                     "anomaly_description": f"'SUBTLE_PAYEE_MISMATCH: Payee changed from ''' || ref_name || ''' to ''' || {SUBTLE} || ''''"},
}


def inject_sql(kind: str) -> str:
    if kind == "frequency":
        cols = ", ".join(txt(c) for c in OUT)
        extra = {"date_post": f"make_date(year(date_post), month(date_post), CAST((day(date_post) + 7 + {number(9)}) % 28 + 1 AS BIGINT))",
                 "paym_note": "'REPAYMENT-URGENT'", "anomaly_description": "'FREQUENCY_ANOMALY: Duplicate monthly payment'"}
        added = ", ".join(txt(extra.get(c, c), c) for c in OUT)
        return tx_sql(f", {PICK_SQL} SELECT {cols}, {flt('amount')} FROM pk UNION ALL SELECT {added}, {flt('amount')} FROM pk WHERE pick")
    ch = CHANGES[kind]

    def col(c):
        return f"CASE WHEN pick THEN {ch[c]} ELSE {c} END" if c in ch else c

    cols = ", ".join(txt(col(c), c) for c in OUT)
    return tx_sql(f", {PICK_SQL} SELECT {cols}, {flt(col('amount'), 'amount')} FROM pk")


def _inject(kind):
    @query(f"inject_{kind}", inject_sql(kind))
    def run(spark, sf):
        return shape(J.inject(ledger(spark, sf), kind, T.TX, "row_key"), OUT, (), ["amount"])

    return run


for _kind in J.KINDS:
    _inject(_kind)

SERIES = ["bank_account_uuid", "ref_name"]
PART = "PARTITION BY bank_account_uuid, ref_name"


@query("customer_overview", tx_sql(f"""SELECT bank_account_uuid, {num('count(*)', 'n')}, {flt('sum(amount)', 'total', 2)},
{txt('min(date_post)', 'first_date')}, {txt('max(date_post)', 'last_date')}, {num('count(DISTINCT ref_name)', 'recipients')},
{num('count(DISTINCT channel)', 'channels')} FROM tx GROUP BY bank_account_uuid"""))
def customer_overview(spark, sf):
    out = R.customer_overview(T.transactions(spark, sf), T.TX)
    return shape(out, ["bank_account_uuid", "first_date", "last_date"], ["n", "recipients", "channels"], ["total"], 2)


@query("recurring_amount_change", tx_sql(f"""SELECT {KEY_SQL} AS row_key, {num('n')}, {flt('(amount - m) / s', 'deviation')} FROM
(SELECT *, count(*) OVER ({PART}) AS n, avg(amount) OVER ({PART}) AS m, stddev_pop(amount) OVER ({PART}) AS s FROM tx)
WHERE n > 1 AND s > 0 AND abs((amount - m) / s) > 2"""))
def recurring_amount_change(spark, sf):
    return shape(R.recurring_amount_change(ledger(spark, sf), T.TX), ["row_key"], ["n"], ["deviation"])


FREQ = ["payments", "active_months", "span_months", "duplicate_months", "most_in_month"]


@query("payment_frequency_change", tx_sql(f""", m AS (SELECT bank_account_uuid, ref_name,
  date_trunc('month', CASE WHEN day(date_post) <= 3 THEN date_post - 3 ELSE date_post END) AS mo, count(*) AS n FROM tx GROUP BY ALL),
s AS (SELECT bank_account_uuid, ref_name, sum(n) AS payments, count(*) AS active_months,
  date_diff('month', min(mo), max(mo)) + 1 AS span_months, count(*) FILTER (n > 1) AS duplicate_months, max(n) AS most_in_month FROM m GROUP BY ALL)
SELECT bank_account_uuid, ref_name, {', '.join(num(c) for c in FREQ)} FROM s WHERE payments > 1 AND payments <> span_months"""))
def payment_frequency_change(spark, sf):
    return shape(R.payment_frequency_change(T.transactions(spark, sf), T.TX), SERIES, FREQ)


SMALL = ["payments", "small", "most_small_in_month", "sequential", "only_small", "surge"]


@query("small_payment_patterns", tx_sql(f""", c AS (SELECT bank_account_uuid, quantile_cont(amount, 0.1) AS q FROM tx GROUP BY ALL),
r AS (SELECT tx.*, amount <= q AS sm, date_trunc('month', date_post) AS mo FROM tx JOIN c USING (bank_account_uuid)),
l AS (SELECT *, lag(amount) OVER (PARTITION BY bank_account_uuid, ref_name, mo ORDER BY tx_id) AS pv FROM r WHERE sm),
m AS (SELECT bank_account_uuid, ref_name, mo, count(*) AS ns, count(*) FILTER (abs(amount - pv) <= 1) AS sq FROM l GROUP BY ALL),
s AS (SELECT bank_account_uuid, ref_name, sum(ns) AS small, max(ns) AS most_small_in_month, avg(ns) AS av, sum(sq) AS sequential FROM m GROUP BY ALL),
n AS (SELECT bank_account_uuid, ref_name, count(*) AS payments FROM tx GROUP BY ALL),
f AS (SELECT *, CAST(small = payments AS BIGINT) AS only_small, CAST(most_small_in_month >= 2 AND most_small_in_month > 1.5 * av AS BIGINT) AS surge FROM s JOIN n USING (bank_account_uuid, ref_name))
SELECT bank_account_uuid, ref_name, {', '.join(num(c) for c in SMALL)} FROM f"""))
def small_payment_patterns(spark, sf):
    return shape(R.small_payment_patterns(T.transactions(spark, sf), T.TX), SERIES, SMALL)


@query("rare_payment_channels", tx_sql(f"""SELECT bank_account_uuid, pay_method, channel, {num('n')}, {flt('n / t', 'share')}, {num('CAST(n / t < 0.05 AS BIGINT)', 'rare')}
FROM (SELECT *, sum(n) OVER (PARTITION BY bank_account_uuid)::DOUBLE AS t FROM
  (SELECT bank_account_uuid, pay_method, channel, count(*) AS n FROM tx GROUP BY ALL))"""))
def rare_payment_channels(spark, sf):
    out = R.rare_payment_channels(T.transactions(spark, sf), T.TX)
    return shape(out, ["bank_account_uuid", "pay_method", "channel"], ["n", "rare"], ["share"])


@query("iban_changes", tx_sql(f"""SELECT {KEY_SQL} AS row_key, previous_iban, ref_iban, {num('levenshtein(previous_iban, ref_iban)', 'distance')}
FROM (SELECT *, lag(ref_iban) OVER ({PART} ORDER BY tx_id) AS previous_iban FROM tx) WHERE previous_iban <> ref_iban"""))
def iban_changes(spark, sf):
    return shape(R.iban_changes(ledger(spark, sf), T.TX), ["row_key", "previous_iban", "ref_iban"], ["distance"])


@query("new_recipient_similar_name", tx_sql(""", n AS (SELECT bank_account_uuid, ref_name || ' ' || ref_iban || ' ' || ref_swift AS nm, count(*) AS n FROM tx GROUP BY ALL)
SELECT a.bank_account_uuid, a.nm AS one_off, b.nm AS recurring FROM n a JOIN n b ON a.bank_account_uuid = b.bank_account_uuid
AND a.n = 1 AND b.n > 1 AND abs(len(a.nm) - len(b.nm)) <= 1 AND levenshtein(a.nm, b.nm) = 1"""))
def new_recipient_similar_name(spark, sf):
    tx = T.transactions(spark, sf).withColumn("ref_name", F.concat_ws(" ", "ref_name", "ref_iban", "ref_swift"))
    return shape(R.new_recipient_similar_name(tx, T.TX), ["bank_account_uuid", "one_off", "recurring"])


@query("payment_day_shift", tx_sql(f""", m AS (SELECT *, quantile_cont(day(date_post), 0.5) OVER ({PART}) AS md, count(*) OVER ({PART}) AS n FROM tx),
s AS (SELECT *, CAST(abs(day(date_post) - md) > 7 AS BIGINT) AS sh FROM m WHERE n > 1),
l AS (SELECT *, lag(sh) OVER ({PART} ORDER BY tx_id) AS pv FROM s)
SELECT {KEY_SQL} AS row_key, {flt('md', 'median_day')}, CASE WHEN pv = 1 THEN 'persistent' ELSE 'one-off' END AS kind FROM l WHERE sh = 1"""))
def payment_day_shift(spark, sf):
    out = R.payment_day_shift(T.transactions(spark, sf), T.TX).withColumn("row_key", row_key())  # its parts travel as ties
    return shape(out, ["row_key", "kind"], (), ["median_day"])


def runs_sql(rows: str) -> str:
    """Runs of rows with sh = 1 in `rows`, a query with bank_account_uuid, ref_name, tx_id, date_post, sh."""
    return f"""i AS (SELECT *, sum(1 - sh) OVER ({PART} ORDER BY tx_id ROWS UNBOUNDED PRECEDING) AS island FROM ({rows})),
g AS (SELECT bank_account_uuid, ref_name, island, min(date_post) AS start_date, max(date_post) AS end_date, count(*) AS length FROM i WHERE sh = 1 GROUP BY ALL)
SELECT bank_account_uuid, ref_name, {num(f'row_number() OVER ({PART} ORDER BY island)', 'run')}, {txt('start_date')}, {txt('end_date')}, {num('length')},
  CASE WHEN length > 1 THEN 'persistent' ELSE 'one-off' END AS kind FROM g"""


def _runs(out):
    return shape(out, [*SERIES, "start_date", "end_date", "kind"], ["run", "length"])


@query("payment_day_shift_runs", tx_sql(f""", m AS (SELECT *, quantile_cont(day(date_post), 0.5) OVER ({PART}) AS md, count(*) OVER ({PART}) AS n FROM tx),
{runs_sql('SELECT *, CAST(abs(day(date_post) - md) > 7 AS BIGINT) AS sh FROM m WHERE n > 1')}"""))
def payment_day_shift_runs(spark, sf):
    return _runs(R.day_shift_runs(T.transactions(spark, sf), T.TX))


@query("small_payment_runs", tx_sql(f""", c AS (SELECT bank_account_uuid, quantile_cont(amount, 0.1) AS q FROM tx GROUP BY ALL),
{runs_sql('SELECT tx.*, CAST(amount <= q AS BIGINT) AS sh FROM tx JOIN c USING (bank_account_uuid)')}"""))
def small_payment_runs(spark, sf):
    return _runs(R.small_payment_runs(T.transactions(spark, sf), T.TX))


@query("invoice_period_mismatch", f"""WITH {NOTES_SQL}, p AS (SELECT *, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 75 AS INTEGER) AS posted,
{note_part(1)} AS iy, {note_part(2)} AS im, {note_part(4)} AS term FROM n),
d AS (SELECT *, date_diff('month', make_date(iy, im, 1), date_trunc('month', posted - CAST(term AS INTEGER))) AS off FROM p WHERE iy IS NOT NULL)
SELECT {num('o_orderkey')}, {txt('posted')}, {num('off', 'months_off')} FROM d WHERE off <> 0""")
def invoice_period_mismatch(spark, sf):
    posted = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 75).cast("int"))
    rows = invoice_notes(spark, sf).withColumn("posted", posted)
    out = R.invoice_period_mismatch(rows, "posted", S.invoice_note_parse("paym_note"))
    return shape(out, ["posted"], ["o_orderkey", "months_off"])
