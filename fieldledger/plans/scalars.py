"""Queries over the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hyperparameters as H, noise as N, scalars as S
from ..operators import fields, prep
from ..sources import tables as T
from .common import KEY_SQL, LINE_KEY_SQL, flt, num, row_key, shape, tx_sql
from .registry import query

BITS = "4503599627370496::DOUBLE"


def hex_sql(key: str, start: int) -> str:
    return f"CAST('0x' || substr(md5({key}), {start}, 13) AS BIGINT)"


def uniform_sql(key: str) -> str:
    return f"({hex_sql(key, 1)} / {BITS})"


def normal_sql(key: str, slot="0", d="d") -> str:
    """Normal of (slot, d) for the row whose digest text is key."""
    count = f"(CAST({slot} AS BIGINT) * {N.SLOT} + {d} + 1) * {N.STRIDE}"

    def turn(x):
        return f"xor({x} >> 16, {x})"

    def uniform(start):
        x = f"((CAST('0x' || substr(md5({key}), {start}, 8) AS BIGINT) + {count}) & {N.MASK})"
        for _ in range(2):
            x = f"(({turn(x)} * {N.MIX}) & {N.MASK})"
        return turn(x)

    return (f"(sqrt(-2.0::DOUBLE * ln(({uniform(1)} + 0.5::DOUBLE) / 4294967296::DOUBLE))"
            f" * cos(2.0::DOUBLE * pi() * ({uniform(9)} / 4294967296::DOUBLE)))")


def _tx(spark, sf):
    return T.transactions(spark, sf).withColumn("row_key", row_key())


@query("series_key", tx_sql(f"SELECT {KEY_SQL} AS row_key, bank_account_uuid || '_' || ref_name AS series_id FROM tx"))
def series_key(spark, sf):
    return shape(_tx(spark, sf).withColumn("series_id", S.series_key("bank_account_uuid", "ref_name")),
                 ["row_key", "series_id"])


@query("year_month", tx_sql(f"SELECT {KEY_SQL} AS row_key, strftime(date_post, '%Y-%m') AS ym FROM tx"))
def year_month(spark, sf):
    return shape(_tx(spark, sf).withColumn("ym", S.year_month("date_post")), ["row_key", "ym"])


@query("calendar_parts", tx_sql(
    f"SELECT {KEY_SQL} AS row_key, {num('day(date_post)', 'dom')}, {num('isodow(date_post) - 1', 'dow')}, "
    f"{num('month(date_post)', 'mon')} FROM tx"))
def calendar_parts(spark, sf):
    return shape(_tx(spark, sf).withColumns({
        "dom": F.dayofmonth("date_post"), "dow": S.day_of_week("date_post"), "mon": F.month("date_post")}),
        ["row_key"], ["dom", "dow", "mon"])


@query("is_card_mobile", tx_sql(
    f"SELECT {KEY_SQL} AS row_key, "
    f"{num('''CASE WHEN pay_method = 'CARD' AND channel = 'MOBILE_APP' THEN 1 ELSE 0 END''', 'flag')} FROM tx"))
def is_card_mobile(spark, sf):
    return shape(_tx(spark, sf).withColumn("flag", S.is_card_mobile("pay_method", "channel")), ["row_key"], ["flag"])


@query("anomaly_label", tx_sql(
    f"SELECT {KEY_SQL} AS row_key, CAST(anomaly_description IS NOT NULL AS BIGINT) AS label FROM tx"))
def anomaly_label(spark, sf):
    return shape(_tx(spark, sf).withColumn("label", S.anomaly_label("anomaly_description")), ["row_key"], ["label"])


@query("anomaly_type", tx_sql(
    f"SELECT {KEY_SQL} AS row_key, split_part(anomaly_description, ':', 1) AS kind FROM tx "
    "WHERE anomaly_description IS NOT NULL"))
def anomaly_type(spark, sf):
    out = _tx(spark, sf).where(F.col("anomaly_description").isNotNull())
    return shape(out.withColumn("kind", S.anomaly_type("anomaly_description")), ["row_key", "kind"])


def _line(spark, sf):
    return T.table(spark, sf, "lineitem").withColumn("row_key", row_key("l_shipdate"))


@query("log1p_counts", f"SELECT {LINE_KEY_SQL} AS row_key, {flt('ln(1 + l_quantity)', 'a')}, "
       f"{flt('ln(1 + l_partkey)', 'b')}, {flt('ln(1 + l_suppkey)', 'c')} FROM lineitem")
def log1p_counts(spark, sf):
    return shape(_line(spark, sf).withColumns({
        "a": F.log1p("l_quantity"), "b": F.log1p("l_partkey"), "c": F.log1p("l_suppkey")}),
        ["row_key"], (), ["a", "b", "c"])


@query("clip_range", f"SELECT {LINE_KEY_SQL} AS row_key, "
       f"{flt('greatest(-10, least(10, l_quantity - 25))', 'z')}, "
       f"{flt('greatest(0, least(10, l_extendedprice / 7777 - 1))', 'ratio')} FROM lineitem")
def clip_range(spark, sf):
    return shape(_line(spark, sf).withColumns({
        "z": S.clip_range(F.col("l_quantity") - 25, -10, 10),
        "ratio": S.clip_range(F.col("l_extendedprice") / 7777 - 1, 0, 10)}), ["row_key"], (), ["z", "ratio"])


GAPS_SQL = ("CASE WHEN l_orderkey % 7 = 0 THEN 'NaN'::DOUBLE WHEN l_orderkey % 11 = 0 THEN 'Infinity'::DOUBLE "
            "WHEN l_orderkey % 13 = 0 THEN '-Infinity'::DOUBLE WHEN l_orderkey % 17 = 0 THEN NULL "
            "ELSE l_extendedprice END")


def _gaps(price="l_extendedprice"):
    k = F.col("l_orderkey")
    return (F.when(k % 7 == 0, F.lit(float("nan"))).when(k % 11 == 0, F.lit(float("inf")))
            .when(k % 13 == 0, F.lit(float("-inf"))).when(k % 17 == 0, F.lit(None)).otherwise(F.col(price)))


@query("nan_to_num", f"WITH g AS (SELECT {LINE_KEY_SQL} AS row_key, {GAPS_SQL} AS x FROM lineitem) "
       "SELECT row_key, CASE WHEN x IS NULL OR isnan(x) THEN 0.0::DOUBLE "
       "WHEN isinf(x) AND x > 0 THEN 1.7976931348623157e308::DOUBLE "
       "WHEN isinf(x) THEN -1.7976931348623157e308::DOUBLE ELSE x END AS x FROM g")
def nan_to_num(spark, sf):
    return _line(spark, sf).withColumn("x", _gaps()).select("row_key", S.nan_to_num(F.col("x")).alias("x"))


NAMES_SQL = ("CASE doc_id % 3 WHEN 0 THEN 'campaign_' WHEN 1 THEN 'business_dataset_' ELSE 'magic.gamma-2_' END "
             "|| source || '_' || lang || '.npz'")


def _names():
    k = F.col("doc_id") % 3
    head = F.when(k == 0, "campaign_").when(k == 1, "business_dataset_").otherwise("magic.gamma-2_")
    return F.concat(head, F.col("source"), F.lit("_"), F.col("lang"), F.lit(".npz"))


@query("dataset_display_name", f"""WITH d AS (SELECT doc_id, {NAMES_SQL} AS name FROM documents)
SELECT {num('doc_id')}, CASE WHEN contains(lower(name), 'campaign') THEN 'Campaign Dataset'
  WHEN contains(lower(name), 'business') THEN 'Business Dataset'
  ELSE array_to_string(list_transform(
    regexp_extract_all(replace(replace(name, '.npz', ''), '_', ' '), '\\pL+|\\PL+'),
    lambda r: upper(r[1]) || lower(r[2:])), '') END AS display FROM d""")
def dataset_display_name(spark, sf):
    out = T.table(spark, sf, "documents").withColumn("name", _names())
    return shape(out.withColumn("display", S.dataset_display_name("name")), ["display"], ["doc_id"])


RULES_SQL = "rules(priority, pattern, epochs, batch_size, learning_rate) AS (VALUES " + ", ".join(
    f"({i}, '{p}', {e}, {b}, {lr})" for i, (p, e, b, lr) in enumerate(H.RULES)) + ")"
PATTERN_LIST = "[" + ", ".join(f"'{p}'" for p, *_ in H.RULES) + ", 'unknown set']"
SET_NAME_SQL = f"'id_' || doc_id || '_' || upper(({PATTERN_LIST})[doc_id % {len(H.RULES) + 1} + 1]) || '.npz'"


def _set_names(spark, sf):
    patterns = F.array(*[F.lit(p) for p, *_ in H.RULES], F.lit("unknown set"))
    pick = patterns[(F.col("doc_id") % (len(H.RULES) + 1)).cast("int")]
    return T.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("id_"), F.col("doc_id"), F.lit("_"), F.upper(pick), F.lit(".npz")).alias("name"))


@query("hyperparameter_lookup", f"""WITH {RULES_SQL}, d AS (SELECT doc_id, {SET_NAME_SQL} AS name FROM documents),
hit AS (SELECT doc_id, min(priority) AS p FROM d JOIN rules ON contains(lower(name), pattern) GROUP BY doc_id)
SELECT {num('d.doc_id', 'doc_id')}, name, {num('epochs')}, {num('batch_size')}, {flt('learning_rate')}
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN rules ON p = priority""")
def hyperparameter_lookup(spark, sf):
    return shape(H.lookup_hyperparameters(_set_names(spark, sf), "name"), ["name"],
                 ["doc_id", "epochs", "batch_size"], ["learning_rate"])


@query("contains_join", f"""WITH {RULES_SQL},
hit AS (SELECT doc_id, min(priority) AS p FROM documents JOIN rules ON contains(lower(text), pattern) GROUP BY doc_id)
SELECT {num('doc_id')}, pattern, {num('epochs')} FROM hit JOIN rules ON p = priority""")
def contains_join(spark, sf):
    """Documents whose whole text contains a rule pattern, with the first such rule."""
    out = H.lookup_hyperparameters(T.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return shape(out.where(F.col("pattern").isNotNull()), ["pattern"], ["doc_id", "epochs"])


@query("time_grid", f"SELECT {num('p_partkey')}, {num('i')}, "
       f"{flt('0.001 + 0.999::DOUBLE * i / (p_size + 1)', 't', 10)} "
       "FROM (SELECT p_partkey, p_size, unnest(range(p_size + 2)) AS i FROM part)")
def time_grid(spark, sf):
    out = T.table(spark, sf, "part").select(
        "p_partkey", F.posexplode(S.time_grid(F.col("p_size") + 2, 0.001)).alias("i", "t"))
    return shape(out, (), ["p_partkey", "i"], ["t"], 10)


@query("sinusoidal_time_embedding", "SELECT " + ", ".join(
    [num("event_id")]
    + [flt(f"sin(value / 100 * exp(-ln(10000) * {i} / 4))", f"e{i}") for i in range(4)]
    + [flt(f"cos(value / 100 * exp(-ln(10000) * {i} / 4))", f"e{i + 4}") for i in range(4)]) + " FROM events")
def sinusoidal_time_embedding(spark, sf):
    out = T.events(spark, sf).withColumn("e", S.time_embedding(F.col("value") / 100, 8))
    return shape(out.select("event_id", *[F.col("e")[i].alias(f"e{i}") for i in range(8)]),
                 (), ["event_id"], [f"e{i}" for i in range(8)])


VP_T = "((user_id % 100) / 100.0::DOUBLE)"
VP_LOG = f"(-0.25 * {VP_T} * {VP_T} * 7.9 - 0.5 * {VP_T} * 0.1)"


@query("vp_marginal", f"SELECT {num('event_id')}, {flt(f'exp({VP_LOG}) * value', 'mean')}, "
       f"{flt(f'sqrt(1 - exp(2 * {VP_LOG}))', 'std')} FROM events")
def vp_marginal(spark, sf):
    t = (F.col("user_id") % 100) / F.lit(100.0)
    out = T.events(spark, sf).withColumns({"mean": S.vp_mean(t) * F.col("value"), "std": S.vp_std(t)})
    return shape(out, (), ["event_id"], ["mean", "std"])


@query("vp_drift_diffusion", f"SELECT {num('event_id')}, {flt(f'-0.5 * (0.1 + {VP_T} * 7.9) * value', 'drift')}, "
       f"{flt(f'sqrt(0.1 + {VP_T} * 7.9)', 'diffusion')} FROM events")
def vp_drift_diffusion(spark, sf):
    t = (F.col("user_id") % 100) / F.lit(100.0)
    out = T.events(spark, sf).withColumns({"drift": S.vp_drift(F.col("value"), t), "diffusion": S.vp_diffusion(t)})
    return shape(out, (), ["event_id"], ["drift", "diffusion"])


@query("vp_discrete_schedule", f"""WITH g AS (
  SELECT p_partkey, i, 0.1 / n + (8.0 - 0.1) / n * i / (n - 1) AS beta
  FROM (SELECT p_partkey, (p_size + 20)::DOUBLE AS n, unnest(range(p_size + 20)) AS i FROM part)),
c AS (SELECT *, exp(sum(ln(1 - beta)) OVER (PARTITION BY p_partkey ORDER BY i)) AS cum FROM g)
SELECT {num('p_partkey')}, {num('i')}, {flt('beta')}, {flt('cum')}, {flt('sqrt(cum)', 'sqrt_cum')},
  {flt('sqrt(1 - cum)', 'sqrt_1m_cum')} FROM c""")
def vp_discrete_schedule(spark, sf):
    out = fields.vp_schedule(T.table(spark, sf, "part").withColumn("n", F.col("p_size") + 20), ["p_partkey"], "n")
    return shape(out, (), ["p_partkey", "i"], ["beta", "cum", "sqrt_cum", "sqrt_1m_cum"])


NOISE_DIMS_SQL = ("v AS (SELECT vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS x1 "
                  "FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS d FROM embeddings)), "
                  f"p AS (SELECT *, {normal_sql('''concat_ws('|', vec_id, 'path')''')} AS x0, "
                  "0.05 * (vec_id % 20) AS t FROM v)")


def _paths(spark, sf, arrays):
    v = T.vectors(spark, sf).withColumn(
        "x0", N.normal_vector(F.size("features"), N.words(F.col("row_id").cast("string"), "path"), 0))
    v = v.withColumn("t", F.lit(0.05) * (F.col("row_id") % 20)).withColumns(arrays)
    zipped = F.arrays_zip(*[F.col(a) for a in arrays])
    return v.select(F.col("row_id").alias("vec_id"), F.posexplode(zipped).alias("d", "e")).select(
        "vec_id", "d", "e.*")


@query("flow_interpolate", f"WITH {NOISE_DIMS_SQL} SELECT {num('vec_id')}, {num('d')}, "
       f"{flt('t * x1 + (1 - t) * x0', 'xt')}, {flt('x1 - x0', 'target')} FROM p")
def flow_interpolate(spark, sf):
    out = _paths(spark, sf, {"xt": S.flow_interpolate(F.col("features"), F.col("x0"), F.col("t")),
                             "target": S.flow_target(F.col("features"), F.col("x0"))})
    return shape(out, (), ["vec_id", "d"], ["xt", "target"])


@query("vp_perturb", f"WITH {NOISE_DIMS_SQL}, q AS (SELECT *, -0.25 * t * t * 7.9 - 0.5 * t * 0.1 AS lm FROM p) "
       f"SELECT {num('vec_id')}, {num('d')}, {flt('exp(lm) * x1 + sqrt(1 - exp(2 * lm)) * x0', 'xt')}, "
       f"{flt('x0', 'target')} FROM q")
def vp_perturb(spark, sf):
    out = _paths(spark, sf, {"xt": S.vp_perturb(F.col("features"), F.col("x0"), F.col("t")), "target": F.col("x0")})
    return shape(out, (), ["vec_id", "d"], ["xt", "target"])


@query("contraction_path", f"WITH {NOISE_DIMS_SQL} SELECT {num('vec_id')}, {num('d')}, "
       f"{flt('(1 - t) * x1', 'xt')}, {flt('-(1 - t) * x1', 'field')} FROM p")
def contraction_path(spark, sf):
    xt = S.contraction_path(F.col("features"), F.col("t"))
    out = _paths(spark, sf, {"xt": xt, "field": F.transform(xt, lambda a: -a)})
    return shape(out, (), ["vec_id", "d"], ["xt", "field"])


@query("gaussian_noise", f"SELECT {LINE_KEY_SQL} AS row_key, "
       f"{flt(normal_sql(f'''concat_ws('|', {LINE_KEY_SQL}, 'noise', 7)''', '3', '1'), 'z')} FROM lineitem")
def gaussian_noise(spark, sf):
    out = _line(spark, sf).withColumn("z", N.hash_normal(N.words(F.col("row_key"), "noise", 7), F.lit(3), F.lit(1)))
    return shape(out, ["row_key"], (), ["z"])


@query("logits_to_labels", f"""WITH c AS (SELECT doc_id, n_chars / 1000.0::DOUBLE AS score, quality, toxic
  FROM labels JOIN documents USING (doc_id)),
m AS (SELECT *, exp(score) + exp(1.0::DOUBLE) + exp(2.0::DOUBLE * quality) AS total FROM c)
SELECT {num('doc_id')}, {flt('1 / (1 + exp(1 - score))', 'prob')},
  CAST(1 / (1 + exp(1 - score)) > 0.5 AS BIGINT) AS binary_label,
  {flt('exp(score) / total', 'p0')},
  CAST(CASE WHEN score >= 1 AND score >= 2 * quality THEN 0 WHEN 1 >= 2 * quality THEN 1 ELSE 2 END AS BIGINT) AS multi_label
FROM m""")
def logits_to_labels(spark, sf):
    logits = F.array(F.col("score"), F.lit(1.0), F.lit(2.0) * F.col("truth"))
    out = T.classified(spark, sf).withColumn("prob", S.sigmoid(F.col("score") - 1)).withColumns({
        "binary_label": S.binary_label(F.col("prob")), "p": S.softmax(logits)})
    return shape(out.withColumns({"p0": F.col("p")[0], "multi_label": S.argmax(F.col("p"))}),
                 (), ["doc_id", "binary_label", "multi_label"], ["prob", "p0"])


@query("business_day_roll", f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS due FROM orders)
SELECT {num('o_orderkey')}, CAST(CASE WHEN isodow(due) >= 6 THEN due + CAST(8 - isodow(due) AS INTEGER) ELSE due END AS VARCHAR) AS paid FROM d""")
def business_day_roll(spark, sf):
    due = F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int"))
    out = T.table(spark, sf, "orders").withColumn("due", due).withColumn("paid", S.business_day_roll(F.col("due")))
    return shape(out, ["paid"], ["o_orderkey"])


NOTE_SQL = ("CASE o_orderkey % 4 WHEN 0 THEN 'Invoice #' WHEN 1 THEN 'Inv. #' WHEN 2 THEN 'Payment for ' END "
            "|| 'INV-' || strftime(o_orderdate, '%Y-%m') || '-' || (o_orderkey + 1000) || ' (Term ' "
            "|| (15 * (1 + o_custkey % 4)) || 'd)'")


def invoice_notes(spark, sf):
    """orders with a payment note; every fourth order has another text."""
    k = F.col("o_orderkey") % 4
    head = F.when(k == 0, "Invoice #").when(k == 1, "Inv. #").when(k == 2, "Payment for ")
    note = F.concat(head, F.lit("INV-"), F.date_format("o_orderdate", "yyyy-MM"), F.lit("-"),
                    F.col("o_orderkey") + 1000, F.lit(" (Term "), F.lit(15) * (1 + F.col("o_custkey") % 4), F.lit("d)"))
    return T.table(spark, sf, "orders").withColumn("paym_note", F.coalesce(note, F.lit("REPAYMENT-URGENT")))


NOTES_SQL = f"n AS (SELECT *, coalesce({NOTE_SQL}, 'REPAYMENT-URGENT') AS paym_note FROM orders)"


def note_part(i: int) -> str:
    return f"TRY_CAST(regexp_extract(paym_note, 'INV-(\\d{{4}})-(\\d{{2}})-(\\d+) \\(Term (\\d+)d\\)', {i}) AS BIGINT)"


@query("invoice_note_parse", f"WITH {NOTES_SQL} SELECT {num('o_orderkey')}, {note_part(1)} AS inv_year, "
       f"{note_part(2)} AS inv_month, {note_part(3)} AS inv_counter, {note_part(4)} AS inv_term FROM n")
def invoice_note_parse(spark, sf):
    parts = S.invoice_note_parse("paym_note")
    return shape(invoice_notes(spark, sf).withColumns(parts), (), ["o_orderkey", *parts])


DEQ_KEY = f"concat_ws('|', {LINE_KEY_SQL}, 'l_quantity', 3, 0)"


@query("dequantize", f"SELECT {LINE_KEY_SQL} AS row_key, {flt(f'l_quantity + {uniform_sql(DEQ_KEY)} * 0.5', 'uniform')}, "
       f"{flt(f'l_quantity + {uniform_sql(DEQ_KEY)} - 0.5', 'beta')} FROM lineitem")
def dequantize(spark, sf):
    li = _line(spark, sf)
    one = prep.dequantize(li.withColumn("raw", F.col("l_quantity")), ["l_quantity"], "row_key", "uniform", 0.5, 3)
    one = one.withColumnRenamed("l_quantity", "uniform").withColumnRenamed("raw", "l_quantity")
    two = prep.dequantize(one, ["l_quantity"], "row_key", "beta", 1.0, 3)
    return shape(two.withColumnRenamed("l_quantity", "beta"), ["row_key"], (), ["uniform", "beta"])


@query("dequantize_beta", f"SELECT {LINE_KEY_SQL} AS row_key, {flt(f'l_quantity + pow(sin(pi() * {uniform_sql(DEQ_KEY)} / 2), 2) - 0.5', 'beta')} FROM lineitem")
def dequantize_beta(spark, sf):
    """Noise of Beta(1/2, 1/2), whose quantiles are squared sines."""
    out = prep.dequantize(_line(spark, sf), ["l_quantity"], "row_key", "beta", 0.5, 3)
    return shape(out.withColumnRenamed("l_quantity", "beta"), ["row_key"], (), ["beta"])


@query("requantize", f"SELECT {LINE_KEY_SQL} AS row_key, {flt(f'floor(l_quantity + {uniform_sql(DEQ_KEY)} * 0.5)', 'uniform')}, "
       f"{flt('round_even(l_quantity / 2, 0)', 'rounded')} FROM lineitem")
def requantize(spark, sf):
    li = _line(spark, sf).withColumn("rounded", F.col("l_quantity") / 2)
    noisy = prep.dequantize(li, ["l_quantity"], "row_key", "uniform", 0.5, 3)
    back = prep.requantize(prep.requantize(noisy, ["l_quantity"], "uniform"), ["rounded"], "round")
    return shape(back.withColumnRenamed("l_quantity", "uniform"), ["row_key"], (), ["uniform", "rounded"])
