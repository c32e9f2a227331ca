"""Queries over the contamination study, tree and network learners, the model cache, streams and
the flagship report of top anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import experiment as X, fields as M, learners as L, metrics, prep, prior, splits
from ..session import passed, remove, scratch_path
from ..sources import tables as T
from ..streaming import features as SF, ledger as SL, scoring
from .common import FLOAT_FEATURES, INT_FEATURES, KEY_SQL, LINE_KEY_SQL, features_sql, flt, num, row_key, shape
from .features import all_features
from .fields import CONTRACTION, FLOW, bin_sql, field_join, fit_sql, fitted, levels_sql, score_sql
from .metrics import SCORED_SQL, cuts_sql
from .registry import query
from .scalars import normal_sql
from .splits import CONTAM_SQL

def _sweep_scores_sql() -> str:
    """sc(score_kind, vec_id, label, level_idx, level, score): the three scores of a contraction field per level. It has no noise, so
    the seeds do not differ."""
    spec, h = CONTRACTION, 1.0 / (CONTRACTION.n_t - 1)
    levels = [(i, i / (spec.n_t - 1)) for i in M.score_levels(spec, "deviation")]
    parts, prev = [], "st"
    for s in range(spec.n_t - 1):
        parts.append(f"e{s} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (CASE WHEN t_idx + {s} < {spec.n_t - 1} THEN xt + {h!r}::DOUBLE * f ELSE xt END AS xt) "
                     f"FROM {field_join(prev, 'q.xt', spec, '0', 'q.level_idx')})")
        prev = f"e{s}"
    return f"""{CONTAM_SQL},
v AS (SELECT vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS x FROM (SELECT *, unnest(range(len(embedding))) AS d FROM embeddings)),
rg AS (SELECT d, avg(x) AS mu, CASE WHEN max(x) > min(x) THEN stddev_pop(x) ELSE 1 END AS sd FROM v JOIN tr USING (vec_id) WHERE label = 0 GROUP BY d),
z AS (SELECT vec_id, d, (x - mu) / sd AS zs FROM v JOIN rg USING (d)),
lg AS (SELECT level_idx AS lab, 0 AS t_idx, d, zs AS xt, -zs AS y FROM z JOIN contaminated USING (vec_id)),
cell AS MATERIALIZED (SELECT lab, t_idx, d, {bin_sql('xt', spec)} AS bin, avg(y) AS f FROM lg GROUP BY ALL),
every AS MATERIALIZED (SELECT lab, t_idx, d, avg(y) AS f FROM lg GROUP BY ALL),
te AS MATERIALIZED (SELECT vec_id, label, level_idx, level, d, zs FROM half JOIN z USING (vec_id), levels WHERE split = 'test'),
st AS MATERIALIZED (SELECT te.*, t_idx, a * zs AS xt FROM te, {levels_sql(spec, levels)}), {', '.join(parts)},
sc AS MATERIALIZED (SELECT 'decision' AS score_kind, vec_id, label, level_idx, level, sqrt(sum((f + zs) * (f + zs))) AS score
    FROM {field_join('te', 'q.zs', spec, '0', 'q.level_idx')} GROUP BY ALL
  UNION ALL SELECT 'deviation', vec_id, label, level_idx, level, sum((xt + f) * (xt + f)) FROM {field_join('st', 'q.xt', spec, '0', 'q.level_idx')} GROUP BY ALL
  UNION ALL SELECT 'reconstruction', vec_id, label, level_idx, level, sum(xt * xt) FROM {prev} GROUP BY ALL)"""


SWEEP_SQL = f"""WITH {_sweep_scores_sql()},
ra AS (SELECT *, rank() OVER (PARTITION BY score_kind, level_idx ORDER BY score) + (count(*) OVER (PARTITION BY score_kind, level_idx, score) - 1) / 2.0::DOUBLE AS r,
  rank() OVER (PARTITION BY score_kind, level_idx ORDER BY score DESC) + count(*) OVER (PARTITION BY score_kind, level_idx, score) - 1 AS seen FROM sc),
rb AS (SELECT *, sum(label) OVER (PARTITION BY score_kind, level_idx ORDER BY score DESC) AS tp FROM ra)
SELECT score_kind, {num('level_idx')}, {flt('level')}, {num('5', 'n_seeds')},
  {flt('(sum(r) FILTER (label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label)::DOUBLE * sum(1 - label))', 'auroc_mean', 5)},
  {flt('sum(label * tp / seen) / sum(label)', 'auprc_mean', 5)}, {flt('0', 'auroc_std')}, {flt('0', 'auprc_std')} FROM rb GROUP BY score_kind, level_idx, level"""


@query("contamination_sweep", SWEEP_SQL)
def contamination_sweep(spark, sf):
    """All three scores of a contraction field at ten levels over five seeds."""
    out = X.sweep(T.vectors(spark, sf), "row_id", "features", "label", CONTRACTION)
    return shape(out, ["score_kind"], ["level_idx", "n_seeds"], ["level", "auroc_std", "auprc_std"]).join(
        shape(out, ["score_kind"], ["level_idx"], ["auroc_mean", "auprc_mean"], 5), ["score_kind", "level_idx"])


SWEEP_CASES_SQL = f"""WITH {cuts_sql('score_kind, level_idx, ').replace(SCORED_SQL, _sweep_scores_sql())}
SELECT score_kind, CASE level_idx WHEN 0 THEN 'no_contamination' ELSE 'full_contamination' END AS "case", {flt('percentile', digits=4)}, {num('5', 'n_seeds')},
  {', '.join(flt(c, c + '_mean', 4) for c in ('f1', 'precision', 'recall', 'accuracy'))} FROM tm WHERE level_idx IN (0, 9)"""


@query("contamination_sweep_thresholds", SWEEP_CASES_SQL)
def contamination_sweep_thresholds(spark, sf):
    """Metrics at the percentile thresholds of the study's own scores, at its first and last level."""
    scored, _ = X.score_grid(T.vectors(spark, sf), "row_id", "features", "label", CONTRACTION)
    out = X.sweep_thresholds(X.cut_lineage(scored, "scored"), "label")
    return shape(out, ["score_kind", "case"], ["n_seeds"], ["percentile", "f1_mean", "precision_mean", "recall_mean", "accuracy_mean"], 4)


@query("contamination_sweep_flow")
def contamination_sweep_flow(spark, sf):
    """All three scores of a flow field at the study's ten levels over its five seeds."""
    out = X.sweep(T.vectors(spark, sf), "row_id", "features", "label", FLOW)
    return shape(out, ["score_kind"], ["level_idx", "n_seeds"],
                 ["level", "auroc_mean", "auroc_std", "auprc_mean", "auprc_std"])


@query("model_cache", score_sql(CONTRACTION, "decision"))
def model_cache(spark, sf):
    """Fit and save, then find the saved model by configuration and data, and score with it."""
    rows = T.vectors(spark, sf)
    # the cache is asked with the rows as they are read: means over several tasks may differ in their last bits from run to run
    train, folder = rows.where("label = 0"), scratch_path(spark, "cache")
    v = prep.standard_scale_vector(train, rows, "features", "features")
    config = {"dataset": "vectors", "kind": "contraction", "scaled": "standard", "seed": CONTRACTION.seed}

    def fit(d):
        return M.fit_field(prep.standard_scale_vector(d, d, "features", "features"), "row_id", "features", CONTRACTION)

    X.fit_or_load(train, "row_id", CONTRACTION, config, folder, fit)

    def must_load(_):
        raise AssertionError("the saved model was not found")

    model = X.fit_or_load(train, "row_id", CONTRACTION, config, folder, must_load)
    return shape(M.score(v, "row_id", "features", model, "decision"), (), ["row_id"], ["score"], 4)


@query("fit_contraction_network")
def fit_contraction_network(spark, sf):
    v = T.vectors(spark, sf)
    v = prep.standard_scale_vector(v.where("label = 0"), v, "features", "features")
    net, _ = L.fit_contraction_network(v.where("label = 0"), "row_id", "features", 64)
    return shape(L.score_network(v, "row_id", "features", net, "decision"), (), ["row_id"], ["score"], 4)


LINE_SPEC = M.FieldSpec("flow")
LINE_SQL = f"""WITH rw AS (SELECT {LINE_KEY_SQL} AS vec_id, CAST(l_quantity >= 50 AS BIGINT) AS label,
  unnest(range(4)) AS d, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS x FROM lineitem),
rg AS (SELECT d, min(x) AS lo, max(x) AS hi, max(x) - min(x) AS w FROM rw WHERE label = 0 GROUP BY d),
z AS (SELECT rw.*, (x - lo) / w * 2 - 1 AS z1 FROM rw JOIN rg USING (d)),
{fit_sql(LINE_SPEC)},
sn AS MATERIALIZED (SELECT *, {normal_sql("concat_ws('|', vec_id, 'score', 0)", 'k')} AS x0 FROM (SELECT *, unnest(range({LINE_SPEC.copies})) AS k FROM z)),
st AS (SELECT sn.*, t_idx, a * z1 + b * x0 AS xt FROM sn, {levels_sql(LINE_SPEC, [(i, S.grid_levels(LINE_SPEC.n_t, LINE_SPEC.eps)[i]) for i in M.score_levels(LINE_SPEC, 'deviation')])}),
p AS {field_join('st', 'xt', LINE_SPEC)}
SELECT vec_id AS row_id, {flt(f'sum((z1 - x0 - f) * (z1 - x0 - f)) / {LINE_SPEC.copies}', 'score', 4)} FROM p GROUP BY vec_id"""


@query("lineitem_flow_deviation", LINE_SQL)
def lineitem_flow_deviation(spark, sf):
    """A flow field on the four numbers of every normal line item, and the deviation of all."""
    df = T.line_numbers(spark, sf)
    model = M.fit_field(df.where("label = 0"), "row_id", "features", LINE_SPEC)
    return shape(M.score(df, "row_id", "features", model, "deviation"), ["row_id"], (), ["score"], 4)


STREAM_INTS = ["iban_mismatch", "swift_mismatch", "method_mismatch", "channel_mismatch", "tx_count_this_month_so_far",
               "is_new_series", "series_tx_count_before"]
STREAM_FLOATS = ["amount_zscore_series", "amount_ratio_to_mean", "day_deviation_from_usual"]


@query("stream_transaction_features", features_sql(
    f"SELECT {KEY_SQL} AS row_key, {', '.join(num(c) for c in STREAM_INTS)}, {', '.join(flt(c) for c in STREAM_FLOATS)} FROM feat"))
def stream_transaction_features(spark, sf):
    """The ledger replayed year by year as a stream of files."""
    tx = T.transactions(spark, sf).withColumn("row_key", row_key())
    out = SF.replay(tx, T.TX, "row_key", scratch_path(spark, "stream"))
    return shape(out, ["row_key"], STREAM_INTS, STREAM_FLOATS)


SWITCH = "1998-01-01"
LEDGER_SQL = features_sql(f"SELECT {KEY_SQL} AS row_key, {', '.join(num(c) for c in INT_FEATURES)}, {', '.join(flt(c) for c in FLOAT_FEATURES)} "
                          f"FROM feat WHERE date_post >= DATE '{SWITCH}'").replace(", late ORDER BY", " ORDER BY")


@query("stream_ledger_features", LEDGER_SQL)
def stream_ledger_features(spark, sf):
    """All 21 features: the ledger as a batch up to a day, then as a stream in two parts, from the state that the batch left."""
    tx = T.transactions(spark, sf).withColumn("row_key", row_key())
    tx = passed(tx, "ledger")
    path = scratch_path(spark, "ledger")
    starts = SL.start_states(tx.where(F.col("date_post") < SWITCH), T.TX)
    starts = SL.Starts(*(passed(s, "start") for s in (starts.series, starts.names, starts.ibans)))
    rest, found = tx.where(F.col("date_post") >= SWITCH), None
    for part in (F.year("date_post") < 2000, F.year("date_post") >= 2000):
        rest.where(part).write.mode("append").parquet(f"{path}/in", compression="zstd")
        found = SL.process(spark.readStream.schema(tx.schema).parquet(f"{path}/in"), T.TX, "row_key", path, starts)
        remove(spark, f"{path}/in")  # processed
    return shape(SL.with_row_features(found, rest, T.TX, "row_key"), ["row_key"], INT_FEATURES, FLOAT_FEATURES)


@query("stream_score", score_sql(CONTRACTION, "decision"))
def stream_score(spark, sf):
    v, model = fitted(spark, sf, CONTRACTION)
    path = scratch_path(spark, "stream-score")
    model = model.materialize(f"{path}/model")
    v.select("row_id", "features").write.parquet(f"{path}/in")
    stream = spark.readStream.schema("row_id long, features array<double>").parquet(f"{path}/in")
    return shape(scoring.stream_score(stream, "row_id", "features", model, "decision", path), (), ["row_id"], ["score"], 4)


TOP = M.FieldSpec("contraction", bins=16)
COLS = prior.FEATURE_COLUMNS
TOP_SQL = features_sql(f""", fx AS (SELECT {KEY_SQL} AS row_key, late, anomaly_description IS NULL AS normal,
  unnest(range({len(COLS)})) AS d, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in COLS)}]) AS x FROM feat),
rg AS (SELECT d, avg(x) AS mu, CASE WHEN max(x) > min(x) THEN stddev_pop(x) ELSE 1 END AS sd FROM fx WHERE NOT late AND normal GROUP BY d),
z AS (SELECT row_key, late, normal, d, (x - mu) / sd AS zs FROM fx JOIN rg USING (d)),
cell AS MATERIALIZED (SELECT 0 AS lab, 0 AS t_idx, d, {bin_sql('zs', TOP)} AS bin, avg(-zs) AS f FROM z WHERE NOT late AND normal GROUP BY ALL),
every AS MATERIALIZED (SELECT 0 AS lab, 0 AS t_idx, d, avg(-zs) AS f FROM z WHERE NOT late AND normal GROUP BY ALL),
p AS {field_join('z', 'q.zs', TOP, '0')}
SELECT row_key, {flt('sqrt(sum((f + zs) * (f + zs)))', 'score', 4)}, {num('CAST(NOT any_value(normal) AS BIGINT)', 'label')}
FROM p WHERE late GROUP BY row_key ORDER BY score DESC, row_key LIMIT 100""")


@query("top_anomalies", TOP_SQL)
def top_anomalies(spark, sf):
    """Flagship: prior features, scaling by the normal training rows, a contraction field on them,
    and the 100 test payments with the largest decision score."""
    rows = all_features(spark, sf)
    # read three times below (scaling, fit, scores): written once, as what the features and the row key are made from, a third of their bytes
    logs = {c: c.removesuffix("_log") for c in COLS if c.endswith("_log")}
    parts = list(dict.fromkeys([*T.TX_KEY, *(logs.get(c, c) for c in COLS)]))
    rows = passed(rows.select(*parts, F.col("anomaly_description").isNull().alias("normal")), "features",
                  *getattr(rows, "_fieldledger_own", ()))
    cutoff = splits.looked_up(spark, splits.chronological_cutoff(rows, "date_post"), "date")
    rows = rows.withColumns({c: F.log1p(n) for c, n in logs.items()})
    rows = rows.select(row_key().alias("row_key"), "date_post", "normal", prior.select_features(None).alias("features"))
    rows = rows.withColumn("late", F.col("date_post") > cutoff)
    train = rows.where("NOT late AND normal")
    z = prep.standard_scale_vector(train, rows, "features", "features")
    model = M.fit_field(z.where("NOT late AND normal"), "row_key", "features", TOP)
    scored = M.score(z.where("late"), "row_key", "features", model, "decision")
    scored = scored.withColumns({"score": F.round("score", 4), "label": (~F.col("normal")).cast("long")})
    return metrics.top_anomalies(scored, "score", 100, ["row_key"]).select("row_key", "score", "label")
