"""Queries over metrics. Scored rows: lineitem with score = discounted price, label = large
quantity; l_returnflag stands for the model and l_linenumber for the seed."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions import scalars as S
from ..operators import metrics as M, ranks, splits
from ..session import cut_lineage
from ..sources import tables as T
from .common import KEY_SQL, LINE_KEY_SQL, flt, num, row_key, shape, tx_sql
from .registry import query

PCT_SQL = "[" + ", ".join(f"{p}::DOUBLE" for p in M.PERCENTILES) + "]"
SCORED_SQL = f"""sc AS (SELECT {LINE_KEY_SQL} AS row_key, l_returnflag AS model, l_linestatus AS score_name,
  l_linenumber AS seed, l_extendedprice * (1 - l_discount) AS score, CAST(l_quantity >= 45 AS BIGINT) AS label FROM lineitem)"""


def scored(spark, sf):
    return T.table(spark, sf, "lineitem").select(
        row_key("l_shipdate").alias("row_key"), F.col("l_returnflag").alias("model"),
        F.col("l_linestatus").alias("score_name"), F.col("l_linenumber").alias("seed"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
        (F.col("l_quantity") >= 45).cast("int").alias("label"))


def cuts_sql(keys: str = "") -> str:
    """thresholds and threshold metrics per key list (with a trailing comma)."""
    by = f"GROUP BY {keys.rstrip(', ')}" if keys else ""
    over = f"PARTITION BY {keys.rstrip(', ')}" if keys else ""
    pair = f"JOIN rk USING ({keys.rstrip(', ')})" if keys else ", rk"
    join = f"JOIN sc USING ({keys.rstrip(', ')})" if keys else ", sc"
    return f"""{SCORED_SQL},
rk AS (SELECT {keys} score, row_number() OVER ({over} ORDER BY score) - 1 AS r FROM sc),
spot AS (SELECT {keys} percentile, part * (n - 1) AS h FROM (SELECT {keys} count(*) AS n FROM sc {by}),
  (SELECT unnest({PCT_SQL}) AS percentile, unnest([{', '.join(repr(p / 100.0) + '::DOUBLE' for p in M.PERCENTILES)}]) AS part)),
th AS (SELECT {keys} percentile, lo + coalesce((hi - lo) * (h - floor(h)), 0) AS threshold FROM (
  SELECT {keys} percentile, any_value(h) AS h, max(score) FILTER (r = floor(h)) AS lo, max(score) FILTER (r = floor(h) + 1) AS hi
  FROM spot {pair} GROUP BY {keys} percentile)),
cm AS (SELECT {keys} percentile, threshold,
    count(*) FILTER (score > threshold AND label = 1) AS tp, count(*) FILTER (score > threshold AND label = 0) AS fp,
    count(*) FILTER (score <= threshold AND label = 1) AS fn, count(*) FILTER (score <= threshold AND label = 0) AS tn
  FROM th {join} GROUP BY {keys} percentile, threshold),
pr AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
    (tp + tn) / (tp + fp + fn + tn) AS accuracy FROM cm),
tm AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr)"""


COUNTS = ["tp", "fp", "fn", "tn"]
RATES = ["percentile", "threshold", "precision", "recall", "f1", "accuracy"]


@query("score_percentiles", f"WITH {cuts_sql()} SELECT {flt('percentile')}, {flt('threshold')} FROM th")
def score_percentiles(spark, sf):
    return shape(M.score_percentiles(scored(spark, sf), "score"), (), (), ["percentile", "threshold"])


@query("threshold_metrics", f"WITH {cuts_sql()} SELECT {', '.join(num(c) for c in COUNTS)}, {', '.join(flt(c) for c in RATES)} FROM tm")
def threshold_metrics(spark, sf):
    return shape(M.threshold_metrics(scored(spark, sf), "score", "label"), (), COUNTS, RATES)


@query("best_f1_threshold", f"""WITH {cuts_sql('model, seed, ')}
SELECT model, {num('seed')}, {flt('f1', 'best_f1')}, {flt('threshold', 'best_threshold')}, {flt('percentile', 'best_percentile')}
FROM tm WHERE f1 > 0 QUALIFY row_number() OVER (PARTITION BY model, seed ORDER BY f1 DESC, percentile) = 1""")
def best_f1_threshold(spark, sf):
    keys = ["model", "seed"]
    out = M.best_f1(M.threshold_metrics(scored(spark, sf), "score", "label", keys=keys), keys)
    return shape(out, ["model"], ["seed"], ["best_f1", "best_threshold", "best_percentile"])


@query("confusion_counts", f"""WITH {SCORED_SQL} SELECT model, {num('count(*) FILTER (score > 50000 AND label = 1)', 'tp')},
{num('count(*) FILTER (score > 50000 AND label = 0)', 'fp')}, {num('count(*) FILTER (score <= 50000 AND label = 1)', 'fn')},
{num('count(*) FILTER (score <= 50000 AND label = 0)', 'tn')} FROM sc GROUP BY model""")
def confusion_counts(spark, sf):
    df = scored(spark, sf).withColumn("pred", (F.col("score") > 50000).cast("int"))
    return shape(M.confusion_counts(df, "label", "pred", ["model"]), ["model"], COUNTS)


AUC_SQL = """ra AS (SELECT *, rank() OVER (PARTITION BY model, seed ORDER BY score)
    + (count(*) OVER (PARTITION BY model, seed, score) - 1) / 2.0::DOUBLE AS r FROM sc),
auc AS (SELECT model, seed, (sum(r) FILTER (label = 1) - np * (np + 1) / 2.0::DOUBLE) / (np * nn) AS auroc FROM
  (SELECT *, sum(label) OVER (PARTITION BY model, seed)::DOUBLE AS np, sum(1 - label) OVER (PARTITION BY model, seed)::DOUBLE AS nn FROM ra)
  GROUP BY model, seed, np, nn),
g AS (SELECT model, seed, score, sum(label)::DOUBLE AS p, count(*)::DOUBLE AS n FROM sc GROUP BY model, seed, score),
cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al, sum(p) OVER (PARTITION BY model, seed) AS np FROM g
  WINDOW w AS (PARTITION BY model, seed ORDER BY score DESC)),
ap AS (SELECT model, seed, sum(p * tp / al) / any_value(np) AS auprc FROM cu GROUP BY model, seed)"""


@query("roc_auc", f"WITH {SCORED_SQL}, {AUC_SQL} SELECT model, {num('seed')}, {flt('auroc')} FROM auc")
def roc_auc(spark, sf):
    return shape(M.roc_auc(scored(spark, sf), "score", "label", ["model", "seed"]), ["model"], ["seed"], ["auroc"])


@query("average_precision", f"WITH {SCORED_SQL}, {AUC_SQL} SELECT model, {num('seed')}, {flt('auprc')} FROM ap")
def average_precision(spark, sf):
    return shape(M.average_precision(scored(spark, sf), "score", "label", ["model", "seed"]),
                 ["model"], ["seed"], ["auprc"])


@query("average_rank", f"SELECT {flt('l_extendedprice', 'price')}, {num('count(*)', 'n')}, {flt('any_value(r) + (count(*) - 1) / 2.0', 'avg_rank')} "
       "FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY l_extendedprice")
def average_rank(spark, sf):
    out = ranks.average_rank(T.table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice")), "price")
    return shape(out, (), ["n"], ["price", "avg_rank"])


#: Rows of a side of the join that go to one part.
JOINED_ROWS = 1_000_000


def packed(key: str) -> Column:
    """The key as binary, equal where keys are equal: keys of digits and hyphens take half a byte per character, behind a
    mark that no text begins with; others are their text."""
    digits = F.replace(key, F.lit("-"), F.lit("f"))
    mark = F.when(F.length(key) % 2 == 1, "a").otherwise("aa")
    # no letters, so that what can be read as hexadecimal is digits and hyphens
    return F.coalesce(F.when(F.upper(key) == F.lower(key), F.unhex(F.concat(mark, digits))), F.col(key).cast("binary"))


@query("score_label_join", f"""WITH {SCORED_SQL}, ra AS (SELECT l.label, rank() OVER (ORDER BY s.score)
    + (count(*) OVER (PARTITION BY s.score) - 1) / 2.0::DOUBLE AS r FROM sc s JOIN (SELECT row_key, label FROM sc) l USING (row_key)),
n AS (SELECT sum(label)::DOUBLE AS np, sum(1 - label)::DOUBLE AS nn, sum(r) FILTER (label = 1) AS rs FROM ra)
SELECT {flt('(rs - np * (np + 1) / 2.0) / (np * nn)', 'auroc')} FROM n""")
def score_label_join(spark, sf):
    """Scores and labels kept apart meet again on the row key."""
    df = scored(spark, sf).withColumn("key", packed("row_key"))
    # so many rows of a part are sorted in memory
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // JOINED_ROWS)
    side = lambda value: df.select("key", value).repartition(parts, "key")
    joined = side("score").join(side("label"), "key")
    joined = cut_lineage(joined.select("score", "label"), "joined")  # counted, cut into ranges and ranked: joined once
    return shape(M.roc_auc(joined, "score", "label"), (), (), ["auroc"])


SEEDS_SQL = f"{SCORED_SQL}, {AUC_SQL}, ms AS (SELECT * FROM auc JOIN ap USING (model, seed))"


def seed_metrics(spark, sf, keys=("model", "seed")):
    df = scored(spark, sf)
    bounds = ranks.value_bounds(df, "score")
    return M.roc_auc(df, "score", "label", keys, bounds).join(
        M.average_precision(df, "score", "label", keys, bounds), list(keys))


@query("seed_mean_std", f"""WITH {SEEDS_SQL} SELECT model, {num('count(*)', 'n_seeds')}, {flt('avg(auroc)', 'auroc_mean')},
{flt('stddev_pop(auroc)', 'auroc_std')}, {flt('avg(auprc)', 'auprc_mean')}, {flt('stddev_pop(auprc)', 'auprc_std')} FROM ms GROUP BY model""")
def seed_mean_std(spark, sf):
    out = M.seed_mean_std(seed_metrics(spark, sf), ["model"], ["auroc", "auprc"])
    return shape(out, ["model"], ["n_seeds"], ["auroc_mean", "auroc_std", "auprc_mean", "auprc_std"])


@query("extreme_case_summary", f"""WITH {cuts_sql('model, seed, ')},
e AS (SELECT *, CASE seed WHEN 1 THEN 'no_contamination' WHEN 7 THEN 'full_contamination' END AS "case" FROM tm WHERE seed IN (1, 7))
SELECT "case", {flt('percentile')}, {num('count(*)', 'n_seeds')}, {flt('avg(f1)', 'f1_mean')}, {flt('stddev_pop(f1)', 'f1_std')},
{flt('avg(precision)', 'precision_mean')}, {flt('avg(recall)', 'recall_mean')} FROM e GROUP BY "case", percentile""")
def extreme_case_summary(spark, sf):
    """l_linenumber is the level here and l_returnflag the repetition."""
    tm = M.threshold_metrics(scored(spark, sf), "score", "label", keys=["model", "seed"])
    out = M.seed_mean_std(M.extreme_cases(tm, [], "seed"), ["case", "percentile"], ["f1", "precision", "recall"])
    return shape(out, ["case"], ["n_seeds"], ["percentile", "f1_mean", "f1_std", "precision_mean", "recall_mean"])


MEANS_SQL = f"""{cuts_sql('model, seed, ')}, mf AS (SELECT model, percentile, avg(f1) AS f1_mean, stddev_pop(f1) AS f1_std FROM tm GROUP BY model, percentile)"""


def _percentile_means(spark, sf):
    tm = M.threshold_metrics(scored(spark, sf), "score", "label", keys=["model", "seed"])
    return M.seed_mean_std(tm, ["model", "percentile"], ["f1"])


@query("best_percentile_by_mean_f1", f"""WITH {MEANS_SQL} SELECT model, {flt('percentile')}, {flt('f1_mean')} FROM mf
QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1_mean DESC, percentile) = 1""")
def best_percentile_by_mean_f1(spark, sf):
    out = M.best_percentile_by_mean_f1(_percentile_means(spark, sf), ["model"])
    return shape(out, ["model"], (), ["percentile", "f1_mean"])


@query("percentile_curve", f"""WITH {MEANS_SQL} SELECT model, {flt('percentile')}, {flt('f1_mean', 'mean')},
{flt('f1_mean - f1_std', 'low')}, {flt('f1_mean + f1_std', 'high')} FROM mf""")
def percentile_curve(spark, sf):
    means = _percentile_means(spark, sf).withColumn("case", F.lit("full_contamination"))
    return shape(M.percentile_curve(means, "model", "full_contamination"), ["model"], (), ["percentile", "mean", "low", "high"])


@query("contamination_curve", f"""WITH {SCORED_SQL}, {AUC_SQL} SELECT score_name, {flt('seed / 7.0', 'level')}, {flt('avg(auroc)', 'mean')},
{flt('avg(auroc) - stddev_pop(auroc)', 'low')}, {flt('avg(auroc) + stddev_pop(auroc)', 'high')}
FROM auc JOIN (SELECT DISTINCT score_name FROM sc) ON true GROUP BY score_name, seed""")
def contamination_curve(spark, sf):
    """l_linenumber / 7 stands for the level; one curve per l_linestatus."""
    df = scored(spark, sf)
    auc = M.roc_auc(df, "score", "label", ["model", "seed"]).withColumn("level", F.col("seed") / 7.0)
    names = df.agg(F.array_sort(F.collect_set("score_name"))).scalar()
    auc = auc.withColumn("_s", names).withColumn("score_name", F.explode("_s"))
    out = M.contamination_curve(M.seed_mean_std(auc, ["score_name", "level"], ["auroc"]), "score_name")
    return shape(out, ["score_name"], (), ["level", "mean", "low", "high"])


CLF_SQL = """cl AS (SELECT doc_id, quality AS truth, CAST(n_chars / 1000.0 > 0.8 AS BIGINT) + toxic AS pred FROM labels JOIN documents USING (doc_id))"""


@query("classification_report", f"""WITH {CLF_SQL}, k AS (SELECT truth AS c FROM cl UNION SELECT pred FROM cl),
pc AS (SELECT c::VARCHAR AS class, count(*) FILTER (truth = c)::DOUBLE AS sup, count(*) FILTER (pred = c)::DOUBLE AS prd,
  count(*) FILTER (truth = c AND pred = c)::DOUBLE AS hit FROM k, cl GROUP BY c),
m AS (SELECT class, sup, hit, coalesce(hit / nullif(prd, 0), 0) AS p, coalesce(hit / nullif(sup, 0), 0) AS r,
  coalesce(2 * hit / nullif(sup + prd, 0), 0) AS f FROM pc)
SELECT class, {flt('p', 'precision')}, {flt('r', 'recall')}, {flt('f', 'f1')}, {num('sup', 'support')} FROM m
UNION ALL SELECT 'accuracy', round(CAST(sum(hit) / sum(sup) AS DOUBLE), 6), round(CAST(sum(hit) / sum(sup) AS DOUBLE), 6), round(CAST(sum(hit) / sum(sup) AS DOUBLE), 6), CAST(sum(sup) AS BIGINT) FROM m
UNION ALL SELECT 'macro avg', round(CAST(avg(p) AS DOUBLE), 6), round(CAST(avg(r) AS DOUBLE), 6), round(CAST(avg(f) AS DOUBLE), 6), CAST(sum(sup) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(CAST(sum(p * sup) / sum(sup) AS DOUBLE), 6), round(CAST(sum(r * sup) / sum(sup) AS DOUBLE), 6), round(CAST(sum(f * sup) / sum(sup) AS DOUBLE), 6), CAST(sum(sup) AS BIGINT) FROM m""")
def classification_report(spark, sf):
    df = T.classified(spark, sf).withColumn("pred", (F.col("score") > 0.8).cast("int") + F.col("toxic"))
    return shape(M.classification_report(df, "truth", "pred"), ["class"], ["support"], ["precision", "recall", "f1"])


REG_SQL = """rg AS (SELECT l_returnflag AS model, sqrt(avg((l_extendedprice - l_quantity * 1500) ^ 2)) / 1000 AS rmse,
  1 - sum((l_extendedprice - l_quantity * 1500) ^ 2) / (var_pop(l_extendedprice) * count(*)) AS r2,
  avg(CAST((l_extendedprice > 40000) = (l_quantity > 25) AS BIGINT)) AS accuracy FROM lineitem GROUP BY l_returnflag)"""


def _regression(spark, sf):
    df = T.table(spark, sf, "lineitem").withColumns({
        "model": F.col("l_returnflag"), "pred": F.col("l_quantity") * 1500,
        "hit": ((F.col("l_extendedprice") > 40000) == (F.col("l_quantity") > 25)).cast("int")})
    reg = M.regression_metrics(df, "l_extendedprice", "pred", 0.001, ["model"])
    return reg.join(df.groupBy("model").agg(F.avg("hit").alias("accuracy")), "model")


@query("rmse_r2", f"WITH {REG_SQL} SELECT model, {flt('rmse')}, {flt('r2')} FROM rg")
def rmse_r2(spark, sf):
    return shape(_regression(spark, sf), ["model"], (), ["rmse", "r2"])


@query("signed_score", f"WITH {REG_SQL} SELECT model, {flt('-rmse', 'regression')}, {flt('accuracy', 'classification')} FROM rg")
def signed_score(spark, sf):
    df = _regression(spark, sf)
    return shape(df.withColumns({"regression": M.signed_score("regression", df),
                                 "classification": M.signed_score("binclass", df)}),
                 ["model"], (), ["regression", "classification"])


@query("metrics_transpose", f"""WITH {REG_SQL}, l AS (UNPIVOT (SELECT model, rmse, r2, accuracy FROM rg) ON rmse, r2, accuracy INTO NAME metric VALUE v)
SELECT metric, {flt("max(v) FILTER (model = 'A')", 'A')}, {flt("max(v) FILTER (model = 'N')", 'N')}, {flt("max(v) FILTER (model = 'R')", 'R')} FROM l GROUP BY metric""")
def metrics_transpose(spark, sf):
    out = M.metrics_transpose(_regression(spark, sf), "model", ["rmse", "r2", "accuracy"], ["A", "N", "R"])
    return shape(out, ["metric"], (), ["A", "N", "R"])


@query("selection_score", f"WITH {REG_SQL} SELECT model, {flt('''CASE WHEN model = 'A' THEN accuracy ELSE r2 END''', 'selection_score')} FROM rg")
def selection_score(spark, sf):
    """Model A reports only f1 (its accuracy stands for it), the others both."""
    long = _regression(spark, sf).select("model", F.col("accuracy").alias("f1"), "r2").unpivot(
        ["model"], ["f1", "r2"], "metric", "value")
    long = long.where((F.col("model") != "A") | (F.col("metric") == "f1"))
    return shape(M.selection_score(long, ["model"]), ["model"], (), ["selection_score"])


@query("anomaly_type_counts", tx_sql(f"""SELECT split, kind, {num('count(*)', 'n')} FROM
(SELECT CASE WHEN date_post <= (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split,
  split_part(anomaly_description, ':', 1) AS kind FROM tx WHERE anomaly_description IS NOT NULL)
GROUP BY CUBE (split, kind)"""))
def anomaly_type_counts(spark, sf):
    tx = splits.chronological_split(T.transactions(spark, sf), "date_post").where("anomaly_description IS NOT NULL")
    out = M.anomaly_type_counts(tx.withColumn("kind", S.anomaly_type("anomaly_description")), "split", "kind")
    return shape(out, ["split", "kind"], ["n"])


@query("split_summary", tx_sql(f"""SELECT split, {num('count(*) - count(anomaly_description)', 'normal')}, {num('count(anomaly_description)', 'abnormal')},
{flt('count(anomaly_description) * 100.0::DOUBLE / count(*)', 'anomaly_rate_pct')} FROM
(SELECT CASE WHEN date_post <= (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split, anomaly_description FROM tx) GROUP BY split"""))
def split_summary(spark, sf):
    tx = splits.chronological_split(T.transactions(spark, sf), "date_post")
    out = M.split_summary(tx.withColumn("label", S.anomaly_label("anomaly_description")), "split", "label")
    return shape(out, ["split"], ["normal", "abnormal"], ["anomaly_rate_pct"])


@query("distinct_values", f"SELECT {flt('l_discount', 'value')}, {num('count(*)', 'n')} FROM lineitem GROUP BY l_discount")
def distinct_values(spark, sf):
    return shape(M.distinct_values(T.table(spark, sf, "lineitem"), "l_discount").orderBy("value"), (), ["n"], ["value"])


@query("list_test_anomalies", tx_sql(f"SELECT {KEY_SQL} AS row_key, {flt('amount')}, anomaly_description FROM tx "
       "WHERE anomaly_description IS NOT NULL AND date_post > (SELECT cutoff FROM cut)"))
def list_test_anomalies(spark, sf):
    tx = splits.chronological_split(T.transactions(spark, sf), "date_post")
    out = tx.where("split = 'test' AND anomaly_description IS NOT NULL").orderBy("date_post", "l_orderkey", "l_linenumber")
    return shape(out.withColumn("row_key", row_key()), ["row_key", "anomaly_description"], (), ["amount"])
