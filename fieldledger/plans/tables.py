"""Queries over sources, sinks, joins, set operations, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import noise as N
from ..operators import metrics as M, relational as R, splits
from ..session import scratch_path
from ..sources import files, npz, tables as T
from .common import FEATURES_SQL, KEY_SQL, LINE_KEY_SQL, features_sql, flt, num, row_key, shape, tx_sql, txt
from .prep import CAT_SQL, NUM_SQL, numbers, train_of
from .registry import query


def _payments(spark, sf):
    """The 14-column transaction file."""
    tx = T.transactions(spark, sf)
    return tx.select(
        "bank_account_uuid", F.col("bank_account_uuid").alias("business_partner_name"),
        F.date_format("date_post", "yyyyMMdd").alias("date_post"), "amount", F.lit("USD").alias("currency"),
        "ref_name", "ref_iban", "ref_swift", F.lit("US").alias("ref_bank"), row_key().alias("paym_note"),
        F.lit("DEBIT").alias("trns_type"), "pay_method", "channel", "anomaly_description")


@query("scan_transactions", tx_sql(
    f"SELECT {KEY_SQL} AS paym_note, {txt('date_post')}, ref_name, pay_method, anomaly_description, {flt('amount')} FROM tx"))
def scan_transactions(spark, sf):
    path = files.write_csv(_payments(spark, sf), scratch_path(spark, "payments"), files.TRANSACTION_COLUMNS)
    out = files.read_transactions(spark, path + "-absent", path)
    return shape(out, ["paym_note", "date_post", "ref_name", "pay_method", "anomaly_description"], (), ["amount"])


@query("transaction_date_range", tx_sql(
    f"SELECT {num('count(*)', 'n')}, {txt('min(date_post)', 'first_date')}, {txt('max(date_post)', 'last_date')} FROM tx"))
def transaction_date_range(spark, sf):
    return shape(files.date_range(T.transactions(spark, sf), "date_post"), ["first_date", "last_date"], ["n"])


@query("scan_labeled_matrix", f"SELECT {num('vec_id', 'row_id')}, {num('CAST(label = 9 AS BIGINT)', 'label')}, {num('len(embedding)', 'width')}, "
       f"{flt('embedding[1]', 'first')}, {flt('list_sum(embedding::DOUBLE[])', 'total')} FROM embeddings")
def scan_labeled_matrix(spark, sf):
    out = T.vectors(spark, sf)
    return shape(out.withColumns({
        "width": F.size("features"), "first": F.col("features")[0],
        "total": F.aggregate("features", F.lit(0.0), lambda a, x: a + x)}),
        (), ["row_id", "label", "width"], ["first", "total"])


@query("scan_npz", f"SELECT {num('vec_id')}, {num('label')}, {flt('list_sum(embedding::DOUBLE[])', 'total')}, {num('(SELECT count(*) FROM embeddings)', 'n')} FROM embeddings")
def scan_npz(spark, sf):
    """The vectors written as archives, one per partition, and read back in ranges of 40 rows."""
    path = scratch_path(spark, "npz")
    v = T.vectors(spark, sf).repartition(3, "row_id").withColumn("x", F.concat(F.array(F.col("row_id").cast("double")), "features"))
    n = npz.write_npz(v, path, "x", "class").agg(F.sum("n")).first()[0]
    out = npz.scan_npz(spark, path, ("features", "label"), rows=40)
    return shape(out.select(F.col("features")[0].alias("vec_id"), "label", F.lit(n).alias("n"), F.aggregate(
        F.slice("features", F.lit(2), F.size("features") - 1), F.lit(0.0), lambda a, x: a + x).alias("total")), (), ["vec_id", "label", "n"], ["total"])


@query("scan_split_dataset", f"WITH {CAT_SQL} SELECT {num('o_orderkey')}, c1, {flt('y')}, split FROM c WHERE split IN ('train', 'test')")
def scan_split_dataset(spark, sf):
    path = files.write_split_dataset(T.categorical(spark, sf), scratch_path(spark, "split"))
    return shape(files.read_split_dataset(spark, path, ["train", "test"]), ["c1", "split"], ["o_orderkey"], ["y"])


@query("scan_csv_with_roles", f"WITH {CAT_SQL} SELECT {flt('o_orderkey')}, c0, c1, c2, {flt('y')}, split FROM c WHERE split <> 'val'")
def scan_csv_with_roles(spark, sf):
    df = T.categorical(spark, sf)
    cols = ["o_orderkey", "c0", "c1", "c2", "y"]
    paths = {s: files.write_csv(df.where(F.col("split") == s), scratch_path(spark, f"roles-{s}"), cols)
             for s in ("train", "test")}
    out = files.read_csv_roles(spark, paths, ["c0", "c1", "c2"], "y")
    return shape(out, ["c0", "c1", "c2", "split"], (), ["o_orderkey", "y"])


@query("dataset_info", f"WITH {CAT_SQL} SELECT coalesce(split, 'all') AS part, {num('count(*)', 'size')}, {num('4', 'n_features')} FROM c GROUP BY ROLLUP (split)")
def dataset_info(spark, sf):
    return shape(files.dataset_info(T.categorical(spark, sf), 4), ["part"], ["size", "n_features"])


@query("write_csv", tx_sql(f"SELECT {KEY_SQL} AS paym_note, {flt('amount')} FROM tx"))
def write_csv(spark, sf):
    path = files.write_csv(_payments(spark, sf), scratch_path(spark, "csv"), files.TRANSACTION_COLUMNS)
    back = spark.read.csv(path, schema=files.TRANSACTION_SCHEMA, header=True)
    return shape(back, ["paym_note"], (), ["amount"])


RESULT_SQL = """res AS (SELECT c_mktsegment AS dataset, o_orderpriority AS model, o_orderstatus AS score,
  avg(o_totalprice) / 1000 AS auroc_mean FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY c_mktsegment, o_orderpriority, o_orderstatus)"""


def results(spark, sf):
    """A result table from orders: segment = data set, priority = model, status = score."""
    o, c = T.table(spark, sf, "orders"), T.table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(
        F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("model"),
        F.col("o_orderstatus").alias("score")).agg((F.avg("o_totalprice") / 1000).alias("auroc_mean"))


@query("write_results", f"WITH {RESULT_SQL} SELECT dataset, model, score, {flt('auroc_mean')} FROM res")
def write_results(spark, sf):
    path = files.write_results(results(spark, sf), scratch_path(spark, "results"))
    return shape(spark.read.parquet(path), ["dataset", "model", "score"], (), ["auroc_mean"])


@query("merge_results", f"""WITH {RESULT_SQL} SELECT dataset, model, score,
{flt("CASE WHEN score = 'F' THEN auroc_mean + 2 WHEN dataset = 'BUILDING' THEN auroc_mean + 1 ELSE auroc_mean END", 'auroc_mean')} FROM res""")
def merge_results(spark, sf):
    res = results(spark, sf)
    first = files.write_results(res, scratch_path(spark, "merge"))
    later = res.where("dataset = 'BUILDING'").withColumn("auroc_mean", F.col("auroc_mean") + 1)
    last = res.where("score = 'F'").withColumn("auroc_mean", F.col("auroc_mean") + 2)
    parts = files.read_results(spark, [first, first + "-absent"]) + [later, last]
    return shape(R.merge_results(parts, ["dataset", "model", "score"]), ["dataset", "model", "score"], (), ["auroc_mean"])


REPORT_SQL = f"WITH {RESULT_SQL} SELECT dataset, model, score, {flt('auroc_mean')} FROM res"


@query("write_report", REPORT_SQL)
def write_report(spark, sf):
    path = files.write_report(results(spark, sf), scratch_path(spark, "report"), "parquet")
    return shape(files.read_report(spark, path, "parquet"), ["dataset", "model", "score"], (), ["auroc_mean"])


@query("read_report", REPORT_SQL)
def read_report(spark, sf):
    path = files.write_report(results(spark, sf), scratch_path(spark, "report"), "json")
    out = files.read_report(spark, path, "json", "dataset string, model string, score string, auroc_mean double")
    return shape(out, ["dataset", "model", "score"], (), ["auroc_mean"])


NONE_SQL = "CASE WHEN o_orderkey % 3 = 0 THEN '__none__' WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END"


def _sentinels(spark, sf):
    k = F.col("o_orderkey")
    return T.table(spark, sf, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, "__none__").when(k % 5 == 0, None).otherwise(F.col("o_orderstatus")).alias("s"),
        F.col("o_orderpriority").alias("p"))


@query("unpack_none_sentinel", f"SELECT {num('o_orderkey')}, nullif({NONE_SQL}, '__none__') AS s, o_orderpriority AS p FROM orders")
def unpack_none_sentinel(spark, sf):
    return shape(R.unpack_none_sentinel(_sentinels(spark, sf)), ["s", "p"], ["o_orderkey"])


@query("pack_none_sentinel", f"SELECT {num('o_orderkey')}, coalesce({NONE_SQL}, '__none__') AS s, o_orderpriority AS p FROM orders")
def pack_none_sentinel(spark, sf):
    return shape(R.pack_none_sentinel(_sentinels(spark, sf)), ["s", "p"], ["o_orderkey"])


@query("config_fingerprint", f"""SELECT {num('o_orderkey')}, md5('{{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey
|| ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}}') AS fingerprint FROM orders""")
def config_fingerprint(spark, sf):
    out = T.table(spark, sf, "orders").withColumn(
        "fingerprint", R.config_fingerprint("o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey"))
    return shape(out, ["fingerprint"], ["o_orderkey"])


@query("filter_models", f"WITH {RESULT_SQL} SELECT DISTINCT model FROM res WHERE model IN ('1-URGENT', '5-LOW', 'none')")
def filter_models(spark, sf):
    return R.filter_models(results(spark, sf), "model", ["1-URGENT", "5-LOW", "none"])


@query("model_intersection", "SELECT DISTINCT o_orderpriority AS model FROM orders WHERE o_orderstatus = 'F' "
       "INTERSECT SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 100000")
def model_intersection(spark, sf):
    o = T.table(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderpriority").alias("model"))
    b = o.where("o_orderstatus = 'P' AND o_totalprice > 100000").select(F.col("o_orderpriority").alias("model"))
    return R.intersect_models(a, b)


@query("apply_fitted_stats", f"WITH {NUM_SQL} SELECT row_key, {flt('tax - (SELECT avg(tax) FROM train)', 'tax')}, "
       f"{flt('disc - (SELECT avg(disc) FROM train)', 'disc')} FROM li")
def apply_fitted_stats(spark, sf):
    """One row of fitted statistics reaches every row as a scalar subquery."""
    df = numbers(spark, sf)
    stats = train_of(df).agg(F.struct(F.avg("tax").alias("t"), F.avg("disc").alias("d")))
    out = df.withColumn("_s", stats.scalar()).withColumns({
        "tax": F.col("tax") - F.col("_s.t"), "disc": F.col("disc") - F.col("_s.d")})
    return shape(out, ["row_key"], (), ["tax", "disc"])


@query("grid_join", f"WITH {RESULT_SQL} SELECT dataset, model, score, {num('seed')}, score_kind FROM res, "
       "(SELECT unnest(range(5)) AS seed), (SELECT unnest(['deviation', 'reconstruction', 'decision']) AS score_kind)")
def grid_join(spark, sf):
    out = R.grid(results(spark, sf), seed=[0, 1, 2, 3, 4], score_kind=["deviation", "reconstruction", "decision"])
    return shape(out, ["dataset", "model", "score", "score_kind"], ["seed"])


@query("state_left_join", tx_sql(f"""SELECT {KEY_SQL} AS row_key, {num('coalesce(n, 0)', 'n')}, {flt('coalesce(mean, 1)', 'mean')}
FROM tx LEFT JOIN (SELECT bank_account_uuid, ref_name, count(*) AS n, avg(amount) AS mean FROM tx
  WHERE date_post <= (SELECT cutoff FROM cut) GROUP BY bank_account_uuid, ref_name) USING (bank_account_uuid, ref_name)
WHERE date_post > (SELECT cutoff FROM cut)"""))
def state_left_join(spark, sf):
    tx = splits.chronological_split(T.transactions(spark, sf), "date_post")
    state = tx.where("split = 'train'").groupBy("bank_account_uuid", "ref_name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean"))
    out = R.state_left_join(tx.where("split = 'test'"), state, ["bank_account_uuid", "ref_name"], {"n": 0, "mean": 1.0})
    return shape(out.withColumn("row_key", row_key()), ["row_key"], ["n"], ["mean"])


PAIRS = "(SELECT ref_name, ref_iban FROM tx WHERE date_post <= DATE '1995-06-30')"


def _pairs(spark, sf):
    tx = T.transactions(spark, sf).withColumn("row_key", row_key())
    return tx, tx.where("date_post <= DATE '1995-06-30'")


@query("seen_semi_join", tx_sql(f"SELECT {KEY_SQL} AS row_key FROM tx SEMI JOIN {PAIRS} USING (ref_name, ref_iban)"))
def seen_semi_join(spark, sf):
    tx, known = _pairs(spark, sf)
    return shape(R.seen(tx, known, ["ref_name", "ref_iban"]), ["row_key"])


UNSEEN = "(SELECT bank_account_uuid, ref_name FROM tx WHERE date_post <= DATE '1995-06-30')"


@query("unseen_anti_join", tx_sql(f"SELECT {KEY_SQL} AS row_key FROM tx ANTI JOIN {UNSEEN} USING (bank_account_uuid, ref_name)"))
def unseen_anti_join(spark, sf):
    tx, known = _pairs(spark, sf)
    return shape(R.unseen(tx, known, ["bank_account_uuid", "ref_name"]), ["row_key"])


@query("union_rows", tx_sql(f"SELECT {KEY_SQL} AS row_key, ref_name FROM tx WHERE pay_method = 'CARD' "
       f"UNION ALL SELECT {KEY_SQL}, ref_name FROM tx WHERE channel = 'API'"))
def union_rows(spark, sf):
    tx = T.transactions(spark, sf).withColumn("row_key", row_key())
    return shape(tx.where("pay_method = 'CARD'").unionByName(tx.where("channel = 'API'")), ["row_key", "ref_name"])


@query("sort_by_date", tx_sql(f"SELECT {KEY_SQL} AS row_key, {flt('amount')} FROM tx ORDER BY tx_id"))
def sort_by_date(spark, sf):
    tx = T.transactions(spark, sf).orderBy(*T.TX_KEY)
    return tx.select(row_key().alias("row_key"), F.round("amount", 6).alias("amount"))


@query("first_rows", tx_sql(f"SELECT {KEY_SQL} AS row_key, {flt('amount')} FROM tx ORDER BY tx_id LIMIT 10"))
def first_rows(spark, sf):
    tx = R.first_rows(T.transactions(spark, sf), T.TX_KEY)
    return shape(tx.withColumn("row_key", row_key()), ["row_key"], (), ["amount"])


@query("nearest_value_join", f"""WITH s AS (SELECT s_nationkey, s_acctbal, max(s_suppkey) AS s_suppkey FROM supplier GROUP BY ALL),
a AS (SELECT c_custkey, c_acctbal, s_suppkey, s_acctbal FROM customer ASOF LEFT JOIN s ON c_nationkey = s_nationkey AND c_acctbal >= s_acctbal),
b AS (SELECT c_custkey, s_suppkey, s_acctbal FROM customer ASOF LEFT JOIN s ON c_nationkey = s_nationkey AND c_acctbal <= s_acctbal)
SELECT {num('c_custkey')}, {num('CASE WHEN lower THEN a.s_suppkey ELSE b.s_suppkey END', 's_suppkey')}, {flt('CASE WHEN lower THEN a.s_acctbal ELSE b.s_acctbal END', 's_acctbal')}
FROM a JOIN b USING (c_custkey), (SELECT 1), LATERAL (SELECT a.s_suppkey IS NOT NULL AND (b.s_suppkey IS NULL OR c_acctbal - a.s_acctbal <= b.s_acctbal - c_acctbal) AS lower)""")
def nearest_value_join(spark, sf):
    """For each customer the supplier of the same nation with the nearest balance."""
    out = R.nearest_join(T.table(spark, sf, "customer"), T.table(spark, sf, "supplier"), ("c_acctbal", "s_acctbal"),
                         [("c_nationkey", "s_nationkey")], {"s_suppkey": "s_suppkey", "s_acctbal": "s_acctbal"}, ties=["s_suppkey"])
    return shape(out, (), ["c_custkey", "s_suppkey"], ["s_acctbal"])


@query("asof_join", f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) + 60 AS due FROM orders),
s AS (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS shipped, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL),
a AS (SELECT * FROM o ASOF LEFT JOIN s ON o_orderkey = l_orderkey AND due >= shipped)
SELECT {num('o_orderkey')}, {num('CASE WHEN due - shipped <= 45 THEN l_linenumber END', 'l_linenumber')},
  {txt('CASE WHEN due - shipped <= 45 THEN shipped END', 'shipped')} FROM a""")
def asof_join(spark, sf):
    """The last line of each order that had been shipped 60 days after the order, if that was in the 45 days before."""
    o = T.table(spark, sf, "orders").select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 60).alias("due"))
    s = T.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    out = R.nearest_join(o, s, ("due", "day"), [("o_orderkey", "l_orderkey")], {"l_linenumber": "l_linenumber", "shipped": "day"},
                         "backward", 45, ["l_linenumber"])
    return shape(out, ["shipped"], ["o_orderkey", "l_linenumber"])
