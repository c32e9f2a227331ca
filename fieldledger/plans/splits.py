"""Queries over splits, contamination and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import splits as P
from ..sources import tables as T
from .common import KEY_SQL, LINE_KEY_SQL, num, flt, row_key, shape, tx_sql
from .registry import query


def tx(spark, sf):
    return T.transactions(spark, sf).withColumn("row_key", row_key())


def lines(spark, sf):
    return T.table(spark, sf, "lineitem").withColumn("row_key", row_key("l_shipdate")).withColumn(
        "label", (F.col("l_quantity") >= 50).cast("int"))


LINES_SQL = f"li AS (SELECT *, {LINE_KEY_SQL} AS row_key, CAST(l_quantity >= 50 AS BIGINT) AS label FROM lineitem)"


@query("chronological_split", tx_sql(
    f"SELECT {KEY_SQL} AS row_key, CASE WHEN date_post <= (SELECT cutoff FROM cut) THEN 'train' ELSE 'test' END AS split FROM tx"))
def chronological_split(spark, sf):
    return shape(P.chronological_split(tx(spark, sf), "date_post"), ["row_key", "split"])


@query("normal_abnormal_split", f"WITH {LINES_SQL} SELECT row_key, CASE label WHEN 0 THEN 'normal' ELSE 'abnormal' END AS part FROM li")
def normal_abnormal_split(spark, sf):
    li = lines(spark, sf)
    normal = li.where("label = 0").withColumn("part", F.lit("normal"))
    return shape(normal.unionByName(li.where("label = 1").withColumn("part", F.lit("abnormal"))), ["row_key", "part"])


HALF_SQL = f"""{LINES_SQL}, half AS (SELECT *, md5(concat_ws('|', row_key, 42)) AS h,
  CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', row_key, 42)))
       <= floor(count(*) OVER (PARTITION BY label) / 2) THEN 'train' ELSE 'test' END AS split FROM li)"""


@query("random_half_split", f"WITH {HALF_SQL} SELECT row_key, {num('label')}, split FROM half")
def random_half_split(spark, sf):
    return shape(P.random_half_split(lines(spark, sf), "row_key", "label"), ["row_key", "split"], ["label"])


@query("stratified_split", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat_ws('|', event_id, 777))) AS rn,
  count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT {num('event_id')}, event_type, CASE WHEN rn <= ceil(n * 0.2::DOUBLE) THEN 'val' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, sf):
    return shape(P.stratified_split(T.events(spark, sf), "event_id", "event_type"), ["event_type", "split"], ["event_id"])


GAP_SQL = """g AS (SELECT *, l_orderkey % 5 = 0 AS g1, l_orderkey % 10 = 0 AS g2 FROM li)"""


def with_gaps(df):
    """Features with NaN: the first where l_orderkey % 5 = 0, both where it is % 10."""
    nan, k = F.lit(float("nan")), F.col("l_orderkey")
    return df.withColumn("features", F.array(
        F.when(k % 5 == 0, nan).otherwise(F.col("l_quantity")), F.when(k % 10 == 0, nan).otherwise(F.col("l_extendedprice"))))


@query("drop_all_missing_rows", f"WITH {LINES_SQL}, {GAP_SQL} SELECT row_key FROM g WHERE NOT g2")
def drop_all_missing_rows(spark, sf):
    return shape(P.drop_all_missing_rows(with_gaps(lines(spark, sf)), "features"), ["row_key"])


@query("drop_any_missing_rows", f"WITH {LINES_SQL}, {GAP_SQL} SELECT row_key, 'removed' AS mode FROM g WHERE NOT g1 "
       "UNION ALL SELECT row_key, 'per dimension' AS mode FROM g WHERE (SELECT bool_or(g1) FROM g)")
def drop_any_missing_rows(spark, sf):
    gaps = with_gaps(lines(spark, sf))
    removed = P.drop_any_missing_rows(gaps, "features", True).withColumn("mode", F.lit("removed"))
    kept = P.drop_any_missing_rows(gaps, "features").where("per_dimension").withColumn("mode", F.lit("per dimension"))
    return shape(removed.unionByName(kept), ["row_key", "mode"])


@query("drop_missing_target", f"WITH {LINES_SQL}, {GAP_SQL} SELECT row_key, {num('0', 'd')}, {flt('l_quantity', 'y')} FROM g WHERE NOT g1 "
       f"UNION ALL SELECT row_key, {num('1', 'd')}, {flt('l_extendedprice', 'y')} FROM g WHERE NOT g2")
def drop_missing_target(spark, sf):
    long = with_gaps(lines(spark, sf)).select("row_key", F.posexplode("features").alias("d", "y"))
    return shape(long.where(~F.isnan("y")), ["row_key"], ["d"], ["y"])


LEVELS_SQL = """tr AS (SELECT * FROM half WHERE split = 'train'),
sizes AS (SELECT count(*) FILTER (label = 0)::DOUBLE AS nn, count(*) FILTER (label = 1)::DOUBLE AS na FROM tr),
lv AS (SELECT i AS level_idx, nn, na, 0.001::DOUBLE + (na / (na + nn) - 0.001::DOUBLE) * i / 9.0::DOUBLE AS level
       FROM sizes, (SELECT unnest(range(10)) AS i)),
levels AS (SELECT level_idx, level, least(floor(level * nn / (1.0::DOUBLE - level)), na) AS n_ab FROM lv)"""


def _parts(spark, sf):
    train = P.random_half_split(lines(spark, sf), "row_key", "label").where("split = 'train'")
    return train.where("label = 0"), train.where("label = 1")


@query("contamination_levels", f"WITH {HALF_SQL}, {LEVELS_SQL} SELECT {num('level_idx')}, {flt('level')}, {num('n_ab')} FROM levels")
def contamination_levels(spark, sf):
    return shape(P.contamination_levels(*_parts(spark, sf)), (), ["level_idx", "n_ab"], ["level"])


VEC_HALF_SQL = """half AS (SELECT vec_id, CAST(label = 9 AS BIGINT) AS label,
  md5(concat_ws('|', vec_id, 42)) AS h,
  CASE WHEN row_number() OVER (PARTITION BY label = 9 ORDER BY md5(concat_ws('|', vec_id, 42)))
       <= floor(count(*) OVER (PARTITION BY label = 9) / 2) THEN 'train' ELSE 'test' END AS split FROM embeddings)"""
CONTAM_SQL = f"""{VEC_HALF_SQL}, {LEVELS_SQL},
bad AS (SELECT vec_id, row_number() OVER (ORDER BY h) AS rn FROM tr WHERE label = 1),
contaminated AS (SELECT level_idx, vec_id, 0 AS label FROM tr, levels WHERE label = 0
  UNION ALL SELECT level_idx, vec_id, 1 AS label FROM bad JOIN levels ON rn <= n_ab)"""


def contaminated_vectors(spark, sf):
    train = P.random_half_split(T.vectors(spark, sf), "row_id", "label").where("split = 'train'")
    normal, bad = train.where("label = 0"), train.where("label = 1")
    return P.contaminate(normal, bad, P.contamination_levels(normal, bad), "row_id")


@query("contaminate", f"WITH {CONTAM_SQL} SELECT {num('level_idx')}, {num('vec_id', 'row_id')}, {num('label')} FROM contaminated")
def contaminate(spark, sf):
    return shape(contaminated_vectors(spark, sf), (), ["level_idx", "row_id", "label"])


@query("range_join_contamination", f"""WITH {CONTAM_SQL} SELECT {num('level_idx')}, {num('count(*)', 'n_rows')},
  {num('sum(label)', 'n_abnormal')} FROM contaminated GROUP BY level_idx""")
def range_join_contamination(spark, sf):
    out = contaminated_vectors(spark, sf).groupBy("level_idx").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_abnormal"))
    return shape(out, (), ["level_idx", "n_rows", "n_abnormal"])


@query("replicate_rows", f"SELECT {num('event_id')}, {num('copy')} FROM (SELECT event_id, unnest(range(4)) AS copy FROM events)")
def replicate_rows(spark, sf):
    return shape(P.replicate_rows(T.events(spark, sf), 4), (), ["event_id", "copy"])


@query("batch_assign", f"WITH {LINES_SQL} SELECT row_key, "
       f"{num('''CAST('0x' || substr(md5(concat_ws('|', row_key, 0)), 1, 8) AS BIGINT) % 7''', 'batch')} FROM li")
def batch_assign(spark, sf):
    return shape(P.batch_assign(lines(spark, sf), "row_key", 7), ["row_key"], ["batch"])


@query("shuffle_rows", f"WITH {LINES_SQL} SELECT row_key, md5(concat_ws('|', row_key, 0)) AS shuffle_key FROM li")
def shuffle_rows(spark, sf):
    return P.shuffle_rows(lines(spark, sf), "row_key").select("row_key", "shuffle_key")


@query("prefix_take", f"WITH {LINES_SQL} SELECT row_key FROM li WHERE label = 1 ORDER BY md5(concat_ws('|', row_key, 42)) LIMIT 500")
def prefix_take(spark, sf):
    return shape(P.prefix_take(lines(spark, sf).where("label = 1"), "row_key", 500), ["row_key"])
