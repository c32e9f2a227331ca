"""Queries over the preprocessing operators. Fitted on split = train, applied to all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as P
from ..sources import tables as T
from .common import LINE_KEY_SQL, flt, num, row_key, shape
from .registry import query

NUM = ["q", "price", "disc", "tax"]
NUM_SQL = f"""li AS (SELECT {LINE_KEY_SQL} AS row_key, l_orderkey, l_quantity AS q, l_extendedprice AS price,
  l_discount AS disc, l_tax AS tax, 1.0::DOUBLE AS flat,
  CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS gap,
  CASE WHEN l_orderkey % 10 < 6 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split
  FROM lineitem), train AS (SELECT * FROM li WHERE split = 'train')"""


def numbers(spark, sf):
    k = F.col("l_orderkey")
    return T.table(spark, sf, "lineitem").select(
        row_key("l_shipdate").alias("row_key"), "l_orderkey", F.col("l_quantity").alias("q"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.lit(1.0).alias("flat"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("gap"),
        F.when(k % 10 < 6, "train").when(k % 10 < 8, "val").otherwise("test").alias("split"))


def train_of(df):
    return df.where("split = 'train'")


@query("standard_scale", f"WITH {NUM_SQL}, s AS (SELECT avg(q) mq, stddev_pop(q) sq, avg(price) mp, stddev_pop(price) sp FROM train) "
       f"SELECT row_key, {flt('(q - mq) / sq', 'q')}, {flt('(price - mp) / sp', 'price')}, {flt('0', 'flat')} FROM li, s")
def standard_scale(spark, sf):
    df = numbers(spark, sf)
    return shape(P.standard_scale(train_of(df), df, ["q", "price", "flat"]), ["row_key"], (), ["q", "price", "flat"])


MM = "s AS (SELECT min(q) lq, max(q) hq, min(price) lp, max(price) hp FROM train)"


@query("minmax_scale", f"WITH {NUM_SQL}, {MM} SELECT row_key, {flt('(q - lq) / (hq - lq) * 2 - 1', 'q')}, "
       f"{flt('(price - lp) / (hp - lp) * 2 - 1', 'price')}, {flt('-1', 'flat')} FROM li, s")
def minmax_scale(spark, sf):
    df = numbers(spark, sf)
    return shape(P.minmax_scale(train_of(df), df, ["q", "price", "flat"]), ["row_key"], (), ["q", "price", "flat"])


@query("minmax_unscale", f"WITH {NUM_SQL}, {MM} SELECT row_key, {flt('(disc * 10 + 1) / 2 * (hq - lq) + lq', 'q')}, "
       f"{flt('(tax * 10 + 1) / 2 * (hp - lp) + lp', 'price', 4)} FROM li, s")
def minmax_unscale(spark, sf):
    df = numbers(spark, sf)
    unit = df.withColumns({"q": F.col("disc") * 10, "price": F.col("tax") * 10})
    out = P.minmax_unscale(train_of(df), unit, ["q", "price"])
    return out.select("row_key", F.round("q", 6).alias("q"), F.round("price", 4).alias("price"))


ACKLAM_SQL = """CASE WHEN p < 0.02425 THEN
  (((((-7.784894002430293e-03*sqrt(-2*ln(p))-3.223964580411365e-01)*sqrt(-2*ln(p))-2.400758277161838e+00)*sqrt(-2*ln(p))-2.549732539343734e+00)*sqrt(-2*ln(p))+4.374664141464968e+00)*sqrt(-2*ln(p))+2.938163982698783e+00)
  / ((((7.784695709041462e-03*sqrt(-2*ln(p))+3.224671290700398e-01)*sqrt(-2*ln(p))+2.445134137142996e+00)*sqrt(-2*ln(p))+3.754408661907416e+00)*sqrt(-2*ln(p))+1)
 WHEN p > 1 - 0.02425 THEN
  -(((((-7.784894002430293e-03*sqrt(-2*ln(1-p))-3.223964580411365e-01)*sqrt(-2*ln(1-p))-2.400758277161838e+00)*sqrt(-2*ln(1-p))-2.549732539343734e+00)*sqrt(-2*ln(1-p))+4.374664141464968e+00)*sqrt(-2*ln(1-p))+2.938163982698783e+00)
  / ((((7.784695709041462e-03*sqrt(-2*ln(1-p))+3.224671290700398e-01)*sqrt(-2*ln(1-p))+2.445134137142996e+00)*sqrt(-2*ln(1-p))+3.754408661907416e+00)*sqrt(-2*ln(1-p))+1)
 ELSE (((((-3.969683028665376e+01*(p-0.5)^2+2.209460984245205e+02)*(p-0.5)^2-2.759285104469687e+02)*(p-0.5)^2+1.383577518672690e+02)*(p-0.5)^2-3.066479806614716e+01)*(p-0.5)^2+2.506628277459239e+00)*(p-0.5)
  / (((((-5.447609879822406e+01*(p-0.5)^2+1.615858368580409e+02)*(p-0.5)^2-1.556989798598866e+02)*(p-0.5)^2+6.680131188771972e+01)*(p-0.5)^2-1.328068155288572e+01)*(p-0.5)^2+1) END"""


def quantile_sql(col: str) -> str:
    return f"""WITH {NUM_SQL},
n AS (SELECT greatest(least(count(*) // 30, 1000), 10) AS n_q FROM train),
ranked AS (SELECT {col} AS x, row_number() OVER (ORDER BY {col}) - 1 AS r, count(*) OVER () AS m FROM train),
grid AS (SELECT unnest(range(n_q)) AS i, n_q FROM n),
pos AS (SELECT i, n_q, i::DOUBLE / (n_q - 1) * ((SELECT max(m) FROM ranked) - 1) AS h FROM grid),
q AS (SELECT i, n_q, lo.x + (h - floor(h)) * (coalesce(hi.x, lo.x) - lo.x) AS v FROM pos
  JOIN ranked lo ON lo.r = floor(h) LEFT JOIN ranked hi ON hi.r = floor(h) + 1),
u AS (SELECT v, min(i) AS f, max(i) AS l, any_value(n_q) AS n_q, lead(v) OVER (ORDER BY v) AS nv,
  lead(min(i)) OVER (ORDER BY v) AS nf FROM q GROUP BY v),
c AS (SELECT row_key, {col} AS x, u.* FROM li ASOF LEFT JOIN u ON {col} >= v),
pr AS (SELECT row_key, greatest(1e-7, least(1 - 1e-7, CASE WHEN v IS NULL OR f = 0 AND x = v THEN 0
    WHEN nv IS NULL THEN 1 WHEN x = v THEN (f + l) / 2.0 / (n_q - 1)
    ELSE (l + (x - v) / (nv - v) * (nf - l)) / (n_q - 1) END))::DOUBLE AS p FROM c)
SELECT row_key, {flt(ACKLAM_SQL, 'z', 4)} FROM pr"""


@query("quantile_normalize", quantile_sql("price"))
def quantile_normalize(spark, sf):
    df = numbers(spark, sf)
    out = P.quantile_normalize(train_of(df), df, ["price"])
    return shape(out.withColumn("z", F.col("price")), ["row_key"], (), ["z"], 4)


@query("impute_mean", f"WITH {NUM_SQL} SELECT row_key, {flt('coalesce(gap, (SELECT avg(gap) FROM train))', 'gap')} FROM li")
def impute_mean(spark, sf):
    df = numbers(spark, sf)
    return shape(P.impute_mean(train_of(df), df, ["gap"]), ["row_key"], (), ["gap"])


@query("drop_nan_rows", f"WITH {NUM_SQL} SELECT row_key, {flt('gap')} FROM li WHERE split <> 'test' AND gap IS NOT NULL "
       f"UNION ALL SELECT row_key, {flt('q', 'gap')} FROM li WHERE split = 'test'")
def drop_nan_rows(spark, sf):
    df = numbers(spark, sf)
    df = df.withColumn("gap", F.when(F.col("split") == "test", F.col("q")).otherwise(F.col("gap")))
    return shape(P.drop_nan_rows(df, ["gap"], "split"), ["row_key"], (), ["gap"])


@query("standardize_target", f"WITH {NUM_SQL} SELECT row_key, {flt('(price - (SELECT avg(price) FROM train)) / (SELECT stddev_pop(price) FROM train)', 'price')} FROM li")
def standardize_target(spark, sf):
    df = numbers(spark, sf)
    return shape(P.standardize_target(train_of(df), df, "price"), ["row_key"], (), ["price"])


@query("feature_min_max", f"WITH v AS (SELECT unnest(range(len(embedding))) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings) "
       f"SELECT {num('d')}, {flt('min(x)', 'lo')}, {flt('max(x)', 'hi')}, {flt('avg(x)', 'mean')}, {num('count(*)', 'n')} FROM v GROUP BY d")
def feature_min_max(spark, sf):
    return shape(P.vector_stats(T.vectors(spark, sf), "features"), (), ["d", "n"], ["lo", "hi", "mean"])


@query("clip_to_training_range", f"WITH {NUM_SQL}, {MM} SELECT row_key, "
       f"{flt('greatest(lq, least(hq, round_even(q * 1.3 - 5.05, 0)))', 'q')}, "
       f"{flt('greatest(lp, least(hp, price * 1.25 - 900))', 'price', 4)} FROM li, s")
def clip_to_training_range(spark, sf):
    df = numbers(spark, sf)
    ranges = P.minmax_vector(train_of(df).withColumn("f", F.array("q", "price")), "f")
    out = df.withColumn("_r", ranges).withColumn("x", F.array(F.col("q") * 1.3 - 5.05, F.col("price") * 1.25 - 900))
    out = out.withColumn("x", P.clip_to_range("x", "_r", [0]))
    return out.select("row_key", F.round(F.col("x")[0], 6).alias("q"), F.round(F.col("x")[1], 4).alias("price"))


CAT_SQL = """c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 'nan' ELSE o_orderstatus END AS c0,
  o_orderpriority AS c1, c_mktsegment AS c2, o_totalprice AS y,
  CASE WHEN o_orderkey % 10 < 6 THEN 'train' WHEN o_orderkey % 10 < 8 THEN 'val' ELSE 'test' END AS split
  FROM orders JOIN customer ON o_custkey = c_custkey), ctrain AS (SELECT * FROM c WHERE split = 'train')"""


@query("impute_most_frequent", f"WITH {CAT_SQL}, m AS (SELECT c0 AS v FROM ctrain WHERE c0 <> 'nan' GROUP BY c0 ORDER BY count(*) DESC, c0 LIMIT 1) "
       f"SELECT {num('o_orderkey')}, CASE WHEN c0 = 'nan' THEN (SELECT v FROM m) ELSE c0 END AS c0 FROM c")
def impute_most_frequent(spark, sf):
    df = T.categorical(spark, sf)
    return shape(P.impute_most_frequent(train_of(df), df, ["c0"]), ["c0"], ["o_orderkey"])


@query("collapse_rare_categories", f"WITH {CAT_SQL}, k AS (SELECT c0 FROM ctrain GROUP BY c0 HAVING count(*) >= round_even((SELECT count(*) FROM ctrain) * 0.1, 0)) "
       f"SELECT {num('o_orderkey')}, CASE WHEN c0 IN (SELECT c0 FROM k) THEN c0 ELSE '__rare__' END AS c0 FROM c")
def collapse_rare_categories(spark, sf):
    df = T.categorical(spark, sf)
    return shape(P.collapse_rare(train_of(df), df, ["c0"], 0.1), ["c0"], ["o_orderkey"])


# fitted without the sentinel so that unseen values occur
@query("ordinal_encode", f"""WITH {CAT_SQL}, v0 AS (SELECT c0, row_number() OVER (ORDER BY c0) - 1 AS k FROM (SELECT DISTINCT c0 FROM ctrain WHERE c0 <> 'nan')),
v1 AS (SELECT c1, row_number() OVER (ORDER BY c1) - 1 AS k FROM (SELECT DISTINCT c1 FROM ctrain))
SELECT {num('o_orderkey')}, {num('coalesce(v0.k, (SELECT count(*) FROM v0))', 'c0')}, {num('v1.k', 'c1')}
FROM c LEFT JOIN v0 USING (c0) LEFT JOIN v1 USING (c1)""")
def ordinal_encode(spark, sf):
    df = T.categorical(spark, sf)
    return shape(P.ordinal_encode(train_of(df).where("c0 <> 'nan'"), df, ["c0", "c1"]), (), ["o_orderkey", "c0", "c1"])


@query("one_hot_encode", f"""WITH {CAT_SQL}, v AS (SELECT c2 AS v, row_number() OVER (ORDER BY c2) - 1 AS i FROM (SELECT DISTINCT c2 FROM ctrain))
SELECT {num('o_orderkey')}, {num('i')}, {flt('CASE WHEN c2 = v THEN 1 ELSE 0 END', 'x')} FROM c, v""")
def one_hot_encode(spark, sf):
    df = T.categorical(spark, sf)
    out = P.one_hot_encode(train_of(df), df, ["c2"])
    return shape(out.select("o_orderkey", F.posexplode("c2_onehot").alias("i", "x")), (), ["o_orderkey", "i"], ["x"])


@query("one_hot_drop_first", f"""WITH {CAT_SQL}, v AS (SELECT c2 AS v, row_number() OVER (ORDER BY c2) - 2 AS i FROM (SELECT DISTINCT c2 FROM ctrain))
SELECT {num('o_orderkey')}, {num('i')}, {flt('CASE WHEN c2 = v THEN 1 ELSE 0 END', 'x')} FROM c, v WHERE i >= 0""")
def one_hot_drop_first(spark, sf):
    df = T.categorical(spark, sf)
    out = P.one_hot_drop_first(train_of(df), df, ["c2"])
    return shape(out.select("o_orderkey", F.posexplode("c2_dummies").alias("i", "x")), (), ["o_orderkey", "i"], ["x"])


@query("decode_one_hot", f"""WITH {CAT_SQL}, v AS (SELECT c2, row_number() OVER (ORDER BY c2) - 1 AS i FROM (SELECT DISTINCT c2 FROM ctrain))
SELECT {num('o_orderkey')}, {num('CASE WHEN o_orderkey % 3 = 2 THEN i ELSE 0 END', 'code')} FROM c JOIN v USING (c2)""")
def decode_one_hot(spark, sf):
    """Dummies scaled by 0, 0.5 or 1: only above 0.5 do they beat the value without a dummy."""
    df = T.categorical(spark, sf)
    out = P.one_hot_drop_first(train_of(df), df, ["c2"])
    scaled = F.transform("c2_dummies", lambda x: x * (F.col("o_orderkey") % 3) / 2.0)
    return shape(out.withColumn("code", P.decode_one_hot(scaled)), (), ["o_orderkey", "code"])


@query("leave_one_out_encode", f"""WITH {CAT_SQL}, s AS (SELECT c1, sum(y) AS s, count(*) AS n FROM ctrain GROUP BY c1)
SELECT {num('o_orderkey')}, {flt("CASE WHEN split = 'train' THEN (s - y) / (n - 1) ELSE s / n END", 'loo', 3)} FROM c JOIN s USING (c1)""")
def leave_one_out_encode(spark, sf):
    df = T.categorical(spark, sf)
    out = P.leave_one_out_encode(train_of(df), df, "c1", "y", F.col("split") == "train")
    return shape(out.withColumn("loo", F.col("c1_loo")), (), ["o_orderkey"], ["loo"], 3)


@query("category_sizes", f"WITH {CAT_SQL} SELECT 'c0' AS \"column\", {num('count(DISTINCT c0)', 'n')} FROM c UNION ALL "
       f"SELECT 'c1', {num('count(DISTINCT c1)', 'n')} FROM c UNION ALL SELECT 'c2', {num('count(DISTINCT c2)', 'n')} FROM c")
def category_sizes(spark, sf):
    return shape(P.category_sizes(T.categorical(spark, sf), ["c0", "c1", "c2"]), ["column"], ["n"])


@query("class_priors", f"SELECT {num('label')}, {num('count(*)', 'n')}, {flt('count(*)::DOUBLE / (SELECT count(*) FROM embeddings)', 'prob')} FROM embeddings GROUP BY label")
def class_priors(spark, sf):
    out = P.class_priors(T.vectors(spark, sf).select(F.col("class").alias("label")), "label")
    return shape(out, (), ["label", "n"], ["prob"])


@query("concat_features", f"""WITH {CAT_SQL}, v AS (SELECT c2, row_number() OVER (ORDER BY c2) AS i FROM (SELECT DISTINCT c2 FROM ctrain)),
w AS (SELECT count(*) AS m FROM v)
SELECT {num('o_orderkey')}, {num('1 + m', 'width')}, {flt('y', 'first')}, {flt('i', 'hot_at')} FROM c JOIN v USING (c2), w""")
def concat_features(spark, sf):
    df = T.categorical(spark, sf)
    out = P.one_hot_encode(train_of(df), df, ["c2"]).withColumn("f", P.concat_features(F.array("y"), F.col("c2_onehot")))
    tail = F.slice("f", F.lit(2), F.size("f") - 1)
    return shape(out.withColumns({"width": F.size("f"), "first": F.col("f")[0],
                                  "hot_at": F.array_position(tail, F.lit(1.0))}),
                 (), ["o_orderkey", "width"], ["first", "hot_at"])


SNAP_SQL = f"""WITH u AS (SELECT DISTINCT p_retailprice AS v FROM part),
s AS (SELECT {LINE_KEY_SQL} AS row_key, l_extendedprice / l_quantity AS x FROM lineitem),
a AS (SELECT row_key, x, v AS lo FROM s ASOF LEFT JOIN u ON x >= v),
b AS (SELECT row_key, v AS hi FROM s ASOF LEFT JOIN u ON x <= v)
SELECT row_key, {flt('CASE WHEN lo IS NULL THEN hi WHEN hi IS NULL OR x - lo <= hi - x THEN lo ELSE hi END', 'snapped')}
FROM a JOIN b USING (row_key)"""


def _snap(spark, sf):
    real = T.table(spark, sf, "part").select(F.col("p_retailprice").alias("x"))
    synth = T.table(spark, sf, "lineitem").select(
        row_key("l_shipdate").alias("row_key"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"))
    return shape(P.snap_to_real(real, synth, "x").withColumn("snapped", F.col("x_snapped")), ["row_key"], (), ["snapped"])


query("snap_to_real_values", SNAP_SQL)(_snap)


@query("transform_dataset", f"""WITH {CAT_SQL},
m AS (SELECT c0 AS v FROM ctrain WHERE c0 <> 'nan' GROUP BY c0 ORDER BY count(*) DESC, c0 LIMIT 1),
f AS (SELECT *, CASE WHEN c0 = 'nan' THEN (SELECT v FROM m) ELSE c0 END AS d0, y / 1000 AS x FROM c),
k AS (SELECT d0 FROM f WHERE split = 'train' GROUP BY d0 HAVING count(*) >= round_even((SELECT count(*) FROM ctrain) * 0.3, 0)),
g AS (SELECT *, CASE WHEN d0 IN (SELECT d0 FROM k) THEN d0 ELSE '__rare__' END AS e0 FROM f),
v AS (SELECT e0, row_number() OVER (ORDER BY e0) - 1 AS code FROM (SELECT DISTINCT e0 FROM g WHERE split = 'train')),
s AS (SELECT avg(x) mx, stddev_pop(x) sx, avg(y) my, stddev_pop(y) sy FROM g WHERE split = 'train')
SELECT {num('o_orderkey')}, {num('coalesce(code, (SELECT count(*) FROM v))', 'c0')}, {flt('(x - mx) / sx', 'x')}, {flt('(y - my) / sy', 'y')}
FROM g LEFT JOIN v USING (e0), s""")
def transform_dataset(spark, sf):
    df = T.categorical(spark, sf).withColumn("x", F.col("y") / 1000)
    spec = P.TransformSpec(num=("x",), cat=("c0",), y="y", key=("o_orderkey",), num_nan="mean",
                           normalization="standard", cat_nan="most_frequent", min_frequency=0.3,
                           target_policy="default")
    return shape(P.transform_dataset(df, spec), (), ["o_orderkey", "c0"], ["x", "y"])
