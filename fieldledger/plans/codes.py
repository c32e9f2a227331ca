"""Queries over rows of typed columns: a number, a whole number and a category of each customer, coded for a field per group
(odd and even keys) and decoded inside it. With binned fields, so that the check SQL follows every step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import fields as M, prep
from ..operators.codec import Codec
from ..session import spread
from ..sources import tables as T
from .common import flt, num, shape, txt
from .fields import _steps_sql, field_join, fit_sql, levels_sql
from .registry import query
from .scalars import normal_sql

FLOW, VP = M.FieldSpec("flow"), M.FieldSpec("vp")
COLUMNS = (("c_acctbal", "numeric"), ("c_nationkey", "integer"), ("c_mktsegment", "categorical"))

# x0: balance, x1: nation, from 2 on one 0/1 number per segment but the first
DATA_SQL = """sg AS (SELECT c_mktsegment AS name, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)),
cu AS (SELECT c_custkey AS vec_id, c_custkey % 2 AS grp, c_acctbal, c_nationkey::DOUBLE AS nation, code FROM customer JOIN sg ON name = c_mktsegment),
v AS (SELECT vec_id, grp, 0 AS label, d, CASE d WHEN 0 THEN c_acctbal WHEN 1 THEN nation ELSE (code = d - 1)::DOUBLE END AS x
  FROM cu, (SELECT unnest(range((SELECT count(*) + 1 FROM sg))) AS d)),
rg AS (SELECT d, min(x) AS lo, max(x) AS hi, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS w FROM v GROUP BY d),
z AS MATERIALIZED (SELECT v.*, lo, hi, w, (x - lo) / w * 2 - 1 AS z1 FROM v JOIN rg USING (d))"""


def decoded_sql(rows: str, scaled: str, by: str) -> str:
    """Per `by`: c0, c1 (rounded, clamped) and code, the segment with the largest number above a half."""
    raw = f"(({scaled} + 1) / 2 * w + lo)"
    return (f"(SELECT {by}, max(greatest(lo, least(hi, {raw}))) FILTER (d = 0) AS c0, max(greatest(lo, least(hi, round_even({raw}, 0)))) FILTER (d = 1) AS c1, "
            f"CASE WHEN max({raw}) FILTER (d > 1) > 0.5 THEN arg_max(d - 1, {raw}) FILTER (d > 1) ELSE 0 END AS code FROM {rows} GROUP BY {by})")


def _coded(spark, sf):
    df = spread(T.table(spark, sf, "customer")).withColumn("grp", F.col("c_custkey") % 2)
    codec = Codec.of(df, COLUMNS)
    return df, codec, codec.encode(df)


RECONSTRUCTION_SQL = f"""WITH {DATA_SQL}, {fit_sql(VP, 'true', 'grp')},
sn AS MATERIALIZED (SELECT *, {normal_sql("concat_ws('|', vec_id, 'score', 0)", 'k')} AS x0 FROM (SELECT *, unnest(range(20)) AS k FROM z)),
st AS (SELECT sn.*, t_idx, a, b, a * z1 + b * x0 AS xt FROM sn, {levels_sql(VP, [(i, S.grid_levels(VP.n_t, VP.eps)[i]) for i in M.score_levels(VP, 'reconstruction')])}),
p AS (SELECT *, (xt - b * f) / a AS back FROM {field_join('st', 'xt', VP, lab='q.grp')}),
g AS {decoded_sql('p', 'back', 'vec_id, k, t_idx')}
SELECT {num('vec_id', 'c_custkey')}, {flt('sum((c_acctbal - c0) * (c_acctbal - c0) + (nation - c1) * (nation - c1) + (cu.code - g.code) * (cu.code - g.code)) / 20', 'score', 2)}
FROM g JOIN cu USING (vec_id) GROUP BY vec_id"""


@query("vp_reconstruction_score_columns", RECONSTRUCTION_SQL)
def vp_reconstruction_score_columns(spark, sf):
    """Reconstruction error in the units of the columns; a wrong segment counts by its distance in the vocabulary."""
    _, codec, df = _coded(spark, sf)
    model = M.fit_field(df, "c_custkey", "features", VP, label="grp", codec=codec)
    return shape(M.score(df, "c_custkey", "features", model, "reconstruction", label="grp"), (), ["c_custkey"], ["score"], 2)


def _generate_sql() -> str:
    uniform = "(CAST('0x' || substr(md5(concat_ws('|', vec_id, 'label', 0)), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE)"
    key = "concat_ws('|', vec_id, 'generate', 0)"
    parts, prev, h = [], "st", 1.0 / (FLOW.n_t - 1)
    for s in range(FLOW.n_t - 1):
        parts.append(f"e{s} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (xt + {h!r}::DOUBLE * f AS xt) FROM {field_join(prev, 'q.xt', FLOW, str(s), 'q.lab')})")
        prev = f"e{s}"
    return (f"WITH {DATA_SQL}, {fit_sql(FLOW, 'true', 'grp')}, pr AS (SELECT avg(1 - grp) AS even FROM cu), "
            f"st AS (SELECT z.*, CASE WHEN {uniform} < even THEN 0 ELSE 1 END AS lab, {normal_sql(key)} AS xt FROM z, pr), "
            f"{', '.join(parts)}, g AS {decoded_sql(prev, 'xt', 'vec_id, lab')} "
            f"SELECT {num('vec_id', 'c_custkey')}, {num('lab', 'grp')}, {num('c1', 'c_nationkey')}, {txt('name', 'c_mktsegment')}, {flt('c0', 'c_acctbal', 3)} FROM g JOIN sg USING (code)")


@query("generate_flow_columns", _generate_sql())
def generate_flow_columns(spark, sf):
    """A synthetic customer per key: the group drawn by its share, then balance, nation and segment."""
    df, codec, coded = _coded(spark, sf)
    model = M.fit_field(coded, "c_custkey", "features", FLOW, label="grp", codec=codec)
    out = M.generate(df.select("c_custkey"), "c_custkey", model, priors=prep.class_priors(df, "grp"), label="grp")
    return shape(codec.to_columns(out, "generated"), ["c_mktsegment"], ["c_custkey", "grp", "c_nationkey"], ["c_acctbal"], 3)


def _impute_sql() -> str:
    start, step = "concat_ws('|', vec_id, 'impute', 0, 0)", "concat_ws('|', vec_id, 'impute-step', 0, 0)"
    body = _steps_sql(VP, "st", M.reverse_schedule(VP), step).replace("c.lab = 0", "c.lab = q.grp").replace("e.lab = 0", "e.lab = q.grp")
    std = S.vp_coefficients(VP.eps, VP.b0, VP.b1)[1]
    return (f"WITH {DATA_SQL}, {fit_sql(VP, 'true', 'grp')}, st AS MATERIALIZED (SELECT z.*, {normal_sql(start)} AS xt FROM z), {body}, "
            f"g AS {decoded_sql('(SELECT *, xt - ' + repr(std) + '::DOUBLE * f AS done FROM fin)', 'done', 'vec_id')} "
            f"SELECT {num('vec_id', 'c_custkey')}, {num('CASE WHEN vec_id % 5 = 1 THEN c1 ELSE nation END', 'c_nationkey')}, {txt('name', 'c_mktsegment')}, "
            f"{flt('CASE WHEN vec_id % 5 = 2 THEN c0 ELSE c_acctbal END', 'c_acctbal', 3)} "
            f"FROM g JOIN cu USING (vec_id) JOIN sg ON sg.code = CASE WHEN vec_id % 5 = 0 THEN g.code ELSE cu.code END")


@query("impute_vp_columns", _impute_sql())
def impute_vp_columns(spark, sf):
    """Of three in five customers one column is missing: the segment, the nation or the balance."""
    df, codec, coded = _coded(spark, sf)
    model = M.fit_field(coded, "c_custkey", "features", VP, label="grp", codec=codec)
    gap = lambda c, k, kind: F.when(F.col("c_custkey") % 5 != k, F.col(c)).cast(kind).alias(c)
    holes = df.select("c_custkey", "grp", gap("c_mktsegment", 0, "string"), gap("c_nationkey", 1, "int"), gap("c_acctbal", 2, "double"))
    out = M.impute(codec.encode(holes), "c_custkey", "features", model, label="grp")
    return shape(codec.to_columns(out, "features"), ["c_mktsegment"], ["c_custkey", "c_nationkey"], ["c_acctbal"], 3)
