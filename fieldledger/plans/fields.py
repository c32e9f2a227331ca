"""Queries over fields: fits, the nine scores, generation, imputation, classification.

Data: embeddings with class 9 as anomaly; fields are fitted on the normal rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields as M, prep
from ..sources import tables as T
from .common import flt, num, shape
from .registry import query
from .scalars import normal_sql
from ..functions import scalars as S

SPEC = dict(n_t=20, copies=20, bins=32)
FLOW, VP = M.FieldSpec("flow", **SPEC), M.FieldSpec("vp", **SPEC)
CONTRACTION = M.FieldSpec("contraction", **SPEC)

# z1: normal rows scaled to [-1, 1] by their range, zs: standardized
DATA_SQL = """v AS (SELECT vec_id, d, CAST(embedding[d + 1] AS DOUBLE) AS x, label AS class,
    CAST(label = 9 AS BIGINT) AS label FROM (SELECT *, unnest(range(len(embedding))) AS d FROM embeddings)),
rg AS (SELECT d, min(x) AS lo, max(x) AS hi, CASE WHEN max(x) > min(x) THEN max(x) - min(x) ELSE 1 END AS w,
    avg(x) AS mu, CASE WHEN max(x) > min(x) THEN stddev_pop(x) ELSE 1 END AS sd FROM v WHERE label = 0 GROUP BY d),
z AS (SELECT v.*, lo, hi, w, (x - lo) / w * 2 - 1 AS z1, (x - mu) / sd AS zs FROM v JOIN rg USING (d))"""


def bin_sql(x: str, spec) -> str:
    return (f"CAST(greatest(0, least({spec.bins - 1}, floor(({x} + {spec.span}::DOUBLE) * "
            f"{spec.bins / (2 * spec.span)}::DOUBLE))) AS BIGINT)")


def levels_sql(spec, levels) -> str:
    rows = []
    for i, t in levels:
        mean, std = S.vp_coefficients(t, spec.b0, spec.b1)
        a, b = {"flow": (t, 1 - t), "vp": (mean, std), "contraction": (1 - t, 0.0)}[spec.kind]
        rows.append(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE, {t!r}::DOUBLE)")
    return f"(VALUES {', '.join(rows)}) AS lv(t_idx, a, b, t)"


def fit_sql(spec, where="label = 0", by="0") -> str:
    """cell(lab, t_idx, d, bin, f) and every(lab, t_idx, d, f) for the binned learner, line(...) for linear."""
    if spec.kind == "contraction":
        noise, x1 = "(SELECT *, 0 AS k, 0.0::DOUBLE AS x0 FROM z)", "zs"
    else:
        key = f"concat_ws('|', vec_id, 'fit', {spec.seed})"
        noise = (f"(SELECT *, {normal_sql(key, 'k')} AS x0 FROM (SELECT *, unnest(range({spec.copies})) AS k FROM z WHERE {where}))")
        x1 = "z1"
    y = {"flow": f"{x1} - x0", "vp": "x0", "contraction": f"-(a * {x1})"}[spec.kind]
    return f"""nz AS MATERIALIZED {noise},
lg AS (SELECT {by} AS lab, t_idx, d, a * {x1} + b * x0 AS xt, {y} AS y FROM nz, {levels_sql(spec, spec.fit_levels)} WHERE {where}),
cell AS MATERIALIZED (SELECT lab, t_idx, d, {bin_sql('xt', spec)} AS bin, avg(y) AS f FROM lg GROUP BY ALL),
every AS MATERIALIZED (SELECT lab, t_idx, d, avg(y) AS f FROM lg GROUP BY ALL),
line AS MATERIALIZED (SELECT lab, t_idx, d, regr_slope(y, xt) AS s, regr_intercept(y, xt) AS c FROM lg GROUP BY ALL)"""


def field_join(rows: str, x: str, spec, t: str = "q.t_idx", lab: str = "0", extra: str = "") -> str:
    """rows joined to the field value f at x."""
    if spec.learner == "linear":
        return (f"(SELECT q.*, l.s * ({x}) + l.c AS f FROM {rows} q JOIN line l "
                f"ON l.t_idx = {t} AND l.d = q.d AND l.lab = {lab})")
    return (f"(SELECT q.*, coalesce(c.f, e.f) AS f FROM {rows} q JOIN every e ON e.t_idx = {t} AND e.d = q.d AND e.lab = {lab} "
            f"LEFT JOIN cell c ON c.t_idx = {t} AND c.d = q.d AND c.lab = {lab} AND c.bin = {bin_sql(x, spec)})")


def fitted(spark, sf, spec):
    v = T.vectors(spark, sf)
    if spec.kind == "contraction":
        v = prep.standard_scale_vector(v.where("label = 0"), v, "features", "features")
    return v, M.fit_field(v.where("label = 0"), "row_id", "features", spec)


def score_sql(spec, which: str, copies: int = 20, seed: int = 0, digits: int = 4) -> str:
    levels = [(i, (i / (spec.n_t - 1) if spec.kind == "contraction" else S.grid_levels(spec.n_t, spec.eps)[i]))
              for i in M.score_levels(spec, which)]
    head = f"WITH {DATA_SQL}, {fit_sql(spec)}"
    if spec.kind == "contraction":
        if which == "decision":
            return (f"{head}, p AS {field_join('z', 'zs', spec, '0')} SELECT {num('vec_id', 'row_id')}, "
                    f"{flt('sqrt(sum((f + zs) * (f + zs)))', 'score', digits)} FROM p GROUP BY vec_id")
        start = f"st AS (SELECT z.*, t_idx, a * zs AS xt, 0 AS k FROM z, {levels_sql(spec, levels)})"
        if which == "deviation":
            return (f"{head}, {start}, p AS {field_join('st', 'xt', spec, '0')} SELECT {num('vec_id', 'row_id')}, "
                    f"{flt('sum((xt + f) * (xt + f))', 'score', digits)} FROM p GROUP BY vec_id")
    else:
        key = f"concat_ws('|', vec_id, 'score', {seed})"
        start = (f"sn AS MATERIALIZED (SELECT *, {normal_sql(key, 'k')} AS x0 FROM (SELECT *, unnest(range({copies})) AS k FROM z)), "
                 f"st AS (SELECT sn.*, t_idx, b, a, a * z1 + b * x0 AS xt FROM sn, {levels_sql(spec, levels)})")
        gap = "(z1 - x0 - f)" if spec.kind == "flow" else "((f - x0) / b)"
        if which != "reconstruction":
            return (f"{head}, {start}, p AS {field_join('st', 'xt', spec)} SELECT {num('vec_id', 'row_id')}, "
                    f"{flt(f'sum({gap} * {gap}) / {copies}', 'score', digits)} FROM p GROUP BY vec_id")
    clip = "greatest(lo, least(hi, {}))"
    if spec.kind == "vp":
        guess = clip.format("((xt - b * f) / a + 1) / 2 * w + lo")
        seen = clip.format("x")
        return (f"{head}, {start}, p AS {field_join('st', 'xt', spec)} SELECT {num('vec_id', 'row_id')}, "
                f"{flt(f'sum(({seen} - {guess}) * ({seen} - {guess})) / {copies}', 'score', digits)} FROM p GROUP BY vec_id")
    # Euler: one CTE per step; rows past their last step stay
    h = 1.0 / (spec.n_t - 1)
    parts, prev = [], "st"
    for s in range(spec.n_t - 1):
        level = "0" if spec.kind == "contraction" else f"least(q.t_idx + {s}, {spec.n_t - 1})"
        joined = field_join(prev, "q.xt", spec, level)
        parts.append(f"e{s} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (CASE WHEN t_idx + {s} < {spec.n_t - 1} THEN xt + {h!r}::DOUBLE * f ELSE xt END AS xt) "
                     f"FROM {joined})")
        prev = f"e{s}"
    if spec.kind == "contraction":
        value = "sum(xt * xt)"
    else:
        seen, back = clip.format("x"), clip.format("(xt + 1) / 2 * w + lo")
        value = f"sum(({seen} - {back}) * ({seen} - {back})) / {copies}"
    return f"{head}, {start}, {', '.join(parts)} SELECT {num('vec_id', 'row_id')}, {flt(value, 'score', digits)} FROM {prev} GROUP BY vec_id"


def _score(name, spec, which):
    @query(name, score_sql(spec, which))
    def run(spark, sf):
        v, model = fitted(spark, sf, spec)
        return shape(M.score(v, "row_id", "features", model, which), (), ["row_id"], ["score"], 4)

    return run


for _spec, _prefix in ((FLOW, "flow"), (VP, "vp"), (CONTRACTION, "contraction")):
    for _which in ("deviation", "reconstruction", "decision"):
        _score(f"{_prefix}_{_which}_score", _spec, _which)
_score("flow_deviation_score_linear", M.FieldSpec("flow", "linear", **SPEC), "deviation")


def _cells(model):
    """Long form of a fitted grid."""
    out = model.table.select("label", F.posexplode("grid").alias("t_idx", "g"))
    out = out.select("label", "t_idx", F.posexplode("g").alias("d", "c"))
    return out.select("label", "t_idx", "d", F.posexplode("c").alias("bin", "f"))


CELLS_SQL = """, bins AS (SELECT unnest(range({bins})) AS bin)
SELECT {lab}, {t}, {d}, {b}, {f} FROM every e, bins b LEFT JOIN cell c ON c.lab = e.lab AND c.t_idx = e.t_idx AND c.d = e.d AND c.bin = b.bin"""


def cells_sql(spec, where="label = 0", by="0") -> str:
    return f"WITH {DATA_SQL}, {fit_sql(spec, where, by)}" + CELLS_SQL.format(
        bins=spec.bins, lab=num("e.lab", "label"), t=num("e.t_idx", "t_idx"), d=num("e.d", "d"), b=num("b.bin", "bin"),
        f=flt("coalesce(c.f, e.f)", "f", 5))


def _fit(name, spec):
    @query(name, cells_sql(spec))
    def run(spark, sf):
        return shape(_cells(fitted(spark, sf, spec)[1]), (), ["label", "t_idx", "d", "bin"], ["f"], 5)

    return run


_fit("fit_flow_field", FLOW)
_fit("fit_vp_field", VP)
_fit("fit_contraction_field", CONTRACTION)


def conditional(spark, sf, spec):
    """Fields per class % 3, over all rows."""
    v = T.vectors(spark, sf).withColumn("group", F.col("class") % 3)
    return v, M.fit_field(v, "row_id", "features", spec, label="group")


ALL_SQL = DATA_SQL.replace("FROM v WHERE label = 0 GROUP BY d", "FROM v GROUP BY d")


@query("fit_label_conditional", cells_sql(FLOW, "true", "class % 3").replace(DATA_SQL, ALL_SQL))
def fit_label_conditional(spark, sf):
    return shape(_cells(conditional(spark, sf, FLOW)[1]), (), ["label", "t_idx", "d", "bin"], ["f"], 5)


HOLES = "label = 0 AND (vec_id + d) % 5 <> 0"


@query("fit_per_dimension", cells_sql(FLOW, HOLES).replace("FROM v WHERE label = 0 GROUP BY d", f"FROM v WHERE {HOLES} GROUP BY d"))
def fit_per_dimension(spark, sf):
    """Every fifth cell is missing; each dimension is fitted on what it has."""
    v = T.vectors(spark, sf).where("label = 0")
    holes = v.withColumn("features", F.transform("features", lambda x, d: F.when(
        (F.col("row_id") + d) % 5 == 0, F.lit(float("nan"))).otherwise(x)))
    return shape(_cells(M.fit_field(holes, "row_id", "features", FLOW)), (), ["label", "t_idx", "d", "bin"], ["f"], 5)


FIELD_SQL = f"WITH {DATA_SQL}, {fit_sql(FLOW)}, p AS {field_join('z', 'z1', FLOW, '3')} SELECT {num('vec_id', 'row_id')}, {num('d')}, {flt('f', 'f', 5)} FROM p"


@query("predict_field", FIELD_SQL)
def predict_field(spark, sf):
    """Field at the scaled data, level 3, from the packed model."""
    v, model = fitted(spark, sf, FLOW)
    v = v.withColumns({"_g": model.grid(), "_r": model.range_array()})
    f = F.zip_with(prep.scale_to_unit(F.col("features"), F.col("_r")), F.col("_g")[3], lambda x, g: M.predict(g, x, FLOW))
    return shape(v.select("row_id", F.posexplode(f).alias("d", "f")), (), ["row_id", "d"], ["f"], 5)


@query("model_join", FIELD_SQL)
def model_join(spark, sf):
    """The same values from an equi join of cells (level, dimension, bin) and the model table."""
    v, model = fitted(spark, sf, FLOW)
    v = v.withColumn("_r", model.range_array())
    rows = v.select("row_id", F.posexplode(prep.scale_to_unit(F.col("features"), F.col("_r"))).alias("d", "x"))
    rows = rows.withColumns({"t_idx": F.lit(3), "bin": M.bin_of(F.col("x"), FLOW)})
    out = rows.join(_cells(model).drop("label"), ["t_idx", "d", "bin"])
    return shape(out, (), ["row_id", "d"], ["f"], 5)


def _steps_sql(spec, start: str, schedule, noise_key: str) -> str:
    """Reverse SDE, one CTE per entry; start names a CTE with x."""
    parts, prev = [], start
    for s in schedule:
        joined = field_join(prev, "q.xt", spec, str(s["i"]))
        shake = f"sqrt({s['beta']!r}::DOUBLE) * sqrt({s['h']!r}::DOUBLE) * {normal_sql(noise_key, str(s['s']))}"
        drift = f"(-0.5::DOUBLE * {s['beta']!r}::DOUBLE * xt)"
        if s["back"]:
            new = f"xt + {drift} * {s['h']!r}::DOUBLE + {shake}"
        else:
            new = f"xt - ({drift} - {s['beta']!r}::DOUBLE * (-f / {s['std']!r}::DOUBLE)) * {s['h']!r}::DOUBLE + {shake}"
        parts.append(f"r{s['s']} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE ({new} AS xt) FROM {joined})")
        prev = f"r{s['s']}"
    _, std = S.vp_coefficients(spec.eps, spec.b0, spec.b1)
    parts.append(f"fin AS (SELECT *, greatest(lo, least(hi, (xt - {std!r}::DOUBLE * f + 1) / 2 * w + lo)) AS value FROM "
                 f"{field_join(prev, 'q.xt', spec, '0')})")
    return ", ".join(parts)


def generate_flow_sql() -> str:
    h = 1.0 / (FLOW.n_t - 1)
    parts, prev = [], "st"
    for s in range(FLOW.n_t - 1):
        parts.append(f"e{s} AS MATERIALIZED (SELECT * EXCLUDE (f) REPLACE (xt + {h!r}::DOUBLE * f AS xt) FROM {field_join(prev, 'q.xt', FLOW, str(s))})")
        prev = f"e{s}"
    key = "concat_ws('|', vec_id, 'generate', 0)"
    return (f"WITH {DATA_SQL}, {fit_sql(FLOW)}, st AS (SELECT *, {normal_sql(key)} AS xt FROM z), {', '.join(parts)} "
            f"SELECT {num('vec_id', 'row_id')}, {num('d')}, {flt('greatest(lo, least(hi, (xt + 1) / 2 * w + lo))', 'value', 4)} FROM {prev}")


@query("generate_flow", generate_flow_sql())
def generate_flow(spark, sf):
    """One synthetic row per row of the table."""
    v, model = fitted(spark, sf, FLOW)
    out = M.generate(v.select("row_id"), "row_id", model)
    return shape(out.select("row_id", F.posexplode("generated").alias("d", "value")), (), ["row_id", "d"], ["value"], 4)


GENERATE_VP_SQL = (
    f"WITH {DATA_SQL}, {fit_sql(VP)}, st AS (SELECT *, " + normal_sql("concat_ws('|', vec_id, 'generate', 0)")
    + " AS xt FROM z), " + _steps_sql(VP, "st", M.reverse_schedule(VP), "concat_ws('|', vec_id, 'step', 0)")
    + f" SELECT {num('vec_id', 'row_id')}, {num('d')}, {flt('value', 'value', 4)} FROM fin")


@query("generate_vp", GENERATE_VP_SQL)
def generate_vp(spark, sf):
    v, model = fitted(spark, sf, VP)
    out = M.generate(v.select("row_id"), "row_id", model)
    return shape(out.select("row_id", F.posexplode("generated").alias("d", "value")), (), ["row_id", "d"], ["value"], 4)


def impute_sql(repaint: bool) -> str:
    schedule = M.reverse_schedule(VP, repaint=repaint, r=2, j=0.3)
    start, key = "concat_ws('|', vec_id, 'impute', 0, k)", "concat_ws('|', vec_id, 'impute-step', 0, k)"
    return (f"WITH {DATA_SQL}, {fit_sql(VP)}, st AS MATERIALIZED (SELECT *, {normal_sql(start)} AS xt "
            f"FROM (SELECT *, unnest(range(2)) AS k FROM z)), {_steps_sql(VP, 'st', schedule, key)} "
            f"SELECT {num('vec_id', 'row_id')}, {num('k', 'imputation')}, {num('d')}, "
            f"{flt('CASE WHEN (vec_id + d) % 5 = 0 THEN value ELSE x END', 'value', 4)} FROM fin")


def _impute(name, repaint):
    @query(name, impute_sql(repaint))
    def run(spark, sf):
        v, model = fitted(spark, sf, VP)
        holes = v.withColumn("features", F.transform("features", lambda x, d: F.when(
            (F.col("row_id") + d) % 5 == 0, F.lit(float("nan"))).otherwise(x)))
        out = M.impute(holes, "row_id", "features", model, k=2, repaint=repaint, r=2, j=0.3)
        return shape(out.select("row_id", "imputation", F.posexplode("features").alias("d", "value")),
                     (), ["row_id", "imputation", "d"], ["value"], 4)

    return run


_impute("impute_vp", False)
_impute("impute_repaint", True)


def classify_sql(tail: str) -> str:
    looks, t = [], 0.0
    for s in range(9):
        t += 1.0 / 10
        for k in range(10):
            looks.append(f"({int(round(t * (FLOW.n_t - 1)))}, {t!r}::DOUBLE, {1 - t!r}::DOUBLE, {s * 10 + k})")
    key = "concat_ws('|', vec_id, 'classify', 0)"
    return (f"WITH {ALL_SQL}, {fit_sql(FLOW, 'true', 'class % 3')}, "
            f"nzl AS MATERIALIZED (SELECT *, a * z1 + b * x0 AS xt FROM (SELECT z.*, lk.*, {normal_sql(key, 's')} AS x0 FROM z, (VALUES {', '.join(looks)}) AS lk(t_idx, a, b, s))), "
            f"st AS (SELECT *, unnest(range(3)) AS lab3 FROM nzl), "
            f"p AS {field_join('st', 'q.xt', FLOW, 'q.t_idx', 'q.lab3')}, "
            f"ds AS (SELECT vec_id, lab3, sum((z1 - f - x0) * (z1 - f - x0)) / {len(looks)} AS dist FROM p GROUP BY vec_id, lab3) {tail}")


@query("classify_by_field", classify_sql(
    f"SELECT {num('vec_id', 'row_id')}, {num('arg_min(lab3, dist)', 'predicted')}, {flt('min(dist)', 'distance', 4)} FROM ds GROUP BY vec_id"))
def classify_by_field(spark, sf):
    v, model = conditional(spark, sf, FLOW)
    out = M.classify(v, "row_id", "features", model)
    return shape(out.withColumn("distance", F.array_min("distances")["distance"]), (), ["row_id", "predicted"], ["distance"], 4)


@query("classify_proba", classify_sql(
    f", mn AS (SELECT *, exp(min(dist) OVER (PARTITION BY vec_id) - dist) AS e FROM ds) "
    f"SELECT {num('vec_id', 'row_id')}, {num('lab3', 'label')}, {flt('e / sum(e) OVER (PARTITION BY vec_id)', 'proba', 4)} FROM mn"))
def classify_proba(spark, sf):
    v, model = conditional(spark, sf, FLOW)
    out = M.classify(v, "row_id", "features", model)
    return shape(out.select("row_id", F.posexplode("proba").alias("label", "proba")), (), ["row_id", "label"], ["proba"], 4)
