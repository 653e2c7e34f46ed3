"""Catalog entries for meta-learners, DML, the causal forest (E12-E18, F16, G3) and refutation (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_PLACEBO, fold_sql, standard_normal_sql, uniform_sql
from causeway.operators import hte as G
from causeway.operators import learners as L
from causeway.operators import refute as RF
from causeway.plans.catalog import register, rnd
from causeway.plans.frames import orders_causal, orders_holes, with_holes, with_oc
from causeway.spec import CausalSpec

SPEC = CausalSpec("tc", "y_hte", ("x1", "x2"), id_col="id")
CELLS = L.CellMean(("seg", "x1_band"))
FOREST = L.Forest()
N_SIMS = 100

_CM_SQL = """
cm AS (SELECT seg, x1_band, avg(CASE WHEN tc = 1 THEN y_hte END) AS m1, avg(CASE WHEN tc = 0 THEN y_hte END) AS m0
       FROM oc GROUP BY seg, x1_band),
gm AS (SELECT avg(CASE WHEN tc = 1 THEN y_hte END) AS g1, avg(CASE WHEN tc = 0 THEN y_hte END) AS g0 FROM oc),
ite AS (SELECT oc.*, coalesce(m1, g1) - coalesce(m0, g0) AS Estimated_ITE FROM oc JOIN cm USING (seg, x1_band), gm)"""


def _cm_ite(spark, sf_dir):
    return L.s_learner(orders_causal(spark, sf_dir), SPEC, CELLS)


@register("e12_s_learner_cell_mean", with_oc("SELECT round(avg(Estimated_ITE), 6) AS ate FROM ite", _CM_SQL))
def e12_s_learner_cell_mean(spark, sf_dir):
    return rnd(_cm_ite(spark, sf_dir).agg(F.avg(L.ITE).alias("ate")), 6)


@register("e13_t_learner_cell_mean", with_oc("SELECT round(avg(Estimated_ITE), 6) AS ate FROM ite", _CM_SQL))
def e13_t_learner_cell_mean(spark, sf_dir):
    return rnd(L.t_learner(orders_causal(spark, sf_dir), SPEC, CELLS).agg(F.avg(L.ITE).alias("ate")), 6)


@register("e18_ite_table_cell_mean", with_oc("SELECT id, round(Estimated_ITE, 4) AS Estimated_ITE FROM ite", _CM_SQL))
def e18_ite_table_cell_mean(spark, sf_dir):
    return rnd(_cm_ite(spark, sf_dir).select("id", L.ITE), 4)


@register("e12_s_learner_missing", with_holes("SELECT id, round(Estimated_ITE, 4) AS Estimated_ITE FROM ite", _CM_SQL))
def e12_s_learner_missing(spark, sf_dir):
    return rnd(L.s_learner(orders_holes(spark, sf_dir), SPEC, CELLS, missing="drop").select("id", L.ITE), 4)


@register("e13_t_learner_missing", with_holes("SELECT round(avg(Estimated_ITE), 6) AS ate FROM ite", _CM_SQL))
def e13_t_learner_missing(spark, sf_dir):
    return rnd(L.t_learner(orders_holes(spark, sf_dir), SPEC, CELLS, missing="drop").agg(F.avg(L.ITE).alias("ate")), 6)


@register("e12_s_learner_forest")
def e12_s_learner_forest(spark, sf_dir):
    return L.learner_estimate(orders_causal(spark, sf_dir), SPEC, "s_learner", FOREST)


@register("e13_t_learner_forest")
def e13_t_learner_forest(spark, sf_dir):
    return L.learner_estimate(orders_causal(spark, sf_dir), SPEC, "t_learner", FOREST)


_RES_SQL = f"""
fo AS (SELECT *, {fold_sql('id', 3)} AS fold FROM oc),
cf AS (SELECT seg, x1_band, fold, sum(y_hte) AS sy, sum(tc) AS st, count(*) AS n FROM fo GROUP BY seg, x1_band, fold),
cc AS (SELECT seg, x1_band, sum(sy) AS csy, sum(st) AS cst, sum(n) AS cn FROM cf GROUP BY seg, x1_band),
ff AS (SELECT fold, sum(y_hte) AS fsy, sum(tc) AS fst, count(*) AS fn FROM fo GROUP BY fold),
tt AS (SELECT sum(fsy) AS tsy, sum(fst) AS tst, sum(fn) AS tn FROM ff),
oof AS (SELECT cf.seg, cf.x1_band, cf.fold,
          CASE WHEN cn - n > 0 THEN (csy - sy) / (cn - n) ELSE (tsy - fsy) / (tn - fn) END AS my,
          CASE WHEN cn - n > 0 THEN (cst - st) / (cn - n) ELSE (tst - fst) / (tn - fn) END AS mt
        FROM cf JOIN cc USING (seg, x1_band) JOIN ff USING (fold), tt),
res AS (SELECT fo.*, y_hte - my AS y_res, tc - mt AS t_res FROM fo JOIN oof USING (seg, x1_band, fold))"""


@register("e14_dml_residuals_cell_mean", with_oc(
    "SELECT id, fold, round(y_res, 4) AS y_res, round(t_res, 4) AS t_res FROM res", _RES_SQL))
def e14_dml_residuals_cell_mean(spark, sf_dir):
    res = L.dml_residuals(orders_causal(spark, sf_dir), SPEC, CELLS, 3)
    # per-row values of magnitude 1e2-1e3: 4 decimals (summation order differs between engines)
    return rnd(res.select("id", F.col("_fold").alias("fold"), F.col("_y_res").alias("y_res"),
                          F.col("_t_res").alias("t_res")), 4)


@register("e14_dml_residuals_missing", with_holes(
    "SELECT id, fold, round(y_res, 4) AS y_res, round(t_res, 4) AS t_res FROM res", _RES_SQL))
def e14_dml_residuals_missing(spark, sf_dir):
    res = L.dml_residuals(orders_holes(spark, sf_dir), SPEC, CELLS, 3, missing="drop")
    return rnd(res.select("id", F.col("_fold").alias("fold"), F.col("_y_res").alias("y_res"),
                          F.col("_t_res").alias("t_res")), 4)


@register("e15_dml_constant_effect_cell_mean", with_oc(
    "SELECT round(sum(t_res * y_res) / sum(t_res * t_res), 6) AS theta FROM res", _RES_SQL))
def e15_dml_constant_effect_cell_mean(spark, sf_dir):
    res = L.dml_residuals(orders_causal(spark, sf_dir), SPEC, CELLS, 3)
    fs = L.dml_final_stage(res, SPEC, constant_effect=True)
    return rnd(spark.createDataFrame([(float(fs["theta"][0]),)], "theta double"), 6)


@register("e15_linear_dml_cell_mean")
def e15_linear_dml_cell_mean(spark, sf_dir):
    """Heterogeneous final stage theta(x) = theta0 + theta'x (planted: 400 + 200 x2)."""
    est, _ = L.linear_dml(orders_causal(spark, sf_dir), SPEC, CELLS)
    return est


@register("e14_e15_linear_dml_forest")
def e14_e15_linear_dml_forest(spark, sf_dir):
    est, _ = L.linear_dml(orders_causal(spark, sf_dir), SPEC, FOREST)
    return est


@register("e16_causal_forest")
def e16_causal_forest(spark, sf_dir):
    est, _, _, _ = L.causal_forest(orders_causal(spark, sf_dir), SPEC, FOREST, FOREST)
    return est


@register("e17_feature_importance")
def e17_feature_importance(spark, sf_dir):
    _, _, model, feats = L.causal_forest(orders_causal(spark, sf_dir), SPEC, FOREST, FOREST)
    return L.feature_importance(model, feats, spark)


_HIST30 = " + ".join(f"CAST(Estimated_ITE >= {i} * step + lo AS INTEGER)" for i in range(1, 30))


@register("f16_ite_histogram", with_oc(f"""
SELECT b.bin, round(b.bin * step + lo, 4) AS lower,
       round(CASE WHEN b.bin = 29 THEN hi ELSE (b.bin + 1) * step + lo END, 4) AS upper, coalesce(h.n, 0) AS n,
       round(ate, 4) AS ate
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(30)) b CROSS JOIN hr
LEFT JOIN (SELECT {_HIST30} AS bin, count(*) AS n FROM ite, hr GROUP BY 1) h ON b.bin = h.bin""", _CM_SQL,
    "hr AS (SELECT min(Estimated_ITE) AS lo, max(Estimated_ITE) AS hi, (max(Estimated_ITE) - min(Estimated_ITE)) / 30 "
    "AS step, avg(Estimated_ITE) AS ate FROM ite)"))
def f16_ite_histogram(spark, sf_dir):
    return rnd(L.ite_histogram(_cm_ite(spark, sf_dir), 30))


@register("g3_ite_slopes", with_oc(
    "SELECT 'x1' AS feature, round(regr_slope(Estimated_ITE, x1), 6) AS coef FROM ite "
    "UNION ALL SELECT 'x2', round(regr_slope(Estimated_ITE, x2), 6) FROM ite", _CM_SQL))
def g3_ite_slopes(spark, sf_dir):
    out = G.ite_slopes(_cm_ite(spark, sf_dir), L.ITE, ["x1", "x2"])
    return out.select("feature", F.round("coef", 6).alias("coef"))


@register("g3_ite_slopes_table")
def g3_ite_slopes_table(spark, sf_dir):
    return G.ite_slopes(_cm_ite(spark, sf_dir), L.ITE, ["x1", "x2", "seg"])


# ---- R: refutation ------------------------------------------------------------------------------

SPEC_R = CausalSpec("tc", "y_planted", (), id_col="id")
_SIMS = f"sm AS (SELECT oc.id, oc.tc, oc.y_planted, CAST(r.range AS INTEGER) AS sim FROM oc CROSS JOIN range({N_SIMS}) r)"
_OLS2 = """
SELECT sim, round((sty * sww - stw * swy) / (stt * sww - stw * stw), 6) AS estimate FROM (
  SELECT sim, covar_pop(tc, tc) AS stt, covar_pop(w, w) AS sww, covar_pop(tc, w) AS stw,
         covar_pop(tc, y_planted) AS sty, covar_pop(w, y_planted) AS swy FROM {src} GROUP BY sim)"""


@register("r1_random_common_cause_sims", with_oc(_OLS2.format(src="rc"), _SIMS,
    f"rc AS (SELECT *, {standard_normal_sql('id', 'sim')} AS w FROM sm)"))
def r1_random_common_cause_sims(spark, sf_dir):
    return rnd(RF.random_common_cause_sims(orders_causal(spark, sf_dir), SPEC_R, N_SIMS), 6)


@register("r2_placebo_sims", with_oc("""
SELECT sim, round(avg(CASE WHEN p = 1 THEN y_planted END) - avg(CASE WHEN p = 0 THEN y_planted END), 6) AS estimate
FROM pl GROUP BY sim""", _SIMS,
    f"pl AS (SELECT *, CAST({uniform_sql('id', SALT_PLACEBO, 'sim')} < (SELECT sum(tc) / count(*) FROM oc) AS INTEGER) "
    "AS p FROM sm)"))
def r2_placebo_sims(spark, sf_dir):
    return rnd(RF.placebo_sims(orders_causal(spark, sf_dir), SPEC_R, N_SIMS), 6)


@register("r2_placebo_sims_exact", with_oc(f"""
SELECT sim, round(avg(CASE WHEN u <= cut THEN y_planted END) - avg(CASE WHEN u > cut THEN y_planted END), 6) AS estimate
FROM ux JOIN (SELECT sim, max(u) AS cut FROM (
        SELECT sim, u, row_number() OVER (PARTITION BY sim ORDER BY u) AS rn FROM ux)
      WHERE rn <= (SELECT sum(tc) FROM oc) GROUP BY sim) USING (sim)
GROUP BY sim""",
    f"ux AS (SELECT oc.id, oc.y_planted, CAST(r.range AS INTEGER) AS sim, "
    f"{uniform_sql('oc.id', SALT_PLACEBO, 'r.range')} AS u FROM oc CROSS JOIN range({N_SIMS}) r)"))
def r2_placebo_sims_exact(spark, sf_dir):
    return rnd(RF.placebo_sims(orders_causal(spark, sf_dir), SPEC_R, N_SIMS, exact=True), 6)


@register("r1_r2_r3_refutation")
def r1_r2_r3_refutation(spark, sf_dir):
    return RF.refute(orders_causal(spark, sf_dir), CausalSpec("tc", "y_planted", ("x1", "x2"), id_col="id"), "ols", N_SIMS)


@register("r2_placebo_sims_multilevel", with_oc("""
SELECT sim, round(regr_slope(y_planted, p), 6) AS estimate FROM (
  SELECT pu.sim, pu.y_planted, (SELECT min(v) FROM lv WHERE pu.u < lv.thr) AS p FROM pu)
GROUP BY sim""",
    "lv AS (SELECT v, CAST(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) "
    "/ (SELECT count(x1_band) FROM oc) AS thr FROM (SELECT x1_band AS v, count(*) AS n FROM oc GROUP BY x1_band))",
    f"pu AS (SELECT oc.y_planted, CAST(r.range AS INTEGER) AS sim, {uniform_sql('oc.id', SALT_PLACEBO, 'r.range')} AS u "
    f"FROM oc CROSS JOIN range({N_SIMS}) r)"))
def r2_placebo_sims_multilevel(spark, sf_dir):
    """R2 for a treatment with many values (the acct-balance band): each value keeps its share."""
    spec = CausalSpec("x1_band", "y_planted", (), id_col="id")
    return rnd(RF.placebo_sims(orders_causal(spark, sf_dir), spec, N_SIMS), 6)


@register("r2_placebo_continuous", with_oc("""
SELECT sim, round((covar_pop(p, y_planted) * var_pop(x2) - covar_pop(x2, y_planted) * covar_pop(p, x2))
                  / (var_pop(p) * var_pop(x2) - covar_pop(p, x2) * covar_pop(p, x2)), 9) AS estimate
FROM px JOIN pv USING (place) GROUP BY sim""",
    "pv AS (SELECT y AS p, row_number() OVER (ORDER BY y DESC, id) AS place FROM oc)",
    "px AS (SELECT oc.x2, oc.y_planted, CAST(r.range AS INTEGER) AS sim, row_number() OVER (PARTITION BY r.range ORDER BY "
    f"md5(CAST(oc.id AS VARCHAR) || '-{SALT_PLACEBO}-' || CAST(r.range AS VARCHAR)), oc.id) AS place "
    f"FROM oc CROSS JOIN range({N_SIMS}) r)"))
def r2_placebo_continuous(spark, sf_dir):
    """R2 for a continuous treatment (the order's price): exact permutations of the column."""
    spec = CausalSpec("y", "y_planted", ("x2",), id_col="id")
    return rnd(RF.placebo_sims(orders_causal(spark, sf_dir), spec, N_SIMS), 9)
