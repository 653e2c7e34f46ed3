"""Catalog entries for the estimators (E), uncertainty (U), heterogeneity (G) and refutation (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_BOOTSTRAP, poisson1_weight_sql, uniform_sql
from causeway.operators import inference as U
from causeway.operators import regression as R
from causeway.plans.catalog import register, rnd
from causeway.plans.frames import orders_causal, with_oc
from causeway.spec import CausalSpec

SPEC_PLANTED = CausalSpec("tc", "y_planted", ("x1",), id_col="id")
SPEC_DID = CausalSpec("tc", "y_did", (), time_period="post", id_col="id")
SPEC_LOGIT = CausalSpec("tc", "yb_planted", (), id_col="id")
SPEC_DID_LOGIT = CausalSpec("tc", "yb_planted", (), time_period="post", id_col="id")
Z975 = repr(R.Z975)
B_ORACLE = 50


def _coef_cols(df):
    return df.select("term", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"),
                     F.round("stat", 3).alias("stat"))


# ---- E1, E2: OLS --------------------------------------------------------------------------------

_OLS2_CTE = """
m AS (SELECT count(*) AS n, avg(tc) AS mt, avg(x1) AS mx, avg(y_planted) AS my,
        covar_pop(tc, tc) * count(*) AS stt, covar_pop(x1, x1) * count(*) AS sxx, covar_pop(tc, x1) * count(*) AS stx,
        covar_pop(tc, y_planted) * count(*) AS sty, covar_pop(x1, y_planted) * count(*) AS sxy,
        covar_pop(y_planted, y_planted) * count(*) AS syy FROM oc),
c AS (SELECT *, (sty * sxx - stx * sxy) / (stt * sxx - stx * stx) AS bt,
               (sxy * stt - stx * sty) / (stt * sxx - stx * stx) AS bx, stt * sxx - stx * stx AS det FROM m),
r AS (SELECT *, (syy - bt * sty - bx * sxy) / (n - 3) AS s2 FROM c)"""


@register("e1_ols_adjusted", with_oc("""
SELECT 'const' AS term, round(my - bt * mt - bx * mx, 6) AS coef,
       round(sqrt(s2 / n + s2 * (mt * mt * sxx - 2 * mt * mx * stx + mx * mx * stt) / det), 6) AS se,
       round((my - bt * mt - bx * mx) / sqrt(s2 / n + s2 * (mt * mt * sxx - 2 * mt * mx * stx + mx * mx * stt) / det), 3) AS stat
FROM r
UNION ALL SELECT 'tc', round(bt, 6), round(sqrt(s2 * sxx / det), 6), round(bt / sqrt(s2 * sxx / det), 3) FROM r
UNION ALL SELECT 'x1', round(bx, 6), round(sqrt(s2 * stt / det), 6), round(bx / sqrt(s2 * stt / det), 3) FROM r""",
                                         _OLS2_CTE))
def e1_ols_adjusted(spark, sf_dir):
    return _coef_cols(R.ols_coefficients(orders_causal(spark, sf_dir), SPEC_PLANTED))


@register("e1_ols_full_adjustment")
def e1_ols_full_adjustment(spark, sf_dir):
    """Y ~ T + x1 + x2 with p-values and t intervals (U5); checked against numpy in the tests."""
    return R.ols_coefficients(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=("x1", "x2")))


_DIM_SQL = """
SELECT 'ols' AS method, 'ate' AS estimand, count(*) AS n,
  round(avg(CASE WHEN tc = 1 THEN y_planted END) - avg(CASE WHEN tc = 0 THEN y_planted END), 6) AS value,
  round(sqrt(((sum(tc) - 1) * var_samp(CASE WHEN tc = 1 THEN y_planted END)
              + (count(*) - sum(tc) - 1) * var_samp(CASE WHEN tc = 0 THEN y_planted END)) / (count(*) - 2)
             * (1.0 / sum(tc) + 1.0 / (count(*) - sum(tc)))), 6) AS se
FROM oc"""


@register("e2_diff_in_means", with_oc(_DIM_SQL))
def e2_diff_in_means(spark, sf_dir):
    est = R.diff_in_means(orders_causal(spark, sf_dir), SPEC_PLANTED)
    return est.select("method", "estimand", "n", F.round("value", 6).alias("value"), F.round("se", 6).alias("se"))


# ---- E6, E7: difference in differences ----------------------------------------------------------

_CELLS_SQL = """
cells AS (SELECT tc, post, count(*) AS nc, avg(y_did) AS m, var_samp(y_did) AS v FROM oc GROUP BY tc, post),
dd AS (SELECT sum(CASE WHEN tc = 1 AND post = 1 THEN m WHEN tc = 1 THEN -m WHEN post = 1 THEN -m ELSE m END) AS did,
              sum((nc - 1) * v) / (sum(nc) - 4) AS s2, sum(1.0 / nc) AS inv FROM cells)"""


@register("e6_did_ols", with_oc("""
SELECT 'did_interaction' AS term, round(did, 6) AS coef, round(sqrt(s2 * inv), 6) AS se,
       round(did / sqrt(s2 * inv), 3) AS stat FROM dd""", _CELLS_SQL))
def e6_did_ols(spark, sf_dir):
    out = R.did_coefficients(orders_causal(spark, sf_dir), SPEC_DID)
    return _coef_cols(out.where(F.col("term") == R.DID_TERM))


@register("e6_did_ols_adjusted")
def e6_did_ols_adjusted(spark, sf_dir):
    """DiD with a confounder (planted 300); checked against numpy in the tests."""
    return R.did_coefficients(orders_causal(spark, sf_dir), SPEC_DID.with_(confounders=("x2",)))


@register("e7_did_four_cell", with_oc("""
SELECT round(avg(CASE WHEN tc = 1 AND post = 1 THEN y_did END), 6) AS t1_post,
       round(avg(CASE WHEN tc = 1 AND post = 0 THEN y_did END), 6) AS t1_pre,
       round(avg(CASE WHEN tc = 0 AND post = 1 THEN y_did END), 6) AS t0_post,
       round(avg(CASE WHEN tc = 0 AND post = 0 THEN y_did END), 6) AS t0_pre,
       round((avg(CASE WHEN tc = 1 AND post = 1 THEN y_did END) - avg(CASE WHEN tc = 1 AND post = 0 THEN y_did END))
           - (avg(CASE WHEN tc = 0 AND post = 1 THEN y_did END) - avg(CASE WHEN tc = 0 AND post = 0 THEN y_did END)), 6) AS did
FROM oc"""))
def e7_did_four_cell(spark, sf_dir):
    return rnd(R.did_four_cell(orders_causal(spark, sf_dir), SPEC_DID), 6)


# ---- E19: fit summary ---------------------------------------------------------------------------

@register("e19_fit_summary", with_oc("""
SELECT statistic, round(value, 4) AS value FROM (
  SELECT 'n' AS statistic, n AS value FROM s
  UNION ALL SELECT 'r2', r2 FROM s
  UNION ALL SELECT 'adj_r2', 1 - (1 - r2) * (n - 1) / (n - 2) FROM s
  UNION ALL SELECT 'f_stat', r2 / (1 - r2) * (n - 2) FROM s
  UNION ALL SELECT 'log_likelihood', ll FROM s
  UNION ALL SELECT 'aic', -2 * ll + 2 * 2 FROM s
  UNION ALL SELECT 'bic', -2 * ll + 2 * ln(n) FROM s
  UNION ALL SELECT 'df_resid', n - 2 FROM s
  UNION ALL SELECT 'rank', 2.0 FROM s)""",
    "s0 AS (SELECT CAST(count(*) AS DOUBLE) AS n, regr_r2(y_planted, tc) AS r2, var_pop(y_planted) * count(*) AS syy FROM oc)",
    "s AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln(syy * (1 - r2) / n) + 1) AS ll FROM s0)"))
def e19_fit_summary(spark, sf_dir):
    out = R.fit_summary(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=()))
    return rnd(out.where(F.col("statistic") != "f_p_value"), 4)


@register("e19_logit_summary")
def e19_logit_summary(spark, sf_dir):
    return R.logit_summary(orders_causal(spark, sf_dir), SPEC_LOGIT.with_(confounders=("x2",)))


# ---- E3, E4, E5, E8: logistic -------------------------------------------------------------------

def _odds_sql(log_or: str, se: str) -> str:
    rd = "exp({v}) * p0 / (1 - p0 + exp({v}) * p0) - p0"
    lo, hi = f"({log_or} - {Z975} * {se})", f"({log_or} + {Z975} * {se})"
    return f"""
SELECT round(exp({log_or}), 6) AS odds_ratio, round({log_or}, 6) AS log_odds,
       round(exp({lo}), 6) AS ci_lower, round(exp({hi}), 6) AS ci_upper, round(p0, 6) AS baseline_risk,
       round({rd.format(v=log_or)}, 6) AS risk_diff, round({rd.format(v=lo)}, 6) AS rd_lower,
       round({rd.format(v=hi)}, 6) AS rd_upper
FROM k"""


_ODDS_COLS = ["odds_ratio", "log_odds", "ci_lower", "ci_upper", "baseline_risk", "risk_diff", "rd_lower", "rd_upper"]


@register("e3_logit_odds", with_oc(_odds_sql("ln((a11 / b11) / (a01 / b01))", "sqrt(1 / a11 + 1 / b11 + 1 / a01 + 1 / b01)"),
    """k AS (SELECT CAST(sum(tc * yb_planted) AS DOUBLE) AS a11, CAST(sum(tc * (1 - yb_planted)) AS DOUBLE) AS b11,
              CAST(sum((1 - tc) * yb_planted) AS DOUBLE) AS a01, CAST(sum((1 - tc) * (1 - yb_planted)) AS DOUBLE) AS b01,
              avg(CASE WHEN tc = 0 THEN yb_planted END) AS p0 FROM oc)"""))
def e3_logit_odds(spark, sf_dir):
    """E3 + E4 + E5 (T only: the 2 x 2 closed form is the oracle)."""
    return rnd(R.estimate_logit(orders_causal(spark, sf_dir), SPEC_LOGIT).select(*_ODDS_COLS), 6)


@register("e3_logit_adjusted")
def e3_logit_adjusted(spark, sf_dir):
    """Logit with a confounder (planted 0.5, 0.5), Wald p-values; numpy IRLS in the tests."""
    return R.estimate_logit(orders_causal(spark, sf_dir), SPEC_LOGIT.with_(confounders=("x2",)))


@register("e4_baseline_risk", with_oc("SELECT round(avg(CASE WHEN tc = 0 THEN yb_planted END), 6) AS baseline_risk FROM oc"))
def e4_baseline_risk(spark, sf_dir):
    return spark.createDataFrame([(round(R.baseline_risk(orders_causal(spark, sf_dir), SPEC_LOGIT), 6),)],
                                 "baseline_risk double")


@register("e5_odds_to_risk_diff", with_oc("""
SELECT prio, round(CASE WHEN p0 > 0 AND p0 < 1 THEN 1.5 * p0 / (1 - p0 + 1.5 * p0) - p0 END, 6) AS risk_diff
FROM (SELECT prio, avg(yb) AS p0 FROM oc GROUP BY prio)"""))
def e5_odds_to_risk_diff(spark, sf_dir):
    """E5 as a column expression: risk difference implied by an odds ratio of 1.5 at each group's risk."""
    g = orders_causal(spark, sf_dir).groupBy("prio").agg(F.avg("yb").alias("p0"))
    return rnd(g.select("prio", R.odds_to_risk_diff_col(F.lit(1.5), F.col("p0")).alias("risk_diff")), 6)


_DID_LOGIT_K = """k AS (SELECT
  sum(CASE WHEN tc = 1 AND post = 1 THEN yb_planted END)::DOUBLE AS a11, sum(CASE WHEN tc = 1 AND post = 1 THEN 1 - yb_planted END)::DOUBLE AS b11,
  sum(CASE WHEN tc = 1 AND post = 0 THEN yb_planted END)::DOUBLE AS a10, sum(CASE WHEN tc = 1 AND post = 0 THEN 1 - yb_planted END)::DOUBLE AS b10,
  sum(CASE WHEN tc = 0 AND post = 1 THEN yb_planted END)::DOUBLE AS a01, sum(CASE WHEN tc = 0 AND post = 1 THEN 1 - yb_planted END)::DOUBLE AS b01,
  sum(CASE WHEN tc = 0 AND post = 0 THEN yb_planted END)::DOUBLE AS a00, sum(CASE WHEN tc = 0 AND post = 0 THEN 1 - yb_planted END)::DOUBLE AS b00,
  avg(CASE WHEN tc = 0 THEN yb_planted END) AS p0 FROM oc)"""


@register("e8_did_logit", with_oc(_odds_sql(
    "(ln(a11 / b11) - ln(a10 / b10) - ln(a01 / b01) + ln(a00 / b00))",
    "sqrt(1 / a11 + 1 / b11 + 1 / a10 + 1 / b10 + 1 / a01 + 1 / b01 + 1 / a00 + 1 / b00)"), _DID_LOGIT_K))
def e8_did_logit(spark, sf_dir):
    return rnd(R.estimate_did_logit(orders_causal(spark, sf_dir), SPEC_DID_LOGIT).select(*_ODDS_COLS), 6)


# ---- U: bootstrap -------------------------------------------------------------------------------

_W = poisson1_weight_sql(uniform_sql("id", SALT_BOOTSTRAP, "rep"))
_REPS_CTE = (f"bw AS (SELECT oc.*, CAST(r.range AS INTEGER) AS rep, {_W} AS w "
             f"FROM oc CROSS JOIN range({B_ORACLE}) r)")

_BOOT_DIM = """
bd AS (SELECT rep, sum(w * tc * y_planted) / sum(w * tc) - sum(w * (1 - tc) * y_planted) / sum(w * (1 - tc)) AS estimate
       FROM bw GROUP BY rep)"""


@register("u1_bootstrap_diff_in_means", with_oc("SELECT rep, round(estimate, 6) AS estimate FROM bd", _REPS_CTE, _BOOT_DIM))
def u1_bootstrap_diff_in_means(spark, sf_dir):
    return rnd(U.bootstrap_ols(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=()), B_ORACLE), 6)


_BOOT_OLS = """
mu AS (SELECT avg(tc) AS ct, avg(x1) AS cx, avg(y_planted) AS cy FROM oc),
bs AS (SELECT rep, sum(w) AS sw,
         sum(w * (tc - ct)) AS st, sum(w * (x1 - cx)) AS sx, sum(w * (y_planted - cy)) AS sy,
         sum(w * (tc - ct) * (tc - ct)) AS stt, sum(w * (x1 - cx) * (x1 - cx)) AS sxx, sum(w * (tc - ct) * (x1 - cx)) AS stx,
         sum(w * (tc - ct) * (y_planted - cy)) AS sty, sum(w * (x1 - cx) * (y_planted - cy)) AS sxy
       FROM bw, mu GROUP BY rep),
bc AS (SELECT rep, stt - st * st / sw AS ctt, sxx - sx * sx / sw AS cxx, stx - st * sx / sw AS ctx,
              sty - st * sy / sw AS cty, sxy - sx * sy / sw AS cxy FROM bs),
bo AS (SELECT rep, (cty * cxx - ctx * cxy) / (ctt * cxx - ctx * ctx) AS estimate FROM bc)"""


@register("u1_bootstrap_ols", with_oc("SELECT rep, round(estimate, 6) AS estimate FROM bo", _REPS_CTE, _BOOT_OLS))
def u1_bootstrap_ols(spark, sf_dir):
    return rnd(U.bootstrap_ols(orders_causal(spark, sf_dir), SPEC_PLANTED, B_ORACLE), 6)


@register("u1_bootstrap_logit", with_oc("""
SELECT rep, round(ln((a11 / b11) / (a01 / b01)), 6) AS estimate FROM (
  SELECT rep, sum(w * tc * yb_planted)::DOUBLE AS a11, sum(w * tc * (1 - yb_planted))::DOUBLE AS b11,
         sum(w * (1 - tc) * yb_planted)::DOUBLE AS a01, sum(w * (1 - tc) * (1 - yb_planted))::DOUBLE AS b01
  FROM bw GROUP BY rep)""", _REPS_CTE))
def u1_bootstrap_logit(spark, sf_dir):
    return rnd(U.bootstrap_logit(orders_causal(spark, sf_dir), SPEC_LOGIT, B_ORACLE), 6)


@register("u1_bootstrap_did", with_oc("""
SELECT rep, round(
   (sum(w * tc * post * y_did) / sum(w * tc * post) - sum(w * tc * (1 - post) * y_did) / sum(w * tc * (1 - post)))
 - (sum(w * (1 - tc) * post * y_did) / sum(w * (1 - tc) * post)
    - sum(w * (1 - tc) * (1 - post) * y_did) / sum(w * (1 - tc) * (1 - post))), 6) AS estimate
FROM bw GROUP BY rep""", _REPS_CTE))
def u1_bootstrap_did(spark, sf_dir):
    return rnd(U.bootstrap_ols(orders_causal(spark, sf_dir), SPEC_DID, B_ORACLE, did=True), 6)


@register("u2_u4_bootstrap_summary", with_oc("""
SELECT count(estimate) AS n_reps, round(stddev_pop(estimate), 6) AS se,
       round(quantile_cont(estimate, 0.025), 6) AS ci_lower, round(quantile_cont(estimate, 0.975), 6) AS ci_upper
FROM bd""", _REPS_CTE, _BOOT_DIM))
def u2_u4_bootstrap_summary(spark, sf_dir):
    boot = U.bootstrap_ols(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=()), B_ORACLE)
    return rnd(U.bootstrap_summary(boot), 6)


@register("u5_analytic_inference")
def u5_analytic_inference(spark, sf_dir):
    return U.analytic_inference(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=("x1", "x2")))


@register("u6_estimate_record", with_oc("""
SELECT 'ols' AS method, 'ate' AS estimand, (SELECT n FROM r) AS n, round((SELECT bt FROM r), 6) AS value,
       round(stddev_pop(estimate), 6) AS se, round(quantile_cont(estimate, 0.025), 6) AS ci_lower,
       round(quantile_cont(estimate, 0.975), 6) AS ci_upper, 'bootstrap' AS se_source
FROM bo""", _OLS2_CTE, _REPS_CTE, _BOOT_OLS))
def u6_estimate_record(spark, sf_dir):
    return rnd(U.estimate_record(orders_causal(spark, sf_dir), SPEC_PLANTED, "ols", B_ORACLE), 6)


@register("b_one_hot_segment", with_oc("""
SELECT id, CASE WHEN seg = 'AUTOMOBILE' THEN 1 ELSE 0 END AS seg_AUTOMOBILE,
       CASE WHEN seg = 'BUILDING' THEN 1 ELSE 0 END AS seg_BUILDING,
       CASE WHEN seg = 'FURNITURE' THEN 1 ELSE 0 END AS seg_FURNITURE,
       CASE WHEN seg = 'HOUSEHOLD' THEN 1 ELSE 0 END AS seg_HOUSEHOLD FROM oc"""))
def b_one_hot_segment(spark, sf_dir):
    from causeway.operators.coerce import one_hot
    out, names = one_hot(orders_causal(spark, sf_dir).select("id", "seg"), ["seg"])
    return out.select("id", *names)


@register("e1_ols_text_confounder")
def e1_ols_text_confounder(spark, sf_dir):
    """A text confounder (segment) enters the Gram job as 0/1 columns."""
    from causeway.operators.coerce import one_hot
    oc, names = one_hot(orders_causal(spark, sf_dir), ["seg"])
    return R.ols_coefficients(oc, CausalSpec("tc", "y_planted", ("x1", *names), id_col="id"))


_OLS3_CTE = """
m3 AS (SELECT count(*) AS n, avg(tc) AS mt, avg(x1) AS ma, avg(x2) AS mb, avg(y_planted) AS my,
         covar_pop(tc, tc) * count(*) AS tt, covar_pop(tc, x1) * count(*) AS ta, covar_pop(tc, x2) * count(*) AS tb,
         covar_pop(x1, x1) * count(*) AS aa, covar_pop(x1, x2) * count(*) AS ab, covar_pop(x2, x2) * count(*) AS bb,
         covar_pop(tc, y_planted) * count(*) AS ty, covar_pop(x1, y_planted) * count(*) AS ay,
         covar_pop(x2, y_planted) * count(*) AS by_, covar_pop(y_planted, y_planted) * count(*) AS yy FROM oc),
a3 AS (SELECT *, aa * bb - ab * ab AS ctt, tb * ab - ta * bb AS cta, ta * ab - aa * tb AS ctb,
              tt * bb - tb * tb AS caa, ta * tb - tt * ab AS cab, tt * aa - ta * ta AS cbb FROM m3),
d3 AS (SELECT *, tt * ctt + ta * cta + tb * ctb AS det FROM a3),
b3 AS (SELECT *, (ctt * ty + cta * ay + ctb * by_) / det AS bt, (cta * ty + caa * ay + cab * by_) / det AS ba,
              (ctb * ty + cab * ay + cbb * by_) / det AS bbx FROM d3),
r3 AS (SELECT *, (yy - bt * ty - ba * ay - bbx * by_) / (n - 4) AS s2,
              (mt * (ctt * mt + cta * ma + ctb * mb) + ma * (cta * mt + caa * ma + cab * mb)
               + mb * (ctb * mt + cab * ma + cbb * mb)) / det AS q FROM b3)"""


@register("e1_ols_two_confounders", with_oc("""
SELECT 'const' AS term, round(my - bt * mt - ba * ma - bbx * mb, 6) AS coef, round(sqrt(s2 / n + s2 * q), 6) AS se,
       round((my - bt * mt - ba * ma - bbx * mb) / sqrt(s2 / n + s2 * q), 3) AS stat FROM r3
UNION ALL SELECT 'tc', round(bt, 6), round(sqrt(s2 * ctt / det), 6), round(bt / sqrt(s2 * ctt / det), 3) FROM r3
UNION ALL SELECT 'x1', round(ba, 6), round(sqrt(s2 * caa / det), 6), round(ba / sqrt(s2 * caa / det), 3) FROM r3
UNION ALL SELECT 'x2', round(bbx, 6), round(sqrt(s2 * cbb / det), 6), round(bbx / sqrt(s2 * cbb / det), 3) FROM r3""",
                                               _OLS3_CTE))
def e1_ols_two_confounders(spark, sf_dir):
    """The flagship model Y ~ 1 + T + x1 + x2; DuckDB solves the 3 x 3 system by its adjugate."""
    return _coef_cols(R.ols_coefficients(orders_causal(spark, sf_dir), SPEC_PLANTED.with_(confounders=("x1", "x2"))))
