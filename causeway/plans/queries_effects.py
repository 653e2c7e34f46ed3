"""Catalog entries for heterogeneity (G), propensity / matching / weighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_BOOTSTRAP, poisson1_weight_sql, uniform_sql
from causeway.operators import cell_bootstrap as CB
from causeway.operators import hte as G
from causeway.operators import matching as M
from causeway.operators import propensity as P
from causeway.plans.catalog import register, rnd
from causeway.plans.frames import orders_causal, orders_holes, with_holes, with_oc
from causeway.spec import CausalSpec

SPEC_HTE = CausalSpec("tc", "y_hte", ("x1", "x2"), id_col="id")
SPEC_HTE_X2 = CausalSpec("tc", "y_hte", ("x2",), id_col="id")
SPEC_DID_X2 = CausalSpec("tc", "y_did", ("x2",), time_period="post", id_col="id")
SPEC_PS = CausalSpec("tc", "y_planted", ("x1", "x2"), id_col="id")
CELLS = ["seg", "x1_band"]


def _terms_df(spark, rows):
    data = [(r["feature"], r.get("coef"), r.get("se"), r.get("stat")) for r in rows if r.get("coef") is not None]
    df = spark.createDataFrame(data, "feature string, coef double, se double, stat double")
    return df.select("feature", F.round("coef", 6).alias("coef"), F.round("se", 6).alias("se"),
                     F.round("stat", 3).alias("stat"))


_SAT_SQL = """
SELECT 'x2' AS feature, round(coef, 6) AS coef, round(sqrt(s2 * inv), 6) AS se, round(coef / sqrt(s2 * inv), 3) AS stat
FROM (SELECT sum({sign} * m) AS coef, sum((nc - 1) * v) / (sum(nc) - {k}) AS s2, sum(1.0 / nc) AS inv
      FROM (SELECT {keys}, count(*) AS nc, avg({y}) AS m, var_samp({y}) AS v FROM oc GROUP BY {keys}))"""


@register("g1_hte_interaction", with_oc(_SAT_SQL.format(
    sign="(2 * tc - 1) * (2 * x2 - 1)", k=4, keys="tc, x2", y="y_hte")))
def g1_hte_interaction(spark, sf_dir):
    """G1 with one binary feature and no other confounders: the saturated 2 x 2 model is the oracle."""
    return _terms_df(spark, G.interaction_terms(orders_causal(spark, sf_dir), SPEC_HTE_X2, ["x2"]))


@register("g2_hte_did_triple", with_oc(_SAT_SQL.format(
    sign="(2 * tc - 1) * (2 * post - 1) * (2 * x2 - 1)", k=8, keys="tc, post, x2", y="y_did")))
def g2_hte_did_triple(spark, sf_dir):
    return _terms_df(spark, G.interaction_terms(orders_causal(spark, sf_dir), SPEC_DID_X2, ["x2"], did=True))


@register("g1_g5_g7_hte_table")
def g1_g5_g7_hte_table(spark, sf_dir):
    """Every candidate feature (G4), ranked by p-value (G5), text features skipped."""
    oc = orders_causal(spark, sf_dir).select("id", "tc", "y_hte", "x1", "x2", "seg", "post")
    return G.hte_interactions(oc, SPEC_HTE)


@register("g2_hte_did_table")
def g2_hte_did_table(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "tc", "y_did", "x1", "x2", "seg", "post")
    return G.hte_interactions(oc, CausalSpec("tc", "y_did", ("x1", "x2"), time_period="post", id_col="id"), did=True)


@register("g6_strongest_modifier")
def g6_strongest_modifier(spark, sf_dir):
    oc = orders_causal(spark, sf_dir).select("id", "tc", "y_hte", "x1", "x2", "seg", "post")
    return G.strongest_modifier(G.hte_interactions(oc, SPEC_HTE))


# ---- E9-E11 -------------------------------------------------------------------------------------

_PS_SQL = "ps AS (SELECT *, avg(tc) OVER (PARTITION BY seg, x1_band) AS ps FROM oc)"


@register("e9_propensity_stratified", with_oc("SELECT id, round(ps, 6) AS ps FROM ps", _PS_SQL))
def e9_propensity_stratified(spark, sf_dir):
    scored = P.propensity_scores(orders_causal(spark, sf_dir), SPEC_PS, "stratified", CELLS)
    return scored.select("id", F.round("ps", 6).alias("ps"))


@register("e9_propensity_logistic")
def e9_propensity_logistic(spark, sf_dir):
    scored = P.propensity_scores(orders_causal(spark, sf_dir), SPEC_PS, "logistic")
    return scored.select("id", "ps")


_PSM_SQL = """
g AS (SELECT ps, tc, count(*) AS n, sum(y_planted) AS sy FROM ps GROUP BY ps, tc),
tr AS (SELECT * FROM g WHERE tc = 1), co AS (SELECT * FROM g WHERE tc = 0),
d1 AS (SELECT tr.ps, min(abs(tr.ps - co.ps)) AS d FROM tr, co GROUP BY tr.ps),
m1 AS (SELECT tr.ps, tr.n, tr.sy, sum(co.sy) / sum(co.n) AS ym FROM tr JOIN d1 ON tr.ps = d1.ps
       JOIN co ON abs(tr.ps - co.ps) = d1.d GROUP BY tr.ps, tr.n, tr.sy),
d0 AS (SELECT co.ps, min(abs(co.ps - tr.ps)) AS d FROM co, tr GROUP BY co.ps),
m0 AS (SELECT co.ps, co.n, co.sy, sum(tr.sy) / sum(tr.n) AS ym FROM co JOIN d0 ON co.ps = d0.ps
       JOIN tr ON abs(co.ps - tr.ps) = d0.d GROUP BY co.ps, co.n, co.sy),
att AS (SELECT sum(sy - n * ym) / sum(n) AS att, sum(n) AS n1 FROM m1),
atc AS (SELECT -sum(sy - n * ym) / sum(n) AS atc, sum(n) AS n0 FROM m0)"""


@register("e10_psm_stratified", with_oc(
    "SELECT round(att, 6) AS att, round(atc, 6) AS atc, round((n1 * att + n0 * atc) / (n1 + n0), 6) AS ate "
    "FROM att, atc", _PS_SQL, _PSM_SQL))
def e10_psm_stratified(spark, sf_dir):
    r = M.psm_effects(orders_causal(spark, sf_dir), SPEC_PS, "stratified", CELLS)
    return rnd(spark.createDataFrame([(r["att"], r["atc"], r["ate"])], "att double, atc double, ate double"), 6)


@register("e10_psm_missing", with_holes(
    "SELECT round(att, 6) AS att, round(atc, 6) AS atc, round((n1 * att + n0 * atc) / (n1 + n0), 6) AS ate "
    "FROM att, atc", _PS_SQL, _PSM_SQL))
def e10_psm_missing(spark, sf_dir):
    r = M.psm_effects(orders_holes(spark, sf_dir), SPEC_PS, "stratified", CELLS, missing="drop")
    return rnd(spark.createDataFrame([(r["att"], r["atc"], r["ate"])], "att double, atc double, ate double"), 6)


@register("e10_psm_logistic")
def e10_psm_logistic(spark, sf_dir):
    return M.estimate_psm(orders_causal(spark, sf_dir), SPEC_PS, "logistic")


_IPTW_SQL = """
SELECT round((sum(tc * y_planted / ps) - sum((1 - tc) * y_planted / (1 - ps))) / count(*), 6) AS ate_ht,
       round(sum(tc * y_planted / ps) / sum(tc / ps) - sum((1 - tc) * y_planted / (1 - ps)) / sum((1 - tc) / (1 - ps)), 6)
         AS ate_hajek
FROM ps"""


@register("e11_iptw_stratified", with_oc(_IPTW_SQL, _PS_SQL))
def e11_iptw_stratified(spark, sf_dir):
    scored = P.propensity_scores(orders_causal(spark, sf_dir), SPEC_PS, "stratified", CELLS)
    s = P.iptw_sums(scored, SPEC_PS)
    return rnd(spark.createDataFrame([(P.iptw_value(s, "ht"), P.iptw_value(s, "hajek"))],
                                     "ate_ht double, ate_hajek double"), 6)


@register("e11_iptw_missing", with_holes(_IPTW_SQL, _PS_SQL.replace("seg, x1_band", "seg")))
def e11_iptw_missing(spark, sf_dir):
    d = orders_holes(spark, sf_dir)
    both = [P.iptw_effect(d, SPEC_PS, "stratified", ["seg"], w, missing="drop") for w in ("ht", "hajek")]
    return rnd(spark.createDataFrame([tuple(both)], "ate_ht double, ate_hajek double"), 6)


@register("e11_iptw_logistic")
def e11_iptw_logistic(spark, sf_dir):
    return P.estimate_iptw(orders_causal(spark, sf_dir), SPEC_PS, "logistic", weighting="hajek")


# ---- U1 for E10-E13 on confounder cells -----------------------------------------------------------

B_CELLS = 50
_CELL_REPS_SQL = f"""
bw AS (SELECT oc.*, CAST(r.range AS INTEGER) AS rep, {poisson1_weight_sql(uniform_sql('id', SALT_BOOTSTRAP, 'rep'))} AS w
       FROM oc CROSS JOIN range({B_CELLS}) r),
cw AS (SELECT rep, seg, x1_band, sum(w * (1 - tc))::DOUBLE AS n0, sum(w * (1 - tc) * y_planted) AS y0, sum(w * tc)::DOUBLE AS n1,
              sum(w * tc * y_planted) AS y1 FROM bw GROUP BY rep, seg, x1_band HAVING sum(w) > 0),
ce AS (SELECT *, n1 / (n0 + n1) AS e FROM cw)"""


@register("u1_bootstrap_iptw", with_oc("""
SELECT CAST(r.range AS INTEGER) AS rep, round(ht, 6) AS ate_ht, round(hajek, 6) AS ate_hajek FROM range(50) r LEFT JOIN (
  SELECT rep, (sum(y1 / e) - sum(y0 / (1 - e))) / sum(n0 + n1) AS ht,
         sum(y1 / e) / sum(n1 / e) - sum(y0 / (1 - e)) / sum(n0 / (1 - e)) AS hajek
  FROM ce GROUP BY rep HAVING bool_and(n0 > 0 AND n1 > 0)) x ON x.rep = r.range""", _CELL_REPS_SQL))
def u1_bootstrap_iptw(spark, sf_dir):
    oc = orders_causal(spark, sf_dir)
    ht, hajek = (CB.bootstrap_iptw(oc, SPEC_PS, CELLS, B_CELLS, w).withColumnRenamed("estimate", f"ate_{w}") for w in ("ht", "hajek"))
    return rnd(ht.join(hajek, "rep"), 6)


_PSM_REPS_SQL = """
sc AS (SELECT rep, e, sum(n0) AS n0, sum(y0) AS y0, sum(n1) AS n1, sum(y1) AS y1 FROM ce GROUP BY rep, e),
p1 AS (SELECT a.rep, a.e, min(abs(a.e - b.e)) AS d FROM sc a JOIN sc b ON a.rep = b.rep AND a.n1 > 0 AND b.n0 > 0 GROUP BY a.rep, a.e),
p0 AS (SELECT a.rep, a.e, min(abs(a.e - b.e)) AS d FROM sc a JOIN sc b ON a.rep = b.rep AND a.n0 > 0 AND b.n1 > 0 GROUP BY a.rep, a.e),
q1 AS (SELECT a.rep, a.e, any_value(a.n1) AS n, any_value(a.y1) AS y, sum(b.y0) / sum(b.n0) AS m FROM sc a JOIN p1 USING (rep, e)
       JOIN sc b ON a.rep = b.rep AND b.n0 > 0 AND abs(a.e - b.e) = p1.d GROUP BY a.rep, a.e),
q0 AS (SELECT a.rep, a.e, any_value(a.n0) AS n, any_value(a.y0) AS y, sum(b.y1) / sum(b.n1) AS m FROM sc a JOIN p0 USING (rep, e)
       JOIN sc b ON a.rep = b.rep AND b.n1 > 0 AND abs(a.e - b.e) = p0.d GROUP BY a.rep, a.e),
s1 AS (SELECT rep, sum(y - n * m) AS num, sum(n) AS cnt FROM q1 GROUP BY rep),
s0 AS (SELECT rep, sum(y - n * m) AS num, sum(n) AS cnt FROM q0 GROUP BY rep)"""


@register("u1_bootstrap_psm", with_oc("""
SELECT CAST(r.range AS INTEGER) AS rep, round((s1.num - s0.num) / (s1.cnt + s0.cnt), 6) AS estimate
FROM range(50) r LEFT JOIN s1 ON s1.rep = r.range LEFT JOIN s0 ON s0.rep = r.range""", _CELL_REPS_SQL, _PSM_REPS_SQL))
def u1_bootstrap_psm(spark, sf_dir):
    return rnd(CB.bootstrap_psm(orders_causal(spark, sf_dir), SPEC_PS, CELLS, B_CELLS), 6)


@register("u1_bootstrap_cell_mean", with_oc("""
SELECT rep, round(sum((n0 + n1) * (CASE WHEN n1 > 0 THEN y1 / n1 ELSE g1 END - CASE WHEN n0 > 0 THEN y0 / n0 ELSE g0 END))
                  / sum(n0 + n1), 6) AS estimate
FROM cw JOIN (SELECT rep, sum(y1) / sum(n1) AS g1, sum(y0) / sum(n0) AS g0 FROM cw GROUP BY rep) USING (rep) GROUP BY rep""", _CELL_REPS_SQL))
def u1_bootstrap_cell_mean(spark, sf_dir):
    return rnd(CB.bootstrap_cell_mean(orders_causal(spark, sf_dir), SPEC_PS, CELLS, B_CELLS), 6)
