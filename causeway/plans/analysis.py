"""The whole analysis of one table: prepare -> estimate -> uncertainty -> heterogeneity -> refute -> export.

``analyze`` is the batch form of the reference's "Run Causal Analysis": every stage is one of the
operators, each result is a small DataFrame, and the table that carries the per-row effect is a
lazy DataFrame written by the executors (A2), never collected.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators import cell_bootstrap as CB
from causeway.operators import hte as G
from causeway.operators import inference as U
from causeway.operators import learners as L
from causeway.operators import matching as M
from causeway.operators import propensity as P
from causeway.operators import refute as RF
from causeway.operators import regression as R
from causeway.operators.prep import apply_steps
from causeway.session import cached
from causeway.sources.io import write_csv
from causeway.spec import CausalSpec, Method


@dataclass
class Analysis:
    estimate: DataFrame
    table: DataFrame
    coefficients: DataFrame | None = None
    odds: DataFrame | None = None
    fit_summary: DataFrame | None = None
    bootstrap: DataFrame | None = None
    hte: DataFrame | None = None
    refutation: DataFrame | None = None
    ite_histogram: DataFrame | None = None
    importance: DataFrame | None = None
    extras: dict = field(default_factory=dict)

    def release(self) -> None:
        d = self.extras.get("persisted")
        if d is not None:
            d.unpersist()


def _point_estimator(method: Method, spec: CausalSpec, learner, provider, cells, weighting, rng, forest=None):
    """``(df, spec) -> ATE`` refit of the method, for refutations that change the data."""
    lrn = learner or L.Forest()

    def est(d: DataFrame, sp: CausalSpec) -> float:
        if method is Method.PSM:
            return M.psm_effects(d, sp, provider, cells)["ate"]
        if method is Method.IPTW:
            return P.iptw_effect(d, sp, provider, cells, weighting)
        if method is Method.LINEAR_DML:
            return L.dml_final_stage(L.dml_residuals(d, sp, lrn, 3, rng), sp)["ate"]
        if method is Method.CAUSAL_FOREST:
            return L.causal_forest(d, sp, lrn, forest or L.Forest(), rng=rng)[0].collect()[0]["value"]
        fn = L.s_learner if method is Method.S_LEARNER else L.t_learner
        return L.ate_from_ite(fn(d, sp, lrn))

    return est


def analyze(df: DataFrame, spec: CausalSpec, method: str | Method = "ols", *, steps: list = (),
            bootstrap: int | None = 50, heterogeneity: bool = True, refutation: bool = True,
            n_sims: int | None = None,
            learner=None, provider: str = "logistic", cells: list[str] | None = None, weighting: str = "hajek",
            export_path: str | None = None, rng: str = "md5", persist: bool = True,
            refit_nuisances: bool = True, forest: L.Forest | None = None) -> Analysis:
    """``method="auto"``: the logit for a 0/1 outcome, least squares otherwise, as differences in differences if the spec
    names a time period. ``refit_nuisances=False`` bootstraps only the final stage of LinearDML.
    ``persist``: keep the prepared table (MEMORY_AND_DISK) while the ~10 jobs of the analysis read
    it; lost blocks are recomputed from the source, and it is released by ``Analysis.release()``."""
    spark = df.sparkSession
    d = apply_steps(df, list(steps)) if steps else df
    spec.validate(d)
    if method == "auto":
        method = ("did" if spec.time_period else "") + ("logit" if L._is_binary_outcome(d, spec.outcome) else "ols")
        method = {"didols": "did", "didlogit": "did_logit"}.get(method, method)
    method = Method(method)
    if persist:
        d = cached(d)
    out: dict = {"table": d}
    if method in (Method.OLS, Method.DID):
        did = method is Method.DID
        out["estimate"], out["bootstrap"] = U.estimate_record(d, spec, method.value, bootstrap, rng, return_boot=True)
        out["coefficients"] = R.did_coefficients(d, spec) if did else R.ols_coefficients(d, spec)
        out["fit_summary"] = R.fit_summary(d, spec, did)
    elif method in (Method.LOGIT, Method.DID_LOGIT):
        did = method is Method.DID_LOGIT
        out["estimate"], out["bootstrap"] = U.estimate_record(d, spec, method.value, bootstrap, rng, return_boot=True)
        out["odds"] = R.estimate_logit(d, spec, did)
        out["coefficients"] = R.logit_coefficients(d, spec, did)
        out["fit_summary"] = R.logit_summary(d, spec, did)
    elif method in (Method.PSM, Method.IPTW):
        if method is Method.PSM:
            def est(x, w=None):
                return M.psm_effects(x, spec, provider, cells, weight_col=w)["ate"]
        else:
            def est(x, w=None):
                return P.iptw_effect(x, spec, provider, cells, weighting, weight_col=w)
        value = est(d)
        se = lo = hi = None
        src = "none"
        if bootstrap:
            if provider == "stratified":
                keys = cells or list(spec.confounders)
                boot = (CB.bootstrap_psm(d, spec, keys, bootstrap, rng=rng) if method is Method.PSM
                        else CB.bootstrap_iptw(d, spec, keys, bootstrap, weighting, rng=rng))
            else:
                boot = U.generic_bootstrap(d, spec, lambda x, w: est(x, w), bootstrap, rng)
            out["bootstrap"] = boot
            _, se, lo, hi = U.summarize(boot)
            src = "bootstrap"
        out["estimate"] = R.estimate_df(spark, [(method.value, "ate", d.count(), value, se, lo, hi, src)])
    else:
        lrn = learner or L.Forest()
        refit = _point_estimator(method, spec, learner, provider, cells, weighting, rng, forest)
        if method is Method.LINEAR_DML:
            res = L.dml_residuals(d, spec, lrn, 3, rng)
            from causeway.session import materialize
            res = materialize(res)
            fs = L.dml_final_stage(res, spec)
            ite = res.withColumn(L.ITE, L.cate_column(fs["terms"], fs["theta"])).drop("_fold", "_y_res", "_t_res")
            se, src = fs["se"], "analytic"
            lo, hi = U.normal_interval(fs["ate"], fs["se"])
            if bootstrap:
                boot = (U.generic_bootstrap(d, spec, lambda x, w: refit(L.resampled(x, w), spec), bootstrap, rng)
                        if refit_nuisances else L.bootstrap_dml_final(res, spec, bootstrap, rng=rng))
                out["bootstrap"] = boot
                _, se, lo, hi = U.summarize(boot)
                src = "bootstrap"
            out["estimate"] = R.estimate_df(spark, [("linear_dml", "ate", fs["n"], fs["ate"], se, lo, hi, src)])
        elif method is Method.CAUSAL_FOREST:
            est_df, ite, model, feats = L.causal_forest(d, spec, lrn, forest or L.Forest(),
                                                        rng=rng)
            if bootstrap:
                boot = U.generic_bootstrap(d, spec, lambda x, w: refit(L.resampled(x, w), spec), bootstrap, rng)
                out["bootstrap"] = boot
                _, se, lo, hi = U.summarize(boot)
                one = est_df.first()
                est_df = R.estimate_df(spark, [("causal_forest", "ate", one["n"], one["value"], se, lo, hi, "bootstrap")])
            out["estimate"] = est_df
            out["importance"] = L.feature_importance(model, feats, spark)
        else:
            fn = L.s_learner if method is Method.S_LEARNER else L.t_learner
            ite = fn(d, spec, lrn)
            a = ite.agg(F.avg(L.ITE).alias("a"), F.count(F.lit(1)).alias("n")).collect()[0]
            se = lo = hi = None
            src = "none"
            if bootstrap:
                boot = (CB.bootstrap_cell_mean(d, spec, list(lrn.cells), bootstrap, rng) if isinstance(lrn, L.CellMean)
                        else U.generic_bootstrap(d, spec, lambda x, w: L.ate_from_ite(fn(x, spec, lrn, w), w), bootstrap, rng))
                out["bootstrap"] = boot
                _, se, lo, hi = U.summarize(boot)
                src = "bootstrap"
            out["estimate"] = R.estimate_df(spark, [(method.value, "ate", a["n"], a["a"], se, lo, hi, src)])
        out["table"] = ite
        out["ite_histogram"] = L.ite_histogram(ite, 30)
    if heterogeneity:
        if method.is_cate:
            out["hte"] = G.ite_slopes(out["table"], L.ITE, G.candidate_features(d, spec))
        else:
            out["hte"] = G.hte_interactions(d, spec, did=method in (Method.DID, Method.DID_LOGIT))
    if refutation and method is Method.OLS:
        out["refutation"] = RF.refute(d, spec, "ols", n_sims, rng=rng)
    elif refutation and method not in (Method.DID, Method.DID_LOGIT, Method.LOGIT):
        out["refutation"] = RF.refute(d, spec, method.value, n_sims, estimator=_point_estimator(method, spec, learner,
                                                                                               provider, cells, weighting, rng, forest),
                                      rng=rng)
    result = Analysis(**out)
    result.extras["persisted"] = d if persist else None
    if export_path:
        write_csv(result.table, export_path)
    return result
