"""Regression estimators of the treatment effect.

Linear models run as one Gram job (``moments``); logistic models run as Spark ML's distributed
IRLS (``GeneralizedLinearRegression``), each iteration one aggregate over the table.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import spec as S
from causeway.functions import stats
from causeway.operators.moments import Moments, OLSFit, moments, solve_ols
from causeway.session import cached, spread
from causeway.spec import CausalSpec

Z975 = stats.norm_ppf(0.975)
DID_TERM = "did_interaction"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def model_columns(spec: CausalSpec, did: bool = False) -> dict[str, Column]:
    cols = {spec.treatment: _q(spec.treatment)}
    if did:
        if not spec.time_period:
            raise ValueError("difference-in-differences needs a time period column")
        cols[spec.time_period] = _q(spec.time_period)
        cols[DID_TERM] = _q(spec.treatment) * _q(spec.time_period)
    for c in spec.confounders:
        cols[c] = _q(c)
    cols[spec.outcome] = _q(spec.outcome)
    return cols


def ols_moments(df: DataFrame, cols: dict[str, Column], allow_missing: bool = False) -> Moments:
    m = moments(df, cols)
    if not allow_missing and m.n_total != m.n:
        raise ValueError(f"{int(m.n_total - m.n)} rows have a missing value in a model column; impute or drop them")
    if m.n == 0:
        raise ValueError("no rows")
    return m


def ols_fit(df: DataFrame, spec: CausalSpec, did: bool = False) -> OLSFit:
    cols = model_columns(spec, did)
    m = ols_moments(df, cols)
    xs = [c for c in cols if c != spec.outcome]
    fit = solve_ols(m, spec.outcome, xs)
    effect = DID_TERM if did else spec.treatment
    if not fit.identified.get(effect, False):
        raise ValueError(f"the effect term {effect!r} is not identified (constant or collinear)")
    return fit


def coefficients_df(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, S.COEFFICIENTS)


def estimate_df(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, S.ESTIMATE)


def _estimate_from_fit(method: str, estimand: str, fit: OLSFit, term: str) -> tuple:
    row = fit.table()[fit.index(term)]
    return (method, estimand, int(fit.n), row[1], row[2], row[5], row[6], "analytic")


# ---- E1 / E2 -----------------------------------------------------------------------------------

def ols_coefficients(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """E1 + U5: full coefficient table of Y ~ 1 + T + X."""
    spec.validate(df)
    return coefficients_df(df.sparkSession, ols_fit(df, spec).table())


def estimate_ols(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """The coefficient of T in Y ~ 1 + T + X, analytic se and t interval."""
    spec.validate(df)
    fit = ols_fit(df, spec)
    return estimate_df(df.sparkSession, [_estimate_from_fit("ols", "ate", fit, spec.treatment)])


def diff_in_means(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """Unadjusted contrast (OLS of Y on T alone)."""
    return estimate_ols(df, spec.with_(confounders=()))


# ---- E6 / E7 -----------------------------------------------------------------------------------

def did_coefficients(df: DataFrame, spec: CausalSpec) -> DataFrame:
    spec.validate(df)
    return coefficients_df(df.sparkSession, ols_fit(df, spec, did=True).table())


def estimate_did(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """Y ~ 1 + T + Post + T*Post + X; the effect is the interaction."""
    spec.validate(df)
    fit = ols_fit(df, spec, did=True)
    return estimate_df(df.sparkSession, [_estimate_from_fit("did", "att_did", fit, DID_TERM)])


def did_four_cell(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """(treated post - treated pre) - (control post - control pre), one aggregate."""
    t, p, y = _q(spec.treatment), _q(spec.time_period), _q(spec.outcome)

    def cell(tv, pv):
        return F.avg(F.when((t == tv) & (p == pv), y))

    out = df.agg(cell(1, 1).alias("t1_post"), cell(1, 0).alias("t1_pre"),
                 cell(0, 1).alias("t0_post"), cell(0, 0).alias("t0_pre"))
    return out.withColumn("did", (F.col("t1_post") - F.col("t1_pre")) - (F.col("t0_post") - F.col("t0_pre")))


# ---- E19 ---------------------------------------------------------------------------------------

def fit_summary(df: DataFrame, spec: CausalSpec, did: bool = False) -> DataFrame:
    """N, R2, adjusted R2, F, log-likelihood, AIC, BIC of the linear model."""
    fit = ols_fit(df, spec, did)
    return df.sparkSession.createDataFrame(fit.summary(), S.FIT_SUMMARY)


# ---- E3 / E4 / E5 / E8: logistic models ---------------------------------------------------------

class LogitFit:
    def __init__(self, terms, coef, se, n, deviance, null_deviance, aic, iterations):
        self.terms, self.coef, self.se = terms, np.asarray(coef), np.asarray(se)
        self.n, self.deviance, self.null_deviance, self.aic, self.iterations = n, deviance, null_deviance, aic, iterations

    def index(self, term):
        return self.terms.index(term)

    def table(self) -> list[tuple]:
        rows = []
        for k, term in enumerate(self.terms):
            b, s = float(self.coef[k]), float(self.se[k])
            z = b / s if s > 0 else float("nan")
            rows.append((term, b, s, z, stats.norm_two_sided_p(z), b - Z975 * s, b + Z975 * s))
        return rows


def check_binary(df: DataFrame, col: str) -> None:
    """B7 + logit precondition: values are exactly {0, 1} (no distinct shuffle)."""
    r = df.agg(F.min(_q(col)).alias("lo"), F.max(_q(col)).alias("hi"),
               F.sum((~_q(col).isin(0, 1)).cast("int")).alias("bad")).collect()[0]
    if r["lo"] is None or r["bad"] or r["lo"] == r["hi"]:
        raise ValueError(f"column {col!r} must take exactly the values 0 and 1")


def logit_fit(df: DataFrame, y: str, cols: dict[str, Column], max_iter: int = 100, tol: float = 1e-10,
              fit_stats: bool = False) -> LogitFit:
    """Unregularised logistic regression by Spark ML IRLS; Wald (normal) inference.

    ``fit_stats``: also deviance, null deviance and AIC (the null deviance is a second, intercept-only
    fit, so only the E19 summary asks for it)."""
    names = list(cols)
    proj = df.select(*[e.cast("double").alias(f"f{i}") for i, e in enumerate(cols.values())],
                     _q(y).cast("double").alias("label"))
    va = VectorAssembler(inputCols=[f"f{i}" for i in range(len(names))], outputCol="features", handleInvalid="error")
    glr = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=max_iter, tol=tol,
                                      regParam=0.0, fitIntercept=True, labelCol="label", featuresCol="features")
    # IRLS reads the input once per iteration: keep the small assembled projection (lost blocks recompute)
    train = cached(spread(va.transform(proj)))
    try:
        model = glr.fit(train)
        sm = model.summary
        se = list(sm.coefficientStandardErrors)
        n_inst, iters = int(sm.numInstances), int(sm.numIterations)
        dev = null_dev = aic = float("nan")
        if fit_stats:
            dev, null_dev, aic = float(sm.deviance), float(sm.nullDeviance), float(sm.aic)
    finally:
        train.unpersist()
    coef = [float(model.intercept)] + [float(v) for v in model.coefficients]
    se = [se[-1]] + se[:-1]
    return LogitFit(["const", *names], coef, se, n_inst, dev, null_dev, aic, iters)


def baseline_risk(df: DataFrame, spec: CausalSpec) -> float:
    """Mean outcome of the controls."""
    return df.agg(F.avg(F.when(_q(spec.treatment) == 0, _q(spec.outcome))).alias("p0")).collect()[0]["p0"]


def odds_to_risk_diff(odds_ratio: float, p0: float) -> float | None:
    """E5: OR * p0 / (1 - p0 + OR * p0) - p0; only defined for 0 < p0 < 1."""
    if p0 is None or not (0.0 < p0 < 1.0) or odds_ratio is None or math.isnan(odds_ratio):
        return None
    return odds_ratio * p0 / (1.0 - p0 + odds_ratio * p0) - p0


def odds_to_risk_diff_col(odds_ratio: Column, p0: Column) -> Column:
    """E5 as a column expression (NULL outside 0 < p0 < 1)."""
    return F.when((p0 > 0) & (p0 < 1), odds_ratio * p0 / (F.lit(1.0) - p0 + odds_ratio * p0) - p0)


def _odds_row(fit: LogitFit, term: str, p0: float) -> tuple:
    k = fit.index(term)
    b, s = float(fit.coef[k]), float(fit.se[k])
    lo, hi = b - Z975 * s, b + Z975 * s
    orr = math.exp(b)
    return (orr, b, stats.norm_two_sided_p(b / s) if s > 0 else float("nan"), math.exp(lo), math.exp(hi), p0,
            odds_to_risk_diff(orr, p0), odds_to_risk_diff(math.exp(lo), p0), odds_to_risk_diff(math.exp(hi), p0))


def logit_coefficients(df: DataFrame, spec: CausalSpec, did: bool = False) -> DataFrame:
    check_binary(df, spec.outcome)
    cols = model_columns(spec, did)
    cols.pop(spec.outcome)
    return coefficients_df(df.sparkSession, logit_fit(df, spec.outcome, cols).table())


def estimate_logit(df: DataFrame, spec: CausalSpec, did: bool = False) -> DataFrame:
    """E3 (E8 with ``did=True``): log-odds of T (of T*Post), odds ratio, and the implied risk
    difference at the overall control mean (E4, E5)."""
    spec.validate(df)
    check_binary(df, spec.outcome)
    cols = model_columns(spec, did)
    cols.pop(spec.outcome)
    fit = logit_fit(df, spec.outcome, cols)
    p0 = baseline_risk(df, spec)
    return df.sparkSession.createDataFrame([_odds_row(fit, DID_TERM if did else spec.treatment, p0)], S.ODDS)


def estimate_did_logit(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """E8."""
    return estimate_logit(df, spec, did=True)


def logit_estimate_row(df: DataFrame, spec: CausalSpec, did: bool = False) -> DataFrame:
    """The ``estimate`` contract for a logit: value = log-odds of the effect term."""
    check_binary(df, spec.outcome)
    cols = model_columns(spec, did)
    cols.pop(spec.outcome)
    fit = logit_fit(df, spec.outcome, cols)
    row = fit.table()[fit.index(DID_TERM if did else spec.treatment)]
    return estimate_df(df.sparkSession, [("did_logit" if did else "logit", "log_odds", fit.n, row[1], row[2],
                                          row[5], row[6], "analytic")])


def logit_summary(df: DataFrame, spec: CausalSpec, did: bool = False) -> DataFrame:
    """E19 for logit: n, deviance, null deviance, pseudo R2 (McFadden), log-likelihood, AIC, BIC."""
    check_binary(df, spec.outcome)
    cols = model_columns(spec, did)
    cols.pop(spec.outcome)
    fit = logit_fit(df, spec.outcome, cols, fit_stats=True)
    ll = -fit.deviance / 2.0
    k = len(fit.terms)
    rows = [("n", float(fit.n)), ("deviance", fit.deviance), ("null_deviance", fit.null_deviance),
            ("pseudo_r2", 1.0 - fit.deviance / fit.null_deviance if fit.null_deviance else float("nan")),
            ("log_likelihood", ll), ("aic", fit.aic), ("bic", -2 * ll + k * math.log(fit.n)),
            ("iterations", float(fit.iterations))]
    return df.sparkSession.createDataFrame(rows, S.FIT_SUMMARY)
