"""Propensity scores and inverse-propensity weighting.

``logistic``: unregularised logistic regression fitted by Spark ML's distributed IRLS
(``GeneralizedLinearRegression``, binomial family, logit link); its prediction is P(T=1 | X). ``stratified``: the treated share per confounder cell, a grouped aggregate
joined back (AQE broadcasts the cell table only when its measured size allows; a skewed cell is
split by the skew-join rule). IPTW is one aggregate of weighted sums.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.complete import absent, join_cells, usable_rows
from causeway.operators.regression import estimate_df
from causeway.session import cached, spread
from causeway.spec import CausalSpec


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def propensity_scores(df: DataFrame, spec: CausalSpec, provider: str = "logistic", cells: list[str] | None = None,
                      clip: tuple[float, float] | None = None, out: str = "ps", weight_col: str | None = None) -> DataFrame:
    """Adds ``out`` = estimated P(T = 1 | X)."""
    t = _q(spec.treatment)
    if provider == "stratified":
        keys = cells or list(spec.confounders)
        if weight_col:
            share = df.groupBy(*[_q(k) for k in keys]).agg(
                (F.sum(_q(weight_col) * t) / F.sum(_q(weight_col))).alias(out))
        else:
            share = df.groupBy(*[_q(k) for k in keys]).agg(F.avg(t.cast("double")).alias(out))
        scored = join_cells(df, share, keys)
    elif provider == "logistic":
        if not spec.confounders:
            raise ValueError("a logistic propensity model needs confounders")
        # unregularised logistic MLE by IRLS (GLM binomial / logit): one aggregate pass per iteration,
        # a handful of passes instead of the many of a quasi-Newton solver
        va = VectorAssembler(inputCols=list(spec.confounders), outputCol="_ps_features", handleInvalid="error")
        glr = GeneralizedLinearRegression(family="binomial", link="logit", featuresCol="_ps_features",
                                          labelCol="_ps_label", predictionCol=out, maxIter=100, tol=1e-10, regParam=0.0)
        if weight_col:
            glr = glr.setWeightCol(weight_col)
        train = va.transform(df.withColumn("_ps_label", t.cast("double")))
        fit_input = cached(spread(train).select("_ps_features", "_ps_label", *([weight_col] if weight_col else [])))
        try:
            model = glr.fit(fit_input)
        finally:
            fit_input.unpersist()
        scored = model.transform(train).drop("_ps_features", "_ps_label")
    else:
        raise ValueError("provider must be 'logistic' or 'stratified'")
    if clip:
        scored = scored.withColumn(out, F.least(F.greatest(F.col(out), F.lit(clip[0])), F.lit(clip[1])))
    return scored


def overlap_report(df: DataFrame, ps: str = "ps", clip: tuple[float, float] | None = None) -> DataFrame:
    """Rows at or beyond the clip bounds (or at 0 / 1 without clipping), min and max score: one aggregate."""
    lo, hi = clip if clip else (0.0, 1.0)
    e = F.col(ps)
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(e <= lo, 1).otherwise(0)).alias("n_at_lower"),
                  F.sum(F.when(e >= hi, 1).otherwise(0)).alias("n_at_upper"), F.min(e).alias("ps_min"),
                  F.max(e).alias("ps_max"))


def iptw_sums(df: DataFrame, spec: CausalSpec, ps: str = "ps", weight_col: str | None = None) -> dict:
    t, y, e = _q(spec.treatment).cast("double"), _q(spec.outcome).cast("double"), F.col(ps)
    w = _q(weight_col) if weight_col else F.lit(1.0)
    inside = (e > 0) & (e < 1)  # outside (0, 1) the weights are undefined: counted, never divided by

    def s(x):
        return F.sum(F.when(inside, x))

    r = df.agg(F.sum(w).alias("n"),
               s(w * t * y / e).alias("a1"), s(w * t / e).alias("w1"),
               s(w * (1 - t) * y / (1 - e)).alias("a0"), s(w * (1 - t) / (1 - e)).alias("w0"),
               F.sum(F.when(inside, 0).otherwise(1)).alias("bad"),
               F.sum(F.when(absent(df, spec.treatment) | absent(df, spec.outcome), 1).otherwise(0)).alias("missing")).collect()[0]
    return r.asDict()


def iptw_value(s: dict, weighting: str = "ht") -> float:
    if s["missing"]:
        raise ValueError(f"{s['missing']} rows miss the treatment or the outcome; impute them or pass missing='drop'")
    if s["bad"]:
        raise ValueError(f"{s['bad']} rows have a propensity of 0 or 1 (no overlap); use clip=")
    if weighting == "ht":
        return (s["a1"] - s["a0"]) / s["n"]
    if weighting == "hajek":
        return s["a1"] / s["w1"] - s["a0"] / s["w0"]
    raise ValueError("weighting must be 'ht' or 'hajek'")


def iptw_effect(df: DataFrame, spec: CausalSpec, provider: str = "stratified", cells: list[str] | None = None,
                weighting: str = "ht", clip=None, weight_col: str | None = None, missing: str = "raise") -> float:
    df = usable_rows(df, spec, missing) if missing == "drop" else df
    scored = propensity_scores(df, spec, provider, cells, clip, weight_col=weight_col)
    return iptw_value(iptw_sums(scored, spec, weight_col=weight_col), weighting)


def estimate_iptw(df: DataFrame, spec: CausalSpec, provider: str = "stratified", cells: list[str] | None = None,
                  weighting: str = "ht", clip=None, missing: str = "raise") -> DataFrame:
    """Weighted contrast with w = T/e + (1-T)/(1-e); Horvitz-Thompson or Hajek."""
    df = usable_rows(df, spec, missing) if missing == "drop" else df
    scored = propensity_scores(df, spec, provider, cells, clip)
    s = iptw_sums(scored, spec)
    return estimate_df(df.sparkSession, [("iptw", "ate", int(s["n"]), iptw_value(s, weighting), None, None, None, "none")])
