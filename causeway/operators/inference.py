"""Bootstrap and analytic uncertainty.

Poisson bootstrap: every row gets an independent Poisson(1) count per replicate, drawn from a
hash of (id, replicate), so a replicate is identical whatever the partitioning or retries. All
replicates run in ONE job for moment estimators: a matrix of counts for each Arrow batch times the
rows' products (``replicates``), so no row is exploded and only B * p^2 numbers a partition shuffle. The
logistic models run a Newton step for all replicates per job (start: the full-sample fit, so a
few passes suffice) over counts drawn once, a byte a replicate. Estimators with learned nuisances refit per replicate with ``weightCol``.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import spec as S
from causeway.functions import stats
from causeway.functions.hashing import (SALT_BOOTSTRAP, explode_draws, poisson1_weight,
                                        uniform)
from causeway.operators import regression as R
from causeway.operators.moments import centred_moments, moments, solve_ols
from causeway.operators.replicates import pairs, replicate_sums, symmetric, weighed, weighed_sums
from causeway.session import cached
from causeway.spec import CausalSpec

DEFAULT_B = 50


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def with_replicates(df: DataFrame, id_col: str, B: int, rng: str = "md5") -> DataFrame:
    """Adds ``rep`` (0..B-1) and its Poisson(1) weight ``w`` (rows of weight 0 stay: they add nothing)."""
    ex = explode_draws(df, id_col, B, SALT_BOOTSTRAP, rng, "rep", "_u")
    return ex.withColumn("w", poisson1_weight(F.col("_u"))).drop("_u")


def _moment_cols(spec: CausalSpec, did: bool) -> tuple[dict[str, Column], str]:
    cols = R.model_columns(spec, did)
    return cols, (R.DID_TERM if did else spec.treatment)


def bootstrap_ols(df: DataFrame, spec: CausalSpec, B: int = DEFAULT_B, did: bool = False,
                  rng: str = "md5") -> DataFrame:
    """U1 for E1/E2/E6: replicate estimates (rep, estimate) from one grouped Gram job."""
    cols, term = _moment_cols(spec, did)
    base = moments(df, cols)
    if base.n != base.n_total:
        raise ValueError("missing values in model columns")
    names, mean = list(cols), base.mean
    p = len(names)
    i, j = pairs(p)

    def sums(x, draws):
        m = x - mean
        return draws.poisson(SALT_BOOTSTRAP).T.astype(float) @ np.column_stack([np.ones(len(m)), m, m[:, i] * m[:, j]])

    got = replicate_sums(df, spec.id_col, list(cols.values()), B, 1 + p + len(i), sums, rng, (SALT_BOOTSTRAP,))
    xs = [c for c in names if c != spec.outcome]
    rows = []
    for rep, row in enumerate(got):
        m = centred_moments(names, mean, row[0], row[1:1 + p], symmetric(row[1 + p:], p))
        est = None
        if m is not None:
            fit = solve_ols(m, spec.outcome, xs)
            if fit.identified.get(term, False):
                est = float(fit.coef[fit.index(term)])
        rows.append((rep, est))
    return df.sparkSession.createDataFrame(rows, S.BOOTSTRAP)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def bootstrap_logit(df: DataFrame, spec: CausalSpec, B: int = DEFAULT_B, did: bool = False, rng: str = "md5",
                    max_iter: int = 25, tol: float = 1e-10) -> DataFrame:
    """U1 for E3/E8: weighted logit MLE of every replicate; one Newton step for all replicates per job."""
    R.check_binary(df, spec.outcome)
    cols = R.model_columns(spec, did)
    cols.pop(spec.outcome)
    names = list(cols)
    term = R.DID_TERM if did else spec.treatment
    full = R.logit_fit(df, spec.outcome, cols)
    p = len(names) + 1
    beta = {rep: np.array(full.coef, dtype=float) for rep in range(B)}
    i, j = pairs(p)
    # the counts are drawn once, a byte each, and read by every pass
    drawn = cached(weighed(df, spec.id_col, [_q(spec.outcome), *cols.values()], B, SALT_BOOTSTRAP, rng))
    active = set(range(B))
    for _ in range(max_iter):
        if not active:
            break
        now = np.array(sorted(active))
        start = np.array([beta[r] for r in now])

        def sums(x, w, now=now, start=start):
            ok = ~np.isnan(x).any(axis=1)
            y, z, w = x[ok, :1], np.column_stack([np.ones(ok.sum()), x[ok, 1:]]), w[ok][:, now]
            mu = _sigmoid(np.clip(z @ start.T, -700, 700))
            out = np.zeros((B, p + len(i)))
            out[now] = np.column_stack([(w * (y - mu)).T @ z, (w * mu * (1 - mu)).T @ (z[:, i] * z[:, j])])
            return out

        got = weighed_sums(drawn, B, p + len(i), sums)
        for r in now:
            try:
                step = np.linalg.solve(symmetric(got[r, p:], p), got[r, :p])
            except np.linalg.LinAlgError:
                beta[r] = np.full(p, np.nan)
                active.discard(r)
                continue
            beta[r] = beta[r] + step
            if np.max(np.abs(step)) < tol * (1.0 + np.max(np.abs(beta[r]))):
                active.discard(r)
    drawn.unpersist()
    k = 1 + names.index(term)
    rows = [(r, float(beta[r][k]) if np.isfinite(beta[r][k]) and r not in active else None) for r in range(B)]
    return df.sparkSession.createDataFrame(rows, S.BOOTSTRAP)


def bootstrap_summary(boot: DataFrame) -> DataFrame:
    """Successful replicates, population std (the bootstrap se) and the 95 % percentile interval."""
    e = F.col("estimate")
    return boot.where(e.isNotNull()).agg(
        F.count(e).alias("n_reps"), F.stddev_pop(e).alias("se"),
        F.percentile(e, F.lit(0.025)).alias("ci_lower"), F.percentile(e, F.lit(0.975)).alias("ci_upper"))


def summarize(boot: DataFrame) -> tuple[int, float, float, float]:
    r = bootstrap_summary(boot).collect()[0]
    if not r["n_reps"]:
        raise RuntimeError("every bootstrap replicate failed")
    return int(r["n_reps"]), r["se"], r["ci_lower"], r["ci_upper"]


def estimate_record(df: DataFrame, spec: CausalSpec, method: str = "ols", B: int | None = DEFAULT_B,
                    rng: str = "md5", return_boot: bool = False):
    """The ``estimate`` row; bootstrap se and percentile interval when B is given, else the
    analytic ones (U5). ``se_source`` says which."""
    spark = df.sparkSession
    if method in ("ols", "did", "diff_in_means"):
        sp = spec.with_(confounders=()) if method == "diff_in_means" else spec
        did = method == "did"
        fit = R.ols_fit(df, sp, did)
        term = R.DID_TERM if did else sp.treatment
        row = fit.table()[fit.index(term)]
        value, n, a_se, a_lo, a_hi = row[1], int(fit.n), row[2], row[5], row[6]
        estimand = "att_did" if did else "ate"
        boot = (lambda: bootstrap_ols(df, sp, B, did, rng))
    elif method in ("logit", "did_logit"):
        did = method == "did_logit"
        est = R.logit_estimate_row(df, spec, did).collect()[0]
        value, n, a_se, a_lo, a_hi, estimand = est["value"], est["n"], est["se"], est["ci_lower"], est["ci_upper"], "log_odds"
        boot = (lambda: bootstrap_logit(df, spec, B, did, rng))
    else:
        raise ValueError(f"use the method's own module for {method!r}")
    if not B:
        est = R.estimate_df(spark, [(method, estimand, n, value, a_se, a_lo, a_hi, "analytic")])
        return (est, None) if return_boot else est
    reps = boot()
    _, se, lo, hi = summarize(reps)
    est = R.estimate_df(spark, [(method, estimand, n, value, se, lo, hi, "bootstrap")])
    return (est, reps) if return_boot else est


def analytic_inference(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """The treatment row of the coefficient table (se, t, p, interval)."""
    return R.ols_coefficients(df, spec).where(F.col("term") == spec.treatment)


def normal_interval(value: float, se: float, alpha: float = 0.05) -> tuple[float, float]:
    z = stats.norm_ppf(1 - alpha / 2)
    return value - z * se, value + z * se


def generic_bootstrap(df: DataFrame, spec: CausalSpec, estimator, B: int = 10, rng: str = "md5") -> DataFrame:
    """Refit loop for estimators with learned parts: ``estimator(weighted_df, weight_col) -> float``.
    The weight column carries the replicate's Poisson counts (Spark ML ``weightCol``)."""
    rows = []
    for rep in range(B):
        wdf = df.withColumn("_boot_w", poisson1_weight(uniform(spec.id_col, SALT_BOOTSTRAP, rep, rng)).cast("double"))
        wdf = wdf.where(F.col("_boot_w") > 0)
        try:
            est = float(estimator(wdf, "_boot_w"))
        except (ValueError, ZeroDivisionError, np.linalg.LinAlgError):  # no overlap or singular in this replicate
            est = None
        rows.append((rep, est if est is not None and math.isfinite(est) else None))
    return df.sparkSession.createDataFrame(rows, S.BOOTSTRAP)
