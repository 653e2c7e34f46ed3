"""Gram-job OLS, Spark IRLS logit, the bootstrap, DiD, HTE and DML against independent numpy
on a small collected fixture (tests only)."""

import numpy as np
from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_BOOTSTRAP, poisson1_weight, uniform
from causeway.operators import hte as G
from causeway.operators import inference as U
from causeway.operators import regression as R
from causeway.spec import CausalSpec


def _ols(X, y, w=None):
    X1 = np.column_stack([np.ones(len(y)), X])
    if w is None:
        w = np.ones(len(y))
    XtW = X1.T * w
    beta = np.linalg.solve(XtW @ X1, XtW @ y)
    resid = y - X1 @ beta
    dof = w.sum() - X1.shape[1]
    s2 = (w * resid ** 2).sum() / dof
    cov = s2 * np.linalg.inv(XtW @ X1)
    return beta, np.sqrt(np.diag(cov))


def _pdf(oc, cols):
    return oc.select(*cols).toPandas()


def test_ols_matches_numpy(oc_small):
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    got = {r["term"]: r for r in R.ols_coefficients(oc_small, spec).collect()}
    p = _pdf(oc_small, ["tc", "x1", "x2", "y_planted"])
    beta, se = _ols(p[["tc", "x1", "x2"]].to_numpy(float), p["y_planted"].to_numpy(float))
    for k, term in enumerate(["const", "tc", "x1", "x2"]):
        assert np.isclose(got[term]["coef"], beta[k], rtol=1e-9, atol=1e-9)
        assert np.isclose(got[term]["se"], se[k], rtol=1e-7)


def test_did_with_confounder_matches_numpy(oc_small):
    spec = CausalSpec("tc", "y_did", ("x2",), time_period="post")
    got = {r["term"]: r for r in R.did_coefficients(oc_small, spec).collect()}
    p = _pdf(oc_small, ["tc", "post", "x2", "y_did"])
    X = np.column_stack([p.tc, p.post, p.tc * p.post, p.x2]).astype(float)
    beta, se = _ols(X, p.y_did.to_numpy(float))
    assert np.isclose(got["did_interaction"]["coef"], beta[3], rtol=1e-9)
    assert np.isclose(got["did_interaction"]["se"], se[3], rtol=1e-7)


def _irls(X, y, w=None, iters=50):
    X1 = np.column_stack([np.ones(len(y)), X])
    w = np.ones(len(y)) if w is None else w
    b = np.zeros(X1.shape[1])
    for _ in range(iters):
        mu = 1 / (1 + np.exp(-X1 @ b))
        H = (X1.T * (w * mu * (1 - mu))) @ X1
        b = b + np.linalg.solve(H, X1.T @ (w * (y - mu)))
    mu = 1 / (1 + np.exp(-X1 @ b))
    H = (X1.T * (w * mu * (1 - mu))) @ X1
    return b, np.sqrt(np.diag(np.linalg.inv(H)))


def test_logit_matches_numpy_irls(oc_small):
    spec = CausalSpec("tc", "yb_planted", ("x2", "x1"))
    got = {r["term"]: r for r in R.logit_coefficients(oc_small, spec).collect()}
    p = _pdf(oc_small, ["tc", "x2", "x1", "yb_planted"])
    b, se = _irls(p[["tc", "x2", "x1"]].to_numpy(float), p.yb_planted.to_numpy(float))
    assert np.isclose(got["tc"]["coef"], b[1], rtol=1e-6)
    assert np.isclose(got["tc"]["se"], se[1], rtol=1e-5)


def _weights(oc, B):
    ex = oc.select("id", F.explode(F.sequence(F.lit(0), F.lit(B - 1))).alias("rep"))
    ex = ex.withColumn("w", poisson1_weight(uniform("id", SALT_BOOTSTRAP, F.col("rep"))))
    return ex.toPandas()


def test_bootstrap_ols_matches_numpy_with_same_weights(oc_small):
    B = 6
    spec = CausalSpec("tc", "y_planted", ("x1",))
    got = {r["rep"]: r["estimate"] for r in U.bootstrap_ols(oc_small, spec, B).collect()}
    p = _pdf(oc_small, ["id", "tc", "x1", "y_planted"])
    w = _weights(oc_small, B)
    for rep in range(B):
        ww = p.merge(w[w.rep == rep], on="id")
        beta, _ = _ols(ww[["tc", "x1"]].to_numpy(float), ww.y_planted.to_numpy(float), ww.w.to_numpy(float))
        assert np.isclose(got[rep], beta[1], rtol=1e-8)


def test_bootstrap_logit_matches_numpy_with_same_weights(oc_small):
    B = 4
    spec = CausalSpec("tc", "yb_planted", ("x2",))
    got = {r["rep"]: r["estimate"] for r in U.bootstrap_logit(oc_small, spec, B).collect()}
    p = _pdf(oc_small, ["id", "tc", "x2", "yb_planted"])
    w = _weights(oc_small, B)
    for rep in range(B):
        ww = p.merge(w[w.rep == rep], on="id")
        b, _ = _irls(ww[["tc", "x2"]].to_numpy(float), ww.yb_planted.to_numpy(float), ww.w.to_numpy(float))
        assert np.isclose(got[rep], b[1], rtol=1e-6)


def test_hte_shared_gram_equals_separate_fits(oc_small):
    spec = CausalSpec("tc", "y_hte", ("x1", "x2"))
    rows = {r["feature"]: r for r in G.interaction_terms(oc_small, spec, ["x1", "x2"])}
    p = _pdf(oc_small, ["tc", "x1", "x2", "y_hte"])
    for f, other in (("x1", "x2"), ("x2", "x1")):
        X = np.column_stack([p.tc, p[f], p.tc * p[f], p[other]]).astype(float)
        beta, se = _ols(X, p.y_hte.to_numpy(float))
        assert np.isclose(rows[f]["coef"], beta[3], rtol=1e-7)
        assert np.isclose(rows[f]["se"], se[3], rtol=1e-6)


def test_wide_gram_equals_aggregate_gram(oc_small, monkeypatch):
    from causeway.operators import moments as MM
    cols = {"tc": F.col("tc"), "x1": F.col("x1"), "x2": F.col("x2"), "post": F.col("post"),
            "tx1": F.col("tc") * F.col("x1"), "y": F.col("y_hte")}
    a = MM.moments(oc_small, cols)
    monkeypatch.setattr(MM, "WIDE_LIMIT", 2)
    b = MM.moments(oc_small, cols)
    assert a.n == b.n and a.n_total == b.n_total
    assert np.allclose(a.mean, b.mean, rtol=1e-12)
    assert np.allclose(a.C, b.C, rtol=1e-9)
    fa, fb = MM.solve_ols(a, "y", ["tc", "x1", "x2", "post", "tx1"]), MM.solve_ols(b, "y", ["tc", "x1", "x2", "post", "tx1"])
    assert np.allclose(fa.coef, fb.coef, rtol=1e-8)
