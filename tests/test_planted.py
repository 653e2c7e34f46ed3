"""Planted effects on the derived frame (sf0.01) are recovered; confounding biases the naive contrast."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import learners as L
from causeway.operators import matching as M
from causeway.operators import propensity as P
from causeway.operators import refute as RF
from causeway.operators import regression as R
from causeway.spec import CausalSpec

ADJ = CausalSpec("tc", "y_planted", ("x1", "x2"))
HTE = CausalSpec("tc", "y_hte", ("x1", "x2"))
TRUE_MEAN_HTE = 332.5  # 260 + 180 x share of x2


def _value(df):
    return df.collect()[0]["value"]


def test_naive_is_biased_adjusted_is_not(oc_mid):
    assert abs(_value(R.diff_in_means(oc_mid, ADJ)) - 320) > 100
    assert abs(_value(R.estimate_ols(oc_mid, ADJ)) - 320) < 2


def test_did_recovers_210(oc_mid):
    est = R.estimate_did(oc_mid, CausalSpec("tc", "y_did", ("x2",), time_period="post"))
    assert abs(_value(est) - 210) < 3


def test_logit_recovers_planted_log_odds(oc_mid):
    r = R.estimate_logit(oc_mid, CausalSpec("tc", "yb_planted", ("x2",))).collect()[0]
    assert abs(r["log_odds"] - 0.9) < 0.1


@pytest.mark.parametrize("provider", ["stratified", "logistic"])
def test_psm_and_iptw(oc_mid, provider):
    cells = ["seg", "x1_band"] if provider == "stratified" else None
    assert abs(M.psm_effects(oc_mid, ADJ, provider, cells)["ate"] - 320) < 15
    assert abs(P.iptw_effect(oc_mid, ADJ, provider, cells, "hajek") - 320) < 15


def test_learners_recover_mean_effect(oc_mid):
    small = L.Forest(num_trees=20, max_depth=6)
    for fn in (L.s_learner, L.t_learner):
        assert abs(L.ate_from_ite(fn(oc_mid, HTE, small)) - TRUE_MEAN_HTE) < 10
    est, ite = L.linear_dml(oc_mid, HTE, L.CellMean(("seg", "x1_band")))
    assert abs(_value(est) - TRUE_MEAN_HTE) < 5
    by = {r["x2"]: r["m"] for r in ite.groupBy("x2").agg(F.avg(L.ITE).alias("m")).collect()}
    assert abs(by[0] - 260) < 10 and abs(by[1] - 440) < 10


def test_causal_forest_two_groups(oc_mid):
    est, ite, model, feats = L.causal_forest(oc_mid, HTE, L.CellMean(("seg", "x1_band")), L.Forest(20, 6))
    by = {r["x2"]: r["m"] for r in ite.groupBy("x2").agg(F.avg(L.ITE).alias("m")).collect()}
    assert abs(by[0] - 260) < 25 and abs(by[1] - 440) < 25
    imp = {r["feature"]: r["importance"] for r in L.feature_importance(model, feats, oc_mid.sparkSession).collect()}
    assert imp["x2"] > imp["x1"]


def test_refutations_pass_on_planted_effect(oc_mid):
    out = {r["test"]: r for r in RF.refute(oc_mid, ADJ, "ols", 40).collect()}
    assert out["random_common_cause"]["passed"]
    assert abs(out["placebo_treatment"]["new_effect"]) < 20
    with pytest.raises(ValueError):
        RF.guard("did")


def test_registered_forest_queries_use_the_full_settings(monkeypatch):
    from causeway.plans import queries_learners as Q
    seen, full = [], L.Forest(num_trees=100, max_depth=10)

    def noted(result):
        return lambda df, spec, *args: seen.append(args) or result

    monkeypatch.setattr(Q, "orders_causal", lambda spark, sf_dir: None)
    monkeypatch.setattr(L, "learner_estimate", noted(None))
    monkeypatch.setattr(L, "linear_dml", noted((None, None)))
    monkeypatch.setattr(L, "causal_forest", noted((None, None, None, None)))
    monkeypatch.setattr(L, "feature_importance", lambda *args: None)
    for f in (Q.e12_s_learner_forest, Q.e13_t_learner_forest, Q.e14_e15_linear_dml_forest, Q.e16_causal_forest, Q.e17_feature_importance):
        f(None, None)
    assert seen == [("s_learner", full), ("t_learner", full), (full,), (full, full), (full, full)]
