"""analyze(): each method end to end on the derived frame (sf0.001, light settings)."""

import pytest

from causeway.operators import learners as L
from causeway.operators import prep as C
from causeway.plans.analysis import analyze
from causeway.spec import CausalSpec

ADJ = CausalSpec("tc", "y_planted", ("x1", "x2"))
HTE = CausalSpec("tc", "y_hte", ("x1", "x2"))


def _frame(oc):
    return oc.select("id", "tc", "y_planted", "y_hte", "y_did", "yb_planted", "x1", "x2", "post", "seg", "x1_band")


@pytest.mark.parametrize("method,spec,kw", [
    ("ols", ADJ, dict(n_sims=10, steps=[C.Winsorize(("x1",), 0.05)])),
    ("did", CausalSpec("tc", "y_did", ("x2",), time_period="post"), {}),
    ("logit", CausalSpec("tc", "yb_planted", ("x2",)), dict(bootstrap=5)),
    ("psm", ADJ, dict(bootstrap=3, provider="stratified", cells=["seg"], n_sims=3)),
    ("iptw", ADJ, dict(bootstrap=3, provider="stratified", cells=["seg"], n_sims=3)),
    ("linear_dml", HTE, dict(learner=L.CellMean(("seg", "x1_band")), bootstrap=10, n_sims=3)),
    ("s_learner", HTE, dict(learner=L.CellMean(("seg", "x1_band")), bootstrap=3, n_sims=3)),
])
def test_analyze_runs(oc_small, method, spec, kw, tmp_path):
    kw.setdefault("bootstrap", 10)
    res = analyze(_frame(oc_small), spec, method, export_path=str(tmp_path / "out"), **kw)
    try:
        est = res.estimate.collect()[0]
        assert est["method"] == method and est["value"] == est["value"]
        if kw.get("bootstrap"):
            assert est["se_source"] == "bootstrap" and est["se"] > 0
        assert res.hte is not None and res.hte.count() > 0
        assert res.table.sparkSession.read.option("header", True).csv(str(tmp_path / "out")).count() == res.table.count()
        if method not in ("did", "logit"):
            rows = {r["test"]: r for r in res.refutation.collect()}
            assert set(rows) == {"random_common_cause", "placebo_treatment"}
    finally:
        res.release()


def test_auto_picks_the_logit_for_a_binary_outcome(oc_small):
    for spec, name in ((CausalSpec("tc", "yb_planted", ("x2",), id_col="id"), "logit"), (CausalSpec("tc", "y_planted", ("x2",), id_col="id"), "ols")):
        res = analyze(_frame(oc_small), spec, "auto", bootstrap=None, heterogeneity=False, refutation=False)
        assert res.estimate.first()["method"] == name


@pytest.mark.parametrize("method", ["linear_dml", "causal_forest"])
def test_refit_bootstrap_of_learned_estimators(oc_small, method):
    spec = CausalSpec("tc", "y_hte", ("x1", "x2"), id_col="id")
    res = analyze(_frame(oc_small), spec, method, bootstrap=2, heterogeneity=False, refutation=False,
                  learner=L.CellMean(("seg", "x1_band")), forest=L.Forest(num_trees=3, max_depth=3))
    row = res.estimate.first()
    assert row["se"] > 0 and res.bootstrap.where("estimate IS NOT NULL").count() == 2
