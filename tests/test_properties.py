"""Invariances: partitioning, winsorize bounds, scaling, bucket coverage, identities between estimators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.functions.quantiles import exact_quantiles
from causeway.operators import eda as E
from causeway.operators import inference as U
from causeway.operators import matching as M
from causeway.operators import prep as C
from causeway.operators import propensity as P
from causeway.operators import regression as R
from causeway.spec import CausalSpec

SPEC = CausalSpec("tc", "y_planted", ("x1",))


def test_bootstrap_does_not_depend_on_partitioning(oc_small):
    a = sorted(U.bootstrap_ols(oc_small.repartition(1), SPEC, 5).collect())
    b = sorted(U.bootstrap_ols(oc_small.repartition(7), SPEC, 5).collect())
    assert [r.rep for r in a] == [r.rep for r in b]
    assert np.allclose([r.estimate for r in a], [r.estimate for r in b], rtol=1e-10)


def test_winsorize_within_quantiles_and_order(oc_small):
    lo, hi = C.winsor_bounds(oc_small, ["x1"], 0.1)["x1"]
    w = C.winsorize(oc_small.select("id", "x1"), ["x1"], 0.1).join(oc_small.select("id", F.col("x1").alias("raw")), "id")
    p = w.toPandas().sort_values("raw")
    assert p.x1.min() >= lo - 1e-9 and p.x1.max() <= hi + 1e-9
    assert (np.diff(p.x1.to_numpy()) >= -1e-12).all()


def test_standardize_mean_zero_std_one(oc_small):
    r = C.standardize(oc_small, ["x1"]).agg(F.avg("x1").alias("m"), F.stddev_pop("x1").alias("s")).collect()[0]
    assert abs(r.m) < 1e-9 and abs(r.s - 1) < 1e-9


def test_qcut_codes_cover_every_row(oc_small):
    b = C.bucketize(oc_small.select("x1"), "x1", 5, "qcut")
    assert b.where(F.col("x1_binned_code").isNull()).count() == 0
    assert {r[0] for r in b.select("x1_binned_code").distinct().collect()} == set(range(5))


def test_identities(oc_small):
    did = R.did_coefficients(oc_small, CausalSpec("tc", "y_did", (), time_period="post"))
    coef = did.where(F.col("term") == R.DID_TERM).collect()[0]["coef"]
    four = R.did_four_cell(oc_small, CausalSpec("tc", "y_did", (), time_period="post")).collect()[0]["did"]
    assert np.isclose(coef, four, rtol=1e-9)
    e2 = R.diff_in_means(oc_small, SPEC).collect()[0]["value"]
    e1 = R.estimate_ols(oc_small, SPEC.with_(confounders=())).collect()[0]["value"]
    assert np.isclose(e1, e2)


def test_hajek_invariant_to_outcome_shift(oc_small):
    spec = CausalSpec("tc", "y_planted", ("x1",))
    a = P.iptw_effect(oc_small, spec, "stratified", ["seg", "x1_band"], "hajek")
    shifted = oc_small.withColumn("y_planted", F.col("y_planted") + 1000.0)
    b = P.iptw_effect(shifted, spec, "stratified", ["seg", "x1_band"], "hajek")
    assert np.isclose(a, b, rtol=1e-9)


def test_exact_quantiles_refinement_equals_percentile(oc_small):
    qs = [0.05, 0.25, 0.5, 0.9]
    a = exact_quantiles(oc_small, ["x1", "y"], qs)
    b = exact_quantiles(oc_small, ["x1", "y"], qs, quantile_limit=0)
    p = oc_small.select("x1", "y").toPandas()
    for c in ("x1", "y"):
        assert np.allclose(a[c], b[c], rtol=1e-12)
        assert np.allclose(a[c], np.quantile(p[c].to_numpy(), qs), rtol=1e-12)


def test_grouped_quantiles_hot_groups_equal_percentile(oc_small):
    a = E.grouped_quantiles(oc_small, ["seg"], "y", [0.25, 0.5], ["q1", "q2"]).toPandas().sort_values("seg")
    b = E.grouped_quantiles(oc_small, ["seg"], "y", [0.25, 0.5], ["q1", "q2"], quantile_limit=0).toPandas().sort_values("seg")
    assert np.allclose(a[["q1", "q2"]].to_numpy(), b[["q1", "q2"]].to_numpy(), rtol=1e-12)


def _brute_force(groups: pd.DataFrame, from_arm: int) -> float:
    fr, to = groups[groups.arm == from_arm], groups[groups.arm == 1 - from_arm]
    num, cnt = 0.0, 0.0
    ts = to.s.to_numpy()
    for _, r in fr.iterrows():
        d = np.abs(ts - r.s)
        near = to[d == d.min()]
        ym = near.sy.sum() / near.n.sum()
        num += r.sy - r.n * ym
        cnt += r.n
    return (1 if from_arm == 1 else -1) * num / cnt


@pytest.mark.parametrize("parts", [1, 40])
def test_matching_over_range_partitions_equals_brute_force(oc_small, parts):
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    scored = P.propensity_scores(oc_small, spec, "logistic")
    groups = M.score_groups(scored, spec)
    pg = groups.toPandas()
    conf = oc_small.sparkSession.conf
    before = {k: conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        conf.set("spark.sql.shuffle.partitions", str(parts))
        conf.set("spark.sql.adaptive.enabled", "false")
        assert M._placed(groups, []).agg(F.count_distinct("part")).first()[0] == parts
        both = M.matched_effects(groups)
    finally:
        for k, v in before.items():
            conf.set(k, v)
    for arm in (1, 0):
        assert np.isclose(both[arm][0], _brute_force(pg, arm), rtol=1e-9)


def test_matching_all_scores_tied(oc_small):
    spec = CausalSpec("tc", "y_planted", ())
    d = oc_small.withColumn("ps", F.lit(0.5))
    r = M.psm_effects(d, spec, ps="ps")
    naive = R.diff_in_means(oc_small, spec).collect()[0]["value"]
    assert np.isclose(r["ate"], naive, rtol=1e-9)


def test_quantile_passes_split_by_distinct_budget(oc_small):
    qs = [0.1, 0.5]
    a = exact_quantiles(oc_small, ["x1", "y", "t"], qs)
    b = exact_quantiles(oc_small, ["x1", "y", "t"], qs, quantile_limit=1600)  # one column per pass
    for c in ("x1", "y", "t"):
        assert np.allclose(a[c], b[c], rtol=1e-12)


def test_joint_refutation_pass_equals_separate_passes(oc_small):
    from causeway.operators import refute as RF
    spec = CausalSpec("tc", "y_planted", ("x1",))
    j1, j2 = RF.joint_sims(oc_small, spec, 8)
    a1 = sorted(RF.random_common_cause_sims(oc_small, spec, 8).collect())
    a2 = sorted(RF.placebo_sims(oc_small, spec, 8).collect())
    assert np.allclose([r.estimate for r in sorted(j1.collect())], [r.estimate for r in a1], rtol=1e-8)
    assert np.allclose([r.estimate for r in sorted(j2.collect())], [r.estimate for r in a2], rtol=1e-8)
