"""Edge cases: all-missing and constant columns, empty frames, one-arm data, collinearity,
boolean text with a missing value, negative values under log, duplicate quantile edges."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import coerce as B
from causeway.operators import eda as E
from causeway.operators import filters as D
from causeway.operators import prep as C
from causeway.operators import regression as R
from causeway.spec import CausalSpec


def test_all_missing_column_left_alone(oc_small):
    d = oc_small.select("id", F.lit(None).cast("double").alias("z"), "x1")
    out = C.impute_numeric(d, "mean")
    assert out.where(F.col("z").isNotNull()).count() == 0


def test_constant_column_cut_is_widened(oc_small):
    d = oc_small.select(F.lit(5.0).alias("k"))
    out = C.bucketize(d, "k", 4, "cut")
    assert {r[0] for r in out.select("k_binned_code").distinct().collect()} == {1}


def test_empty_frame(spark):
    d = spark.createDataFrame([], "a double, b string")
    assert E.histogram(d, "a").count() == 0
    assert E.describe(d, ["a"]).collect()[0]["count"] == 0


def test_one_arm_is_an_error(oc_small):
    one = oc_small.where(F.col("tc") == 1)
    with pytest.raises(ValueError):
        R.estimate_ols(one, CausalSpec("tc", "y_planted", ("x1",)))


def test_collinear_confounder_keeps_treatment(oc_small):
    d = oc_small.withColumn("x2b", F.col("x2") * 2)
    rows = {r["term"]: r for r in R.ols_coefficients(d, CausalSpec("tc", "y_planted", ("x1", "x2", "x2b"))).collect()}
    assert abs(rows["tc"]["coef"] - 320) < 20


def test_boolean_text_with_missing_not_converted(spark):
    d = spark.createDataFrame([("TRUE", "T"), ("false", None), ("t", "F")], "a string, b string")
    assert B.text_bool_columns(d) == ["a"]
    assert B.text_bool_columns(d, allow_null=True) == ["a", "b"]


def test_negative_values_skip_log(oc_small):
    _, skipped = C.log1p_columns(oc_small, ["x1", "y"])
    assert skipped == ["x1"]


def test_ne_keeps_missing_and_contains_never_matches_missing(spark):
    d = spark.createDataFrame([("a",), (None,), ("b",)], "s string")
    assert D.filter_rows(d, "s", "!=", "a").count() == 2
    assert D.filter_rows(d, "s", "contains", ".*").count() == 2


def test_duplicate_qcut_edges_dropped(spark):
    d = spark.createDataFrame([(float(v),) for v in [0] * 10 + [1, 2]], "k double")
    edges = C.qcut_edges(d, "k", 4)
    assert edges == sorted(set(edges)) and edges[0] == 0.0


def test_treatment_encoding_rejects_equal_values(oc_small):
    with pytest.raises(ValueError):
        B.encode_treatment(oc_small, "prio", "1-URGENT", "1-URGENT")


def test_iptw_without_overlap_is_a_clear_error(oc_small):
    from causeway.operators import propensity as P
    spec = CausalSpec("tc", "y_planted", ("x1",))
    d = oc_small.withColumn("cell", F.col("tc"))  # the cell is the treatment: propensities 0 and 1
    with pytest.raises(ValueError, match="no overlap"):
        P.iptw_effect(d, spec, "stratified", ["cell"])


def test_missing_tokens_and_nan_become_null(spark, tmp_path):
    from causeway.sources import io as A
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1.5,x\nNaN,NA\n,nan\n2.5,None\n")
    df = A.read_csv(spark, str(p))
    rows = df.collect()
    assert [r.a for r in rows] == [1.5, None, None, 2.5]
    assert [r.b for r in rows] == ["x", None, None, None]


def test_candidate_features_exclude_roles_and_helpers(oc_small):
    from causeway.operators import hte as G
    d = oc_small.select("id", "tc", "y_did", "post", "x1", "x2", F.lit(1.0).alias("_helper"),
                        F.lit(0.0).alias("Estimated_ITE"))
    feats = G.candidate_features(d, CausalSpec("tc", "y_did", ("x1",), time_period="post"))
    assert feats == ["x1", "x2"]


def test_approx_quantiles_are_opt_in_and_close(oc_small):
    from causeway.functions.quantiles import exact_quantiles
    a = exact_quantiles(oc_small, ["x1"], [0.05, 0.95])["x1"]
    b = exact_quantiles(oc_small, ["x1"], [0.05, 0.95], approx=True)["x1"]
    rng = oc_small.agg(F.max("x1") - F.min("x1")).collect()[0][0]
    assert all(abs(x - y) < 0.01 * rng for x, y in zip(a, b))


def test_overlap_report_counts_clipped(oc_small):
    from causeway.operators import propensity as P
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    sc = P.propensity_scores(oc_small, spec, "logistic", clip=(0.35, 0.65))
    r = P.overlap_report(sc, clip=(0.35, 0.65)).collect()[0]
    assert r.ps_min >= 0.35 and r.ps_max <= 0.65 and r.n_at_lower + r.n_at_upper > 0
