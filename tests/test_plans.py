"""Physical-plan properties the scale design relies on (checked on the executed plan text)."""

from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_BOOTSTRAP, explode_draws
from causeway.operators import eda as E
from causeway.operators import filters as D
from causeway.operators import inference as U
from causeway.operators import learners as L
from causeway.operators import propensity as P
from causeway.operators import regression as R
from causeway.plans.frames import orders_causal
from causeway.sources.io import read_table
from causeway.spec import CausalSpec
from conftest import SF_SMALL


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def _formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_filter_is_pushed_into_the_scan(spark):
    orders = read_table(spark, SF_SMALL, "orders")
    plan = _formatted(D.filter_rows(orders, "o_totalprice", ">", 1000.0))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,1000.0)]" in plan


def test_gram_job_reads_only_model_columns(spark):
    # sf0.1 is never cached by the fixtures (a cached frame would replace the scan); only planned here
    oc = orders_causal(spark, "/root/testdata/sf0.1")
    q = oc.agg(F.covar_pop("tc", "y_planted").alias("c"))
    plan = _formatted(q)
    orders_schema = [ln for ln in plan.splitlines() if "ReadSchema" in ln and "o_orderkey" in ln][0]
    for unused in ("o_orderstatus", "o_orderpriority", "o_totalprice"):
        assert unused not in orders_schema


def test_no_cartesian_or_nested_loop_joins(spark):
    oc = orders_causal(spark, SF_SMALL)
    frames = [
        E.histogram_by(oc, "y", "seg", 20),
        E.grouped_agg(oc, ["seg", "t"], "y", "median"),
        U.with_replicates(oc.select("id", "y"), "id", 5),
        explode_draws(oc.select("id"), "id", 5, SALT_BOOTSTRAP, normal=True),
    ]
    for f in frames:
        p = _plan(f)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_rows_are_not_shuffled_to_meet_a_few_cells(spark):
    oc = orders_causal(spark, SF_SMALL).select("id", "tc", "x1", "x2", "y", "y_hte", "y_planted", "seg", "x1_band").cache()
    spec, cells = CausalSpec("tc", "y_planted", ("x1", "x2"), id_col="id"), ["seg", "x1_band"]
    frames = [P.propensity_scores(oc, spec, "stratified", cells), L.s_learner(oc, spec, L.CellMean(tuple(cells))),
              L.dml_residuals(oc, spec, L.CellMean(tuple(cells)))]
    for f in frames:
        assert "Exchange hashpartitioning" not in f._jdf.queryExecution().executedPlan().toString()
    for f in (E.histogram_by(oc, "y", "seg", 20), E.box_stats(oc, "y", "seg")):
        plan = f._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning(seg" not in plan.split("HashAggregate")[-1]


def test_one_hash_per_replicate_row(spark):
    oc = orders_causal(spark, SF_SMALL)
    q = U.with_replicates(oc.select("id", "tc"), "id", 50).groupBy("rep").agg(F.sum(F.col("w") * F.col("tc")))
    assert q._jdf.queryExecution().executedPlan().toString().count("md5(") == 1


def test_replicate_aggregate_shuffles_only_groups(spark):
    oc = orders_causal(spark, SF_SMALL)
    q = U.with_replicates(oc.select("id", "tc"), "id", 50).groupBy("rep").agg(F.sum("w"))
    plan = _formatted(q)
    assert "partial_sum" in plan  # map-side combine before the exchange
    assert q.count() == 50


def test_estimates_do_not_depend_on_input_partitioning(spark):
    oc = orders_causal(spark, SF_SMALL)
    spec = CausalSpec("tc", "y_planted", ("x1", "x2"))
    a = R.ols_coefficients(oc.repartition(1), spec).collect()
    b = R.ols_coefficients(oc.repartition(64), spec).collect()
    for ra, rb in zip(sorted(a), sorted(b)):
        assert abs(ra["coef"] - rb["coef"]) <= 1e-9 * max(1.0, abs(ra["coef"]))
