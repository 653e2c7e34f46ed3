"""Missing outcomes, null cells, row layout: nothing is wrong in silence."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import learners as L
from causeway.operators import matching as M
from causeway.operators import propensity as P
from causeway.sources import io
from causeway.spec import CausalSpec

SPEC = CausalSpec("tc", "y_planted", ("x1", "x2"), id_col="id")
CELLS = ["seg", "x1_band"]
CELL = L.CellMean(tuple(CELLS))
ESTIMATES = {
    "psm": lambda d, **k: M.psm_effects(d, SPEC, "stratified", CELLS, **k)["ate"],
    "iptw": lambda d, **k: P.iptw_effect(d, SPEC, "stratified", CELLS, "hajek", **k),
    "t_learner": lambda d, **k: L.ate_from_ite(L.t_learner(d, SPEC, CELL, **k)),
    "s_learner": lambda d, **k: L.ate_from_ite(L.s_learner(d, SPEC, CELL, **k)),
    "dml": lambda d, **k: L.linear_dml(d, SPEC, CELL, **k)[0].collect()[0]["value"],
}


@pytest.fixture(scope="module")
def holes(oc_mid):
    third = F.col("id") % 3 == 0
    return oc_mid.withColumn("y_planted", F.when(third & (F.col("id") % 2 == 0), F.lit(float("nan"))).when(third, None).otherwise(
        F.col("y_planted"))).cache()


@pytest.mark.parametrize("name", sorted(ESTIMATES))
def test_missing_outcomes_raise_or_drop(holes, name):
    with pytest.raises(ValueError, match="miss"):
        ESTIMATES[name](holes)
    kept = holes.where("y_planted IS NOT NULL AND NOT isnan(y_planted)")
    dropped = ESTIMATES[name](holes, missing="drop")
    assert abs(dropped - ESTIMATES[name](kept)) < 1e-9 and abs(dropped - 320) < 15


@pytest.mark.parametrize("name", sorted(ESTIMATES))
def test_null_cells_are_cells(oc_mid, name):
    null = oc_mid.withColumn("seg", F.when(F.col("seg") != "BUILDING", F.col("seg")))
    named = oc_mid.withColumn("seg", F.when(F.col("seg") != "BUILDING", F.col("seg")).otherwise("none"))
    assert abs(ESTIMATES[name](null) - ESTIMATES[name](named)) < 1e-9


def test_forests_do_not_depend_on_the_layout(oc_small):
    small = L.Forest(num_trees=5, max_depth=4)
    got = {n: (L.ate_from_ite(L.t_learner(oc_small.repartition(n, "y"), SPEC, small)),
               L.causal_forest(oc_small.repartition(n, "y"), SPEC, CELL, small)[0].collect()[0]["value"]) for n in (1, 3, 7, 8)}
    for a, b in got.values():
        assert abs(a - got[1][0]) < 1e-9 and abs(b - got[1][1]) < 1e-9


def test_matching_of_a_rare_arm_is_linear_in_its_scores(spark):
    n = 200_000
    groups = spark.range(n).selectExpr("CAST(id AS DOUBLE) AS s", "CAST(id % 5000 = 0 AS INT) AS arm", "1.0D AS n",
                                       "CAST(id % 5000 = 0 AS INT) * 3.0D + id AS sy")
    both = M.matched_effects(groups)
    assert abs(both[1][0] - 3.0) < 1.0 and both[0][1] == n - n // 5000


def test_csv_keeps_text_and_types(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, 'say "hi", ok\nnext', "en", "a,b", 5), (-2, "back\\slash\\", None, '"', 6)], docs.schema)
    io.write_csv(docs.unionByName(odd), str(tmp_path / "d"))
    back = io.read_csv(spark, str(tmp_path / "d"))
    assert dict(back.dtypes)["n_chars"] in ("int", "bigint")
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, docs.unionByName(odd).collect()), key=repr)
    (tmp_path / "n.csv").write_text('a,b,c,d,e\n1,2.5,true,2024-01-02,007x\nNA,nan,,N/A,x\n3,4,false,2024-02-03,y\n')
    got = io.read_csv(spark, str(tmp_path / "n.csv"))
    assert [t for _, t in got.dtypes] == ["int", "double", "boolean", "date", "string"]
    assert got.where("a IS NULL AND b IS NULL AND c IS NULL AND d IS NULL").count() == 1


def test_labels_and_encoded_names_tell_values_apart(spark):
    from causeway.operators import coerce, prep
    d = spark.createDataFrame([(i / 1000,) for i in range(100)], "v double")
    labels = [r[0] for r in prep.bucketize(d, "v", 4).select("v_binned").distinct().collect()]
    assert len(labels) == 4
    t = spark.createDataFrame([("A-B",), ("A B",), (None,), ("Z",)], "v string")
    out, names = coerce.one_hot(t, ["v"])
    assert len(set(names)) == len(names) == 3 and "v_missing" in names
    assert sorted(sum(r[n] for n in names) for r in out.collect()) == [0, 1, 1, 1]
