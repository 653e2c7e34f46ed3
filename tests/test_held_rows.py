"""An estimate by forests reads and joins its table once; bins are found by halving."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import forest as G
from causeway.operators import learners as L
from causeway.spec import CausalSpec

SPEC = CausalSpec("t", "y", ("x", "z"), id_col="id")
SMALL = L.Forest(3, 3)


def _read_once(spark, estimate):
    rng = np.random.default_rng(8)
    rows = [(i, float(x), int(z), float(y), int(i * 7919 % 10 < 4)) for i, (x, z, y) in enumerate(
        zip(rng.normal(size=400).round(2), rng.integers(0, 4, 400), rng.normal(size=400)))]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(v):
        seen.add(1)
        return v

    df = spark.createDataFrame(rows, "id long, x double, z int, y double, t int").withColumn("x", noted("x"))
    assert estimate(df).first()["n"] == 400
    assert seen.value == 400


def test_causal_forest_reads_its_table_once(spark):
    _read_once(spark, lambda d: L.causal_forest(d, SPEC, SMALL, SMALL)[0])


def test_linear_dml_reads_its_table_once(spark):
    _read_once(spark, lambda d: L.linear_dml(d, SPEC, SMALL)[0])


@pytest.mark.parametrize("method", ["s_learner", "t_learner"])
def test_learners_read_their_table_once(spark, method):
    _read_once(spark, lambda d: L.learner_estimate(d, SPEC, method, SMALL))


def test_rows_are_let_go(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    _read_once(spark, lambda d: L.linear_dml(d, SPEC, SMALL)[0])
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_scored_tables_keep_rows_and_columns(spark):
    rows = [(i, float(i % 7), i % 3, float(i), i % 2 if i % 5 else None, "a") for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double, z int, y double, t int, other string")
    for ite in (L.linear_dml(df, SPEC, SMALL, missing="drop")[1], L.causal_forest(df, SPEC, SMALL, SMALL, missing="drop")[1]):
        assert ite.columns == [*df.columns, L.ITE] and ite.count() == 160
    with pytest.raises(ValueError, match="missing"):
        L.linear_dml(df, SPEC, SMALL)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 63])
def test_bins_count_the_edges_below(spark, n):
    edges = np.sort(np.random.default_rng(n).normal(size=n))
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, *edges.tolist(), *np.nextafter(edges, 9).tolist(),
              *np.nextafter(edges, -9).tolist()]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", G._bin(F.col("v"), edges).alias("b"))
    for v, b in df.collect():
        assert b == (0 if v is None else n if math.isnan(v) else int((edges < v).sum())), v
