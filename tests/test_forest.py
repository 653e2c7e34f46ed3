"""Forests grown together: brute-force splits, the same bits under any layout, other columns left alone."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import forest as G
from causeway.operators import learners as L
from causeway.spec import CausalSpec

SPEC = CausalSpec("tc", "y_planted", ("x1", "x2"), id_col="id")


def _frame(spark, n=900, parts=3):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=n).round(2), rng.integers(0, 4, n)
    y = np.where(x > 0.3, 5.0, 1.0) + z + rng.normal(size=n) * 0.1
    rows = [(int(i), float(a), int(b), float(c), bool(a > 0)) for i, a, b, c in zip(range(n), x, z, y)]
    return spark.createDataFrame(rows, "id long, x double, z int, y double, side boolean").repartition(parts), x, z, y


def _brute(x, y, w, edges, depth):
    """Value of each leaf's rows in a tree grown by exhaustive search over the given edges."""
    total = lambda i: (w[i] * y[i]).sum() ** 2 / w[i].sum()
    out = np.empty(len(y))

    def split(i, d):
        best = (0.0, None)
        for f in range(x.shape[1]):
            for e in edges[f]:
                a, b = i[x[i, f] <= e], i[x[i, f] > e]
                if w[a].sum() > 0 and w[b].sum() > 0:
                    gain = total(a) + total(b) - total(i)
                    if gain > best[0] + 1e-9:
                        best = (gain, (a, b))
        if d and best[1] is not None:
            for part in best[1]:
                split(part, d - 1)
        else:
            out[i] = (w[i] * y[i]).sum() / w[i].sum()

    split(np.arange(len(y)), depth)
    return out


def test_trees_are_those_of_an_exhaustive_search(spark):
    df, x, z, y = _frame(spark, 300)
    settings = G.Forest(num_trees=3, max_depth=3, max_bins=16)
    model = G.grow(df, "id", ["x", "z"], [G.Target(F.col("y"))], settings)[0]
    edges = G._edges(df, ["x", "z"], 16)
    both = np.stack([x, z], axis=1).astype(float)
    ids = dict(df.select("id", F.xxhash64("id")).collect())
    drawn = G.bootstrap_counts(np.array([ids[i] for i in range(300)]), np.arange(3), settings.seed)
    assert 0.8 < drawn.mean() < 1.2
    leaves = model.leaves(both)
    for t in range(3):
        w = drawn[:, t].astype(float)
        used = np.flatnonzero(w)
        want = _brute(both[used], y[used], w[used], edges, 3)
        assert np.allclose(model.value[t, leaves[used, t]], want, atol=1e-7)
    assert np.allclose(model.predict(both), model.value[np.arange(3), leaves].mean(axis=1))
    assert abs(model.importances().sum() - 1) < 1e-12


def test_models_grow_together_as_alone(spark):
    df, *_ = _frame(spark)
    settings = G.Forest(num_trees=4, max_depth=4, max_bins=32, min_instances_per_node=3)
    targets = [G.Target(F.col("y"), F.col("side")), G.Target(F.col("y"), ~F.col("side"), F.col("x") * F.col("x")),
               G.Target((F.col("z") > 1).cast("int"), classifier=True), G.Target(F.col("y"), F.lit(False)), G.Target(F.lit(7.0))]
    together = G.grow(df, "id", ["x", "z"], targets, settings)
    for target, model in zip(targets, together):
        alone = G.grow(df.repartition(7), "id", ["x", "z"], [target], settings)[0]
        for a, b in ((model.feature, alone.feature), (model.edge, alone.edge), (model.value, alone.value)):
            assert np.array_equal(a, b, equal_nan=True)
    x = np.array([[0.5, 1.0], [-1.0, 3.0]])
    assert np.isnan(together[3].predict(x)).all() and (together[4].predict(x) == 7.0).all()
    assert ((together[2].predict(x) >= 0) & (together[2].predict(x) <= 1)).all()


@pytest.mark.parametrize("estimate", [
    lambda d: L.learner_estimate(d, SPEC, "s_learner", L.Forest(5, 4)), lambda d: L.learner_estimate(d, SPEC, "t_learner", L.Forest(5, 4)),
    lambda d: L.linear_dml(d, SPEC, L.Forest(5, 4))[0], lambda d: L.causal_forest(d, SPEC, L.Forest(5, 4), L.Forest(5, 4))[0]])
def test_estimates_don_t_depend_on_the_layout(oc_small, estimate):
    got = [estimate(oc_small.repartition(n, "y")).first()["value"] for n in (1, 3, 7, 8)]
    assert np.allclose(got, got[0], rtol=1e-9, atol=0) and abs(got[0] - 320) < 40


def test_other_columns_come_back_bit_for_bit(spark, oc_small):
    when = dt.datetime(2024, 2, 29, 1, 2, 3, 456789)
    more = oc_small.withColumns({"big": F.when(F.col("id") % 2 == 0, F.lit(9007199254740993)), "money": F.lit(Decimal("12345678901234567890.123456789")),
                                 "at": F.lit(when), "tags": F.array(F.lit("a"), F.lit(None)), "_leaf": F.lit("mine")})
    _, ite, *_ = L.causal_forest(more, SPEC, L.CellMean(("seg", "x1_band")), L.Forest(3, 3))
    assert ite.columns == [*more.columns, L.ITE] and ite.schema[:-1] == more.schema[:]
    assert ite.drop(L.ITE).exceptAll(more).count() == 0 and ite.count() == more.count()
    assert ite.where(F.col(L.ITE).isNull() | F.isnan(L.ITE)).count() == 0


def test_what_cannot_be_grown_is_refused(spark):
    df, *_ = _frame(spark, 60)
    with pytest.raises(ValueError, match="nodes"):
        G.grow(df, "id", ["x"], [G.Target(F.col("y"))], G.Forest(num_trees=10_000, max_depth=20))
    with pytest.raises(ValueError, match="feature"):
        G.grow(df.withColumn("x", F.when(F.col("id") > 3, F.col("x"))), "id", ["x"], [G.Target(F.col("y"))], G.Forest(2, 2))
    with pytest.raises(ValueError, match="labels"):
        G.grow(df, "id", ["x"], [G.Target(F.when(F.col("id") > 3, F.col("y")))], G.Forest(2, 2))
