"""Trees grown from counts by combination of bins are those grown level by level; predictions looked up are those walked."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.operators import forest as G
from causeway.operators import learners as L
from causeway.spec import CausalSpec


def _frame(spark, n=1500):
    rng = np.random.default_rng(5)
    x, z = rng.normal(size=n).round(2), rng.integers(0, 4, n)
    y = np.where(x > 0.3, 5.0, 1.0) + z + rng.normal(size=n) * 0.1
    rows = [(int(i), float(a), int(b), float(c), bool(a > 0), int(i * 7919 % 10 < 4)) for i, a, b, c in zip(range(n), x, z, y)]
    return spark.createDataFrame(rows, "id long, x double, z int, y double, side boolean, t int").repartition(4)


def test_trees_are_those_grown_level_by_level(spark, monkeypatch):
    df = _frame(spark)
    settings = G.Forest(num_trees=5, max_depth=6, max_bins=20, min_instances_per_node=2)
    targets = [G.Target(F.col("y"), F.col("side")), G.Target(F.col("y") * 1e6, ~F.col("side"), F.col("x") * F.col("x")),
               G.Target((F.col("z") > 1).cast("int"), classifier=True), G.Target(F.col("y"), F.lit(False)), G.Target(F.lit(7.0))]
    jobs = []
    count = G._count_level
    monkeypatch.setattr(G, "_count_level", lambda *a: jobs.append(1) or count(*a))
    monkeypatch.setattr(G, "BLOCK", 300)
    cells = G.grow(df, "id", ["x", "z"], targets, settings)
    assert not jobs  # one pass over the rows, not one a level
    monkeypatch.setattr(G, "JOINT", 0)
    levels = G.grow(df, "id", ["x", "z"], targets, settings)
    assert len(jobs) > 3
    for a, b in zip(cells, levels):
        for name in ("feature", "edge", "value", "gain"):
            assert np.array_equal(getattr(a, name), getattr(b, name), equal_nan=True), name


def test_draws_are_poisson_counts_by_search():
    ids = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63 - 1, 20000)
    with np.errstate(over="ignore"):
        salt = G._mix((np.arange(7).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(42))
        draw = (G._mix(ids.view(np.uint64)[:, None] ^ salt[None, :]) >> np.uint64(11)).view(np.int64)
    assert (G.bootstrap_counts(ids, np.arange(7), 42) == np.searchsorted(G._POISSON, draw, side="right")).all()
    some = np.concatenate([G._POISSON, G._POISSON - 1, [0, 2 ** 53 - 1]])
    top = some >> G._SHIFT
    got = G._BELOW[top] + (some >= G._NEXT[top])
    assert (got == np.searchsorted(G._POISSON, some, side="right"))[~G._SEVERAL[top]].all()


def test_predictions_looked_up_are_those_walked(spark):
    model = G.grow(_frame(spark), "id", ["x", "z"], [G.Target(F.col("y"))], G.Forest(6, 5, max_bins=16))[0]
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=5000) * 2, rng.integers(-1, 6, 5000)]).astype(float)
    edges = np.unique(model.edge[model.feature == 0])
    x[:len(edges), 0] = edges
    x[100:110, 0], x[105:115, 1] = np.nan, np.inf
    look = G.Lookup(model, model.predict)
    assert look.cells is not None and (look.predict(x) == model.predict(x)).all()


@pytest.mark.parametrize("estimate", [
    lambda d, s: L.learner_estimate(d, s, "s_learner", L.Forest(5, 5)), lambda d, s: L.learner_estimate(d, s, "t_learner", L.Forest(5, 5)),
    lambda d, s: L.linear_dml(d, s, L.Forest(5, 5))[0], lambda d, s: L.causal_forest(d, s, L.Forest(5, 5), L.Forest(5, 5))[0]])
def test_estimates_are_those_of_the_general_way(spark, monkeypatch, estimate):
    df, spec = _frame(spark, 600), CausalSpec("t", "y", ("x", "z"), id_col="id")
    few = estimate(df, spec).first()["value"]
    monkeypatch.setattr(G, "JOINT", 0)
    for module in (G, L):
        monkeypatch.setattr(module, "LOOKED_UP", 0)
    assert abs(few - estimate(df, spec).first()["value"]) < 1e-9


def test_upper_bits_of_a_draw_give_its_count_or_call_for_the_rest():
    draw = np.concatenate([G._POISSON, G._POISSON - 1, [0, 2 ** 53 - 1], np.random.default_rng(3).integers(0, 2 ** 53, 20000)])
    draw = draw[draw < 2 ** 53]
    want, got = np.searchsorted(G._POISSON, draw, side="right"), G._COUNT[draw >> 37]
    sure = got != G._UNSURE
    assert (got[sure] == want[sure]).all() and (G._counts(draw) == want).all()
    assert (~sure).any() and (G._COUNT == G._UNSURE).sum() <= len(G._POISSON)


def test_labels_are_rounded_as_round_does_without_decimals(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([[0.0, -0.0, 0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, 2.0 ** 33 - 0.5, 2.0 ** 52 + 1, 3.0e18],
                        rng.normal(size=2000) * 2.0 ** rng.integers(-3, 60, 2000), rng.integers(-10 ** 6, 10 ** 6, 500) / 2])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    got = df.select(G._whole(F.col("x")).alias("got"), F.round("x").cast("long").alias("want"))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).count() == 0
    rows, _ = G._table(df.where("abs(x) < 1000"), None, ["x"], [G.Target(F.col("x"))], [np.array([0.0])], True)
    assert "round(" not in rows._jdf.queryExecution().optimizedPlan().toString()
