"""Quantiles of many columns and groups at once, exact permutations, one meaning of missing."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import quantiles as Q
from causeway.operators import eda as E
from causeway.operators import prep as C
from causeway.operators import refute as RF
from causeway.operators import regression as R
from causeway.spec import CausalSpec


def _aggregates(monkeypatch):
    """Counts the aggregates over the rows: each makes one state of brackets."""
    made = []
    state = Q._State

    def counted(table):
        made.append(1)
        return state(table)

    monkeypatch.setattr(Q, "_State", counted)
    return made


def _wild(n=3000):
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(size=n // 3), rng.lognormal(0, 200, n // 3).clip(0, 1e300), -rng.lognormal(0, 100, n // 3),
                        [0.0, -0.0, 1e308, -1e308, 5e-324, math.inf, -math.inf] * 3, np.full(500, 7.25)])
    return rng.permutation(v)


@pytest.mark.parametrize("limit", [0, 50, 20_000])
def test_quantiles_of_any_distribution(spark, limit, monkeypatch):
    made = _aggregates(monkeypatch)
    v = _wild()
    rows = [(i % 5, float(x)) for i, x in enumerate(v)] + [(0, None), (1, float("nan")), (9, None), (9, float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double")
    qs = [0.0, 0.013, 0.25, 0.5, 0.77, 1.0]
    out = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in Q.quantiles_by(df, ["g"], "v", qs, [f"q{i}" for i in range(6)], limit).collect()}
    assert len(made) <= 6
    assert set(out) == {0, 1, 2, 3, 4, 9, None} and out[9] == [None] * 6 and out[None] == [3.0] * 6
    for g in range(5):
        own = np.sort(v[g::5])
        for q, got in zip(qs, out[g]):
            h = (len(own) - 1) * q
            lo, hi = own[math.floor(h)], own[min(math.floor(h) + 1, len(own) - 1)]
            want = lo if lo == hi else lo + (hi - lo) * (h - math.floor(h))
            assert got == want or (math.isnan(got) and math.isnan(want)), (g, q)


def test_few_aggregates_for_many_columns_and_hot_groups(spark, monkeypatch):
    made = _aggregates(monkeypatch)
    df = spark.range(60_000).select(
        (F.col("id") % 5).alias("g"), *[(F.xxhash64("id", F.lit(k)) / 1e12).alias(f"c{k}") for k in range(4)]).persist()
    df.count()
    got = E.exact_quantiles(df, [f"c{k}" for k in range(4)], [0.25, 0.5, 0.75], 100)
    assert len(made) <= 3
    p = df.toPandas()
    for k in range(4):
        assert np.allclose(got[f"c{k}"], p[f"c{k}"].quantile([0.25, 0.5, 0.75]), rtol=1e-12)
    made.clear()
    by = {r["g"]: r["m"] for r in E.grouped_quantiles(df, ["g"], "c0", [0.5], ["m"], 100).collect()}
    assert len(made) <= 3
    assert np.allclose([by[g] for g in range(5)], p.groupby("g").c0.median(), rtol=1e-12)


def test_more_brackets_than_may_be_broadcast(spark, monkeypatch):
    monkeypatch.setattr(Q, "BRACKETS", 3)
    df = spark.range(2000).select((F.col("id") % 7).alias("g"), (F.col("id") * 37 % 1999).cast("double").alias("v"))
    got = {r["g"]: (r["a"], r["b"]) for r in Q.quantiles_by(df, ["g"], "v", [0.1, 0.5], ["a", "b"], 10).collect()}
    p = df.toPandas()
    for g, own in p.groupby("g"):
        assert np.allclose(got[g], own.v.quantile([0.1, 0.5]))


def test_permutations_are_exact(spark, oc_small):
    spec = CausalSpec("y", "y_planted", ("x2",), id_col="id")
    want = sorted(r["y"] for r in oc_small.select("y").collect())
    out = RF.permuted(oc_small, spec, range(2, 4), ("id",)).collect()
    by = {s: {r["id"]: r[RF.PLACEBO] for r in out if r["sim"] == s} for s in (2, 3)}
    assert all(sorted(by[s].values()) == want for s in (2, 3)) and by[2] != by[3]
    again = RF.permuted(oc_small.repartition(3), spec, range(3, 4), ("id",)).collect()
    assert {r["id"]: r[RF.PLACEBO] for r in again} == by[3]
    binary = CausalSpec("tc", "y_planted", (), id_col="id")
    n1 = oc_small.agg(F.sum("tc")).first()[0]
    treated = RF.permuted(oc_small, binary, range(5)).groupBy("sim").agg(F.sum(RF.PLACEBO).alias("n")).collect()
    assert [r["n"] for r in treated] == [n1] * 5


def test_placebo_on_either_side_of_the_level_limit(spark, monkeypatch):
    rows = [(i, float(i % 40), 3.0 * (i % 40) + (i * 7 % 11)) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, t double, y double")
    spec = CausalSpec("t", "y", (), id_col="id")
    for limit in (1000, 40, 39, 5):
        monkeypatch.setattr(RF, "MAX_PLACEBO_LEVELS", limit)
        est = [r["estimate"] for r in RF.placebo_sims(df, spec, 30).collect()]
        assert len(est) == 30 and abs(np.mean(est)) < 0.2 and 0 < np.std(est) < 0.3
    r = {x["test"]: x for x in RF.refute(df, spec, "ols", 20).collect()}
    assert abs(r["placebo_treatment"]["new_effect"]) < 0.2 and r["placebo_treatment"]["passed"]


def test_nan_is_missing_everywhere(spark):
    rows = [(float(i), 2.0 * i + i % 3, float(i % 2)) for i in range(40)]
    holes = [(float("nan"), 1.0, 1.0), (3.0, float("nan"), 0.0), (None, 5.0, 1.0)]
    schema = "x double, y double, t double"
    clean, holed = spark.createDataFrame(rows, schema), spark.createDataFrame(rows + holes, schema)
    only_x = spark.createDataFrame(rows + holes[1:2], schema)
    assert E.describe(holed, ["x"]).collect() == E.describe(only_x, ["x"]).collect()
    assert {r["column"]: r["missing"] for r in E.missing_summary(holed).collect()} == {"x": 2, "y": 1, "t": 0}
    a, b = (sorted(map(tuple, E.correlation_matrix(d, ["x", "y"]).collect())) for d in (clean, holed))
    assert a == b
    spec = CausalSpec("t", "y", ("x",))
    with pytest.raises(ValueError):
        R.ols_fit(holed, spec)
    assert np.allclose(R.ols_fit(clean, spec).coef, R.ols_fit(holed.na.drop(), spec).coef)
    filled = C.impute_numeric(holed, "mean", cols=["x", "y"])
    assert filled.where("isnan(x) OR isnan(y) OR x IS NULL").count() == 0
    assert math.isclose(filled.agg(F.avg("x")).first()[0], only_x.agg(F.avg("x")).first()[0])
    assert C.winsorize(holed, ["x"]).where("isnan(x)").count() == 0
    assert sum(r["n"] for r in E.histogram(holed, "x", 5).collect()) == 41
    med = {r["t"]: r["median_x"] for r in E.grouped_agg(holed, ["t"], "x", "median").collect()}
    assert med == {0.0: 18.0, 1.0: 20.0}
