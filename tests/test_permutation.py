"""Permutation simulations: exact, in ranges, with little on disk."""

import os
from hashlib import md5

import numpy as np
import pytest

from causeway.operators import permutation as P
from causeway.operators import refute as RF
from causeway.spec import CausalSpec

SPEC = CausalSpec("t", "y", ("x",), id_col="id")


def _rows(n, kind):
    rng = np.random.default_rng(7)
    t = {"two": rng.random(n) < 0.3, "levels": rng.integers(0, 5, n), "many": rng.normal(size=n).round(6)}[kind].astype(float)
    x = rng.normal(size=n)
    return t, x, 2 * t + x + rng.normal(size=n)


def _brute(ids, t, x, y, sim):
    order = sorted(range(len(ids)), key=lambda i: (md5(f"{ids[i]}-p-{sim}".encode()).hexdigest(), ids[i]))
    p = np.empty(len(ids))
    p[order] = np.sort(t)[::-1]
    z = np.column_stack([np.ones(len(ids)), p, x])
    return np.linalg.lstsq(z, y, rcond=None)[0][1]


@pytest.mark.parametrize("kind", ["two", "levels", "many"])
@pytest.mark.parametrize("at_once", [2, 5])
def test_estimates_are_those_of_whole_permutations(spark, monkeypatch, kind, at_once):
    monkeypatch.setattr(P, "RANGE_ROWS", 40)
    monkeypatch.setattr(P, "AT_ONCE", at_once)
    monkeypatch.setattr(RF, "MAX_PLACEBO_LEVELS", 10)
    n = 700
    t, x, y = _rows(n, kind)
    rows = [(int(i), float(a), float(b), float(c)) for i, a, b, c in zip(range(n), t, x, y)]
    gone = [(None, 1.0, 0.5, 3.0), (901, None, 0.5, 3.0), (902, 1.0, float("nan"), 3.0), (903, 1.0, 0.5, None)]
    df = spark.createDataFrame(rows + gone, "id long, t double, x double, y double").repartition(5)
    got = {r["sim"]: r["estimate"] for r in RF.permutation_sims(df, SPEC, 7).collect()}
    assert sorted(got) == list(range(7))
    for sim, e in got.items():
        assert abs(e - _brute(range(n), t, x, y, sim)) < 1e-9
    assert [r["estimate"] for r in RF.permutation_sims(df.where("id < 0"), SPEC, 2).collect()] == [None, None]


def test_repeated_ids_take_places_in_any_layout(spark):
    t, x, y = _rows(300, "many")
    df = spark.createDataFrame([(i // 3, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, y))],
                               "id long, t double, x double, y double")
    one, other = ([r["estimate"] for r in RF.permutation_sims(df.repartition(k), SPEC, 3).collect()] for k in (2, 9))
    assert np.allclose(one, other, rtol=1e-9)


@pytest.mark.parametrize("kind", ["two", "many"])
def test_simulations_store_no_copies_of_the_table(spark, monkeypatch, kind):
    monkeypatch.setattr(RF, "MAX_PLACEBO_LEVELS", 10)
    n, sims = 5000, 60
    t, x, y = _rows(n, kind)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(t, x, y))],
                               "id long, t double, x double, y double").repartition(4)

    def stored():
        folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)

    from causeway.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    before = stored()
    RF.permutation_sims(df, SPEC, sims).collect()
    assert stored() - before < n * sims * 8
