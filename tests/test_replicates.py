"""Draw matrices of replicates: same bits as the column expressions, same estimates as exploded rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions.hashing import (SALT_BOOTSTRAP, SALT_COMMON_CAUSE_A, SALT_COMMON_CAUSE_B, poisson1_weight,
                                        standard_normal, uniform)
from causeway.operators import inference as U
from causeway.operators.replicates import Drawn, key_columns, replicate_sums, weighed
from causeway.spec import CausalSpec

SALTS = (SALT_BOOTSTRAP, SALT_COMMON_CAUSE_A, SALT_COMMON_CAUSE_B)


@pytest.mark.parametrize("rng", ["md5", "xxhash"])
def test_draws_are_the_bits_of_the_column_expressions(spark, rng):
    ids = spark.createDataFrame([(i,) for i in (None, 0, -5, 7, 10**12)] + [(i,) for i in range(50, 90)], "id long")
    rows = ids.select(*[k.alias(f"k{i}") for i, k in enumerate(key_columns("id", rng, SALTS))],
                      *[uniform("id", SALT_BOOTSTRAP, F.lit(r), rng).alias(f"u{r}") for r in range(3)],
                      *[standard_normal("id", F.lit(r), rng).alias(f"z{r}") for r in range(3)]).toArrow().combine_chunks()
    n = sum(c.startswith("k") for c in rows.column_names)
    drawn = Drawn([rows.column(i).combine_chunks() for i in range(n)], 3, rng, SALTS)
    want = {k: np.column_stack([rows[f"{k}{r}"].to_numpy() for r in range(3)]) for k in "uz"}
    assert (drawn.uniform(SALT_BOOTSTRAP) == want["u"]).all()
    assert np.allclose(drawn.normal(), want["z"], rtol=1e-13, atol=1e-15)


def test_counts_are_the_poisson_weights(spark):
    df = spark.range(200).withColumn("x", F.lit(2.0))
    got = {r["c1"]: list(r["w"]) for r in weighed(df, "id", [F.col("x"), F.col("id")], 4, SALT_BOOTSTRAP).collect()}
    want = df.select("id", *[poisson1_weight(uniform("id", SALT_BOOTSTRAP, r)).alias(f"w{r}") for r in range(4)]).collect()
    assert got == {float(r["id"]): [r[f"w{k}"] for k in range(4)] for r in want}


def test_sums_do_not_depend_on_slices_or_partitions(spark, monkeypatch):
    import causeway.operators.replicates as M
    df = spark.range(3000).withColumn("x", (F.col("id") % 17).cast("double"))

    def sums(x, draws):
        return draws.poisson(SALT_BOOTSTRAP).T.astype(float) @ x

    want = replicate_sums(df, "id", [F.col("x")], 20, 1, sums)
    monkeypatch.setattr(M, "CELLS", 700)
    assert (replicate_sums(df.repartition(7), "id", [F.col("x")], 20, 1, sums) == want).all()
    assert (replicate_sums(df.where("id < 0"), "id", [F.col("x")], 20, 1, sums) == 0).all()


def test_no_row_is_exploded_and_counts_are_drawn_once(spark):
    df = spark.range(2000).select("id", (F.col("id") % 2).alias("t"), (F.col("id") % 7).cast("double").alias("x"),
                                  ((F.col("id") * 7919) % 3 == 0).cast("int").alias("y"))
    spec = CausalSpec("t", "y", ("x",), id_col="id")
    boot = {r["rep"]: r["estimate"] for r in U.bootstrap_ols(df, spec, 12).collect()}
    ex = U.with_replicates(df, "id", 12).toPandas()
    for rep, d in ex.groupby("rep"):
        z = np.column_stack([np.ones(len(d)), d["t"], d["x"]])
        w = d["w"].to_numpy(float)
        beta = np.linalg.solve((z * w[:, None]).T @ z, (z * w[:, None]).T @ d["y"].to_numpy(float))
        assert abs(beta[1] - boot[rep]) < 1e-9
    logit = {r["rep"]: r["estimate"] for r in U.bootstrap_logit(df, spec, 5).collect()}
    for rep, d in ex[ex["rep"] < 5].groupby("rep"):
        z = np.column_stack([np.ones(len(d)), d["t"], d["x"]])
        w, y, beta = d["w"].to_numpy(float), d["y"].to_numpy(float), np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-z @ beta))
            beta = beta + np.linalg.solve((z * (w * mu * (1 - mu))[:, None]).T @ z, z.T @ (w * (y - mu)))
        assert abs(beta[1] - logit[rep]) < 1e-7


def test_cell_bootstraps_equal_refits_on_reweighted_rows(spark):
    from causeway.operators import cell_bootstrap as CB
    from causeway.operators import learners as L
    from causeway.operators import matching as M
    from causeway.operators import propensity as P
    rows = [(i, int(i * 7919 % 10 < 4), float(i % 5) if i % 11 else None, float(i * 31 % 97)) for i in range(160)]
    rows += [(500, 1, 77.0, 3.0), (501, 0, 78.0, 4.0)]  # cells of one arm
    df = spark.createDataFrame(rows, "id long, t int, c double, y double")
    spec, cells = CausalSpec("t", "y", ("c",), id_col="id"), ["c"]
    got = {"psm": CB.bootstrap_psm(df, spec, cells, 6), "iptw": CB.bootstrap_iptw(df.where("id < 500"), spec, cells, 6, "hajek"),
           "none": CB.bootstrap_iptw(df.where("id > 499"), spec, cells, 6), "clip": CB.bootstrap_iptw(df, spec, cells, 6, clip=(0.05, 0.95)),
           "cells": CB.bootstrap_cell_mean(df, spec, cells, 6)}
    fits = {"psm": (df, lambda x, w: M.psm_effects(x, spec, "stratified", cells, weight_col=w)["ate"]),
            "iptw": (df.where("id < 500"), lambda x, w: P.iptw_effect(x, spec, "stratified", cells, "hajek", weight_col=w)),
            "clip": (df, lambda x, w: P.iptw_effect(x, spec, "stratified", cells, "ht", (0.05, 0.95), weight_col=w)),
            "cells": (df, lambda x, w: L.ate_from_ite(L.t_learner(x, spec, L.CellMean(("c",)), w), w))}
    for name, (rows_, fit) in fits.items():
        want = {r["rep"]: r["estimate"] for r in U.generic_bootstrap(rows_, spec, fit, 6).collect()}
        have = {r["rep"]: r["estimate"] for r in got[name].collect()}
        assert set(have) == set(want)
        for rep, w in want.items():
            assert (have[rep] is None) == (w is None) and (w is None or abs(have[rep] - w) < 1e-9), (name, rep, have[rep], w)
    assert [r["estimate"] for r in got["none"].collect()] == [None] * 6
