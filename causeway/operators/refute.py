"""Refutation tests.

R1 adds an independent N(0, 1) common cause; R2 replaces the treatment with a random placebo: a draw of the same
shares for a treatment of few values, a permutation of the column for any other. For the moment estimators every simulation runs in ONE job (a
matrix of draws for each Arrow batch times the model columns); other estimators refit per simulation.
Random draws are hashes of (id, simulation), so a rerun gives the same answer.

p-value (ours; the library's is not visible): the simulated estimates are fitted by a normal
distribution and the two-sided tail probability of the reference value is reported: the
original estimate for R1 (the effect should not move), 0 for R2 (a placebo should do nothing).
Passed = p > 0.05.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway import spec as S
from causeway.functions import stats
from causeway.functions.hashing import (SALT_COMMON_CAUSE_A, SALT_COMMON_CAUSE_B, SALT_PLACEBO, draw_key, standard_normal,
                                         uniform)
from causeway.functions.ranks import ranked
from causeway.operators import regression as R
from causeway.operators.complete import absent
from causeway.operators.moments import Moments, moments, solve_ols, with_drawn
from causeway.operators.permutation import permuted_products
from causeway.operators.replicates import replicate_sums
from causeway.spec import CausalSpec

MOMENT_METHODS = ("ols", "diff_in_means")
W_COL = "_w_random"
PLACEBO = "_t_placebo"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def guard(method: str, binary_outcome: bool = False) -> None:
    """Not for DiD, nor for a logit."""
    if method in ("did", "did_logit", "logit") or binary_outcome and method == "logit":
        raise ValueError(f"refutation is not supported for {method!r}")


def random_common_cause_sims(df: DataFrame, spec: CausalSpec, n_sims: int = 100, rng: str = "md5") -> DataFrame:
    """R1 simulations: (sim, estimate) of the OLS effect with one extra N(0,1) confounder."""
    base, got = _drawn_sums(df, spec, R.model_columns(spec), n_sims, rng, causes=True)
    xs = [c for c in base.cols if c != spec.outcome]
    rows = [(s, _effect(_one(base, W_COL, got[s]), spec.outcome, [*xs, W_COL], spec.treatment)) for s in range(n_sims)]
    return df.sparkSession.createDataFrame(rows, "sim int, estimate double")


def _drawn_sums(df: DataFrame, spec: CausalSpec, cols: dict[str, Column], n_sims: int, rng: str, causes: bool = False,
                levels: list[tuple[float, float]] | None = None) -> tuple[Moments, np.ndarray]:
    """The model columns' moments, shared by all simulations, and for each simulation the sums of what is drawn: itself,
    its squares, its products with the centred columns. First the random cause, then the placebo of ``levels`` (value,
    cumulative share)."""
    base = moments(df, cols)
    mean = base.mean
    values, ends = (np.array(v, float) for v in zip(*levels, strict=True)) if levels else (None, None)

    def sums(x, draws):
        ok = ~np.isnan(x).any(axis=1)
        drawn = [draws.normal()] if causes else []
        if levels:
            drawn.append(values[np.searchsorted(ends[:-1], draws.uniform(SALT_PLACEBO), "right")])
        m = x[ok] - mean
        return np.column_stack([np.column_stack([d.sum(axis=0), (d * d).sum(axis=0), d.T @ m]) for d in (d[ok] for d in drawn)])

    width = (causes + bool(levels)) * (2 + len(mean))
    return base, replicate_sums(df, spec.id_col, list(cols.values()), n_sims, width, sums, rng,
                                (SALT_COMMON_CAUSE_A, SALT_COMMON_CAUSE_B, SALT_PLACEBO))


def _one(base: Moments, name: str, sums: np.ndarray, nth: int = 0) -> Moments:
    part = sums[nth * (2 + len(base.cols)):(nth + 1) * (2 + len(base.cols))]
    return with_drawn(base, name, part[0], part[1], part[2:])


def _effect(m: Moments | None, outcome: str, model: list[str], term: str) -> float | None:
    fit = solve_ols(m, outcome, model) if m and m.n else None
    return float(fit.coef[fit.index(term)]) if fit and fit.identified.get(term) else None


def placebo_share(df: DataFrame, spec: CausalSpec) -> float:
    r = df.agg(F.sum(_q(spec.treatment)).alias("n1"), F.count(F.lit(1)).alias("n")).collect()[0]
    return float(r["n1"]) / float(r["n"])


#: A treatment of at most so many values is drawn by their shares; any other is permuted.
MAX_PLACEBO_LEVELS = 1000


def treatment_levels(df: DataFrame, spec: CausalSpec) -> list[tuple[float, int]] | None:
    """(value, count) of the treatment, sorted; None above MAX_PLACEBO_LEVELS (one aggregate)."""
    rows = (df.where(~absent(df, spec.treatment)).groupBy(_q(spec.treatment).alias("v"))
              .agg(F.count(F.lit(1)).alias("n")).limit(MAX_PLACEBO_LEVELS + 1).collect())
    return sorted((r["v"], r["n"]) for r in rows) if len(rows) <= MAX_PLACEBO_LEVELS else None


def _many(df: DataFrame, spec: CausalSpec) -> None:
    """Levels of a treatment that is known to have too many."""


def permuted(df: DataFrame, spec: CausalSpec, sims: range, keep: tuple[str, ...] = (), rng: str = "md5",
             values: DataFrame | None = None) -> DataFrame:
    """(sim, PLACEBO, ``keep``): for each simulation the treatment column permuted over the rows that have one.

    The rows are put in the order of their draws (ties by id) and the treatment's values in falling order, each by one
    distributed sort; the p-th row gets the p-th value. No group, no window and no cut: each simulation is an exact
    permutation, whatever the column's values and however many they are. A 0/1 treatment puts exactly n1 rows, those
    with the smallest draws, under treatment."""
    if spec.id_col is None:
        raise ValueError("a permutation needs an id column")
    d = df.where(~absent(df, spec.treatment) & _q(spec.id_col).isNotNull())
    if values is None:
        values = treatment_values(df, spec)
    n = values.count()
    draws = d.select(_q(spec.id_col).alias("_id"), *[_q(c) for c in keep],
                     F.explode(F.sequence(F.lit(sims.start), F.lit(sims.stop - 1))).alias("sim"))
    draws = draws.withColumn("_key", draw_key("_id", SALT_PLACEBO, F.col("sim"), rng))
    placed = ranked(draws, [F.asc("sim"), F.asc("_key"), F.asc("_id")], "_place")
    placed = placed.withColumn("_place", F.col("_place") - (F.col("sim") - sims.start) * F.lit(n))
    return placed.join(values, "_place").select("sim", PLACEBO, *[_q(c) for c in keep])


def treatment_values(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """(_place, PLACEBO): the treatment's values in falling order, places from 1."""
    d = df.where(~absent(df, spec.treatment) & _q(spec.id_col).isNotNull())
    d = d.select(_q(spec.treatment).cast("double").alias(PLACEBO), _q(spec.id_col).alias("_id"))
    return ranked(d, [F.desc(PLACEBO), F.asc("_id")], "_place").drop("_id")


def permutation_sims(df: DataFrame, spec: CausalSpec, n_sims: int = 100, rng: str = "md5",
                     levels_of: Callable[[DataFrame, CausalSpec], list[tuple[float, int]] | None] = treatment_levels) -> DataFrame:
    """R2 simulations by permutation: (sim, estimate) of the OLS effect of the permuted treatment. Its own moments and
    those of the other columns are the same in all simulations; only their products are summed anew
    (``permuted_products``)."""
    if spec.id_col is None:
        raise ValueError("a permutation needs an id column")
    xs = list(spec.confounders)
    model = [spec.treatment, *xs, spec.outcome]
    d = df.where(_q(spec.id_col).isNotNull())
    for c in model:
        d = d.where(~absent(df, c))
    base = moments(d, model)
    levels = levels_of(d, spec)
    values = treatment_values(d, spec).select("_place", PLACEBO) if levels is None else None
    others = [_q(c).cast("double") - F.lit(float(m)) for c, m in zip(model[1:], base.mean[1:])]
    got = permuted_products(d, spec.id_col, others, float(base.mean[0]), int(base.n), n_sims, rng, levels, values)
    rows = [(s, _effect(_with_products(base, got[s]), spec.outcome, model[:-1], spec.treatment)) for s in range(n_sims)]
    return df.sparkSession.createDataFrame(rows, "sim int, estimate double")


def _with_products(base: Moments, products: np.ndarray) -> Moments:
    """``base`` with other products of its first column with the others."""
    C = base.C.copy()
    C[0, 1:] = C[1:, 0] = products
    return Moments(base.cols, base.n, base.mean, C, base.n_total)


def multilevel_placebo(levels: list[tuple[float, int]], u: Column) -> Column:
    """Level j when C(j-1)/n <= u < C(j)/n (C = cumulative counts): each level keeps its share."""
    n = sum(c for _, c in levels)
    expr, acc = None, 0
    for v, c in levels[:-1]:
        acc += c
        cond = u < F.lit(acc / n)
        expr = F.when(cond, F.lit(v)) if expr is None else expr.when(cond, F.lit(v))
    last = F.lit(levels[-1][0])
    return last if expr is None else expr.otherwise(last)


def cumulative_shares(levels: list[tuple[float, int]]) -> list[tuple[float, float]]:
    """(value, C / n) with C the cumulative counts: a uniform draw at C(j-1) / n or above and below C(j) / n is level j,
    so each level keeps its share. Of 0 and 1, 1 comes first: treated with a draw below n1 / n."""
    ordered = levels[::-1] if [v for v, _ in levels] == [0, 1] else levels
    total = sum(c for _, c in ordered)
    out, acc = [], 0
    for v, c in ordered:
        acc += c
        out.append((float(v), acc / total))
    return out


def placebo_sims(df: DataFrame, spec: CausalSpec, n_sims: int = 100, exact: bool = False, rng: str = "md5") -> DataFrame:
    """R2 simulations: (sim, estimate) with the treatment replaced by a random placebo.

    Default: treated with probability n1/n per row (the share of a permutation in expectation).
    A treatment with more than two values: each value is drawn with its share (``multilevel_placebo``).
    ``exact=True``, and any treatment with more values than MAX_PLACEBO_LEVELS: permutations (``permutation_sims``).
    """
    levels = None if exact else treatment_levels(df, spec)
    if levels is None:
        return permutation_sims(df, spec, n_sims, rng, treatment_levels if exact else _many)
    cols = {c: _q(c) for c in [*spec.confounders, spec.outcome]}
    base, got = _drawn_sums(df, spec, cols, n_sims, rng, levels=cumulative_shares(levels))
    rows = [(s, _effect(_one(base, PLACEBO, got[s]), spec.outcome, [PLACEBO, *spec.confounders], PLACEBO))
            for s in range(n_sims)]
    return df.sparkSession.createDataFrame(rows, "sim int, estimate double")


def joint_sims(df: DataFrame, spec: CausalSpec, n_sims: int = 100, rng: str = "md5") -> tuple[DataFrame, DataFrame]:
    """R1 and R2 from ONE pass: both draws of a row (the N(0,1) common cause and the placebo) are multiplied with the
    model columns, whose own moments all simulations share. Same draws, same estimates as
    ``random_common_cause_sims`` and ``placebo_sims``, half the passes."""
    levels = treatment_levels(df, spec)
    if levels is None:
        return random_common_cause_sims(df, spec, n_sims, rng), permutation_sims(df, spec, n_sims, rng, _many)
    base, got = _drawn_sums(df, spec, R.model_columns(spec), n_sims, rng, causes=True, levels=cumulative_shares(levels))
    xs = list(spec.confounders)
    r1 = [(s, _effect(_one(base, W_COL, got[s]), spec.outcome, [spec.treatment, *xs, W_COL], spec.treatment))
          for s in range(n_sims)]
    r2 = [(s, _effect(_one(base, PLACEBO, got[s], 1), spec.outcome, [PLACEBO, *xs], PLACEBO)) for s in range(n_sims)]
    sp = df.sparkSession
    return sp.createDataFrame(r1, "sim int, estimate double"), sp.createDataFrame(r2, "sim int, estimate double")


def p_value(sims: list[float], centre: float) -> float:
    """Two-sided tail probability of ``centre`` under a normal fitted to the simulations."""
    v = np.array([s for s in sims if s is not None and math.isfinite(s)])
    if v.size < 2:
        return float("nan")
    mu, sd = float(v.mean()), float(v.std(ddof=1))
    if sd == 0:
        return 1.0 if centre == mu else 0.0
    return stats.norm_two_sided_p((centre - mu) / sd)


def _result(spark, test: str, original: float, sims: DataFrame, centre: float, alpha: float = 0.05) -> DataFrame:
    vals = [r["estimate"] for r in sims.collect()]
    ok = [v for v in vals if v is not None]
    new = float(np.mean(ok)) if ok else float("nan")
    p = p_value(vals, centre)
    return spark.createDataFrame([(test, original, new, p, bool(p > alpha) if not math.isnan(p) else None)], S.REFUTATION)


def refute(df: DataFrame, spec: CausalSpec, method: str = "ols", n_sims: int | None = None,
           exact_placebo: bool = False, estimator=None, rng: str = "md5") -> DataFrame:
    """R1 + R2 + R3 for an estimate; R4 guards the methods it does not apply to.

    ``estimator(df, spec) -> float`` refits any other method once per simulation. Simulations default
    to 100 for the moment methods (all in one job) and 10 for refits.
    """
    guard(method)
    spark = df.sparkSession
    if n_sims is None:
        n_sims = 100 if method in MOMENT_METHODS else 10
    if method in MOMENT_METHODS:
        sp = spec.with_(confounders=()) if method == "diff_in_means" else spec
        fit = R.ols_fit(df, sp)
        original = float(fit.coef[fit.index(sp.treatment)])
        if exact_placebo:
            r1 = random_common_cause_sims(df, sp, n_sims, rng)
            r2 = placebo_sims(df, sp, n_sims, True, rng)
        else:
            r1, r2 = joint_sims(df, sp, n_sims, rng)
    else:
        if estimator is None:
            raise ValueError("pass estimator= for a method without a moment form")
        original = float(estimator(df, spec))
        rows1, rows2 = [], []
        levels = treatment_levels(df, spec)
        for s in range(n_sims):
            d1 = df.withColumn(W_COL, standard_normal(spec.id_col, s, rng))
            rows1.append((s, float(estimator(d1, spec.with_(confounders=(*spec.confounders, W_COL))))))
            u = uniform(spec.id_col, SALT_PLACEBO, s, rng)
            if exact_placebo or levels is None:
                others = tuple(c for c in df.columns if c != spec.treatment)
                d2 = permuted(df, spec, range(s, s + 1), others, rng).withColumnRenamed(PLACEBO, spec.treatment).drop("sim")
            elif [v for v, _ in levels] in ([0, 1], [0.0, 1.0]):
                d2 = df.withColumn(spec.treatment, (u < F.lit(levels[1][1] / (levels[0][1] + levels[1][1]))).cast("int"))
            else:
                d2 = df.withColumn(spec.treatment, multilevel_placebo(levels, u))
            rows2.append((s, float(estimator(d2, spec))))
        r1 = spark.createDataFrame(rows1, "sim int, estimate double")
        r2 = spark.createDataFrame(rows2, "sim int, estimate double")
    return _result(spark, "random_common_cause", original, r1, original).unionByName(
        _result(spark, "placebo_treatment", original, r2, 0.0))
