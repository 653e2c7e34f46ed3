"""Pattern 1, the Gram job: the sufficient statistics of every linear model in one aggregate.

One distributed aggregate yields n, the column means and the centred cross-product matrix
C[a, b] = sum (a - mean a)(b - mean b) of the model columns. Spark's ``covar_pop`` keeps a
numerically stable running co-moment per partition and merges them (map-side partial aggregate),
so only p*(p+1)/2 numbers per partition are shuffled, whatever the row count. The driver holds
the p x p matrix and solves it.

The weighted, grouped variant (bootstrap replicates, simulations) centres by known means and sums
w, w*a, w*a*b per group; the correction term is then small, so it stays stable too.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions import stats


@dataclass
class Moments:
    cols: list[str]
    n: float
    mean: np.ndarray
    C: np.ndarray
    n_total: float | None = None

    def index(self, c: str) -> int:
        return self.cols.index(c)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def complete_case(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [_q(c).isNotNull() & ~F.isnan(_q(c)) for c in cols], F.lit(True))


WIDE_LIMIT = 20


def moments(df: DataFrame, cols: list[str] | dict[str, Column]) -> Moments:
    """Unweighted Gram job over complete rows; also returns the total row count.

    ``cols`` may map names to expressions (interaction terms are built here, never materialised).
    Above ``WIDE_LIMIT`` columns the cross-products come from ``moments_wide`` instead of
    p*(p+1)/2 aggregate expressions.
    """
    exprs = cols if isinstance(cols, dict) else {c: _q(c) for c in cols}
    names = list(exprs)
    if len(names) > WIDE_LIMIT:
        return moments_wide(df, exprs)
    proj = df.select(*[e.cast("double").alias(f"m{i}") for i, e in enumerate(exprs.values())])
    ok = complete_case([f"m{i}" for i in range(len(names))])
    v = [F.when(ok, F.col(f"m{i}")) for i in range(len(names))]
    aggs = [F.count(F.lit(1)).alias("n_total"), F.sum(ok.cast("long")).alias("n")]
    aggs += [F.avg(v[i]).alias(f"a{i}") for i in range(len(names))]
    aggs += [F.covar_pop(v[i], v[j]).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]
    row = proj.agg(*aggs).collect()[0]
    return _to_moments(names, row)


def moments_wide(df: DataFrame, exprs: dict[str, Column]) -> Moments:
    """Gram job for many columns: pass 1 gives counts and means (p aggregates); pass 2 is a
    ``mapInArrow`` that multiplies each Arrow batch of centred, complete rows into one p x p partial
    matrix per partition (numpy), emitted as (i, j, value) rows and summed by ``groupBy(i, j)``.
    Only p*(p+1)/2 numbers per partition shuffle."""
    import pyarrow as pa

    names = list(exprs)
    p = len(names)
    proj = df.select(*[e.cast("double").alias(f"m{i}") for i, e in enumerate(exprs.values())])
    ok = complete_case([f"m{i}" for i in range(p)])
    head = proj.agg(F.count(F.lit(1)).alias("n_total"), F.sum(ok.cast("long")).alias("n"),
                    *[F.avg(F.when(ok, F.col(f"m{i}"))).alias(f"a{i}") for i in range(p)]).collect()[0]
    n = float(head["n"] or 0)
    mean = np.array([head[f"a{i}"] if head[f"a{i}"] is not None else np.nan for i in range(p)], dtype=float)
    if n == 0:
        return Moments(names, 0.0, mean, np.full((p, p), np.nan), float(head["n_total"]))
    centred = proj.where(ok).select(*[(F.col(f"m{i}") - F.lit(float(mean[i]))).alias(f"m{i}") for i in range(p)])
    iu, ju = np.triu_indices(p)

    def block(batches):
        acc = np.zeros((p, p))
        for b in batches:
            if b.num_rows:
                X = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(p)])
                acc += X.T @ X
        yield pa.RecordBatch.from_arrays([pa.array(iu.astype(np.int32)), pa.array(ju.astype(np.int32)),
                                          pa.array(acc[iu, ju])], names=["i", "j", "v"])

    parts = centred.mapInArrow(block, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    C = np.zeros((p, p))
    for r in parts.collect():
        C[r["i"], r["j"]] = C[r["j"], r["i"]] = r["v"]
    return Moments(names, n, mean, C, float(head["n_total"]))


def _to_moments(names: list[str], row) -> Moments:
    p = len(names)
    n = float(row["n"] or 0)
    mean = np.array([row[f"a{i}"] if row[f"a{i}"] is not None else np.nan for i in range(p)], dtype=float)
    C = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            val = row[f"c{i}_{j}"]
            C[i, j] = C[j, i] = (val if val is not None else np.nan) * n
    return Moments(names, n, mean, C, float(row["n_total"]))


def weighted_moments_by(df: DataFrame, cols: dict[str, Column], weight: Column, group: str,
                        center: np.ndarray) -> dict[int, Moments]:
    """Weighted Gram job per group (bootstrap replicate, simulation); rows must be complete.

    ``center`` (the unweighted means) is subtracted before the products, so the sums are of
    small, centred numbers; one row per group reaches the driver.
    """
    names = list(cols)
    p = len(names)
    proj = df.select(F.col(group).alias("g"), weight.cast("double").alias("w"),
                     *[(e.cast("double") - F.lit(float(center[i]))).alias(f"m{i}")
                       for i, e in enumerate(cols.values())])
    aggs = [F.sum("w").alias("sw")]
    aggs += [F.sum(F.col("w") * F.col(f"m{i}")).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(F.col("w") * F.col(f"m{i}") * F.col(f"m{j}")).alias(f"s{i}_{j}")
             for i in range(p) for j in range(i, p)]
    out = {}
    for row in proj.groupBy("g").agg(*aggs).collect():
        sw = float(row["sw"] or 0.0)
        if sw <= 0:
            continue
        s = np.array([row[f"s{i}"] for i in range(p)], dtype=float)
        S = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                S[i, j] = S[j, i] = row[f"s{i}_{j}"]
        out[int(row["g"])] = centred_moments(names, center, sw, s, S)
    return out


def centred_moments(names: list[str], center: np.ndarray, sw: float, s: np.ndarray, S: np.ndarray) -> Moments | None:
    """Moments from the sum of weights and the weighted sums of centred columns and of their products; None without
    any weight."""
    return Moments(names, sw, center + s / sw, S - np.outer(s, s) / sw, sw) if sw > 0 else None


def with_drawn(base: Moments, name: str, s: float, ss: float, cross: np.ndarray) -> Moments:
    """``base`` with one more column d: its sum, its sum of squares, its sums of products with the centred columns."""
    p = len(base.cols)
    C = np.zeros((p + 1, p + 1))
    C[:p, :p] = base.C
    C[p, :p] = C[:p, p] = cross
    C[p, p] = ss - s * s / base.n
    return Moments([*base.cols, name], base.n, np.append(base.mean, s / base.n), C, base.n_total)


@dataclass
class OLSFit:
    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: float
    rank: int
    df_resid: float
    rss: float
    tss: float
    identified: dict[str, bool] = field(default_factory=dict)

    def index(self, term: str) -> int:
        return self.terms.index(term)

    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def table(self, alpha: float = 0.05) -> list[tuple]:
        """Rows of the ``coefficients`` contract, Student-t inference with df_resid."""
        se = self.se()
        q = stats.t_ppf(1 - alpha / 2, self.df_resid) if self.df_resid > 0 else float("nan")
        rows = []
        for k, term in enumerate(self.terms):
            b, s = float(self.coef[k]), float(se[k])
            t = b / s if s > 0 else float("nan")
            rows.append((term, b, s, t, stats.t_two_sided_p(t, self.df_resid), b - q * s, b + q * s))
        return rows

    def summary(self) -> list[tuple]:
        """Fit statistics of the linear model (Gaussian log-likelihood)."""
        n, k = self.n, self.rank + 1
        r2 = 1.0 - self.rss / self.tss if self.tss > 0 else float("nan")
        df_model = self.rank
        adj = 1.0 - (1.0 - r2) * (n - 1) / self.df_resid if self.df_resid > 0 else float("nan")
        f = (r2 / df_model) / ((1 - r2) / self.df_resid) if df_model > 0 and self.df_resid > 0 and r2 < 1 else float("nan")
        ll = -n / 2.0 * (math.log(2 * math.pi) + math.log(self.rss / n) + 1.0) if self.rss > 0 else float("nan")
        return [("n", n), ("r2", r2), ("adj_r2", adj), ("f_stat", f),
                ("f_p_value", stats.f_sf(f, df_model, self.df_resid) if not math.isnan(f) else float("nan")),
                ("log_likelihood", ll), ("aic", -2 * ll + 2 * k), ("bic", -2 * ll + k * math.log(n)),
                ("df_resid", float(self.df_resid)), ("rank", float(k))]


def solve_ols(m: Moments, y: str, xs: list[str], rel_tol: float = 1e-10) -> OLSFit:
    """OLS of y on [1, xs] from the centred Gram matrix; pseudo-inverse with a rank check.

    Slopes come from the centred block; the intercept and its variance follow exactly from the
    means, so no uncentred (ill-conditioned) matrix is ever formed.
    """
    ix = [m.index(c) for c in xs]
    iy = m.index(y)
    n = m.n
    Cxx = m.C[np.ix_(ix, ix)]
    Cxy = m.C[ix, iy]
    Cyy = m.C[iy, iy]
    p = len(ix)
    d = np.sqrt(np.clip(np.diag(Cxx), 0, None)) if p else np.zeros(0)
    d_safe = np.where(d > 0, d, 1.0)
    identified = {}
    if p:
        S = Cxx / np.outer(d_safe, d_safe)
        U, sv, Vt = np.linalg.svd(S)
        tol = rel_tol * (sv.max() if sv.size else 0.0)
        keep = sv > tol
        rank = int(keep.sum())
        Sinv = (Vt[keep].T / sv[keep]) @ U[:, keep].T
        beta = (Sinv @ (Cxy / d_safe)) / d_safe
        inv = Sinv / np.outer(d_safe, d_safe)
        # a coefficient is identified when its column is not in the span of the others
        null_space = Vt[~keep]
        for k, c in enumerate(xs):
            identified[c] = bool(d[k] > 0 and (null_space.size == 0 or np.abs(null_space[:, k]).max() < 1e-6))
    else:
        rank, beta, inv = 0, np.zeros(0), np.zeros((0, 0))
    rss = float(Cyy - 2 * beta @ Cxy + beta @ Cxx @ beta) if p else float(Cyy)
    rss = max(rss, 0.0)
    df_resid = n - rank - 1
    sigma2 = rss / df_resid if df_resid > 0 else float("nan")
    mx = m.mean[ix]
    cov_s = sigma2 * inv
    b0 = float(m.mean[iy] - beta @ mx) if p else float(m.mean[iy])
    var0 = sigma2 / n + (mx @ cov_s @ mx if p else 0.0)
    cov_0s = -(cov_s @ mx) if p else np.zeros(0)
    cov = np.zeros((p + 1, p + 1))
    cov[0, 0] = var0
    cov[0, 1:] = cov[1:, 0] = cov_0s
    cov[1:, 1:] = cov_s
    return OLSFit(["const", *xs], np.concatenate([[b0], beta]), cov, n, rank, df_resid, rss, float(Cyy), identified)
