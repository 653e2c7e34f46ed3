"""E12-E18, F16 helpers: meta-learners, double machine learning and the causal forest.

Nuisance learners:
* ``CellMean``: the mean of the target per discrete confounder cell (a grouped aggregate joined
  back; unseen cells fall back to the overall mean). Exact, so SQL can check it.
* ``Forest``: random forests (``operators.forest``); all models of an estimate grow together, one aggregate a level.
  Binary targets use the class probability of a classifier.

Scoring is one column: a row meets only the trees of its own fold's models, and no other column passes through Python.
Cross-fitting: fold = floor(k * u(id)); with cell means, the out-of-fold mean of a cell is
(cell total - cell-in-fold total) / (cell count - cell-in-fold count), so all k folds come out
of one grouped aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.hashing import SALT_BOOTSTRAP, SALT_SPLIT, fold, uniform
from causeway.operators.complete import join_cells, usable_rows
from causeway.operators.forest import LOOKED_UP, Cells, Forest, Lookup, Target, Trees, grow, predictions
from causeway.operators.regression import check_binary, estimate_df
from causeway.operators.replicates import pairs, replicate_sums, symmetric
from causeway.session import held_rows, materialize
from causeway.spec import CausalSpec

ITE = "Estimated_ITE"


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


@dataclass(frozen=True)
class CellMean:
    cells: tuple[str, ...]


def _is_binary_outcome(df: DataFrame, col: str) -> bool:
    try:
        check_binary(df, col)
        return True
    except ValueError:
        return False


def _check_features(df: DataFrame, feats: list[str]) -> None:
    if not feats:
        raise ValueError("this method needs at least one confounder")
    bad = [f for f in feats if not isinstance(df.schema[f].dataType, T.NumericType)]
    if bad:
        raise ValueError(f"confounders must be numeric (encode text first): {bad}")


def _columns_of(names: list[str]) -> list[Column]:
    return [_q(c) for c in names]


# ---- meta-learners (E12, E13, E18) -------------------------------------------------------------

def _cell_mean_ite(df: DataFrame, spec: CausalSpec, cells: list[str], weight: str | None = None) -> DataFrame:
    t, y = _q(spec.treatment), _q(spec.outcome).cast("double")
    w = _q(weight) if weight else F.lit(1.0)

    def wavg(arm):
        return F.sum(F.when(t == arm, w * y)) / F.sum(F.when(t == arm, w))

    g = df.agg(wavg(1).alias("g1"), wavg(0).alias("g0")).collect()[0]
    cm = df.groupBy(*[_q(c) for c in cells]).agg(wavg(1).alias("_m1"), wavg(0).alias("_m0"))
    j = join_cells(df, cm, cells)
    ite = F.coalesce(F.col("_m1"), F.lit(g["g1"])) - F.coalesce(F.col("_m0"), F.lit(g["g0"]))
    return j.withColumn(ITE, ite).drop("_m1", "_m0")


def s_learner(df: DataFrame, spec: CausalSpec, learner: CellMean | Forest = Forest(), weight: str | None = None,
              missing: str = "raise", dealt: bool = False) -> DataFrame:
    """E12 + E18: one model f(X, T); ITE = f(X, 1) - f(X, 0), added as ``Estimated_ITE``. ``dealt``: as of ``grow``."""
    df = usable_rows(df, spec, missing)
    if isinstance(learner, CellMean):
        return _cell_mean_ite(df, spec, list(learner.cells), weight)
    feats = list(spec.confounders)
    _check_features(df, feats)
    binary = _is_binary_outcome(df, spec.outcome)
    target = Target(_q(spec.outcome), None, _q(weight) if weight else None, binary)
    model = grow(df, _id_of(df, spec), [*feats, spec.treatment], [target], learner, dealt)
    x = _columns_of(feats)
    mu1, mu0 = (predictions(df.sparkSession, model, [*x, F.lit(arm)]) for arm in (1.0, 0.0))
    return df.withColumn(ITE, mu1 - mu0)


def _id_of(df: DataFrame, spec: CausalSpec) -> str | None:
    return spec.id_col if spec.id_col in df.columns else None


def t_learner(df: DataFrame, spec: CausalSpec, learner: CellMean | Forest = Forest(), weight: str | None = None,
              missing: str = "raise", dealt: bool = False) -> DataFrame:
    """E13 + E18: separate models for treated and controls, both scored on every row. ``dealt``: as of ``grow``."""
    df = usable_rows(df, spec, missing)
    if isinstance(learner, CellMean):
        return _cell_mean_ite(df, spec, list(learner.cells), weight)
    feats = list(spec.confounders)
    _check_features(df, feats)
    binary = _is_binary_outcome(df, spec.outcome)
    w = _q(weight) if weight else None
    m1, m0 = grow(df, _id_of(df, spec), feats, [Target(_q(spec.outcome), _q(spec.treatment) == arm, w, binary) for arm in (1, 0)],
                  learner, dealt)
    x = _columns_of(feats)
    return df.withColumn(ITE, predictions(df.sparkSession, [m1], x) - predictions(df.sparkSession, [m0], x))


def ate_from_ite(df: DataFrame, weight: str | None = None) -> float:
    if weight:
        r = df.agg((F.sum(F.col(ITE) * _q(weight)) / F.sum(_q(weight))).alias("a")).collect()[0]
    else:
        r = df.agg(F.avg(ITE).alias("a")).collect()[0]
    return r["a"]


def _average(ite: DataFrame):
    return ite.agg(F.avg(ITE).alias("a"), F.count(F.lit(1)).alias("n")).collect()[0]


def _model_columns(df: DataFrame, spec: CausalSpec) -> DataFrame:
    """What a forest's estimate reads of the table."""
    names = [*spec.confounders, spec.treatment, spec.outcome, *([spec.id_col] if _id_of(df, spec) else [])]
    return df.select(*[_q(c) for c in dict.fromkeys(names)])


def learner_estimate(df: DataFrame, spec: CausalSpec, method: str, learner) -> DataFrame:
    fn = {"s_learner": s_learner, "t_learner": t_learner}[method]
    if isinstance(learner, CellMean):
        r = _average(fn(df, spec, learner))
    else:
        with held_rows(_model_columns(df, spec)) as rows:
            r = _average(fn(rows, spec, learner, dealt=True))
    return estimate_df(df.sparkSession, [(method, "ate", r["n"], r["a"], None, None, None, "none")])


# ---- double machine learning (E14, E15) ---------------------------------------------------------

def dml_residuals(df: DataFrame, spec: CausalSpec, learner: CellMean | Forest = Forest(), folds: int = 3,
                  rng: str = "md5", missing: str = "raise", dealt: bool = False) -> DataFrame:
    """Cross-fitted residuals ``_y_res`` = Y - E[Y|X], ``_t_res`` = T - P(T=1|X); each row is
    scored by a model that did not see it. The outcome model is a regressor even for a binary Y. ``dealt``: as of ``grow``."""
    df = usable_rows(df, spec, missing, (spec.id_col,))
    d = df.withColumn("_fold", fold(spec.id_col, folds, rng))
    y, t = _q(spec.outcome).cast("double"), _q(spec.treatment).cast("double")
    if isinstance(learner, CellMean):
        cells = list(learner.cells)
        cf = d.groupBy(*[_q(c) for c in cells], "_fold").agg(F.sum(y).alias("_sy"), F.sum(t).alias("_st"),
                                                               F.count(F.lit(1)).alias("_n"))
        cc = cf.groupBy(*cells).agg(F.sum("_sy").alias("_csy"), F.sum("_st").alias("_cst"), F.sum("_n").alias("_cn"))
        tot = d.groupBy("_fold").agg(F.sum(y).alias("_fsy"), F.sum(t).alias("_fst"), F.count(F.lit(1)).alias("_fn"))
        tr = {r["_fold"]: r for r in tot.collect()}
        sy, st, sn = (sum(r[k] for r in tr.values()) for k in ("_fsy", "_fst", "_fn"))
        fb_y = F.lit(None).cast("double")
        fb_t = F.lit(None).cast("double")
        for k, r in tr.items():  # out-of-fold overall means, the fallback for cells seen only in fold k
            fb_y = F.when(F.col("_fold") == k, F.lit((sy - r["_fsy"]) / (sn - r["_fn"]) if sn > r["_fn"] else None)).otherwise(fb_y)
            fb_t = F.when(F.col("_fold") == k, F.lit((st - r["_fst"]) / (sn - r["_fn"]) if sn > r["_fn"] else None)).otherwise(fb_t)
        oof = join_cells(cf, cc, cells).select(
            *cells, "_fold",
            F.when(F.col("_cn") - F.col("_n") > 0, (F.col("_csy") - F.col("_sy")) / (F.col("_cn") - F.col("_n"))).alias("_my"),
            F.when(F.col("_cn") - F.col("_n") > 0, (F.col("_cst") - F.col("_st")) / (F.col("_cn") - F.col("_n"))).alias("_mt"))
        j = join_cells(d, oof, cells + ["_fold"])
        return (j.withColumn("_y_res", y - F.coalesce(F.col("_my"), fb_y))
                 .withColumn("_t_res", t - F.coalesce(F.col("_mt"), fb_t)).drop("_my", "_mt"))
    feats = list(spec.confounders)
    _check_features(df, feats)
    others = [F.col("_fold") != k for k in range(folds)]
    targets = [Target(y, o) for o in others] + [Target(t, o, classifier=True) for o in others]
    models = grow(d, spec.id_col, feats, targets, learner, dealt)
    x, spark = _columns_of(feats), df.sparkSession
    return (d.withColumn("_y_res", y - predictions(spark, models[:folds], x, F.col("_fold")))
             .withColumn("_t_res", t - predictions(spark, models[folds:], x, F.col("_fold"))))


def dml_final_stage(res: DataFrame, spec: CausalSpec, constant_effect: bool = False) -> dict:
    """Regress Y_res on T_res * [1, X] (no intercept); theta(x) = theta0 + theta'x; ATE = mean theta(x).
    ``constant_effect``: theta = sum T_res Y_res / sum T_res^2."""
    yr, tr = F.col("_y_res"), F.col("_t_res")
    mods = [] if constant_effect else list(spec.confounders)
    z = [tr] + [tr * _q(c).cast("double") for c in mods]
    p = len(z)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(_q(c).cast("double")).alias(f"mx{i}") for i, c in enumerate(mods)]
    aggs += [F.sum(z[a] * z[b]).alias(f"zz{a}_{b}") for a in range(p) for b in range(a, p)]
    aggs += [F.sum(z[a] * yr).alias(f"zy{a}") for a in range(p)] + [F.sum(yr * yr).alias("yy")]
    r = res.agg(*aggs).collect()[0]
    ZZ = np.zeros((p, p))
    for a in range(p):
        for b in range(a, p):
            ZZ[a, b] = ZZ[b, a] = r[f"zz{a}_{b}"]
    Zy = np.array([r[f"zy{a}"] for a in range(p)])
    inv = np.linalg.pinv(ZZ)
    theta = inv @ Zy
    n = r["n"]
    rss = max(r["yy"] - 2 * theta @ Zy + theta @ ZZ @ theta, 0.0)
    s2 = rss / max(n - p, 1)
    V = s2 * inv
    g = np.array([1.0] + [r[f"mx{i}"] for i in range(len(mods))])
    return dict(theta=theta, terms=["const"] + mods, ate=float(g @ theta), se=float(np.sqrt(max(g @ V @ g, 0.0))), n=int(n))


def bootstrap_dml_final(res: DataFrame, spec: CausalSpec, B: int = 50, constant_effect: bool = False,
                        rng: str = "md5") -> DataFrame:
    """U1 for LinearDML: the final stage re-solved per Poisson replicate, all replicates in one
    grouped aggregate over the (checkpointed) residual table; nuisances are held fixed."""
    from causeway import spec as S
    mods = [] if constant_effect else list(spec.confounders)
    q, p = len(mods), len(mods) + 1
    i, j = pairs(p)

    def sums(x, draws):
        ok = ~np.isnan(x).any(axis=1)
        w, x = draws.poisson(SALT_BOOTSTRAP)[ok].T.astype(float), x[ok]
        z = x[:, 1:2] * np.column_stack([np.ones(len(x)), x[:, 2:]])
        return w @ np.column_stack([np.ones(len(x)), x[:, 2:], z * x[:, :1], z[:, i] * z[:, j]])

    cols = [F.col("_y_res"), F.col("_t_res"), *[_q(c) for c in mods]]
    rows = []
    for rep, r in enumerate(replicate_sums(res, spec.id_col, cols, B, 1 + q + p + len(i), sums, rng, (SALT_BOOTSTRAP,))):
        if r[0] <= 0:
            rows.append((rep, None))
            continue
        theta = np.linalg.pinv(symmetric(r[1 + q + p:], p)) @ r[1 + q:1 + q + p]
        rows.append((rep, float(np.append(1.0, r[1:1 + q] / r[0]) @ theta)))
    return res.sparkSession.createDataFrame(rows, S.BOOTSTRAP)


def resampled(df: DataFrame, weight: str) -> DataFrame:
    """Each row as often as its replicate count says, under its own id: its copies share a fold and a half, so no model
    is scored on a copy of what it saw."""
    copies = F.explode(F.array_repeat(F.lit(1), F.col(weight).cast("int")))
    return df.withColumn("_copy", copies).drop("_copy", weight)


def cate_column(spec_terms: list[str], theta: np.ndarray) -> Column:
    expr = F.lit(float(theta[0]))
    for i, c in enumerate(spec_terms[1:], start=1):
        expr = expr + F.lit(float(theta[i])) * _q(c).cast("double")
    return expr


def linear_dml(df: DataFrame, spec: CausalSpec, learner: CellMean | Forest = Forest(), folds: int = 3,
               constant_effect: bool = False, rng: str = "md5", missing: str = "raise") -> tuple[DataFrame, DataFrame]:
    """E14 + E15 + E18: (estimate row, table with ``Estimated_ITE`` = theta(x))."""
    if isinstance(learner, CellMean):
        res = dml_residuals(df, spec, learner, folds, rng, missing)
        fs = dml_final_stage(res, spec, constant_effect)
    else:
        with held_rows(_model_columns(df, spec)) as rows:
            fs = dml_final_stage(dml_residuals(rows, spec, learner, folds, rng, missing, dealt=True), spec, constant_effect)
        res = usable_rows(df, spec, "drop", (spec.id_col,))
    ite = res.withColumn(ITE, cate_column(fs["terms"], fs["theta"])).drop("_fold", "_y_res", "_t_res")
    lo, hi = fs["ate"] - 1.959963984540054 * fs["se"], fs["ate"] + 1.959963984540054 * fs["se"]
    est = estimate_df(df.sparkSession, [("linear_dml", "ate", fs["n"], fs["ate"], fs["se"], lo, hi, "analytic")])
    return est, ite


# ---- causal forest (E16, E17) -------------------------------------------------------------------

def causal_forest(df: DataFrame, spec: CausalSpec, nuisance: CellMean | Forest = Forest(),
                  forest: Forest = Forest(), folds: int = 3, rng: str = "md5", missing: str = "raise"):
    """tau(x) = sum_b mean_leaf(Y_res T_res) / sum_b mean_leaf(T_res^2) over the trees b.

    Honest: the trees grow on half A (label Y_res / T_res, weight T_res^2, which is the local
    least-squares problem of the displayed formula); the leaf sums come from half B: each task adds its rows up by
    (tree, leaf), one row for each of those shuffles, and the sums by leaf (at most trees * 2^depth) are broadcast and
    looked up by one function of the features, so no other column passes through Python.
    Returns (estimate row, table with ``Estimated_ITE``, the forest, feature names).
    """
    feats = list(spec.confounders)
    _check_features(df, feats)
    spark = df.sparkSession
    half = uniform(spec.id_col, SALT_SPLIT, 0, rng) < F.lit(0.5)

    def stored(res: DataFrame) -> DataFrame:
        # read several times below; a reliable checkpoint of the columns the forest needs, not a recompute of the nuisances
        return materialize(res.select(_q(spec.id_col).alias("_id"), *[_q(c).cast("double").alias(f"_x{i}") for i, c in enumerate(feats)],
                                      "_y_res", "_t_res", half.alias("_half_a")))

    dealt = not isinstance(nuisance, CellMean)
    if not dealt:
        narrow = stored(dml_residuals(df, spec, nuisance, folds, rng, missing))
    else:
        with held_rows(_model_columns(df, spec)) as rows:
            narrow = stored(dml_residuals(rows, spec, nuisance, folds, rng, missing, dealt=True))
    xs = [f"_x{i}" for i in range(len(feats))]
    grows = narrow.where(F.col("_half_a") & (F.col("_t_res") != 0))
    model = grow(grows, "_id", xs, [Target(F.col("_y_res") / F.col("_t_res"), None, F.col("_t_res") * F.col("_t_res"))], forest, dealt)[0]
    num, den = _leaf_means(narrow.where(~F.col("_half_a")), xs, model)
    held = spark.sparkContext.broadcast(Lookup(model, _Effects(model, num, den)))

    @F.arrow_udf(T.DoubleType())
    def effect(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
        return pa.array(held.value.predict(x), pa.float64(), from_pandas=True)

    kept = usable_rows(df, spec, "drop", (spec.id_col,))  # if missing is an error, there are none
    ite = kept.withColumn(ITE, effect(*[_q(c).cast("double") for c in feats]))
    r = narrow.agg(F.avg(effect(*[F.col(c) for c in xs])).alias("a"), F.count(F.lit(1)).alias("n")).first()
    est = estimate_df(spark, [("causal_forest", "ate", r["n"], r["a"], None, None, None, "none")])
    return est, ite, model, feats


@dataclass(frozen=True)
class _Effects:
    """tau(x) from the leaves' means."""
    model: Trees
    num: np.ndarray
    den: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        at = np.arange(len(self.num))[None, :]
        for k in range(0, len(x), 2048):
            lv = self.model.leaves(x[k:k + 2048])
            a, b = self.num[at, lv].sum(axis=1), self.den[at, lv].sum(axis=1)
            out[k:k + 2048] = np.where(b > 0, a / np.where(b > 0, b, 1.0), np.nan)
        return out


def _leaf_means(rows: DataFrame, xs: list[str], model: Trees) -> tuple[np.ndarray, np.ndarray]:
    """By tree and leaf the means of Y_res T_res and of T_res^2; 0 where a leaf has no row."""
    cells = Cells(model)
    by_cell = cells.size <= LOOKED_UP
    held = rows.sparkSession.sparkContext.broadcast((model, cells))
    shape = model.feature.shape

    def run(batches):
        model, cells = held.value
        sums = np.zeros((3, shape[0] * shape[1]))
        base = (np.arange(shape[0]) * shape[1])[None, :]
        added = np.zeros((3, cells.size if by_cell else 0))
        for batch in batches:
            c = [col.to_numpy(zero_copy_only=False) for col in batch.columns]
            x = np.stack(c[2:], axis=1).astype(float)
            if by_cell:
                at, (y, t) = cells.of(x), c[:2]
                for i, v in enumerate((y * t, t * t, None)):
                    added[i] += np.bincount(at, v, cells.size)
                continue
            for k in range(0, len(x), 2048):
                lv = (base + model.leaves(x[k:k + 2048])).ravel()
                y, t = (np.repeat(v[k:k + 2048], shape[0]) for v in c[:2])
                for i, v in enumerate((y * t, t * t, None)):
                    sums[i] += np.bincount(lv, v, sums.shape[1])
        if by_cell:
            lv = (base + model.leaves(cells.points())).ravel()
            sums = np.stack([np.bincount(lv, np.repeat(v, shape[0]), sums.shape[1]) for v in added])
        got = np.flatnonzero(sums[2])
        yield pa.RecordBatch.from_arrays([pa.array(got), *(pa.array(v[got]) for v in sums)], names=["leaf", "syt", "stt", "n"])

    parts = rows.select("_y_res", "_t_res", *xs).mapInArrow(run, "leaf long, syt double, stt double, n double")
    found = parts.groupBy("leaf").agg(F.sum("syt").alias("syt"), F.sum("stt").alias("stt"), F.sum("n").alias("n")).toArrow()
    held.destroy()
    leaf, syt, stt, n = (found.column(k).to_numpy() for k in ("leaf", "syt", "stt", "n"))
    num, den = np.zeros(shape[0] * shape[1]), np.zeros(shape[0] * shape[1])
    num[leaf], den[leaf] = syt / n, stt / n
    return num.reshape(shape), den.reshape(shape)


def feature_importance(model, feats: list[str], spark) -> DataFrame:
    """The forest's impurity-based importances, one row per feature."""
    imp = model.importances()
    return spark.createDataFrame([(f, float(imp[i])) for i, f in enumerate(feats)],
                                 "feature string, importance double").orderBy(F.col("importance").desc(), "feature")


def ite_histogram(ite: DataFrame, bins: int = 30) -> DataFrame:
    """F16: histogram of ``Estimated_ITE`` (30 bins) with the ATE as the reference line."""
    from causeway.operators.eda import histogram
    ate = ite.agg(F.avg(ITE).alias("a")).collect()[0]["a"]
    return histogram(ite, ITE, bins).withColumn("ate", F.lit(ate))

