"""Which features modify the effect.

G1/G2 fit one model per feature, but all of them come out of ONE Gram job over
[T, (Post, T*Post), all X, all T*X, (Post*X, T*Post*X), Y]: every per-feature model is a
sub-matrix of it, solved on the driver. G3 regresses the per-row effect on each feature with
one aggregate of ``regr_slope`` / ``corr`` / ``regr_count``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway import spec as S
from causeway.functions import stats
from causeway.operators.moments import moments, solve_ols
from causeway.spec import CausalSpec

HELPER_PREFIXES = ("_", "Estimated_ITE", "Treatment_Encoded")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def candidate_features(df: DataFrame, spec: CausalSpec, extra_exclude: tuple[str, ...] = ()) -> list[str]:
    """Every column except treatment, outcome, time, id and helper columns."""
    skip = {spec.treatment, spec.outcome, spec.id_col, *(extra_exclude or ())}
    if spec.time_period:
        skip.add(spec.time_period)
    return [c for c in df.columns if c not in skip and not c.startswith(HELPER_PREFIXES)]


def interaction_terms(df: DataFrame, spec: CausalSpec, features: list[str] | None = None,
                      did: bool = False) -> list[dict]:
    """Per feature: coefficient, se, t, p of T*X (G1) or T*Post*X (G2), or the reason it was skipped."""
    feats = features if features is not None else candidate_features(df, spec)
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    out, usable = [], []
    for f in feats:
        if f not in numeric:
            out.append(dict(feature=f, skipped_reason="not numeric"))
        else:
            usable.append(f)
    # null counts of every model column in one pass; columns with gaps are skipped, as a fit would fail
    base = [spec.treatment, spec.outcome] + ([spec.time_period] if did else [])
    nulls = df.agg(*[F.sum(_q(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(base + usable)]).collect()[0]
    if any(nulls[f"n{i}"] for i in range(len(base))):
        raise ValueError("treatment, outcome or time column has missing values")
    gaps = {c for i, c in enumerate(usable) if nulls[f"n{i + len(base)}"]}
    for f in [c for c in usable if c in gaps]:
        out.append(dict(feature=f, skipped_reason="missing values"))
    usable = [c for c in usable if c not in gaps]
    others_pool = [c for c in spec.confounders if c in usable]
    t, y = _q(spec.treatment), _q(spec.outcome)
    cols: dict[str, Column] = {"T": t}
    if did:
        p = _q(spec.time_period)
        cols.update({"P": p, "TP": t * p})
    for i, f in enumerate(usable):
        x = _q(f)
        cols[f"X{i}"] = x
        cols[f"TX{i}"] = t * x
        if did:
            cols[f"PX{i}"] = p * x
            cols[f"TPX{i}"] = t * p * x
    cols["Y"] = y
    if usable:
        m = moments(df, cols)
    for i, f in enumerate(usable):
        others = [f"X{usable.index(o)}" for o in others_pool if o != f]
        if did:
            xs = ["T", "P", "TP", f"X{i}", f"TX{i}", f"PX{i}", f"TPX{i}"] + others
            term = f"TPX{i}"
        else:
            xs = ["T", f"X{i}", f"TX{i}"] + others
            term = f"TX{i}"
        fit = solve_ols(m, "Y", xs)
        if not fit.identified.get(term, False):
            out.append(dict(feature=f, skipped_reason="collinear or constant"))
            continue
        row = fit.table()[fit.index(term)]
        out.append(dict(feature=f, coef=row[1], se=row[2], stat=row[3], p_value=row[4]))
    return out


def _hte_frame(spark, rows: list[dict], alpha: float) -> DataFrame:
    rows = sorted(rows, key=lambda r: (r.get("p_value") is None, r.get("p_value") or 0.0, r["feature"]))
    data = [(r["feature"], r.get("coef"), r.get("p_value"),
             (r["p_value"] < alpha) if r.get("p_value") is not None else None, r.get("skipped_reason")) for r in rows]
    return spark.createDataFrame(data, S.HTE)


def hte_interactions(df: DataFrame, spec: CausalSpec, features: list[str] | None = None, did: bool = False,
                     alpha: float = 0.05) -> DataFrame:
    """G1 (G2 with ``did=True``) + G5 ranking + G7 skip reasons, in the ``hte`` contract."""
    return _hte_frame(df.sparkSession, interaction_terms(df, spec, features, did), alpha)


def ite_slopes(df: DataFrame, ite_col: str, features: list[str], alpha: float = 0.05) -> DataFrame:
    """Simple regression ITE ~ 1 + X per feature; slope and t-test p-value, one aggregate."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    use = [f for f in features if f in numeric]
    rows = [dict(feature=f, skipped_reason="not numeric") for f in features if f not in numeric]
    if use:
        e = _q(ite_col)
        aggs = []
        for i, f in enumerate(use):
            x = _q(f).cast("double")
            aggs += [F.regr_slope(e, x).alias(f"b{i}"), F.corr(e, x).alias(f"r{i}"), F.regr_count(e, x).alias(f"n{i}")]
        r = df.agg(*aggs).collect()[0]
        for i, f in enumerate(use):
            b, rr, n = r[f"b{i}"], r[f"r{i}"], r[f"n{i}"]
            if b is None or rr is None or n is None or n < 3:
                rows.append(dict(feature=f, skipped_reason="constant or too few rows"))
                continue
            tval = rr * math.sqrt((n - 2) / (1 - rr * rr)) if abs(rr) < 1 else math.copysign(math.inf, rr)
            rows.append(dict(feature=f, coef=b, p_value=stats.t_two_sided_p(tval, n - 2)))
    return _hte_frame(df.sparkSession, rows, alpha)


def strongest_modifier(hte: DataFrame) -> DataFrame:
    """The most significant modifier, or no row."""
    return hte.where(F.col("significant")).orderBy("p_value", "feature").limit(1)
