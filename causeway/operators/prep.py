"""Preprocessing steps whose parameters come from one aggregate of their input.

Every step is a pair ``fit(df) -> params`` (one job, a few numbers reach the driver) and
``apply(df, params) -> df`` (a projection with the parameters as literals, so Catalyst folds it
into the scan's stage). ``apply_steps`` runs an ordered list once each: impute, winsorize, log,
standardize, filter, bucket, or whatever order the caller gives.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.quantiles import exact_quantiles, present
from causeway.operators.complete import absent, absent_possible
from causeway.operators.coerce import split_types
from causeway.operators.filters import predicate

log = logging.getLogger(__name__)


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace some columns in place, keeping column order."""
    return df.select(*[(new[c] if c in new else _q(c)).alias(c) for c in df.columns])


def _given(df: DataFrame, c: str) -> Column:
    """The column, null where it is missing (null or NaN)."""
    return F.when(~absent(df, c), _q(c)) if absent_possible(df, c) else _q(c)


# ---- C1-C4: numeric imputation ----------------------------------------------------------------

def impute_numeric(df: DataFrame, method: str = "mean", value: float | None = None,
                   cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """C1 mean, C2 exact median, C3 zero, C4 custom value.

    Columns without missing values are left as they are (pandas keeps their dtype); a filled
    integer column becomes double when the fill value is not whole, as in pandas.
    """
    num = cols if cols is not None else split_types(df)[0]
    if not num:
        return df
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count(_given(df, c)).alias(f"n{i}") for i, c in enumerate(num)]
    if method == "mean":
        aggs += [F.avg(_given(df, c)).alias(f"v{i}") for i, c in enumerate(num)]
    row = df.agg(*aggs).collect()[0]
    need = [i for i in range(len(num)) if row[f"n{i}"] < row["_n"]]
    if not need:
        return df
    if method == "mean":
        fills = {num[i]: row[f"v{i}"] for i in need}
    elif method == "median":
        med = exact_quantiles(df, [num[i] for i in need], [0.5], approx=approx)
        fills = {c: v[0] for c, v in med.items()}
    elif method == "zero":
        fills = {num[i]: 0 for i in need}
    elif method == "custom":
        fills = {num[i]: value for i in need}
    else:
        raise ValueError(f"unknown numeric imputation {method!r}")
    new = {}
    for c, v in fills.items():
        if v is None:  # all-missing column: nothing to fill with
            continue
        is_int = isinstance(df.schema[c].dataType, T.IntegralType)
        whole = float(v).is_integer()
        lit = F.lit(int(v)) if (is_int and whole and method in ("zero", "custom")) else F.lit(float(v))
        new[c] = F.coalesce(_given(df, c), lit)
    return _replace(df, new)


# ---- C5-C7: categorical imputation -------------------------------------------------------------

def column_modes(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Most frequent non-null value per column, ties to the smallest value.

    All columns in one unpivot -> groupBy(column, value).count (partial aggregate) -> one
    aggregate per column: the largest count, at it the smallest value. Only aggregates, so a column with millions of
    distinct values is never gathered into one task.
    """
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), _q(c).cast("string").alias("v"))
                                        for c in cols])).alias("kv")).select("kv.k", "kv.v").where(F.col("v").isNotNull())
    counts = long.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("k").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("best"))
    return {r["k"]: r["best"]["v"] for r in best.collect()}


def impute_categorical(df: DataFrame, method: str = "mode", value: str = "Missing",
                       cols: list[str] | None = None) -> DataFrame:
    """C5 mode, C6 "Missing" indicator, C7 custom text. Non-string categoricals are cast to text
    when filled with text."""
    cat = cols if cols is not None else split_types(df)[1]
    if not cat:
        return df
    if method == "mode":
        modes = column_modes(df, cat)
        new = {c: F.coalesce(_q(c), F.lit(modes[c]).cast(df.schema[c].dataType)) for c in cat if c in modes}
        return _replace(df, new)
    if method == "missing":
        value = "Missing"
    elif method != "custom":
        raise ValueError(f"unknown categorical imputation {method!r}")
    return _replace(df, {c: F.coalesce(_q(c).cast("string"), F.lit(value)) for c in cat})


# ---- C8-C10 -------------------------------------------------------------------------------------

def winsor_bounds(df: DataFrame, cols: list[str], p: float = 0.05, approx: bool = False) -> dict[str, tuple[float, float]]:
    if not 0 < p < 0.5:
        raise ValueError("p must be in (0, 0.5)")
    qs = exact_quantiles(df, cols, [p, 1 - p], approx=approx)
    return {c: (v[0], v[1]) for c, v in qs.items()}


def winsorize(df: DataFrame, cols: list[str], p: float = 0.05, approx: bool = False) -> DataFrame:
    """Clip at the p-th and (1-p)-th quantiles (exact, linear interpolation; ``approx`` opt-in).
    Missing stays missing."""
    b = winsor_bounds(df, cols, p, approx)
    new = {}
    for c, (lo, hi) in b.items():
        if lo is None:
            continue
        x = present(_q(c))
        new[c] = F.when(x.isNull(), F.lit(None).cast("double")).otherwise(F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
    return _replace(df, new)


def log1p_columns(df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """log(1 + x); a column with any negative value is skipped (returned in the second slot)."""
    if not cols:
        return df, []
    row = df.agg(*[F.min(_q(c)).alias(f"m{i}") for i, c in enumerate(cols)]).collect()[0]
    skipped = [c for i, c in enumerate(cols) if row[f"m{i}"] is not None and row[f"m{i}"] < 0]
    for c in skipped:
        log.warning("column %s has negative values; log transform skipped", c)
    return _replace(df, {c: F.log1p(_q(c).cast("double")) for c in cols if c not in skipped}), skipped


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    if not cols:
        return df
    row = df.agg(*[f(_given(df, c)).alias(f"{n}{i}") for i, c in enumerate(cols)
                   for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))]).collect()[0]
    new = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        if m is None:
            continue
        s = s if s and s > 0 else 1.0
        new[c] = (_q(c).cast("double") - F.lit(m)) / F.lit(s)
    return _replace(df, new)


# ---- C11-C13: buckets ---------------------------------------------------------------------------

def cut_edges(lo: float, hi: float, n_bins: int) -> list[float]:
    """Equal-width edges; the lowest edge moves down 0.1 % of the range so the minimum is inside
    the first right-closed bin; a constant column is widened by 0.1 % on both sides."""
    if lo == hi:
        lo, hi = (lo - 0.001 * abs(lo), hi + 0.001 * abs(hi)) if lo != 0 else (lo - 0.001, hi + 0.001)
        return list(np.linspace(lo, hi, n_bins + 1))
    edges = list(np.linspace(lo, hi, n_bins + 1))
    edges[0] = edges[0] - (hi - lo) * 0.001
    return [float(e) for e in edges]


def qcut_edges(df: DataFrame, col: str, n_bins: int) -> list[float]:
    """Equal-frequency edges from exact quantiles k/n; duplicate edges dropped."""
    qs = exact_quantiles(df, [col], [k / n_bins for k in range(n_bins + 1)])[col]
    if qs[0] is None:
        return []
    return sorted(set(float(v) for v in qs))


def bucket_code(col: str, edges: list[float]) -> Column:
    """Right-closed code: number of interior edges strictly below x (x in [e0, e_last])."""
    x = present(_q(col))
    if len(edges) < 2:
        return F.lit(None).cast("int")
    code = reduce(lambda a, b: a + b, [F.when(x > F.lit(e), 1).otherwise(0) for e in edges[1:-1]], F.lit(0))
    inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
    return F.when(x.isNotNull() & inside, code).cast("int")


def _fmt(v: float, precision: int) -> str:
    r = round(v, precision)
    return f"{r:.{precision}f}"


def bucket_label(col: str, edges: list[float], precision: int = 1, lowest_closed: bool = False) -> Column:
    code = bucket_code(col, edges)
    labels = []
    while precision < 15 and len({_fmt(e, precision) for e in edges}) < len(set(edges)):
        precision += 1  # edges that differ must read differently
    for i in range(len(edges) - 1):
        left = "[" if (lowest_closed and i == 0) else "("
        labels.append(f"{left}{_fmt(edges[i], precision)}, {_fmt(edges[i + 1], precision)}]")
    return F.element_at(F.array(*[F.lit(s) for s in labels]), code + 1) if labels else F.lit(None).cast("string")


def bucketize(df: DataFrame, col: str, n_bins: int = 4, method: str = "cut", new_col: str | None = None,
              precision: int = 1) -> DataFrame:
    """C11 (``cut``, equal width) / C12 (``qcut``, equal frequency): adds ``<new_col>`` (interval
    label) and ``<new_col>_code`` (0-based bin)."""
    if not 2 <= n_bins <= 20:
        raise ValueError("n_bins must be between 2 and 20")
    new_col = new_col or f"{col}_binned"
    if method == "cut":
        r = df.agg(F.min(_given(df, col)).alias("lo"), F.max(_given(df, col)).alias("hi")).collect()[0]
        if r["lo"] is None:
            return df.withColumn(new_col, F.lit(None).cast("string")).withColumn(f"{new_col}_code", F.lit(None).cast("int"))
        edges = cut_edges(float(r["lo"]), float(r["hi"]), n_bins)
        lowest = False
    elif method == "qcut":
        edges = qcut_edges(df, col, n_bins)
        lowest = True
    else:
        raise ValueError("method must be 'cut' or 'qcut'")
    return df.withColumn(new_col, bucket_label(col, edges, precision, lowest)).withColumn(f"{new_col}_code",
                                                                                            bucket_code(col, edges))


def bucket_counts(df: DataFrame, code_col: str) -> DataFrame:
    """Rows per bucket, in bucket order."""
    return df.groupBy(code_col).agg(F.count(F.lit(1)).alias("n")).orderBy(code_col)


# ---- C14: the ordered step chain ----------------------------------------------------------------

@dataclass(frozen=True)
class Impute:
    numeric: str | None = "mean"
    numeric_value: float | None = None
    categorical: str | None = None
    categorical_value: str = "Missing"

    def __call__(self, df):
        if self.numeric:
            df = impute_numeric(df, self.numeric, self.numeric_value)
        if self.categorical:
            df = impute_categorical(df, self.categorical, self.categorical_value)
        return df


@dataclass(frozen=True)
class Winsorize:
    cols: tuple[str, ...]
    p: float = 0.05

    def __call__(self, df):
        return winsorize(df, list(self.cols), self.p)


@dataclass(frozen=True)
class Log1p:
    cols: tuple[str, ...]

    def __call__(self, df):
        return log1p_columns(df, list(self.cols))[0]


@dataclass(frozen=True)
class Standardize:
    cols: tuple[str, ...]

    def __call__(self, df):
        return standardize(df, list(self.cols))


@dataclass(frozen=True)
class Filter:
    col: str
    op: str
    value: object
    literal: bool = False

    def __call__(self, df):
        return df.where(predicate(self.col, self.op, self.value, self.literal))


@dataclass(frozen=True)
class Bucket:
    col: str
    n_bins: int = 4
    method: str = "cut"
    new_col: str | None = None

    def __call__(self, df):
        return bucketize(df, self.col, self.n_bins, self.method, self.new_col)


@dataclass
class StepLog:
    steps: list = field(default_factory=list)

    def add(self, step) -> "StepLog":
        self.steps.append(step)
        return self


def apply_steps(df: DataFrame, steps: list) -> DataFrame:
    """C14: fold the steps over the frame, each applied once; each step fits on its own input."""
    return reduce(lambda d, s: d.transform(s), steps, df)


def default_order(impute=None, winsor=None, log=None, std=None, filters=(), buckets=()) -> list:
    """The batch order: impute -> winsorize -> log -> standardize -> filter -> bucket."""
    return [s for s in (impute, winsor, log, std) if s is not None] + list(filters) + list(buckets)
