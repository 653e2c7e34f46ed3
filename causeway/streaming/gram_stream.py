"""The E1 Gram job over a stream of rows: a running OLS effect.

A streaming aggregation keeps the sums of 1, x and x*x' of the model columns (centred by a fixed
shift, e.g. means from a first batch) as its state: p*(p+1)/2 + p + 1 numbers, whatever the number of
rows seen. Each trigger's output is one row; ``effect_from_sums`` solves it on the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.moments import Moments, OLSFit, solve_ols
from causeway.operators.regression import model_columns
from causeway.spec import CausalSpec


def stream_sums(stream: DataFrame, cols: dict[str, Column], shift: list[float]) -> DataFrame:
    """Streaming aggregate of the shifted sums (use outputMode "complete" or "update")."""
    names = list(cols)
    p = len(names)
    proj = stream.select(*[(e.cast("double") - F.lit(float(shift[i]))).alias(f"m{i}") for i, e in enumerate(cols.values())])
    proj = proj.where(" AND ".join(f"m{i} IS NOT NULL" for i in range(p)))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(f"m{i}").alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(F.col(f"m{i}") * F.col(f"m{j}")).alias(f"s{i}_{j}") for i in range(p) for j in range(i, p)]
    return proj.agg(*aggs)


def sums_to_moments(row, names: list[str], shift: list[float]) -> Moments:
    p = len(names)
    n = float(row["n"])
    s = np.array([row[f"s{i}"] for i in range(p)], dtype=float)
    C = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            C[i, j] = C[j, i] = row[f"s{i}_{j}"] - s[i] * s[j] / n
    return Moments(names, n, np.asarray(shift, dtype=float) + s / n, C, n)


def running_ols(stream: DataFrame, spec: CausalSpec, shift: list[float]) -> tuple[DataFrame, list[str]]:
    """The streaming aggregate for Y ~ 1 + T + X and its column names (for ``effect_from_sums``)."""
    cols = model_columns(spec)
    return stream_sums(stream, cols, shift), list(cols)


def effect_from_sums(row, names: list[str], shift: list[float], spec: CausalSpec) -> OLSFit:
    m = sums_to_moments(row, names, shift)
    return solve_ols(m, spec.outcome, [c for c in names if c != spec.outcome])
