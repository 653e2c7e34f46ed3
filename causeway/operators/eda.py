"""F1-F16: the tables behind the summary views and charts; every one is an aggregate job.

Quantiles are exact (linear interpolation); all columns, groups and quantiles of a call are selected together
(``functions.quantiles``), and a hot group never lands in one aggregation buffer. Null and NaN are missing everywhere.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.complete import absent, absent_possible, small_side
from causeway.functions.hashing import SALT_SAMPLE, uniform
from causeway.functions.quantiles import QUANTILE_LIMIT, exact_quantiles, present, quantiles_by
from causeway.operators.coerce import split_types


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


_DESCRIBE = ("column string, count bigint, mean double, std double, min double, p25 double, p50 double, p75 double, "
             "max double")


def describe(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per numeric column (one row per column)."""
    cols = cols if cols is not None else split_types(df)[0]
    if not cols:
        return df.sparkSession.createDataFrame([], _DESCRIBE)
    aggs = []
    for i, c in enumerate(cols):
        x = present(_q(c))
        aggs += [F.count(x).alias(f"dn{i}"), F.avg(x).alias(f"dm{i}"), F.stddev_samp(x).alias(f"ds{i}"),
                 F.min(x).alias(f"dlo{i}"), F.max(x).alias(f"dhi{i}")]
    row = df.agg(*aggs).first()
    qs = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    rows = [(c, int(row[f"dn{i}"]), row[f"dm{i}"], row[f"ds{i}"], row[f"dlo{i}"], *qs[c], row[f"dhi{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, _DESCRIBE)


def missing_summary(df: DataFrame) -> DataFrame:
    """missing count and percentage per column, one aggregate then an unpivot."""
    cols = df.columns
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(absent(df, c).cast("long")).alias(f"m{i}") for i, c in enumerate(cols)])
    stacked = agg.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"))
                                                   for i, c in enumerate(cols)])).alias("s"))
    return stacked.select("s.column", "s.missing",
                          (F.col("s.missing") / F.col("_n") * 100.0).alias("missing_pct"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are present (one aggregate)."""
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    agg = df.agg(*[F.corr(present(_q(cols[i])), present(_q(cols[j]))).alias(f"r{i}_{j}") for i, j in pairs])
    structs = []
    for i, j in pairs:
        structs.append(F.struct(F.lit(cols[i]).alias("col_a"), F.lit(cols[j]).alias("col_b"),
                                F.col(f"r{i}_{j}").alias("corr")))
        if i != j:
            structs.append(F.struct(F.lit(cols[j]).alias("col_a"), F.lit(cols[i]).alias("col_b"),
                                    F.col(f"r{i}_{j}").alias("corr")))
    return agg.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


AGGS = ("mean", "sum", "count", "median", "min", "max")


def grouped_agg(df: DataFrame, keys: list[str], y: str, agg: str = "mean", out: str | None = None) -> DataFrame:
    """Y aggregated by one or two keys (x, colour); rows with a missing key are left out.

    Partial aggregate per partition, one shuffle on the keys. ``median`` is exact.
    """
    out = out or f"{agg}_{y}"
    d = df.where(reduce(lambda a, b: a & b, [~absent(df, k) for k in keys])) if keys else df
    if absent_possible(df, y):
        d = d.withColumn(y, F.when(~absent(df, y), _q(y)))
    if agg == "median":
        return grouped_quantiles(d, keys, y, [0.5], [out])
    f = {"mean": F.avg(_q(y)), "sum": F.coalesce(F.sum(_q(y)), F.lit(0)), "count": F.count(_q(y)),
         "min": F.min(_q(y)), "max": F.max(_q(y))}[agg]
    return d.groupBy(*[_q(k) for k in keys]).agg(f.alias(out))


def grouped_quantiles(df: DataFrame, keys: list[str], y: str, qs: list[float], names: list[str],
                      quantile_limit: int = QUANTILE_LIMIT) -> DataFrame:
    """Exact quantiles of y per group, all groups together; a group without a value has nulls."""
    return quantiles_by(df, keys, y, qs, names, quantile_limit)


def histogram_edges(lo: float, hi: float, bins: int) -> list[float]:
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    return [float(e) for e in np.linspace(lo, hi, bins + 1)]


def _bin_of(x: Column, edges: list[float]) -> Column:
    # left-closed bins, last closed: number of interior edges <= x
    code = F.lit(0)
    for e in edges[1:-1]:
        code = code + F.when(x >= F.lit(e), 1).otherwise(0)
    return code


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """equal bins over [min, max] (numpy edges), left-closed, the last one closed; empty bins
    are listed with 0."""
    x = present(_q(col))
    r = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    spark = df.sparkSession
    if r["lo"] is None:
        return spark.createDataFrame([], "bin int, lower double, upper double, n bigint")
    edges = histogram_edges(float(r["lo"]), float(r["hi"]), bins)
    counts = (df.where(x.isNotNull()).groupBy(_bin_of(x, edges).alias("bin")).agg(F.count(F.lit(1)).alias("n")))
    frame = spark.createDataFrame([(i, edges[i], edges[i + 1]) for i in range(bins)], "bin int, lower double, upper double")
    return frame.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_by(df: DataFrame, col: str, group: str, bins: int = 20) -> DataFrame:
    """one histogram per colour group, each over the group's own range.

    Group ranges come from one aggregate and are joined back (broadcast when counted to be few); the bin is then a column expression of the row and its
    group's range, so each row is binned where it sits.
    """
    x = present(_q(col))
    d = df.where(x.isNotNull() & ~absent(df, group)).select(_q(group).alias("g"), x.alias("x"))
    rng = d.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    rng = rng.select("g", F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                     F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    rng = rng.withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(bins)))
    rng = small_side(rng)
    j = d.join(rng, "g")
    code = F.lit(0)
    for i in range(1, bins):
        code = code + F.when(F.col("x") >= F.lit(i) * F.col("step") + F.col("lo"), 1).otherwise(0)
    counts = j.groupBy("g", code.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    frame = rng.select("g", "lo", "hi", "step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    frame = frame.select("g", "bin", (F.col("bin") * F.col("step") + F.col("lo")).alias("lower"),
                         F.when(F.col("bin") == bins - 1, F.col("hi"))
                          .otherwise((F.col("bin") + 1) * F.col("step") + F.col("lo")).alias("upper"))
    return (frame.join(counts, ["g", "bin"], "left")
                 .select(F.col("g").alias(group), "bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n")))


def box_stats(df: DataFrame, y: str, group: str | None = None) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR of the box) and the
    number of outliers, overall or per group. Quartiles come from one (grouped) exact-quantile job;
    the fences are joined back and a second aggregate finds whiskers and outliers."""
    keys = [group] if group else []
    d = df.where(~absent(df, y) & (~absent(df, group) if group else F.lit(True)))
    x = _q(y).cast("double")
    j = d.select(*[_q(k) for k in keys], x.alias("x"))
    if group:
        qt = grouped_quantiles(d, keys, y, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
        qt = qt.withColumn("iqr", F.col("q3") - F.col("q1"))
        qt = qt.withColumn("lo_fence", F.col("q1") - 1.5 * F.col("iqr")).withColumn("hi_fence", F.col("q3") + 1.5 * F.col("iqr"))
        j = j.join(small_side(qt), keys)
    else:  # overall: the quartiles are three numbers, carried as literals
        q1, med, q3 = exact_quantiles(d, [y], [0.25, 0.5, 0.75])[y]
        if q1 is None:
            return d.sparkSession.createDataFrame([], "q1 double, median double, q3 double, iqr double, "
                                                      "whisker_low double, whisker_high double, n_outliers bigint, n bigint")
        iqr = q3 - q1
        j = j.select("x", F.lit(q1).alias("q1"), F.lit(med).alias("median"), F.lit(q3).alias("q3"),
                     F.lit(iqr).alias("iqr"), F.lit(q1 - 1.5 * iqr).alias("lo_fence"), F.lit(q3 + 1.5 * iqr).alias("hi_fence"))
    inside = (F.col("x") >= F.col("lo_fence")) & (F.col("x") <= F.col("hi_fence"))
    agg = j.groupBy(*[_q(k) for k in keys], "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.sum((~inside).cast("long")).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"))
    return agg


def category_counts(df: DataFrame, col: str) -> DataFrame:
    """count per category and its share of the counted rows, largest first (ties by value)."""
    c = _q(col)
    counts = df.where(c.isNotNull()).groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("n"))
    total = df.where(c.isNotNull()).count()
    return counts.select(col, "n", (F.col("n") / F.lit(float(total)) * 100.0).alias("share_pct")).orderBy(
        F.col("n").desc(), F.col(col).asc())


def point_series(df: DataFrame, x: str, y: str, color: str | None = None, id_col: str | None = None,
                 fraction: float | None = None, max_points: int | None = None) -> DataFrame:
    """the (x, y, colour) points of a scatter / line / bar chart.

    Sampling is the feature of a scatter over a big table, and it is hash-deterministic:
    ``fraction`` keeps each row whose draw u(id) is below it; ``max_points`` keeps exactly the N rows
    with the smallest draws (ties by id), a top-k that each partition reduces to N rows before the merge.
    """
    cols = [_q(x), _q(y)] + ([_q(color)] if color else [])
    d = df
    if fraction is not None or max_points is not None:
        if id_col is None:
            raise ValueError("sampling needs an id column")
        d = d.withColumn("_sample_u", uniform(id_col, SALT_SAMPLE, 0))
        if fraction is not None:
            d = d.where(F.col("_sample_u") < F.lit(float(fraction)))
        if max_points is not None:
            d = d.orderBy("_sample_u", id_col).limit(int(max_points))
    return d.select(*([_q(id_col)] if id_col else []), *cols)
