"""Pattern 5: exact quantiles (linear interpolation between order statistics) at any scale.

All order statistics that a call asks for, of all its columns and groups, are selected together. A cell is a column of a
group. The first aggregate counts each cell's values by binade (sign and exponent, so a bin's values differ by less than
a factor of two whatever the distribution) with the least and largest value of each bin; a running count over a cell's
few thousand bins tells which bin holds each wanted rank. The next aggregates read only the rows inside those brackets
and cut each bracket into BINS parts, or into its single values once it holds at most QUANTILE_LIMIT rows. A bracket whose least
and largest value are equal is an answer. A binade has 2^52 numbers and BINS is 2^12, so six aggregates always do, and
two or three usually.

Only counts by bin shuffle, keyed by cell and bin: neither a hot cell nor a column is ever held by one task. The
brackets, one row for each cell and wanted rank, are collected and broadcast while they are at most BRACKETS, and are a
stored table beyond.

Null and NaN are missing; infinities are values. A cell without values has null quantiles.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.session import materialize

QUANTILE_LIMIT = 20_000
BINS = 4096
BRACKETS = 10_000
_VALUE = "_value"


def present(c: Column) -> Column:
    """The column as double, null where it is NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def _binade(v: Column) -> Column:
    """Order-preserving bin: sign and exponent; zero and the infinities on their own."""
    size = F.abs(v)
    place = F.when(size == 0, F.lit(0)).when(size == math.inf, F.lit(3000)).otherwise(F.floor(F.log2(size)) + 1100)
    return F.signum(v) * place


def _bracketed(bins: DataFrame, by: list[str], wanted: Column, keep_empty: bool) -> DataFrame:
    """From counts by bin (n, mn, mx) and ``wanted``, an array of (t, k) by cell or bracket, the bins that hold a wanted
    rank, with the ranks counted from the bin's start."""
    order = Window.partitionBy(*by).orderBy("mn")
    below = F.sum("n").over(order) - F.col("n")
    held = F.transform(F.filter("wanted", lambda w: (w["k"] >= F.col("below")) & (w["k"] < F.col("below") + F.col("n"))),
                       lambda w: F.struct(w["t"].alias("t"), (w["k"] - F.col("below")).alias("k")))
    out = bins.withColumn("below", below).withColumn("wanted", wanted).withColumn("wanted", held)
    rows = F.size("wanted") > 0
    return out.where(rows | (F.col("total") == 0) if keep_empty else rows).drop("below")


def _ranks(total: Column, qs: list[float]) -> Column:
    """(t, k): for quantile i the ranks 2i and 2i + 1 it lies between, counted from 0."""
    out = []
    for i, q in enumerate(qs):
        h = (total - 1) * F.lit(float(q))
        low = F.floor(h)
        out.append(F.struct(F.lit(2 * i).alias("t"), low.alias("k")))
        out.append(F.struct(F.lit(2 * i + 1).alias("t"), F.least(low + 1, total - 1).alias("k")))
    return F.array(*out)


class _State:
    """Brackets by cell: rows on the driver while they are few, else a stored table."""

    def __init__(self, table: DataFrame):
        self.schema, self.spark = table.schema, table.sparkSession
        self.rows = table.limit(BRACKETS + 1).collect()
        self.few = len(self.rows) <= BRACKETS
        self.table = None if self.few else materialize(table)

    def part(self, done: bool) -> DataFrame | None:
        """The answered brackets, or the open ones; None if there are none."""
        if self.few:
            rows = [r for r in self.rows if (r["mn"] == r["mx"] or r["mn"] is None) == done]
            return self.spark.createDataFrame(rows, self.schema) if rows else None
        is_done = F.coalesce(F.col("mn") == F.col("mx"), F.lit(True))
        part = self.table.where(is_done if done else ~is_done)
        return None if part.isEmpty() else part


def quantiles_by(df: DataFrame, cells: list[str], value: str, qs: list[float], names: list[str],
                 quantile_limit: int = QUANTILE_LIMIT) -> DataFrame:
    """One row for each combination of ``cells`` (none: one row): the columns ``names`` with the quantiles ``qs`` of
    ``value``. At most six aggregates over ``df``, whatever the number of cells, quantiles and rows."""
    if not cells:  # one cell, as a key of the rows: brackets are joined by it
        one = df.select(F.explode(F.array(F.lit(0))).alias("_all"), F.col(f"`{value}`").alias(_VALUE))
        return quantiles_by(one, ["_all"], _VALUE, qs, names, quantile_limit).drop("_all")
    keys = [f"_cell{i}" for i in range(len(cells))]
    values = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(cells, keys)], present(F.col(f"`{value}`")).alias(_VALUE))
    v = F.col(_VALUE)
    bins = values.groupBy(*keys, _binade(v).alias("bin")).agg(F.count(v).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx"))
    bins = bins.withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    state = _State(_bracketed(bins, keys, _ranks(F.col("total"), qs), True).drop("bin"))
    found = []
    while True:
        if (answered := state.part(True)) is not None:
            found.append(answered)
        if (left := state.part(False)) is None:
            break
        left = left.select(*keys, "total", F.col("n").alias("held"), F.col("mn").alias("lo"), F.col("mx").alias("hi"), "wanted")
        bounds = left.select(*[F.col(k).alias(f"_of{k}") for k in keys], "lo", "hi", "held")
        same = [values[k].eqNullSafe(F.col(f"_of{k}")) for k in keys]
        inside = reduce(lambda a, b: a & b, [*same, v >= F.col("lo"), v <= F.col("hi")])
        step = F.least(F.floor((v - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("double")
        rows = values.join(F.broadcast(bounds) if state.few else bounds, inside)
        bins = rows.groupBy(*keys, "lo", "hi", F.when(F.col("held") <= quantile_limit, v).otherwise(step).alias("bin")).agg(
            F.count(v).alias("n"), F.min(v).alias("mn"), F.max(v).alias("mx")).drop("bin")
        of = left.withColumnsRenamed({k: f"_of{k}" for k in keys} | {"lo": "_lo", "hi": "_hi", "wanted": "_wanted"}).drop("held")
        on = reduce(lambda a, b: a & b, [*(bins[k].eqNullSafe(of[f"_of{k}"]) for k in keys),
                                         bins["lo"] == of["_lo"], bins["hi"] == of["_hi"]])
        bins = bins.join(F.broadcast(of) if state.few else of, on).drop("_lo", "_hi", *[f"_of{k}" for k in keys])
        state = _State(_bracketed(bins, [*keys, "lo", "hi"], F.col("_wanted"), False).select(
            *keys, "n", "mn", "mx", "total", "wanted"))
    if not found:
        rows = df.sparkSession.createDataFrame([], values.select(*keys).schema)
        return rows.select(*[F.col(k).alias(c) for k, c in zip(keys, cells)], *[F.lit(None).cast("double").alias(n) for n in names])
    answers = reduce(DataFrame.unionByName, found).select(*keys, "total", "mn", F.explode_outer("wanted").alias("w"))
    at = [F.max(F.when(F.col("w.t") == t, F.col("mn"))).alias(f"at{t}") for t in range(2 * len(qs))]
    answers = answers.groupBy(*keys, "total").agg(*at)
    out = []
    for i, (q, name) in enumerate(zip(qs, names)):
        h = (F.col("total") - 1) * F.lit(float(q))
        low, high = F.col(f"at{2 * i}"), F.col(f"at{2 * i + 1}")
        out.append(F.when(low == high, low).otherwise(low + (high - low) * (h - F.floor(h))).alias(name))
    return answers.select(*[F.col(k).alias(c) for k, c in zip(keys, cells)], *out)


def exact_quantiles(df: DataFrame, cols: list[str], qs: list[float], quantile_limit: int = QUANTILE_LIMIT, approx: bool = False,
                    accuracy: int = 10000) -> dict[str, list[float | None]]:
    """{col: [q-th quantile for q in qs]} over the values present, linear interpolation, all columns and quantiles
    together.

    ``approx=True`` (opt-in) uses ``percentile_approx`` in one pass instead: a value of the column
    within rank error 1/accuracy, no interpolation."""
    if not cols:
        return {}
    if approx:
        arr = F.array(*[F.lit(float(q)) for q in qs])
        r = df.agg(*[F.percentile_approx(present(F.col(f"`{c}`")), arr, accuracy).alias(f"p{i}")
                     for i, c in enumerate(cols)]).collect()[0]
        return {c: (list(r[f"p{i}"]) if r[f"p{i}"] is not None else [None] * len(qs)) for i, c in enumerate(cols)}
    names = [f"p{i}" for i in range(len(qs))]
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v"))
                                         for i, c in enumerate(cols)])).alias("s")).select("s.c", "s.v")
    got = {r["c"]: [r[n] for n in names] for r in quantiles_by(long, ["c"], "v", qs, names, quantile_limit).collect()}
    return {c: got.get(i, [None] * len(qs)) for i, c in enumerate(cols)}
