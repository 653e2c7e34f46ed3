"""The seven row filters and the before/after row counts.

Each filter is one predicate, so Catalyst pushes it into the parquet scan when it sits on a
source column. ``!=`` keeps missing values (pandas comparison semantics); ``contains`` is a
regular-expression search on the value as text, and a missing value never matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPS = ("==", "!=", ">", "<", ">=", "<=", "contains")


def predicate(col: str, op: str, value, literal: bool = False) -> Column:
    c = F.col(f"`{col}`")
    v = F.lit(value)
    if op == "==":
        return c == v
    if op == "!=":
        return ~c.eqNullSafe(v)
    if op == ">":
        return c > v
    if op == "<":
        return c < v
    if op == ">=":
        return c >= v
    if op == "<=":
        return c <= v
    if op == "contains":
        s = c.cast("string")
        m = s.contains(str(value)) if literal else s.rlike(str(value))
        return F.coalesce(m, F.lit(False))
    raise ValueError(f"unknown filter operator {op!r}; one of {OPS}")


def filter_rows(df: DataFrame, col: str, op: str, value, literal: bool = False) -> DataFrame:
    return df.where(predicate(col, op, value, literal))


def filter_counts(df: DataFrame, col: str, op: str, value, literal: bool = False) -> DataFrame:
    """Rows before and after the filter, one aggregate."""
    p = predicate(col, op, value, literal)
    return df.agg(F.count(F.lit(1)).alias("rows_before"), F.sum(p.cast("long")).alias("rows_after"))
