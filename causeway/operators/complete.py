"""Rows an estimator can use, and joins on confounder cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.spec import CausalSpec

#: Rows of a table by group or cell that may be broadcast.
BROADCAST_ROWS = 10_000


def absent(df: DataFrame, column: str) -> Column:
    """Missing: null, or NaN in a floating column."""
    c = F.col(f"`{column}`")
    return c.isNull() | F.isnan(c) if absent_possible(df, column) else c.isNull()


def absent_possible(df: DataFrame, column: str) -> bool:
    """A column that can hold NaN."""
    return isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))


def usable_rows(df: DataFrame, spec: CausalSpec, missing: str = "raise", more: tuple[str, ...] = ()) -> DataFrame:
    """``missing="drop"``: without the rows that miss the treatment, the outcome or one of ``more``.
    ``missing="raise"``: an error if there are such rows (one aggregate)."""
    gone = reduce(lambda a, b: a | b, [absent(df, c) for c in (spec.treatment, spec.outcome, *more)])
    if missing == "drop":
        return df.where(~gone)
    if missing != "raise":
        raise ValueError("missing must be 'raise' or 'drop'")
    n = df.agg(F.sum(F.when(gone, 1).otherwise(0))).first()[0] or 0
    if n:
        raise ValueError(f"{n} rows have a missing value in a model column; impute them or pass missing='drop'")
    return df


def small_side(table: DataFrame) -> DataFrame:
    """An aggregate of few rows as the broadcast side of a join: counted first, and left to a shuffled join (which
    Spark splits where a key is hot) beyond BROADCAST_ROWS."""
    rows = table.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return table
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def join_cells(df: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the other columns of ``cells``, a table of few rows by ``keys``; a null is a cell of its own."""
    named = small_side(cells.withColumnsRenamed({k: f"_cell_{k}" for k in keys}))
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(F.col(f"_cell_{k}")) for k in keys])
    return df.join(named, on, "left").drop(*[f"_cell_{k}" for k in keys])
