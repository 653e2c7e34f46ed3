"""Query catalog: one Spark query per operator of the inventory, each with its DuckDB oracle.

Each query takes (spark, sf_dir), reads the given tables (or frames Spark derives from them) in
full and returns a DataFrame. ``SQL[name]`` is the same computation as DuckDB SQL over the same
parquet tables; omitted where the operator is not SQL-expressible (forests, logistic
propensity, iterative refits). Doubles are rounded the same way on both sides, since summation
order differs between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rnd(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating column (the oracle rounds the same columns the same way)."""
    return df.select(*[(F.round(F.col(f"`{f.name}`"), digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                        else F.col(f"`{f.name}`")).alias(f.name) for f in df.schema.fields])


# importing the modules registers their queries
from causeway.plans import queries_basic  # noqa: E402,F401
from causeway.plans import queries_eda  # noqa: E402,F401
from causeway.plans import queries_models  # noqa: E402,F401
from causeway.plans import queries_effects  # noqa: E402,F401
from causeway.plans import queries_learners  # noqa: E402,F401
