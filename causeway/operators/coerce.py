"""Type coercion, projections and encodings. All single projections or one aggregate."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Upper-cased spellings read as booleans, and their integers.
BOOL_TRUE = ("TRUE", "T", "1", "1.0")
BOOL_FALSE = ("FALSE", "F", "0", "0.0")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def bools_to_int(df: DataFrame) -> DataFrame:
    """B1: boolean columns become 0/1 integers, in one select."""
    return df.select(*[(_q(f.name).cast("int") if isinstance(f.dataType, T.BooleanType) else _q(f.name)).alias(f.name)
                       for f in df.schema.fields])


def text_bool_columns(df: DataFrame, allow_null: bool = False) -> list[str]:
    """B2 detection: string columns whose every value, upper-cased, is a boolean spelling.

    One aggregate over all string columns. A missing value is not a spelling, so a column with
    missing values does not qualify unless ``allow_null``.
    """
    strs = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not strs:
        return []
    keys = BOOL_TRUE + BOOL_FALSE
    aggs = []
    for i, c in enumerate(strs):
        bad = ~F.upper(_q(c)).isin(*keys)
        if not allow_null:
            bad = F.coalesce(bad, F.lit(True))
        aggs.append(F.max(bad.cast("int")).alias(f"b{i}"))
    row = df.agg(*aggs).collect()[0]
    return [c for i, c in enumerate(strs) if not row[f"b{i}"]]


def text_bools_to_int(df: DataFrame, allow_null: bool = False) -> DataFrame:
    """B2: convert qualifying text columns to 0/1 integers."""
    conv = set(text_bool_columns(df, allow_null))
    out = []
    for f in df.schema.fields:
        c = _q(f.name)
        if f.name in conv:
            u = F.upper(c)
            c = F.when(u.isin(*BOOL_TRUE), F.lit(1)).when(u.isin(*BOOL_FALSE), F.lit(0))
        out.append(c.alias(f.name))
    return df.select(*out)


def coerce_booleans(df: DataFrame, allow_null: bool = False) -> DataFrame:
    """B1 then B2, as on load."""
    return text_bools_to_int(bools_to_int(df), allow_null)


def split_types(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names from the schema; no job."""
    num = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    return num, [f.name for f in df.schema.fields if f.name not in num]


def cast_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """B4."""
    return df.select(*[(_q(c).cast(types[c]) if c in types else _q(c)).alias(c) for c in df.columns])


def encode_treatment(df: DataFrame, col: str, treat_value, control_value=None, others: str = "drop",
                     out: str = "Treatment_Encoded") -> DataFrame:
    """Two chosen values of a categorical treatment -> 1 / 0.

    ``others="drop"`` keeps only rows holding one of the two values (a valid comparison);
    ``"control"`` maps every other value to 0.
    """
    if control_value is not None and treat_value == control_value:
        raise ValueError("treatment and control values must differ")
    c = _q(col)
    if others == "control" or control_value is None:
        return df.withColumn(out, F.when(c == F.lit(treat_value), 1).otherwise(0))
    if others != "drop":
        raise ValueError("others must be 'drop' or 'control'")
    return (df.where(c.isin(treat_value, control_value))
              .withColumn(out, F.when(c == F.lit(treat_value), 1).otherwise(0)))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct values (partial aggregate per partition, then one shuffle of the distinct keys)."""
    return df.select(_q(col)).distinct()


def binary_columns(df: DataFrame, cols: list[str]) -> dict[str, bool]:
    """B7 for any number of columns in one job: which hold exactly two distinct values. A task keeps at most three
    values of a column, so no column's distinct values are shuffled. Null and NaN are missing; -0.0 is 0.0."""
    def value(c: str) -> Column:
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            return F.when(~F.isnan(_q(c)), _q(c) + F.lit(0.0)).cast("string")
        return _q(c).cast("string")

    def run(batches):
        kept = [set() for _ in cols]
        for b in batches:
            for i, seen in enumerate(kept):
                if len(seen) < 3:
                    seen.update(pc.unique(b.column(i)).slice(0, 4).to_pylist())
                    seen.discard(None)
        pairs = [(i, v) for i, seen in enumerate(kept) for v in sorted(seen)[:3]]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], pa.int32()),
                                              pa.array([v for _, v in pairs], pa.string())], names=["i", "v"])

    few = df.select(*[value(c).alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "i int, v string")
    n = {r["i"]: r["n"] for r in few.groupBy("i").agg(F.count_distinct("v").alias("n")).collect()}
    return {c: n.get(i, 0) == 2 for i, c in enumerate(cols)}


def is_binary(df: DataFrame, col: str) -> bool:
    """Exactly two distinct values."""
    return binary_columns(df, [col])[col]


def add_interactions(df: DataFrame, pairs: list[tuple[str, ...]]) -> DataFrame:
    """Product columns named a_x_b(_x_c)."""
    return df.select("*", *[reduce(lambda a, b: a * b, [_q(c) for c in p]).alias("_x_".join(p)) for p in pairs])


def column_bind(df: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """A column bind of the same frame is a projection."""
    return df.select(*[_q(c) for c in dict.fromkeys([*left, *right])])


def drop_missing(df: DataFrame, subset: list[str]) -> DataFrame:
    """B11."""
    return df.dropna(subset=subset)


def one_hot(df: DataFrame, cols: list[str], drop_last: bool = True, max_levels: int | None = None) -> tuple[DataFrame, list[str]]:
    """Text confounders as 0/1 columns ``<col>_<level>``, levels sorted, the last one the reference.

    Levels come from one distinct aggregate; with ``max_levels`` a column of more levels is an error, never silently
    truncated. Missing values are a level of their own, ``<col>_missing``. Levels whose names would clash are numbered.
    Returns the frame and the names of the new columns.
    """
    new, names = [], []
    for c in cols:
        found = df.select(_q(c).cast("string").alias("v")).distinct()
        got = [r[0] for r in (found if max_levels is None else found.limit(max_levels + 2)).collect()]
        levels = sorted(v for v in got if v is not None)
        if max_levels is not None and len(levels) > max_levels:
            raise ValueError(f"column {c!r} has more than {max_levels} levels")
        keep = levels[:-1] if drop_last else levels
        for lv in keep:
            name = plain = f"{c}_{lv}".replace(" ", "_").replace("-", "_")
            k = 2
            while name in names or name in df.columns:
                name, k = f"{plain}_{k}", k + 1
            new.append(F.when(_q(c).cast("string") == F.lit(lv), 1).otherwise(0).alias(name))
            names.append(name)
        if None in got and levels:
            new.append(F.when(_q(c).isNull(), 1).otherwise(0).alias(f"{c}_missing"))
            names.append(f"{c}_missing")
    return df.select("*", *new), names
