"""A1-A3: read a table (CSV with header, parquet), write it back, preview it.

Pandas reads many spellings as missing and turns NaN into a missing value; Spark keeps NaN as a
value and takes only one ``nullValue`` token. ``normalize_missing`` makes both into SQL NULL in
one projection so averages, counts and filters follow the pandas semantics.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.sources.records import records

# Text tokens pandas' CSV reader treats as missing by default.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
                  "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
             normalize: bool = True) -> DataFrame:
    """A1: header row in every file; quotes are doubled inside quoted fields, which may hold line feeds, and files are
    read by many tasks all the same (``records``). Without a schema the types are inferred in one extra pass, after
    missing tokens have become null, so a number column with ``NA`` stays one."""
    if schema is None:
        header = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        text = _parsed(spark, path, schema)
        text = normalize_missing(text) if normalize else text
        return normalize_missing(cast_inferred(text)) if normalize else cast_inferred(text)
    df = _parsed(spark, path, T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)
    return normalize_missing(df) if normalize else df


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("record", ddl, {"escape": '"', "mode": "FAILFAST", "multiLine": "true"})
    return records(spark, path).select(row.alias("r")).select("r.*")


# Types tried for a text column, narrowest first.
INFERRED = ("int", "bigint", "double", "boolean", "date", "timestamp_ntz")
_SHAPE = {"int": r"^[+-]?\d+$", "bigint": r"^[+-]?\d+$", "double": r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|Infinity|NaN)$",
          "boolean": "^(?i)(true|false)$", "date": r"^\d{4}-\d\d-\d\d$", "timestamp_ntz": r"^\d{4}-\d\d-\d\d[ T]\d\d:\d\d(:\d\d(\.\d+)?)?$"}


def cast_inferred(df: DataFrame) -> DataFrame:
    """Text columns as the first of INFERRED that takes all their values (one aggregate over the table); a column
    without values, or with any that none takes, stays text."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not names:
        return df
    col = {n: F.col(f"`{n}`") for n in names}
    fits = {(i, t): F.sum(F.when(col[n].rlike(_SHAPE[t]) & col[n].try_cast(t).isNotNull(), 1).otherwise(0)).alias(f"{i}_{t}")
            for i, n in enumerate(names) for t in INFERRED}
    got = df.agg(*[F.count(col[n]).alias(f"{i}_n") for i, n in enumerate(names)], *fits.values()).first()
    kinds = {n: next((t for t in INFERRED if got[f"{i}_n"] and got[f"{i}_{t}"] == got[f"{i}_n"]), None) for i, n in enumerate(names)}
    return df.select(*[(F.col(f"`{c}`").cast(kinds[c]) if kinds.get(c) else F.col(f"`{c}`")).alias(c) for c in df.columns])


def normalize_missing(df: DataFrame) -> DataFrame:
    """NaN -> NULL for floating columns, missing tokens -> NULL for text columns; one projection."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c.isin(*MISSING_TOKENS), F.lit(None).cast("string")).otherwise(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A2: header, no index; one file per partition, written by the executors (no collect)."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """A3: first n rows by an explicit order (Spark has no implicit row order); a top-k, not a sort."""
    return df.orderBy(F.col(order_by)).limit(n)
