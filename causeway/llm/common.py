"""Shared pieces: the query table, reading inputs, cutting lineage in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A word: a run of anything but the ASCII blanks x20 and x09-x0D.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"

#: Settings while a table is written: shuffle files go when they have been read, and what goes to a Python worker at
#: once is counted in bytes of text, not in rows.
_WHILE_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
                  "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the session's checkpoint folder (shared by driver and executors) and read it
    back: the lineage ends there, and lost executors cost no recomputation. Column-wise files are several times
    smaller than a checkpoint of rows, and unlike one they carry no constraints along, which a loop would multiply. The shuffle files behind it go as soon as it is written. The table lives as long as
    the checkpoint folder."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE_WRITING}
    try:
        for k, v in _WHILE_WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(table: DataFrame) -> None:
    """Delete a table that ``saved`` wrote, once what was made of it is saved itself and nothing reads it any more."""
    sc = table.sparkSession.sparkContext
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        kept, name = folder.rsplit("/", 1)
        if not kept.endswith("/tables"):
            raise ValueError(f"not a saved table: {folder}")
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{sc.getCheckpointDir()}/tables/{name}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
