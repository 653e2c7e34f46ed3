"""Positions of rows in a total order, without one task or one window over the table.

The table is sorted once (Spark's range partitions), every row gets its place in its partition, and the partitions'
row counts, one number each, give the offsets. The sorted rows are stored before they are counted, so a lost executor
cannot deal them anew. Order by a unique last key where rows may tie: equal rows take their places in any order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.session import materialize

_PLACE = 33  # monotonically_increasing_id holds the place in the partition in its low 33 bits


def ranked(df: DataFrame, order: list[Column], rank: str = "rank",
           store: Callable[[DataFrame], DataFrame] = materialize) -> DataFrame:
    """``df`` with ``rank``: 1, 2, 3, ... in ``order``."""
    if rank in df.columns:
        raise ValueError(f"{rank} is a column already")
    return numbered(store(df.orderBy(*order).withColumn(rank, F.monotonically_increasing_id())), rank)


def numbered(stored: DataFrame, mark: str) -> DataFrame:
    """``stored`` rows whose ``mark`` was monotonically_increasing_id, with their positions from 1 in its place."""
    part = F.shiftright(F.col(mark), _PLACE)
    counts = sorted((r["part"], r["n"]) for r in
                    stored.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, offsets = 0, []
    for p, n in counts:
        offsets.append((p, before))
        before += n
    if not offsets:
        return stored
    # a row for each partition of the sort
    table = stored.sparkSession.createDataFrame(offsets, "_part long, _before long")
    place = F.col(mark).bitwiseAND(F.lit((1 << _PLACE) - 1))
    return (stored.withColumn("_part", part).join(F.broadcast(table), "_part")
            .withColumn(mark, F.col("_before") + place + 1).drop("_part", "_before"))
