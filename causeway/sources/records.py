"""CSV records from splits: one large file is read by many tasks, though quoted fields may hold line feeds.

Whether a line feed ends a record depends on the number of quotes before it. One aggregate counts the quotes of each
split; their running parity over a file says whether a split begins inside a quoted field. With that each split finds
its own records; the pieces of a record that runs over splits, at most two a split, are joined by one small group.
Quotes inside fields must be doubled and such fields quoted (RFC 4180), as ``write_csv`` and pandas do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.option("lineSep", "\n").text(path).select(
        m["file_path"].alias("file"), m["file_block_start"].alias("start"), "value")


def _open_splits(lines: DataFrame) -> DataFrame:
    """(file, start, open): a row for each split; ``open`` is 1 where it begins inside a quoted field."""
    n = F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))
    splits = lines.groupBy("file", "start").agg(F.sum(n).alias("n"))
    over = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return splits.select("file", "start", (F.coalesce(F.sum("n").over(over), F.lit(0)) % 2).cast("int").alias("open"))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of splits, each split's together and in order, as records. ``whole`` is false for a piece: ``begins`` where
    its record begins in it, ``ends`` where it ends. A file's first record, the header, is left out."""
    at, state, held, begins, header = None, 0, [], True, False

    def piece(ends: bool) -> tuple:
        return (*at, "\n".join(held), begins and ends, begins, ends)

    for b in batches:
        out = []
        files, starts, opens = (b.column(i).to_pylist() for i in (0, 1, 2))
        texts, quotes = b.column(3).to_pylist(), pc.count_substring(b.column(3), QUOTE).to_numpy()
        for file, start, opened, text, n in zip(files, starts, opens, texts, quotes, strict=True):
            if at != (file, start):
                if held:
                    out.append(piece(False))
                at, state, held, begins, header = (file, start), opened, [], not opened, start == 0
            held.append(text)
            state = (state + int(n)) % 2
            if not state:
                if not header:
                    out.append(piece(True))
                held, begins, header = [], True, False
        if out:
            yield _batch(out)
    if held:
        yield _batch([piece(False)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["file", "start", "record", "whole", "begins", "ends"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record): the text of each record of the files at ``path`` but their headers and empty lines. A file that ends
    inside a quoted field is an error."""
    lines = _lines(spark, path)
    # a row for each split of the input
    placed = lines.join(F.broadcast(_open_splits(lines)), ["file", "start"]).select("file", "start", "open", "value")
    found = placed.mapInArrow(_found, "file string, start long, record string, whole boolean, begins boolean, ends boolean")
    pieces = found.where("NOT whole")
    # within a split a piece that ends a record comes before the one that begins the next
    order = Window.partitionBy("file").orderBy("start", F.desc("ends")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = (pieces.withColumn("nth", F.sum(F.col("begins").cast("int")).over(order)).groupBy("file", "nth")
              .agg(F.array_sort(F.collect_list(F.struct("start", "record"))).alias("p"), F.max("ends").alias("ends"))
              .select(F.when(F.col("ends"), F.array_join(F.transform("p", lambda x: x["record"]), "\n"))
                      .otherwise(F.raise_error(F.concat(F.lit("a quoted field is not closed in "), "file"))).alias("record")))
    every = found.where("whole").select("record").unionByName(joined)
    return every.select(F.regexp_replace("record", "\r$", "").alias("record")).where("record <> ''")
