"""CSV read in splits: quoted line feeds across split borders, many tasks for one file."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import coerce as B
from causeway.sources import io


def _write(path, rows, newline="\n"):
    with open(path, "w", newline="") as f:
        w = csv.writer(f, lineterminator=newline)
        w.writerow(["id", "text", "n"])
        w.writerows(rows)


def _split(spark, size):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, str(size))
    return before


@pytest.mark.parametrize(("size", "newline"), [(64, "\n"), (700, "\r\n"), (5000, "\n"), (1 << 27, "\n")])
def test_records_over_split_borders(spark, tmp_path, size, newline):
    rng = random.Random(size)
    pieces = ["a", "say \"hi\"", ",", "\n", "\n\n", "é", "line\nfeed", "\"", "x" * 40, "\r\n" if newline == "\r\n" else " "]
    rows = [(i, "t" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))), i * 2) for i in range(120)]
    rows.append((120, "long " + "\n\"q\"\n" * 900, 7))
    rows.append((121, "after", 8))
    (tmp_path / "d").mkdir()
    _write(tmp_path / "d" / "a.csv", rows[:60], newline)
    _write(tmp_path / "d" / "b.csv", rows[60:], newline)
    _write(tmp_path / "d" / "c.csv", [], newline)
    before = _split(spark, size)
    try:
        df = io.read_csv(spark, str(tmp_path / "d"), "id long, text string, n int", normalize=False)
        assert sorted(map(tuple, df.collect())) == rows
        assert dict(io.read_csv(spark, str(tmp_path / "d")).dtypes)["n"] == "int"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_file_is_read_by_many_tasks(spark, tmp_path):
    _write(tmp_path / "one.csv", [(i, f"word {i}\nnext \"{i}\"", i) for i in range(60_000)])
    before = _split(spark, 200_000)
    try:
        df = io.read_csv(spark, str(tmp_path / "one.csv"), "id long, text string, n int")
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks >= 8 and df.agg(F.sum("n"), F.count("*")).first()[:] == (60_000 * 59_999 // 2, 60_000)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_open_quote_is_an_error(spark, tmp_path):
    (tmp_path / "bad.csv").write_text('id,text,n\n1,"never closed,2\n3,x,4\n')
    with pytest.raises(Exception, match="not closed"):
        io.read_csv(spark, str(tmp_path / "bad.csv"), "id long, text string, n int").collect()


def test_binary_columns_in_one_job(spark):
    df = spark.createDataFrame([(1, 0.0, "a", None, float("nan"), True), (1, -0.0, "b", None, 1.0, False), (2, 0.0, None, None, 2.0, None),
                                (2, 0.0, "a", None, 1.0, True)], "a int, b double, c string, d int, e double, f boolean")
    assert B.binary_columns(df, df.columns) == {"a": True, "b": False, "c": True, "d": False, "e": True, "f": True}
    assert B.binary_columns(spark.range(1000).repartition(7), ["id"]) == {"id": False}
    assert B.binary_columns(df.where("a > 5"), ["a"]) == {"a": False}
