from pyspark.sql import functions as F

from causeway.functions.ranks import ranked


def test_ranks_follow_the_order_whatever_the_layout(spark):
    rows = [(i, (i * 7919) % 1000, None if i % 50 == 0 else i % 3) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, v long, g int")
    want = [r[0] for r in sorted(rows, key=lambda r: (-r[1], r[0]))]
    for parts in (1, 5):
        out = ranked(df.repartition(parts), [F.desc("v"), F.asc("id")])
        assert out.columns == ["id", "v", "g", "rank"]
        assert [r.id for r in sorted(out.collect(), key=lambda r: r.rank)] == want
        assert out.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first() == (1, 5000, 5000)
    assert ranked(df.where("false"), [F.asc("id")]).count() == 0
