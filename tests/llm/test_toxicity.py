import zlib

from causeway.llm import toxicity as X


def test_folding():
    assert X.fold("Іd​10T, lоs3r").split() == ["idiot", "loser"]
    assert X.fold("ＴＲＡＳＨ")[1:] == "trash"


def test_matching_counts_once_and_skips_exceptions():
    m = X.Matcher({" idio": 2.0, " idiot ": 3.0, " trash": 1.0}, X.EXCEPTIONS)
    one, two = m.features("an idiot"), m.features("an idiot, an 1d10t")
    assert two[0] > one[0] > 0
    assert m.features("the trash can is full") == (0.0, 0.0) and m.features("trash talk")[0] > 0
    assert m.features("videotrash")[0] == 0 and m.features("") == (0.0, 0.0)
    assert m.features("idiot " + "word " * 20_000)[1] < one[1]


def test_learned_scores_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    from causeway.llm.registry import QUERIES
    got = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, d).collect()}
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, clean = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(s >= 0.5 for s in toxic) >= 0.9 * len(toxic) > 0
    assert sum(s >= 0.5 for s in clean) <= 0.02 * len(clean)


def test_edge_cases(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "idiot " * 50_000), (3, "idiot"), (None, "x")], schema).selectExpr(
        "*", "1 AS x1", "2 AS score")
    model = X.Model({" idiot": 3.0}, (-4.0, 5.0, 0.5))
    rows = X.score(docs, model).collect()
    assert len(rows) == 5 and {r.score < 0.5 for r in rows if r.doc_id in (1, 2)} == {True}
    assert all(r.predicted == 1 for r in rows if r.doc_id == 3)
    assert X.score(spark.createDataFrame([], schema), model).count() == 0
    none = X.fit(spark.createDataFrame([], "text string, toxic int"))
    assert none.weights == {} and X.score(docs, none).where("predicted = 1").count() == 0
    one = X.fit(spark.createDataFrame([("a", 0), ("b", 0)], "text string, toxic int"))
    assert one.weights == {}
