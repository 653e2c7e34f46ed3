import re
from collections import defaultdict

from causeway.llm import source_mix as M


def plain_targets(sizes):
    """Reshare by weight, again and again, until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        w = sum(weight[s] for s in free)
        share = {s: left * weight[s] / w for s in free}
        above = [s for s in free if share[s] > M.MOST * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: M.MOST * sizes[s] for s in above}


def check(rows, texts):
    sizes = defaultdict(int)
    for i, t, s in texts:
        sizes[s] += len(re.findall(M.WORD, t or ""))
    target = plain_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) <= 1e-6 * (1 + r["target"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        longest = max(len(re.findall(M.WORD, t or "")) for i, t, x in texts if x == s)
        assert abs(taken[s] - target[s]) <= 0.51 * longest + 1e-6 * target[s], s


def test_targets_and_rounding_with_nulls_ties_and_copies(spark):
    texts = [(i, "w " * (i % 7 + 1), f"s{i % 5}") for i in range(400)]
    texts += [(1000 + i, "same text here", "hot") for i in range(900)]
    texts += [(2000, None, None), (2001, "", "void"), (2002, "x" * 300_000, None), (2003, "a\x0bb\x1cc\u00a0d é", None)]
    texts += [(2004, "dup row", "s1")] * 3 + [(None, "no id", "s2")]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS rate")
    rows = M.mix(df).collect()
    assert len(rows) == len(texts)
    check(rows, texts)
    again = M.mix(df.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_query_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(M.mix(docs).collect(), [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0 and M.apply_mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in M.mix(blank).collect()] == [(0.0, 0)] * 2


def test_applied_mix_repeats_documents(spark):
    docs = spark.createDataFrame([(i, "one two three", "ab"[i % 4 == 0]) for i in range(200)],
                                 "doc_id long, text string, source string").selectExpr("*", "doc_id AS _extra")
    copies = {r.doc_id: r.copies for r in M.mix(docs).collect()}
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id] += 1
    assert dict(got) == {k: v for k, v in copies.items() if v}


def test_a_callers_columns_stay_and_no_copy_exceeds_the_cap(spark):
    rows = [(i, f"s{i % 2}", "word " * (1 + i % 3), i, i, i) for i in range(400)] + [(1000 + i, "t", "a b", 0, 0, 0) for i in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, _id long, _copies long, _copy long")
    out = M.apply_mix(docs)
    assert out.columns == docs.columns
    assert all(r._id == r._copies == r._copy == (r.doc_id if r.doc_id < 1000 else 0) for r in out.collect())
    got = M.mix(docs, weights=(1.0, 1.0, 1000.0)).collect()
    assert max(r.copies for r in got) == 3 and all(r.copies == 3 for r in got if r.source == "t")
