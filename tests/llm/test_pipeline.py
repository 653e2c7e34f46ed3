import random
import re
from collections import Counter

import corpus_pipeline as P
from causeway.llm import graph, ngram_join, packing, quality_rules, secret_scan, source_mix
from causeway.llm.common import saved as written
from test_ngram_join import brute as brute_groups
from test_packing import check as check_pieces
from test_quality_rules import brute as brute_quality
from test_secret_scan import PLANTED


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [len(P.STAGES), P.STAGES[1][1]] == [5, P.near_duplicates]
    before = {r.doc_id: r for r in docs.collect()}

    good = P.quality(spark, docs, d).cache()
    kept = brute_quality([(r.doc_id, r.text, r.lang, r.source) for r in before.values()])[2]
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == {i for i, k in kept.items() if k}

    single = P.near_duplicates(spark, good, d).cache()
    groups = brute_groups([(r.doc_id, r.text) for r in good.collect()], 5, 80, 100)
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in groups.items() if i == c}

    clean = P.secrets(spark, single, d).cache()
    for r in clean.collect():
        t = before[r.doc_id].text
        for v in sorted({next(g for g in (*m.groups(), m.group(0)) if g) for m in PLANTED.finditer(t)}, key=len, reverse=True):
            t = t.replace(v, secret_scan.MASK)
        assert r.text == t and r.source == before[r.doc_id].source

    mixed = P.mix(spark, clean, d).cache()
    copies = {r.doc_id: r.copies for r in source_mix.mix(clean).collect()}
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: c for i, c in copies.items() if c})

    one = mixed.dropDuplicates(["doc_id"]).cache()
    check_pieces(spark, [(r.doc_id, r.text) for r in one.collect()], P.pack(spark, one, d).collect(), packing.SIZE)


def test_run_end_to_end(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.length > 0 for r in rows)
    assert not any(re.search("AKIA[A-Z0-9]{16}", str(r)) for r in rows)


def test_empty_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_plans_hold_each_table_seldom(spark, monkeypatch):
    """What a query costs the driver grows with its plan: no stage plans a table of its own again and again."""
    reads = {}

    def recording(module):
        save = module.saved

        def saved(df):
            # leaves of the plan before Spark finds equal parts, with the columns that are written
            n = df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
            reads.setdefault((module.__name__.rpartition(".")[2], tuple(sorted(df.columns))), []).append(n)
            return save(df)
        monkeypatch.setattr(module, "saved", saved)

    for module in (graph, ngram_join, quality_rules, secret_scan):
        recording(module)
    rng = random.Random(1)
    words = [f"wort{k}" for k in range(400)]
    rows = [(k, " ".join(rng.choices(words, k=80)) + f" password=Ab{k}x9Qz8Lm{k} mail{k}@host{k}.org", "en", "s") for k in range(60)]
    rows += [(100 + k, rows[k][1].replace(" ", " x ", 1), "en", "s") for k in range(20)]
    df = written(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert quality_rules.keep_good(df).count() == 80
    assert ngram_join.keep_one(df).count() == 60
    assert graph.components(written(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long"))).count() == 4
    assert secret_scan.masked(df).where("text LIKE '%[SECRET]%'").count() > 0
    assert max(reads["graph", ("u", "v")]) <= 5  # of a round: links twice, each with its smallest neighbours
    assert max(reads["ngram_join", ("a", "b")]) <= 8
    opened = next(v for (m, c), v in reads.items() if m == "ngram_join" and "main" in c)
    assert max(opened) <= 7
    near = next(v for (m, c), v in reads.items() if m == "quality_rules" and "d2" in c)
    assert max(near) <= 3
    judged = next(v for (m, c), v in reads.items() if m == "secret_scan" and "probability" in c)
    assert max(judged) <= 3
