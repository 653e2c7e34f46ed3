import os
import random

import pytest

from causeway.llm import ngram_join as J
from causeway.llm.common import forgotten
from causeway.llm.graph import components


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(docs, n, part, whole):
    sets = [(i, shingles(t, n)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a and b and whole * both >= part * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "a b", "Über"]
    docs, line = [], " ".join(rng.choices(vocabulary, k=25))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 30, 120, 300]))
        for _ in range(rng.choice([1, 2, 8])):
            copy = [w if rng.random() > rng.choice([0, .005, .02]) else rng.choice(vocabulary) for w in base]
            docs.append(" ".join(copy).upper() if rng.random() < .2 else "\n".join(copy))
    docs += [line + " " + " ".join(rng.choices(vocabulary, k=rng.randint(2, 40))) for _ in range(20)]
    docs += [None, "", " \n\t", "one", "ONE", "one two", "one two", "one two three", "x\x0by\x1cz", "same same same same same"]
    docs += ["word " * 30_000, "word " * 20_000, "z" * 100_000]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_matches_brute_force_at_both_settings(spark):
    docs = planted()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS component", "3 AS size")
    for n, part in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, n, part, 100).collect()}
        assert got == brute(docs, n, part, 100)


def test_empty_table_and_null_ids(spark):
    assert J.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = J.jaccard_components(spark.createDataFrame(
        [(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None)], "doc_id long, text string"), 3, 90).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in rows) == [
        ("4", 1, "4"), ("4", 1, "4"), ("None", 0, "None"), ("None", 1, "4")]


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b").where("id % 50 <> 49")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}


def test_tables_go_when_they_have_been_used(spark, monkeypatch):
    made, save = [], J.saved

    def saved(df):
        out = save(df)
        made.append((out.columns, [f.rsplit("/", 1)[0].removeprefix("file:") for f in out.inputFiles()][:1]))
        return out

    monkeypatch.setattr(J, "saved", saved)
    df = spark.createDataFrame(planted(), "doc_id long, text string")
    J.jaccard_components(df, 3, 90, 100).collect()
    used = [folder for columns, folders in made for folder in folders if {"grams", "low", "main"} & set(columns)]
    assert len(used) >= 4 and not any(os.path.exists(f.replace("//", "/")) for f in used)


def test_only_saved_tables_are_deleted(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/given")
    with pytest.raises(ValueError, match="not a saved table"):
        forgotten(spark.read.parquet(f"{tmp_path}/given"))
    assert spark.read.parquet(f"{tmp_path}/given").count() == 3


def test_buckets_pairs_and_sets_are_worked_off_in_shares(spark, monkeypatch):
    docs, made, save = planted(), [], J.saved

    def saved(df):
        out = save(df)
        made.append((set(out.columns), out.count(), [r.gram for r in out.select("gram").distinct().collect()] if "gram" in out.columns else []))
        return out

    monkeypatch.setattr(J, "saved", saved)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, 3, 90, 100).collect()}
    assert got == brute(docs, 3, 90, 100)
    for column in ("low", "main"):  # each n-gram in one share, and no share with most of them
        shares = [grams for columns, _, grams in made if column in columns]
        assert len(shares) == J.SHARES and sum(map(len, shares)) == len({g for s in shares for g in s})
    sizes = [n for columns, n, _ in made if "low" in columns]
    assert max(sizes) < sum(sizes) / 2
    assert len([1 for columns, *_ in made if "similar" in columns]) == 2 * J.SHARES
