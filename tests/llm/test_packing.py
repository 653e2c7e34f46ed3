import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from causeway.llm import packing as P


def check(spark, docs, rows, size):
    tok = Tokenizer.from_file(P.default_tokenizer())
    ids = {i: tok.encode(t or "", add_special_tokens=False).ids + [P.END] for i, t in docs}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert len(part) == r.length > 0 and zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(ids[r.doc_id])
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(ids[i])
    padding = total = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
        total += at
    return padding / max(1, total)


TEXTS = [None, "", "Hello, world. It's <|endoftext|> here!", "a\u00a0b\x1cc \x0bd\u2003e", "Σας ΣΑΣ İI", "e\u0301 \u0301x",
         "word " * 9000, "x" * 50_000, "1234567890" * 300, "same", "same", "It's. ok., no.\nÉté, été. ÷ß ÿ! a1, b.c, 'tis don't. x.", ".", "a.", "a. ",
         "ÀÉÎ naïve, œuvre. e\u0327! Ünïcode; \u00adsoft <|STARTOFTEXT|> <|startoftext|>x", "日本語。 русский, текст."]


def test_pieces_cover_every_token_once(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS length").coalesce(1)
    check(spark, docs, P.pack(df).collect(), P.SIZE)
    check(spark, docs, P.pack(df, size=64).collect(), 64)


def test_words_tokenise_as_whole_texts():
    import duckdb
    import pyarrow as pa
    texts = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' LIMIT 4000").fetchall()]
    texts += [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    words = P.WordTokenizer(P.default_tokenizer())
    whole = words.tokenizer.encode_batch([t or "" for t in texts + TEXTS], add_special_tokens=False)
    for got, want in zip(words(pa.array(texts + TEXTS)), whole, strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids


def test_documents_pack_with_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert check(spark, [(r.doc_id, r.text) for r in docs.collect()], P.pack(docs).collect(), P.SIZE) < 0.02


def test_repeated_rows_and_empty_table(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = P.pack(spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string").coalesce(1)).collect()
    assert sum(r.length for r in rows) == 6
    with pytest.raises(ValueError):
        P.pack(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_cuts_are_the_cheapest():
    rng = random.Random(9)
    for _ in range(200):
        size, at = 10, list(itertools.accumulate(rng.randint(1, 6) for _ in range(9)))
        pen = [rng.choice([0.0, 2.0, 5.0]) for _ in at]
        cost = lambda cuts: sum(size - (at[b] - (at[a] if a >= 0 else 0)) + pen[b] for a, b in zip([-1, *cuts], cuts))  # noqa: E731,B905
        best = min(cost([*c, len(at) - 1]) for k in range(len(at)) for c in itertools.combinations(range(len(at) - 1), k)
                   if all(at[b] - (at[a] if a >= 0 else 0) <= size for a, b in zip([-1, *c], [*c, len(at) - 1])))  # noqa: B905
        got = P.best_cuts(at, pen, size)
        assert got[-1] == len(at) - 1 and cost(got) == best


def test_streamed_buffers_give_whole_sequences():
    packer = P.Packer(0, np.zeros(10, bool), size=16, held=100)
    for i in range(300):
        packer.add(i, np.array([3] * (i % 23) + [2], "<u4").tobytes())
    packer.finish()
    assert sum(r[2] for r in packer.rows) == sum(i % 23 + 1 for i in range(300))
    assert {r[5] for r in packer.rows} == set(range(packer.sequence))
