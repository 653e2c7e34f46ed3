import hashlib
import random
from collections import Counter

from causeway.llm import suffix_dedup as S


def brute(texts):
    n = S.LENGTH
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i:i + n]] > 1:
                gone[i:i + n] = b"\x01" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_matches_brute_force(spark):
    rng = random.Random(10)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, long = word(450), word(5000)
    texts = [None, "", "short", passage[:399], passage[:400] + "x", "y" + passage, word(700) + passage + word(333),
             long, long[:2500] + "#" + long[2500:], long[1000:3000], word(50) + long[137:1600] + word(9),
             "a" * 1000, "ab" * 700, "a" * 399, "a" * 400, word(3000), "copy " * 100, "copy " * 100, "copy " * 100,
             word(401), "z" * 398 + "é", "q" * 401, "ééé" * 300, long[777:1176], long[2200:2599], long[2201:2800]]
    for k in range(30):  # passages at every offset against the period
        texts.append(word(rng.randint(1, 900)) + passage[rng.randint(0, 30):] + word(rng.randint(0, 300)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS cid", "2 AS bucket")
    got = {r.doc_id: r for r in S.repeated_spans(df).collect()}
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, len(r.starts), r.kept_sha256) == want, (i, texts[i] and texts[i][:50])
        assert sum(e - s for s, e in zip(r.starts, r.ends, strict=True)) == r.n_removed


def test_empty_table_and_repeated_ids(spark):
    assert S.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = S.repeated_spans(spark.createDataFrame([(1, "k" * 500), (1, "k" * 500), (None, "m"), (1, "n" * 10)],
                                                  "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(1, 0), (10, 0), (500, 500), (500, 500)]


def test_a_text_without_id_shares_a_passage(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(400)
    texts = [word(50) + "#" + passage + "#" + word(60), word(30) + "+" + passage + "+" + word(20)]
    for ids in ((1, None), (None, None)):
        rows = S.repeated_spans(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")).collect()
        assert sorted((r.n_bytes, r.n_removed) for r in rows) == [(452, 400), (512, 400)]
