import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
from tests_llm_help import duck_rows, rows

from causeway.llm import importance_resampling as I


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def runs(text, least, most):
    w = words(text)
    return [" ".join(w[i:i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, least=1, most=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    hashed = lambda t: Counter(zlib.crc32(x.encode()) % buckets for x in runs(t, least, most))
    s, t = Counter(), Counter()
    for _, text in docs:
        s += hashed(text)
    for text in target:
        t += hashed(text)
    n_s, n_t = s.total() + buckets, t.total() + buckets
    out = []
    for i, text in docs:
        weight = sum(n * math.floor(1000 * math.log((t[b] + 1) * n_s / ((s[b] + 1) * n_t))) for b, n in hashed(text).items())
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(runs(text, least, most)), weight, score, len(words(text)) >= least_words))
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2]))
    place = {id(r): k for k, r in enumerate(able, 1) if k <= percent * len(able) // 100}
    return sorted(((*r[:4], place.get(id(r))) for r in out), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS weight", "2 AS _none", "3 AS rank")


def resample(spark, docs, target, **kw):
    out = I.resample(frame(spark, docs).repartition(3), frame(spark, [(0, x) for x in target]), **kw)
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect()), key=repr)


def test_prefix_crcs_spell_every_run():
    rng = random.Random(1)
    texts = [None, "", " .,", "a", "A", "x" * 70_000 + " b", "Zoë9 8 é 日本 語", "q" * 300 + " " + "r" * 5000 + "-s t"]
    texts += ["".join(rng.choice("aB9é .\n-_日") for _ in range(rng.randrange(200))) for _ in range(200)]
    for least, most in ((1, 1), (2, 2), (1, 4)):
        for (n, got), text in zip(I.word_runs(pa.array(texts, pa.string()), least, most), texts, strict=True):
            assert n == len(words(text))
            assert got.tolist() == [zlib.crc32(x.encode()) for x in runs(text, least, most)]


def test_resampling_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(300)] + ["É", "日本", "the", "The"]
    make = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 19, 20, 21, 60])))
    docs = [(k, make()) for k in range(400)]
    docs += [(500, None), (501, ""), (502, docs[0][1]), (502, docs[0][1]), (503, "w1 " * 30_000), (None, "w1 " * 25), (None, "w2 " * 25)]
    target = [make() for _ in range(30)] + [None, ""]
    assert resample(spark, docs, target) == brute(docs, target)
    settings = dict(least=1, most=3, buckets=97, percent=35, least_words=5, seed=9)
    assert resample(spark, docs, target, **settings) == brute(docs, target, **settings)


def test_empty_tables(spark):
    assert resample(spark, [], ["a b"]) == []
    docs = [(1, "a b c " * 10), (2, "d " * 30)]
    assert resample(spark, docs, [], percent=50) == brute(docs, [], percent=50)


def test_query_against_sql(spark):
    got, want = rows(spark, "op11_importance_resampling", "sf0.01"), duck_rows("op11_importance_resampling", "sf0.01")
    assert got == want and sum(r[2] is not None for r in got) > 50
