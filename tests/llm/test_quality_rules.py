import re
from collections import Counter, defaultdict

import numpy as np

from causeway.llm import quality_rules as Q
from causeway.llm.common import WORD


def counts(text):
    t = text or ""
    w = re.findall(WORD, t)
    tri = Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    hit = set()
    for i in range(len(w) - 2):
        if tri[w[i], w[i + 1], w[i + 2]] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), sum(c in Q.SYMBOLS for c in t), len(lines) - len(set(lines)), len(hit))


def brute(rows):
    """kept by id: the same estimator in numpy, with sorted quantiles."""
    stat = {i: counts(t) for i, t, _, _ in rows}
    failed = {i: s[0] < 50 or 100 * s[4] > 50 * s[0] for i, s in stat.items()}
    size = Counter((g, s) for i, _, g, s in rows if not failed[i])
    pool = Counter()
    for (g, _), n in size.items():
        if n < Q.LEAST:
            pool[g] += n
    group = defaultdict(list)
    for i, _, g, s in rows:
        if not failed[i]:
            group[("own", g, s) if size[g, s] >= Q.LEAST else ("pool", g) if pool[g] >= Q.LEAST else "rest"].append(i)
    kept, floors = {i: not f for i, f in failed.items()}, np.array(Q.FLOORS)
    quantile = lambda x, q: np.sort(x, axis=0)[max(0, int(np.ceil(q * len(x))) - 1)]
    for ids in group.values():
        if len(ids) < Q.LEAST:
            continue
        s = np.array([stat[i] for i in ids], float)
        n = s[:, 0]
        x = np.stack([np.log(n), np.log((s[:, 1] + 1) / n), *(np.sqrt(s[:, k] / n) for k in (2, 3, 4))], 1)
        m = quantile(x, 0.5)
        c = np.diag(np.maximum(quantile(np.abs(x - m), 0.5) * 1.4826, floors) ** 2)
        for step in range(Q.STEPS + 1):
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            if step < Q.STEPS:
                near = x[d2 <= quantile(d2, Q.H)]
                m, c = near.mean(0), np.cov(near.T, bias=True) * Q.CONSISTENCY + np.diag(floors ** 2)
        for i, d in zip(ids, d2, strict=True):
            kept[i] = bool(d <= Q.CUTOFF)
    return stat, failed, kept


def compare(df, rows, doubtful=0):
    stat, failed, kept = brute(rows)
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert set(got) == set(stat)
    for i, r in got.items():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == stat[i], i
        assert r.base_failed == failed[i]
    assert sum(got[i].kept != kept[i] for i in got) <= doubtful
    return got


def test_documents_match_brute_force_and_labels(spark):
    d = "/root/testdata/sf0.1"
    df = spark.read.parquet(f"{d}/documents.parquet")
    got = compare(df, [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()], doubtful=2)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = [(got[i].kept, q) for i, q in quality.items() if not got[i].base_failed]
    assert sum(k for k, q in judged if q) >= 0.998 * sum(q for _, q in judged)
    assert sum(not k for k, q in judged if not q) >= 0.95 * sum(not q for _, q in judged) > 0


TEXTS = [None, "", " \n\t ", "a b c a b c", "x x x x", "one two", "a b c d a b c", "p q r\np q r\n\n\np q r\n", "é ñ ü\x1c#|<>",
         "word " * 49, "word word2 " * 30, "z" * 200_000, " ".join(f"w{i}" for i in range(20_000)),
         " ".join(f"w{i % 9000}" for i in range(20_000)), "k l m\r\nk l m\r\n k l m"]


def test_edge_cases(spark):
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(f"v{(i * j) % 997}" for j in range(60 + i % 50)), "en", "s") for i in range(120)]
    rows += [(300, " ".join(f"u{i}{'#$%' * 5}" for i in range(80)), "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_words", "2 AS g")
    got = compare(df, rows)
    assert not got[300].kept
    assert Q.keep_good(df).columns == df.columns
    assert {r.doc_id for r in Q.keep_good(df).collect()} == {i for i, r in got.items() if r.kept}


def test_empty_table_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string"
    assert Q.judge(spark.createDataFrame([], schema)).count() == 0
    assert Q.judge(spark.createDataFrame([(1, "a b", "en", "s")] * 3 + [(None, None, None, None)], schema)).count() == 4


def test_chi_squared():
    assert abs(Q.chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(Q.chi2_cdf(6.6257, 5) - 0.75) < 1e-4


def test_equal_low_bits_of_a_hash_hide_no_repeat(spark):
    # the hashes of both windows of three end in the same 40 bits, and the second stands between the first's repeats
    text = "w5381903 x y a b c w5667203 x y d e f w5381903 x y g"
    got = Q.statistics(spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")).first()
    assert got.n_repeat_words == counts(text)[4] == 6
