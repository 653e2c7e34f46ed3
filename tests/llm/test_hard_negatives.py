import numpy as np
import pytest
from pyspark.sql import functions as F
from tests_llm_help import duck_rows, rows

from causeway.llm import hard_negatives as H


def brute(table, scale=256, n_positives=5, n_negatives=10, low=30, high=90, every=100):
    ok = [(i, c, [int(np.floor(scale * float(x))) for x in v]) for i, c, v in table
          if i is not None and c is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    anchors = {}
    for i, c, v in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (c, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, d) for i, d, w in ok if i != a)
        for p, q, _ in [s for s in scored if s[2] == c][:n_positives]:
            fit = [s for s in scored if s[2] != c and low * -p <= 100 * -s[0] <= high * -p]
            out += [(a, q, k, s[1], -p, -s[0]) for k, s in enumerate(fit[:n_negatives], 1)]
    return sorted(out)


def mined(spark, table, every=100, parts=3, **kw):
    df = spark.createDataFrame(table, "vec_id long, label int, embedding array<double>").selectExpr(
        "*", "1 AS id", "2 AS `group`", "3 AS block", "4 AS rank").repartition(parts)
    out = H.mine(df, F.col("id") % every == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 0, 4), (33, 65, 70), (200, 64, 300), (129, 127, 131)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(4)
    n, k, m = shape
    for most in (10, 2 ** 28):
        a, b = rng.integers(-most, most, (n, k)), rng.integers(-most, most, (k, m))
        assert (H.strassen(a, b, 8) == a @ b).all()
        assert (H.strassen(a.astype(np.int64), b.astype(np.int64)) == a @ b).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(5)
    scores, fits, ids = rng.integers(0, 6, (7, 90)), rng.random((7, 90)) < 0.4, rng.permutation(90)
    for cuts in ([0, 90], [0, 1, 2, 40, 90]):
        heap = H.Heaps(7, 5)
        for a, b in zip(cuts[:-1], cuts[1:]):
            heap.offer(scores[:, a:b], fits[:, a:b], ids[a:b])
        owner, score, ident = heap.entries()
        for k in range(7):
            want = sorted((-s, i) for s, i, f in zip(scores[k], ids, fits[k]) if f)[:5]
            assert [(-s, i) for o, s, i in zip(owner, score, ident) if o == k] == want


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(6)
    table = [(k, int(rng.integers(0, 4)), [float(x) for x in rng.normal(0.1, 0.3, 70)]) for k in range(600)]
    table += [(1000 + k, k % 3, table[k % 4][2]) for k in range(60)]  # copies: ties
    table += [(None, 1, table[0][2]), (2000, None, table[0][2]), (2001, 1, None), (2002, 1, []), (2003, 2, [0.5]),
              (2004, 1, [float("nan")] * 70), (2005, 1, [float("inf")] * 70), (2006, 1, [None] * 70), (100, 3, table[5][2]),
              (7, 2, table[7][2]), (7, 2, table[7][2]), (2007, 0, [0.0] * 70), (2100, 9, table[9][2])]
    want = brute(table)
    assert mined(spark, table) == want and len(want) > 100
    monkeypatch.setattr(H, "ROWS", 37)  # many blocks, and groups of two
    monkeypatch.setattr(H, "GROUP_BYTES", 2 * 37 * (72 * 8 + 3 * 96))
    assert mined(spark, table, every=5, n_positives=3, n_negatives=4, low=10, high=95) == brute(table, every=5, n_positives=3,
                                                                                              n_negatives=4, low=10, high=95)


def test_defined_edges(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 0, [1.0]), (2, 1, [1.0])]) == []  # no anchor
    assert mined(spark, [(0, 0, [1.0]), (2, 1, [1.0])]) == []  # no positive
    with pytest.raises(ValueError):
        mined(spark, [(0, 0, [1e12]), (2, 0, [1.0])])


def test_query_against_sql(spark):
    got, want = rows(spark, "op13_hard_negatives", "sf0.1"), duck_rows("op13_hard_negatives", "sf0.1")
    assert got == want and len(got) > 100
