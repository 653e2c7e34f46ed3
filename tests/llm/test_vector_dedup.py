import numpy as np

from causeway.llm import vector_dedup as V


def brute(rows, cosine=0.95):
    ok = [(i, np.array(v, float)) for i, v in rows
          if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: set() for i, _ in rows}
    for dim in {len(v) for _, v in ok}:
        own = [(i, v) for i, v in ok if len(v) == dim]
        m = np.array([v / np.linalg.norm(v) for _, v in own])
        for p, q in np.argwhere(np.triu(m @ m.T >= cosine, 1)):
            links[own[p][0]].add(own[q][0])
            links[own[q][0]].add(own[p][0])
    return links


def closure(links):
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += links[j]
    return out


def test_edge_cases(spark):
    e = [1.0, 2.0, 3.0, 4.0]
    rows = [(9, e), (3, e), (5, [2 * x for x in e]), (1, None), (2, []), (4, [0.0] * 4), (6, [float("nan"), 1.0, 2.0, 3.0]),
            (7, [float("inf"), 1.0, 0.0, 0.0]), (8, [None, 1.0, 2.0, 3.0]), (10, [-x for x in e]), (11, e + [0.0]),
            (12, [1.0, 2.0, 3.0, 4.1]), (13, [4.0, -3.0, 2.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "2 AS key")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in V.near_duplicates(df).collect()}
    want = brute(rows)
    roots = closure(want)
    assert got == {i: (len(want[i]), roots[i], roots[i] == i) for i, _ in rows}
    assert V.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_recall_on_embeddings(spark):
    rng = np.random.default_rng(7)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    for k, (_, v) in enumerate(rows[:400]):  # copies with noise up to the threshold and a little beyond
        noise = rng.standard_normal(64)
        noise *= np.linalg.norm(v) * rng.uniform(0, 0.36) / np.linalg.norm(noise)
        rows.append((100_000 + k, [float(x) for x in np.float32(np.array(v) + noise)]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows)
    got = {r.vec_id: r for r in V.near_duplicates(df).collect()}
    total = sum(map(len, want.values()))
    assert len(got) == len(rows) and all(got[i].n_links <= len(w) for i, w in want.items())
    assert total and sum(r.n_links for r in got.values()) >= 0.98 * total
    roots = closure(want)
    assert sum(got[i].component_id == roots[i] for i in roots) >= 0.99 * len(roots)


def test_a_group_near_the_threshold_is_found(spark):
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    rows = []
    for i in range(300):
        noise = rng.standard_normal(64)
        noise -= noise @ centre * centre
        rows.append((i, (centre + 0.155 * noise / np.linalg.norm(noise)).tolist()))
    want = brute(rows)
    got = V.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sum(r.n_links for r in got.collect()) >= 0.97 * sum(map(len, want.values())) > 0
