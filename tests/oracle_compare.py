"""Run catalog queries in Spark and their oracle SQL in DuckDB; compare like the driver does:
row count, column names (sorted), and an order-insensitive hash of the values."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


def digest(cols: list[str], rows: list[tuple]) -> str:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def compare(spark, name: str, sf_dir: str, con=None, verbose=True) -> dict:
    from causeway.plans.catalog import QUERIES, SQL
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_sec": round(t1 - t0, 2)}
    if name not in SQL:
        res["status"] = "rows-only"
        return res
    rel = con.execute(SQL[name])
    dcols = [d[0] for d in rel.description]
    drows = [tuple(r) for r in rel.fetchall()]
    res.update(duck_rows=len(drows), cols_match=sorted(scols) == sorted(dcols))
    res["hash_match"] = res["cols_match"] and digest(scols, srows) == digest(dcols, drows)
    res["status"] = "ok" if (res["hash_match"] and len(srows) == len(drows)) else "MISMATCH"
    if res["status"] != "ok" and verbose:
        print("spark cols", scols, "duck cols", dcols)
        print("spark", sorted(srows, key=str)[:3])
        print("duck ", sorted(drows, key=str)[:3])
    return res


if __name__ == "__main__":
    from causeway.plans.catalog import QUERIES
    from causeway.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    names = sys.argv[1:] or list(QUERIES)
    spark = local_session()
    con = duck(sf)
    bad = 0
    for n in names:
        if not any(n == q or (n.endswith("*") and q.startswith(n[:-1])) for q in QUERIES):
            continue
        for q in [q for q in QUERIES if q == n or (n.endswith("*") and q.startswith(n[:-1]))]:
            try:
                r = compare(spark, q, sf, con)
            except Exception as e:  # noqa: BLE001
                r = {"name": q, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
            bad += r["status"] not in ("ok", "rows-only")
            print(r, flush=True)
    print("mismatches:", bad)
