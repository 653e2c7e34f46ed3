"""Rows of a registered query and of its SQL, as sorted tuples with the columns in name order."""

import duckdb

from causeway.llm.registry import QUERIES, SQL

DATA = "/root/testdata"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows(spark, name, sf):
    df = QUERIES[name](spark, f"{DATA}/{sf}")
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def duck_rows(name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    rel = con.sql(SQL[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    return sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=repr)
