"""Near duplicates of embeddings by Euclidean p-stable hashing and exact cosine checks.

Normalised vectors of cosine c are sqrt(2 - 2c) apart. A table hashes a vector by K quantised Gaussian projections
floor((a v + b) / WIDTH); near vectors share all K values with probability p(near)^K, so T tables find a pair at the
threshold with probability 1 - (1 - p^K)^T. K and T follow from the number of vectors by one rule: unrelated vectors
(at right angles) meet about once a table, and a pair at the threshold is found with probability RECALL or more (nearer
pairs with more). Vectors that meet in a bucket are compared by BITS random sign bits first: their Hamming distance
at the threshold is MARGIN standard deviations from the cut. What passes is verified by its cosine in double precision.

Equal vectors are one class and hashed once; classes carry their number of rows. Buckets join by (table, key), so Spark
splits a bucket that is too large for one task. Links of one group are all counted, as ``n_links`` asks for them.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different length never link; rows that share an id are one node; an empty table gives an empty result; further
columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import textbytes as T
from causeway.llm.common import read, register, same, saved
from causeway.llm.graph import components

WIDTH = 2.0
RECALL = 0.99
BITS = 256
MARGIN = 6.0


def meet(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised projection of two points at ``distance`` is equal."""
    r = width / distance
    return (1 - 2 * 0.5 * math.erfc(r / math.sqrt(2))
            - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2)))


def shape(n: int, cosine: float) -> tuple[int, int]:
    """(K projections a table, T tables) for n vectors."""
    k = max(1, math.ceil(math.log(max(2, n)) / -math.log(meet(math.sqrt(2)))))
    near = meet(math.sqrt(2 - 2 * cosine)) ** k
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near)))


def most_bits_apart(cosine: float) -> int:
    p = math.acos(cosine) / math.pi
    return math.ceil(BITS * p + MARGIN * math.sqrt(BITS * p * (1 - p)))


def _hashes(k: int, tables: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                part = b.filter(pa.array(lengths == dim))
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = (rng.standard_normal((dim, tables * k)), rng.uniform(0, WIDTH, tables * k),
                                   rng.standard_normal((dim, BITS)))
                a, shift, signs = planes[dim]
                for at in range(0, part.num_rows, 1000):
                    rows = part.slice(at, 1000)
                    v = rows.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    v = v / np.linalg.norm(v, axis=1, keepdims=True)
                    cells = np.floor((v @ a + shift) / WIDTH).astype(np.int64).view(T.U).reshape(len(v), tables, k)
                    keys = np.full((len(v), tables), T.U(dim))
                    for j in range(k):
                        keys = T.avalanche(keys ^ cells[:, :, j])
                    sketch = np.packbits(v @ signs > 0, axis=1).view(np.int64)
                    arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).view(np.int64).ravel()), x.shape[1])
                              .cast(pa.list_(pa.int64())) for x in (keys, sketch)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), *arrays], names=["vec", "keys", "bits"])
    return run


def _cosines(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            good = np.zeros(b.num_rows, bool)
            lengths = b.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == dim)
                part = b.take(pa.array(rows))
                x, y = (part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for i in (2, 3))
                dots = np.einsum("ij,ij->i", x, y)
                good[rows] = dots / (np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)) >= cosine
            yield b.select(["a", "b"]).filter(pa.array(good))
    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                    seed: int = 5) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept (the smallest id of its component)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    rows = saved(rows.withColumn("ok", F.coalesce(usable, F.lit(False))))
    classes = saved(rows.where("ok AND vec_id IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("vec"),
                                                                           F.count("*").alias("n")))
    k, tables = shape(classes.count(), cosine)
    hashed = saved(classes.select("vec", "v").mapInArrow(_hashes(k, tables, seed), "vec long, keys array<long>, bits array<long>"))
    entries = hashed.select("vec", *[F.col("bits")[i].alias(f"s{i}") for i in range(BITS // 64)],
                            F.posexplode("keys").alias("table", "key"))
    shared = entries.groupBy("table", "key").agg(F.count("*").alias("n")).where("n > 1").select("table", "key")
    entries = saved(entries.join(shared, ["table", "key"]))
    x, y = (entries.select("table", "key", F.col("vec").alias(v), *[F.col(f"s{i}").alias(f"{v}{i}") for i in range(BITS // 64)])
            for v in ("a", "b"))
    apart = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(BITS // 64)), F.lit(0))
    pairs = saved(x.join(y, ["table", "key"]).where((F.col("a") < F.col("b")) & (apart <= most_bits_apart(cosine)))
                  .select("a", "b").distinct())
    both = (pairs.join(classes.select(F.col("vec").alias("a"), F.col("v").alias("va")), "a")
            .join(classes.select(F.col("vec").alias("b"), F.col("v").alias("vb")), "b").select("a", "b", "va", "vb"))
    links = saved(both.mapInArrow(_cosines(cosine), "a long, b long"))

    found = components(links)
    weight = classes.select("vec", "n")
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(weight.withColumnRenamed("vec", "b"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    labels = (classes.join(others.withColumnRenamed("a", "vec"), "vec", "left")
              .join(found.withColumnRenamed("node", "vec"), "vec", "left")
              .select(F.col("v").alias("cv"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
                      F.coalesce("component", "vec").alias("label")))
    key = F.when(F.col("ok"), F.col("v"))
    out = rows.withColumn("key", key).join(labels, F.col("key") == F.col("cv"), "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("label", "vec_id").alias("component_id")).withColumn(
        "kept", same(F.col("vec_id"), F.col("component_id")))


@register("op5_vector_dedup")
def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.95."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))
