"""Jaccard join of word n-gram sets: rare-first prefixes with length, positional and suffix filters.

Two sets of at least ``part`` / ``whole`` similarity share an n-gram among the first |x| - ceil(t |x|) + 1 of each, in
any common order; with the rarest first those prefixes meet seldom. The order comes from a count sketch of SLOTS
counters over all documents (it decides only which n-grams are tried first, never what is linked), ties by hash.

Documents with the same set are one class and join as its smallest id. Prefix n-grams held by two classes or more make
buckets, and pairs come from buckets:

* first every class meets two pivots of each bucket (linear in the prefixes, whatever the size of a bucket);
* then links are closed into components, and only pairs of a bucket that lie in different components are left: a
  bucket within one component, such as a group of thousands of near copies, gives none.

The suffix filter bounds the difference of two sets from below without reading them: each n-gram that only one of them
holds flips the parity of its part of the hash range, so the parities that differ in PARTS parts are at most as many as
the n-grams that differ.

A pair passes the length filter (sizes), the positional filter (what can still be shared after the n-gram's places)
and the suffix filter, and is then verified once on the whole sets. Skipping a pair inside a component never changes the components.

N-grams are 64-bit hashes. Edge cases: null, empty and wordless texts have an empty set and link with nothing; with
fewer words than n the whole sequence is the one n-gram; rows that share an id are one document; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import textbytes as T
from causeway.llm.common import forgotten, read, register, same, saved, text_or_empty
from causeway.llm.graph import components

SLOTS = 1 << 20
#: Shares of the prefix n-grams, and of the pairs to be verified, that are worked off one after the other, so that the
#: disk holds the shuffles of one share at a time.
SHARES = 4
#: Pairs of ids that may be broadcast to their sets: 16 bytes each.
BROADCAST_PAIRS = 500_000
#: Hash parts of a set whose parities make its sketch, and the 64-bit words that hold them.
PARTS = 1024
WORDS = PARTS // 64


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(_signed(np.concatenate(parts))))


def _classes(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(len(s), int(_signed(s.sum(keepdims=True))[0]) if len(s) else 0,
                     int(_signed(np.bitwise_xor.reduce(T.avalanche(s), keepdims=True))[0]) if len(s) else 0)
                    for s in T.shingle_sets(b.column(1), n)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))],
                                             names=["doc_id", "n_shingles", "f1", "f2"])
    return run


def _slots(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for b in batches:
            for s in T.shingle_sets(b.column(1), n):
                np.add.at(held, (s >> T.U(44)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        for k in range(0, len(at), 100_000):
            part = at[k:k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(held[part])], names=["slot", "held"])
    return run


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """Count sketch over the sets of all documents: SLOTS counters, whatever the input's size."""
    counts = texts.mapInArrow(_slots(n), "slot int, held long").groupBy("slot").agg(F.sum("held").alias("held"))
    found = counts.toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[found.column("slot").to_numpy()] = found.column("held").to_numpy()
    return out


def _prefixes(n: int, part: int, whole: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = counts.value, set()
        for b in batches:
            ids, sizes, prefixes, parts = [], [], [], []
            for doc_id, s in zip(b.column(0).to_pylist(), T.shingle_sets(b.column(1), n), strict=True):
                if not len(s) or doc_id is None:
                    continue
                keep = len(s) + part * len(s) // -whole + 1
                ids.append(doc_id)
                sizes.append(len(s))
                order = np.lexsort((s, held[(s >> T.U(44)).astype(np.int64)]))
                prefixes.append(s[order[:keep]])
                parts.append(np.packbits(np.bincount((s & T.U(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1).view(T.U))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), _lists(prefixes),
                                                  _lists(parts)], names=["doc", "size", "prefix", "parts"])
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([*T.shingle_sets(part.column(1), n)])],
                                                 names=["doc", "grams"])
    return run


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")


def _in_slots(taken):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(taken.value[b.column(2).to_numpy(zero_copy_only=False)])).select(["doc_id", "text"])
    return run


def _bucketed(entries: DataFrame) -> list[DataFrame]:
    """The entries (gram, doc, size, at) of n-grams with two entries or more, with each n-gram's pivots: a table for each
    share of the n-grams."""
    out = []
    for k in range(SHARES):
        own = entries.where(F.pmod("gram", F.lit(SHARES)) == k).select("gram", "doc", "size", "at")
        buckets = own.groupBy("gram").agg(F.count("*").alias("n"), F.min(F.struct("doc", "size", "at")).alias("low"),
                                          F.max(F.struct("doc", "size", "at")).alias("high")).where("n > 1").drop("n")
        out.append(saved(own.join(buckets, "gram")))
    return out


def _overlap(a: str, b: str, part: int, whole: int) -> Column:
    """Least intersection of a similar pair: ceil(t / (1 + t) (|x| + |y|))."""
    return F.ceil((F.col(a) + F.col(b)) * part / (part + whole))


def _may_be_similar(x: str, y: str, part: int, whole: int) -> Column:
    """Length, positional and suffix filter on columns <x>_size, <x>_at, <x>_parts and the same of y."""
    sx, sy, ax, ay = F.col(f"{x}_size"), F.col(f"{y}_size"), F.col(f"{x}_at"), F.col(f"{y}_at")
    need = _overlap(f"{x}_size", f"{y}_size", part, whole)
    length = (sx * part <= sy * whole) & (sy * part <= sx * whole)
    place = F.least(ax, ay) + F.least(sx - ax, sy - ay) >= need
    apart = sum((F.bit_count(F.get(f"{x}_parts", F.lit(i)).bitwiseXOR(F.get(f"{y}_parts", F.lit(i)))) for i in range(WORDS)), F.lit(0))
    return length & place & (apart <= sx + sy - need * 2)


def _verified(pairs: DataFrame, texts: DataFrame, n: int, part: int, whole: int) -> DataFrame:
    """(a, b, similar) for distinct pairs a < b, each verified on its whole sets; only texts in a pair are gathered."""
    pairs = saved(pairs)
    paired = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    # only texts whose id falls into an occupied slot are shuffled: SLOTS bits, whatever the number of pairs
    taken = np.zeros(SLOTS, bool)
    taken[paired.select(_slot().alias("slot")).distinct().toArrow().column(0).to_numpy()] = True
    near = texts.withColumn("slot", _slot()).mapInArrow(_in_slots(texts.sparkSession.sparkContext.broadcast(taken)),
                                                        "doc_id long, text string")
    sets = saved(near.join(paired, "doc_id", "left_semi").dropDuplicates(["doc_id"])
                 .mapInArrow(_sets(n), "doc long, grams array<long>"))
    # counted pairs of ids (two numbers each) go to the sets; beyond the bound both sides are shuffled
    few = pairs.count() <= BROADCAST_PAIRS
    out = None
    for k in range(SHARES):  # whole sets are shuffled a share of the larger ids at a time
        own = lambda c: F.pmod(F.xxhash64(c), F.lit(SHARES)) == k  # noqa: B023, E731
        mine = pairs.where(own("b"))
        with_a = (F.broadcast(mine) if few else mine).join(sets.select(F.col("doc").alias("a"), F.col("grams").alias("ga")), "a")
        both = with_a.join(sets.where(own("doc")).select(F.col("doc").alias("b"), F.col("grams").alias("gb")), "b")
        shared = F.size(F.array_intersect("ga", "gb"))
        checked = saved(both.select("a", "b", (shared * whole >= (F.size("ga") + F.size("gb") - shared) * part).alias("similar")))
        out = checked if out is None else out.unionByName(checked)
    forgotten(sets)
    forgotten(pairs)
    return out


def _open_entries(entries: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """The entries of buckets that lie in several components, with their component, their bucket's most common one
    (which meets the others, never itself) and their set's sketch."""
    placed = entries.drop("low", "high").join(found.withColumnRenamed("node", "doc"), "doc", "left").withColumn(
        "component", F.coalesce("component", "doc"))
    # the plan holds the placed entries twice only: every further use would be planned, and listed in the driver, again
    by_component = placed.groupBy("gram", "component").agg(F.count("*").alias("n"))
    mixed = by_component.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                             F.max(F.struct("n", "component")).alias("m")).where("lo <> hi")
    return placed.join(mixed.select("gram", F.col("m.component").alias("main")), "gram").join(sizes, "doc")


def jaccard_components(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id (smallest doc_id reachable by links of similarity
    ``part`` / ``whole`` or more)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    each = saved(texts.mapInArrow(_classes(n), "doc_id long, n_shingles long, f1 long, f2 long"))
    classes = each.where("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("doc"))
    counts = spark.sparkContext.broadcast(frequencies(texts, n))
    cards = texts.mapInArrow(_prefixes(n, part, whole, counts), "doc long, size long, prefix array<long>, parts array<long>")
    # of a class only the smallest id goes on
    cards = saved(cards.join(classes.select("doc").distinct(), "doc", "left_semi"))

    shares = _bucketed(cards.select("doc", "size", F.posexplode("prefix").alias("at", "gram")))
    entries = reduce(DataFrame.unionByName, shares)
    sizes = cards.select("doc", "parts")

    def with_parts(pairs: DataFrame, of: str) -> DataFrame:
        return pairs.join(sizes.select(F.col("doc").alias(of), F.col("parts").alias(f"{of}_parts")), of)

    p = F.col("p")
    met = (entries.select("doc", "size", "at", F.explode(F.array("low", "high")).alias("p")).where(F.col("doc") != p["doc"])
           .select(F.col("doc").alias("x"), F.col("size").alias("x_size"), F.col("at").alias("x_at"),
                   p["doc"].alias("y"), p["size"].alias("y_size"), p["at"].alias("y_at")))
    short = (F.col("x_size") * part <= F.col("y_size") * whole) & (F.col("y_size") * part <= F.col("x_size") * whole)
    met = met.where(short).groupBy("x", "y", "x_size", "y_size").agg(F.min("x_at").alias("x_at"), F.min("y_at").alias("y_at"))
    pairs = with_parts(with_parts(met, "x"), "y").where(_may_be_similar("x", "y", part, whole)).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    first = _verified(pairs, texts, n, part, whole)
    linked = first.where("similar").select("a", "b")
    found = saved(components(linked))

    # what is left: pairs of a bucket from different components
    rest = []
    for share in shares:
        open_ = saved(_open_entries(share, found, sizes))
        forgotten(share)
        x = open_.where("component <> main").select("gram", *[F.col(c).alias(f"x_{c}") for c in ("doc", "size", "at", "parts", "component")])
        y = open_.select("gram", *[F.col(c).alias(f"y_{c}") for c in ("doc", "size", "at", "parts", "component", "main")])
        pairs = x.join(y, "gram").where((F.col("x_component") != F.col("y_component"))
                                        & ((F.col("y_component") == F.col("y_main")) | (F.col("x_doc") < F.col("y_doc")))
                                        & _may_be_similar("x", "y", part, whole))
        rest.append(saved(pairs.select(F.least("x_doc", "y_doc").alias("a"), F.greatest("x_doc", "y_doc").alias("b")).distinct()))
        forgotten(open_)
    # pairs that were verified before drop out by a flag: an anti join would be planned once for each share
    both = reduce(DataFrame.unionByName, rest).withColumn("old", F.lit(False)).unionByName(first.select("a", "b", F.lit(True).alias("old")))
    left = both.groupBy("a", "b").agg(F.max("old").alias("old")).where(~F.col("old")).select("a", "b")
    more = _verified(left, texts, n, part, whole).where("similar").select("a", "b")
    found = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    labels = classes.join(found.withColumnRenamed("node", "doc"), "doc", "left").select(
        "n_shingles", "f1", "f2", F.coalesce("component", "doc").alias("label"))
    return each.join(labels, ["n_shingles", "f1", "f2"], "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, part: int = 80,
             whole: int = 100) -> DataFrame:
    """The documents with all their columns, one of each group: the one with the smallest id."""
    found = jaccard_components(docs, n, part, whole, id_col, text_col)
    first = found.where(same(F.col("doc_id"), F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(first, same(docs[id_col], F.col("_keep")), "left_semi")


@register("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by 3-word shingles at 0.9."""
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, part=90, whole=100)
