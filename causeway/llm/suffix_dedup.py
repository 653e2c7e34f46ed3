"""Removal of repeated byte strings by a difference-cover, blockwise suffix order.

Only suffixes whose first LENGTH bytes also start elsewhere matter. COVER is a difference cover modulo PERIOD: any two
positions i, j have a shift k < PERIOD for which i + k and j + k both lie in the cover, so two equal strings of LENGTH
bytes share a cover sample of WINDOW = LENGTH - PERIOD + 1 bytes at the same place inside them.

1. Ranks of the cover samples (6 % of the positions): equal windows get the same name. Only suffixes with a repeated
   sample within the next PERIOD bytes can tie over LENGTH bytes; all others are settled without being sorted.
2. The suffixes left are dealt into buckets by the name of their first LENGTH bytes and each bucket is sorted on its
   own: memory is that of one bucket, and the number of buckets follows the number of bytes. Neighbours that tie over
   LENGTH bytes are repeats. (The order is by name, not by alphabet: it need only bring equal prefixes together.) The
   buckets are worked off in PASSES shares, so that the disk holds one share of the suffixes at a time.
3. The repeats return to their text, which loses the bytes they cover.

Equal texts count once: each task hands on a text once, and a bucket keeps one entry for each text and place, so a
group of copies that holds a third of the rows adds a few entries. Names hold 64 bits, texts are known by 64 bits.
Entries travel as packed arrays, one row for each bucket and block of texts.

Edge cases: null and empty texts have 0 bytes and lose none; a text shorter than LENGTH loses none; repeated rows are
copies of each other; rows of one text get the same result; an empty table gives an empty result; further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import textbytes as T
from causeway.llm.common import read, register, same, saved, text_or_empty

LENGTH = 400
PERIOD = 273
#: A planar difference set modulo 273: closed under doubling.
COVER = tuple(sorted({(s << k) % PERIOD for s in (1, 91, 117) for k in range(12)}))
#: Entries of one bucket, about; a bucket is sorted in memory.
BUCKET = 400_000
BLOCK = 1 << 20
PASSES = 4
TASKS = 48
_EMPTY = hashlib.sha256(b"").hexdigest()


class _Blocks:
    """Gathers (name, text, place) entries and gives them out by bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.names, self.cids, self.offs, self.bucket, self.n = buckets, [], [], [], [], 0

    def add(self, names: np.ndarray, cid: int, offs: np.ndarray, bucket: np.ndarray) -> None:
        self.names.append(names)
        self.offs.append(offs.astype(np.int32))
        self.bucket.append(bucket)
        self.cids.append((cid, len(offs)))
        self.n += len(offs)

    def rows(self) -> pa.RecordBatch:
        names, offs, bucket = np.concatenate(self.names), np.concatenate(self.offs), np.concatenate(self.bucket)
        text = np.repeat(np.arange(len(self.cids), dtype=np.int32), [n for _, n in self.cids])
        cids = np.array([c for c, _ in self.cids], np.int64)
        order = np.argsort(bucket, kind="stable")
        at = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        out = []
        for part in np.split(order, at[1:]):
            own, count = np.unique(text[part], return_counts=True)  # the entries of a bucket are in the order of texts
            out.append((int(bucket[part[0]]), names[part].tobytes(), cids[own].tobytes(),
                        count.astype(np.int32).tobytes(), offs[part].tobytes()))
        self.__init__(self.buckets)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*out, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=_PACKED_NAMES)


_PACKED = "bucket int, names binary, cids binary, counts binary, offs binary"
_PACKED_NAMES = ["bucket", "names", "cids", "counts", "offs"]


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by bucket in; out for each text the places whose name is also found elsewhere, one row for all buckets
    that are settled together."""
    held: list[tuple] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bucket = None

    def settle() -> None:
        names = np.concatenate([np.frombuffer(r[0], T.U) for r in held])
        cids = np.concatenate([np.repeat(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.int32)) for r in held])
        offs = np.concatenate([np.frombuffer(r[3], np.int32) for r in held])
        order = np.argsort(names, kind="stable")
        order = order[_ties(names[order])]
        names, cids, offs = names[order], cids[order], offs[order]
        order = np.lexsort((offs, cids, names))
        names, cids, offs = names[order], cids[order], offs[order]
        if len(names):  # one entry for each text and place
            first = np.ones(len(names), bool)
            first[1:] = (np.diff(names) != 0) | (np.diff(cids) != 0) | (np.diff(offs) != 0)
            tie = _ties(names[first])
            found.append((cids[first][tie], offs[first][tie]))

    def give() -> Iterator[pa.RecordBatch]:
        cids, offs = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        found.clear()
        order = np.lexsort((offs, cids))
        cids, offs = cids[order], offs[order]
        at = np.flatnonzero(np.diff(cids)) + 1
        parts, own = np.split(offs, at), cids[np.concatenate([[0], at])] if len(cids) else cids
        for k in range(0, len(own), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(own[k:k + 20_000], pa.int64()),
                                              pa.array([x.tobytes() for x in parts[k:k + 20_000]], pa.binary())], names=["cid", "offs"])

    for batch in batches:
        for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != bucket and held:
                settle()
                held = []
                if sum(len(f[0]) for f in found) >= 4 * BUCKET:
                    yield from give()
            bucket = b
            held.append(tuple(row))
    if held:
        settle()
    if found:
        yield from give()


def _ties(names: np.ndarray) -> np.ndarray:
    """Marks the sorted names that equal a neighbour."""
    tie = np.zeros(len(names), bool)
    tie[1:] = names[1:] == names[:-1]
    tie[:-1] |= tie[1:]
    return tie


def _entries(places: Callable, window: int, buckets: int, share: tuple[int, int] = (0, 1)) -> Callable:
    """mapInArrow function over (cid, text, ...): the names of ``window`` bytes at the places of each text, for one
    share (k, of) of the buckets."""
    low, high = (buckets * (share[0] + k) // share[1] for k in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, seen = _Blocks(buckets), set()
        for batch in batches:
            cids = batch.column(0).to_pylist()
            data, offsets = T.byte_runs(batch.column(1))
            more = [c.to_pylist() for c in batch.columns[2:]]
            for at, end, part, offs in T.chunks(data, offsets):
                sums = T.prefix_sums(part)
                for k in range(at, end):
                    n = int(offsets[k + 1] - offsets[k])
                    if n < LENGTH or cids[k] in seen:
                        continue
                    seen.add(cids[k])
                    where = places(n, *(m[k] for m in more))
                    if len(where):
                        start = where + int(offs[k - at])
                        names = T.span_hashes(sums, start, start + window)
                        bucket = ((names >> T.U(32)) * T.U(buckets) >> T.U(32)).astype(np.int32)
                        if share[1] > 1:
                            own = (bucket >= low) & (bucket < high)
                            names, where, bucket = names[own], where[own], bucket[own]
                        blocks.add(names, cids[k], where, bucket)
                if blocks.n >= BLOCK:
                    yield blocks.rows()
        if blocks.n:
            yield blocks.rows()
    return run


_COVER = np.array(COVER)


def sample_places(n: int) -> np.ndarray:
    """Cover positions of a text of n bytes that have a whole window."""
    at = (np.arange(0, n, PERIOD)[:, None] + _COVER).ravel()
    return at[at <= n - (LENGTH - PERIOD + 1)]


def suffix_places(n: int, samples: list[bytes]) -> np.ndarray:
    """Starts of LENGTH bytes that hold one of the repeated samples within their first PERIOD bytes."""
    edge = np.zeros(n + 1, np.int32)
    for s in samples:
        p = np.frombuffer(s, np.int32)
        np.add.at(edge, np.maximum(0, p - PERIOD + 1), 1)
        np.add.at(edge, p + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:n - LENGTH + 1]) > 0)


def covered(n: int, starts: list[bytes]) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    for s in starts:
        p = np.frombuffer(s, np.int32)
        np.add.at(edge, p, 1)
        np.add.at(edge, p + LENGTH, -1)
    return np.cumsum(edge[:n]) > 0


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for cid, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text.encode()
            gone = covered(len(text), starts)
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            runs = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).astype(np.int64)
            out.append((cid, int(gone.sum()), runs[::2].tolist(), runs[1::2].tolist(), hashlib.sha256(kept).hexdigest()))
        if out:
            cols = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())),
                 pa.array(cols[3], pa.list_(pa.int64())), pa.array(cols[4])], names=["cid", "n_removed", "starts", "ends", "sha"])


def _sorted_buckets(packed: DataFrame, buckets: int) -> DataFrame:
    """Tasks of some 16 buckets each, and no fewer than TASKS: a text comes back in one row for each task or so."""
    dealt = packed.repartition(max(TASKS, buckets // 16), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_repeats, "cid long, offs binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, the removed runs [starts, ends) and kept_sha256."""
    text = text_or_empty(text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text, F.octet_length(text)).alias("cid"), text.alias("text"))
    each = saved(source.select("doc_id", "cid", F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2("text", 256).alias("sha")))
    n_bytes = each.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = lambda share: max(64, int(n_bytes * share / BUCKET))
    long_enough = source.where(F.octet_length("text") >= LENGTH).select("cid", "text")

    window = LENGTH - PERIOD + 1
    of_samples, of_suffixes = buckets(len(COVER) / PERIOD), buckets(0.2)
    samples = long_enough.mapInArrow(_entries(sample_places, window, of_samples), _PACKED)
    ranked = saved(_sorted_buckets(samples, of_samples))
    tied = ranked.groupBy("cid").agg(F.collect_list("offs").alias("samples"))
    first = each.groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    tied = tied.join(first.select("cid", F.col("doc_id").alias("first_id")), "cid")
    # a text that has repeated samples is read once, under the smallest of its ids (null if it has no other)
    left = source.join(tied.withColumnRenamed("cid", "tied_cid"), (F.col("cid") == F.col("tied_cid")) & same(F.col("doc_id"), F.col("first_id")))
    left = saved(left.dropDuplicates(["cid"]).select("cid", "text", "samples"))

    repeats = None
    for k in range(PASSES):
        suffixes = left.mapInArrow(_entries(suffix_places, LENGTH, of_suffixes, (k, PASSES)), _PACKED)
        part = saved(_sorted_buckets(suffixes, of_suffixes // PASSES))
        repeats = part if repeats is None else repeats.unionByName(part)
    repeats = repeats.groupBy("cid").agg(F.collect_list("offs").alias("starts"))
    stripped = left.select("cid", "text").join(repeats, "cid").mapInArrow(
        _strip, "cid long, n_removed long, starts array<long>, ends array<long>, sha string")
    stripped = stripped.withColumnRenamed("sha", "kept_sha")

    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    none = F.array().cast("array<long>")
    return (each.join(first.select("cid", "copies"), "cid").join(stripped, "cid", "left").select(
        "doc_id", "n_bytes",
        F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("starts", none)).alias("starts"),
        F.when(all_gone, F.array("n_bytes")).otherwise(F.coalesce("ends", none)).alias("ends"),
        F.when(all_gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256")))


@register("op10_suffix_dedup")
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that start elsewhere too."""
    found = repeated_spans(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
