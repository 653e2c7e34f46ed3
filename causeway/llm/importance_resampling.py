"""Target-distribution importance resampling on hashed n-grams, by prefix CRCs.

A text's words are joined by one blank and scanned once; the running CRC-32 after every word is kept. CRC-32 is linear
over GF(2): the CRC of any run of words follows from the two prefix CRCs around it,

    crc(run) = crc(prefix to its end) xor shift(crc(prefix to its start), bytes of the run),

where shift multiplies by x^(8 bytes) modulo the polynomial. Shifts by powers of two are four table lookups each, so all
n-grams of all lengths cost a few array operations a text and no n-gram is ever spelled out.

A feature's bucket is its CRC modulo ``buckets``. ``features`` keeps the buckets of every document (about two bytes
each); bucket counts are summed inside tasks, then by bucket. A document's weight is the sum of the log ratios of target
to raw frequency over its features, and a Gumbel draw from its id turns the highest scores into a sample without
replacement. Ranks come from one sort and one count for each of its partitions. The driver sees one count a bucket.

Edge cases: null and empty texts, and texts without a word, have no feature and weight 0; they are never drawn where
``least_words`` is positive. Repeated rows are rows of their own. A null id draws as the text "null" and comes last
among ties. Empty tables: no rows, or gains from counts of zero. Further columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.ranks import ranked
from causeway.llm import textbytes as T
from causeway.llm.common import read, register, saved

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

#: Bytes of words: digits, letters, and every byte of a character beyond ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _operator(step) -> np.ndarray:
    """Four tables of 256: what a linear map of 32 bits makes of each of their bytes."""
    image = np.zeros(32, np.uint32)
    for b in range(32):
        image[b] = step(1 << b)
    out = np.zeros((4, 256), np.uint32)
    for q in range(4):
        for b in range(8):
            out[q, np.arange(256) >> b & 1 == 1] ^= image[8 * q + b]
    return out


def apply(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][c >> 8 & 255] ^ tables[2][c >> 16 & 255] ^ tables[3][c >> 24]


#: The CRC's own byte step without its inversions: the effect of one zero byte, a shift by eight.
_BYTE = np.array([zlib.crc32(bytes([b ^ 255]), 0) ^ 0xFF000000 ^ zlib.crc32(b"\xff") ^ 0xFF000000 for b in range(256)], np.uint32)
_SHIFTS = [_operator(lambda c: int(_BYTE[c & 255]) ^ (c >> 8))]


def shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Every CRC multiplied by x^(8 n) modulo the polynomial, its own n each."""
    out = crcs.copy()
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        if k == len(_SHIFTS):
            last = _SHIFTS[-1]
            _SHIFTS.append(_operator(lambda c: apply(last, apply(last, np.array([c], np.uint32)))[0]))
        on = np.flatnonzero(n_bytes >> k & 1)
        out[on] = apply(_SHIFTS[k], out[on])
    return out


def _running(words: list[bytes]) -> np.ndarray:
    """The CRC of ``words[0] words[1] ... words[j]``, joined by blanks, for every j."""
    if not words:
        return np.zeros(0, np.uint32)
    crc = zlib.crc32
    return np.fromiter(accumulate(words[1:], lambda c, w: crc(w, crc(b" ", c)), initial=crc(words[0])), np.uint32, len(words))


def word_runs(column: pa.Array, least: int, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each text its number of words and the CRC-32 of every run of ``least`` to ``most`` words, short runs first."""
    data, offsets = T.byte_runs(column)
    for at, end, raw, offs in T.chunks(data, offsets):
        word = _IS_WORD[raw]
        edge = np.empty(len(raw), bool)
        edge[:1] = True
        edge[1:] = ~word[:-1]
        edge[offs[:-1][offs[:-1] < len(raw)]] = True  # a word never runs on into the next text
        first = np.searchsorted(np.flatnonzero(word & edge), offs)  # number of each text's first word
        low = np.where(word, T._LOWER[raw], 32).astype(np.uint8).tobytes()
        for k in range(end - at):
            n = int(first[k + 1] - first[k])
            words = low[offs[k]:offs[k + 1]].split()
            ends = _running(words)
            # the prefix before word j: all words before it and the blank after them
            starts = np.zeros(n, np.uint32)
            before = ends[:-1] ^ np.uint32(0xFFFFFFFF)
            starts[1:] = _BYTE[(before ^ 32) & 255] ^ (before >> 8) ^ np.uint32(0xFFFFFFFF)
            places = np.zeros(n + 1, np.int64)  # where each word starts in the joined text
            np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=places[1:])
            runs = []
            for size in range(least, most + 1):
                m = max(0, n - size + 1)
                runs.append(ends[size - 1:size - 1 + m] ^ shift(starts[:m], places[size:size + m] - 1 - places[:m]))
            yield n, np.concatenate(runs) if len(runs) > 1 else runs[0]


def features(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets array<int>): the bucket of every run of ``least`` to ``most`` words, repeats included."""
    if not 1 <= least <= most or not 1 <= buckets < 1 << 31:
        raise ValueError("runs of 1 word or more, fewest first, and at least one bucket")
    id_type = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, runs = zip(*word_runs(part.column(1), least, most), strict=True)
                offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
                values = (np.concatenate(runs) % np.uint32(buckets)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))],
                    names=["doc_id", "n_words", "buckets"])

    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"doc_id {id_type}, n_words long, buckets array<int>"))


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values, offsets) of a list column without nulls."""
    offsets = np.asarray(column.offsets)
    return np.asarray(column.values)[offsets[0]:offsets[-1]], offsets - offsets[0]


def bucket_counts(feats: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket holds: one partial count a task, summed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(_values(batch.column(0))[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in feats.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the log ratio of target to raw frequency, each with one added to every bucket, rounded down."""
    n, s_all, t_all = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((float(target[b]) + 1) * s_all / ((float(raw[b]) + 1) * t_all)))
                     for b in range(n)], np.int64)


def weighted(feats: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the sum of a document's gains. ``gains`` holds one number a bucket."""
    id_type = dict(feats.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _values(batch.column(2))
            sums = np.zeros(len(values) + 1, np.int64)
            np.cumsum(gains[values], out=sums[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(np.diff(sums[offsets]))],
                names=["doc_id", "n_words", "n_features", "weight"])

    return feats.select("doc_id", "n_words", "buckets").mapInArrow(run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = BUCKETS,
             percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id",
             text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_features, weight, score, rank (of the drawn, else null).
    Of the documents with ``least_words`` words, ``percent`` of a hundred are drawn, rounded down."""
    feats = saved(features(docs, least, most, buckets, id_col, text_col))
    wanted = features(target.withColumn("_none", F.lit(None).cast("long")), least, most, buckets, "_none", target_text_col)
    gains = bucket_gains(bucket_counts(feats, buckets), bucket_counts(wanted, buckets))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256),
                              1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((draw + 0.5) / F.lit(4294967296.0))))
    scored = weighted(feats, gains).withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= least_words
    placed = ranked(scored, [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.asc("n_features")],
                    rank="rank", store=saved)
    n_able = feats.where(able).count()
    drawn = able & (F.col("rank") <= percent * n_able // 100)
    return placed.withColumn("rank", F.when(drawn, F.col("rank")))


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of distinct words only: eight polynomial steps for each entry of the byte table, then one lookup a byte.
_STEP = "lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
ORACLE = rf"""
WITH bytes AS MATERIALIZED (
  SELECT list(list_reduce([0, 1, 2, 3, 4, 5, 6, 7], {_STEP}, b::BIGINT) ORDER BY b) AS step FROM range(256) AS r(b)
), said AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
), wanted AS (
  SELECT unnest(regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), words AS MATERIALIZED (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM said UNION SELECT w FROM wanted)
), hashed AS MATERIALIZED (
  SELECT w, xor(4294967295, list_reduce(
    list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i::INTEGER + 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, step[1 + xor(c % 256, x)]), 4294967295::BIGINT)) % 10000 AS bucket
  FROM words, bytes
), s AS (
  SELECT bucket, count(*) AS n FROM said JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS n FROM wanted JOIN hashed USING (w) GROUP BY bucket
), gains AS MATERIALIZED (
  SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)
    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM said JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE
      / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (WHERE n_features >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM placed"""


@register("op11_importance_resampling", ORACLE)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents weighed against the benchmark's words; a tenth of those with 20 words is drawn."""
    return (resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
            .select("doc_id", "n_features", "weight", "score", "rank"))
