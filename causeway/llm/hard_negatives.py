"""Hard negatives by exact integer inner products: Strassen products of tiles, mergeable heaps.

Vectors are quantised to int64. Rows are written as blocks of at most ROWS rows; a task takes a block of candidates and,
one after another, the blocks of anchors, and multiplies the two (anchors x dimensions by dimensions x candidates) with
Strassen's recursion: halves in all three dimensions, padded with zeros to even lengths, seven products for eight, down
to LEAF. Sums and products are int64; their ring is exact modulo 2^64, and vectors whose product could leave int64 are
refused.

Two rounds. The first keeps for each anchor its best rows of the same label, the second for each anchor and positive the
best rows of other labels within the positive's window of scores. Both keep fixed-size heaps for each anchor of the
current group inside a task, merge every tile into them at once, and emit them when the task ends; the heaps of all
tasks are then merged by anchor. No pair of rows is ever a row of a table.

Anchors are worked in groups whose blocks, heaps and positives are counted to at most GROUP_BYTES (or one block), and only
such a group is broadcast: two passes over the candidate blocks for each group, so time grows with anchors times rows and
memory with neither.

Edge cases: rows with a null id, label or vector, or a null or non-finite component, take no part; shorter vectors count
as padded with zeros, an empty one scores 0 with every row; equal scores go to the smaller id; a repeated row is a
candidate of its own, and rows of an anchor's own id are never its candidates; of several rows with an anchor's id the one
with the least label and vector is the anchor. An anchor without positives, and a positive without a row in its window,
gives no row. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.ranks import numbered
from causeway.llm.common import read, register, saved

ROWS = 1024
BLOCK_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
LEAF = 32
LEAST = np.iinfo(np.int64).min
_BLOCK = "block long, n long, dim long, most long, ids binary, labels binary, vectors binary"


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b of int64 matrices, modulo 2^64."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= leaf:
        return a @ b
    if n & 1 or k & 1 or m & 1:
        a = np.pad(a, ((0, n & 1), (0, k & 1)))
        b = np.pad(b, ((0, k & 1), (0, m & 1)))
        return strassen(a, b, leaf)[:n, :m]
    n, k, m = n // 2, k // 2, m // 2
    a11, a12, a21, a22 = a[:n, :k], a[:n, k:], a[n:, :k], a[n:, k:]
    b11, b12, b21, b22 = b[:k, :m], b[:k, m:], b[k:, :m], b[k:, m:]
    out = np.empty((2 * n, 2 * m), np.int64)
    p = strassen(a11 + a22, b11 + b22, leaf)
    out[:n, :m] = p
    out[n:, m:] = p
    p = strassen(a21 + a22, b11, leaf)
    out[n:, :m] = p
    out[n:, m:] -= p
    p = strassen(a11, b12 - b22, leaf)
    out[:n, m:] = p
    out[n:, m:] += p
    p = strassen(a22, b21 - b11, leaf)
    out[:n, :m] += p
    out[n:, :m] += p
    p = strassen(a11 + a12, b22, leaf)
    out[:n, :m] -= p
    out[:n, m:] += p
    out[n:, m:] += strassen(a21 - a11, b11 + b12, leaf)
    out[:n, :m] += strassen(a12 - a22, b21 + b22, leaf)
    return out


class Heaps:
    """The best ``size`` (score, id) of each of ``n`` owners: higher scores first, then smaller ids."""

    def __init__(self, n: int, size: int):
        self.size = size
        self.score = np.full((n, size), LEAST, np.int64)
        self.id = np.zeros((n, size), np.int64)
        self.held = np.zeros(n, np.int64)

    def offer(self, scores: np.ndarray, fits: np.ndarray, ids: np.ndarray) -> None:
        """Merge a tile: owners x candidates scores, which of them count, the candidates' ids."""
        # whoever is below the tile's own best, or below a full heap's last, can't come in
        k = min(self.size, scores.shape[1])
        masked = np.where(fits, scores, LEAST)
        floor = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        floor = np.maximum(floor, np.where(self.held == self.size, self.score[:, -1], LEAST))
        owner, column = np.nonzero(fits & (scores >= floor[:, None]))
        if not len(owner):
            return
        touched = np.unique(owner)
        old = np.arange(self.size)[None, :] < self.held[touched, None]
        who = np.concatenate([owner, np.repeat(touched, self.size)[old.ravel()]])
        score = np.concatenate([scores[owner, column], self.score[touched][old]])
        ident = np.concatenate([ids[column], self.id[touched][old]])
        order = np.lexsort((ident, ~score, who))  # ~score falls as score rises and has no overflow
        who, score, ident = who[order], score[order], ident[order]
        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.append(first, len(who))))
        keep = place < self.size
        self.score[who[keep], place[keep]] = score[keep]
        self.id[who[keep], place[keep]] = ident[keep]
        self.held[touched] = np.minimum(np.bincount(who, minlength=len(self.held))[touched], self.size)

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(owner, score, id) of all entries."""
        owner, place = np.nonzero(np.arange(self.size)[None, :] < self.held[:, None])
        return owner, self.score[owner, place], self.id[owner, place]


def quantised(vectors: DataFrame, label: Column, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, label, v array<long>) of the rows that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    size = F.lit(float(2 ** 62))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), v.alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # a component too large for int64 stands as the largest number, which the range check refuses
    whole = F.transform("x", lambda x: F.when(F.abs(x * scale) < size, F.floor(x * scale)).otherwise(F.lit(2 ** 62)))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & sound).select(
        "id", "label", whole.alias("v"))


def blocks(rows: DataFrame) -> DataFrame:
    """Stored blocks of at most ROWS rows: packed ids, labels and the matrix, a row of zero-padded int64 for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                lists = batch.column(2).slice(at, ROWS)
                lengths = np.diff(np.asarray(lists.offsets))
                # rows of one block share the longest one's length; long vectors make short blocks
                widest = np.maximum.accumulate(np.maximum(lengths, 1))
                n = max(1, int(np.count_nonzero(widest * np.arange(1, len(lengths) + 1) * 8 <= BLOCK_BYTES)))
                part, lengths = lists.slice(0, n), lengths[:n]
                dim = int(lengths.max(initial=0))
                matrix = np.zeros((n, dim), np.int64)
                offsets = np.asarray(part.offsets)
                matrix[np.arange(dim)[None, :] < lengths[:, None]] = np.asarray(part.values)[offsets[0]:offsets[-1]]
                most = int(np.abs(matrix).max(initial=0))
                yield pa.RecordBatch.from_pylist([{
                    "n": n, "dim": dim, "most": most, "ids": np.asarray(batch.column(0).slice(at, n)).tobytes(),
                    "labels": np.asarray(batch.column(1).slice(at, n)).tobytes(), "vectors": matrix.tobytes()}],
                    schema=pa.schema([("n", pa.int64()), ("dim", pa.int64()), ("most", pa.int64()), ("ids", pa.binary()),
                                      ("labels", pa.binary()), ("vectors", pa.binary())]))
                at += n

    packed = rows.select("id", "label", "v").mapInArrow(run, _BLOCK.split(", ", 1)[1])
    return numbered(saved(packed.withColumn("block", F.monotonically_increasing_id())), "block")


class Tile:
    """A block read back: its packed ids, labels and matrix."""

    def __init__(self, n: int, dim: int, ids: bytes, labels: bytes, vectors: bytes):
        self.n, self.dim = n, dim
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.int64).reshape(n, dim)

    def products(self, other: Tile) -> np.ndarray:
        dim = min(self.dim, other.dim)  # the zeros beyond the shorter vectors add nothing
        return strassen(np.ascontiguousarray(self.vectors[:, :dim]), np.ascontiguousarray(other.vectors[:, :dim].T))


_TILE = ("n", "dim", "ids", "labels", "vectors")


def _tiled(candidates: DataFrame, anchors: Broadcast, schema: str, heaps: Callable[[int, Tile], object]) -> DataFrame:
    """Every candidate block meets every anchor block of a group; ``heaps(number, block)`` makes an anchor block's heaps,
    whose ``merge`` takes the tiles and whose ``rows`` gives the columns of ``schema`` when the task ends."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if held is None:
                own = [Tile(*block) for block in anchors.value]
                held = [(tile, heaps(k, tile)) for k, tile in enumerate(own)]
            for k in range(batch.num_rows):
                candidate = Tile(*(c[k].as_py() for c in batch.columns))
                for anchor, heap in held:
                    heap.merge(anchor, candidate, anchor.products(candidate))
        for _, heap in held or []:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in heap.rows()], names=names)

    return candidates.select(*_TILE).mapInArrow(run, schema)


class _Positives:
    """Best rows of the same label."""

    def __init__(self, anchor: Tile, size: int):
        self.ids, self.heap = anchor.ids, Heaps(anchor.n, size)

    def merge(self, anchor: Tile, candidate: Tile, scores: np.ndarray) -> None:
        fits = (anchor.labels[:, None] == candidate.labels) & (anchor.ids[:, None] != candidate.ids)
        self.heap.offer(scores, fits, candidate.ids)

    def rows(self):
        owner, score, ident = self.heap.entries()
        return self.ids[owner], score, ident


class _Windows:
    """Best rows of other labels between the bounds of each positive. ``wanted``: (row of the block, number of the
    positive among the row's own, positive's id, its score), ordered."""

    def __init__(self, anchor: Tile, wanted: np.ndarray, size: int, low: int, high: int):
        self.ids, self.low, self.high, self.layers = anchor.ids, low, high, []
        for number in range(int(wanted[:, 1].max(initial=-1)) + 1):
            layer = wanted[wanted[:, 1] == number]
            self.layers.append((layer, Heaps(len(layer), size)))

    def merge(self, anchor: Tile, candidate: Tile, scores: np.ndarray) -> None:
        other = anchor.labels[:, None] != candidate.labels
        hundred = 100 * scores
        for layer, heap in self.layers:
            row, score = layer[:, 0], layer[:, 3, None]
            mine = hundred[row]
            fits = other[row] & (self.low * score <= mine) & (mine <= self.high * score)
            if fits.any():
                heap.offer(scores[row], fits, candidate.ids)

    def rows(self):
        parts = []
        for layer, heap in self.layers:
            owner, score, ident = heap.entries()
            parts.append((self.ids[layer[owner, 0]], layer[owner, 2], layer[owner, 3], layer[owner, 1], ident, score))
        return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 6


def _best(df: DataFrame, by: list[str], score: str, ident: str, size: int, rank: str) -> DataFrame:
    """The heaps of all tasks merged: at most ``size`` rows a task and owner come in."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), F.asc(ident)))
    return df.withColumn(rank, place).where(F.col(rank) <= size)


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, scale: int = 256, n_positives: int = 5,
         n_negatives: int = 10, low: int = 30, high: int = 90, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, positive_score, positive_rank, rank, negative_id, negative_score): for the rows that
    ``is_anchor`` holds for (a condition on ``id``) the best rows of their label, and for each of these the best rows of
    other labels that score from ``low`` to ``high`` hundredths of it. Scores are inner products of floor(scale * x)."""
    spark = vectors.sparkSession
    rows = quantised(vectors, F.col("label") if label is None else label, scale, id_col, vector_col)
    candidates = blocks(rows)
    one = F.min(F.struct("label", "v")).alias("s")
    anchors = blocks(rows.where(is_anchor).groupBy("id").agg(one).select("id", "s.label", "s.v"))
    head = candidates.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"), F.max("most").alias("most")).first()
    own = anchors.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("vectors") + F.length("ids") + F.length("labels")).alias("size"),
                      F.max("most").alias("most")).first()
    if head["n"] and own["n"] and head["dim"] * head["most"] * own["most"] * 100 >= 2 ** 63:
        raise ValueError("an inner product could leave int64: take a smaller scale")
    # what an anchor costs a task: its block's share, its heaps and its row of positives
    cost = (own["size"] or 0) + ROWS * (n_positives * (n_negatives * 16 + 32))
    a_group = max(1, GROUP_BYTES // cost)
    tasks = max(1, -(-head["n"] // 16), min(head["n"], 2 * spark.sparkContext.defaultParallelism))
    candidates = candidates.repartition(tasks, "block")
    schema = "anchor_id long, positive_id long, positive_score long, positive_rank long, negative_id long, negative_score long"
    out = None
    for first in range(0, own["n"], a_group):
        group = anchors.where((F.col("block") > first) & (F.col("block") <= first + a_group)).select(*_TILE).collect()
        blocks_of_group = spark.sparkContext.broadcast([tuple(r) for r in group])
        found = saved(_best(_tiled(candidates, blocks_of_group, "anchor_id long, positive_score long, positive_id long",
                                   lambda k, anchor: _Positives(anchor, n_positives)),
                            ["anchor_id"], "positive_score", "positive_id", n_positives, "positive_rank"))
        wanted = spark.sparkContext.broadcast(_by_block(group, found.collect()))
        part = _tiled(candidates, blocks_of_group, schema,
                      lambda k, anchor, wanted=wanted: _Windows(anchor, wanted.value[k], n_negatives, low, high))
        # a repeated row can be a positive twice: its number keeps the two apart
        part = saved(_best(part, ["anchor_id", "positive_rank"], "negative_score", "negative_id", n_negatives, "rank"))
        blocks_of_group.destroy()
        wanted.destroy()
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema + ", rank int") if out is None else out


def _by_block(group: list, found: list) -> list[np.ndarray]:
    """For each block of a group its positives: (row of the block, number of the positive, its id, its score)."""
    where = {}
    for k, block in enumerate(group):
        for row, i in enumerate(np.frombuffer(block["ids"], np.int64).tolist()):
            where[i] = k, row
    tables: list[list] = [[] for _ in group]
    for r in found:
        k, row = where[r["anchor_id"]]
        tables[k].append((row, r["positive_rank"] - 1, r["positive_id"], r["positive_score"]))
    return [np.array(sorted(t), np.int64).reshape(-1, 4) for t in tables]


ORACLE = """
WITH sound AS MATERIALIZED (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
  SELECT a.id AS anchor_id, b.id AS id, a.label = b.label AS alike,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM sound a JOIN sound b ON a.id % 100 = 0 AND a.id <> b.id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 10"""


@register("op13_hard_negatives", ORACLE)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector's hard negatives among all vectors."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = mine(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
