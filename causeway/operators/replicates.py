"""Sums for every replicate or simulation without exploded rows.

A task draws one matrix (rows x replicates) for each slice of an Arrow batch and multiplies it with the slice's columns,
so B replicates of p sums cost one matrix product a slice and B * p numbers a partition; those are added by one grouped
aggregate. The draws are the same bits as ``hashing.uniform`` and ``hashing.standard_normal`` give a row: functions of
(id, salt, replicate), whatever the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.digests import digest_words
from causeway.functions.hashing import (SALT_COMMON_CAUSE_A, SALT_COMMON_CAUSE_B, TWO_32, TWO_53, poisson1_thresholds)
from causeway.session import spread

#: Draws held at once by a task.
CELLS = 1 << 20

# The constants of 64-bit xxHash.
_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def key_columns(id_col: str, rng: str, salts: tuple[str, ...]) -> list[Column]:
    """What a task needs of a row's id: its text (md5), or its hash with each salt (xxhash)."""
    c = F.col(f"`{id_col}`")
    if rng == "md5":
        return [c.cast("string")]
    if rng == "xxhash":
        return [F.xxhash64(c, F.lit(s)) for s in salts]
    raise ValueError(f"unknown rng {rng!r}")


def _digests(ids: list[str | None], salt: str, sims: range, words: int) -> np.ndarray:
    """(words, rows, n): the digests' first 32-bit words. A missing id leaves only salt and replicate, as concat_ws does."""
    return digest_words([b"" if i is None else i.encode() + b"-" for i in ids], [f"{salt}-{r}".encode() for r in sims], words)


def _hashed(seed: np.ndarray, sims: range) -> np.ndarray:
    """(rows, n): 64-bit xxHash of the 32-bit numbers ``sims`` after ``seed``."""
    h = (seed.view(np.uint64) + _P5 + np.uint64(4))[:, None] ^ (np.arange(sims.start, sims.stop, dtype=np.uint64) * _P1)[None, :]
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


class Drawn:
    """The draws of a slice of rows: matrices (rows, n), of the replicates 0..n-1 or of a range of them."""

    def __init__(self, keys: list[pa.Array], n: int | range, rng: str, salts: tuple[str, ...]):
        self.sims, self.rng, self.salts = range(n) if isinstance(n, int) else n, rng, salts
        self.keys = keys[0].to_pylist() if rng == "md5" else [k.to_numpy(zero_copy_only=False) for k in keys]

    def uniform(self, salt: str) -> np.ndarray:
        if self.rng == "md5":
            return _digests(self.keys, salt, self.sims, 1)[0] / TWO_32
        return (_hashed(self.keys[self.salts.index(salt)], self.sims) & np.uint64((1 << 53) - 1)) / TWO_53

    def order(self, salt: str) -> np.ndarray:
        """64 bits whose order as unsigned numbers is that of ``hashing.draw_key`` (md5: of the digests themselves)."""
        if self.rng == "md5":
            words = _digests(self.keys, salt, self.sims, 2).astype(np.uint64)
            return (words[0] << np.uint64(32)) | words[1]
        return _hashed(self.keys[self.salts.index(salt)], self.sims) ^ np.uint64(1 << 63)

    def normal(self) -> np.ndarray:
        if self.rng == "md5":
            u1, u2 = _digests(self.keys, SALT_COMMON_CAUSE_A, self.sims, 2) / TWO_32
        else:
            u1, u2 = self.uniform(SALT_COMMON_CAUSE_A), self.uniform(SALT_COMMON_CAUSE_B)
        return np.sqrt(-2.0 * np.log(1.0 - u1)) * np.cos(2 * math.pi * u2)

    def poisson(self, salt: str) -> np.ndarray:
        """Poisson(1) counts, as ``hashing.poisson1_weight``."""
        return np.searchsorted(poisson1_thresholds(), self.uniform(salt), "right").astype(np.uint8)


def _matrix(batch: pa.RecordBatch, at: int) -> np.ndarray:
    cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(at, batch.num_columns)]
    return np.column_stack(cols) if cols else np.zeros((batch.num_rows, 0))


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    step = max(1, CELLS // max(n, 1))
    for b in batches:
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def _added(df: DataFrame, n: int, width: int, sums: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """(n, width): ``sums`` of all slices added up, in tasks first, then by (replicate, column)."""

    def run(batches):
        acc = np.zeros((n, width))
        for b in _slices(batches, n):
            acc += sums(b)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(n, dtype=np.int32), width)),
                                          pa.array(np.tile(np.arange(width, dtype=np.int32), n)),
                                          pa.array(acc.ravel())], names=["rep", "j", "v"])

    out = np.zeros((n, width))
    total = df.mapInArrow(run, "rep int, j int, v double").groupBy("rep", "j").agg(F.sum("v").alias("v")).toArrow()
    rep, j, v = (total.column(k).to_numpy() for k in range(3))
    out[rep, j] = v
    return out


def replicate_sums(df: DataFrame, id_col: str, cols: list[Column], n: int, width: int,
                   sums: Callable[[np.ndarray, Drawn], np.ndarray], rng: str = "md5",
                   salts: tuple[str, ...] = ()) -> np.ndarray:
    """(n, width): ``sums(columns, draws)`` gives a slice's (n, width) sums. Missing values reach it as NaN."""
    keys = key_columns(id_col, rng, salts)
    rows = spread(df).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)],
                             *[c.cast("double").alias(f"_c{i}") for i, c in enumerate(cols)])

    k = len(keys)

    def of_slice(b: pa.RecordBatch) -> np.ndarray:
        return sums(_matrix(b, k), Drawn(b.columns[:k], n, rng, salts))

    return _added(rows, n, width, of_slice)


def weighed(df: DataFrame, id_col: str, cols: list[Column], n: int, salt: str, rng: str = "md5") -> DataFrame:
    """(w, c0, c1, ...): each row's Poisson counts as n bytes, for estimators that pass over the same draws again."""
    keys = key_columns(id_col, rng, (salt,))
    names = [f"c{i}" for i in range(len(cols))]
    rows = spread(df).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)],
                             *[c.cast("double").alias(m) for c, m in zip(cols, names, strict=True)])

    def run(batches):
        for b in _slices(batches, n):
            w = Drawn([b.column(0)], n, rng, (salt,)).poisson(salt)
            data = pa.Array.from_buffers(pa.binary(n), len(w), [None, pa.py_buffer(w.tobytes())])
            yield pa.RecordBatch.from_arrays([data.cast(pa.binary()), *b.columns[1:]], names=["w", *names])

    return rows.mapInArrow(run, ", ".join(["w binary", *[f"{m} double" for m in names]]))


def weighed_sums(rows: DataFrame, n: int, width: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """(n, width) over a ``weighed`` table: ``sums(columns, counts)`` of each slice, added up."""

    def of_slice(b: pa.RecordBatch) -> np.ndarray:
        w = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(b.num_rows, n)
        return sums(_matrix(b, 1), w.astype(float))

    return _added(rows, n, width, of_slice)


def pairs(p: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(p)


def symmetric(values: np.ndarray, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    i, j = pairs(p)
    out[i, j] = out[j, i] = values
    return out
