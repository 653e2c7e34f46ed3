"""Whole texts of an Arrow batch as one byte array: words, word n-grams and window hashes without a Python loop over
characters. Hashes are 64-bit polynomial sums over the bytes (random odd base, random value for each byte) finished by
an avalanche step; equal strings have equal hashes in every batch, task and run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_GOLD = U(0x9E3779B97F4A7C15)
_BASE = U(0xD6E8FEB86659FD93)  # odd, so that its powers can be undone modulo 2^64
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = U(0xA0761D6478BD642F)
CHUNK = 1 << 18


def avalanche(x: np.ndarray) -> np.ndarray:
    x = x + _GOLD
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_VALUE = avalanche(np.arange(1, 257, dtype=U))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; kept for the next call."""
    if len(_powers[0]) < n:
        n = max(n, 2 * CHUNK)
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def byte_runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, their bytes, their offsets) with about CHUNK bytes, or a single longer text."""
    at = 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


def prefix_sums(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * powers(len(data) + 1)[0][:len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end) each; spans of different length don't meet."""
    raw = (sums[end] - sums[start]) * powers(len(sums))[1][start]
    return avalanche(raw + (end - start).astype(U) * _STEP)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of the first word of each text (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _IS_WORD[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~word[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True  # a word never runs on into the next text
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~word[1:]
    ends_at = offsets[1:][offsets[1:] > 0] - 1
    last[ends_at] = True
    starts = np.flatnonzero(word & first)
    return starts, np.flatnonzero(word & last) + 1, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its n-word shingles, A-Z lower-cased: with fewer words the whole
    sequence as one, without words none."""
    data, offsets = byte_runs(column)
    for at, end, part, offs in chunks(data, offsets):
        part = _LOWER[part]
        starts, ends, first = word_spans(part, offs)
        words = span_hashes(prefix_sums(part), starts, ends)
        total = np.zeros(max(0, len(words) - n + 1), U)
        for j in range(n):
            total = total * _STEP + words[j:len(words) - n + 1 + j]
        total = avalanche(total + U(n))
        for k in range(end - at):
            a, b = int(first[k]), int(first[k + 1])
            if b - a >= n:
                yield np.unique(total[a:b - n + 1])
            elif b > a:
                short = U(0)
                with np.errstate(over="ignore"):
                    for w in words[a:b]:
                        short = short * _STEP + w
                    yield avalanche(np.array([short + U(b - a)], U))
            else:
                yield np.zeros(0, U)
