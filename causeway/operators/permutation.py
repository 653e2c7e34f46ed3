"""Sums over exact permutations of a column, without a sort or a stored row for each simulation.

In a simulation the row with the p-th smallest draw gets the p-th value, counted down. Draws are cut into equal ranges.
One aggregate counts the rows of each range of each simulation, so the places a range covers are known:

* where all its places hold one value (a treatment of few values: all ranges but those at the cuts), a task adds its rows
  up where they lie;
* the rows of other ranges go to the range's task, packed as arrays of draws and columns, are put in order there and meet
  their places' values, which come from one sort of the column for all simulations.

At most AT_ONCE times the table is under way at a time, whatever the number of simulations, and the files of a round's
shuffle are dropped when the round is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_PLACEBO
from causeway.operators.replicates import CELLS, Drawn, _matrix, key_columns, replicate_sums
from causeway.session import cached, shuffles_dropped, spread

#: Rows of a range.
RANGE_ROWS = 1 << 16
#: Rows under way at a time, as a multiple of the table's.
AT_ONCE = 5
_SENT = "part int, sim int, range int, n int, data binary"
_NAMES = ["part", "sim", "range", "n", "data"]


def permuted_products(df: DataFrame, id_col: str, cols: list[Column], mean: float, n_rows: int, n_sims: int, rng: str,
                      levels: list[tuple[float, int]] | None, values: DataFrame | None) -> np.ndarray:
    """(n_sims, columns): the sums of (permuted value - ``mean``) * column. The values are given by ``levels`` (value and
    count), or by ``values``, a table of (_place, value) with places from 1. Ids are present and columns not missing."""
    if not n_rows:
        return np.zeros((n_sims, len(cols)))
    n_ranges = -(-n_rows // RANGE_ROWS)
    salts = (SALT_PLACEBO,)
    keys = key_columns(id_col, rng, salts)
    rows = cached(spread(df).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.col(f"`{id_col}`").alias("_id"),
                                    *[c.cast("double").alias(f"_c{i}") for i, c in enumerate(cols)]))
    spark = df.sparkSession
    try:
        with shuffles_dropped(spark):
            def count(_, draws):
                at = _range(draws.order(SALT_PLACEBO), n_ranges) + np.arange(n_sims) * n_ranges
                return np.bincount(at.ravel(), minlength=n_sims * n_ranges).reshape(n_sims, n_ranges)

            counts = replicate_sums(rows, "_id", [], n_sims, n_ranges, count, rng, salts).astype(np.int64)
            first = np.cumsum(counts, axis=1) - counts
            whole = _whole(first, counts, levels, mean)
            sent = np.where(np.isnan(whole), counts, 0).sum(axis=1)
            narrow = rows.drop("_id")
            parts = [_round(narrow, sims, first, counts, whole, mean, rng, levels, values, len(cols))
                     for sims in _rounds(sent, AT_ONCE * n_rows)]
    finally:
        rows.unpersist()
    return np.concatenate(parts)


def _range(order: np.ndarray, n: int) -> np.ndarray:
    return (((order >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _whole(first: np.ndarray, counts: np.ndarray, levels: list[tuple[float, int]] | None, mean: float) -> np.ndarray:
    """(simulations, ranges): the centred value of all of a range's places; NaN where they have several."""
    if levels is None:
        return np.full(first.shape, np.nan)
    value, ends = _falling(levels)
    low = np.searchsorted(ends, first, "right")
    high = np.searchsorted(ends, first + np.maximum(counts, 1) - 1, "right")
    return np.where(low == high, value[np.minimum(low, len(value) - 1)] - mean, np.where(counts > 0, np.nan, 0.0))


def _falling(levels: list[tuple[float, int]]) -> tuple[np.ndarray, np.ndarray]:
    down = sorted(levels, reverse=True)
    return np.array([float(v) for v, _ in down]), np.cumsum([c for _, c in down])


def _rounds(sent: np.ndarray, most: int) -> list[range]:
    """Runs of simulations that send at most so many rows together, or one simulation."""
    out, start, held = [], 0, 0
    for s, n in enumerate(sent.tolist()):
        if s > start and held + n > most:
            out.append(range(start, s))
            start, held = s, 0
        held += n
    return [*out, range(start, len(sent))]


def _round(rows: DataFrame, sims: range, first: np.ndarray, counts: np.ndarray, whole: np.ndarray, mean: float, rng: str,
           levels: list[tuple[float, int]] | None, values: DataFrame | None, width: int) -> np.ndarray:
    n_ranges = first.shape[1]
    own = slice(sims.start, sims.stop)
    first, counts, whole = first[own], counts[own], whole[own]
    packed = rows.mapInArrow(_packing(sims, whole, rng, width, levels is None), _SENT)
    parts = n_ranges if levels is None else int(np.isnan(whole).sum()) + len(sims)
    if levels is None:
        packed = packed.unionAll(values.mapInArrow(_places(first.min(axis=0), (first + counts).max(axis=0)), _SENT))
    tasks = max(1, min(parts, max(rows.sparkSession.sparkContext.defaultParallelism, parts // 4)))
    sums = packed.repartition(tasks, "part").mapInArrow(_ordered(sims, first, mean, width, levels), "sim int, j int, v double")
    total = sums.groupBy("sim", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((len(sims), width))
    sim, j, v = (total.column(k).to_numpy() for k in range(3))
    out[sim - sims.start, j] = v
    return out


def _packing(sims: range, whole: np.ndarray, rng: str, width: int, by_range: bool):
    """A task's rows as one record for each simulation and range of a slice; what needs no order is added up."""
    n_keys, n_ranges, at_sim = 1, whole.shape[1], np.arange(len(sims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        added = np.zeros((len(sims), width))
        for b in _joined(batches, max(1, CELLS // len(sims))):
            draws = Drawn(b.columns[:n_keys], sims, rng, (SALT_PLACEBO,)).order(SALT_PLACEBO)
            x = _matrix(b, n_keys)
            at = _range(draws, n_ranges)
            value = whole[at_sim, at]
            unknown = np.isnan(value)
            added += np.where(unknown, 0.0, value).T @ x
            found = []
            for s in np.flatnonzero(unknown.any(axis=0)):
                r = np.flatnonzero(unknown[:, s])
                r = r[np.argsort(at[r, s], kind="stable")]
                ranges, starts = np.unique(at[r, s], return_index=True)
                for k, lo, hi in zip(ranges.tolist(), starts.tolist(), [*starts[1:].tolist(), len(r)]):
                    some = r[lo:hi]
                    data = draws[some, s].tobytes() + np.ascontiguousarray(x[some].T).tobytes()
                    found.append((k if by_range else int(s) * n_ranges + k, sims.start + int(s), k, hi - lo, data))
            yield from _records(found)
        # added up: no range, and a part that the records of no range need
        yield from _records([(-1 - s, sims.start + s, -1, 1, added[s].tobytes()) for s in range(len(sims))])

    return run


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about so many rows."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _records(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    if found:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=_NAMES)


def _places(low: np.ndarray, high: np.ndarray):
    """The sorted values for each range that has one of their places in a simulation of the round."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _joined(batches, CELLS):
            place, value = b.column(0).to_numpy() - 1, b.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(place, kind="stable")
            place, value = place[order], value[order]
            starts, ends = np.searchsorted(place, low), np.searchsorted(place, high)
            yield from _records([(int(k), -1, int(k), int(ends[k] - starts[k]),
                                  place[starts[k]:ends[k]].astype(np.int64).tobytes() + value[starts[k]:ends[k]].tobytes())
                                 for k in np.flatnonzero(ends > starts)])

    return run


def _ordered(sims: range, first: np.ndarray, mean: float, width: int, levels: list[tuple[float, int]] | None):
    """The sums of a task's ranges: rows in the order of their draws beside the values of their places."""
    falling = None if levels is None else _falling(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        values: dict[int, list] = {}
        out = np.zeros((len(sims), width))
        for b in batches:
            for sim, k, n, data in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
                if k < 0:
                    out[sim - sims.start] += np.frombuffer(data)
                elif sim < 0:
                    values.setdefault(k, []).append((np.frombuffer(data, np.int64, n), np.frombuffer(data, float, n, 8 * n)))
                else:
                    held.setdefault((k, sim), []).append((np.frombuffer(data, np.uint64, n),
                                                          np.frombuffer(data, float, n * width, 8 * n).reshape(width, n)))
        sorted_values = {}
        for k, got in values.items():
            place, value = (np.concatenate(x) for x in zip(*got))
            order = np.argsort(place)
            sorted_values[k] = (int(place[order[0]]), value[order])
        for k, sim in list(held):
            draws, x = zip(*held.pop((k, sim)))
            draws, x = np.concatenate(draws), np.concatenate(x, axis=1)
            order = np.argsort(draws)
            if (np.diff(draws[order]) == 0).any():  # rows of one id: by their columns, whatever order they came in
                order = np.lexsort((*x, draws))
            start = int(first[sim - sims.start, k])
            if falling:
                value = falling[0][np.searchsorted(falling[1], start + np.arange(len(order)), "right")]
            else:
                low, all_ = sorted_values[k]
                value = all_[start - low:start - low + len(order)]
            out[sim - sims.start] += x[:, order] @ (value - mean)
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used + sims.start, width).astype(np.int32)),
                                          pa.array(np.tile(np.arange(width, dtype=np.int32), len(used))),
                                          pa.array(out[used].ravel())], names=["sim", "j", "v"])

    return run
