"""Random forests of several models grown together, one histogram aggregate a level.

All trees of all models (the nuisances of every fold, both arms of a learner) grow level by level in step. For a level
every task walks its rows down the trees so far, whose nodes are a broadcast table, and counts them by (model, tree,
node, feature, bin); the counts are merged by tree, each node's best split is found where its counts lie, and one row for
each split node reaches the driver. So there are as many jobs as levels, whatever the number of models and trees.

Where the features' bins have few combinations (two or three features), rows are first added up by combination: one pass over
the table counts each model's and tree's drawn rows, and a tree grows to its leaves where its counts lie, with the same
sums and so the same splits. Predictions look up a row's combination of the trees' intervals, likewise.

* Features are cut into at most ``max_bins`` bins at exact quantiles; a split is "at most the bin's upper edge".
* A row's bootstrap weight in a tree is a Poisson(1) draw from its id, shared by the models: no draw depends on how rows
  are partitioned.
* Labels (times their weights) are rounded to whole numbers of 2^-33 of their reach, weights likewise: all sums are integers, so
  trees are the same, bit for bit, under any partitioning, retry or executor loss.
* A split maximises the reduction of the weighted squared error. For a 0/1 label that is the Gini criterion, and the mean
  of the leaf means is the class probability.

A prediction touches only the trees of the row's own model and comes back as one column: no other column of the table
passes through Python.

What is collected and broadcast is bounded by the settings: at most NODES nodes in all trees, checked before the growth.
Missing features are an error, as are labels or weights that aren't finite. A model without rows, or without weight,
predicts null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.quantiles import exact_quantiles
from causeway.operators.complete import absent
from causeway.session import materialize, spread

#: Nodes of all trees of a growth that may be held by the driver and broadcast: 24 bytes each.
NODES = 50_000_000
#: Rows of a task that are walked down the trees at once, and cells of its counts that are held at once.
ROWS = 4096
CELLS = 4_000_000
#: Bytes of a task's counts by combination of bins, and combinations that predictions are looked up by.
JOINT = 64 << 20
LOOKED_UP = 1 << 14
#: Rows multiplied at once: their sums stay below 2^53.
BLOCK = 1 << 15
#: Bytes of counts that a task searches for splits.
SEARCHED = 64 << 20
_GRAIN = 33
_U = np.uint64


@dataclass(frozen=True)
class Forest:
    """Forest settings. Regressors consider every feature at each split and classifiers the square root of them (the
    published defaults of the learners)."""
    num_trees: int = 100
    max_depth: int = 10
    seed: int = 42
    min_instances_per_node: int = 1
    max_bins: int = 64


@dataclass(frozen=True)
class Target:
    """One model: its label, the rows it learns from (all if None), a weight column, and whether it is a classifier."""
    label: Column
    rows: Column | None = None
    weight: Column | None = None
    classifier: bool = False


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Cumulative Poisson(1) probabilities as 53-bit whole numbers.
_POISSON = np.array([int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2 ** 53) for k in range(17)], np.int64)


#: Thresholds by a draw's upper 12 bits: how many lie at or below the least such draw, and the next one.
_SHIFT = 41
_BELOW = np.searchsorted(_POISSON, np.arange(1 << 12) << _SHIFT, side="right").astype(np.uint8)
_NEXT = np.append(_POISSON, 1 << 53)[_BELOW]
_SEVERAL = np.append(_BELOW[1:], len(_POISSON)) - _BELOW > 1
#: Counts by a draw's upper 16 bits; _UNSURE where a threshold lies among the draws that share them.
_UNSURE = 255
_COUNT = np.searchsorted(_POISSON, np.arange(1 << 16) << 37, side="right").astype(np.uint8)
_COUNT[_POISSON[_POISSON < 1 << 53] >> 37] = _UNSURE


def _counts(draw: np.ndarray) -> np.ndarray:
    """Counts of 53-bit draws."""
    top = draw >> _SHIFT
    out = _BELOW[top] + (draw >= _NEXT[top])
    several = _SEVERAL[top]
    out[several] = np.searchsorted(_POISSON, draw[several], side="right")
    return out


def bootstrap_counts(ids: np.ndarray, trees: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (hash of its id) is drawn for each tree: rows x trees."""
    with np.errstate(over="ignore"):
        salt = _mix((trees.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed))
        draw = ids.view(_U)[:, None] ^ salt[None, :]
        spare = np.empty_like(draw)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # _mix, in place
            draw ^= np.right_shift(draw, _U(shift), out=spare)
            draw *= _U(times)
        draw ^= np.right_shift(draw, _U(31), out=spare)
    out = _COUNT[np.right_shift(draw, _U(48), out=spare).view(np.int64)]
    unsure = np.flatnonzero(out == _UNSURE)
    out.ravel()[unsure] = _counts((draw.ravel()[unsure] >> _U(11)).view(np.int64))
    return out


class Trees:
    """Trees of one model as arrays over heap-numbered nodes: the children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, feature: np.ndarray, edge: np.ndarray, value: np.ndarray, gain: np.ndarray, n_features: int):
        self.feature, self.edge, self.value, self.gain, self.n_features = feature, edge, value, gain, n_features

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row in every tree: rows x trees."""
        n, trees = len(x), len(self.feature)
        size = self.feature.shape[1]
        base = (np.arange(trees) * size)[None, :]
        feature, edge = self.feature.ravel(), self.edge.ravel()
        flat, row = x.ravel(), (np.arange(n) * x.shape[1])[:, None]
        node = np.zeros((n, trees), np.int64)
        for _ in range(int(size).bit_length() - 1):
            at = base + node
            f = feature[at]
            inner = f >= 0
            if not inner.any():
                break
            right = flat[row + np.where(inner, f, 0)] > edge[at]
            node = np.where(inner, 2 * node + 1 + right, node)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean over the trees; NaN where the model has learned nothing."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))[None, :]
        for at in range(0, len(x), ROWS):
            part = self.leaves(x[at:at + ROWS])
            values = self.value[trees, part]
            known = ~np.isnan(values)
            n = known.sum(axis=1)
            out[at:at + ROWS] = np.where(n > 0, np.where(known, values, 0.0).sum(axis=1) / np.maximum(n, 1), np.nan)
        return out

    def importances(self) -> np.ndarray:
        """Impurity decrease by feature, each tree's adding up to 1, averaged."""
        total = np.zeros(self.n_features)
        for feature, gain in zip(self.feature, self.gain):
            own = np.bincount(feature[feature >= 0], gain[feature >= 0], self.n_features)
            total += own / own.sum() if own.sum() > 0 else 0.0
        return total / total.sum() if total.sum() > 0 else total


class Cells:
    """The combinations of the intervals that trees tell apart: each tree takes all rows of one the same way."""

    def __init__(self, model: Trees):
        self.edges = [np.unique(model.edge[model.feature == f]) for f in range(model.n_features)]
        self.shape = tuple(len(e) + 1 for e in self.edges)
        self.size = math.prod(self.shape)

    def points(self) -> np.ndarray:
        """A row of each."""
        grid = np.meshgrid(*[np.append(e, np.inf) for e in self.edges], indexing="ij")
        return np.stack([g.ravel() for g in grid], axis=1)

    def of(self, x: np.ndarray) -> np.ndarray:
        # a missing value is above no edge
        places = [np.where(np.isnan(v), 0, np.searchsorted(e, v, "left")) for e, v in zip(self.edges, x.T)]
        return np.ravel_multi_index(places, self.shape)


class Lookup:
    """``values`` of rows, a function of the leaves a model's trees give them, computed once for each of its cells."""

    def __init__(self, model: Trees, values: Callable[[np.ndarray], np.ndarray]):
        cells = Cells(model)
        self.cells = cells if cells.size <= LOOKED_UP else None
        self.known = values(cells.points()) if self.cells else values

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.known[self.cells.of(x)] if self.cells else self.known(x)


def _edges(df: DataFrame, feats: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins: distinct values at or between the quantiles k / bins. The last bin has none."""
    got = exact_quantiles(df, feats, [k / bins for k in range(1, bins)] + [1.0])
    return [np.array([e for e in sorted(set(got[f][:-1])) if e < got[f][-1]]) if got[f][-1] is not None else np.zeros(0) for f in feats]


def _bin(column: Column, edges: np.ndarray) -> Column:
    """Number of edges below the value: halved at an edge at a time, which is compiled code."""
    x, at = column.cast("double"), edges.tolist()

    def between(low: int, high: int) -> Column:
        mid = (low + high) // 2
        return F.lit(low) if low == high else F.when(x <= F.lit(at[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return F.when(x.isNull(), F.lit(0)).otherwise(between(0, len(at)))


def _whole(x: Column) -> Column:
    """The nearest whole number, halves away from zero, as ``round`` gives it, which goes through decimal text."""
    size = F.abs(x)
    low = F.floor(size)
    near = low + F.when(size - low >= 0.5, F.lit(1)).otherwise(F.lit(0))
    return F.when(x < 0, -near).otherwise(near).cast("long")


def _table(df: DataFrame, id_col: str | None, feats: list[str], targets: list[Target], edges: list[np.ndarray], dealt: bool,
           raw: bool = False):
    """The rows of a growth (hash of the id, bins, or with ``raw`` the values, of the features, a weight and a weighted
    label of whole numbers for each target) and each target's (mean, grain of the labels, grain of the weights); None for a target without rows."""
    label = [t.label.cast("double") for t in targets]
    weight = [F.lit(1.0) if t.weight is None else t.weight.cast("double") for t in targets]
    weight = [w if t.rows is None else F.when(t.rows, w).otherwise(0.0) for t, w in zip(targets, weight)]
    aggs = [F.sum(F.when(F.greatest(*[absent(df, f).cast("int") for f in feats], F.lit(0)) > 0, 1).otherwise(0)).alias("gone"),
            F.count(F.lit(1)).alias("n")]
    for m, (y, w) in enumerate(zip(label, weight)):
        used = w > 0
        aggs += [F.sum(w).alias(f"w{m}"), F.max(w).alias(f"wm{m}"), F.max(F.when(used, w * F.abs(y))).alias(f"wy{m}"), F.min(F.when(used, y)).alias(f"lo{m}"), F.max(F.when(used, y)).alias(f"hi{m}"),
                 F.sum(F.when((w < 0) | (used & (y.isNull() | F.isnan(y) | (F.abs(y) == math.inf))), 1).otherwise(0)).alias(f"bad{m}")]
    r = df.agg(*aggs).first()
    if r["gone"]:
        raise ValueError(f"{r['gone']} rows miss a feature; impute or drop them")
    if any(r[f"bad{m}"] for m in range(len(targets))):
        raise ValueError("labels must be present and finite and weights not negative")
    # whole numbers: a batch's sums stay below 2^53 and the table's below 2^62
    room = min(_GRAIN, 61 - math.ceil(math.log2(max(r["n"], 1) * 16)))
    scales, columns = [], []
    for m, (y, w) in enumerate(zip(label, weight)):
        if not r[f"w{m}"]:
            scales.append(None)
            columns += [F.lit(0).cast("long").alias(f"w{m}"), F.lit(0).cast("long").alias(f"s{m}")]
            continue
        # labels are taken from the middle of their range; with weights, where a label may be large because its weight is
        # small, from 0
        plain = targets[m].weight is None
        mid = (r[f"lo{m}"] + r[f"hi{m}"]) / 2 if plain else 0.0
        reach = r[f"hi{m}"] - mid if plain else r[f"wy{m}"]
        grain_w = 1.0 if plain else 2.0 ** (room - math.ceil(math.log2(r[f"wm{m}"])))
        grain_s = 2.0 ** (room - math.ceil(math.log2(reach))) if reach > 0 else 1.0
        scales.append((mid, grain_s, grain_w))
        columns += [_whole(w * F.lit(grain_w)).alias(f"w{m}"),
                    F.when(w > 0, _whole(w * (y - F.lit(mid)) * F.lit(grain_s))).otherwise(0).cast("long").alias(f"s{m}")]
    key = F.xxhash64(F.col(f"`{id_col}`")) if id_col else F.xxhash64(*[F.col(f"`{c}`") for c in feats], *[y for y in label])
    rows = (df if dealt else spread(df)).select(key.alias("key"), *[(F.col(f"`{f}`").cast("double") if raw else _bin(F.col(f"`{f}`"), e).cast("short")).alias(f"b{i}")
                                                               for i, (f, e) in enumerate(zip(feats, edges))], *columns)
    return rows, scales


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {name: batch.column(i).to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}


def _count_level(rows: DataFrame, state, level: int, n_models: int, n_trees: int, n_features: int, bins: int, seed: int) -> DataFrame:
    """(key, counts): one row for each task and tree (key: model x trees + tree), its counts by cell (number of the open
    node, feature, bin) packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feature, split, number, open_ = state.value  # keys x nodes; number of open nodes at this level by key
        parts = [_columns(b) for b in batches]
        if not parts:
            return
        c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}  # one task's share: a few numbers a row and model
        b = np.stack([c[f"b{f}"] for f in range(n_features)], axis=1).astype(np.int64)
        cells = int(open_.max(initial=1)) * n_features * bins
        at_once = max(1, CELLS // cells)
        for m in range(n_models):
            mine = np.flatnonzero(c[f"w{m}"] > 0)
            for first in range(0, n_trees, at_once):
                trees = np.arange(first, min(n_trees, first + at_once))
                keys = m * n_trees + trees
                if not len(mine) or not open_[keys].any():
                    continue
                total = np.zeros((3, len(trees) * cells), np.int64)
                waiting, held = [], 0
                for at in range(0, len(mine), ROWS):
                    own = mine[at:at + ROWS]
                    waiting.append(_walk(b[own], c["key"][own], c[f"w{m}"][own], c[f"s{m}"][own], trees, keys, feature, split,
                                         number, level, n_features * bins, cells, seed))
                    held += len(waiting[-1][0])
                    if held > CELLS or at + ROWS >= len(mine):
                        _add(total, [np.concatenate(x) for x in zip(*waiting)], n_features, bins)
                        waiting, held = [], 0
                packed = [_packed(total[:, t * cells:(t + 1) * cells]) for t in range(len(trees))]
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(packed, pa.binary())], names=["key", "counts"])

    return rows.mapInArrow(run, "key int, counts binary")


def _walk(b, ids, w, s, trees, keys, feature, split, number, level, per_node, cells, seed) -> tuple:
    """Some rows down some trees: for each row that a tree has drawn and that is in an open node, the node's first cell
    among the trees' cells, the row's bins, weight, label and count."""
    n, size, n_features = len(b), feature.shape[1], b.shape[1]
    flat_f, flat_s, flat_b = feature.ravel(), split.ravel(), b.ravel()
    r, t = np.nonzero(drawn := bootstrap_counts(ids, trees, seed))
    k, base, row = drawn[r, t], keys[t] * size, r * n_features
    node = np.zeros(len(r), np.int64)
    for _ in range(level):
        at = base + node
        f = flat_f[at]
        inner = f >= 0
        if not inner.all():  # rows whose leaf is reached are done
            r, t, k, base, row, node, at, f = (x[inner] for x in (r, t, k, base, row, node, at, f))
        node = 2 * node + 1 + (flat_b[row + f] > flat_s[at])
    place = number.ravel()[base + node]
    if (place < 0).any():
        r, t, k, place = (x[place >= 0] for x in (r, t, k, place))
    return t * cells + place * per_node, b[r], w[r] * k, s[r] * k, k


def _add(total, found, n_features, bins) -> None:
    start, b, w, s, k = found
    for f in range(n_features):
        cell = start + f * bins + b[:, f]
        for i, x in enumerate((w, s, k)):
            total[i] += np.bincount(cell, x, total.shape[1]).astype(np.int64)


def _best_splits(counts: DataFrame, keys: int, cells: int, n_features: int, bins: int, least: int, subset: np.ndarray, level: int,
                 n_trees: int, seed: int) -> DataFrame:
    """One row for each open node: its totals and its best split (feature -1: none). A tree's counts meet in one task as a
    stream of packed rows; the task holds nodes x features x bins numbers for each of its trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches, cells)
        for key in list(held):
            total = held.pop(key)
            nodes = int(np.flatnonzero(total[2])[-1]) // (n_features * bins) + 1
            total = total[:, :nodes * n_features * bins].reshape(3, nodes, n_features, bins)
            found = _search(key, total, least, subset[key // n_trees], level, seed)
            yield _split_rows(key, [np.arange(nodes), *found])

    return _by_tree(counts, keys, cells).mapInArrow(run, _SPLIT_TYPES)


def _by_tree(counts: DataFrame, keys: int, cells: int) -> DataFrame:
    parts = max(1, min(keys, -(-keys * cells * 24 // SEARCHED)), min(keys, counts.sparkSession.sparkContext.defaultParallelism))
    return counts.where(F.length("counts") > 0).repartition(parts, "key")


def _held(batches: Iterator[pa.RecordBatch], cells: int) -> dict[int, np.ndarray]:
    """By tree the weights, labels and counts of its cells, from packed rows."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for key, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = packed.as_buffer()
            n = data.size // 28
            cell = np.frombuffer(data, np.int32, n)
            if key not in held:
                held[key] = np.zeros((3, cells), np.int64)
            for i, at in ((2, 4), (0, 12), (1, 20)):
                held[key][i, cell] += np.frombuffer(data, np.uint8)[at * n:(at + 8) * n].view(np.int64)
    return held


def _packed(total: np.ndarray) -> bytes:
    w, s, n = total
    got = np.flatnonzero(n)
    return got.astype(np.int32).tobytes() + n[got].tobytes() + w[got].tobytes() + s[got].tobytes()


def _search(key: int, total: np.ndarray, least: int, considered: int, level: int, seed: int) -> list[np.ndarray]:
    """The best splits of a tree's open nodes from their (weights, labels, counts) x nodes x features x bins: feature (-1:
    none), bin, gain, the node's weight and label, and those of its left side."""
    _, nodes, n_features, bins = total.shape
    per_node = n_features * bins
    w, s, c = total
    wl, sl, cl = (np.cumsum(x, axis=2) for x in (w, s, c))
    wt, st, ct = (x[:, :, -1:] for x in (wl, sl, cl))
    ok = (wl > 0) & (wt - wl > 0) & (cl >= least) & (ct - cl >= least)
    if considered < n_features:  # the features of the least draws, a draw for each node
        with np.errstate(over="ignore"):
            at = np.arange(nodes)[:, None] * n_features + np.arange(n_features)[None, :]
            draw = _mix(_mix(_U(key * 64 + level + 1) * _U(0x9E3779B97F4A7C15) + _U(seed)) ^ at.astype(_U))
        ok &= (np.argsort(np.argsort(draw, axis=1), axis=1) < considered)[:, :, None]
    left, right, whole = (sl.astype(float) ** 2 / np.maximum(wl, 1), (st - sl).astype(float) ** 2 / np.maximum(wt - wl, 1),
                          st.astype(float) ** 2 / np.maximum(wt, 1))
    gain = np.where(ok, left + right - whole, -1.0)
    gain = np.where(gain > 1e-12 * (left + right), gain, -1.0).reshape(nodes, per_node)
    best = gain.argmax(axis=1)
    at = np.arange(nodes)
    split = gain[at, best] > 0
    pick = lambda x: x.reshape(nodes, per_node)[at, best]
    return [np.where(split, best // bins, -1), best % bins, gain[at, best], wt[:, 0, 0], st[:, 0, 0], pick(wl), pick(sl)]


def _split_rows(key: int, columns: list[np.ndarray]) -> pa.RecordBatch:
    types = [np.int32, np.int32, np.int32, float, *[np.int64] * 4]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), key, np.int32)),
                                       *[pa.array(c.astype(t)) for c, t in zip(columns, types)]], names=_SPLIT)


def _count_cells(rows: DataFrame, n_models: int, n_trees: int, edges: list[np.ndarray], seed: int) -> DataFrame:
    """(key, counts): one row for each task and tree, its counts by combination of bins packed. A slice's rows are put in the
    order of their combinations, and the draws of each multiplied with its weights, labels and counts."""
    shape, trees = tuple(len(e) + 1 for e in edges), np.arange(n_trees)
    size = math.prod(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, n_trees, n_models, 3), np.int64)
        for batch in _blocks(batches):
            c = _columns(batch)
            cell = np.ravel_multi_index([np.searchsorted(e, c[f"b{f}"], "left") for f, e in enumerate(edges)], shape)
            w = np.stack([c[f"w{m}"] for m in range(n_models)], axis=1)
            used = np.flatnonzero((w > 0).any(axis=1))
            if not len(used):
                continue
            used = used[np.argsort(cell[used], kind="stable")]
            cell, w = cell[used], w[used]
            s = np.stack([c[f"s{m}"] for m in range(n_models)], axis=1)[used]
            columns = np.stack([w, np.where(w > 0, s, 0), w > 0], axis=2).astype(float).reshape(len(used), -1)
            drawn = np.empty((len(used), n_trees))
            for at in range(0, len(used), 512):
                drawn[at:at + 512] = bootstrap_counts(c["key"][used[at:at + 512]], trees, seed)
            first = np.flatnonzero(np.diff(cell, prepend=-1))
            for lo, hi in zip(first, [*first[1:], len(cell)]):
                total[cell[lo]] += (drawn[lo:hi].T @ columns[lo:hi]).astype(np.int64).reshape(n_trees, n_models, 3)
        if total.any():
            total = total.transpose(2, 1, 3, 0).reshape(n_models * n_trees, 3, size)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)),
                                              pa.array([_packed(t) for t in total], pa.binary())], names=["key", "counts"])

    return rows.mapInArrow(run, "key int, counts binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined and cut to BLOCK rows at most."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if held and n + part.num_rows > BLOCK:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _whole_trees(counts: DataFrame, keys: int, shape: tuple[int, ...], bins: int, depth: int, least: int, subset: np.ndarray,
                 n_trees: int, seed: int) -> DataFrame:
    """One row for each node that was open at a level, by its place in the tree: as ``_best_splits``, for all levels."""
    size, p = math.prod(shape), len(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _held(batches, size)
        for key in list(held):
            total = held.pop(key)
            cell = np.flatnonzero(total[2])
            total, b = total[:, cell], np.stack(np.unravel_index(cell, shape))
            node, places = np.zeros(len(cell), np.int64), np.zeros(1, np.int64)
            for level in range(depth):
                by_bin = np.zeros((3, len(places), p, bins), np.int64)
                for f in range(p):
                    for i in range(3):
                        np.add.at(by_bin[i, :, f], (node, b[f]), total[i])
                found = _search(key, by_bin, least, subset[key // n_trees], level, seed)
                yield _split_rows(key, [places, *found])
                feature, split = found[:2]
                inner = feature >= 0
                if not inner.any():
                    break
                kept = inner[node]
                total, b, node = total[:, kept], b[:, kept], node[kept]
                right = b[feature[node], np.arange(len(node))] > split[node]
                node = 2 * (np.cumsum(inner) - 1)[node] + right
                places = (2 * places[inner][:, None] + np.array([1, 2])).ravel()

    return _by_tree(counts, keys, size).mapInArrow(run, _SPLIT_TYPES)


_SPLIT_TYPES = "key int, node int, feature int, split int, gain double, w long, s long, wl long, sl long"
_SPLIT = ["key", "node", "feature", "split", "gain", "w", "s", "wl", "sl"]


def grow(df: DataFrame, id_col: str | None, feats: list[str], targets: list[Target], settings: Forest, dealt: bool = False) -> list[Trees]:
    """The forests of all targets, grown together. ``dealt``: the rows are over the cores already (``session.held_rows``)."""
    if not feats or not all(isinstance(df.schema[f].dataType, T.NumericType) for f in feats):
        raise ValueError("features must be numeric, and there must be one")
    n_models, n_trees, depth, p = len(targets), settings.num_trees, settings.max_depth, len(feats)
    size, keys = 2 ** (depth + 1) - 1, len(targets) * settings.num_trees
    if keys * size > NODES:
        raise ValueError(f"{n_models} models of {n_trees} trees of depth {depth} could have more than {NODES} nodes")
    edges = _edges(df, feats, settings.max_bins)
    bins = max(len(e) for e in edges) + 1
    shape = tuple(len(e) + 1 for e in edges)
    joint = math.prod(shape) * keys * 24 <= JOINT
    rows, scales = _table(df, id_col, feats, targets, edges, dealt, raw=joint)
    subset = np.array([math.ceil(math.sqrt(p)) if t.classifier else p for t in targets])
    feature, split = np.full((keys, size), -1, np.int16), np.zeros((keys, size), np.int16)
    gain, w, s = np.zeros((keys, size)), np.zeros((keys, size), np.int64), np.zeros((keys, size), np.int64)

    def put(key, node, got):
        """Open nodes and their splits into the trees."""
        root = node == 0
        w[key[root], 0], s[key[root], 0] = got["w"][root], got["s"][root]
        inner = got["feature"] >= 0
        key, node = key[inner], node[inner]
        feature[key, node], split[key, node], gain[key, node] = got["feature"][inner], got["split"][inner], got["gain"][inner]
        left, right = 2 * node + 1, 2 * node + 2
        w[key, left], s[key, left] = got["wl"][inner], got["sl"][inner]
        w[key, right], s[key, right] = got["w"][inner] - got["wl"][inner], got["s"][inner] - got["sl"][inner]
        return key, node, left

    if joint:
        counts = _count_cells(rows, n_models, n_trees, edges, settings.seed)
        found = _whole_trees(counts, keys, shape, bins, depth, settings.min_instances_per_node, subset, n_trees, settings.seed).toArrow()
        got = {name: found.column(name).to_numpy() for name in _SPLIT}
        put(got["key"], got["node"].astype(np.int64), got)
    else:
        rows = materialize(rows)
    number = np.full((keys, size), -1, np.int32)
    number[[m * n_trees + t for m in range(n_models) if scales[m] for t in range(n_trees)], 0] = 0
    sc = df.sparkSession.sparkContext
    for level in range(0 if joint else depth):
        open_ = number.max(axis=1) + 1
        if not open_.any():
            break
        state = sc.broadcast((feature, split, number, open_))
        counts = _count_level(rows, state, level, n_models, n_trees, p, bins, settings.seed)
        found = _best_splits(counts, keys, int(open_.max()) * p * bins, p, bins, settings.min_instances_per_node, subset, level, n_trees, settings.seed).toArrow()
        state.destroy()
        got = {name: found.column(name).to_numpy() for name in _SPLIT}
        # the number of an open node back to its place in the tree
        k, place = np.nonzero(number >= 0)
        where = np.full((keys, int(open_.max())), -1, np.int64)
        where[k, number[k, place]] = place
        key, node = got["key"], where[got["key"], got["node"]]
        number[:] = -1
        key, node, left = put(key, node, got)
        order = np.argsort(key * size + node, kind="stable")
        key, left = key[order], left[order]
        first = np.searchsorted(key, key)
        number[key, left] = 2 * (np.arange(len(key)) - first)
        number[key, left + 1] = number[key, left] + 1
    out = []
    upper = np.full((p, bins), np.inf)
    for f, e in enumerate(edges):
        upper[f, :len(e)] = e
    for m in range(n_models):
        own = slice(m * n_trees, (m + 1) * n_trees)
        f = feature[own]
        edge = np.where(f >= 0, upper[np.maximum(f, 0), np.minimum(split[own], bins - 1)], np.inf)
        if scales[m] is None:
            value = np.full(f.shape, np.nan)
        else:
            mid, grain_s, grain_w = scales[m]
            value = np.where(w[own] > 0, mid + s[own] / np.maximum(w[own], 1) * (grain_w / grain_s), np.nan)
        out.append(Trees(f, edge, value, gain[own], p))
    return out


def predictions(spark, models: list[Trees], feats: list[Column], which: Column | None = None) -> Column:
    """A column of predictions: of the only model, or of the model with the number ``which`` (0, 1, ...) of the row."""
    held = spark.sparkContext.broadcast([Lookup(m, m.predict) for m in models])

    @F.arrow_udf(T.DoubleType())
    def predict(number: pa.Array, *columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1).astype(float)
        number = number.to_numpy(zero_copy_only=False)
        out = np.full(len(x), np.nan)
        for m in np.unique(number):
            mine = np.flatnonzero(number == m)
            out[mine] = held.value[int(m)].predict(x[mine])
        return pa.array(out, pa.float64(), from_pandas=True)

    return predict(F.lit(0) if which is None else which.cast("int"), *[c.cast("double") for c in feats])
