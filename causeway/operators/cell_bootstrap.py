"""U1 for the estimators that work on confounder cells: IPTW and matching on stratified scores, cell-mean learners.

These need no more of a replicate than the units and outcomes of each (cell, arm). One pass over the rows gives these
sums for every replicate: a task multiplies each slice's matrix of Poisson counts into its cells, and the sums of
(cell, replicate) are added by one grouped aggregate. Estimates of all replicates follow from that table together;
nothing is fitted in a loop. Draws and results are those of a refit on the reweighted rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashing import SALT_BOOTSTRAP
from causeway.operators.matching import matched_sums
from causeway.operators.replicates import CELLS, Drawn, key_columns
from causeway.session import materialize, spread
from causeway.spec import CausalSpec

SUMS = ("n0", "y0", "n1", "y1")


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def replicate_cells(df: DataFrame, spec: CausalSpec, cells: list[str], B: int, rng: str = "md5") -> DataFrame:
    """(cell, rep, n0, y0, n1, y1): units and outcome sums of both arms of each cell with a unit in the replicate. Null
    is a cell of its own. Rows need a treatment of 0 or 1 and an outcome (``usable_rows``)."""
    keys = key_columns(spec.id_col, rng, (SALT_BOOTSTRAP,))
    rows = spread(df).select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)], F.to_json(F.struct(*[_q(c) for c in cells])).alias("cell"),
                             _q(spec.treatment).cast("int").alias("arm"), _q(spec.outcome).cast("double").alias("y"))
    step = max(1, CELLS // max(B, 1))

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                found = b.column(1).dictionary_encode()
                code = 2 * found.indices.to_numpy().astype(np.int64) + b.column(2).to_numpy()
                y, w = b.column(3).to_numpy(), Drawn([b.column(0)], B, rng, (SALT_BOOTSTRAP,)).poisson(SALT_BOOTSTRAP)
                order = np.argsort(code, kind="stable")
                present, first = np.unique(code[order], return_index=True)
                w = w[order].astype(float)
                n, sy = np.add.reduceat(w, first), np.add.reduceat(w * y[order, None], first)
                sums = np.zeros((len(found.dictionary), 4, B))
                for arm in (0, 1):
                    of = present % 2 == arm
                    sums[present[of] // 2, 2 * arm], sums[present[of] // 2, 2 * arm + 1] = n[of], sy[of]
                cell, rep = np.nonzero(sums[:, 0] + sums[:, 2])
                yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(cell)), pa.array(rep.astype(np.int32)),
                                                  *[pa.array(sums[cell, k, rep]) for k in range(4)]], names=["cell", "rep", *SUMS])

    part = rows.mapInArrow(run, "cell string, rep int, " + ", ".join(f"{c} double" for c in SUMS))
    return part.groupBy("cell", "rep").agg(*[F.sum(c).alias(c) for c in SUMS])


def _all(found: DataFrame, B: int) -> DataFrame:
    """(rep, estimate) with null for replicates without an estimate."""
    reps = found.sparkSession.range(B).select(F.col("id").cast("int").alias("rep"))
    ok = F.when(~F.isnan("estimate"), F.col("estimate"))
    return reps.join(found.select(F.col("rep").alias("_rep"), ok.alias("estimate")), F.col("rep") == F.col("_rep"), "left").drop("_rep")


def bootstrap_iptw(df: DataFrame, spec: CausalSpec, cells: list[str], B: int, weighting: str = "ht", clip=None,
                   rng: str = "md5") -> DataFrame:
    """U1 for E11 on stratified scores. A replicate in which a cell lacks an arm has no estimate, unless ``clip``
    keeps its score off 0 and 1."""
    if weighting not in ("ht", "hajek"):
        raise ValueError("weighting must be 'ht' or 'hajek'")
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    e = F.least(F.greatest(share, F.lit(clip[0])), F.lit(clip[1])) if clip else share
    c = replicate_cells(df, spec, cells, B, rng).withColumn("e", e)
    inside = (F.col("e") > 0) & (F.col("e") < 1)
    total = lambda arm, of: F.sum(F.when(inside, F.col(of) / (F.col("e") if arm else 1 - F.col("e"))))
    s = c.groupBy("rep").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"), F.max(~inside).alias("bad"),
                             *[total(a, f"{k}{a}").alias(f"{k}{a}") for a in (0, 1) for k in "ny"])
    value = ((F.col("y1") - F.col("y0")) / F.col("n") if weighting == "ht"
             else F.col("y1") / F.col("n1") - F.col("y0") / F.col("n0"))
    return _all(s.select("rep", F.when(~F.col("bad"), value).alias("estimate")), B)


def bootstrap_psm(df: DataFrame, spec: CausalSpec, cells: list[str], B: int, target: str = "ate", rng: str = "md5") -> DataFrame:
    """U1 for E10 on stratified scores: all replicates are matched together. A replicate without one arm has no estimate."""
    c = materialize(replicate_cells(df, spec, cells, B, rng).withColumn("s", F.col("n1") / (F.col("n0") + F.col("n1"))))
    groups = [c.select("rep", "s", F.lit(a).alias("arm"), F.col(f"n{a}").alias("n"), F.col(f"y{a}").alias("sy")) for a in (0, 1)]
    m = matched_sums(groups[0].unionByName(groups[1]).where("n > 0"), ("rep",))
    value = {"ate": (F.col("num1") - F.col("num0")) / (F.col("cnt1") + F.col("cnt0")), "att": F.col("num1") / F.col("cnt1"),
             "atc": -F.col("num0") / F.col("cnt0")}[target]
    return _all(m.select("rep", F.when((F.col("cnt1") > 0) & (F.col("cnt0") > 0), value).alias("estimate")), B)


def bootstrap_cell_mean(df: DataFrame, spec: CausalSpec, cells: list[str], B: int, rng: str = "md5") -> DataFrame:
    """U1 for E12 and E13 with cell means: a cell without an arm takes that arm's mean over all cells."""
    c = materialize(replicate_cells(df, spec, cells, B, rng))
    g = c.groupBy("rep").agg(*[(F.sum(f"y{a}") / F.sum(f"n{a}")).alias(f"g{a}") for a in (0, 1)])  # a row for each replicate
    mean = lambda a: F.coalesce(F.when(F.col(f"n{a}") > 0, F.col(f"y{a}") / F.col(f"n{a}")), F.col(f"g{a}"))
    n = F.col("n0") + F.col("n1")
    return _all(c.join(F.broadcast(g), "rep").groupBy("rep").agg((F.sum(n * (mean(1) - mean(0))) / F.sum(n)).alias("estimate")), B)
