"""Propensity score matching, one nearest neighbour on the score, without a cross join.

1. Rows collapse to (score, arm) groups, then to one row a score with the counts and outcome sums of both arms. Ties
   disappear here, so a hot score (a third of the table on one value) is one row.
2. The scores are sorted once (Spark's range partitions) and stored.
3. Within a partition, windows ordered by score carry the nearest (score, n, sum) of each arm from below and above
   (``last`` with ``ignorenulls``; both frames grow from the start of their order).
4. A table of a row for each partition carries each arm's last and first score across the partitions' borders.
5. The nearer side wins; on an exact tie both sides are pooled (mean of all equally near units). The outcomes travel with
   the scores: nothing is joined back, and no number of buckets is set.
ATT matches treated to controls, ATC controls to treated; ATE = (n1 ATT + n0 ATC) / n. Bootstrap replicates are matched
together, with the replicate ahead of the score in every order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.complete import usable_rows
from causeway.operators.propensity import propensity_scores
from causeway.operators.regression import estimate_df
from causeway.session import materialize
from causeway.spec import CausalSpec


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def score_groups(df: DataFrame, spec: CausalSpec, ps: str = "ps", weight_col: str | None = None) -> DataFrame:
    """(score, arm) -> unit count and outcome sum; a weight column (bootstrap counts) scales both."""
    w = _q(weight_col).cast("double") if weight_col else F.lit(1.0)
    return (df.groupBy(F.col(ps).alias("s"), _q(spec.treatment).cast("int").alias("arm"))
              .agg(F.sum(w).alias("n"), F.sum(w * _q(spec.outcome).cast("double")).alias("sy")))


def _placed(groups: DataFrame, by: list[str]) -> DataFrame:
    """One row for each score: ``a0`` and ``a1`` are (s, n, sy) of an arm, null without units; ``part`` numbers the
    range partitions of the order (by, s)."""
    scores = groups.groupBy(*by, "s").agg(
        *[F.sum(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}{a}") for a in (0, 1) for c in ("n", "sy")])
    arm = [F.when(F.col(f"n{a}") > 0, F.struct("s", F.col(f"n{a}").alias("n"), F.col(f"sy{a}").alias("sy"))).alias(f"a{a}")
           for a in (0, 1)]
    return materialize(scores.select(*by, "s", *arm).orderBy(*by, "s").withColumn("part", F.spark_partition_id()))


def matched_sums(groups: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each ``by`` (all groups together without): ``cnt1``, ``num1`` (units of the treated arm, sum of own minus
    matched outcomes), ``cnt0``, ``num0`` (of the controls); a sum is null where the other arm is empty."""
    by = list(by)
    g = _placed(groups, by)
    arms = ("a0", "a1")
    edges = g.groupBy(*by, "part").agg(*[F.max(a).alias(f"last_{a}") for a in arms], *[F.min(a).alias(f"first_{a}") for a in arms])
    over = Window.partitionBy(*by).orderBy("part")  # a row for each partition of the sort (and replicate)
    edges = edges.select(
        *[F.col(k).alias(f"_{k}") for k in [*by, "part"]],
        *[F.last(f"last_{a}", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias(f"before_{a}") for a in arms],
        *[F.first(f"first_{a}", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias(f"after_{a}") for a in arms])
    up, down = (Window.partitionBy("part", *by).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
                for o in (F.asc("s"), F.desc("s")))
    g = g.select("*", *[F.last(a, ignorenulls=True).over(w).alias(f"{side}_{a}") for a in arms for side, w in (("lo", up), ("hi", down))])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*by, "part"]]
    g = g.join(F.broadcast(edges), same)
    out = []
    for own, other in (("a1", "a0"), ("a0", "a1")):
        lo, hi = F.coalesce(f"lo_{other}", f"before_{other}"), F.coalesce(f"hi_{other}", f"after_{other}")
        below, above = F.col("s") - lo["s"], hi["s"] - F.col("s")
        mean = (F.when(hi.isNull() | (below < above) | (lo["s"] == hi["s"]), lo["sy"] / lo["n"])
                 .when(lo.isNull() | (above < below), hi["sy"] / hi["n"])
                 .otherwise((lo["sy"] + hi["sy"]) / (lo["n"] + hi["n"])))
        k = own[1]
        out += [F.sum(F.col(own)["n"]).alias(f"cnt{k}"), F.sum(F.col(own)["sy"] - F.col(own)["n"] * mean).alias(f"num{k}")]
    return g.groupBy(*by).agg(*out)


def matched_effects(groups: DataFrame) -> dict[int, tuple[float, float]]:
    """Both directions in one pass: {1: (ATT, n1), 0: (ATC, n0)}."""
    r = matched_sums(groups).first()
    if r is None or not r["cnt1"] or not r["cnt0"]:
        raise ValueError("no units to match (one arm is empty)")
    return {a: ((1.0 if a == 1 else -1.0) * r[f"num{a}"] / r[f"cnt{a}"], float(r[f"cnt{a}"])) for a in (0, 1)}


def psm_effects(df: DataFrame, spec: CausalSpec, provider: str = "stratified", cells: list[str] | None = None,
                ps: str = "ps", weight_col: str | None = None, missing: str = "raise") -> dict:
    df = usable_rows(df, spec, missing)
    scored = (propensity_scores(df, spec, provider, cells, out=ps, weight_col=weight_col)
              if ps not in df.columns else df)
    both = matched_effects(score_groups(scored, spec, ps, weight_col))
    (att, n1), (atc, n0) = both[1], both[0]
    return dict(att=att, atc=atc, ate=(n1 * att + n0 * atc) / (n1 + n0), n1=n1, n0=n0)


def estimate_psm(df: DataFrame, spec: CausalSpec, provider: str = "stratified", cells: list[str] | None = None,
                 target: str = "ate", missing: str = "raise") -> DataFrame:
    """The ``estimate`` row for ATE (default), ATT or ATC."""
    r = psm_effects(df, spec, provider, cells, missing=missing)
    return estimate_df(df.sparkSession, [("psm", target, int(r["n1"] + r["n0"]), r[target], None, None, None, "none")])
