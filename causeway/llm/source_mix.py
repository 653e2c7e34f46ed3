"""Mixing sources to target weights by entropy balancing.

Documents are weighted by rates ``r`` that stay as near as possible to 1 in relative entropy over tokens while each
source's tokens meet its target. The dual has one multiplier for each source; every Newton iteration is a distributed
aggregate over (source, size) cells, and the solution tilts exponentially: ``r = exp(multiplier)``. Rates are rounded
into whole copies by systematic rounding along the documents of a source from the longest down, so that the rounding error
of a source stays below half of its longest document, whatever the number of documents.

Scale: documents are first counted by (source, size, salt); windows run over those cells, one source's window holds as
many rows as it has distinct sizes, and the documents of a cell are ranked within one of SALTS parts. A source, or a
group of copies, that holds a third of all rows is thereby split.

Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own, after all others; a
source whose texts are all empty has target 0; repeated rows are documents of their own; an empty table gives an empty
result; further columns are ignored by ``mix`` and kept by ``apply_mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import WORD, read, register, same, saved, text_or_empty

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.0
MOST = 3.0
SALTS = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def capped_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes dealt by weight, none above ``most`` times its source.
    With sources ordered by cap over weight the capped ones come first, so one running sum finds the water level. The
    table has one row for each source."""
    ranked = sources.withColumn("i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    t = ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * most).alias("cap"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.select("*", (F.sum("source_size").over(everything) * share).alias("total"),
                 F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
                 (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("w_left"))
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
    # the first source whose cap is above the level sets it: the sums of the rows after it count caps that don't bind
    first = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "cap_before", "level"))).over(everything)
    t = t.withColumn("open_level", F.coalesce(first["level"], F.lit(float("inf"))))
    return t.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(
        F.least("cap", F.col("weight") * F.col("open_level"))).alias("target"))


def solve_dual(cells: DataFrame, targets: DataFrame, tolerance: float = 1e-10, most_iterations: int = 50) -> DataFrame:
    """(source, source_size, target, rate). Newton's iteration on the dual of relative entropy: the gradient of a
    source is the tokens its tilted documents give less its target, the curvature those tokens."""
    state = saved(targets.select(F.col("source").alias("s"), "source_size", "target", F.lit(0.0).alias("multiplier")))
    for _ in range(most_iterations):
        given = (cells.join(state, same(F.col("source"), F.col("s")))
                 .groupBy(F.col("s").alias("g")).agg(F.sum(F.col("size") * F.col("n") * F.exp("multiplier")).alias("given")))
        miss = F.col("given") - F.col("target")
        move = F.when(F.col("given") > 0, -miss / F.col("given")).otherwise(0.0)
        # a step beyond 1 leaves the region where the quadratic model of exp holds
        moved = F.col("multiplier") + F.greatest(F.lit(-1.0), F.least(F.lit(1.0), move))
        off = F.when(F.col("given") > 0, F.abs(miss) / F.greatest("given", "target")).otherwise(0.0)
        step = saved(state.join(given, same(F.col("s"), F.col("g")), "left").select(
            "s", "source_size", "target", moved.alias("multiplier"), off.alias("off")))
        state = step.drop("off")
        worst = step.agg(F.max("off")).first()[0]
        if worst is None or worst < tolerance:
            break
    return state.select(F.col("s").alias("source"), "source_size", "target", F.exp("multiplier").alias("rate"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 8) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken."""
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                            n_words(text_or_empty(text_col)).alias("size"),
                            F.xxhash64(F.col(id_col), F.lit(seed)).alias("draw"))
                .withColumn("salt", F.pmod(F.col("draw"), F.lit(SALTS)).cast("int")))
    cells = saved(sizes.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    by_size = saved(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    per_source = by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    solved = solve_dual(by_size, capped_targets(per_source, weights, share, most))

    ahead = Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
    starts = by_size.select(F.col("source").alias("s0"), F.col("size").alias("z0"),
                            F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    dealt = cells.withColumn("ahead", F.coalesce(F.sum("n").over(within), F.lit(0)))
    dealt = dealt.join(starts, same(F.col("source"), F.col("s0")) & (F.col("size") == F.col("z0")))
    solved = solved.withColumnRenamed("source", "s1")
    dealt = dealt.join(solved, same(F.col("source"), F.col("s1")))
    start = F.col("start") + F.col("ahead")
    whole = lambda at: F.floor(F.col("rate") * at + F.lit(0.5))
    dealt = saved(dealt.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("salt").alias("p"), "n",
                             "source_size", "target", # a rate a hair above a cap never deals a document one copy more than it
                             F.least(whole(start + F.col("n")) - whole(start), F.floor(F.lit(most)) * F.col("n")).alias("copies_of_cell")))
    turn = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("draw", "doc_id"))
    each = sizes.withColumn("turn", turn).join(
        dealt, same(F.col("source"), F.col("s")) & (F.col("size") == F.col("z")) & (F.col("salt") == F.col("p")))
    copies = (F.floor(F.col("copies_of_cell") / F.col("n"))
              + F.when(F.col("turn") <= F.col("copies_of_cell") % F.col("n"), 1).otherwise(0)).cast("long")
    return each.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                       (copies * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of the mix with all their columns: each as often as its copies. Rows that share an id are each
    taken as often as the most taken of them."""
    copies = (mix(docs, id_col=id_col, **options).groupBy(F.col("doc_id").alias("_mix_id"))
              .agg(F.max("copies").alias("_mix_copies")))
    joined = docs.join(copies.where("_mix_copies > 0"), same(docs[id_col], F.col("_mix_id")))
    each = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int"))).alias("_mix_copy")
    return joined.select(*[docs[c] for c in docs.columns], each).drop("_mix_copy")


@register("op8_source_mix")
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: sizes, targets and the words taken from each document."""
    return mix(read(spark, sf_dir, "documents")).drop("source")
