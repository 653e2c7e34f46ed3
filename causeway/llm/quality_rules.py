"""Quality rules: robust multivariate outliers by the minimum covariance determinant, for each language and source.

Every text gives counts (words, their code points, symbols, repeated lines, words in repeated 3-word windows) inside
its row. Transformed into a vector of p statistics, the texts of one language and source are described by a robust
centre and covariance: from the medians, concentration steps keep the H of texts nearest by Mahalanobis distance and
re-estimate from those, so that junk doesn't shape the estimate it is judged by. Texts beyond the 1 - TAIL quantile of
chi-squared are rejected. FLOORS give the least spread of each statistic that counts as ordinary; they also keep
covariances regular where most texts have exactly 0 of something.

Groups of fewer than LEAST texts join the pool of their language, and pools of fewer the pool of all such texts; below
that no text is an outlier. Groups are aggregates only (moments, percentile sketches), so a group with a third of all
rows is never in one place. DataFrame functions only.

Edge cases: null and empty texts have no words and fail the base rule; null languages and sources are values of their
own; repeated rows each get a row; an empty table gives an empty result; further columns are ignored by ``judge`` and
kept by ``keep_good``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import BLANK, WORD, read, register, same, saved, text_or_empty

H = 0.75
STEPS = 4
TAIL = 1e-8
LEAST = 50
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Least spread of each statistic: log words, log mean word length, roots of symbols, repeated lines and repeated words
#: for each word.
FLOORS = (0.5, 0.06, 0.05, 0.05, 0.15)
P = len(FLOORS)


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. Windows are hashed; only texts with equal hashes sort
    them, each with its position."""
    windows = lambda w: F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def count(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def flagged(s: Column) -> Column:
            equal = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: equal(x, F.get(s, i + 1)) | (F.when(i > 0, equal(x, F.get(s, i - 1))).otherwise(False)))
            return _bind(F.sort_array(F.transform(twice, lambda x: x["at"])), lambda at: F.aggregate(
                F.transform(at, lambda a, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - a, F.lit(3)))),
                F.lit(0).cast("long"), lambda t, x: t + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(_bind(placed, flagged))

    return _bind(words, lambda w: _bind(windows(w), count))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the counts of each text, ``base_failed`` and the group columns as g0, g1."""
    text = text_or_empty(text_col)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        F.col(id_col).alias("doc_id"), *[F.col(c).cast("string").alias(f"g{i}") for i, c in enumerate(group_cols)],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        _bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    return counted.withColumn("base_failed", failed)


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log((F.col("word_chars") + 1) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_dup_lines") / n),
            F.sqrt(F.col("n_repeat_words") / n)]


def chi2_cdf(x: float, k: float) -> float:
    term = total = 1.0 / (k / 2)
    for i in range(1, 2000):
        term *= x / 2 / (k / 2 + i)
        total += term
        if term < total * 1e-16:
            break
    return total * math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2))


def chi2_quantile(q: float, k: int) -> float:
    z = NormalDist().inv_cdf(q)
    low, high = 0.0, 4 * k * (1 + abs(z)) ** 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < q else (low, mid)
    return (low + high) / 2


#: The covariance of the H nearest of a normal sample is too small by this.
CONSISTENCY = H / chi2_cdf(chi2_quantile(H, P), P + 2)
CUTOFF = chi2_quantile(1 - TAIL, P)


def pooled_groups(stats: DataFrame, least: int = LEAST) -> DataFrame:
    """(g0, g1, g): the group that judges each language and source."""
    sizes = stats.where("NOT base_failed").groupBy("g0", "g1").agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("own", F.col("n") >= least)
    pools = sizes.where("NOT own").groupBy("g0").agg(F.sum("n").alias("pool")).withColumnRenamed("g0", "p0")
    sizes = sizes.join(pools, same(F.col("g0"), F.col("p0")), "left")
    name = (F.when(F.col("own"), F.to_json(F.struct(F.lit("own").alias("k"), "g0", "g1")))
            .when(F.col("pool") >= least, F.to_json(F.struct(F.lit("pool").alias("k"), "g0"))).otherwise(F.lit("rest")))
    return sizes.select("g0", "g1", name.alias("g"))


def _x(i: int) -> Column:
    return F.col(f"x{i}")


def _distance(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """Squared Mahalanobis distances by forward substitution in the Cholesky factor of each group."""
    joined = rows.join(fits, "g")
    solved: list[Column] = []
    total = F.lit(0.0)
    for i in range(P):
        y = _x(i) - F.col(f"m{i}")
        for j in range(i):
            y = y - F.col(f"l{i}{j}") * F.col(f"y{j}")
        joined = joined.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
        solved.append(F.col(f"y{i}"))
        total = total + F.col(f"y{i}") * F.col(f"y{i}")
    return joined.select(*rows.columns, total.alias("d2"))


def _cholesky(moments: DataFrame) -> DataFrame:
    """(g, m*, l**) from (g, m*, c**): covariances widened by CONSISTENCY and FLOORS."""
    out = moments
    for i in range(P):
        for j in range(i + 1):
            v = F.coalesce(F.col(f"c{i}{j}"), F.lit(0.0)) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(v) if i == j else v / F.col(f"l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def robust_fits(rows: DataFrame) -> DataFrame:
    """(g, m*, l**): centre and Cholesky factor of each group's concentrated covariance. ``rows``: (g, x*)."""
    medians = saved(rows.groupBy("g").agg(*[F.percentile_approx(_x(i), 0.5, 10_000).alias(f"m{i}") for i in range(P)]))
    spread = rows.join(medians, "g").groupBy("g").agg(
        *[F.percentile_approx(F.abs(_x(i) - F.col(f"m{i}")), 0.5, 10_000).alias(f"s{i}") for i in range(P)])
    first = medians.join(spread, "g")
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i in range(P) for j in range(i)]
    fits = saved(first.select("g", *[f"m{i}" for i in range(P)], *zero,
                              *[F.greatest(F.col(f"s{i}") * 1.4826, F.lit(FLOORS[i])).alias(f"l{i}{i}") for i in range(P)]))
    for _ in range(STEPS):
        near = saved(_distance(rows, fits))
        edge = near.groupBy("g").agg(F.percentile_approx("d2", H, 10_000).alias("edge"))
        half = near.join(edge, "g").where("d2 <= edge")
        moments = half.groupBy("g").agg(*[F.avg(_x(i)).alias(f"m{i}") for i in range(P)],
                                        *[F.covar_pop(_x(i), _x(j)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)])
        fits = saved(_cholesky(moments))
    return fits


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_cols: tuple[str, ...] = ("lang", "source"),
          least: int = LEAST) -> DataFrame:
    """One row for each document: doc_id, its counts, base_failed, distance (squared; null where the base rule fails or
    no group is large enough) and kept."""
    if len(group_cols) != 2:
        raise ValueError("two group columns are asked for, such as language and source")
    stats = saved(statistics(docs, id_col, text_col, group_cols).withColumn("row", F.monotonically_increasing_id()))
    groups = saved(pooled_groups(stats, least).withColumnsRenamed({"g0": "h0", "g1": "h1"}))
    rows = saved(stats.where("NOT base_failed").join(groups, same(F.col("g0"), F.col("h0")) & same(F.col("g1"), F.col("h1")))
                 .select("row", "g", *[c.alias(f"x{i}") for i, c in enumerate(_vector())]))
    # counted once: every step of the estimate reads the rows through it
    large = saved(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("g"))
    rows = rows.join(large, "g", "left_semi")
    far = _distance(rows, robust_fits(rows)).select("row", F.col("d2").alias("distance"))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return stats.join(far, "row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents with all their columns, without those that are rejected; ids are taken to be unique (of rows that
    share an id all stay if one is kept)."""
    good = judge(docs, id_col=id_col, **options).where("kept").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(good, same(docs[id_col], F.col("_keep")), "left_semi")


@register("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return judge(read(spark, sf_dir, "documents"))
