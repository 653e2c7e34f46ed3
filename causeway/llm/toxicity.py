"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts and full-width forms to a-z, digits and signs
that stand for letters to those letters, invisible characters dropped. The lexicon is learned from labelled documents:
beginnings of words (STEMS letters) and whole words that occur in far more toxic documents than chance allows, weighted
by their log odds. One pass of the automaton finds all terms of a text; hits inside an exception phrase don't count.
The weights are summed, once as such and once for each hundred words, and a logistic curve over both, fitted on the
same labelled documents, gives the score.

The model is fitted on at most about SAMPLE labelled documents (drawn by a hash of their id), whole texts, counted in
Spark; what reaches the driver and goes back to the tasks is the lexicon: terms in at least 1 of every 500 toxic
documents, so its size doesn't grow with the input.

Edge cases: null and empty texts have no hits and get the score of a text without hits; without any toxic label, or
any other, every score is the share of toxic labels (0 without labels); null labels are not used; a document with
several labels counts with each; repeated rows are scored each; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import read, register, saved, text_or_empty

SAMPLE = 20_000
STEMS = (4, 5, 6)
LONGEST_TERM = 24
LEAST_Z = 8.0
LEAST_WEIGHT = 1.5
LEAST_SHARE = 0.002

# Letters of other scripts that look like a-z, and signs used for letters.
LOOK_ALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j",
               "к": "k", "м": "m", "н": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v",
               "ԝ": "w", "х": "x", "у": "y", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
               "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g"}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
# Phrases in which a term of abuse is none.
EXCEPTIONS = ("class clown", "clown fish", "clown nose", "loser's bracket", "recycling and trash", "stupid question",
              "trash bin", "trash can", "trash collection")

_FOLD = {ord(k): v for k, v in {**LOOK_ALIKES, **SIGNS}.items()} | {ord(c): None for c in INVISIBLE}
_FOLD |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in "@$'"}


def fold(text: str) -> str:
    """Folded text: words apart by single or more blanks, one before the first."""
    return " " + text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]  # term -> weight; a term begins with a blank, a whole word also ends with one
    curve: tuple[float, float, float]  # intercept, of the sum, of the sum for each hundred words
    exceptions: tuple[str, ...] = EXCEPTIONS


class Matcher:
    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...]):
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for term, w in weights.items():
            self.automaton.add_word(term, (len(term), w))
        for phrase in {fold(p) for p in exceptions}:
            self.automaton.add_word(phrase, (len(phrase), None))
        self.automaton.make_automaton()
        self.any = bool(len(self.automaton))

    def features(self, text: str) -> tuple[float, float]:
        folded = fold(text) + " "
        hits, covers = [], []
        if self.any:
            for end, (n, w) in self.automaton.iter(folded):
                (covers if w is None else hits).append((end - n + 1, end, w))
        total, free, best = 0.0, -1, 0.0
        for start, end, w in sorted(hits, key=lambda h: (h[0], -h[2])):
            if any(a <= start < b for a, b, _ in covers):
                continue
            if start > free:  # of the terms that begin a word the weightiest counts
                total += w
                free = start
        words = max(1, len(folded.split()))
        best = math.log1p(total)
        return best, math.log1p(100.0 * total / words)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [Counter(), Counter()]

    def out() -> Iterator[pa.RecordBatch]:
        for label in (0, 1):
            if held[label]:
                yield pa.RecordBatch.from_arrays([pa.array([*held[label]]), pa.array([label] * len(held[label]), pa.int32()),
                                                  pa.array([*held[label].values()], pa.int64())], names=["term", "toxic", "n"])
            held[label].clear()

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = set()
            for w in set(fold(text).split()):
                found.update(" " + w[:k] for k in STEMS if len(w) >= k)
                if len(w) <= LONGEST_TERM:
                    found.add(f" {w} ")
            held[toxic].update(found)
        if len(held[0]) + len(held[1]) > 500_000:
            yield from out()
    yield from out()


def _features(weights: dict[str, float], exceptions: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(weights, exceptions)
        for b in batches:
            rows = [matcher.features(t) for t in b.column(b.num_columns - 1).to_pylist()]
            x = np.array(rows, float).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(x[:, 0]), pa.array(x[:, 1])],
                                             names=[*b.schema.names[:-1], "x1", "x2"])
    return run


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms and weights from (text, toxic)."""
    n = {r["toxic"]: r["n"] for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        return {}
    counts = (labelled.select("text", "toxic").mapInArrow(_terms, "term string, toxic int, n long").groupBy("term")
              .agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("c1"), F.sum("n").alias("c")))
    by_chance = F.col("c") * (n1 / (n0 + n1))
    weight = F.log((F.col("c1") + 0.5) / (n1 + 1.0)) - F.log((F.col("c") - F.col("c1") + 0.5) / (n0 + 1.0))
    rows = (counts.withColumn("w", weight).where((F.col("c1") - by_chance) / F.sqrt(by_chance) >= LEAST_Z)
            .where((F.col("w") >= LEAST_WEIGHT) & (F.col("c1") >= max(1, math.ceil(LEAST_SHARE * n1))))
            .select("term", "w").orderBy("term").collect())
    found: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r["term"]), r["term"])):  # a longer term only if it says more
        known = [found[r["term"][:k]] for k in range(2, len(r["term"])) if r["term"][:k] in found]
        if not known or r["w"] > max(known) + 0.5:
            found[r["term"]] = r["w"]
    return found


def fit(labelled: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Model from (text, toxic): the lexicon, and a logistic curve by Newton's steps; each step is one aggregate."""
    weights = learn_lexicon(labelled)
    x = saved(labelled.select(F.col("toxic").cast("double").alias("y"), "text").mapInArrow(
        _features(weights, exceptions), "y double, x1 double, x2 double"))
    total, toxic = x.agg(F.count("*"), F.sum("y")).first()
    share = (toxic or 0.0) / total if total else 0.0
    if not weights:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model({}, (math.log(p / (1 - p)), 0.0, 0.0), exceptions)
    beta, cols = np.array([math.log(share / (1 - share)), 0.0, 0.0]), [F.lit(1.0), F.col("x1"), F.col("x2")]
    for _ in range(12):
        z = sum((F.lit(float(b)) * c for b, c in zip(beta, cols, strict=True)), F.lit(0.0))
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
        sums = x.agg(*[F.sum((F.col("y") - p) * c) for c in cols],
                     *[F.sum(p * (1 - p) * a * b) for a in cols for b in cols]).first()
        gradient = np.array(sums[:3]) - 1e-2 * beta  # a light ridge keeps separable labels finite
        step = np.linalg.solve(np.array(sums[3:]).reshape(3, 3) + 1e-2 * np.eye(3), gradient)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return Model(weights, tuple(map(float, beta)), exceptions)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    x = rows.mapInArrow(_features(model.weights, model.exceptions), f"doc_id {kind}, x1 double, x2 double")
    a, b, c = model.curve
    z = F.lit(a) + F.lit(b) * F.col("x1") + F.lit(c) * F.col("x2")
    return x.select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about ``sample`` labelled documents that aren't held out."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    n = usable.count()
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(1, n)))
    chosen = usable.where(drawn).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    return saved(docs.select("doc_id", text_or_empty().alias("text")).join(chosen, "doc_id").select("text", "toxic"))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model learned from the labels that aren't held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(training_rows(docs, read(spark, sf_dir, "labels")))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")
