"""Quality classifier: a sparse rule ensemble over text statistics.

Shallow trees are grown on labelled documents, every path of a tree becomes a
rule (a conjunction of bounds on statistics), lasso logistic regression gives
most rules the weight zero, and the others are compiled into one Spark column
expression. All labelled rows outside the held-out fold are used, as Spark jobs
over statistics; no text leaves the executors.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import flat, held_out, materialize, mix, pieces, small_batches, words

STATISTICS = (
    "n_words",
    "word_length",
    "long_words",
    "upper",
    "digits",
    "marks",
    "bars",
    "shouts",
    "odd_marks",
    "points",
    "lines",
    "distinct_words",
    "repeated_words",
    "commonest_word",
    "distinct_triples",
)
TREES, DEPTH, PENALTY = 12, 3, 0.001
PREDICT_FROM = 0.7


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _table("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _table("0123456789")
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK &= ~_LETTER & ~_DIGIT


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """One row of STATISTICS for each text; all zero for a null or empty text."""
    parts = [np.zeros((0, len(STATISTICS)))]
    for _, data, offsets in pieces(*flat(column)):
        n = len(offsets) - 1

        def count(mask, offsets=offsets):
            total = np.concatenate([[0], np.cumsum(mask)])
            return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

        hashes, text, starts = words(data, offsets, lower=False)
        n_words = np.bincount(text, minlength=n).astype(float)
        n_bytes = (offsets[1:] - offsets[:-1]).astype(float)
        filled = count(data > 32)
        letters = count(_LETTER[data])
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        long_words = np.bincount(text[ends - starts > 13], minlength=n)

        def distinct(keys, owner, n=n):
            _, first, times = np.unique(mix(keys ^ mix(owner.astype(np.uint64))), return_index=True, return_counts=True)
            most = np.zeros(n)
            np.maximum.at(most, owner[first], times)
            return np.bincount(owner[first], minlength=n), most

        kinds, most = distinct(hashes, text) if len(hashes) else (np.zeros(n), np.zeros(n))
        again = np.bincount(text[1:][(hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])], minlength=n) if len(hashes) else np.zeros(n)
        triples, n_triples = np.zeros(n), np.zeros(n)
        if len(hashes) > 2:
            whole = text[2:] == text[:-2]
            keys = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1] * np.uint64(5) + mix(hashes[2:])))[whole]
            owner = text[2:][whole]
            n_triples = np.bincount(owner, minlength=n)
            triples, _ = distinct(keys, owner) if len(keys) else (triples, None)
        parts.append(
            np.stack(
                [
                    n_words,
                    _ratio(filled, n_words),
                    _ratio(long_words, n_words),
                    _ratio(count(_UPPER[data]), letters),
                    _ratio(count(_DIGIT[data]), filled),
                    _ratio(count(_MARK[data]), filled),
                    _ratio(count(data == ord("|")), n_words),
                    _ratio(count(data == ord("!")), n_words),
                    _ratio(count(_table("#$%&*")[data]), n_words),
                    _ratio(count(_table(".,")[data]), n_words),
                    _ratio(count(data == 10), n_words),
                    _ratio(kinds, n_words),
                    _ratio(again, n_words),
                    _ratio(most, n_words),
                    _ratio(triples, n_triples),
                ],
                1,
            )
            * (n_bytes > 0)[:, None]
        )
    return np.concatenate(parts)


def _describe(batches):
    for batch in batches:
        values = statistics(batch.column(1))
        rows = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), rows], names=["doc_id", "stats"])


def paths(tree: str) -> set[tuple]:
    """Rules of a tree from its printed form: tuples of (feature, '<=' or '>', bound)."""
    found, stack = set(), []
    for line in tree.splitlines():
        if m := re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), (int(m[2]), m[3], float(m[4]))))
            found.add(tuple(sorted({x for _, x in stack})))
    return found


def rule_column(rule: tuple, stats: str = "stats") -> Column:
    """A rule as a condition on the array of statistics."""
    bounds = [(F.col(stats)[i] <= x) if sign == "<=" else (F.col(stats)[i] > x) for i, sign, x in rule]
    return reduce(lambda a, b: a & b, bounds)


def fit(labelled: DataFrame, label: str) -> tuple[float, list[tuple[float, tuple]]]:
    """Bias and the (weight, rule) pairs whose weight is not zero.

    With labels of one kind only, or none, there are no rules and the bias is
    the log odds of the smoothed share of ones.
    """
    n, ones = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))).first()
    if ones in (0, n):
        return float(np.log((ones + 1) / (n - ones + 1))), []
    rows = labelled.select(array_to_vector("stats").alias("features"), F.col(label).cast("double").alias("label"))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=17, maxMemoryInMB=64)
    trees = forest.fit(rows).trees
    rules = sorted(set().union(*(paths(t.toDebugString) for t in trees)))
    if not rules:
        return float(np.log((ones + 1) / (n - ones + 1))), []
    fired = labelled.select(
        array_to_vector(F.array(*[F.when(rule_column(r), 1.0).otherwise(0.0) for r in rules])).alias("features"), F.col(label).cast("double").alias("label")
    )
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, maxIter=40, maxBlockSizeInMB=8).fit(fired)
    weights = lasso.coefficients.toArray()
    return float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-9]


def compiled(bias: float, rules: list[tuple[float, tuple]]) -> Column:
    """The ensemble as one column: the probability of label 1."""
    terms = [F.when(rule_column(r), w).otherwise(0.0) for w, r in rules]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, terms, F.lit(bias))))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Labels are used only for documents outside the held-out fold; null labels
    and ids teach nothing, a repeated label row counts each time. Null and empty
    texts have statistics of zero and are scored like any other. A table without
    usable labels gives one score to all. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    stats = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_describe, "doc_id long, stats array<double>")
    stats = materialize(stats.withColumn("held_out", held_out()), "statistics")
    taught = labels.select(F.col("doc_id").alias("label_id"), F.col(label).alias("label")).where(F.col("label").isin(0, 1))
    labelled = stats.where("not held_out").join(taught, F.col("doc_id") == F.col("label_id")).select("stats", "label")
    labelled = materialize(labelled, "labelled")
    score = compiled(*fit(labelled, "label"))
    scored = stats.select("doc_id", "held_out", score.alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0))
