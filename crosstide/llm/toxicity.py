"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

1. Labelled texts outside the held-out fold are counted: for each character
   n-gram, the documents of either label that hold it.
2. The n-grams that tell the labels apart best (likelihood ratio of their
   document counts) are the features. A feature that is present has the value
   of its log-count ratio, r = log((1 + ones) / |1 + ones|) - log((1 + zeros) /
   |1 + zeros|); an absent one is 0.
3. Logistic regression with a quadratic penalty gives the weights. Weight times
   ratio is all that scoring needs, so each text is read once: which features
   stand anywhere in it, and the sum of what they weigh.

The fit takes at most about ``SAMPLE`` labelled rows of either label, drawn by a
hash of the id; sampled labels are weighted back to their share. Everything else
covers all rows and whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, flat, held_out, materialize, pieces, running_sums, signed, small_batches, span_hashes

ORDERS = (2, 3, 4, 5, 6)  # characters of an n-gram
SAMPLE = 20_000  # labelled rows of either label that the fit takes
FEATURES = 8192  # n-grams of the model
LEAST = 5  # labelled documents that hold a feature
PENALTY = 0.0005
PREDICT_FROM = 0.7
_SLOTS = 18  # bits of the table that sorts out most n-grams before the exact look-up
_KEPT = 1 << 20  # counted n-grams that a task keeps before it folds them
_TEXT = 256 << 10  # bytes of text worked on at a time; one longer text is worked on alone
_ONE = 1 << 32  # what a text of label 1 adds to a count; one of label 0 adds 1


def ngrams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: hashes of all its character n-grams and the text of each, in order of texts."""
    first = np.flatnonzero((data & 0xC0) != 0x80)
    bounds = np.append(first, len(data))
    text = np.searchsorted(offsets, first, side="right") - 1
    sums = running_sums(data)
    for n in ORDERS:
        if len(first) < n:
            continue
        whole = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
        yield span_hashes(sums, bounds[whole], bounds[whole + n]), text[whole]


def _fold(kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and their counts from lists of both."""
    grams, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
    kept.clear()
    order = np.argsort(grams)
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(len(grams[:1]), bool), grams[1:] != grams[:-1]]))
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def _count(batches):
    """Rows (label, text) to (gram, ones, zeros): documents that hold the n-gram.

    A task sends what it has counted when it holds many n-grams, so one n-gram may come more than once.
    """
    kept, size = [], 0

    def rows():
        grams, counts = _fold(kept)
        for cut in range(0, len(grams), 50_000):
            part = slice(cut, cut + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(signed(grams[part])), pa.array(counts[part] // _ONE), pa.array(counts[part] % _ONE)], names=["gram", "ones", "zeros"])

    for batch in batches:
        labels = batch.column(0).to_numpy(zero_copy_only=False)
        for at, data, offsets in pieces(*flat(batch.column(1)), _TEXT):
            for hashes, text in ngrams(data, offsets):
                cuts = np.searchsorted(text, np.arange(len(offsets)))
                own = [np.unique(hashes[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                ones = np.repeat(labels[at : at + len(own)] == 1, [len(o) for o in own])
                kept.append((np.concatenate(own), np.where(ones, _ONE, 1)))
                size += len(ones)
            if size > _KEPT:
                kept.append(_fold(kept))
                size = len(kept[0][0])
            if size > _KEPT // 2 and len(kept) == 1:
                yield from rows()
                size = 0
    if kept:
        yield from rows()


class Lookup:
    """Places of features, given as distinct hashes, in texts."""

    def __init__(self, grams: np.ndarray):
        self.order = np.argsort(grams)
        self.grams = grams[self.order]
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[(self.grams >> np.uint64(64 - _SLOTS)).astype(np.int64)] = True

    def present(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) for each feature that stands anywhere in the text, once."""
        n, found = len(self.grams), [np.zeros(0, np.int64)]
        for hashes, text in ngrams(data, offsets):
            near = np.flatnonzero(self.slots[(hashes >> np.uint64(64 - _SLOTS)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.grams, hashes[near]), n - 1)
            hit = self.grams[place] == hashes[near]
            found.append(np.unique(text[near[hit]] * n + self.order[place[hit]]))
        both = np.concatenate(found)
        return both // n, both % n


def _describe(grams: np.ndarray, ratios: np.ndarray):
    """Rows (label, share, text) to (label, share, places, values) of the features present."""

    def run(batches):
        lookup = Lookup(grams)
        for batch in batches:
            for at, data, offsets in pieces(*flat(batch.column(2)), _TEXT):
                text, feature = lookup.present(data, offsets)
                feature = feature[order := np.lexsort((feature, text))].astype(np.int32)
                cuts = np.searchsorted(text[order], np.arange(len(offsets)))
                places = [feature[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                values = [ratios[feature[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(at, len(places)) for k in (0, 1)), pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                    names=["label", "share", "places", "values"],
                )

    return run


def _score(grams: np.ndarray, weights: np.ndarray, bias: float):
    def run(batches):
        lookup = Lookup(grams) if len(grams) else None
        for batch in batches:
            sums = np.full(len(batch), bias)
            for at, data, offsets in pieces(*flat(batch.column(2)), _TEXT) if lookup else ():
                text, feature = lookup.present(data, offsets)
                sums[at : at + len(offsets) - 1] += np.bincount(text, weights[feature], len(offsets) - 1)
            score = 1 / (1 + np.exp(-np.clip(sums, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], names=["doc_id", "held_out", "score"])

    return run


def features(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and log-count ratios of at most FEATURES n-grams, from rows (label, text)."""
    ones, zeros = (labelled.where(F.col("label") == k).count() for k in (1, 0))
    counts = labelled.select("label", "text").mapInArrow(_count, "gram long, ones long, zeros long")
    counts = counts.groupBy("gram").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).where(F.col("ones") + F.col("zeros") >= LEAST)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    held, rows = F.col("ones") + F.col("zeros"), float(ones + zeros)
    strength = sum(
        part(seen, F.greatest(among * n / rows, F.lit(1e-9)))
        for seen, among, n in (
            (F.col("ones"), held, float(ones)),
            (F.col("zeros"), held, float(zeros)),
            (ones - F.col("ones"), rows - held, float(ones)),
            (zeros - F.col("zeros"), rows - held, float(zeros)),
        )
    )
    best = counts.withColumn("strength", F.round(strength, 6)).orderBy(F.desc("strength"), "gram").limit(FEATURES).collect()
    grams = np.array([r.gram for r in best], np.int64).view(np.uint64)
    p, q = np.array([1.0 + r.ones for r in best]), np.array([1.0 + r.zeros for r in best])
    return grams, np.log(p / p.sum()) - np.log(q / q.sum())


def fit(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(n-grams, weights, bias) from rows (label, share, text).

    With labels of one kind only, or none, there are no n-grams and the bias is
    the log odds of the smoothed share of ones.
    """
    seen = {r.label: r.rows for r in labelled.groupBy("label").agg((F.count("*") / F.first("share")).alias("rows")).collect()}
    ones, zeros = seen.get(1, 0.0), seen.get(0, 0.0)
    none = np.zeros(0, np.uint64), np.zeros(0), float(np.log((ones + 1) / (zeros + 1)))
    if not ones or not zeros:
        return none
    grams, ratios = features(labelled)
    if not len(grams):
        return none
    rows = labelled.select("label", "share", "text").mapInArrow(_describe(grams, ratios), "label int, share double, places array<int>, values array<double>")
    size = len(grams)
    vector = F.udf(lambda places, values: SparseVector(size, places, values), VectorUDT())
    rows = rows.select(F.col("label").cast("double").alias("label"), (1 / F.col("share")).alias("weight"), vector("places", "values").alias("features"))
    model = LogisticRegression(regParam=PENALTY, maxIter=40, standardization=False, weightCol="weight", maxBlockSizeInMB=8).fit(rows)
    return grams, model.coefficients.toArray() * ratios, float(model.intercept)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted.

    Labels are used only for documents outside the held-out fold (crc32 of the
    id as text, remainder 1 when divided by 3); null labels and ids teach
    nothing, a repeated label row counts each time. Null and empty texts hold no
    n-gram and get the score of the bias. A table without usable labels gives
    one score to all, an empty one no rows. Other columns are not read.
    """
    small_batches(docs.sparkSession, size=1 << 20)
    folded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", 3, 1).alias("held_out"), F.lower("text").alias("text"))
    taught = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out("label_id", 3, 1))
    taught = materialize(taught.where("label_id is not null"), "taught")
    rows = {r.label: r["count"] for r in taught.groupBy("label").count().collect()}
    share = F.when(F.col("label") == 1, min(1.0, sample / max(1, rows.get(1, 0)))).otherwise(min(1.0, sample / max(1, rows.get(0, 0))))
    taught = taught.withColumn("share", share).where(F.pmod(F.xxhash64("label_id", F.lit(13)), F.lit(1 << 30)) < F.col("share") * (1 << 30))
    labelled = folded.where("not held_out").join(dealt(taught), F.col("doc_id") == F.col("label_id")).select("label", "share", "text")
    grams, weights, bias = fit(materialize(labelled, "labelled"))
    scored = folded.select("doc_id", "held_out", "text").mapInArrow(_score(grams, weights, bias), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0))
