"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source gets a target number of words. A document is taken ``floor(f)``
times for certain, where f = target / size of its source, and the rest of the
target is filled by one more copy of some documents: documents are ranked by
their random odds u / (1 - u) over the odds of their inclusion probability
p / (1 - p), and the first ones that fill the rest are chosen. A source's words
thus miss its target by half a document at most.

Longer documents are included more often. With q = f - floor(f), a document of
size s in a source of mean size m has the place h = s / (s + m), counted in
LEVELS, and p = q * (1 + (1 - q) * (h - mean h) / 2), where the mean weighs by
size. So the probabilities lie strictly between q / 2 and 1 and the words that
they expect sum to the rest of the target.

The rank is never formed over a whole source. Odds differ from those of equal
probabilities by a factor of two at most, so documents are dealt by them into
cells of a few hundred; words are summed by cell, then by groups of cells, and
only inside a cell are documents counted up one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import materialize

WORD = r"[^\x20\x09-\x0D]+"
CELL = 256  # documents of an average cell
GROUP = 4096  # cells of a group
LEVELS = 10_000  # steps in which the place of a size is counted, so that its sums are exact
_BITS = 52


def uniform(id_column: str, text_column: str) -> Column:
    """A number strictly between 0 and 1 that depends on the id and the text only."""
    text = F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("")), text).cast("binary"))
    return (F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def source_targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows (source, size); one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``percent`` of all words; no target exceeds ``most`` times its source, and
    what that cuts off is shared by weight among the others. Sources are taken
    up in order of the common rate (target by weight) at which they are full.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filling = Window.orderBy("full_at", "turn")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onwards = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = sources.withColumn("turn", F.row_number().over(turn))
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("turn") - 1, F.lit(len(weights))).cast("int") + 1))
    sources = sources.withColumn("cap", F.col("source_size") * float(most))
    sources = sources.withColumn("full_at", F.col("cap") / F.col("weight"))
    sources = sources.withColumn(
        "rate",
        (F.sum("source_size").over(everything) * float(percent) / 100 - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onwards),
    )
    sources = sources.withColumn("full", F.col("rate") >= F.col("full_at"))
    last = F.min_by(F.when(~F.col("full"), F.col("rate")), F.when(~F.col("full"), F.struct("full_at", "turn"))).over(everything)
    return sources.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(last * F.col("weight")).alias("target"))


def inclusion(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows (.., source, size) with certain, rest, q and the inclusion probability ``p`` of one more copy (0 where no source needs one).

    What is known of a source is stored, one row each, so that each pass over
    the documents is a plan of its own and none holds the ones before.
    """
    means = sized.groupBy("source").agg(F.floor(F.sum("size") / F.count(F.lit(1))).alias("mean_size"))
    targets = targets.withColumnRenamed("source", "target_source")
    by_source = means.join(materialize(targets, "targets"), F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    by_source = materialize(by_source, "sources")
    place = F.floor(F.lit(float(LEVELS)) * F.col("size") / (F.col("size") + F.col("mean_size")))

    def with_source(rows, sources):
        return rows.join(sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")

    def placed(sources):
        return with_source(sized, sources).withColumn("place", F.when(F.col("size") > 0, place).otherwise(F.lit(0)))

    mean_place = placed(by_source).groupBy("source").agg(F.try_divide(F.sum(F.col("size") * F.col("place")), F.sum("size")).alias("mean_place"))
    known = materialize(with_source(by_source, mean_place), "sources")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = placed(known).withColumn("share", share).withColumn("certain", F.floor("share"))
    out = out.withColumn("rest", F.col("target") - F.col("certain") * F.col("source_size")).withColumn("q", F.col("share") - F.col("certain"))
    lean = (F.col("place") - F.col("mean_place")) / float(2 * LEVELS)
    return out.withColumn("p", F.when(F.col("q") > 0, F.col("q") * (1 + (1 - F.col("q")) * lean)).otherwise(0.0)).drop("share", "place", "mean_place", "mean_size")


def words_before(by_cell: DataFrame) -> DataFrame:
    """(source, cell, before): words of all earlier cells of a source, from rows (source, cell, words)."""
    group = F.floor(F.col("cell") / GROUP)
    earlier = Window.partitionBy("source").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = by_cell.groupBy("source", group.alias("group")).agg(F.sum("words").alias("words"))
    groups = groups.select(F.col("source").alias("group_source"), F.col("group").alias("group_no"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before_group"))
    inside = Window.partitionBy("source", "group").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = by_cell.withColumn("group", group).withColumn("before_cell", F.coalesce(F.sum("words").over(inside), F.lit(0)))
    cells = cells.join(groups, F.col("source").eqNullSafe(F.col("group_source")) & (F.col("group") == F.col("group_no")))
    return cells.select("source", "cell", (F.col("before_group") + F.col("before_cell")).alias("before"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, size, source_size, target, p, copies, taken.

    ``size`` counts the words of the whole text (null: 0); ``p`` is the
    probability of one copy beyond the certain ones; ``taken`` is copies *
    size. A null source is a source, empty texts take nothing, and rows that
    repeat an id and a text share one random number, so they are alike and lie
    side by side in the rank. An empty table gives no rows. Other columns are
    not read.
    """
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), uniform("doc_id", "text").alias("u"))
    sized = materialize(sized, "sizes")
    cells = max(16, sized.count() // CELL)
    ranked = inclusion(sized, source_targets(sized, weights, percent, most))
    own, even = (F.col(c) / (1 - F.col(c)) for c in ("p", "q"))
    ranked = ranked.withColumn("odds", F.when(F.col("q") > 0, F.col("u") / (1 - F.col("u")) / own))
    spread = F.when(F.col("q") > 0, F.col("odds") * even / (1 + F.col("odds") * even)).otherwise(F.col("u"))
    ranked = ranked.withColumn("cell", F.least(F.floor(spread * cells), F.lit(cells - 1)))
    by_cell = materialize(ranked.groupBy("source", "cell").agg(F.sum("size").alias("words")), "cells")
    before = materialize(words_before(by_cell).withColumnsRenamed({"source": "cell_source", "cell": "cell_no"}), "before")
    ranked = ranked.join(before, F.col("source").eqNullSafe(F.col("cell_source")) & (F.col("cell") == F.col("cell_no")))
    inside = Window.partitionBy("source", "cell").orderBy("odds", "u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    copies = F.col("certain") + F.when((F.col("q") > 0) & (upto <= F.col("rest")), 1).otherwise(0)
    ranked = ranked.withColumn("copies", copies.cast("long"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", "p", "copies", (F.col("copies") * F.col("size")).alias("taken"))
