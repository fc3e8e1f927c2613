"""URL filters: rules first, then the likelihood ratio of two character language models.

The urls that a rule allows or blocks teach two Markov models of bytes with
contexts of up to ORDER bytes. A model backs off from each context to the next
shorter one in the share of new continuations seen after it (Witten-Bell), so
its order varies with what is known. A url without a rule is allowed when the
difference of its two log likelihoods for each byte reaches a threshold, which
is set on a part of the ruled urls that did not teach the models: where the
shares of wrong verdicts of both kinds are smallest together.

Counts are exact: a gram, that is a context and the byte after it, is a number of
ORDER + 1 bytes, and the counts, probabilities and log ratios of all grams are
distributed tables that grow with the urls. Only the histogram of the threshold
comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, discard, materialize, small_batches

ORDER = 5
UNIT = 1 << 32  # scores are added up in parts of this
BINS, REACH = 2000, 4.0  # of the calibration histogram

# Rules as (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host and path; both empty for a null url or one without ``://``."""
    url = F.coalesce("url", F.lit(""))
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    pages = pages.withColumn("rest", rest)
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*+", 0), UPPER, LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract("rest", r"^[^/?#]*+([^?#]*+)", 1)).drop("rest")


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = F.when(fits, host + path).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _grams(texts: list[str | None]):
    """(text, ORDER bytes before and the byte itself as a number) of all bytes and ends."""
    padded = [b"\2" * ORDER + (t or "").encode() + b"\3" for t in texts]
    data = np.frombuffer(b"".join(padded), np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in padded], np.int64)
    text = np.repeat(np.arange(len(padded)), sizes)
    at = np.flatnonzero(np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes) >= ORDER)
    gram = np.zeros(len(at), np.int64)
    for order in range(ORDER, -1, -1):
        gram = gram << 8 | data[at - order]
    return text[at], gram


def _counted(batches):
    """Rows (row, side, text) to the grams of each batch and how often they stand in texts of side 0 and 1."""
    for batch in batches:
        side = batch.column(1).fill_null(2).to_numpy()
        text, gram = _grams(batch.column(2).to_pylist())
        key, times = np.unique(gram << 2 | side[text], return_counts=True)
        yield pa.RecordBatch.from_pydict({"gram": key >> 2, "n0": np.where(key & 3 == 0, times, 0), "n1": np.where(key & 3 == 1, times, 0)})


def _places(batches):
    """Rows (row, side, text) to one row (row, gram, times) for each different gram of a text."""
    for batch in batches:
        row = batch.column(0).to_numpy()
        text, gram = _grams(batch.column(2).to_pylist())
        order = np.lexsort((gram, text))
        text, gram = text[order], gram[order]
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])])[: len(text)])
        yield pa.RecordBatch.from_pydict({"row": row[text[first]], "gram": gram[first], "times": np.diff(first, append=len(text))})


def learn(taught: DataFrame) -> DataFrame:
    """log P(accepted) - log P(rejected) of the last byte of each gram in rows (row, side, text), as (gram, gain).

    Side 1 teaches the model of accepted urls, side 0 that of rejected ones, null
    teaches none. A gram of one order has at most 256 grams of the next below it
    in each join, so that no key is heavy.
    """
    counted = taught.mapInArrow(_counted, "gram long, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    levels = [materialize(counted, "grams")]
    for order in range(ORDER - 1, -1, -1):
        shorter = levels[-1].groupBy(F.col("gram").bitwiseAND((1 << 8 * (order + 1)) - 1).alias("gram"))
        levels.append(materialize(shorter.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams"))
    known = None
    for order, level in enumerate(reversed(levels)):
        context = F.shiftright("gram", 8)
        totals = [F.sum(f"n{s}").alias(f"t{s}") for s in (0, 1)]
        kinds = [F.count(F.when(F.col(f"n{s}") > 0, 1)).alias(f"k{s}") for s in (0, 1)]
        contexts = level.groupBy(context.alias("context")).agg(*totals, *kinds)
        found = level.withColumn("context", context).join(dealt(contexts), "context")
        if known is None:
            found = found.select("*", *[F.lit(1 / 257).alias(f"p{s}") for s in (0, 1)])
        else:
            shorter = F.col("gram").bitwiseAND((1 << 8 * order) - 1)
            found = found.withColumn("shorter", shorter).join(dealt(known.withColumnRenamed("gram", "shorter")), "shorter")
        p = [F.when(F.col(f"t{s}") > 0, (F.col(f"n{s}") + F.col(f"k{s}") * F.col(f"p{s}")) / (F.col(f"t{s}") + F.col(f"k{s}"))).otherwise(F.col(f"p{s}")).alias(f"p{s}") for s in (0, 1)]
        before, known = known, materialize(found.select("gram", *p), "probabilities")
        for table in (level, before):
            if table is not None:
                discard(table)
    return known.select("gram", (F.log("p1") - F.log("p0")).alias("gain"))


def scores(urls: DataFrame, gains: DataFrame) -> DataFrame:
    """(row, score): mean gain for each byte and the end of the text of each row.

    Gains are added up as whole multiples of 1 / UNIT, so that equal texts have equal scores.
    """
    places = urls.mapInArrow(_places, "row long, gram long, times long")
    each = places.join(dealt(gains), "gram").select("row", "times", F.round(F.col("gain") * UNIT).cast("long").alias("gain"))
    sums = each.groupBy("row").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"), F.sum("times").alias("n"))
    return sums.select("row", (F.col("gain") / F.col("n") / UNIT).alias("score"))


def threshold(histogram: dict[tuple[int, int], int]) -> float:
    """Where the shares of accepted below and of rejected above are smallest together; the middle of the best places."""
    accepted, rejected = (np.array([histogram.get((side, b), 0) for b in range(BINS)], float) for side in (1, 0))
    if not accepted.sum() or not rejected.sum():
        return 0.0
    below = np.concatenate([[0], np.cumsum(accepted)]) / accepted.sum()
    above = 1 - np.concatenate([[0], np.cumsum(rejected)]) / rejected.sum()
    best = np.flatnonzero(below + above <= (below + above).min() + 1e-12)
    return float((best[0] + best[-1]) / 2 * 2 * REACH / BINS - REACH)


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, score.

    ``score`` is the length-normalised log likelihood ratio, also where a rule
    decides. Null urls and urls without ``://`` have an empty host and path, fit
    no rule and are judged as empty texts. Without accepted or without rejected
    urls the threshold is 0. Rows that repeat an id and rows without one are
    kept as they are. Other columns are not read.
    """
    small_batches(pages.sparkSession, 5000)
    rule, verdict = rule_columns(rules)
    parts = with_parts(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    parts = parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.concat("host", "path").alias("text"))
    parts = materialize(parts.withColumn("row", F.monotonically_increasing_id()), "urls")
    apart = F.crc32(F.col("text").cast("binary")) % 4 == 0
    side = F.when(F.col("ruled") == "allow", 1).when(F.col("ruled").isNotNull(), 0).cast("long")
    gains = learn(parts.select("row", F.when(~apart, side).alias("side"), "text"))
    found = scores(parts.select("row", side.alias("side"), "text"), gains)
    judged = materialize(parts.join(dealt(found), "row"), "scored")
    discard(gains)
    discard(parts)
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + REACH) * BINS / (2 * REACH)))).cast("int")
    tried = judged.where(apart & F.col("ruled").isNotNull()).groupBy(side.alias("side"), place.alias("bin")).count()
    cut = threshold({(side, b): n for side, b, n in tried.collect()})
    own = F.when(F.col("score") >= cut, "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "score")
