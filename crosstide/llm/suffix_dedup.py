"""Suffix deduplication: strings of SPAN bytes that occur again anywhere, by a difference cover.

The classic algorithm sorts the suffixes at a difference cover of all positions
by triples of characters, recurses on the names of the triples, places the
remaining suffixes by the bytes up to the next sampled one, and compares
neighbours. Here only the first SPAN bytes of a suffix matter, and only whether
two are equal, which makes each step local or a grouping on names:

1. *Names.* The name of 3 bytes is a 64-bit fingerprint, that of 9 bytes the
   fingerprint of three names, and so on to 81; a longer stretch is named by
   overlapping ones. A fingerprint serves as the rank of its string, so the
   recursion needs no exchange of ranks and runs inside a row.
2. *Sampled suffixes.* Every string of SPAN bytes has one sampled position: of
   its first COVER positions the one with the smallest scrambled name. It depends
   on nothing but the string, so equal strings are sampled at equal offsets, as
   with a difference cover. Strings that begin one after the other share their
   sample; a text has one for about COVER / 2 bytes, and only these are
   shuffled: (sample name, name of all bytes of its strings, place).
3. *Neighbours among the samples.* A sample whose name occurs once ends here:
   none of its strings occurs again. Samples with equal full names have all
   their strings in common.
4. *Remaining suffixes.* Where samples share their name but not the full name,
   the strings at all positions before them are named one by one, for one
   representative of each full name, and equal names are found.
5. The byte ranges found are removed from their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstide.llm.common import _TABLE, dealt, discard, flat, let_go, materialize, mix, pieces, small_batches

SPAN = 400  # bytes of a repeated string
COVER = 256  # positions that share a sample at most; a power of two
SLICE = 4 << 20  # longer texts are worked on in overlapping slices
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _join(*names: np.ndarray) -> np.ndarray:
    h = names[0] * _A + names[1] * _B
    if len(names) > 2:
        h += names[2] * _C
    h ^= h >> np.uint64(31)
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def _longer(names: np.ndarray, covered: int, wanted: int) -> np.ndarray:
    """Names of ``wanted`` bytes, at most twice ``covered``, from names of ``covered`` bytes."""
    step = wanted - covered
    return _join(names[:-step], names[step:])


class Names:
    """Names of stretches of a byte array, by their first byte."""

    def __init__(self, data: np.ndarray, span: int):
        triple = _TABLE[data]
        at = {}
        for size in (1, 3, 9, 27):
            triple = _join(triple[: -2 * size], triple[size:-size], triple[2 * size :])
            at[size * 3] = triple
        self.short = at[9]
        key = span - COVER  # bytes after a sample that belong to all its strings
        self.sample = _longer(at[81], 81, key)
        self.full = self.sample
        size = key
        while size < span:
            wanted = min(2 * size, span)
            self.full, size = _longer(self.full, size, wanted), wanted


def samples(names: Names, valid: np.ndarray):
    """(first string, last string, sample) for each run of valid positions with one sample."""
    count = len(names.full)
    order = (mix(names.short) & ~np.uint64((1 << 24) - 1)) | np.arange(len(names.short), dtype=np.uint64)
    width = 1
    while width < COVER:
        order = np.minimum(order[:-width], order[width:])
        width *= 2
    place = (order[:count] & np.uint64((1 << 24) - 1)).astype(np.int64)
    at = np.flatnonzero(valid[:count])
    if len(at) == 0:
        return at, at, at
    new = np.flatnonzero((np.diff(place[at], prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    first, last = at[new], at[np.append(new[1:], len(at)) - 1]
    return first, last, place[first]


def _slices(column: pa.Array, span: int):
    """(text, offset in it, bytes, positions at which a string of ``span`` bytes can begin)."""
    for base, data, offsets in pieces(*flat(column)):
        if len(offsets) == 2 and len(data) > SLICE:
            for begin in range(0, len(data) - span + 1, SLICE):
                part = data[begin : begin + SLICE + span - 1]
                yield np.full(len(part), base), np.full(len(part), begin), part, np.ones(len(part), bool)
            continue
        sizes = offsets[1:] - offsets[:-1]
        text = np.repeat(np.arange(len(sizes)), sizes)
        left = offsets[1:][text] - np.arange(len(data))
        yield base + text, -offsets[:-1][text], data, left >= span


def _sample_rows(span: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for text, shift, data, valid in _slices(batch.column(1), span):
                if len(data) < span:
                    continue
                names = Names(data, span)
                first, last, place = samples(names, valid)
                if len(first) == 0:
                    continue
                whole = _join(names.full[first], names.full[last], ((place - first) * COVER + (last - place + COVER)).astype(np.uint64))
                # where a text was cut into slices the shift is an offset, else it takes the start of the text away
                begin = first + shift[first]
                columns = names.sample[place].view(np.int64), whole.view(np.int64), ids[text[first]], begin, begin + last - first
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sample", "whole", "row", "first", "last"])

    return run


def _string_rows(span: int):
    """Rows (row, text, ranges of (first, last, single)) to the name of each string in the ranges."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, _ = flat(batch.column(1).slice(i, 1))
                ranges = sorted((r["first"], r["last"], r["single"]) for r in batch.column(2)[i].as_py())
                row, found = batch.column(0)[i].as_py(), []
                names, begin, end = None, 0, -1
                for first, last, single in ranges:
                    if last > end:  # the names of the next slice
                        begin, end = first, min(len(data) - span, max(last, first + SLICE))
                        names = Names(data[begin : end + span], span).full
                    at = np.arange(first, last + 1)
                    found.append((names[at - begin].view(np.int64), at, np.full(len(at), single)))
                string, at, single = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(string), pa.array(np.full(len(at), row)), pa.array(at), pa.array(single)], names=["string", "row", "at", "single"]
                )

    return run


def _remove(span: int):
    def run(batches):
        for batch in batches:
            out = []
            data, offsets = flat(batch.column(1))
            raw = data.tobytes()
            for i, ranges in enumerate(batch.column(2).to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                kept, removed, runs, upto = hashlib.sha256(), 0, 0, -1
                begin = 0  # of the bytes kept next
                for r in sorted(ranges or (), key=lambda r: r["first"]):
                    a, b = r["first"], r["last"] + span
                    if a > upto:
                        kept.update(text[begin:a])
                        runs += 1
                        removed += b - a
                    elif b > upto:
                        removed += b - upto
                    upto = begin = max(upto, b)
                kept.update(text[begin:])
                out.append((len(text), removed, runs, kept.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return run


def repeated_ranges(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(row, ranges of (first, last)): strings beginning at first to last of a text occur elsewhere; from (row, text)."""
    every = materialize(docs.mapInArrow(_sample_rows(span), "sample long, whole long, row long, first long, last long"), "samples")
    shared = materialize(every.groupBy("sample").count().where("count > 1").select("sample"), "shared")
    let_go(docs.sparkSession)
    found = materialize(every.join(dealt(shared), "sample", "left_semi"), "repeated")
    discard(every)
    let_go(docs.sparkSession)
    one = F.min(F.struct("row", "first", "last"))
    kinds = materialize(found.groupBy("sample", "whole").agg(F.count("*").alias("times"), one.alias("one")), "wholes")
    same = found.join(dealt(kinds.where("times > 1").select("sample", "whole")), ["sample", "whole"], "left_semi").select("row", "first", "last")
    same = materialize(same, "same")
    discard(found)
    let_go(docs.sparkSession)

    unsure = kinds.groupBy("sample").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1")
    asked = kinds.join(materialize(unsure.select("sample"), "unsure"), "sample", "left_semi").select("one.*", (F.col("times") == 1).alias("single"))
    asked = materialize(asked.groupBy("row").agg(F.collect_list(F.struct("first", "last", "single")).alias("ranges")), "asked")
    discard(kinds)
    let_go(docs.sparkSession)
    # a text that repeats whole gives its strings more than once, and rightly: each of them does occur again
    strings = docs.join(dealt(asked), "row").select("row", "text", "ranges").mapInArrow(_string_rows(span), "string long, row long, at long, single boolean")
    strings = materialize(strings, "strings")
    let_go(docs.sparkSession)
    again = materialize(strings.groupBy("string").count().where("count > 1").select("string"), "again")
    let_go(docs.sparkSession)
    more = strings.where("single").join(dealt(again), "string", "left_semi").select("row", F.col("at").alias("first"), F.col("at").alias("last"))
    ranges = same.union(more).groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    ranges = materialize(ranges, "ranges")
    for table in (same, asked, strings, again):
        discard(table)
    let_go(docs.sparkSession)
    return ranges


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte of the UTF-8 text that a string of ``span`` bytes covers which
    also begins elsewhere, in the same or another text, is removed. Null texts
    are empty, texts shorter than ``span`` stay whole. Rows that repeat an id
    and text are documents of their own and so repeat each other; ids may be
    null. Other columns are not read, an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    ranges = repeated_ranges(docs.select("row", "text"), span)
    marked = docs.join(dealt(ranges), "row", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "ranges")
    return marked.mapInArrow(_remove(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
