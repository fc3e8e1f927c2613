"""Phrase collocation mining: Misra-Gries summaries in hash partitions, then exact counts.

Texts of one language are put together into chunks of some megabytes, with a
piece break between two texts. A chunk is stored as rows of some 100 kB that
follow each other; Python workers put them together again, so that neither rows
nor batches are large in Spark. A phrase is one to three words that follow each
other within a piece; it has a 64-bit hash, whose upper bits name its hash
partition.

1. A summary of a hash partition keeps more counters than its mass (occurrences
   of phrases) divided by the threshold. Chunks bring their own counts; when a
   summary holds too many, the largest count that must go is taken off all of
   them. What is taken off in all, ``lost``, stays below the threshold, so each
   phrase that occurs often enough keeps a counter, and only those with count +
   lost >= threshold survive. A task holds one summary at a time, whatever the
   partition's rows are.
2. The second pass counts exactly. The hashes of each chunk meet the survivors
   of their hash partition; those that survive go back to their chunk, which
   counts them by their words. These counts are added up by language and phrase,
   so that two phrases with the same hash stay apart.
3. Frequent phrases of two and three words are scored by their weakest cut; the
   counts of the parts are joined from the same table, since a part is at least
   as frequent as the whole.
"""

from __future__ import annotations

import hashlib
import re
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstide.llm.common import dealt, discard, materialize, mix, running_sums, small_batches, span_hashes

CHUNK = 4 << 20  # bytes of text in the chunks of all languages together; one longer text ends them
SEGMENT = 2 << 20  # bytes of a chunk that are taken apart at a time
ROW = 192 << 10  # bytes of a chunk in a row; a longer stretch without a piece break is a row of its own
SENT = 1 << 20  # bytes in a batch between Spark and Python
MASS = 1 << 23  # occurrences in a hash partition
WORDS = 1 << 19  # words of the chunks that a task counts
BATCH = 1 << 15  # candidates of a language ranked together

_SPLIT = np.zeros(256, bool)
_SPLIT[[*b".,;:!?", 10, 11, 12, 13]] = True
_BETWEEN = _SPLIT.copy()
_BETWEEN[[9, 32]] = True
_BREAKS = re.compile(rb"[.,;:!?\n-\r]")
_UPPER, _LOWERED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
_BITS = 21  # of a word's number inside a segment
_ENTRIES = pa.schema({"part": pa.int64(), "chunk": pa.int64(), "entries": pa.binary()})


def stretches(text: bytes):
    """A text in parts of about ROW bytes, cut where a piece ends."""
    begin = 0
    while begin < len(text):
        found = _BREAKS.search(text, begin + ROW)
        end = found.end() if found else len(text)
        yield text[begin:end]
        begin = end


def _chunks(batches):
    """Rows (lang, text) to rows (chunk, lang, n_words, body) of chunks, with A-Z lowered."""
    lower = bytes.maketrans(_UPPER, _LOWERED)
    held: dict[str, list[bytes]] = {}
    size, number = 0, TaskContext.get().partitionId() << 32

    def row(lang, parts):
        body = b"\n".join(parts).translate(lower)
        inside = ~_BETWEEN[np.frombuffer(body, np.uint8)]
        n = int(np.count_nonzero(inside[1:] & ~inside[:-1]) + inside[:1].sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([lang]), pa.array([n], pa.int64()), pa.array([body], pa.binary())],
            names=["chunk", "lang", "n_words", "body"],
        )

    def flush():
        nonlocal number
        for lang, texts in held.items():
            parts, filled = [], 0
            for part in (p for text in texts for p in stretches(text)):
                if parts and filled + len(part) > ROW:
                    yield row(lang, parts)
                    parts, filled = [], 0
                parts.append(part)
                filled += len(part)
            if parts:
                yield row(lang, parts)
            number += 1

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if text.is_valid:
                data = text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(data)
                size += len(data)
            if size >= CHUNK:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def segments(batches):
    """Rows (chunk, lang, body) to (chunk, lang, about SEGMENT bytes of the chunk); rows without lang stay single."""
    own, held, size = None, [], 0
    for batch in batches:
        for chunk, lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if held and (lang is None or own != (chunk, lang) or size >= SEGMENT):
                yield *own, b"\n".join(held)
                held, size = [], 0
            own = chunk, lang
            held.append(body.as_buffer().to_pybytes())
            size += len(held[-1])
    if held:
        yield *own, b"\n".join(held)


def _sent(rows, schema: pa.Schema):
    """Rows that end with bytes, in batches of about SENT bytes."""
    held, size = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= SENT:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Segment:
    """Words and phrases of one part of a chunk: numbered words, counted phrases, their hashes."""

    def __init__(self, body: bytes, lang: str, longest: int):
        data = np.frombuffer(body, np.uint8)
        inside = ~_BETWEEN[data]
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        bounds = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.words, numbers = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        if len(self.words) >> _BITS:
            raise ValueError("too many different words in one piece of text")
        piece = np.cumsum(_SPLIT[data])[starts]
        raw = np.frombuffer(self.words.buffers()[2], np.uint8) if len(self.words) else data[:0]
        at = np.frombuffer(self.words.buffers()[1], np.int64)[: len(self.words) + 1] if len(self.words) else np.zeros(1, np.int64)
        salt = np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))
        own = mix(span_hashes(running_sums(raw[: at[-1]]), at[:-1], at[1:]) ^ salt)
        self.numbers, self.counts, self.hashes = [], [], []
        for size in range(1, longest + 1):
            count = max(0, len(numbers) - size + 1)
            whole = piece[:count] == piece[len(numbers) - count :]
            packed = np.zeros(count, np.int64)
            for k in range(size):
                packed = packed << _BITS | numbers[k : k + count]
            packed, times = np.unique(packed[whole], return_counts=True)
            hashes = np.full(len(packed), size, np.uint64)
            for k in range(size):
                hashes = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + own[self.word(packed, size, k)])
            self.numbers.append(packed)
            self.counts.append(times)
            self.hashes.append(hashes)

    @staticmethod
    def word(packed: np.ndarray, size: int, k: int) -> np.ndarray:
        return packed >> (_BITS * (size - 1 - k)) & ((1 << _BITS) - 1)

    def phrases(self, size: int, keep: np.ndarray) -> pa.Array:
        """The kept phrases of one size, words joined by a space."""
        packed = self.numbers[size - 1][keep]
        parts = [self.words.take(pa.array(self.word(packed, size, k))).cast(pa.large_string()) for k in range(size)]
        return parts[0] if size == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))


def hash_counts(parts, lang: str, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the phrases of a chunk, given in parts, and their counts."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in parts:
        segment = Segment(part, lang, longest)
        hashes += segment.hashes
        counts += segment.counts
    return folded(np.concatenate(hashes), np.concatenate(counts))


def folded(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    return hashes[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(hashes: np.ndarray, counts: np.ndarray | None = None) -> bytes:
    """Sorted hashes as differences, byte by byte, so that shuffle files compress; then the counts."""
    steps = np.diff(hashes, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
    return steps + (counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() if counts is not None else b"")


def unpacked(blob: bytes, counted: bool = True) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(blob, np.uint8)
    n = len(raw) // (12 if counted else 8)
    hashes = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    counts = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel().astype(np.int64) if counted else np.ones(n, np.int64)
    return hashes, counts


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _cut(hashes: np.ndarray, parts: int):
    """(part, begin, end) of the runs of sorted hashes."""
    edges = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    return [(p, edges[p], edges[p + 1]) for p in np.flatnonzero(np.diff(edges)).tolist()]


def _hashed(parts: int, longest: int, counted: bool):
    """Chunks (chunk, lang, body) to one row (part, chunk, entries) for each hash partition.

    With counts, a row with chunk -1 brings the mass of the chunk in the partition.
    """

    def rows(batches):
        for (chunk, lang), own in groupby(segments(batches), lambda row: row[:2]):
            hashes, counts = hash_counts((body for _, _, body in own), lang, longest)
            for p, a, b in _cut(hashes, parts):
                yield p, chunk, packed(hashes[a:b], counts[a:b] if counted else None)
                if counted:
                    yield p, -1, int(counts[a:b].sum()).to_bytes(8, "little")

    return lambda batches: _sent(rows(batches), _ENTRIES)


class Summary:
    """Misra-Gries counters of a hash partition; ``mass`` is what all its chunks bring."""

    def __init__(self, mass: int, threshold: int):
        self.capacity, self.threshold, self.lost = mass // threshold + 1, threshold, 0
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, hashes: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((hashes, counts))
        self.size += len(hashes)
        if self.size >= self.capacity:
            self.merge()

    def merge(self) -> None:
        hashes, counts = zip((self.hashes, self.counts), *self.waiting, strict=True)
        self.hashes, self.counts = folded(np.concatenate(hashes), np.concatenate(counts))
        self.waiting, self.size = [], 0
        if len(self.hashes) > self.capacity:
            off = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            self.lost += off
            keep = self.counts > off
            self.hashes, self.counts = self.hashes[keep], self.counts[keep] - off

    def survivors(self) -> np.ndarray:
        self.merge()
        return self.hashes[self.counts + self.lost >= self.threshold]


def _summarise(threshold: int):
    """Rows (part, chunk, entries) in order of part, masses (chunk -1) first, to one row of survivors for each part."""

    def run(batches):
        def row():
            kept = summary.survivors()
            return pa.RecordBatch.from_arrays(
                [pa.array([current], pa.int64()), pa.array([-1], pa.int64()), pa.array([packed(kept)], pa.binary())], names=["part", "chunk", "entries"]
            )

        current, mass, summary = None, 0, None
        for batch in batches:
            for part, chunk, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if part != current:
                    if summary:
                        yield row()
                    current, mass, summary = part, 0, None
                if chunk < 0:
                    mass += int.from_bytes(entries.as_py(), "little")
                    continue
                summary = summary or Summary(mass, threshold)
                summary.add(*unpacked(entries.as_buffer().to_pybytes()))
        if summary:
            yield row()

    return run


def _surviving(batches):
    """Rows (part, chunk, entries), survivors (chunk -1) first, to the hashes of each chunk that survive."""
    current, kept = None, None
    for batch in batches:
        chunks, found = [], []
        for part, chunk, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            hashes, _ = unpacked(entries.as_buffer().to_pybytes(), counted=False)
            if chunk < 0:
                current, kept = part, hashes
                continue
            if part != current or not len(kept):
                continue
            at = np.minimum(np.searchsorted(kept, hashes), len(kept) - 1)
            both = hashes[kept[at] == hashes]
            if len(both):
                chunks.append(chunk)
                found.append(packed(both))
        if chunks:
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array([None] * len(chunks), pa.string()), pa.array(found, pa.binary())], names=["chunk", "lang", "body"]
            )


def _counted(longest: int):
    """Rows (chunk, lang, body), surviving hashes (lang null) first, to exact counts (lang, size, phrase, times)."""

    def run(batches):
        current, kept = None, []
        for chunk, lang, body in segments(batches):
            if chunk != current:
                current, kept = chunk, []
            if lang is None:
                kept.append(unpacked(body, counted=False)[0])
                continue
            wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *kept]))
            if not len(wanted):
                continue
            segment = Segment(body, lang, longest)
            for size in range(1, longest + 1):
                hashes = segment.hashes[size - 1]
                keep = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, hashes), len(wanted) - 1)] == hashes)
                for at in range(0, len(keep), 20_000):
                    some = keep[at : at + 20_000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(some), pa.string()),
                            pa.array(np.full(len(some), size, np.int32)),
                            segment.phrases(size, some).cast(pa.string()),
                            pa.array(segment.counts[size - 1][some]),
                        ],
                        names=["lang", "size", "phrase", "times"],
                    )

    return run


def frequent_phrases(chunks: DataFrame, threshold: int, longest: int = 3) -> DataFrame:
    """(lang, size, phrase, f) of every phrase with f >= threshold, f being exact."""
    words = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    parts = max(192, longest * words // MASS)
    bodies, hashed = chunks.select("chunk", "lang", "body"), "part long, chunk long, entries binary"
    own = bodies.mapInArrow(_hashed(parts, longest, True), hashed)
    survivors = own.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_summarise(threshold), hashed)
    survivors = materialize(survivors, "survivors")
    survivors.count()  # Spark refers to the last query, and so to its shuffle files, until the next one has run

    own = bodies.mapInArrow(_hashed(parts, longest, False), hashed).unionByName(survivors)
    marked = own.repartition(parts, "part").sortWithinPartitions("part", "chunk").mapInArrow(_surviving, "chunk long, lang string, body binary")
    marked = materialize(marked, "marked")
    tasks = max(64, words // WORDS)
    both = marked.unionByName(bodies).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("lang").asc_nulls_first())
    counts = both.mapInArrow(_counted(longest), "lang string, size int, phrase string, times long")
    exact = counts.groupBy("lang", "size", "phrase").agg(F.sum("times").alias("f")).where(F.col("f") >= threshold)
    exact = materialize(exact, "frequent")
    discard(survivors)
    discard(marked)
    return exact


def collocations(frequent: DataFrame, percent: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words that no longer one takes over."""
    exact = "decimal(38,0)"
    candidates = frequent.where("size > 1").withColumnRenamed("f", "a").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "size", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.withColumn("first", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice("words", F.col("k") + 1, F.col("size")), " "))
    left = frequent.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.drop("words").join(dealt(left), ["lang", "first"]).join(dealt(right), ["lang", "rest"])
    cuts = cuts.withColumn("a2", F.lit(1_000_000).cast(exact) * F.col("a").cast(exact) * F.col("a").cast(exact)).withColumn("lr", F.col("l").cast(exact) * F.col("r").cast(exact))
    cuts = cuts.withColumn("score", F.expr("a2 div lr"))
    scored = cuts.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = candidates.where("size > 2").select(
        "lang", F.col("a").alias("over"), F.explode(F.array(F.array_join(F.slice("words", 1, 2), " "), F.array_join(F.slice("words", 2, 2), " "))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    kept = scored.join(dealt(longer), ["lang", "phrase"], "left").where(F.col("over").isNull() | (100 * F.col("over") < percent * F.col("a")))
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def first_of_each(rows: DataFrame, key: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each key in ``order``, with their rank; a key's rows are ranked in rounds of small groups."""
    left = rows.count()
    while left > 2 * BATCH:
        group = Window.partitionBy(key, "salt").orderBy(*order)
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(-(-left // BATCH))))
        rows = materialize(salted.withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= most).drop("salt", "rank"), "first")
        before, left = left, rows.count()
        if left > before * 0.9:
            break
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= most)


def mine_phrases(docs: DataFrame, threshold: int = 10, percent: int = 50, most: int = 2000) -> DataFrame:
    """Each language's first ``most`` collocations: lang, rank, phrase, a, l, r, n, score.

    A null language is ``und``; null and empty texts have no words, repeated rows
    count each time, ids are not read. Phrases end at [.,;:!?] and line ends and
    never cross texts. Ties go by a, then by the phrase's bytes. An empty table,
    or one without a phrase that occurs ``threshold`` times, gives no rows. Other
    columns than lang and text are not read.
    """
    small_batches(docs.sparkSession, size=SENT)
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    chunks = materialize(texts.mapInArrow(_chunks, "chunk long, lang string, n_words long, body binary"), "chunks")
    total = chunks.groupBy("lang").agg(F.sum("n_words").alias("n"))
    found = materialize(collocations(frequent_phrases(chunks, threshold), percent), "collocations")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = first_of_each(found, "lang", order, most).join(dealt(materialize(total, "totals")), "lang")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
