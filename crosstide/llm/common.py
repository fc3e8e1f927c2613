"""Shared pieces: Arrow batches of bounded size, text buffers as arrays, hashed words, folds."""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crosstide import session

PIECE = 1 << 20  # bytes of text worked on at a time; one longer text is a piece of its own

_GEN = np.random.default_rng(20240229)
_TABLE = _GEN.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = _TABLE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_TEXT_ONLY = _SPACE.copy()
_TEXT_ONLY[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
SEPARATORS = {"space": _SPACE, "space and marks": _TEXT_ONLY}
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def small_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Hand Python workers few rows at a time: some texts are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of steps that have ended.

    It does so when the driver collects its garbage. Right after a step its plan
    is still held by the report of its end, so the second time counts.
    """
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Shuffle files of earlier steps go first: nothing refers to their plans any
    more, but Spark deletes them only when the driver collects its garbage.
    """
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return session.materialize(df, name)


def discard(table: DataFrame) -> None:
    """Delete a table of ``materialize`` once all that reads it has been written."""
    spark, files = table.sparkSession, table.inputFiles()
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session.shared_folder(spark)).toUri().getPath()
    for path in {f.rpartition("/")[0] for f in files}:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.toUri().getPath().startswith(folder.rstrip("/") + "/"):
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def dealt(side: DataFrame) -> DataFrame:
    """A side of a join that is shuffled however small it is, so that the plan is the same at every size."""
    return side.hint("merge")


def held_out(id_column: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """True where crc32 of the id as text leaves remainder ``fold`` when divided by ``folds``."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(False))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and where each begins (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(data: np.ndarray, offsets: np.ndarray, size: int = PIECE):
    """Runs of whole texts of about ``size`` bytes: (first text, bytes, offsets)."""
    first, last = 0, len(offsets) - 1
    while first < last:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def powers(base: int, n: int) -> np.ndarray:
    """At least ``n`` powers of an odd base modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(max(n, PIECE), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, between: str = "space") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes that are no separators) of all texts: 64-bit hash, text, first byte."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~SEPARATORS[between][data]
    starting, ending = inside.copy(), inside.copy()
    starting[1:] &= ~inside[:-1]
    ending[:-1] &= ~inside[1:]
    begins, ends = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    starting[begins], ending[ends] = inside[begins], inside[ends]
    starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_FOLDED if lower else _TABLE)[data] * powers(_BASE, n)[:n], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), np.searchsorted(offsets, starts, side="right") - 1, starts


def running_sums(data: np.ndarray, lower: bool = False) -> np.ndarray:
    """Sums from which ``span_hashes`` takes the hash of any span of ``data``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if lower else _TABLE)[data] * powers(_BASE, len(data))[: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: equal strings have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(column: pa.Array, k: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``k``-word runs.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    sets: list[np.ndarray] = []
    empty = np.zeros(0, np.uint64)
    for _, data, offsets in pieces(*flat(column)):
        hashes, text, _ = words(data, offsets)
        n = len(offsets) - 1
        ends = np.cumsum(np.bincount(text, minlength=n))
        rolled = hashes
        if len(hashes) >= k:
            rolled = hashes[: len(hashes) - k + 1].copy()
            for j in range(1, k):
                rolled = rolled * np.uint64(_BASE) + hashes[j : len(hashes) - k + 1 + j]
            rolled = mix(rolled)
        begin = 0
        for end in ends.tolist():
            if end - begin >= k:
                sets.append(np.unique(rolled[begin : end - k + 1]))
            elif end > begin:
                h = np.uint64(end - begin)
                with np.errstate(over="ignore"):
                    for w in hashes[begin:end]:
                        h = h * np.uint64(_BASE) + w
                sets.append(mix(np.array([h], np.uint64)))
            else:
                sets.append(empty)
            begin = end
    return sets


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)
