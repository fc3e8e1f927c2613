"""Keep-latest over a stream: one state per key, released by an event-time timer.

For each key the newest row is held, by the same order as the batch
``latest_by``.  A micro-batch gives out one row for each key whose newest row
has changed, however many rows of the key it had.  A key's state goes when the
watermark has passed its newest event time by ``keep``; rows that come behind
the watermark are late and are dropped by Spark.

``store_latest`` writes what the stream gives out as committed batches whose id
is that of the micro-batch, so a replayed one is stored once; ``read_latest``
folds them to one row a key.  Together they equal ``latest_by`` over all rows
that were not late, in whatever order the files came.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from crosstide.operators.timeline import latest_by
from crosstide.sources import commits

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestRow(StatefulProcessor):
    """Holds the newest row of a key and gives it out when a newer one has come."""

    def __init__(self, schema: StructType, keys: Sequence[str], order: Sequence[str], time: str, keep_ms: int):
        self.schema, self.keys, self.order, self.time, self.keep_ms = schema, list(keys), list(order), time, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", self.schema)

    def _rank(self, row: tuple) -> tuple:
        """Nulls come first, as they do in a maximum over a struct."""
        values = [row[self.schema.fieldNames().index(c)] for c in self.order]
        return tuple((not pd.isna(v), None if pd.isna(v) else v) for v in values)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        names = self.schema.fieldNames()
        held = tuple(self.newest.get()) if self.newest.exists() else None
        best = held
        for frame in rows:
            for row in frame[names].itertuples(index=False, name=None):
                if best is None or self._rank(row) > self._rank(best):
                    best = row
        if best is not held:
            best = tuple(None if pd.isna(v) else v for v in best)
            self.newest.update(best)
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            at = best[names.index(self.time)]
            self.handle.registerTimer(int(pd.Timestamp(at).tz_localize("UTC").timestamp() * 1000) + self.keep_ms)
            yield pd.DataFrame([best], columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.newest.clear()
        yield from ()

    def close(self) -> None:
        pass


def latest_per_key(stream: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, delay: str = "1 day", keep_ms: int = 86_400_000) -> DataFrame:
    """Rows that became the newest of their key, with the columns of ``stream``.

    ``order`` ranks rows of a key, first column first; rows alike in it keep the
    one that came first, so name enough columns.  ``time`` is the event time
    (a timestamp, never null in rows that count; rows without one are left out).
    Needs the RocksDB state store (``STATE_STORE``) and a UTC session.
    """
    schema = stream.schema
    rows = stream.where(F.col(time).isNotNull()).withWatermark(time, delay)
    processor = LatestRow(schema, keys, order, time, keep_ms)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Update", "eventTime")


def store_latest(latest: DataFrame, root: str, checkpoint: str, name: str) -> StreamingQuery:
    """Append what the stream gives out to a committed table; a replayed micro-batch adds nothing."""

    def load(batch: DataFrame, number: int) -> None:
        commits.append(batch, root, None, f"{name}-{number}")

    writer = latest.writeStream.foreachBatch(load).outputMode("update").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def read_latest(spark: SparkSession, root: str, schema: StructType, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key of a table that ``store_latest`` writes."""
    return latest_by(commits.read(spark, root, schema), keys, order)
