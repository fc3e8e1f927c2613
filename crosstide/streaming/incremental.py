"""Incremental loading of landed rows with Structured Streaming."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crosstide.sources.sinks import insert_if_absent


def stream_inserts(stream: DataFrame, location: str, name: str, checkpoint: str) -> StreamingQuery:
    """Insert each micro-batch's new business keys into a stored table.

    A replayed batch finds its keys stored already, so it adds nothing.
    """

    def load(batch: DataFrame, _: int) -> None:
        insert_if_absent(batch, location, name)

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def first_per_key(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "1 day") -> DataFrame:
    """Drop later copies of a key inside the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
