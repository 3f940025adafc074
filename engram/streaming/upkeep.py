"""Index upkeep and read counters over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import Store


def append_stream(stream: DataFrame, store: Store, db: str, checkpoint: str):
    """A stream of rows (content, source, importance, tags, created_at) into a database, a batch at a time.

    The version that adds a batch names it, so that a batch that is replayed after a failure is not added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        done = store.reload().dbs.get(db, {}).get("streams", {}).get(checkpoint, -1)
        if number > done and not batch.isEmpty():
            store.publish(store.append(store.current, db, batch, (checkpoint, number))[0])

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_heat(log: DataFrame, watermark: str = "1 day", window: str = "1 hour") -> DataFrame:
    """(window, id, heat) from a read log (ts, id), batch or stream; late rows beyond the watermark are left out."""
    timed = log.withWatermark("ts", watermark) if log.isStreaming else log
    return timed.groupBy(F.window("ts", window), "id").agg(F.count("*").alias("heat"))
