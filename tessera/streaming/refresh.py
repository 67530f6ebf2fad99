"""Structured Streaming: a stream of changed paths keeps an index fresh, and rolling counts of its events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.plans.engine import Engine


def refresh_from(changes: DataFrame, engine: Engine, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Refresh the index for each batch of a stream with a column path. A batch that is run again changes nothing more."""

    def batch(rows: DataFrame, number: int) -> None:
        names = [r["path"] for r in rows.select("path").distinct().collect()]
        if names:
            engine.refresh(names)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def rolling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events a kind and window; rows later than ``late`` are dropped. ``events`` has ts and event_type."""
    windowed = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return windowed.select(F.col("window.start").alias("start"), "event_type", "n", "value")
