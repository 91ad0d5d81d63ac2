"""Event streams: watermarked tumbling and session windows, per-key switch counts.

Each function takes a streaming or a batch DataFrame (event_id, user_id, ts, event_type,
value) and returns the transformation; the caller chooses sink and trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).option("pathGlobFilter", "*.parquet").parquet(path)


def _timed(events: DataFrame) -> DataFrame:
    """A stream's event time must carry a zone; a batch is taken as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")) if events.isStreaming else events


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, event_type, n, total) by event time; rows later than the watermark are dropped by a stream."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """(user_id, start, end, n): sessions closed by a gap."""
    w = _timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def switch_stream(events: DataFrame) -> DataFrame:
    """(user_id, events, switches) so far: changes of event type along each user's stream, kept as state of three values."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n, switches = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for kind in rows.event_type:
            switches += last is not None and kind != last
            last, n = kind, n + 1
        state.update((last, n, int(switches)))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "switches": [int(switches)]})

    rows = events.select("user_id", "event_id", "ts", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(update, "user_id bigint, events bigint, switches bigint", "last string, n bigint, switches bigint", "update", "NoTimeout")
