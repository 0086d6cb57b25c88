"""Paradata streams: session state, windows with a watermark, and an append sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).parquet(folder)


def fold_sessions(events: DataFrame) -> DataFrame:
    """Latest event of each user and the number of all; the last write wins.

    An aggregate on order-free functions, so it runs on a table and on a stream alike.
    """
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    return events.groupBy("user_id").agg(last.alias("l"), F.count("*").alias("events")).select("user_id", F.col("l.event_type").alias("last_event"), F.col("l.value").alias("last_value"), "events")


def activity(events: DataFrame, *, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by event-time window and type; rows later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user, closed by a gap in event time."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, all that is available now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
