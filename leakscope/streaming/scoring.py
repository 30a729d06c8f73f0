"""Scoring events as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscope.operators import detect, features


def score_stream(events: DataFrame, routes: DataFrame, stops: DataFrame, learned: DataFrame) -> DataFrame:
    """Detections of a stream against stored baselines: stream-static joins, no state."""
    return detect.detections(features.enrich(events, routes, stops), learned)


def once_per_event(events: DataFrame, watermark: str = "2 hours") -> DataFrame:
    """First arrival of every event id within the watermark."""
    timed = events.withColumn("event_time", F.col("event_timestamp").cast("timestamp"))
    return (timed.withWatermark("event_time", watermark)
            .dropDuplicatesWithinWatermark(["event_id"]).drop("event_time"))
