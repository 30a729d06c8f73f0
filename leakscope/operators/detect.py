"""Seasonal baselines and the weighted detection score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.functions.numeric import (cents, clamp01, from_cents, half_up, population_std,
                                         ratio_or, sum_squared_cents)
from leakscope.functions.text import window_label
from leakscope.operators.selection import sample_rows

# Fixed values.
BASELINE_KEYS = ["route_id", "sim_hour", "day_of_week"]
Z_LIMIT = 2.5
WEIGHTS = {"baseline": 0.4, "revenue": 0.35, "tickets": 0.25}
FLAG_ABOVE = 0.3
DETECTION_TYPE = "ml_ensemble"


def baselines(events: DataFrame, keys: list[str] = BASELINE_KEYS,
              value: str = "expected_revenue") -> DataFrame:
    """Population mean, deviation and count per key, from exact integer sums."""
    sums = events.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.sum(cents(value)).cast("decimal(38,0)").alias("_sum"),
        sum_squared_cents(value).alias("_squares"))
    n = F.col("_n")
    return sums.select(
        *keys,
        (from_cents(F.col("_sum")) / n).alias("mean"),
        (population_std(n, F.col("_sum"), F.col("_squares")) / 100.0).alias("stddev"),
        n.alias("n"))


def baseline_events(events: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Rows the detector learns from: normal events, all of them or a fixed-size sample."""
    normal = events.filter(F.col("is_anomalous") == 0)
    return normal if sample is None else sample_rows(normal, "event_id", sample, seed)


def with_deviation(events: DataFrame, keys: list[str] = BASELINE_KEYS, value: str = "expected_revenue") -> DataFrame:
    """Events with the deviation that ``baselines`` has for their key, learned from the normal ones among them.

    One shuffle of the events serves learning and scoring.  Without a key there is no baseline.
    """
    of_key = W.partitionBy(*keys)
    normal = F.when(F.col("is_anomalous") == 0, F.col(value))
    spread = population_std(F.count(normal).over(of_key), F.sum(cents(normal)).over(of_key).cast("decimal(38,0)"),
                            sum_squared_cents(normal, of_key)) / 100.0
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    # spread as they are; what the window derives from them need not travel
    return events.repartition(*keys).withColumn("stddev", F.when(known, spread))


def z_score() -> Column:
    """(expected - reported) / deviation; 0 without a usable baseline."""
    usable = F.col("stddev").isNotNull() & (F.col("stddev") != 0)
    return F.when(usable, (F.col("expected_revenue") - F.col("reported_revenue")) / F.col("stddev")
                  ).otherwise(F.lit(0.0))


def score_against(events: DataFrame, learned: DataFrame, keys: list[str] = BASELINE_KEYS
                  ) -> DataFrame:
    """Events with z_score, baseline_score and is_anomaly."""
    return _scored(events.join(learned.select(*keys, "stddev"), keys, "left"))


def _scored(with_stddev: DataFrame) -> DataFrame:
    return (with_stddev.withColumn("z_score", z_score())
            .withColumn("baseline_score",
                        F.least(F.lit(1.0), F.abs("z_score") / (Z_LIMIT * 2.0)))
            .withColumn("is_anomaly", F.abs("z_score") > Z_LIMIT)
            .drop("stddev"))


def ensemble_score() -> Column:
    expected, reported = F.col("expected_revenue"), F.col("reported_revenue")
    boarded, tickets = F.col("boarding_count"), F.col("ticket_count")
    revenue_gap = ratio_or(expected - reported, expected, 0.0)
    ticket_gap = ratio_or(boarded - tickets, boarded, 0.0)
    return clamp01(F.col("baseline_score") * WEIGHTS["baseline"]
                   + F.abs(revenue_gap) * WEIGHTS["revenue"]
                   + F.abs(ticket_gap) * WEIGHTS["tickets"])


def detections(enriched: DataFrame, learned: DataFrame | None = None, keys: list[str] = BASELINE_KEYS
               ) -> DataFrame:
    """One scored row per event.  The flag looks at the unrounded score.  Events that bring
    the deviation of their key along (``with_deviation``) need no baselines."""
    scored = (_scored(enriched) if learned is None else score_against(enriched, learned, keys)
              ).withColumn("_score", ensemble_score())
    gap = F.col("expected_revenue") - F.col("reported_revenue")
    return scored.select(
        "event_id", "route_id", "trip_id", "stop_id", "stop_sequence", "sim_date",
        F.col("sim_hour").alias("hour"),
        half_up("_score", 4).alias("anomaly_score"),
        "expected_revenue", "reported_revenue",
        half_up(gap, 2).alias("discrepancy"),
        half_up("z_score", 2).alias("z_score"),
        (F.col("_score") > FLAG_ABOVE).alias("is_flagged"),
        "boarding_count", "ticket_count",
        F.col("is_anomalous").alias("is_ground_truth_anomaly"),
        "anomaly_id")


def flagged(detected: DataFrame) -> DataFrame:
    return detected.filter("is_flagged")


def anomaly_records(detected: DataFrame) -> DataFrame:
    """Flagged rows in the form of the review queue.

    The id is a hash of the event, so a rerun replaces its own rows.
    """
    return flagged(detected).select(
        F.sha2("event_id", 256).alias("detection_id"),
        "anomaly_score", "route_id", "trip_id", "stop_id", "stop_sequence",
        F.col("stop_id").alias("segment_start_stop"), F.col("stop_id").alias("segment_end_stop"),
        window_label(F.col("hour"), F.col("hour") + 1).alias("time_window"),
        "sim_date", F.lit(DETECTION_TYPE).alias("detection_type"),
        F.col("expected_revenue").alias("expected_value"),
        F.col("reported_revenue").alias("reported_value"),
        "discrepancy", F.col("anomaly_id").alias("matched_ground_truth_id"),
        F.lit("new").alias("status"))
