"""Labelled anomalies: which events they cover and what they do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.numeric import cents, from_cents, half_up

# Fixed values.
GHOST_TRIP_SHARE = 0.05
DIGITAL_MODES = ["upi", "card"]


def covered_cells(truth: DataFrame) -> DataFrame:
    """First anomaly by id for every (route, date, hour, stop position) one covers.

    An anomaly covers a few hours and a stretch of one route, so listing its
    cells stays within the size of the network and turns the two range
    conditions into equalities.
    """
    cells = truth.select(
        "route_id", "sim_date", "anomaly_id", "anomaly_type", "severity",
        F.explode(F.sequence("start_stop_sequence", "end_stop_sequence")).alias("stop_sequence"),
        F.sequence("time_window_start", "time_window_end").alias("_hours")
    ).withColumn("sim_hour", F.explode("_hours"))
    first = F.min_by(F.struct("anomaly_id", "anomaly_type", "severity"), "anomaly_id")
    return (cells.groupBy("route_id", "sim_date", "sim_hour", "stop_sequence")
            .agg(first.alias("_first"))
            .select("route_id", "sim_date", "sim_hour", "stop_sequence",
                    F.col("_first.anomaly_id").alias("matched_anomaly_id"),
                    F.col("_first.anomaly_type").alias("matched_type"),
                    F.col("_first.severity").alias("matched_severity")))


def match_anomalies(events: DataFrame, truth: DataFrame, date_col: str = "sim_date") -> DataFrame:
    """Events with the first anomaly that covers them, if any."""
    cells = covered_cells(truth).withColumnRenamed("sim_date", "_truth_date")
    at = [F.col("e.route_id") == F.col("c.route_id"),
          F.col(f"e.{date_col}") == F.col("c._truth_date"),
          F.col("e.sim_hour") == F.col("c.sim_hour"),
          F.col("e.stop_sequence") == F.col("c.stop_sequence")]
    return (events.alias("e").join(cells.alias("c"), at, "left")
            .select("e.*", "c.matched_anomaly_id", "c.matched_type", "c.matched_severity"))


def _kept_share() -> tuple[Column, Column]:
    """Share of tickets and of revenue that is still reported."""
    kind, rest = F.col("matched_type"), 1.0 - F.col("matched_severity")
    digital = F.col("payment_mode").isin(DIGITAL_MODES)
    tickets = (F.when(kind.isin("under_reporting", "fare_evasion_cluster"), rest)
               .when(kind == "ghost_trip", GHOST_TRIP_SHARE).otherwise(1.0))
    revenue = (F.when(kind.isin("under_reporting", "fare_evasion_cluster"), rest)
               .when(kind == "ghost_trip", GHOST_TRIP_SHARE)
               .when((kind == "qr_upi_fraud") & digital, rest).otherwise(1.0))
    return tickets, revenue


def apply_anomalies(matched: DataFrame) -> DataFrame:
    """Reported tickets and revenue under the matched anomalies.

    Starts from clean events: every boarding sold a ticket and all money was
    reported.
    """
    tickets, revenue = _kept_share()
    boarded, expected = F.col("boarding_count"), F.col("expected_revenue")
    return (matched
            .withColumn("ticket_count",
                        F.greatest(F.lit(0), F.floor(boarded * tickets + 0.5).cast("int")))
            .withColumn("reported_revenue",
                        F.greatest(F.lit(0.0), half_up(expected * revenue, 2)))
            .withColumn("is_anomalous", F.col("matched_anomaly_id").isNotNull().cast("int"))
            .withColumn("anomaly_id", F.col("matched_anomaly_id"))
            .drop("matched_anomaly_id", "matched_type", "matched_severity"))


def magnitudes(events: DataFrame) -> DataFrame:
    """Money missing under each anomaly."""
    gap = F.sum(cents("expected_revenue") - cents("reported_revenue"))
    return (events.filter(F.col("anomaly_id").isNotNull()).groupBy("anomaly_id")
            .agg(from_cents(gap).alias("magnitude"), F.count("*").alias("events")))


def with_magnitudes(truth: DataFrame, events: DataFrame) -> DataFrame:
    found = magnitudes(events).select("anomaly_id", F.col("magnitude").alias("_magnitude"))
    return (truth.join(found, "anomaly_id", "left")
            .withColumn("magnitude", F.coalesce("_magnitude", F.lit(0.0))).drop("_magnitude"))
