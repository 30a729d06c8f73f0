"""Event enrichment and model features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.functions.demand import lookup
from leakscope.functions.numeric import or_default, ratio_or

FORECAST_FEATURES = [
    "hour", "day_of_week", "is_weekend", "is_peak_morning", "is_peak_evening",
    "hour_sin", "hour_cos", "dow_sin", "dow_cos",
    "route_category_num", "stop_sequence", "boarding_density"]
ANOMALY_FEATURES = [
    "revenue_ratio", "ticket_ratio", "revenue_gap", "hour", "is_peak_morning",
    "is_peak_evening", "route_category_num", "boarding_density"]


def enrich(events: DataFrame, routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Events with the category of their route and the density of their stop.

    No join hint: Spark broadcasts a dimension once its size is known to be
    small and otherwise sort-merges, splitting skewed keys.
    """
    return (events.join(routes.select("route_id", "route_category"), "route_id")
            .join(stops.select("stop_id", "boarding_density"), "stop_id"))


def _cyclic(position: Column, period: int) -> tuple[Column, Column]:
    angle = 2.0 * math.pi * position / float(period)
    return F.sin(angle), F.cos(angle)


def _flag(condition: Column) -> Column:
    return condition.cast("int")


def category_code(category: Column) -> Column:
    return lookup(category, schemas.ROUTE_CATEGORY_CODES, schemas.UNKNOWN_CATEGORY_CODE)


def engineer(enriched: DataFrame) -> DataFrame:
    """One feature row per event, in a single projection."""
    hour, day = F.col("sim_hour"), F.col("day_of_week")
    hour_sin, hour_cos = _cyclic(hour, 24)
    dow_sin, dow_cos = _cyclic(day, 7)
    expected, reported = F.col("expected_revenue"), F.col("reported_revenue")
    boarded, tickets = F.col("boarding_count"), F.col("ticket_count")
    return enriched.select(
        *[c for c in ("event_id",) if c in enriched.columns],
        hour.alias("hour"), day.alias("day_of_week"),
        _flag(day.isin(0, 6)).alias("is_weekend"),
        _flag(hour.between(8, 10)).alias("is_peak_morning"),
        _flag(hour.between(17, 20)).alias("is_peak_evening"),
        hour_sin.alias("hour_sin"), hour_cos.alias("hour_cos"),
        dow_sin.alias("dow_sin"), dow_cos.alias("dow_cos"),
        category_code(F.col("route_category")).alias("route_category_num"),
        F.coalesce("stop_sequence", F.lit(0)).alias("stop_sequence"),
        or_default("boarding_density", 1.0).alias("boarding_density"),
        "boarding_count", "expected_revenue", "reported_revenue", "ticket_count",
        ratio_or(reported, expected, 1.0).alias("revenue_ratio"),
        ratio_or(tickets, boarded, 1.0).alias("ticket_ratio"),
        (expected - reported).alias("revenue_gap"),
        "route_id", "trip_id", "stop_id", "sim_date", "is_anomalous", "anomaly_id")


def feature_array(names: list[str]) -> Column:
    """Features as ARRAY<DOUBLE>, missing values as 0."""
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])
