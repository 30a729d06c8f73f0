"""Routes, stops and timetables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.functions.geo import CITY_CENTER, distance_class, haversine_km
from leakscope.functions.numeric import half_up
from leakscope.functions.text import LONG_NAME_SEPARATOR, clock, headsign, traffic_class

# Fixed values.
MIN_HOP_KM = 0.3
SERVICE_START_HOUR = 5
SERVICE_END_HOUR = 23
DWELL_MINUTES = 1.5
EXPRESS_KMH = 25.0
NORMAL_KMH = 15.0


def route_stop_order(stop_sequences: DataFrame) -> DataFrame:
    """Distinct stops of every route by their first position, numbered from 0."""
    first = stop_sequences.groupBy("route_id", "stop_id").agg(
        F.min("stop_sequence").alias("stop_sequence"),
        F.min_by("distance_from_start_km", "stop_sequence").alias("distance_from_start_km"))
    by_route = W.partitionBy("route_id").orderBy("stop_sequence", "stop_id")
    return first.withColumn("stop_index", F.row_number().over(by_route) - 1)


def route_segments(stop_order: DataFrame) -> DataFrame:
    """Pairs of consecutive stops."""
    by_route = W.partitionBy("route_id").orderBy("stop_index")
    nxt = stop_order.select(
        "route_id", F.col("stop_index").alias("segment_index"),
        F.col("stop_id").alias("segment_start_stop"),
        F.lead("stop_id").over(by_route).alias("segment_end_stop"),
        F.col("stop_sequence").alias("segment_start_seq"),
        F.lead("stop_sequence").over(by_route).alias("segment_end_seq"))
    return nxt.filter(F.col("segment_end_stop").isNotNull())


def cumulative_distance(stops: DataFrame) -> DataFrame:
    """Distance from the first stop of the route, every hop at least 300 m."""
    by_route = W.partitionBy("route_id").orderBy("stop_sequence")
    lat, lon = F.col("stop_lat"), F.col("stop_lon")
    hop = haversine_km(F.lag(lat).over(by_route), F.lag(lon).over(by_route), lat, lon)
    hops = stops.withColumn("_hop", F.when(F.row_number().over(by_route) == 1, 0.0)
                            .otherwise(F.greatest(hop, F.lit(MIN_HOP_KM))))
    running = F.sum("_hop").over(by_route.rowsBetween(W.unboundedPreceding, W.currentRow))
    return hops.select("route_id", "stop_id", "stop_sequence",
                       half_up(running, 1).alias("distance_from_start_km"))


def route_names(stops: DataFrame) -> DataFrame:
    return stops.groupBy("route_id").agg(F.concat(
        F.min_by("stop_name", "stop_sequence"), F.lit(LONG_NAME_SEPARATOR),
        F.max_by("stop_name", "stop_sequence")).alias("route_long_name"))


def stop_classes(stops: DataFrame) -> DataFrame:
    """Stop type by distance from the centre, traffic class by words in the name."""
    center_lat, center_lon = (F.lit(x) for x in CITY_CENTER)
    away = haversine_km(center_lat, center_lon, F.col("stop_lat"), F.col("stop_lon"))
    return stops.select("stop_id", "stop_name", distance_class(away).alias("stop_type"),
                        traffic_class("stop_name").alias("traffic_class"))


def _speed():
    return F.when(F.col("route_category") == "express", EXPRESS_KMH).otherwise(NORMAL_KMH)


def trips(routes: DataFrame) -> DataFrame:
    """Evenly spaced departures of every route over the service day."""
    day_minutes = (SERVICE_END_HOUR - SERVICE_START_HOUR) * 60.0
    numbered = routes.select("*", F.explode(F.sequence(F.lit(0), F.col("trips_per_day") - 1)).alias("_i"))
    start = (SERVICE_START_HOUR * 60
             + F.floor(F.col("_i") * (day_minutes / F.col("trips_per_day")) + 0.5)).cast("int")
    ride = F.col("total_distance_km") / _speed() * 60.0 + F.col("num_stops") * DWELL_MINUTES
    return numbered.withColumn("start_minute", start).select(
        F.concat("route_id", F.lit("_T"), F.lpad((F.col("_i") + 1).cast("string"), 3, "0"))
        .alias("trip_id"),
        "route_id", "route_category", F.lit("WEEKDAY").alias("service_id"),
        headsign("route_long_name", "route_short_name").alias("trip_headsign"),
        F.lit(0).alias("direction_id"), "start_minute",
        clock(F.col("start_minute")).alias("scheduled_start"),
        clock(F.col("start_minute") + ride).alias("scheduled_end"))


def stop_times(routes: DataFrame, stops: DataFrame) -> DataFrame:
    """Arrival at every stop of every trip."""
    served = stops.select("route_id", "stop_id", "stop_sequence", "distance_from_start_km")
    ride = (F.col("distance_from_start_km") / _speed() * 60.0
            + (F.col("stop_sequence") - 1) * DWELL_MINUTES)
    arrival = clock(F.col("start_minute") + ride)
    return (trips(routes).join(served, "route_id")
            .select("trip_id", "route_id", "stop_id", "stop_sequence",
                    arrival.alias("arrival_time"), arrival.alias("departure_time"),
                    "distance_from_start_km"))


def trip_days(trip_table: DataFrame, days: DataFrame) -> DataFrame:
    """Trips per route times the number of days in a one-row table."""
    return trip_table.groupBy("route_id").agg(
        F.count("*").alias("trips")).withColumn("trip_days", F.col("trips") * days.scalar())


def stop_sums(events: DataFrame) -> DataFrame:
    """Boardings and alightings per trip and stop, of a table or a stream."""
    return events.groupBy("trip_id", "stop_sequence").agg(
        F.sum("boarding_count").alias("boarded"), F.sum("alighting_count").alias("alighted"))


def onboard_load(events: DataFrame) -> DataFrame:
    """Passengers on board after each stop of a trip."""
    return load_along(stop_sums(events))


def load_along(per_stop: DataFrame) -> DataFrame:
    """Running load from the sums per stop; it orders at most one row per stop of a trip."""
    along = (W.partitionBy("trip_id").orderBy("stop_sequence")
             .rowsBetween(W.unboundedPreceding, W.currentRow))
    return per_stop.withColumn("on_board", F.sum(F.col("boarded") - F.col("alighted")).over(along))


def event_hours(events: DataFrame, routes: DataFrame) -> DataFrame:
    """Hour at which a stop is reached: start hour plus the share of the route done, twice."""
    joined = events.join(routes.select("route_id", "num_stops"), "route_id")
    progress = F.col("stop_sequence") / F.col("num_stops")
    reached = F.col("sim_hour") + F.floor(F.col("stop_sequence") * 2 / F.col("num_stops"))
    return joined.select("event_id", "route_id", half_up(progress, 4).alias("route_progress"),
                         F.least(reached, F.lit(23)).cast("int").alias("event_hour"))
