"""Table schemas, keys and enumerations."""

from __future__ import annotations

from pyspark.sql import types as T

S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()
DATE, NTZ, TS = T.DateType(), T.TimestampNTZType(), T.TimestampType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


STOPS = _schema(
    ("stop_id", S), ("stop_name", S), ("stop_lat", D), ("stop_lon", D),
    ("stop_type", S), ("boarding_density", D))

ROUTES = _schema(
    ("route_id", S), ("route_short_name", S), ("route_long_name", S), ("route_type", I),
    ("route_category", S), ("total_distance_km", D), ("num_stops", I))

TRIPS = _schema(
    ("trip_id", S), ("route_id", S), ("service_id", S), ("trip_headsign", S),
    ("direction_id", I), ("scheduled_start", S), ("scheduled_end", S))

STOP_SEQUENCES = _schema(
    ("trip_id", S), ("route_id", S), ("stop_id", S), ("stop_sequence", I),
    ("arrival_time", S), ("departure_time", S), ("distance_from_start_km", D))

FARE_SLABS = _schema(
    ("min_distance_km", D), ("max_distance_km", D), ("fare_amount", T.DecimalType(10, 2)),
    ("fare_type", S))

TICKETING_EVENTS = _schema(
    ("event_id", S), ("trip_id", S), ("route_id", S), ("stop_id", S), ("stop_sequence", I),
    ("event_timestamp", NTZ), ("sim_date", DATE), ("sim_hour", I), ("day_of_week", I),
    ("boarding_count", I), ("alighting_count", I), ("ticket_count", I), ("payment_mode", S),
    ("expected_revenue", D), ("reported_revenue", D), ("is_anomalous", I), ("anomaly_id", S))

# Events as they are sent: JSON whose values may be of any type, read as text.
SENT_EVENTS = T.StructType([T.StructField(f.name, S) for f in TICKETING_EVENTS.fields])

# Events with parsed numbers; the timestamp is still text.
RAW_EVENTS = T.StructType(
    [T.StructField(f.name, S if f.name == "event_timestamp" else f.dataType)
     for f in TICKETING_EVENTS.fields])

ANOMALY_GROUND_TRUTH = _schema(
    ("anomaly_id", S), ("anomaly_type", S), ("route_id", S), ("start_stop_id", S),
    ("end_stop_id", S), ("start_stop_sequence", I), ("end_stop_sequence", I),
    ("time_window_start", I), ("time_window_end", I), ("sim_date", DATE), ("severity", D),
    ("magnitude", D), ("description", S))

DETECTED_ANOMALIES = _schema(
    ("detection_id", S), ("anomaly_score", D), ("route_id", S), ("trip_id", S), ("stop_id", S),
    ("stop_sequence", I), ("segment_start_stop", S), ("segment_end_stop", S),
    ("time_window", S), ("sim_date", DATE), ("detection_type", S), ("expected_value", D),
    ("reported_value", D), ("discrepancy", D), ("matched_ground_truth_id", S), ("status", S),
    ("reviewed_by", S), ("reviewed_at", TS), ("notes", S))

FLOW_LOCALIZATION_RESULTS = _schema(
    ("route_id", S), ("sim_date", DATE), ("time_window", S), ("segment_start_stop", S),
    ("segment_end_stop", S), ("segment_start_seq", I), ("segment_end_seq", I),
    ("expected_flow", D), ("reported_flow", D), ("flow_discrepancy", D),
    ("localization_score", D), ("rank_position", I))

ROUTE_LEAKAGE_SCORES = _schema(
    ("route_id", S), ("sim_date", DATE), ("time_window", S), ("expected_revenue", D),
    ("reported_revenue", D), ("leakage_amount", D), ("leakage_percentage", D),
    ("risk_level", S), ("anomaly_count", L))

MODEL_REGISTRY = T.StructType([
    T.StructField("model_id", S), T.StructField("model_type", S), T.StructField("version", L),
    T.StructField("metrics", T.MapType(S, D)), T.StructField("model_path", S),
    T.StructField("is_active", I)])

PIPELINE_METRICS = _schema(
    ("metric_name", S), ("metric_value", D), ("metric_unit", S), ("service", S),
    ("recorded_at", TS))

DEAD_LETTER_EVENTS = _schema(("original_event", S), ("error_message", S), ("error_type", S))

PIPELINE_RUNS = _schema(
    ("run_id", S), ("phase", S), ("status", S), ("time_ms", L), ("stats", S), ("error", S))

TABLES: dict[str, T.StructType] = {
    "stops": STOPS,
    "routes": ROUTES,
    "trips": TRIPS,
    "stop_sequences": STOP_SEQUENCES,
    "fare_slabs": FARE_SLABS,
    "ticketing_events": TICKETING_EVENTS,
    "anomaly_ground_truth": ANOMALY_GROUND_TRUTH,
    "detected_anomalies": DETECTED_ANOMALIES,
    "flow_localization_results": FLOW_LOCALIZATION_RESULTS,
    "route_leakage_scores": ROUTE_LEAKAGE_SCORES,
    "model_registry": MODEL_REGISTRY,
    "pipeline_metrics": PIPELINE_METRICS,
    "dead_letter_events": DEAD_LETTER_EVENTS,
    "pipeline_runs": PIPELINE_RUNS,
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "stops": ["stop_id"],
    "routes": ["route_id"],
    "trips": ["trip_id"],
    "stop_sequences": ["trip_id", "stop_sequence"],
    "fare_slabs": ["min_distance_km", "fare_type"],
    "ticketing_events": ["event_id"],
    "anomaly_ground_truth": ["anomaly_id"],
    "detected_anomalies": ["detection_id"],
    "flow_localization_results": ["route_id", "sim_date", "time_window", "segment_start_seq"],
    "route_leakage_scores": ["route_id", "sim_date", "time_window"],
    "model_registry": ["model_id"],
}

# Tables stored partitioned, so that date filters prune files.
PARTITIONED_BY: dict[str, list[str]] = {
    "ticketing_events": ["sim_date"],
    "detected_anomalies": ["sim_date"],
    "flow_localization_results": ["sim_date"],
    "route_leakage_scores": ["sim_date"],
}

# Fixed values.
PAYMENT_MODES = ["cash", "upi", "card", "pass"]
RISK_LEVELS = ["critical", "high", "medium", "low"]
REVIEW_STATUSES = ["new", "reviewed", "confirmed", "dismissed"]
ANOMALY_TYPES = ["under_reporting", "ghost_trip", "qr_upi_fraud", "fare_evasion_cluster"]
ROUTE_CATEGORY_CODES = {"city-core": 0, "suburban": 1, "feeder": 2, "express": 3, "outer": 4}
UNKNOWN_CATEGORY_CODE = 2
REQUIRED_EVENT_FIELDS = [
    "event_id", "trip_id", "route_id", "stop_id", "event_timestamp",
    "boarding_count", "ticket_count", "expected_revenue", "reported_revenue"]
