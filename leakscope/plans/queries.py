"""Every operator as a named query over a folder of source tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope.functions import demand, geo, text
from leakscope.functions.numeric import from_cents, half_up, sum_money
from leakscope.operators import (detect, evaluate, features, forecast, forest, grid_flow, leakage_score,
                                 localize, nearby, network, ordered, scenario, selection, validation)
from leakscope.plans import jobs, views
from leakscope.session import materialize, scratch_path
from leakscope.sources import tables
from leakscope.sources.testdata import TransitTables
from leakscope.streaming import ingest, scoring
from leakscope.streaming import windows as stream_windows

STANDARD_KEYS = ["route_id", "sim_hour"]


class Analytics(TransitTables):
    """Source tables and the frames most queries start from."""

    @cached_property
    def enriched(self) -> DataFrame:
        return features.enrich(self.events, self.routes, self.stops.drop("route_id", "stop_sequence"))

    @cached_property
    def features(self) -> DataFrame:
        return features.engineer(self.enriched)

    @cached_property
    def learned(self) -> DataFrame:
        """Learned first and stored: its size is then known, so scoring can broadcast it
        instead of shuffling the events."""
        return materialize(detect.baselines(detect.baseline_events(self.events)), "baselines")

    @cached_property
    def detected(self) -> DataFrame:
        """Scored before the dimensions are joined, so that a filter on the score comes before these joins."""
        return detect.detections(features.enrich(
            detect.with_deviation(self.events), self.routes, self.stops.drop("route_id", "stop_sequence")))

    @cached_property
    def records(self) -> DataFrame:
        return detect.anomaly_records(self.detected)

    @cached_property
    def scores(self) -> DataFrame:
        return leakage_score.route_leakage(self.events, "period")

    @cached_property
    def stop_order(self) -> DataFrame:
        return network.route_stop_order(self.stops)

    @cached_property
    def hourly(self) -> DataFrame:
        """Per day, stored, since graphs and segment totals both read it."""
        return materialize(localize.hourly_sums(self.events), "hourly")

    @cached_property
    def yearly(self) -> DataFrame:
        """The same per year, for the queries that list every cell of a grid."""
        return localize.hourly_sums(self.events, "period_year")

    @cached_property
    def segments(self) -> DataFrame:
        return localize.segment_grid(materialize(self.yearly, "yearly"), self.stop_order)

    @cached_property
    def segment_scores(self) -> DataFrame:
        """Segments scored on the discrepancy alone."""
        return localize.score_segments(localize.active_segments(self.hourly, self.stop_order))

    @cached_property
    def localized(self) -> DataFrame:
        return localize.localize(self.events, self.stop_order)

    @cached_property
    def splits(self) -> tuple[DataFrame, DataFrame]:
        last = forecast.last_train_date(self.events)
        return (self.features.filter(F.col("sim_date") <= last),
                self.features.filter(F.col("sim_date") > last))


QUERIES: dict[str, Callable[[Analytics], DataFrame]] = {}


def query(fn: Callable[[Analytics], DataFrame]) -> Callable[[Analytics], DataFrame]:
    """Registers a query; a trailing underscore only keeps a module name free."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def as_text_dates(df: DataFrame) -> DataFrame:
    """Dates and timestamps as ISO text, the form reports hand out."""
    changes = {f.name: F.col(f.name).cast("string") for f in df.schema.fields
               if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))}
    return df.withColumns(changes) if changes else df


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: as_text_dates(fn(Analytics(spark, sf_dir)))

    return {name: bind(fn) for name, fn in QUERIES.items()}


# ---- leakage scores -------------------------------------------------------

@query
def route_leakage(a: Analytics) -> DataFrame:
    return a.scores


@query
def route_leakage_daily(a: Analytics) -> DataFrame:
    return leakage_score.route_leakage(a.events)


@query
def risk_levels(a: Analytics) -> DataFrame:
    return (a.scores.groupBy(F.year("sim_date").alias("year"), "risk_level")
            .agg(F.count("*").alias("route_months"), sum_money("leakage_amount").alias("leakage")))


# ---- tables ---------------------------------------------------------------

@query
def scan_events(a: Analytics) -> DataFrame:
    return tables.select_rows(a.events_with_mode.select(
        "event_id", "trip_id", "route_id", "stop_id", "stop_sequence", "event_timestamp",
        "sim_date", "sim_hour", "day_of_week", "boarding_count", "alighting_count",
        "ticket_count", "payment_mode", "expected_revenue", "reported_revenue", "is_anomalous"))


@query
def upsert_events(a: Analytics) -> DataFrame:
    """Anomalous events are corrected in part; events of closed lines arrive anew."""
    stored = a.events.filter("line_status = 'O'").select(
        "event_id", "route_id", "ticket_count", "expected_revenue", "reported_revenue")
    target = tables.latest_per_key(stored, ["event_id"], F.struct("expected_revenue", "ticket_count"))
    supplied = a.events.filter("is_anomalous = 1 OR line_status = 'F'").select(
        "event_id", F.col("boarding_count").alias("ticket_count"),
        F.col("expected_revenue").alias("reported_revenue"))
    merged = tables.upsert(target, supplied, ["event_id"],
                           F.struct("reported_revenue", "ticket_count"))
    return merged.withColumns({"route_id": F.coalesce("route_id", F.lit("")),
                               "expected_revenue": F.coalesce("expected_revenue", F.lit(-1.0))})


@query
def upsert_stored(a: Analytics) -> DataFrame:
    """A stored table after upserts that move rows to other dates and to none."""
    root = scratch_path(a.spark, "stored")
    columns = ["event_id", "sim_date", "ticket_count", "reported_revenue"]
    rows = a.events.select(*columns)
    first = tables.latest_per_key(rows, ["event_id"], F.struct("reported_revenue", "ticket_count"))
    year = F.trunc("sim_date", "year")
    moved = first.select("event_id", F.when(F.col("ticket_count") % 3 > 0, F.date_add(year, 1)).alias("sim_date"),
                         (F.col("ticket_count") + 1).alias("ticket_count"), "reported_revenue").filter("ticket_count % 2 = 0")
    by_year = first.withColumn("sim_date", year)
    tables.upsert_table(a.spark, root, "ticketing_events", by_year)
    tables.upsert_table(a.spark, root, "ticketing_events", materialize(moved, "moved"))
    return tables.scan(a.spark, root, "ticketing_events").select(
        "event_id", F.coalesce(F.col("sim_date").cast("string"), F.lit("none")).alias("sim_date"), "ticket_count",
        "reported_revenue")


@query
def delete_where(a: Analytics) -> DataFrame:
    kept = tables.delete_where(a.events, (F.col("ticket_count") == 0) | (F.col("sim_hour") >= 23))
    return kept.select("event_id", "ticket_count", "sim_hour")


@query
def assign_ids(a: Analytics) -> DataFrame:
    return tables.assign_ids(a.events.select("sim_date", "event_id", "trip_id"),
                             ["sim_date", "event_id"], start_after=1000)


@query
def latest_models(a: Analytics) -> DataFrame:
    return views.latest_models(a.model_registry).withColumn(
        "mean_revenue", half_up("mean_revenue", 6))


@query
def active_models(a: Analytics) -> DataFrame:
    return views.active_models(a.model_registry).withColumn(
        "mean_revenue", half_up("mean_revenue", 6))


# ---- filters --------------------------------------------------------------

@query
def filter_eq(a: Analytics) -> DataFrame:
    return a.events_with_mode.filter(F.col("payment_mode") == "upi").select(
        "event_id", "payment_mode", "expected_revenue")


@query
def filter_range(a: Analytics) -> DataFrame:
    return a.events.filter(
        (F.col("sim_date") >= F.lit("1997-03-01").cast("date"))
        & (F.col("sim_date") < F.lit("1998-03-01").cast("date"))
        & (F.col("sim_hour") <= 12)).select("event_id", "sim_date", "sim_hour")


@query
def filter_in(a: Analytics) -> DataFrame:
    return a.events_with_mode.filter(F.col("payment_mode").isin("card", "pass")).select(
        "event_id", "payment_mode")


@query
def filter_notnull(a: Analytics) -> DataFrame:
    return a.events.filter(F.col("anomaly_id").isNotNull()).select("event_id", "anomaly_id")


@query
def filter_dynamic(a: Analytics) -> DataFrame:
    given = {"is_anomalous": 1, "payment_mode": "cash", "day_of_week": None}
    chosen = views.all_of([None if v is None else F.col(c) == v for c, v in given.items()])
    return a.events_with_mode.filter(chosen).select("event_id", "payment_mode", "day_of_week")


# ---- joins ----------------------------------------------------------------

@query
def enrich_events(a: Analytics) -> DataFrame:
    return a.enriched.select("event_id", "route_id", "stop_id", "route_category", "boarding_density")


@query
def routes_overview(a: Analytics) -> DataFrame:
    return views.routes_overview(a.routes.drop("trips_per_day", "bearing_deg"), a.scores, a.records)


@query
def route_search(a: Analytics) -> DataFrame:
    overview = views.routes_overview(a.routes, a.scores, a.records)
    return views.route_search(overview, "MARKET", "low").select(
        "route_id", "route_short_name", "route_long_name", "latest_risk")


@query
def fare_lookup(a: Analytics) -> DataFrame:
    away = a.stops.select("stop_id", (F.col("distance_from_start_km") * 3.0 - 2.0).alias("distance_km"))
    travelled = a.events.select("event_id", "stop_id").join(away, "stop_id")
    return demand.join_fares(travelled, a.fare_slabs).select("event_id", "distance_km", "fare")


@query
def match_anomalies(a: Analytics) -> DataFrame:
    matched = scenario.match_anomalies(a.events, a.truth, "period_year")
    return matched.filter(F.col("matched_anomaly_id").isNotNull()).select(
        "event_id", "matched_anomaly_id", "matched_type", "matched_severity")


@query
def segment_stats(a: Analytics) -> DataFrame:
    """Per day, as the engine localizes by default."""
    stats = localize.segment_stats(localize.hourly_sums(a.events), a.stop_order)
    return stats.select("route_id", "sim_date", "window_index", "segment_index", "boardings", "tickets",
                        from_cents("expected").alias("expected_revenue"),
                        from_cents("reported").alias("reported_revenue"))


@query
def segment_grid(a: Analytics) -> DataFrame:
    return a.segments.select("route_id", "sim_date", "window_index", "segment_index",
                             "segment_start_stop", "segment_end_stop", "boardings", "tickets",
                             from_cents("expected").alias("expected_revenue"),
                             from_cents("reported").alias("reported_revenue"))


@query
def nearby_stops(a: Analytics) -> DataFrame:
    first = a.stops.filter("stop_sequence = 1").select(
        "route_id", F.col("stop_lat").alias("start_lat"), F.col("stop_lon").alias("start_lon"))
    starts = first.join(a.routes.select("route_id", "bearing_deg", F.col("num_stops").alias("wanted")),
                        "route_id")
    return nearby.nearest_along_bearing(starts, a.stops).select(
        "route_id", "stop_id", half_up("score", 6).alias("score"), "rank_position")


@query
def demand_model(a: Analytics) -> DataFrame:
    joined = a.enriched
    return joined.select(
        "event_id",
        demand.base_ridership("route_category").alias("base"),
        demand.hour_factor("sim_hour").alias("hour_factor"),
        demand.day_factor("day_of_week").alias("day_factor"),
        demand.expected_demand(F.col("route_category"), F.col("sim_hour"), F.col("day_of_week"),
                               F.col("boarding_density")).alias("expected_demand"))


@query
def stop_times(a: Analytics) -> DataFrame:
    return network.stop_times(a.routes, a.stops)


@query
def trips(a: Analytics) -> DataFrame:
    return network.trips(a.routes).drop("route_category", "start_minute")


@query
def baseline_scores(a: Analytics) -> DataFrame:
    return detect.score_against(a.events, a.learned).select(
        "event_id", "z_score", "baseline_score", "is_anomaly")


# ---- aggregations ---------------------------------------------------------

@query
def count_events(a: Analytics) -> DataFrame:
    return a.events.filter("is_anomalous = 1").agg(F.count("*").alias("cnt"))


@query
def sum_revenue(a: Analytics) -> DataFrame:
    none = a.events.filter("sim_hour > 23").agg(sum_money("expected_revenue"))
    return a.events.agg(sum_money("expected_revenue").alias("expected"),
                        sum_money("reported_revenue").alias("reported")
                        ).withColumn("nothing", none.scalar())


@query
def conditional_count(a: Analytics) -> DataFrame:
    return a.events.agg(
        F.sum(F.when(F.col("is_anomalous") == 1, 1).otherwise(0)).alias("anomalous"),
        F.count_if(F.col("sim_hour") >= 20).alias("late"))


@query
def distinct_counts(a: Analytics) -> DataFrame:
    return a.events.agg(F.count_distinct("sim_date").alias("dates"),
                        F.count_distinct("route_id").alias("routes"),
                        F.count_distinct("trip_id").alias("trips"))


@query
def distinct_dates(a: Analytics) -> DataFrame:
    return a.events.select("sim_date").distinct()


@query
def global_agg(a: Analytics) -> DataFrame:
    named = {"events": F.count("*"), "boardings": F.sum("boarding_count"),
             "first_date": F.min("sim_date"), "last_date": F.max("sim_date"),
             "revenue": sum_money("expected_revenue")}
    return a.events.agg(*[fn.alias(name) for name, fn in named.items()])


@query
def group_agg(a: Analytics) -> DataFrame:
    named = {"events": F.count("*"), "tickets": F.sum("ticket_count"),
             "most_boarded": F.max("boarding_count"), "revenue": sum_money("reported_revenue")}
    return a.events_with_mode.groupBy("payment_mode").agg(
        *[fn.alias(name) for name, fn in named.items()])


@query
def route_timeseries(a: Analytics) -> DataFrame:
    return views.route_timeseries(a.events)


@query
def timeseries_rollup(a: Analytics) -> DataFrame:
    rolled = views.timeseries_rollup(views.route_timeseries(a.events))
    return rolled.withColumns({
        "sim_date": F.coalesce(F.col("sim_date").cast("string"), F.lit("all")),
        "sim_hour": F.coalesce("sim_hour", F.lit(-1))})


@query
def route_stop_order(a: Analytics) -> DataFrame:
    return network.route_stop_order(network.stop_times(a.routes, a.stops))


@query
def baselines(a: Analytics) -> DataFrame:
    return detect.baselines(a.events, STANDARD_KEYS)


@query
def variance_by_key(a: Analytics) -> DataFrame:
    x = F.col("boarding_count")
    return a.events.groupBy("route_id", "day_of_week").agg(
        half_up(F.coalesce(F.var_pop(x), F.lit(0.0)), 6).alias("variance"),
        F.count("*").alias("n"))


@query
def regression_metrics(a: Analytics) -> DataFrame:
    """Fit of the seasonal mean as a revenue forecast."""
    mean = detect.baselines(a.events, STANDARD_KEYS).select(*STANDARD_KEYS, "mean")
    fitted = a.events.join(mean, STANDARD_KEYS)
    return evaluate.regression_metrics(fitted, "expected_revenue", "mean").select(
        *[half_up(c, 4).alias(c) for c in ("mean_predicted", "mse", "rmse", "mae")], "n")


@query
def detection_quality(a: Analytics) -> DataFrame:
    return evaluate.detection_quality(a.detected, F.col("is_ground_truth_anomaly") == 1,
                                      F.col("is_flagged"))


@query
def anomaly_by_type(a: Analytics) -> DataFrame:
    return views.count_by(a.records, "detection_type")


@query
def truth_by_type(a: Analytics) -> DataFrame:
    return views.count_by(a.truth, "anomaly_type")


@query
def risk_distribution(a: Analytics) -> DataFrame:
    return views.risk_distribution(a.scores)


@query
def score_threshold(a: Analytics) -> DataFrame:
    return selection.threshold_of_rounded(a.detected, "anomaly_score", forest.CONTAMINATION)


@query
def run_totals(a: Analytics) -> DataFrame:
    return a.detected.agg(F.count("*").alias("events"), F.count_if("is_flagged").alias("detections"),
                          F.count_distinct("sim_date").alias("days"))


@query
def anomaly_magnitude(a: Analytics) -> DataFrame:
    return scenario.magnitudes(a.events)


@query
def trip_days(a: Analytics) -> DataFrame:
    return network.trip_days(network.trips(a.routes),
                             a.events.agg(F.count_distinct("sim_date")))


@query
def value_ranges(a: Analytics) -> DataFrame:
    names = ["hour", "boarding_density", "stop_sequence", "revenue_ratio", "ticket_ratio"]
    chart = F.max(F.greatest("expected_revenue", "reported_revenue")).alias("chart_max")
    return a.features.agg(
        *[fn(c).cast("double").alias(f"{fn.__name__}_{c}") for c in names for fn in (F.min, F.max)], chart)


# ---- ordering and windows -------------------------------------------------

@query
def topk_segments(a: Analytics) -> DataFrame:
    return localize.top_segments(a.segment_scores, 5).drop("expected_flow", "reported_flow")


@query
def cumulative_distance(a: Analytics) -> DataFrame:
    return network.cumulative_distance(a.stops)


@query
def onboard_load(a: Analytics) -> DataFrame:
    return network.onboard_load(a.events)


@query
def route_segments(a: Analytics) -> DataFrame:
    return network.route_segments(a.stop_order)


@query
def partition_offsets(a: Analytics) -> DataFrame:
    placed = a.routes.select("route_id", text.stream_partition("route_id").alias("partition"))
    arrived = a.events.select("event_id", "route_id", "event_timestamp").join(placed, "route_id")
    return ordered.index_in_groups(arrived, "partition", ["event_timestamp", "event_id"]).select(
        "event_id", "partition", "offset")


@query
def event_hour(a: Analytics) -> DataFrame:
    return network.event_hours(a.events, a.routes)


@query
def route_names(a: Analytics) -> DataFrame:
    return network.route_names(a.stops)


@query
def recent_metrics(a: Analytics) -> DataFrame:
    return views.recent_metrics(views.metrics_long(a.batches)).withColumn(
        "metric_value", half_up("metric_value", 6))


@query
def metrics_long(a: Analytics) -> DataFrame:
    return views.metrics_long(a.batches).withColumn("metric_value", half_up("metric_value", 6))


@query
def ewma_metric(a: Analytics) -> DataFrame:
    return views.ewma(views.metrics_long(a.batches), "metric_name", "recorded_at",
                      "metric_value").withColumn("ewma", half_up("ewma", 6))


@query
def weighted_bucket(a: Analytics) -> DataFrame:
    u = ((F.col("boarding_count") * 37 + F.col("sim_hour") * 11 + F.col("stop_sequence") * 5) % 100
         ) / 100.0
    return a.events.withColumn("u", u).select(
        "event_id", "u", demand.payment_mode("u").alias("payment_mode"),
        demand.weighted_bucket("u", demand.ROUTE_CATEGORY_WEIGHTS).alias("route_category"),
        demand.weighted_bucket("u", demand.ANOMALY_TYPE_WEIGHTS).alias("anomaly_type"))


@query
def leakage_trend(a: Analytics) -> DataFrame:
    return views.leakage_trend(a.scores)


@query
def baseline_sample(a: Analytics) -> DataFrame:
    return detect.baseline_events(a.events, sample=50000).select("event_id", "expected_revenue")


@query
def recent_dates(a: Analytics) -> DataFrame:
    return views.recent_dates(a.events)


@query
def time_split(a: Analytics) -> DataFrame:
    return forecast.split_dates(a.events)


# ---- row rules ------------------------------------------------------------

@query
def validated_events(a: Analytics) -> DataFrame:
    return validation.validate(a.raw_events).select(
        "event_id", "valid", F.array_join("errors", "; ").alias("errors"))


@query
def ingest_counts(a: Analytics) -> DataFrame:
    return validation.ingest_counts(validation.validate(a.raw_events))


@query
def dead_letters(a: Analytics) -> DataFrame:
    return validation.dead_letters(validation.validate(a.raw_events)).drop("original_event")


@query
def features_(a: Analytics) -> DataFrame:
    waves = ["hour_sin", "hour_cos", "dow_sin", "dow_cos"]
    return a.features.drop("anomaly_id").withColumns({c: half_up(c, 6) for c in waves})


@query
def haversine(a: Analytics) -> DataFrame:
    by_route = W.partitionBy("route_id").orderBy("stop_sequence")
    lat, lon = F.col("stop_lat"), F.col("stop_lon")
    km = geo.haversine_km(F.lag(lat).over(by_route), F.lag(lon).over(by_route), lat, lon)
    return (a.stops.select("stop_id", half_up(km, 6).alias("km_from_previous"))
            .filter(F.col("km_from_previous").isNotNull()))


@query
def destination_point(a: Analytics) -> DataFrame:
    joined = a.stops.join(a.routes.select("route_id", "total_distance_km", "bearing_deg"), "route_id")
    lat, lon = geo.destination(F.col("stop_lat"), F.col("stop_lon"), F.col("total_distance_km"),
                               F.col("bearing_deg"))
    return joined.select("stop_id", half_up(lat, 6).alias("lat"), half_up(lon, 6).alias("lon"))


@query
def stop_classes(a: Analytics) -> DataFrame:
    return network.stop_classes(a.stops)


@query
def window_labels(a: Analytics) -> DataFrame:
    return a.events.select(
        "event_id", text.window_label(F.col("sim_hour"), F.col("sim_hour") + 1).alias("time_window"),
        text.iso_timestamp(F.col("sim_date"), F.col("sim_hour"), F.minute("event_timestamp"))
        .alias("iso_timestamp"))


@query
def headsigns(a: Analytics) -> DataFrame:
    return a.routes.select(
        "route_id", text.headsign("route_long_name", "route_short_name").alias("trip_headsign"),
        F.substring("route_long_name", 1, 10).alias("short_label"))


@query
def json_props(a: Analytics) -> DataFrame:
    parsed = F.from_json("props", "k BIGINT")
    return a.table("events").select(
        "event_id", parsed.k.alias("k"),
        F.get_json_object("props", "$.k").alias("k_text"),
        F.to_json(F.struct(parsed.k.alias("k"))).alias("encoded"))


@query
def currency_labels(a: Analytics) -> DataFrame:
    return a.scores.groupBy("route_id").agg(sum_money("expected_revenue").alias("expected")).select(
        "route_id", "expected", text.currency_label("expected").alias("label"))


@query
def calendar(a: Analytics) -> DataFrame:
    span = a.events.agg(F.min("sim_date").alias("first"), F.max("sim_date").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("day"))
    weekday = (F.dayofweek("day") - 1).cast("int")
    return days.select("day", weekday.alias("day_of_week"),
                       weekday.isin(0, 6).cast("int").alias("is_weekend"))


@query
def route_partition(a: Analytics) -> DataFrame:
    return a.routes.select("route_id", text.stream_partition("route_id").alias("partition"))


@query
def apply_anomaly(a: Analytics) -> DataFrame:
    matched = scenario.match_anomalies(a.events_with_mode, a.truth, "period_year")
    return scenario.apply_anomalies(matched).select(
        "event_id", "boarding_count", "ticket_count", "expected_revenue", "reported_revenue",
        "is_anomalous", F.coalesce("anomaly_id", F.lit("")).alias("anomaly_id"))


@query
def scenario_magnitude(a: Analytics) -> DataFrame:
    matched = scenario.match_anomalies(a.events_with_mode, a.truth, "period_year")
    changed = scenario.apply_anomalies(matched)
    return scenario.with_magnitudes(a.truth, changed).select("anomaly_id", "anomaly_type", "magnitude")


# ---- detection ------------------------------------------------------------

@query
def detections(a: Analytics) -> DataFrame:
    return a.detected.withColumn("anomaly_id", F.coalesce("anomaly_id", F.lit("")))


@query
def flagged_events(a: Analytics) -> DataFrame:
    return detect.flagged(a.detected).select("event_id", "anomaly_score", "discrepancy")


@query
def detected_anomalies(a: Analytics) -> DataFrame:
    return a.records.withColumn("matched_ground_truth_id",
                                F.coalesce("matched_ground_truth_id", F.lit("")))


@query
def detect_route(a: Analytics) -> DataFrame:
    return views.detect_route(a.detected, looked_at=a.enriched).select("event_id", "route_id", "sim_date", "anomaly_score", "total")


@query
def severity_bands(a: Analytics) -> DataFrame:
    return a.records.select("detection_id", "anomaly_score",
                            views.severity_band(F.col("anomaly_score")).alias("band"))


@query
def segment_bands(a: Analytics) -> DataFrame:
    return a.segment_scores.select(
        "route_id", "sim_date", "time_window", "segment_start_seq",
        views.segment_band(F.col("localization_score")).alias("band"),
        (F.col("rank_position") <= 3).alias("top_three"))


@query
def anomaly_queue(a: Analytics) -> DataFrame:
    return views.anomaly_queue(a.records, status="new", min_score=0.5, offset=50).select(
        "detection_id", "anomaly_score", "route_id", "sim_date", "status")


@query
def anomaly_queue_by_date(a: Analytics) -> DataFrame:
    return views.anomaly_queue(a.records, sort_by="date").select(
        "detection_id", "anomaly_score", "route_id", "sim_date", "status")


@query
def anomaly_queue_total(a: Analytics) -> DataFrame:
    return views.anomaly_queue_total(a.records, status="new", min_score=0.5)


def _reviews(records: DataFrame) -> DataFrame:
    s = F.col("anomaly_score")
    status = (F.when(s >= 0.8, "confirmed").when(s >= 0.6, "reviewed").when(s < 0.32, "escalated"))
    return records.select(
        "detection_id", status.alias("status"), F.lit("auditor").alias("reviewed_by"),
        F.concat(F.lit("score "), F.floor(s * 100).cast("string")).alias("notes")
    ).filter(F.col("status").isNotNull())


@query
def review_update(a: Analytics) -> DataFrame:
    # both sides of the join are these rows, so they are stored once
    records = materialize(a.records.select("detection_id", "anomaly_score", "status"), "records")
    updated = views.review_update(records, _reviews(records))
    return updated.select("detection_id", "anomaly_score", "status",
                          F.coalesce("reviewed_by", F.lit("")).alias("reviewed_by"),
                          F.coalesce("notes", F.lit("")).alias("notes"))


@query
def review_rejected(a: Analytics) -> DataFrame:
    return views.review_decisions(_reviews(a.records))[1].select("detection_id", "status", "error")


# ---- localization ---------------------------------------------------------

@query
def network_edges(a: Analytics) -> DataFrame:
    grid = localize.stop_grid(materialize(a.yearly, "yearly"), a.stop_order)
    return localize.network_edges(grid, len(localize.HOURLY_WINDOWS))


@query
def flow_totals(a: Analytics) -> DataFrame:
    solved = localize.grid_flows(localize.hourly_sums(a.events), a.stop_order)
    return solved.select("route_id", "sim_date", "total_flow", "total_cost")


@query
def flow_checks(a: Analytics) -> DataFrame:
    """Every graph's certificate of being a cheapest maximum flow."""
    solved = localize.grid_flows(localize.hourly_sums(a.events), a.stop_order, proof=True)
    return grid_flow.certificate(solved, localize.KEYS, len(localize.HOURLY_WINDOWS), localize.CARRY_CAPACITY,
                                 localize.CARRY_COST)


@query
def localization(a: Analytics) -> DataFrame:
    return a.localized


@query
def localization_rank(a: Analytics) -> DataFrame:
    return localize.top_segments(a.localized, 10).select(
        "route_id", "sim_date", "time_window", "segment_start_seq", "localization_score",
        "rank_position")


@query
def localization_hits(a: Analytics) -> DataFrame:
    return localize.localization_hits(a.localized, a.truth_days)


@query
def localization_accuracy(a: Analytics) -> DataFrame:
    """Share of the labelled anomalies found, day by day, in place and time."""
    hits = localize.localization_hits(a.localized, a.truth_days, match_time=True)
    return localize.localization_accuracy(hits, by="sim_date")


@query
def segment_hits(a: Analytics) -> DataFrame:
    """Hit test on the discrepancy score."""
    return localize.localization_hits(a.segment_scores, a.truth_days)


@query
def localization_view(a: Analytics) -> DataFrame:
    located = a.segment_scores.drop("expected_flow", "reported_flow", "time_window_start",
                                    "time_window_end")
    return views.localization_view(located, a.stops, segments=None)


@query
def anomaly_detail(a: Analytics) -> DataFrame:
    """Detections with the segments of their own day; rank 0 where the day has none."""
    return views.anomaly_detail(a.records, a.segment_scores, segments=None).select(
        "detection_id", "route_id", "sim_date", "anomaly_score", "segment_window", "located_start",
        "located_end", "localization_score", F.coalesce("rank_position", F.lit(0)).alias("rank_position"))


# ---- reports --------------------------------------------------------------

@query
def route_detail_stops(a: Analytics) -> DataFrame:
    return views.route_detail_stops(a.stop_order, a.stops)


@query
def route_detail_scores(a: Analytics) -> DataFrame:
    return views.route_detail_scores(a.scores)


@query
def summary_kpis(a: Analytics) -> DataFrame:
    return views.summary_kpis(a.routes, a.records, a.events)


@query
def recent_anomalies(a: Analytics) -> DataFrame:
    return views.recent_anomalies(a.records, a.routes).select(
        "detection_id", "route_id", "route_short_name", "anomaly_score", "discrepancy", "sim_date")


@query
def hourly_windows(a: Analytics) -> DataFrame:
    return stream_windows.hourly_leakage(a.events)


# ---- streams: all that is there, in micro-batches ------------------------

@query
def stream_dead_letters(a: Analytics) -> DataFrame:
    letters = validation.dead_letters(validation.validate(a.raw_event_stream))
    return ingest.drain(letters.drop("original_event"), "dead-letters")


@query
def stream_flagged_events(a: Analytics) -> DataFrame:
    scored = scoring.score_stream(a.event_stream, a.routes, a.stops.drop("route_id", "stop_sequence"),
                                  a.learned)
    return ingest.drain(detect.flagged(scored).select("event_id", "anomaly_score", "discrepancy"),
                        "flagged")


@query
def stream_hourly_windows(a: Analytics) -> DataFrame:
    return ingest.drain_latest(stream_windows.hourly_leakage(a.event_stream), ["route_id", "window_start"], "hourly")


@query
def stream_onboard_load(a: Analytics) -> DataFrame:
    """Stops of a trip arrive in any order, over several micro-batches; the state is a pair of sums per stop."""
    arriving = ingest.shuffled_arrivals(a.events, "event_id")
    return network.load_along(ingest.drain_latest(
        network.stop_sums(arriving), ["trip_id", "stop_sequence"], "onboard"))


@query
def stream_late_windows(a: Analytics) -> DataFrame:
    """Hours of a stream out of order, corrected by the rows that came after their hour had closed."""
    hours = stream_windows.ClosingHours(scratch_path(a.spark, "closing"))
    arriving = ingest.shuffled_arrivals(a.events, "event_id")
    hours.start(arriving, f"{hours.root}-progress", once=True).awaitTermination()
    return hours.reconciled(a.spark, a.events.schema)


# ---- models ---------------------------------------------------------------

def _forecast(a: Analytics, target: str) -> DataFrame:
    train, test = a.splits
    model = forecast.fit_boosted_trees(forecast.training_cells(train, [target]), target)
    return forecast.predict(model, test).select(
        "event_id", F.col(target).cast("double").alias("actual"), "predicted")


@query
def forecast_(a: Analytics) -> DataFrame:
    return _forecast(a, "boarding_count")


@query
def forecast_revenue(a: Analytics) -> DataFrame:
    return _forecast(a, "expected_revenue")


@query
def forest_trees(a: Analytics) -> DataFrame:
    train, _ = a.splits
    return forest.fit_forest(train.filter("is_anomalous = 0"))


@query
def forest_scores(a: Analytics) -> DataFrame:
    train, test = a.splits
    nodes = forest.fit_forest(train.filter("is_anomalous = 0"))
    return forest.score_forest(test, nodes).select("event_id", "is_anomalous", "forest_score")


@query
def training_report(a: Analytics) -> DataFrame:
    report = jobs.train(a.spark, a.events, a.routes, a.stops.drop("route_id", "stop_sequence"))
    quality = report["anomaly"]
    row = (report["train_samples"], report["test_samples"], report["forecast"]["rmse"],
           report["forecast"]["mae"], quality["precision"], quality["recall"], quality["f1"])
    return a.spark.createDataFrame(
        [row], "train_samples bigint, test_samples bigint, rmse double, mae double, precision double, "
               "recall double, f1 double")
