"""Reporting views: one DataFrame each.

Views take an optional route or date.  Without one they answer for all routes
at once, which is one job instead of one query per route.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.functions.numeric import cents, from_cents, half_up, sum_money
from leakscope.operators.ordered import index_in_groups

# Fixed values.
PAGE_SIZE = 50
SCORES_PER_ROUTE = 30
TREND_DAYS = 30
SEGMENTS_PER_DETAIL = 20
SEGMENTS_PER_ROUTE = 50
TOP_ANOMALIES = 10
RECENT_METRICS = 100
RECENT_DEAD_LETTERS = 10
KPI_DAYS = 7


def all_of(predicates: list[Column | None]) -> Column:
    """AND of the predicates that are given; true for none."""
    return reduce(lambda a, b: a & b, [p for p in predicates if p is not None], F.lit(True))


def _equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == value


def risk_rows(scores: DataFrame) -> DataFrame:
    """Newest risk, percentage and amount of every route, in one aggregation."""
    newest = F.max_by(F.struct("risk_level", "leakage_percentage", "leakage_amount"), "sim_date")
    return scores.groupBy("route_id").agg(newest.alias("_s")).select(
        "route_id", F.col("_s.risk_level").alias("latest_risk"),
        F.col("_s.leakage_percentage").alias("latest_leakage_pct"),
        F.col("_s.leakage_amount").alias("latest_leakage_amount"))


def routes_overview(routes: DataFrame, scores: DataFrame, records: DataFrame) -> DataFrame:
    pending = (records.filter("status = 'new'").groupBy("route_id")
               .agg(F.count("*").alias("pending_anomalies")))
    return (routes.join(risk_rows(scores), "route_id", "left").join(pending, "route_id", "left")
            .withColumn("pending_anomalies", F.coalesce("pending_anomalies", F.lit(0).cast("bigint")))
            .orderBy("route_id"))


def route_search(overview: DataFrame, search: str | None = None, risk: str | None = None) -> DataFrame:
    """Routes whose id or name holds the text, at a risk level; unscored routes count as low."""
    found = None
    if search:
        wanted = F.lower(F.lit(search))
        found = reduce(lambda a, b: a | b, [
            F.contains(F.lower(c), wanted)
            for c in ("route_id", "route_short_name", "route_long_name")])
    level = None if risk is None else F.coalesce("latest_risk", F.lit("low")) == risk
    return overview.filter(all_of([found, level]))


def route_detail_stops(stop_order: DataFrame, stops: DataFrame, route_id: str | None = None) -> DataFrame:
    named = stops.select("stop_id", "stop_name", "stop_lat", "stop_lon", "boarding_density")
    return stop_order.filter(all_of([_equals("route_id", route_id)])).join(named, "stop_id")


def route_detail_scores(scores: DataFrame, route_id: str | None = None,
                        newest: int = SCORES_PER_ROUTE) -> DataFrame:
    by_date = W.partitionBy("route_id").orderBy(F.desc("sim_date"))
    return (scores.filter(all_of([_equals("route_id", route_id)]))
            .withColumn("_n", F.row_number().over(by_date)).filter(F.col("_n") <= newest).drop("_n"))


def route_timeseries(events: DataFrame, route_id: str | None = None, start=None, end=None,
                     date_col: str = "sim_date") -> DataFrame:
    chosen = events.filter(all_of([
        _equals("route_id", route_id),
        None if start is None else F.col(date_col) >= start,
        None if end is None else F.col(date_col) <= end]))
    return chosen.groupBy("route_id", F.col(date_col).alias("sim_date"), "sim_hour").agg(
        sum_money("expected_revenue").alias("expected_revenue"),
        sum_money("reported_revenue").alias("reported_revenue"),
        F.sum("boarding_count").alias("total_boardings"),
        F.sum("ticket_count").alias("total_tickets"),
        F.sum(F.when(F.col("is_anomalous") == 1, 1).otherwise(0)).alias("anomaly_events"))


def timeseries_rollup(series: DataFrame) -> DataFrame:
    """Hourly rows with daily and overall totals per route; ``level`` tells them apart."""
    gap = F.sum(cents("expected_revenue") - cents("reported_revenue"))
    rolled = series.rollup("route_id", "sim_date", "sim_hour").agg(
        sum_money("expected_revenue").alias("expected"),
        sum_money("reported_revenue").alias("reported"),
        from_cents(gap).alias("leakage"),
        F.sum("total_boardings").alias("boardings"), F.sum("total_tickets").alias("tickets"),
        F.sum("anomaly_events").alias("anomalies"), F.grouping_id().alias("_level"))
    level = (F.when(F.col("_level") == 0, "hour").when(F.col("_level") == 1, "day")
             .when(F.col("_level") == 3, "route"))
    return rolled.withColumn("level", level).filter(F.col("level").isNotNull()).drop("_level")


def anomaly_queue(records: DataFrame, status: str | None = None, route_id: str | None = None,
                  min_score: float | None = None, sort_by: str = "score",
                  limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    order = [F.desc("sim_date")] if sort_by == "date" else [F.desc("anomaly_score")]
    return (_queued(records, status, route_id, min_score)
            .orderBy(*order, "detection_id").offset(offset).limit(limit))


def anomaly_queue_total(records: DataFrame, status: str | None = None, route_id: str | None = None,
                        min_score: float | None = None) -> DataFrame:
    return _queued(records, status, route_id, min_score).agg(F.count("*").alias("total"))


def _queued(records, status, route_id, min_score) -> DataFrame:
    return records.filter(all_of([
        _equals("status", status), _equals("route_id", route_id),
        None if min_score is None else F.col("anomaly_score") >= min_score]))


def anomaly_detail(records: DataFrame, localized: DataFrame, detection_id: str | None = None,
                   segments: int | None = SEGMENTS_PER_DETAIL) -> DataFrame:
    """Detections, or one of them, with the best segments of their route and day."""
    records = records.filter(all_of([_equals("detection_id", detection_id)]))
    within = None if segments is None else F.col("rank_position") <= segments
    top = localized.filter(all_of([within])).select(
        "route_id", "sim_date", F.col("time_window").alias("segment_window"),
        F.col("segment_start_stop").alias("located_start"),
        F.col("segment_end_stop").alias("located_end"), "localization_score", "rank_position")
    return records.join(top, ["route_id", "sim_date"], "left")


def review_decisions(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted reviews, and rejected ones with the reason."""
    known = F.coalesce(F.col("status").isin(schemas.REVIEW_STATUSES), F.lit(False))
    reason = F.lit(f"Invalid status. Must be one of: {', '.join(schemas.REVIEW_STATUSES)}")
    return reviews.filter(known), reviews.filter(~known).withColumn("error", reason)


def review_update(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """Records with the status, reviewer and notes of the accepted reviews."""
    accepted, _ = review_decisions(reviews)
    r = accepted.select("detection_id", F.col("status").alias("_status"), "reviewed_by", "notes")
    return (records.join(r, "detection_id", "left")
            .withColumn("status", F.coalesce("_status", "status")).drop("_status"))


def localization_view(localized: DataFrame, stops: DataFrame, route_id: str | None = None,
                      sim_date=None, segments: int | None = SEGMENTS_PER_ROUTE) -> DataFrame:
    """Best segments with names and places: of the given date, else each route's newest."""
    chosen = localized.filter(all_of([_equals("route_id", route_id), _equals("sim_date", sim_date)]))
    if sim_date is None:
        newest = chosen.groupBy("route_id").agg(F.max("sim_date").alias("sim_date"))
        chosen = chosen.join(newest, ["route_id", "sim_date"], "left_semi")
    chosen = chosen.filter(all_of([None if segments is None else F.col("rank_position") <= segments]))

    def end(prefix: str) -> DataFrame:
        return stops.select(
            F.col("stop_id").alias(f"_{prefix}"), F.col("stop_name").alias(f"{prefix}_stop_name"),
            F.col("stop_lat").alias(f"{prefix}_lat"), F.col("stop_lon").alias(f"{prefix}_lon"))

    return (chosen
            .join(end("start"), F.col("segment_start_stop") == F.col("_start"), "left")
            .join(end("end"), F.col("segment_end_stop") == F.col("_end"), "left")
            .drop("_start", "_end"))


def summary_kpis(routes: DataFrame, records: DataFrame, events: DataFrame, as_of: Column | None = None
                 ) -> DataFrame:
    """Headline figures of the last seven days up to ``as_of`` (default: newest date)."""
    until = events.agg(F.max("sim_date")).scalar() if as_of is None else as_of
    recent = events.filter(F.col("sim_date") >= F.date_sub(until, KPI_DAYS))
    sums = recent.agg(
        F.coalesce(F.sum(cents("expected_revenue")), F.lit(0)).alias("_e"),
        F.coalesce(F.sum(cents("reported_revenue")), F.lit(0)).alias("_r"),
        F.count_distinct("sim_date").alias("days_covered"),
        F.count_distinct("route_id").alias("routes_with_data"))
    return sums.select(
        routes.agg(F.count("*")).scalar().alias("total_routes"),
        records.filter("status = 'new'").agg(F.count("*")).scalar().alias("pending_anomalies"),
        from_cents("_e").alias("total_expected"), from_cents("_r").alias("total_reported"),
        from_cents(F.col("_e") - F.col("_r")).alias("total_leakage"),
        "days_covered", "routes_with_data",
        F.when(F.col("_e") > 0, half_up(F.col("_r").cast("double") / F.col("_e").cast("double")
                                        * 100.0, 1)).alias("collection_rate"))


def risk_distribution(scores: DataFrame) -> DataFrame:
    """Routes per risk level on the newest date, levels without routes included."""
    newest = scores.agg(F.max("sim_date")).scalar()
    counts = scores.filter(F.col("sim_date") == newest).agg(
        *[F.count_if(F.col("risk_level") == level).alias(level) for level in schemas.RISK_LEVELS])
    total = reduce(lambda a, b: a + b, [F.col(level) for level in schemas.RISK_LEVELS])
    rows = counts.withColumn("_total", total).unpivot(
        ["_total"], schemas.RISK_LEVELS, "risk_level", "routes")
    share = F.coalesce(F.try_divide(F.col("routes").cast("double"), F.col("_total")), F.lit(0.0))
    return rows.select("risk_level", "routes", half_up(share * 100.0, 0).alias("percentage"))


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("cnt"))


def recent_anomalies(records: DataFrame, routes: DataFrame, n: int = TOP_ANOMALIES) -> DataFrame:
    """Highest scores first; the names join after the cut."""
    top = records.orderBy(F.desc("anomaly_score"), "detection_id").limit(n)
    return top.join(routes.select("route_id", "route_short_name"), "route_id", "left")


def leakage_trend(scores: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """Totals of the newest days, oldest first."""
    per_day = scores.groupBy("sim_date").agg(
        sum_money("expected_revenue").alias("expected"),
        sum_money("reported_revenue").alias("reported"),
        sum_money("leakage_amount").alias("leakage"))
    return per_day.orderBy(F.desc("sim_date")).limit(days).orderBy("sim_date")


def metrics_long(batches: DataFrame) -> DataFrame:
    """Five named figures per batch, one row each."""
    units = F.when(F.col("metric_name") == "avg_processing_time", "ms").otherwise("count")
    return batches.unpivot(
        ["recorded_at"],
        ["ingestion_total", "processing_total", "dead_letter_total", "pending_events",
         "avg_processing_time"], "metric_name", "metric_value"
    ).withColumn("metric_unit", units).withColumn("service", F.lit("ingestion"))


def recent_metrics(metrics: DataFrame, n: int = RECENT_METRICS) -> DataFrame:
    return metrics.orderBy(F.desc("recorded_at"), "metric_name").limit(n)


def ewma(series: DataFrame, key: str, order: str, value: str, decay: float = 0.9) -> DataFrame:
    """Running mean m <- decay*m + (1-decay)*x from 0, at its last value per key.

    Unrolled, the k-th newest value has weight (1-decay)*decay^k.  Rows are numbered
    over range partitions, so a key with most of the rows is many tasks' work, and
    the weighted values add up in partial sums.  (key, order) must be unique.
    """
    numbered = index_in_groups(series.select(key, order, value), key, [order], "_at")
    last = numbered.groupBy(key).agg(F.max("_at").alias("_last"))
    weight = F.pow(F.lit(decay), F.col("_last") - F.col("_at")) * (1.0 - decay)
    return numbered.join(last, key).groupBy(key).agg(F.sum(weight * F.col(value)).alias("ewma"))


def active_models(registry: DataFrame) -> DataFrame:
    return registry.filter("is_active = 1")


def latest_models(registry: DataFrame) -> DataFrame:
    """Newest active model of each type."""
    rest = [c for c in registry.columns if c not in ("model_type", "version")]
    newest = F.max_by(F.struct("version", *rest), "version")
    return (active_models(registry).groupBy("model_type").agg(newest.alias("_m"))
            .select("model_type", "_m.*"))


def detect_route(detected: DataFrame, date_col: str = "sim_date", route_id: str | None = None,
                 sim_date=None, looked_at: DataFrame | None = None) -> DataFrame:
    """Flagged rows with the number of events looked at on their route and day.  ``looked_at`` has
    the events that were scored, if counting them is to be spared their scores."""
    wanted = all_of([_equals("route_id", route_id), _equals(date_col, sim_date)])
    chosen = detected.filter(wanted)
    totals = (chosen if looked_at is None else looked_at.filter(wanted)).groupBy("route_id", date_col).agg(F.count("*").alias("total"))
    return chosen.filter("is_flagged").join(totals, ["route_id", date_col])


def severity_band(score: Column) -> Column:
    return F.when(score > 0.7, "high").when(score > 0.4, "medium").otherwise("low")


def segment_band(score: Column) -> Column:
    return F.when(score > 0.5, "high").when(score > 0.25, "medium").otherwise("low")


def recent_dates(events: DataFrame, n: int | None = 7, date_col: str = "sim_date") -> DataFrame:
    """The newest dates first; all of them without ``n``."""
    dates = events.select(F.col(date_col).alias("sim_date")).distinct().orderBy(F.desc("sim_date"))
    return dates if n is None else dates.limit(n)
