"""Leakage localization: which stop-to-stop segment and time window explain a loss.

Every route and day is one time-expanded graph.  All of them are built, solved
and scored by the same job; the groupBy keys replace the loops.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.functions.numeric import cents, clamp01, from_cents, half_up, ladder
from leakscope.functions.text import window_label
from leakscope.operators.flow import solve_graphs, spread
from leakscope.operators.grid_flow import solve_rows
from leakscope.operators.network import route_segments

# Fixed values.
HOURLY_WINDOWS = [(h, h + 1) for h in range(5, 23)]
SOURCE, SINK, FIRST_NODE = 0, 1, 2
CARRY_CAPACITY, CARRY_COST = 5, 1
RATIO_WEIGHT, FLOW_WEIGHT = 0.6, 0.4
MIN_SCORE, MIN_DISCREPANCY = 0.05, 10.0

KEYS = ["route_id", "sim_date"]
_SUMS = ["boardings", "tickets", "expected", "reported"]


def _in_windows(hourly: DataFrame, windows: list[tuple[int, int]]) -> DataFrame:
    """Hourly sums with the window they fall in, once per window where windows overlap;
    -1 outside all of them."""
    hour = F.col("sim_hour")
    hits = [((hour >= start) & (hour < end), t) for t, (start, end) in enumerate(windows)]
    covered = [h for start, end in windows for h in range(start, end)]
    if len(covered) == len(set(covered)):
        return hourly.withColumn("window_index", ladder(hits, -1).cast("int"))
    found = F.array_compact(F.array(*[F.when(inside, F.lit(t)) for inside, t in hits]))
    return hourly.withColumn("window_index", F.explode(
        F.when(F.size(found) == 0, F.array(F.lit(-1))).otherwise(found)))


def _window_rows(windows: list[tuple[int, int]]) -> Column:
    return F.array(*[
        F.struct(F.lit(t).alias("window_index"), F.lit(start).alias("window_start"),
                 F.lit(end).alias("window_end"))
        for t, (start, end) in enumerate(windows)])


def hourly_sums(events: DataFrame, date_col: str = "sim_date") -> DataFrame:
    """Events summed per route, day, hour and stop: everything later is network-sized."""
    return events.groupBy("route_id", F.col(date_col).alias("sim_date"), "sim_hour",
                          "stop_id", "stop_sequence").agg(
        F.sum("boarding_count").alias("boardings"), F.sum("ticket_count").alias("tickets"),
        F.sum(cents("expected_revenue")).alias("expected"),
        F.sum(cents("reported_revenue")).alias("reported"),
        F.count("*").alias("events"))


def route_days(hourly: DataFrame) -> DataFrame:
    return hourly.select(*KEYS).distinct()


def stop_grid(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS) -> DataFrame:
    """Every window and stop of every route and day, with its sums; 0 where nothing happened.

    Routes need at least two stops.
    """
    counted = stop_order.withColumn("num_stops", F.count("*").over(W.partitionBy("route_id")))
    dense = (route_days(hourly).join(counted.filter("num_stops >= 2"), "route_id")
             .select("*", F.inline(_window_rows(windows))))
    sums = (_in_windows(hourly, windows).groupBy(*KEYS, "window_index", "stop_id")
            .agg(*[F.sum(c).alias(c) for c in _SUMS]))
    return (dense.join(sums, [*KEYS, "window_index", "stop_id"], "left")
            .select(*KEYS, "window_index", "window_start", "window_end", "stop_index", "stop_id",
                    "stop_sequence", "num_stops",
                    *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _SUMS]))


def _segment_places(stop_order: DataFrame) -> DataFrame:
    """Every position of a segment, both ends included."""
    return route_segments(stop_order).select(
        "route_id", "segment_index",
        F.explode(F.sequence("segment_start_seq", "segment_end_seq")).alias("stop_sequence"))


def segment_stats(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS) -> DataFrame:
    """Sums per segment and window.  A segment counts both of its ends.

    Spread once by route and day, which all groupings below and the ranks of a day keep.
    """
    places = _segment_places(stop_order)
    per_place = (_in_windows(hourly, windows).filter("window_index >= 0").repartition(*KEYS)
                 .groupBy(*KEYS, "window_index", "stop_sequence")
                 .agg(*[F.sum(c).alias(c) for c in _SUMS]))
    return (per_place.join(places, ["route_id", "stop_sequence"])
            .groupBy(*KEYS, "window_index", "segment_index")
            .agg(*[F.sum(c).alias(c) for c in _SUMS]))


def segment_grid(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS) -> DataFrame:
    """Every window and segment of every route and day; 0 where nothing happened."""
    dense = (route_days(hourly).join(route_segments(stop_order), "route_id")
             .select("*", F.inline(_window_rows(windows))))
    stats = segment_stats(hourly, stop_order, windows)
    return (dense.join(stats, [*KEYS, "window_index", "segment_index"], "left")
            .select(*KEYS, "window_index", "window_start", "window_end", "segment_index",
                    "segment_start_stop", "segment_end_stop", "segment_start_seq",
                    "segment_end_seq",
                    *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _SUMS]))


def network_edges(grid: DataFrame, num_windows: int, skip_empty: bool = False) -> DataFrame:
    """Edges of the time-expanded graph, four kinds at most per grid cell.

    Source to the first stop, last stop to the sink, stop to next stop, and
    the same stop in the next window.  A stretch costs more the fewer tickets
    were sold for its boardings.  ``edge_no`` counts the edges window by window
    and stop by stop.  ``skip_empty`` leaves out cells without any boardings.
    """
    t, i, stops = F.col("window_index"), F.col("stop_index"), F.col("num_stops").cast("int")
    node = FIRST_NODE + t * stops + i
    load = F.greatest(F.lit(1).cast("bigint"), F.col("boardings"))
    missing = F.greatest(F.lit(0).cast("bigint"), load - F.greatest(F.lit(0).cast("bigint"), F.col("tickets")))
    price = F.floor(missing / load * 100.0 + 0.5).cast("int")
    carried = (t < num_windows - 1).cast("int")
    first_no = t * (2 * stops + 1) + F.when(i > 0, 1 + i * (1 + carried)).otherwise(0)
    at_start, at_end = (i == 0).cast("int"), (i == stops - 1).cast("int")

    def edge(when: Column, number: Column, kind: str, src: Column, dst: Column, cap: Column,
             cost: Column) -> Column:
        return F.when(when, F.struct(
            number.cast("int").alias("edge_no"), F.lit(kind).alias("kind"),
            src.cast("int").alias("src"), dst.cast("int").alias("dst"),
            cap.cast("bigint").alias("capacity"), cost.cast("int").alias("cost")))

    zero = F.lit(0)
    kinds = F.array(
        edge(i == 0, first_no, "source", F.lit(SOURCE), node, load, zero),
        edge(i == stops - 1, first_no, "sink", node, F.lit(SINK), load, zero),
        edge(i < stops - 1, first_no + at_start, "segment", node, node + 1, load, price),
        edge(t < num_windows - 1, first_no + at_start + 1, "carry", node, node + stops,
             F.lit(CARRY_CAPACITY), F.lit(CARRY_COST)))
    cells = grid.filter("boardings > 0") if skip_empty else grid
    return (cells.select(*KEYS, "window_index", "stop_index", F.inline(kinds))
            .filter("edge_no IS NOT NULL"))


def discrepancy_ratio(expected: Column, reported: Column) -> Column:
    return F.when(expected > 0, (expected - reported).cast("double") / expected.cast("double")
                  ).otherwise(0.0)


def score_segments(segments: DataFrame, flow_share: Column | None = None) -> DataFrame:
    """Score, low-signal filter and rank.  ``flow_share`` is the segment's part of the flow cost."""
    expected, reported = F.col("expected"), F.col("reported")
    share = F.lit(0.0) if flow_share is None else flow_share
    raw = clamp01(discrepancy_ratio(expected, reported) * RATIO_WEIGHT + share * FLOW_WEIGHT)
    gap = from_cents(expected - reported)
    by_score = W.partitionBy(*KEYS).orderBy(
        F.desc("localization_score"), "window_index", "segment_index")
    extra = [c for c in ("flow_units", "flow_cost") if c in segments.columns]
    return (segments.withColumn("_raw", raw)
            .filter((F.col("_raw") > MIN_SCORE) | (gap > MIN_DISCREPANCY))
            .withColumn("localization_score", half_up("_raw", 4))
            .select(*KEYS, window_label(F.col("window_start"), F.col("window_end")).alias("time_window"),
                    F.col("window_start").alias("time_window_start"),
                    F.col("window_end").alias("time_window_end"),
                    "segment_start_stop", "segment_end_stop", "segment_start_seq", "segment_end_seq",
                    from_cents("expected").alias("expected_flow"),
                    from_cents("reported").alias("reported_flow"),
                    gap.alias("flow_discrepancy"), "localization_score", *extra,
                    F.row_number().over(by_score).alias("rank_position")))


def flows(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS,
          skip_empty: bool = False) -> DataFrame:
    """Solved graph of every route and day, from its listed edges."""
    grid = spread(stop_grid(hourly, stop_order, windows), KEYS)
    return solve_graphs(network_edges(grid, len(windows), skip_empty), KEYS, SOURCE, SINK)


def _packed_routes(stop_order: DataFrame) -> DataFrame:
    """One row per route with at least two stops: the index of each stop, and the segments that count each position."""
    stop = F.when(F.col("stop_id").isNotNull(), F.struct("stop_id", "stop_index"))
    stops = (stop_order.groupBy("route_id").agg(F.count("*").alias("num_stops"), F.map_from_entries(F.collect_list(stop)).alias("_stops"))
             .filter("num_stops >= 2"))
    places = (_segment_places(stop_order).groupBy("route_id", F.col("stop_sequence").cast("bigint").alias("stop_sequence"))
              .agg(F.sort_array(F.collect_list("segment_index")).alias("segments"))
              .groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct("stop_sequence", "segments"))).alias("_segments")))
    return stops.join(places, "route_id", "left")


def graph_rows(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS) -> DataFrame:
    """Hourly sums with their place in the graph of their route and day, and the segments they count in.

    A route's stops are one row, so a single join finds both."""
    return (_in_windows(hourly, windows).join(_packed_routes(stop_order), "route_id")
            .select(*KEYS, "num_stops", "window_index", F.try_element_at("_stops", "stop_id").alias("stop_index"), *_SUMS,
                    F.try_element_at("_segments", F.col("stop_sequence").cast("bigint")).alias("segments")))


def grid_flows(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS,
               skip_empty: bool = False, proof: bool = False) -> DataFrame:
    """The same graphs, solved many at a time from the cells where something happened.

    Only those travel; the grids exist inside the tasks.
    """
    return solve_rows(graph_rows(hourly, stop_order, windows), KEYS, len(windows), skip_empty, CARRY_CAPACITY, CARRY_COST, proof=proof)


def localize(events: DataFrame, stop_order: DataFrame, date_col: str = "sim_date",
             windows=HOURLY_WINDOWS, skip_empty: bool = False) -> DataFrame:
    """Ranked segments of every route and day at hand; one route's day is a filter on ``events``.

    The hourly sums travel once to where their graph is solved, and its flows and
    segment totals come back together.  A route whose graph fails is left
    out; ``failed_routes`` names it.
    """
    rows = graph_rows(hourly_sums(events, date_col), stop_order, windows)
    solved = solve_rows(rows, KEYS, len(windows), skip_empty, CARRY_CAPACITY, CARRY_COST, ["boardings", "expected", "reported"])
    return localize_solved(solved, stop_order, windows)


def active_segments(hourly: DataFrame, stop_order: DataFrame, windows=HOURLY_WINDOWS) -> DataFrame:
    """``segment_grid`` without the cells where nothing happened."""
    return _named(segment_stats(hourly, stop_order, windows), stop_order, windows)


def _named(stats: DataFrame, stop_order: DataFrame, windows) -> DataFrame:
    """Segments with their stops and hours.  Every route lists its segments, so both sides
    of the join are spread by route and segment."""
    bounds = F.get(_window_rows(windows), F.col("window_index"))
    return (stats.join(route_segments(stop_order), ["route_id", "segment_index"])
            .withColumns({"window_start": bounds["window_start"], "window_end": bounds["window_end"]}))


def localize_solved(solved: DataFrame, stop_order: DataFrame, windows) -> DataFrame:
    """Scores from solved graphs with the totals of their segments.

    Cells without events are only ranked for their share of the flow's cost, which
    takes more than ``MIN_SCORE``; the others would be dropped again, so they never arise.
    """
    cells = (solved.filter(F.col("error").isNull()).dropna(subset=KEYS)
             .select(*KEYS, F.col("total_cost").alias("_total"), F.inline("segments")))
    share = F.col("flow_cost") / (F.col("_total") + 1)
    ranked = cells.filter((F.col("boardings") + F.col("expected") + F.col("reported") > 0) | (share * FLOW_WEIGHT > MIN_SCORE))
    return score_segments(_named(ranked, stop_order, windows), share)


def failed_routes(solved: DataFrame) -> DataFrame:
    return solved.filter(F.col("error").isNotNull()).select(*KEYS, "error")


def top_segments(localized: DataFrame, k: int = 5) -> DataFrame:
    return localized.filter(F.col("rank_position") <= k)


def localization_hits(localized: DataFrame, truth: DataFrame, k: int = 5,
                      match_time: bool = False) -> DataFrame:
    """Labelled anomalies with a flag: is one of the top k segments within one stop of it?"""
    top = top_segments(localized, k).select(
        F.col("route_id").alias("_route"), F.col("sim_date").alias("_date"),
        "segment_start_seq", "segment_end_seq", "time_window_start", "time_window_end")
    near = ((F.col("segment_start_seq") >= F.col("start_stop_sequence") - 1)
            & (F.col("segment_end_seq") <= F.col("end_stop_sequence") + 1))
    if match_time:
        near = near & ((F.col("time_window_start") <= F.col("end_hour"))
                       & (F.col("time_window_end") > F.col("start_hour")))
    labelled = truth.withColumnsRenamed({"time_window_start": "start_hour",
                                         "time_window_end": "end_hour"})
    same = (F.col("route_id") == F.col("_route")) & (F.col("sim_date") == F.col("_date"))
    hit = labelled.join(top, same & near, "left_semi").select("anomaly_id", F.lit(True).alias("_hit"))
    return (truth.join(hit, "anomaly_id", "left")
            .select("anomaly_id", "route_id", "sim_date",
                    F.coalesce("_hit", F.lit(False)).alias("hit")))


def localization_accuracy(hits: DataFrame, k: int = 5, by: str | None = None) -> DataFrame:
    """Share of the labelled anomalies that were hit, of all of them or per ``by``."""
    total = F.count("*")
    found = F.count_if("hit")
    return hits.groupBy(*([by] if by else [])).agg(found.alias("hits"), total.alias("total"),
                    F.coalesce(F.try_divide(found.cast("double"), total), F.lit(0.0)).alias("accuracy"),
                    F.lit(k).alias("top_k"))
