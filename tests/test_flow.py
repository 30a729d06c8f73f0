import itertools
import random

import pytest
from pyspark.sql import functions as F

from leakscope.operators import flow, localize, network
from leakscope.plans import queries

GRAPHS = {
    "one arc": ([(0, 1, 7, 3)], 0, 1, 7, 21),
    "three in a row": ([(0, 2, 9, 2), (2, 3, 4, 1), (3, 1, 6, 5)], 0, 1, 4, 32),
    "cheap way first, dear way last": ([(0, 2, 3, 1), (2, 1, 3, 1), (0, 1, 2, 9)], 0, 1, 5, 24),
    "the sink is cut off": ([(0, 2, 4, 1), (3, 1, 4, 1)], 0, 1, 0, 0),
    "flow must be led back": ([(0, 2, 1, 1), (0, 3, 1, 4), (2, 3, 1, 1), (2, 1, 1, 6), (3, 1, 1, 1)], 0, 1, 2, 12)}


@pytest.mark.parametrize("name", GRAPHS)
def test_known_graphs(name):
    edges, source, sink, want_flow, want_cost = GRAPHS[name]
    total, cost, _ = flow.min_cost_flow(*zip(*edges), source, sink)
    assert (total, cost) == (want_flow, want_cost)


def brute_force(edges, source, sink, nodes):
    best = (0, 0)
    for flows in itertools.product(*[range(e[2] + 1) for e in edges]):
        net = [0] * nodes
        for (u, v, _, _), f in zip(edges, flows):
            net[u] -= f
            net[v] += f
        if all(net[n] == 0 for n in range(nodes) if n not in (source, sink)) and net[sink] >= 0:
            cost = sum(e[3] * f for e, f in zip(edges, flows))
            best = max(best, (net[sink], -cost))
    return best[0], -best[1]


def test_random_graphs_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        nodes = rng.randint(3, 5)
        edges = []
        for _ in range(rng.randint(3, 7)):
            u, v = rng.sample(range(nodes), 2)
            edges.append((u, v, rng.randint(1, 2), rng.randint(0, 9)))
        total, cost, flows = flow.min_cost_flow(*zip(*edges), 0, 1)
        assert (total, cost) == brute_force(edges, 0, 1, nodes)
        assert cost == sum(e[3] * f for e, f in zip(edges, flows))


def test_one_bad_graph_does_not_stop_the_others(spark):
    rows = [("good", 0, 0, 2, 3, 4), ("good", 1, 2, 1, 2, 1), ("bad", 0, -5, 1, 1, 1)]
    edges = spark.createDataFrame(rows, "g string, edge_no int, src int, dst int, capacity int, cost int")
    got = {r.g: r for r in flow.solve_graphs(edges, ["g"]).collect()}
    assert (got["good"].total_flow, got["good"].total_cost, got["good"].error) == (2, 10, None)
    assert got["bad"].total_flow is None and got["bad"].error


@pytest.fixture(scope="module")
def solved(small):
    windows = [(5 + 3 * k, 8 + 3 * k) for k in range(6)]
    return localize.flows(small.yearly, small.stop_order, windows).collect()


def test_flows_are_feasible_and_optimal(solved):
    assert solved
    for row in solved[:40]:
        edges, flows = row.edges, row.flow
        assert [e.edge_no for e in edges] == list(range(len(edges)))
        net = {}
        for e, f in zip(edges, flows):
            assert 0 <= f <= e.capacity
            net[e.src] = net.get(e.src, 0) - f
            net[e.dst] = net.get(e.dst, 0) + f
        assert all(v == 0 for n, v in net.items() if n > 1)
        assert net[1] == row.total_flow == -net[0]
        assert row.total_flow <= sum(e.capacity for e in edges if e.src == 0)
        assert row.total_cost == sum(e.cost * f for e, f in zip(edges, flows))
        # no negative cycle is left, so no cheaper flow of the same size exists
        arcs = [(e.src, e.dst, e.cost) for e, f in zip(edges, flows) if f < e.capacity]
        arcs += [(e.dst, e.src, -e.cost) for e, f in zip(edges, flows) if f > 0]
        dist = {n: 0 for n in net}
        for _ in range(len(net)):
            changed = False
            for u, v, c in arcs:
                if dist[u] + c < dist[v]:
                    dist[v], changed = dist[u] + c, True
            if not changed:
                break
        assert not changed


def test_localized_segments(small):
    rows = small.localized.collect()
    assert rows
    groups = {}
    for r in rows:
        assert 0 <= r.localization_score <= 1
        assert r.localization_score > 0.05 or r.flow_discrepancy > 10 or r.localization_score == 0.05
        groups.setdefault((r.route_id, r.sim_date), []).append(r)
    for ranked in groups.values():
        ranked.sort(key=lambda r: r.rank_position)
        assert [r.rank_position for r in ranked] == list(range(1, len(ranked) + 1))
        assert all(a.localization_score >= b.localization_score for a, b in zip(ranked, ranked[1:]))


def test_hits_and_accuracy(spark):
    located = spark.createDataFrame(
        [("R", "2024-01-01", 3, 4, 8, 9, 1), ("R", "2024-01-01", 6, 7, 8, 9, 6)],
        "route_id string, sim_date string, segment_start_seq int, segment_end_seq int, "
        "time_window_start int, time_window_end int, rank_position int")
    truth = spark.createDataFrame(
        [("A1", "R", "2024-01-01", 4, 4, 8, 8), ("A2", "R", "2024-01-01", 6, 6, 8, 8),
         ("A3", "R", "2024-01-01", 4, 5, 12, 14), ("A4", "Q", "2024-01-01", 4, 5, 12, 14)],
        "anomaly_id string, route_id string, sim_date string, start_stop_sequence int, "
        "end_stop_sequence int, time_window_start int, time_window_end int")
    hits = {r.anomaly_id: r.hit for r in localize.localization_hits(located, truth).collect()}
    assert hits == {"A1": True, "A2": False, "A3": True, "A4": False}
    timed = localize.localization_hits(located, truth, match_time=True)
    assert {r.anomaly_id for r in timed.filter("hit").collect()} == {"A1"}
    row = localize.localization_accuracy(localize.localization_hits(located, truth)).first()
    assert (row.hits, row.total, row.accuracy, row.top_k) == (2, 4, 0.5, 5)
    none = localize.localization_accuracy(localize.localization_hits(located, truth.limit(0))).first()
    assert (none.hits, none.total, none.accuracy) == (0, 0, 0.0)


def test_empty_cells_cost_a_hundred_unless_skipped(spark):
    stops = spark.createDataFrame([("R", f"S{i}", i, 0.0) for i in (1, 2)],
                                  "route_id string, stop_id string, stop_sequence int, distance_from_start_km double")
    events = spark.createDataFrame(
        [("R", "2024-01-01", 9, "S1", 1, 4, 2, 10.0, 5.0)],
        "route_id string, sim_date string, sim_hour int, stop_id string, stop_sequence int, "
        "boarding_count int, ticket_count int, expected_revenue double, reported_revenue double")
    order = network.route_stop_order(stops)
    grid = localize.stop_grid(localize.hourly_sums(events), order, [(8, 9), (9, 10)])
    edges = localize.network_edges(grid, 2)
    costs = {(r.window_index, r.kind): (r.capacity, r.cost) for r in edges.filter("kind = 'segment'").collect()}
    assert costs == {(0, "segment"): (1, 100), (1, "segment"): (4, 50)}
    assert edges.count() == 8
    assert localize.network_edges(grid, 2, skip_empty=True).count() == 2


def test_single_stop_routes_have_no_graph(spark):
    stops = spark.createDataFrame([("R", "S1", 1, 0.0)],
                                  "route_id string, stop_id string, stop_sequence int, distance_from_start_km double")
    events = spark.createDataFrame(
        [("R", "2024-01-01", 9, "S1", 1, 4, 2, 10.0, 5.0)],
        "route_id string, sim_date string, sim_hour int, stop_id string, stop_sequence int, "
        "boarding_count int, ticket_count int, expected_revenue double, reported_revenue double")
    assert localize.localize(events, network.route_stop_order(stops)).count() == 0


def test_failed_routes_are_named(spark):
    solved = spark.createDataFrame([("R", "d", None), ("Q", "d", "broken")],
                                   "route_id string, sim_date string, error string")
    assert [r.route_id for r in localize.failed_routes(solved).collect()] == ["Q"]


def test_segments_count_both_ends(small):
    stats = localize.segment_stats(small.yearly, small.stop_order, [(0, 24)])
    total = stats.agg(F.sum("boardings")).first()[0]
    by_place = {r.stop_sequence: r.b for r in small.events.groupBy("stop_sequence").agg(
        F.sum("boarding_count").alias("b")).collect()}
    assert total == sum(by_place[s] + by_place[s + 1] for s in range(1, 7))


# Queries whose graphs, totals and flows come from one pass over the events, without tables stored in between.
IN_ONE_PASS = ["localization", "localization_rank", "localization_hits", "localization_accuracy"]


@pytest.mark.parametrize("name", IN_ONE_PASS)
def test_no_table_is_stored_on_the_way(spark, small, name):
    found = queries.registered()[name](spark, small.dir)
    assert found.inputFiles() and all(small.dir in f for f in found.inputFiles())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_localized_as_from_totals_and_flows(spark):
    """Odd events: no money, no position, a stop of another route, an hour outside the windows, a route without day."""
    stops = spark.createDataFrame([(r, f"{r}{i}", i * 2, 0.0) for r in "RQ" for i in range(1, 5)] + [("P", "P1", 1, 0.0)],
                                  "route_id string, stop_id string, stop_sequence int, distance_from_start_km double")
    events = [("R", "a", 9, "R1", 2, 40, 4, 100.0, 10.0), ("R", "a", 9, "R1", 2, None, 3, None, 5.0), ("R", "a", 9, "R2", 3, 20, None, 50.0, None),
              ("R", "a", 10, "Q1", 4, 7, 1, 30.0, 0.0), ("R", "a", 2, "R3", 6, 30, 1, 90.0, 0.0), ("R", "a", 11, "R4", None, 30, 1, 90.0, 0.0),
              ("R", "b", None, "R1", 2, 30, 1, 90.0, 0.0), ("R", None, 9, "R1", 2, 30, 1, 90.0, 0.0), (None, "a", 9, "R1", 2, 30, 1, 90.0, 0.0),
              ("Q", "a", 9, None, 6, 30, 1, 90.0, 0.0), ("Q", "b", 12, "Q4", 8, 6, 1, None, None), ("P", "a", 9, "P1", 1, 30, 1, 90.0, 0.0)]
    rows = spark.createDataFrame(events * 2, "route_id string, sim_date string, sim_hour int, stop_id string, stop_sequence int, "
                                 "boarding_count int, ticket_count int, expected_revenue double, reported_revenue double")
    order, hourly = network.route_stop_order(stops), localize.hourly_sums(rows)
    solved = {(r.route_id, r.sim_date): r for r in localize.grid_flows(hourly, order).collect()}
    assert set(solved) == {("R", "a"), ("R", "b"), ("R", None), ("Q", "a"), ("Q", "b")} and all(r.error is None for r in solved.values())
    cells = {}
    for key, r in solved.items():
        for u in r.used:
            cells[(*key, u.window_index, u.segment_index)] = [0, 0, 0, u.flow_units, u.flow_cost]
    for r in localize.segment_stats(hourly, order).collect():
        key, sums = (r.route_id, r.sim_date, r.window_index, r.segment_index), [r.boardings, r.expected, r.reported]
        cells[key] = [*((v or 0 for v in sums) if key in cells else sums), *cells.get(key, [0] * 5)[3:]]
    want = {}
    for (route, day, t, i), (boardings, expected, reported, units, cost) in cells.items():
        share = cost / (solved[route, day].total_cost + 1)
        if day is None or not (None not in (boardings, expected, reported) and boardings + expected + reported > 0 or share * 0.4 > 0.05):
            continue
        ratio = (expected - reported) / expected if expected > 0 else 0.0
        score = min(1.0, max(0.0, ratio * 0.6 + share * 0.4))
        if score > 0.05 or (expected - reported) / 100 > 10:
            want[route, day, 5 + t, 2 * (i + 1)] = (int(score * 10000 + 0.5) / 10000, expected / 100, reported / 100, units, cost)
    got = {(r.route_id, r.sim_date, r.time_window_start, r.segment_start_seq): (
        r.localization_score, r.expected_flow, r.reported_flow, r.flow_units, r.flow_cost) for r in localize.localize(rows, order).collect()}
    assert want and got == want
