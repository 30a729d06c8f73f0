"""Batched grid flows against the general solver, and what the certificate rejects."""

import random

import pytest
from pyspark.sql import functions as F

from leakscope.operators import flow, grid_flow, localize

KEYS = ["g"]


def graph_edges(cells, windows, stops, skip_empty):
    """Edges of one grid, as the general solver takes them."""
    at = {}
    for c in cells:
        b, k = at.get((c["window_index"], c["stop_index"]), (0, 0))
        at[c["window_index"], c["stop_index"]] = b + (c["boardings"] or 0), k + (c["tickets"] or 0)
    edges = []
    for t in range(windows):
        for i in range(stops):
            b, k = at.get((t, i), (0, 0))
            if skip_empty and not b:
                continue
            load, node = max(1, b), 2 + t * stops + i
            price = int(max(0, load - max(0, k)) / load * 100.0 + 0.5)
            edges += [(0, node, load, 0)] * (i == 0) + [(node, 1, load, 0)] * (i == stops - 1)
            edges += [(node, node + 1, load, price)] * (i < stops - 1) + [(node, node + stops, 5, 1)] * (t < windows - 1)
    return edges


def random_cells(rng, windows, stops):
    return [{"window_index": rng.randrange(windows), "stop_index": rng.randrange(stops), "boardings": rng.choice((None, 0, 3, 9, 40)),
             "tickets": rng.choice((None, 0, 2, 9))} for _ in range(rng.randrange(0, windows * stops * 2))]


@pytest.mark.parametrize("skip_empty", [False, True])
def test_as_large_and_as_cheap_as_the_general_solver(skip_empty):
    rng = random.Random(4)
    for windows, stops in ((1, 2), (1, 4), (2, 2), (4, 3), (6, 7)):
        cells = [random_cells(rng, windows, stops) for _ in range(60)]
        got = grid_flow._rows(cells, windows, stops, skip_empty, 5, 1)
        for some, row in zip(cells, got):
            edges = graph_edges(some, windows, stops, skip_empty)
            want = flow.min_cost_flow(*zip(*edges), 0, 1)[:2] if edges else (0, 0)
            assert row[:2] == want


SCHEMA = ("g long, num_stops int, cells array<struct<window_index:int,stop_index:int,boardings:bigint,tickets:bigint>>")
CHECKS = ["over_capacity", "unbalanced", "total_gap", "cost_gap", "cut_gap", "cheaper_ways"]


@pytest.fixture(scope="module")
def solved(spark):
    rng = random.Random(6)
    rows = [(g, s, random_cells(rng, 5, s)) for g, s in enumerate([2, 3, 7] * 10)] + [(100, 4, []), (101, 4, None)]
    found = grid_flow.solve_grids(spark.createDataFrame(rows, SCHEMA), KEYS, 5)
    return spark.createDataFrame(found.collect(), found.schema)


def test_certificates_hold_and_failures_are_named(solved):
    checked = grid_flow.certificate(solved, KEYS, 5).collect()
    assert len(checked) == 31 and all(r[c] == 0 for r in checked for c in CHECKS)
    bad = solved.filter("error IS NOT NULL").collect()
    assert [r["g"] for r in bad] == [101] and bad[0]["total_flow"] is None


NO_FLOW = {f"{k}_flow": f"transform({k}_flow, x -> 0L)" for k in ("source", "sink", "segment", "carry")}
SPOILED = {
    "over_capacity": {"segment_flow": "transform(segment_flow, x -> x + 1000)"},
    "unbalanced": {"segment_flow": "transform(segment_flow, (x, i) -> if(i = 0, x + 1, x))"},
    "total_gap": {"total_flow": "total_flow + 1"},
    "cost_gap": {"total_cost": "total_cost - 1"},
    # no flow at all is feasible and costs nothing, but a larger one exists
    "cut_gap": {**NO_FLOW, "total_flow": "0L", "total_cost": "0L"},
    "cheaper_ways": {"potentials": "transform(potentials, (x, i) -> if(i = 1, x + 1000, x))"}}


@pytest.mark.parametrize("check", CHECKS)
def test_certificate_rejects(solved, check):
    spoiled = solved.filter("g = 2").withColumns({c: F.expr(e) for c, e in SPOILED[check].items()})
    row = grid_flow.certificate(spoiled, KEYS, 5).first()
    assert row[check] != 0


def test_ignoring_costs_is_found(spark):
    """A maximum flow over a dear stretch although a cheap one has room."""
    cells = [{"window_index": 0, "stop_index": 0, "boardings": 4, "tickets": 0}, {"window_index": 0, "stop_index": 1, "boardings": 4, "tickets": 4},
             {"window_index": 1, "stop_index": 0, "boardings": 9, "tickets": 9}, {"window_index": 1, "stop_index": 1, "boardings": 9, "tickets": 9}]
    solved = grid_flow.solve_grids(spark.createDataFrame([(1, 2, cells)], SCHEMA), KEYS, 2)
    best = solved.first()
    assert (best["total_flow"], best["total_cost"], best["segment_flow"]) == (13, 400, [4, 9])
    # the same with one unit less on its way through both windows' ends is no maximum; led around it is no cheapest
    worse = solved.withColumns({"prices": F.array(*[F.lit(p).cast("long") for p in (0, 0, 100, 0)])})
    row = grid_flow.certificate(worse, KEYS, 2).first()
    assert row["cost_gap"] != 0 or row["cheaper_ways"] > 0


def test_localize_finds_the_same_totals(small):
    hourly = localize.hourly_sums(small.events.filter("day(sim_date) = 5"))
    one = {tuple(r) for r in localize.flows(hourly, small.stop_order).select(
        *localize.KEYS, "total_flow", "total_cost").limit(60).collect()}
    all_of_them = {tuple(r) for r in localize.grid_flows(hourly, small.stop_order).select(
        *localize.KEYS, "total_flow", "total_cost").collect()}
    assert one and one <= all_of_them


def rounds(monkeypatch, cells, windows, stops):
    calls, distances = [], grid_flow.Grids.distances
    with monkeypatch.context() as patch:
        patch.setattr(grid_flow.Grids, "distances", lambda grids: calls.append(1) or distances(grids))
        return grid_flow._rows(cells, windows, stops, False, 5, 1), len(calls)


def test_paths_apart_from_each_other_share_their_distances(monkeypatch):
    assert rounds(monkeypatch, [[]] * 3, 18, 7)[1] <= 2


def test_sharing_distances_changes_no_flow(monkeypatch):
    rng, along = random.Random(9), grid_flow.Grids._along
    cells = [random_cells(rng, 9, 5)[:rng.choice((1, 3, 90))] for _ in range(80)]
    together, few = rounds(monkeypatch, cells, 9, 5)
    monkeypatch.setattr(grid_flow.Grids, "_along", lambda *args: along(*args)[:0])
    one_by_one, many = rounds(monkeypatch, cells, 9, 5)
    assert together == one_by_one and few <= many


def test_certificates_are_counted_many_graphs_at_a_time(spark, solved):
    checked = grid_flow.certificate(solved.withColumn("carry_flow", F.array_repeat(F.lit(6).cast("long"), 4 * F.col("num_stops"))), KEYS, 5)
    assert "lambda" not in checked._jdf.queryExecution().toString()
    stops = {r["g"]: r["num_stops"] for r in solved.collect()}
    assert {r["g"]: r["over_capacity"] for r in checked.collect()} == {g: 4 * s for g, s in stops.items() if g != 101}


def sparse_cells(rng, windows, stops, most):
    """A day with few cells, more often at the ends of the route."""
    return [{"window_index": rng.randrange(windows), "stop_index": rng.choice((0, 0, stops - 1, min(1, stops - 1), max(0, stops - 2), rng.randrange(stops))),
             "boardings": rng.choice((None, 0, 1, 2, 3, 9, 40)), "tickets": rng.choice((None, 0, 1, 2, 9, 30))} for _ in range(rng.randrange(most))]


@pytest.mark.parametrize("carry", [0, 1, 5])
def test_days_with_few_cells_are_solved_as_well(carry):
    rng = random.Random(7)
    for windows, stops in ((1, 2), (5, 2), (9, 3), (18, 4), (12, 7)):
        cells = [sparse_cells(rng, windows, stops, 2 * stops + 2) for _ in range(120)]
        got = grid_flow._rows(cells, windows, stops, False, carry, 1)
        for some, row in zip(cells, got):
            # the arcs to the next window lead one row of nodes on
            edges = [(u, v, carry if u > 1 and v == u + stops else cap, price) for u, v, cap, price in graph_edges(some, windows, stops, False)]
            assert row[:2] == flow.min_cost_flow(*zip(*edges), 0, 1)[:2]


def test_days_with_few_cells_need_no_paths(monkeypatch):
    """Stops where every cell takes one unit part the grid; only stops beyond the first and last of them are searched."""
    rng = random.Random(8)
    cells = [[{"window_index": rng.randrange(18), "stop_index": i, "boardings": 30, "tickets": 3} for i in set(stops)]
             for stops in [(0,), (6,), (1, 2, 3, 4, 5), (0, 2, 4), (2, 6)] * 20]
    assert rounds(monkeypatch, cells, 18, 7)[1] == 0
    assert rounds(monkeypatch, [[c | {"stop_index": i} for i in range(7) for c in cells[0]]], 18, 7)[1] > 0


def test_first_stops_by_state_as_by_paths():
    rng = grid_flow.np.random.default_rng(3)
    for windows, carry in ((1, 5), (6, 2), (18, 5)):
        load, price = rng.choice([1, 1, 1, 2, 4, 30], (windows, 50)), rng.choice([0, 40, 97, 100], (windows, 50))
        out, waiting = grid_flow._first_stop(load, price, carry, 1)
        assert (out <= load).all() and (out >= 0).all() and (waiting <= carry).all() and (waiting >= 0).all() and not waiting[-1].any()
        assert (out.cumsum(axis=0) - grid_flow.np.arange(1, windows + 1)[:, None] == waiting).all()
        loads, prices = (grid_flow.np.stack([values, grid_flow.np.full_like(values, empty)], axis=1) for values, empty in ((load, 1), (price, 100)))
        grids = grid_flow.Grids(loads, prices, grid_flow.np.ones_like(loads, dtype=bool), carry, 1)
        grid_flow.solve(grids)
        found = grids.flows()
        assert ((price * found["segment"][:, 0]).sum(axis=0) + found["carry"].sum(axis=(0, 1)) == (price * out).sum(axis=0) + waiting.sum(axis=0)).all()


ROWS = "g long, d string, num_stops int, window_index int, stop_index int, boardings bigint, tickets bigint, money bigint, segments array<int>"


def test_rows_are_put_together_wherever_batches_end(spark):
    rng = random.Random(12)
    graphs = [(g, rng.choice((None, "a", "b")), 4) for g in range(40)]
    rows = [(*graphs[g], rng.choice((-1, 0, 1, 2)), rng.choice((None, 0, 1, 2, 3)), rng.choice((None, 4, 9)), 2, rng.choice((None, 7)),
             rng.choice((None, [0], [0, 1], [2]))) for g in range(40) for _ in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, ROWS)
    cell = F.expr("CASE WHEN window_index >= 0 AND stop_index IS NOT NULL THEN struct(window_index, stop_index, boardings, tickets) END")
    packed = df.groupBy("g", "d", "num_stops").agg(F.collect_list(cell).alias("cells"))
    want = {r["g"]: r for r in grid_flow.solve_grids(packed, ["g", "d"], 3).collect()}
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
        got = grid_flow.solve_rows(df, ["g", "d"], 3, sums=["money"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert len(got) == len(graphs) and all(r["error"] is None for r in got)
    for r in got:
        assert (r["d"], r["total_flow"], r["total_cost"], r["used"]) == tuple(want[r["g"]][c] for c in ("d", "total_flow", "total_cost", "used"))
        sums, flows = {}, {(u["window_index"], u["segment_index"]): (u["flow_units"], u["flow_cost"]) for u in r["used"]}
        for _, _, _, t, _, _, _, money, segments in (x for x in rows if x[0] == r["g"] and x[3] >= 0):
            for s in segments or ():
                sums[t, s] = sums.get((t, s)) if money is None else (sums.get((t, s)) or 0) + money
        assert {(x["window_index"], x["segment_index"]): (x["money"], (x["flow_units"], x["flow_cost"])) for x in r["segments"]} == {
            k: ((sums.get(k) or 0) if k in flows else sums[k], flows.get(k, (0, 0))) for k in {*sums, *flows}}


@pytest.fixture(scope="module")
def proven(spark):
    """Graphs from rows, with their proofs: few cells, all cells wide, and none."""
    rng = random.Random(15)
    rows = [(g, None, s, c["window_index"], c["stop_index"], c["boardings"], c["tickets"], None, None) for g, s in enumerate([2, 3, 7, 7] * 8)
            for c in (sparse_cells(rng, 5, s, 6) if g % 4 < 3 else [{"window_index": t, "stop_index": i, "boardings": 9, "tickets": t} for t in (1, 3) for i in range(7)])]
    rows += [(g, None, 7, -1, None, 4, 4, None, None) for g in (100, 101)]
    found = grid_flow.solve_rows(spark.createDataFrame(rows, ROWS), KEYS, 5, proof=True)
    return spark.createDataFrame(found.collect(), found.schema)


def test_short_proofs_hold(proven):
    rows = proven.collect()
    checked = grid_flow.certificate(proven, KEYS, 5).collect()
    assert len(checked) == len(rows) >= 30 and all(r[c] == 0 for r in checked for c in CHECKS)
    # a proof grows with what happened, but for potentials and sides
    empty = next(r for r in rows if r["g"] == 100)
    assert (len(empty["cells"]), len(empty["arcs"])) == (0, 0) and len(empty["potentials"]) + len(empty["side"]) <= 5 * 7 * 2 + 5


def longs(values):
    return grid_flow.np.frombuffer(values, "i8").copy()


def more_flow(row, kind, by):
    """The proof with ``by`` units more on the first arc of a kind."""
    arcs = dict(longs(row["arcs"]).reshape(-1, 2).tolist())
    at = grid_flow.KINDS.index(kind) * 5 * row["num_stops"]
    arcs[at] = arcs.get(at, 0 if kind == "carry" else 1) + by
    return {"arcs": bytes(grid_flow.np.array(sorted(arcs.items()), "i8").tobytes())}


def raised(row):
    pi = grid_flow.np.frombuffer(row["potentials"], "i2").copy()
    pi[1] += 1000
    return {"potentials": pi.tobytes()}


def cheaper(row):
    return {"cells": grid_flow.np.array([[0, 1, 40]], "i8").tobytes()}


SHORT_SPOILED = {
    "over_capacity": lambda r: more_flow(r, "segment", 100_000), "unbalanced": lambda r: more_flow(r, "carry", 1),
    "total_gap": lambda r: more_flow(r, "source", -1), "cost_gap": cheaper, "cut_gap": lambda r: {"side": b"\x40" + bytes(len(r["side"]) - 1)},
    "cheaper_ways": raised}


@pytest.mark.parametrize("check", CHECKS)
def test_short_proofs_are_rejected(spark, proven, check):
    """Also for a graph where nothing is listed: what a proof leaves out is checked as well."""
    row = proven.filter("g = 100").first()
    spoiled = spark.createDataFrame([tuple((row.asDict() | SHORT_SPOILED[check](row)).values())], proven.schema)
    assert grid_flow.certificate(spoiled, KEYS, 5).first()[check] != 0


def test_proofs_of_any_width_are_checked_together(spark, proven):
    row = proven.filter("g = 100").first()
    wide = grid_flow.np.frombuffer(row["potentials"], "i2").astype("i8").tobytes()
    big = [(7, None, 7, 2, 3, 1 << 40, 1 << 39, None, None), (7, None, 7, 2, 0, 1 << 33, 0, None, None)]
    rows = [tuple(row), tuple((row.asDict() | {"potentials": wide}).values()), *map(tuple, grid_flow.solve_rows(
        spark.createDataFrame(big, ROWS), KEYS, 5, proof=True).collect())]
    checked = grid_flow.certificate(spark.createDataFrame(rows, proven.schema).coalesce(1), KEYS, 5).collect()
    assert len(checked) == 3 and all(r[c] == 0 for r in checked for c in CHECKS)
