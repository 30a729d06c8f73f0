import random

from pyspark.sql import functions as F

from leakscope.operators import nearby, network, scenario


def test_nearby_stops_against_all_pairs(spark):
    rng = random.Random(11)
    points = [(f"S{i:04d}", round(12.9 + rng.gauss(0, 0.05), 4), round(77.5 + rng.gauss(0, 0.05), 4))
              for i in range(400)]
    points += [(f"H{i:04d}", 12.91, 77.51) for i in range(150)]  # a third at one place
    points += [("FAR", -40.0, 10.0)]
    stops = spark.createDataFrame(points, "stop_id string, stop_lat double, stop_lon double")
    starts = spark.createDataFrame(
        [(f"R{i}", p[1], p[2], float(rng.randrange(360)), rng.randint(2, 30))
         for i, p in enumerate(rng.sample(points, 25) + [points[-1]])],
        "route_id string, start_lat double, start_lon double, bearing_deg double, wanted int")
    score = nearby.direction_score(F.col("start_lat"), F.col("start_lon"), F.col("stop_lat"),
                                   F.col("stop_lon"), F.col("bearing_deg"))
    want = {}
    for r in starts.crossJoin(stops).withColumn("score", score).collect():
        want.setdefault((r.route_id, r.wanted), []).append((r.score, r.stop_id))
    want = {(route, place): stop for (route, n), found in want.items()
            for place, (_, stop) in enumerate(sorted(found)[:n], 1) if place > 1}
    got = {(r.route_id, r.rank_position): r.stop_id for r in nearby.nearest_along_bearing(starts, stops).collect()}
    assert got == want


def test_no_stop_scores_below_its_cell(spark):
    rng = random.Random(5)
    rows = [(rng.uniform(-80, 80), rng.uniform(-170, 170), float(rng.randrange(-90, 400)), rng.randint(-6, 6), rng.randint(-6, 6),
             rng.random(), rng.random()) for _ in range(3000)]
    rows += [(12.9, 77.5, b, y, x, 0.5, 0.5) for b in (0.0, 90.0, 300.0) for y in range(-4, 5) for x in range(-4, 5)]
    size = 0.01
    y, x = F.floor(F.col("lat") / size) + F.col("dy"), F.floor(F.col("lon") / size) + F.col("dx")
    start = [F.col("lat"), F.col("lon")]
    df = spark.createDataFrame(rows, "lat double, lon double, bearing double, dy int, dx int, u double, v double").select(
        "*", nearby.least_score(*start, F.col("bearing"), y, x, size).alias("least"),
        nearby.direction_score(*start, (y + F.col("u")) * size, (x + F.col("v")) * size, F.col("bearing")).alias("score"))
    got = df.collect()
    assert all(r.least <= r.score for r in got)
    # the cells that may hold a stop within a score are few, not a square around the start
    near = [r for r in got[3000:] if r.bearing == 90.0]
    assert 0 < sum(r.least <= 0.5 for r in near) <= len(near) / 4


def test_first_anomaly_by_id_wins(spark):
    events = spark.createDataFrame([("R", "d", 8, 3), ("R", "d", 8, 5), ("R", "d", 11, 3), ("Q", "d", 8, 3)],
                                   "route_id string, sim_date string, sim_hour int, stop_sequence int")
    truth = spark.createDataFrame(
        [("B", "ghost_trip", "R", "d", 7, 9, 2, 6, 0.9), ("A", "under_reporting", "R", "d", 8, 10, 3, 4, 0.5)],
        "anomaly_id string, anomaly_type string, route_id string, sim_date string, time_window_start int, "
        "time_window_end int, start_stop_sequence int, end_stop_sequence int, severity double")
    got = {(r.route_id, r.sim_hour, r.stop_sequence): r.matched_anomaly_id
           for r in scenario.match_anomalies(events, truth).collect()}
    assert got == {("R", 8, 3): "A", ("R", 8, 5): "B", ("R", 11, 3): None, ("Q", 8, 3): None}


def test_effects(spark):
    kinds = ["under_reporting", "ghost_trip", "qr_upi_fraud", "qr_upi_fraud", "fare_evasion_cluster", None]
    modes = ["cash", "cash", "upi", "cash", "card", "cash"]
    df = spark.createDataFrame(
        [(i, 15, 150.0, m, k, k and 0.5, k and f"A{i}") for i, (k, m) in enumerate(zip(kinds, modes))],
        "i int, boarding_count int, expected_revenue double, payment_mode string, matched_type string, "
        "matched_severity double, matched_anomaly_id string")
    got = [(r.ticket_count, r.reported_revenue, r.is_anomalous)
           for r in scenario.apply_anomalies(df).orderBy("i").collect()]
    assert got == [(8, 75.0, 1), (1, 7.5, 1), (15, 75.0, 1), (15, 150.0, 1), (8, 75.0, 1), (15, 150.0, 0)]


def test_timetable(spark):
    routes = spark.createDataFrame(
        [("R", "K1", "A → B", "express", 50.0, 2, 4)],
        "route_id string, route_short_name string, route_long_name string, route_category string, "
        "total_distance_km double, num_stops int, trips_per_day int")
    stops = spark.createDataFrame([("R", "S1", 1, 0.0), ("R", "S2", 2, 50.0)],
                                  "route_id string, stop_id string, stop_sequence int, distance_from_start_km double")
    trips = network.trips(routes).orderBy("trip_id").collect()
    assert [t.scheduled_start for t in trips] == ["05:00:00", "09:30:00", "14:00:00", "18:30:00"]
    assert (trips[0].scheduled_end, trips[0].trip_headsign, trips[0].trip_id) == ("07:03:00", "B", "R_T001")
    times = network.stop_times(routes, stops).filter("trip_id = 'R_T001'").orderBy("stop_sequence").collect()
    assert [t.arrival_time for t in times] == ["05:00:00", "07:01:00"]


def test_onboard_load_merges_rows_of_one_stop(spark):
    df = spark.createDataFrame([("T", 1, 5, 0), ("T", 1, 2, 1), ("T", 3, 1, 4), ("U", 2, 9, 0)],
                               "trip_id string, stop_sequence int, boarding_count int, alighting_count int")
    got = {(r.trip_id, r.stop_sequence): r.on_board for r in network.onboard_load(df).collect()}
    assert got == {("T", 1): 6, ("T", 3): 3, ("U", 2): 9}
