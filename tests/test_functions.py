import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from leakscope.functions import demand, geo, numeric, text
from leakscope.operators import features, leakage_score, validation
from leakscope.plans import views


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("value, digits, want", [
    (2.5, 0, 3.0), (-2.5, 0, -2.0), (1.005, 1, 1.0), (0.12345, 4, 0.1235), (-0.05, 1, 0.0)])
def test_half_up(spark, value, digits, want):
    assert one(spark, x=numeric.half_up(F.lit(value), digits)).x == want


def test_money_is_summed_in_cents(spark):
    df = spark.createDataFrame([(0.1,), (0.2,), (0.7,)] * 1000, "x double")
    assert df.agg(numeric.sum_money("x").alias("x")).first().x == 1000.0
    assert df.filter("x > 1").agg(numeric.sum_money("x").alias("x")).first().x == 0.0


FARES = [(0.0, 5), (1.0, 5), (3.0, 10), (5.0, 15), (10.0, 20), (15.0, 25), (100.0, 50),
         (-1.0, 50), (999.0, 50), (49.99, 45), (2.0, 10)]


def test_fares(spark):
    slabs = spark.createDataFrame(
        [(float(a), float(b), float(f), "ordinary") for a, b, f in demand.FARE_SLABS],
        "min_distance_km double, max_distance_km double, fare_amount double, fare_type string")
    df = spark.createDataFrame(FARES, "distance_km double, want int")
    rows = demand.join_fares(df, slabs).withColumn("ladder", demand.fare_for("distance_km")).collect()
    assert len(rows) == len(FARES)
    assert all(r.fare == r.want == r.ladder for r in rows)


def test_fare_join_has_no_nested_loop(spark):
    slabs = spark.createDataFrame([(0.0, 2.0, 5.0)],
                                  "min_distance_km double, max_distance_km double, fare_amount double")
    df = spark.createDataFrame([(1.0,)], "distance_km double")
    plan = demand.join_fares(df, slabs)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_factors(spark):
    hours = spark.range(24).select(F.col("id").cast("int").alias("h"), demand.hour_factor(
        F.col("id").cast("int")).alias("f"))
    got = {r.h: r.f for r in hours.collect()}
    assert [got[h] for h in (9, 13, 18, 23)] == [2.5, 1.2, 2.8, 0.4]
    assert (got[6], got[21], got[5], got[7], got[20]) == (1.0, 1.0, 0.4, 1.8, 1.9)
    r = one(spark, sunday=demand.day_factor(F.lit(0)), tuesday=demand.day_factor(F.lit(2)),
            other=demand.day_factor(F.lit(9)), unknown=demand.base_ridership(F.lit("tram")))
    assert tuple(r) == (0.55, 1.05, 1.0, 4.0)


def test_haversine(spark):
    points = [F.lit(x) for x in (12.9767, 77.5713, 12.9698, 77.7500)]
    r = one(spark, far=geo.haversine_km(*points),
            same=geo.haversine_km(points[0], points[1], points[0], points[1]))
    assert 15 < r.far < 25 and r.same < 0.01


def test_destination_is_inverse_of_distance(spark):
    lat, lon = geo.destination(F.lit(12.9), F.lit(77.5), F.lit(7.5), F.lit(200.0))
    r = one(spark, km=geo.haversine_km(F.lit(12.9), F.lit(77.5), lat, lon))
    assert abs(r.km - 7.5) < 1e-9


def test_bearing_deviation_keeps_the_sign_of_the_remainder(spark):
    # direction 90, bearing 350: the remainder of -80 stays -80
    r = one(spark, d=geo.bearing_deviation(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(350.0)))
    assert abs(r.d - 260.0) < 1e-9


def _hash(route, n=8):
    h = 0
    for ch in route:
        h = (h * 31 + ord(ch)) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    return abs(h) % n


def test_stream_partition(spark):
    routes = ["", "K", "KBS-1", "R000000042", "WHF-999F", "x" * 60]
    df = spark.createDataFrame([(r,) for r in routes], "route_id string")
    got = {r.route_id: r.p for r in df.withColumn("p", text.stream_partition("route_id")).collect()}
    assert got == {r: _hash(r) for r in routes}


@pytest.mark.parametrize("amount, want", [
    (250000.0, "2.5L"), (-150000.0, "-1.5L"), (1500.0, "1.5K"), (999.0, "999"), (0.0, "0")])
def test_currency_label(spark, amount, want):
    assert one(spark, x=text.currency_label(F.lit(amount))).x == want


def test_clock_and_labels(spark):
    r = one(spark, a=text.clock(F.lit(605.9)), b=text.clock(F.lit(1500.0)),
            w=text.window_label(F.lit(9), F.lit(10)),
            h=text.headsign(F.lit("A → B"), F.lit("K1")), s=text.headsign(F.lit("A"), F.lit("K1")))
    assert tuple(r) == ("10:05:00", "23:00:00", "9:00-10:00", "B", "K1")


def test_traffic_class(spark):
    names = {"Silk Board": "high", "Old Market": "high", "HSR Layout": "medium", "Hoodi": "low"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.c for r in df.withColumn("c", text.traffic_class("n")).collect()} == names


def test_weighted_bucket(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.31,), (0.85,), (1.0,), (1.5,)], "u double")
    got = [r.c for r in df.select(demand.weighted_bucket("u", demand.ROUTE_CATEGORY_WEIGHTS).alias("c")).collect()]
    # beyond the last running weight the first name counts
    assert got == ["city-core", "city-core", "suburban", "express", "outer", "city-core"]


EVENT = dict(
    event_id="ev-0417", trip_id="night-3", route_id="N12", stop_id="quay", event_timestamp="2031-08-19T22:41:00",
    boarding_count=17, ticket_count=14, expected_revenue=212.5, reported_revenue=175.0, payment_mode="upi")
RAW = ("event_id string, trip_id string, route_id string, stop_id string, event_timestamp string, "
       "boarding_count int, ticket_count int, expected_revenue double, reported_revenue double, "
       "payment_mode string")


@pytest.mark.parametrize("change, errors", [
    ({}, []),
    ({k: None for k in EVENT}, [f"Missing required field: {k}" for k in EVENT if k != "payment_mode"]),
    ({"payment_mode": "bitcoin"}, ["Invalid payment_mode: bitcoin"]),
    ({"payment_mode": None}, []),
    ({"payment_mode": ""}, []),
    ({"boarding_count": -1}, ["boarding_count must be a non-negative number"]),
    ({"ticket_count": -1, "event_timestamp": "not a date"},
     ["ticket_count must be a non-negative number", "Invalid event_timestamp format"]),
    ({"event_timestamp": ""}, ["Invalid event_timestamp format"]),
    ({"event_timestamp": "10:00"}, ["Invalid event_timestamp format"]),
    ({"event_timestamp": "2031-08-19T22:41:00+05:30"}, [])])
def test_event_validation(spark, change, errors):
    row = spark.createDataFrame([Row(**{**EVENT, **change})], RAW)
    got = validation.validate(row).first()
    assert got.errors == errors and got.valid == (not errors)


def test_zone_offsets_count(spark):
    df = spark.createDataFrame([("2031-08-19T22:41:00+05:30",), ("2031-08-19T22:41:00Z",), ("2031-08-19",), ("",), ("10:00",)],
                               "t string")
    got = [str(r.t) for r in df.select(validation.event_time(F.col("t")).alias("t")).collect()]
    assert got == ["2031-08-19 17:11:00", "2031-08-19 22:41:00", "2031-08-19 00:00:00", "None", "None"]


@pytest.mark.parametrize("count, good", [
    ("many", False), ("1000000000000", False), ("NaN", False), ("2.7", False), ("-1", False), ("Infinity", False), ("", False),
    ("12", True), ("3.0", True), ("0", True), ("2147483647", True), ("2147483648", False)])
def test_counts_given_as_text(spark, count, good):
    """Only what a whole-number column can hold is let through."""
    df = spark.createDataFrame([Row(**{**EVENT, "boarding_count": count})],
                               RAW.replace("boarding_count int", "boarding_count string"))
    assert validation.validate(df).first().errors == ([] if good else ["boarding_count must be a non-negative number"])


@pytest.mark.parametrize("count, good", [(2.0, True), (2.7, False), (1e12, False), (float("nan"), False)])
def test_counts_given_as_doubles(spark, count, good):
    df = spark.createDataFrame([Row(**{**EVENT, "ticket_count": count})], RAW.replace("ticket_count int", "ticket_count double"))
    assert validation.validate(df).first().valid == good


def test_features(spark):
    event = spark.createDataFrame([Row(
        event_id="ev-9", sim_hour=8, day_of_week=3, route_category="city-core", stop_sequence=11,
        boarding_density=3.5, boarding_count=40, expected_revenue=640.0, reported_revenue=560.0,
        ticket_count=30, route_id="N12", trip_id="night-3", stop_id="quay", sim_date=dt.date(2031, 8, 20),
        is_anomalous=0, anomaly_id=None)],
        "event_id string, sim_hour int, day_of_week int, route_category string, stop_sequence int, "
        "boarding_density double, boarding_count int, expected_revenue double, reported_revenue double, "
        "ticket_count int, route_id string, trip_id string, stop_id string, sim_date date, "
        "is_anomalous int, anomaly_id string")
    f = features.engineer(event).first()
    assert (f.is_peak_morning, f.is_weekend, f.route_category_num) == (1, 0, 0)
    assert (f.revenue_ratio, f.ticket_ratio, f.revenue_gap) == (0.875, 0.75, 80.0)
    assert -1 <= f.hour_sin <= 1
    changed = event.withColumns({"route_category": F.lit("tram"), "expected_revenue": F.lit(0.0),
                                 "boarding_count": F.lit(0), "boarding_density": F.lit(None).cast("double")})
    f = features.engineer(changed).first()
    assert (f.route_category_num, f.revenue_ratio, f.ticket_ratio, f.boarding_density) == (2, 1.0, 1.0, 1.0)


def test_risk_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (3.0, 3.01, 8.0, 8.01, 15.0, 15.01)], "p double")
    got = [r.r for r in df.select(leakage_score.risk_level(F.col("p")).alias("r")).collect()]
    assert got == ["low", "medium", "medium", "high", "high", "critical"]


def test_route_leakage_without_revenue(spark):
    df = spark.createDataFrame([("R", dt.date(2024, 1, 1), 0.0, 0.0, 0)],
                               "route_id string, sim_date date, expected_revenue double, "
                               "reported_revenue double, is_anomalous int")
    row = leakage_score.route_leakage(df).first()
    assert (row.leakage_percentage, row.risk_level, row.anomaly_count) == (0.0, "low", 0)


def test_dynamic_filters(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string")
    assert df.filter(views.all_of([None, None])).count() == 2
    assert df.filter(views.all_of([F.col("x") > 1, None, F.col("y") == "b"])).count() == 1
