import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leakscope.operators import detect, features, ordered, selection


def test_nth_largest_is_exact(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.random(2000), np.full(700, 0.4321), [0.0, 1.0, 1e-300, 0.4321000001]])
    df = spark.createDataFrame([(float(v),) for v in values], "s double")
    descending = np.sort(values)[::-1]
    for place in (0, 1, 5, 135, 1000, 1500, len(values) - 1):
        assert selection.nth_largest(df, "s", place) == descending[place]
    assert selection.nth_largest(df, "s", len(values)) is None


@pytest.mark.parametrize("scores, fraction, want", [
    ([0.9, 0.8, 0.8, 0.1], 0.5, 0.8), ([0.9, 0.8, 0.8, 0.1], 0.0, 0.9), ([0.0, 0.0], 0.05, 0.5), ([], 0.05, 0.5)])
def test_threshold(spark, scores, fraction, want):
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    assert selection.threshold_of_rounded(df, "s", fraction).first().threshold == want


def test_sample_has_the_exact_size_and_repeats(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("k"))
    a = {r.k for r in selection.sample_rows(df, "k", 777).collect()}
    b = {r.k for r in selection.sample_rows(df.repartition(7), "k", 777).collect()}
    assert a == b and len(a) == 777
    assert selection.sample_rows(df, "k", 30000).count() == 20000
    assert a != {r.k for r in selection.sample_rows(df, "k", 777, seed=1).collect()}


def test_offsets_in_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), (-F.col("id")).alias("o"))
    got = ordered.index_in_groups(df, "g", ["o"]).collect()
    for g in range(3):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.o)
        assert [r.offset for r in mine] == list(range(len(mine)))


def test_baselines_and_scores(spark):
    rows = [("R", 9, 1, 100.0, 100.0), ("R", 9, 1, 200.0, 50.0), ("R", 10, 1, 5.0, 5.0), ("Q", 9, 1, 7.0, 0.0)]
    df = spark.createDataFrame(rows, "route_id string, sim_hour int, day_of_week int, "
                                     "expected_revenue double, reported_revenue double")
    learned = detect.baselines(df)
    b = learned.filter("route_id = 'R' and sim_hour = 9").first()
    assert (b["mean"], b["stddev"], b["n"]) == (150.0, 50.0, 2)
    got = {(r.route_id, r.expected_revenue): r for r in detect.score_against(df, learned).collect()}
    assert got["R", 200.0].z_score == 3.0 and got["R", 200.0].is_anomaly
    assert got["R", 200.0].baseline_score == 0.6
    assert got["Q", 7.0].z_score == 0.0 and not got["Q", 7.0].is_anomaly  # no spread, no score


def test_baselines_match_numpy_on_large_sums(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.random(5000) * 1e6, 2)
    df = spark.createDataFrame([("R", float(v)) for v in x], "route_id string, expected_revenue double")
    b = detect.baselines(df, ["route_id"]).first()
    assert math.isclose(b["mean"], x.mean(), rel_tol=1e-12)
    assert math.isclose(b["stddev"], x.std(), rel_tol=1e-12)


def test_place_among_many_is_bracketed(spark, monkeypatch):
    """Ties across the bracket, values beyond [0, 1], and brackets too full to list."""
    rows = spark.range(60000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7.5D WHEN id % 1000 = 1 THEN NULL ELSE cast((id * 7919) % 60000 AS double) - 30000 END AS s")
    ranked = sorted((r.s for r in rows.filter("s IS NOT NULL").collect()), reverse=True)
    for place in (0, 17, 29999, 30000, 45000, len(ranked) - 1):
        assert selection.nth_largest(rows, "s", place) == ranked[place]
    assert selection.nth_largest(rows, "s", len(ranked)) is None
    monkeypatch.setattr(selection, "EXACT", 5)
    assert selection.nth_largest(rows, "s", 12345) == ranked[12345]
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("places", "places")
    monkeypatch.setattr(selection, "EXACT", 200_000)
    selection.nth_largest(rows, "s", 500)
    assert len(jobs.getJobIdsForGroup("places")) <= 4   # two queries; AQE runs each shuffle as a job of its own
    spark.sparkContext._jsc.sc().clearJobGroup()


def test_deviation_of_own_key_as_from_stored_baselines(spark):
    """Keys that are missing or only have anomalous events or no values, and one event twice."""
    rows = [("a", 8, 1, 0, 10.0, 4.0), ("a", 8, 1, 0, 13.5, 13.5), ("a", 8, 1, 1, 99.0, 1.0), ("a", 8, 1, 1, 99.0, 1.0),
            ("b", 8, 1, 1, 5.0, 1.0), ("c", 8, 1, 0, None, 1.0), ("d", None, 1, 0, 7.0, 1.0), ("d", None, 1, 0, 9.0, 1.0),
            (None, 8, 1, 0, 7.0, 2.0), (None, 8, 1, 0, 8.0, 2.0), ("e", 8, 1, None, 8.0, 2.0), ("e", 8, 1, 0, 8.0, 2.0)]
    events = spark.createDataFrame(rows, "route_id string, sim_hour int, day_of_week int, is_anomalous int, "
                                         "expected_revenue double, reported_revenue double")
    learned = detect.baselines(detect.baseline_events(events))
    want = events.join(learned.select(*detect.BASELINE_KEYS, "stddev"), detect.BASELINE_KEYS, "left")
    found = detect.with_deviation(events)
    names = events.columns
    z = detect.z_score().alias("z")
    assert sorted(map(repr, found.select(*names, z).collect())) == sorted(map(repr, want.select(*names, z).collect()))


def test_detections_move_each_event_once(spark, small):
    """One exchange of the events for learning and scoring, and no stored baselines."""
    bare = [detect.detections(features.enrich(detect.with_deviation(small.events), small.routes, small.stops.drop(
        "route_id", "stop_sequence"))), small.detected]
    for plan in (df._jdf.queryExecution().executedPlan().toString() for df in bare):
        assert plan.count("Exchange hashpartitioning") == 1 and "baselines" not in plan
