import json

import pytest
from pyspark.sql import functions as F

from leakscope.operators import network
from leakscope.plans import jobs, views
from leakscope.sources import tables


@pytest.fixture(scope="module")
def run(spark, small, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    stop_times = network.stop_times(small.routes, small.stops)
    stops = small.stops.drop("route_id", "stop_sequence")
    events = small.events.drop("line_status", "period", "period_year")
    results = jobs.run_pipeline(spark, root, events, small.routes, stops, stop_times, small.truth)
    return root, results


def test_all_phases_succeed(run):
    _, results = run
    assert results["success"], results
    assert list(results["phases"]) == ["training", "detection", "localization", "scoring"]
    stats = results["phases"]["training"]["stats"]
    assert stats["train_samples"] + stats["test_samples"] == 6000
    assert all(0 <= stats["anomaly"][k] <= 1 for k in ("precision", "recall", "f1"))
    assert sum(stats["anomaly"][k] for k in ("tp", "fp", "tn", "fn")) == stats["test_samples"]


def test_outputs(run, spark, small):
    root, results = run
    found = tables.scan(spark, root, "detected_anomalies")
    assert found.count() == results["phases"]["detection"]["stats"]["total_detections"] > 0
    assert found.select("sim_date").distinct().count() > 7          # all days, not the newest few
    assert tables.scan(spark, root, "route_leakage_scores").count() == \
        small.events.select("route_id", "sim_date").distinct().count()
    assert tables.scan(spark, root, "flow_localization_results").count() == \
        results["phases"]["localization"]["stats"]["total_localizations"]
    logged = tables.scan(spark, root, "pipeline_runs")
    assert {r.status for r in logged.collect()} == {"success"}


def test_models_are_stored_and_load(run, spark, small):
    root, results = run
    loaded = jobs.load_models(spark, root)
    assert {"forecast", "revenue", "anomaly", "baselines"} == set(loaded)
    nodes, threshold = loaded["anomaly"]
    assert threshold == results["phases"]["training"]["stats"]["threshold"]
    assert nodes.select("tree").distinct().count() == 50
    registry = tables.scan(spark, root, "model_registry")
    assert views.latest_models(registry).count() == 3
    version = results["phases"]["training"]["stats"]["model_version"]
    report = tables.get_object(spark, root, "training-data", f"evaluation_v{version}", "text").first()[0]
    assert json.loads(report)["model_version"] == version


def test_a_rerun_replaces_its_rows(run, spark, small):
    root, _ = run
    before = tables.scan(spark, root, "detected_anomalies").count()
    events = small.events.drop("line_status", "period", "period_year")
    days = [r[0] for r in views.recent_dates(events).collect()]
    assert len(days) == 7
    jobs.detect_recent(spark, events, small.routes, small.stops.drop("route_id", "stop_sequence"),
                       jobs.load_models(spark, root)["baselines"], root, days)
    assert tables.scan(spark, root, "detected_anomalies").count() == before


def test_a_failing_phase_fails_the_run(spark, small, tmp_path):
    results = jobs.run_pipeline(spark, str(tmp_path), small.events.drop("boarding_count"), small.routes,
                                small.stops, small.stops)
    assert not results["success"] and "boarding_count" in results["error"]
    row = tables.scan(spark, str(tmp_path), "pipeline_runs").first()
    assert row.status == "failed" and row.error == results["error"]


def test_network_load_is_repeatable(spark, small, tmp_path):
    root = str(tmp_path)
    frames = {"routes": small.routes.drop("trips_per_day", "bearing_deg"),
              "stops": small.stops.drop("route_id", "stop_sequence", "distance_from_start_km"),
              "trips": network.trips(small.routes).drop("route_category", "start_minute"),
              "stop_sequences": network.stop_times(small.routes, small.stops),
              "fare_slabs": small.fare_slabs}
    for _ in range(2):
        jobs.load_network(spark, root, frames)
    for name, frame in frames.items():
        assert tables.scan(spark, root, name).count() == frame.count(), name
    assert tables.scan(spark, root, "stop_sequences").agg(F.max("stop_sequence")).first()[0] == 7
