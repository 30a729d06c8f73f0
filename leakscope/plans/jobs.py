"""Training, and the full run: train, detect, localize, validate, score, log."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from leakscope.operators import (detect, features, forecast, forest, leakage_score,
                                 localize, network)
from leakscope.plans import views
from leakscope.session import job_scratch, materialize
from leakscope.sources import tables

TARGETS = {"forecast": "boarding_count", "revenue": "expected_revenue"}


def network_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    return {name: tables.scan(spark, root, name)
            for name in ("routes", "stops", "stop_sequences", "ticketing_events")}


def load_network(spark: SparkSession, root: str, frames: dict[str, DataFrame]) -> None:
    """Upserts routes, stops, trips, stop sequences and fares."""
    for name, frame in frames.items():
        tables.upsert_table(spark, root, name, frame)


def _side_by_side(spark: SparkSession, tasks: list) -> list:
    """Independent Spark jobs at the same time."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        started = [pool.submit(inheritable_thread_target(spark)(t)) for t in tasks]
        return [f.result() for f in started]


def train(spark: SparkSession, events: DataFrame, routes: DataFrame, stops: DataFrame,
          root: str | None = None, seed: int = 42, sample_size: int = forest.SAMPLE_SIZE) -> dict:
    """Fits and evaluates all models; stores them when given a root.

    The events are read for the split date, once for the features of the training
    rows, which are written out, and once for the evaluation.  The boosted trees
    only ever see cells made from the features, the forest its samples.
    """
    started = time.time()
    with job_scratch(spark, "train"):
        return _train(spark, events, routes, stops, root, seed, sample_size, started)


def _train(spark: SparkSession, events: DataFrame, routes: DataFrame, stops: DataFrame, root: str | None,
           seed: int, sample_size: int, started: float) -> dict:
    last = forecast.last_train_date(events)
    if last is None:
        raise ValueError("no training data: the events cover fewer than two dates")
    rows = features.engineer(features.enrich(events, routes, stops))
    used = {"event_id", "is_anomalous", *TARGETS.values(), *features.FORECAST_FEATURES, *features.ANOMALY_FEATURES}
    train_rows = materialize(rows.filter(F.col("sim_date") <= F.lit(last)).select(
        *[c for c in rows.columns if c in used]), "features")
    test_rows = rows.filter(F.col("sim_date") > F.lit(last))
    cells = materialize(forecast.training_cells(train_rows, list(TARGETS.values())), "cells")
    normal = train_rows.filter(F.coalesce(F.col("is_anomalous"), F.lit(0)) == 0)

    def fit_anomaly() -> tuple[DataFrame, float]:
        nodes = materialize(forest.fit_forest(normal, sample_size=sample_size, seed=seed), "forest")
        return nodes, forest.forest_threshold(normal, nodes, sample_size)

    boarding, revenue, (nodes, threshold) = _side_by_side(spark, [
        lambda: forecast.fit_boosted_trees(cells, TARGETS["forecast"], seed),
        lambda: forecast.fit_boosted_trees(cells, TARGETS["revenue"], seed),
        fit_anomaly])

    # Both models are judged in one pass over the test rows.
    scored = forest.label_outliers(
        forest.score_forest(forecast.predict(boarding, test_rows), nodes, sample_size), threshold)
    # an event without a label counts as normal, as it does in training
    label, flag = F.coalesce("is_anomalous", F.lit(0)) == 1, F.col("is_outlier") == 1
    error = F.col("boarding_count") - F.col("predicted")
    sums = scored.agg(
        F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.count("*").alias("n"),
        F.count_if(flag & label).alias("tp"), F.count_if(flag & ~label).alias("fp"),
        F.count_if(~flag & ~label).alias("tn"), F.count_if(~flag & label).alias("fn")).first()
    quality = _quality(sums)
    report = {
        "model_version": int(time.time() * 1000),
        "train_samples": int(cells.agg(F.sum("weight")).first()[0] or 0), "test_samples": sums["n"],
        "forecast": {"rmse": (sums["mse"] or 0.0) ** 0.5, "mae": sums["mae"] or 0.0},
        "anomaly": quality, "threshold": threshold}
    report["total_time_ms"] = int((time.time() - started) * 1000)
    if root is not None:
        learned = detect.baselines(detect.baseline_events(events))
        save_models(spark, root, report, {"forecast": boarding, "revenue": revenue}, nodes, learned)
    return report


def _quality(counts) -> dict:
    tp, fp, fn = counts["tp"], counts["fp"], counts["fn"]
    precision = tp / (tp + fp) if tp + fp else 0.0
    recall = tp / (tp + fn) if tp + fn else 0.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"precision": precision, "recall": recall, "f1": f1,
            **{k: counts[k] for k in ("tp", "fp", "tn", "fn")}}


def save_models(spark: SparkSession, root: str, report: dict, boosted: dict, nodes: DataFrame,
                learned: DataFrame) -> None:
    """Models, their registry rows, and the evaluation report."""
    version = report["model_version"]
    entries = []
    for kind, model in boosted.items():
        path = f"{root}/models/{kind}_v{version}"
        model.write().overwrite().save(path)
        entries.append((f"{kind}_v{version}", kind, version, report["forecast"], path, 1))
    path = f"{root}/models/anomaly_v{version}"
    nodes.withColumn("threshold", F.lit(report["threshold"])).write.mode("overwrite").parquet(path)
    anomaly = {k: float(v) for k, v in report["anomaly"].items()}
    entries.append((f"anomaly_v{version}", "anomaly", version, anomaly, path, 1))
    learned.write.mode("overwrite").parquet(f"{root}/models/baselines_v{version}")
    registry = spark.createDataFrame(
        entries, "model_id string, model_type string, version bigint, metrics map<string,double>, "
                 "model_path string, is_active int")
    tables.append(registry.coalesce(1), root, "model_registry")
    line = spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1)
    tables.put_object(line, root, "training-data", f"evaluation_v{version}", "text")


def load_models(spark: SparkSession, root: str) -> dict:
    """Newest active model of each type, the forest as its node table and threshold."""
    newest = views.latest_models(tables.scan(spark, root, "model_registry"))
    found = {r["model_type"]: r for r in newest.collect()}  # one row per type
    out: dict = {kind: GBTRegressionModel.load(found[kind]["model_path"])
                 for kind in TARGETS if kind in found}
    if "anomaly" in found:
        nodes = spark.read.parquet(found["anomaly"]["model_path"])
        out["anomaly"] = (nodes.drop("threshold"), nodes.select("threshold").first()[0])
        out["baselines"] = spark.read.parquet(
            f"{root}/models/baselines_v{found['anomaly']['version']}")
    return out


def detect_recent(spark: SparkSession, events: DataFrame, routes: DataFrame, stops: DataFrame,
                  learned: DataFrame, root: str, days: list) -> dict:
    """Flags the events of the given days and upserts them into the review queue."""
    with job_scratch(spark, "detect"):
        return _detect(spark, events.filter(F.col("sim_date").isin(days)), routes, stops, learned, root, len(days))


def _detect(spark: SparkSession, recent: DataFrame, routes: DataFrame, stops: DataFrame, learned: DataFrame,
            root: str, days: int) -> dict:
    detected = detect.detections(features.enrich(recent, routes, stops), learned)
    seen = Observation("detections")
    watched = detected.observe(seen, F.count_if("is_flagged").alias("detections"),
                               F.count("*").alias("events"))
    found = materialize(detect.anomaly_records(watched), "detections")
    tables.upsert_table(spark, root, "detected_anomalies", found)
    return {"total_detections": seen.get["detections"], "days_processed": days}


def localize_recent(spark: SparkSession, events: DataFrame, stop_order: DataFrame, root: str,
                    days: list, truth: DataFrame | None = None, windows=localize.HOURLY_WINDOWS,
                    k: int = 5) -> dict:
    """Ranks the segments of the given days, stores them, and checks them against labels,
    day by day and in all."""
    with job_scratch(spark, "localize"):
        return _localize(spark, events, stop_order, root, days, truth, windows, k)


def _localize(spark: SparkSession, events: DataFrame, stop_order: DataFrame, root: str, days: list,
              truth: DataFrame | None, windows, k: int) -> dict:
    located = materialize(localize.localize(events.filter(F.col("sim_date").isin(days)), stop_order,
                                            windows=windows), "located")
    stored = located.select(*[c for c in located.columns if c not in (
        "time_window_start", "time_window_end", "flow_units", "flow_cost")])
    tables.overwrite(stored, root, "flow_localization_results")
    stats = {"total_localizations": located.count()}
    if truth is not None:
        hits = localize.localization_hits(located, truth.filter(F.col("sim_date").isin(days)), k)
        # one row per calendar day
        per_day = localize.localization_accuracy(hits, k, by="sim_date").orderBy("sim_date").collect()
        found, total = (sum(r[c] for r in per_day) for c in ("hits", "total"))
        stats["validation"] = {"hits": found, "total": total, "accuracy": found / total if total else 0.0, "top_k": k}
        stats["validation_by_date"] = {str(r["sim_date"]): r["accuracy"] for r in per_day}
    return stats


def run_pipeline(spark: SparkSession, root: str, events: DataFrame, routes: DataFrame,
                 stops: DataFrame, stop_sequences: DataFrame, truth: DataFrame | None = None,
                 windows=localize.HOURLY_WINDOWS, detect_days: int | None = None,
                 localize_days: int | None = None, newest: int | None = None) -> dict:
    """All phases over the given tables; results below ``root``.

    All days are detected and localized and all route-dates scored; ``detect_days``
    and ``localize_days`` keep to so many newest days, ``newest`` to so many
    newest route-dates.  A phase that fails ends the run, which is logged as failed with the error.
    """
    run = f"run-{int(time.time() * 1000)}"
    results: dict = {"run_id": run, "phases": {}, "success": True}
    log, state = [], {}

    def days(n: int | None) -> list:
        if "days" not in state:       # one value per calendar day
            state["days"] = [r[0] for r in views.recent_dates(events, None).collect()]
        return state["days"][:n]

    phases = {
        "training": lambda: train(spark, events, routes, stops, root),
        "detection": lambda: detect_recent(spark, events, routes, stops,
                                           load_models(spark, root)["baselines"], root,
                                           days(detect_days)),
        "localization": lambda: localize_recent(
            spark, events, network.route_stop_order(stop_sequences), root, days(localize_days),
            truth, windows),
        "scoring": lambda: _store_scores(spark, events, root, newest),
    }
    begun = time.time()
    for name, phase in phases.items():
        started = time.time()
        try:
            stats, status, error = phase(), "success", None
        except Exception as failure:
            stats, status, error = {}, "failed", f"{type(failure).__name__}: {failure}"
        took = int((time.time() - started) * 1000)
        results["phases"][name] = {"time_ms": took, "status": status, "stats": stats}
        log.append((run, name, status, took, json.dumps(stats, default=str), error))
        if error is not None:
            results.update(success=False, error=error)
            break
    results["total_time_ms"] = int((time.time() - begun) * 1000)
    frame = spark.createDataFrame(
        log, "run_id string, phase string, status string, time_ms bigint, stats string, error string")
    tables.append(frame.coalesce(1), root, "pipeline_runs")
    return results


def _store_scores(spark: SparkSession, events: DataFrame, root: str, newest: int | None) -> dict:
    with job_scratch(spark, "scores"):
        scores = materialize(leakage_score.route_leakage(events, newest=newest), "scores")
        tables.overwrite(scores, root, "route_leakage_scores")
        return {"route_dates": scores.count()}


def monitoring(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Recent metrics, number of dead letters, active models."""
    letters = spark.read.parquet(tables.table_path(root, "dead_letter_events"))
    return {
        "recent_metrics": views.recent_metrics(tables.scan(spark, root, "pipeline_metrics")),
        "dead_letters": letters.agg(F.count("*").alias("cnt")),
        "active_models": views.active_models(tables.scan(spark, root, "model_registry"))}
