"""Plans as they would be with tables too large to broadcast."""

import pytest

from leakscope.plans import queries

SCALED = ["route_leakage", "enrich_events", "detections", "match_anomalies", "fare_lookup", "segment_stats",
          "segment_grid", "network_edges", "segment_hits", "risk_distribution", "summary_kpis", "trip_days",
          "baseline_sample", "route_search", "review_update", "apply_anomaly"]


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SCALED)
def test_no_product_of_tables(small, no_broadcast, name):
    plan = plan_of(queries.QUERIES[name](small))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BroadcastExchange" not in plan


def test_leakage_combines_before_its_only_shuffle(small):
    plan = plan_of(small.scores)
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert "partial_sum" in plan


def test_scan_reads_only_its_columns(small):
    plan = plan_of(small.scores)
    assert "l_tax" not in plan and "l_partkey" not in plan and "o_orderpriority" not in plan


def test_top_k_never_sorts_everything(small):
    plan = plan_of(queries.QUERIES["recent_anomalies"](small))
    assert "TakeOrderedAndProject" in plan
