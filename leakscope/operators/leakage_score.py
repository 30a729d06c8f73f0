"""Leakage and risk per route and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.numeric import from_cents, half_up, ladder, sum_cents

# Level, leakage percentage it starts above.
RISK_BOUNDS = [("critical", 15.0), ("high", 8.0), ("medium", 3.0)]


def risk_level(percentage: Column) -> Column:
    return ladder([(percentage > bound, level) for level, bound in RISK_BOUNDS], "low")


def route_leakage(events: DataFrame, date_col: str = "sim_date",
                  newest: int | None = None) -> DataFrame:
    """Expected and reported totals, leakage, risk and anomaly count.

    One aggregation; partial sums leave one row per task and (route, date), so
    a busy route costs no more to shuffle than a quiet one.  ``newest`` keeps
    that many route-dates, latest first.
    """
    totals = events.groupBy("route_id", F.col(date_col).alias("sim_date")).agg(
        sum_cents("expected_revenue").alias("_expected"),
        sum_cents("reported_revenue").alias("_reported"),
        F.count_if(F.col("is_anomalous") == 1).alias("anomaly_count"))
    leakage = F.col("_expected") - F.col("_reported")
    share = F.when(F.col("_expected") > 0,
                   leakage.cast("double") / F.col("_expected").cast("double") * 100.0).otherwise(0.0)
    scores = totals.withColumn("_share", share).select(
        "route_id", "sim_date", F.lit("full_day").alias("time_window"),
        from_cents("_expected").alias("expected_revenue"),
        from_cents("_reported").alias("reported_revenue"),
        from_cents(leakage).alias("leakage_amount"),
        half_up("_share", 2).alias("leakage_percentage"),
        risk_level(F.col("_share")).alias("risk_level"),
        "anomaly_count")
    if newest is None:
        return scores
    return scores.orderBy(F.desc("sim_date"), "route_id").limit(newest)
