"""Ridership factors, fares and weighted buckets as column expressions."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakscope.functions.numeric import as_col, ladder

# Hours, factor.  Hours not named have factor 1.0.
HOUR_FACTORS = [
    ((8, 9), 2.5), ((7, 7), 1.8), ((10, 10), 1.8), ((18, 19), 2.8), ((17, 17), 1.9),
    ((20, 20), 1.9), ((11, 16), 1.2), ((0, 5), 0.4), ((22, 23), 0.4)]
DAY_FACTORS = {0: 0.55, 1: 1.0, 2: 1.05, 3: 1.05, 4: 1.0, 5: 0.95, 6: 0.7}
BASE_RIDERSHIP = {"city-core": 8.0, "suburban": 5.0, "feeder": 4.0, "express": 3.0, "outer": 2.5}
DEFAULT_RIDERSHIP = 4.0
# From km, to km, fare.
FARE_SLABS = [
    (0, 2, 5), (2, 4, 10), (4, 6, 15), (6, 8, 15), (8, 10, 20),
    (10, 13, 20), (13, 16, 25), (16, 19, 25), (19, 22, 30), (22, 26, 30),
    (26, 30, 35), (30, 35, 35), (35, 40, 40), (40, 50, 45), (50, 999, 50)]
MAX_FARE = 50
# Name, weight.
ROUTE_CATEGORY_WEIGHTS = [
    ("city-core", 0.3), ("suburban", 0.3), ("feeder", 0.2), ("express", 0.1), ("outer", 0.1)]
ANOMALY_TYPE_WEIGHTS = [
    ("under_reporting", 0.35), ("ghost_trip", 0.15), ("qr_upi_fraud", 0.25),
    ("fare_evasion_cluster", 0.25)]


def lookup(key: Column | str, table: dict, default) -> Column:
    """Value for a key of a small fixed table, else the default."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.coalesce(F.create_map(*pairs)[as_col(key)], F.lit(default))


def hour_factor(hour: Column | str) -> Column:
    h = as_col(hour)
    return ladder([(h.between(lo, hi), factor) for (lo, hi), factor in HOUR_FACTORS], 1.0)


def day_factor(day_of_week: Column | str) -> Column:
    return lookup(day_of_week, DAY_FACTORS, 1.0)


def base_ridership(category: Column | str) -> Column:
    return lookup(category, BASE_RIDERSHIP, DEFAULT_RIDERSHIP)


def expected_demand(category: Column, hour: Column, day_of_week: Column, density: Column) -> Column:
    return base_ridership(category) * hour_factor(hour) * day_factor(day_of_week) * density


def fare_for(distance_km: Column | str) -> Column:
    """Fare of the fixed slab table; the top fare outside every slab."""
    d = as_col(distance_km)
    return ladder([((d >= lo) & (d < hi), fare) for lo, hi, fare in FARE_SLABS], MAX_FARE
                  ).cast("double")


def join_fares(df: DataFrame, slabs: DataFrame, distance: str = "distance_km") -> DataFrame:
    """Fare from a slab table of any size.

    Each slab is listed once per whole kilometre it touches, which turns the
    range condition into an equality on the kilometre plus a residual check.
    """
    per_km = slabs.select(
        F.explode(F.sequence(F.floor("min_distance_km"),
                             F.ceil(F.col("max_distance_km")) - 1)).alias("_km"),
        F.col("min_distance_km").alias("_lo"), F.col("max_distance_km").alias("_hi"),
        F.col("fare_amount").cast("double").alias("_fare"))
    top = slabs.agg(F.max_by(F.col("fare_amount").cast("double"), "min_distance_km"))
    d = F.col(distance)
    joined = df.withColumn("_km_of", F.floor(d)).join(
        per_km, (F.col("_km_of") == F.col("_km")) & (d >= F.col("_lo")) & (d < F.col("_hi")), "left")
    return (joined.withColumn("fare", F.coalesce(F.col("_fare"), top.scalar()))
            .drop("_km_of", "_km", "_lo", "_hi", "_fare"))


def weighted_bucket(u: Column | str, weights: list[tuple[str, float]]) -> Column:
    """First name whose running weight reaches u; the first name beyond the last."""
    x = as_col(u)
    reach = accumulate(weight for _, weight in weights)
    return ladder([(x <= r, name) for r, (name, _) in zip(reach, weights)], weights[0][0])


def payment_mode(u: Column | str) -> Column:
    """Payment mode of a draw in [0, 1); the bounds are not inclusive."""
    x = as_col(u)
    return F.when(x < 0.45, "cash").when(x < 0.75, "upi").when(x < 0.90, "card").otherwise("pass")
