"""Stops nearest to the start of a route, leaning towards its bearing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leakscope.functions.geo import EARTH_RADIUS_KM, bearing_deviation, haversine_km
from leakscope.functions.numeric import half_up
from leakscope.session import materialize

# Fixed values.
KM_WEIGHT, DEGREE_WEIGHT = 0.3, 0.01
SMALLEST_CELL_DEG = 0.0001
WHOLE_EARTH_DEG = 360.0
# Cells on each side of a start's own once its result has a bound; more of them follow
# the bound closer, but all of them are looked at for each route.
FINE = 4
# Shares of a route's reach, from which on it takes part: a nearer look lowers its bound.
EARLY = 8.0


def _cell(degrees: Column, size: float) -> Column:
    return F.floor(degrees / size)


def direction_score(lat0: Column, lon0: Column, lat: Column, lon: Column, bearing: Column) -> Column:
    """Kilometres and degrees off the bearing, weighted; nine decimals."""
    return half_up(KM_WEIGHT * haversine_km(lat0, lon0, lat, lon)
                   + DEGREE_WEIGHT * bearing_deviation(lat0, lon0, lat, lon, bearing), 9)


def _least_deviation(bearing: Column) -> Column:
    """Degrees off the bearing that no stop falls below: directions are -180 to 180, and
    nothing wraps for bearings from 0 to 360."""
    return F.when((bearing >= 0.0) & (bearing < 360.0), F.greatest(F.lit(0.0), bearing - 180.0)).otherwise(0.0)


def _reach_deg(score: Column, lat: Column, bearing: Column) -> Column:
    """Cell size in degrees that leaves nothing below a score further away."""
    far = score - DEGREE_WEIGHT * _least_deviation(bearing)
    far = F.when(far < 0.0, 0.0).otherwise(far)  # stays null without a score
    arc = far / (KM_WEIGHT * EARTH_RADIUS_KM * 0.999)
    sine = F.sin(F.least(arc, F.lit(math.pi / 2.0))) / F.cos(F.radians(lat))
    return F.when(sine >= 1.0, WHOLE_EARTH_DEG).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))))


def least_score(lat0: Column, lon0: Column, bearing: Column, y: Column, x: Column, size: float) -> Column:
    """A score that no stop in a cell falls below."""
    slack = 1e-9
    south, north = y * size - slack, (y + 1) * size + slack
    low, high = south - lat0, north - lat0
    left, right = x * size - slack - lon0, (x + 1) * size + slack - lon0
    off_lat = F.greatest(F.lit(0.0), low, -high)
    off_lon = F.greatest(F.lit(0.0), left, -right)
    turn = F.greatest(F.abs(left), F.abs(right)) <= 180.0
    shrink = F.greatest(F.lit(0.0), F.least(F.cos(F.radians(south)), F.cos(F.radians(north)))) * F.cos(F.radians(lat0))
    square = F.pow(F.sin(F.radians(F.least(off_lat, F.lit(180.0))) / 2.0), 2) + F.when(
        turn, shrink * F.pow(F.sin(F.radians(off_lon) / 2.0), 2)).otherwise(0.0)
    km = 2.0 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(square, F.lit(1.0)))) * 0.999
    corners = [F.degrees(F.atan2(a, b)) for a in (left, right) for b in (low, high)]
    # seen from the start, the cell is between two of its corners unless it lies across the south
    across = (left <= 0.0) & (right >= 0.0) & (low <= 0.0)
    least = _least_deviation(bearing)
    off = F.when(across | (bearing < 0.0) | (bearing >= 360.0), least).otherwise(
        F.greatest(least, F.least(*corners) - bearing, bearing - F.greatest(*corners)))
    return KM_WEIGHT * km + DEGREE_WEIGHT * off - 1e-6


def first_cell(sites: DataFrame, wanted: int) -> float:
    """Cell size at which nine cells hold about four times the wanted stops, from the
    number of stops and the area they cover; so a start meets as many stops in a
    large network as in a small one."""
    n, south, north, west, east = sites.agg(
        F.count("*"), F.min("stop_lat"), F.max("stop_lat"), F.min("stop_lon"), F.max("stop_lon")).first()
    if not n:
        return WHOLE_EARTH_DEG
    area = max(north - south, SMALLEST_CELL_DEG) * max(east - west, SMALLEST_CELL_DEG)
    return min(WHOLE_EARTH_DEG, max(SMALLEST_CELL_DEG, math.sqrt(4.0 * max(1, wanted) * area / (9.0 * n))))


def nearest_along_bearing(starts: DataFrame, stops: DataFrame) -> DataFrame:
    """For every route the stops after the best-scoring one, ``wanted`` - 1 of them.

    ``starts``: route_id, start_lat, start_lon, bearing_deg, wanted.
    ``stops``: stop_id, stop_lat, stop_lon; not on both sides of the 180th meridian.

    Grid cells replace the product of routes and stops.  A route looks at the
    nine cells around its start.  Once it has found enough stops, the worst of
    them bounds its result: a stop further away than that score allows cannot
    be part of it.  If the cells reach that far the result is final, else
    the route looks twice as far, at finer cells, and only at those of them that may
    hold a score within the bound; so the stops it meets lie along its bearing, and
    what it finds lowers the bound for the next look.
    """
    most = starts.agg(F.max("wanted")).first()[0] or 0
    # Stops at one place score alike, and the lower ids win.
    at_place = W.partitionBy("stop_lat", "stop_lon").orderBy("stop_id")
    sites = materialize(
        stops.select("stop_id", "stop_lat", "stop_lon")
        .withColumn("_same", F.row_number().over(at_place))
        .filter(F.col("_same") <= most).drop("_same"), "sites")
    lat0, lon0, lat, lon = (F.col(c) for c in ("start_lat", "start_lon", "stop_lat", "stop_lon"))
    bearing, bound, of_route = F.col("bearing_deg"), F.col("bound"), W.partitionBy("route_id")
    by_score = of_route.orderBy("score", "stop_id")
    waiting = materialize(starts.withColumn("bound", F.lit(None).cast("double")), "starts")
    finished, size, sides = [], first_cell(sites, most), 1
    while True:
        cell = size / sides
        steps = F.sequence(F.lit(-sides), F.lit(sides))
        reach = (waiting.select("*", F.explode(steps).alias("_dy")).select("*", F.explode(steps).alias("_dx"))
                 .select(*waiting.columns, (_cell(lat0, cell) + F.col("_dy")).alias("_y"),
                         (_cell(lon0, cell) + F.col("_dx")).alias("_x")))
        if sides > 1:
            reach = reach.filter(bound.isNull() | (
                least_score(lat0, lon0, bearing, F.col("_y"), F.col("_x"), cell) <= bound))
        placed = sites.select("*", _cell(lat, cell).alias("_y"), _cell(lon, cell).alias("_x"))
        # A difference in latitude alone is a lower bound of the distance.
        near = bound.isNull() | (F.radians(F.abs(lat - lat0)) * (EARTH_RADIUS_KM * KM_WEIGHT * 0.999) <= bound)
        ranked = (reach.join(placed, ["_y", "_x"]).filter(near)
                  .withColumn("score", direction_score(lat0, lon0, lat, lon, bearing))
                  .filter(bound.isNull() | (F.col("score") <= bound))
                  .withColumn("place", F.row_number().over(by_score))
                  .filter(F.col("place") <= most).filter(F.col("place") <= F.col("wanted"))
                  .withColumn("worst", F.when(F.count("*").over(of_route) == F.col("wanted"),
                                              F.max("score").over(of_route))))
        final = (F.lit(True) if size >= WHOLE_EARTH_DEG else
                 F.coalesce(_reach_deg(F.col("worst"), lat0, bearing) < size, F.lit(False)))
        best = materialize(ranked.select("route_id", "stop_id", "score", "place", "worst",
                                         final.alias("final")), "best")
        finished.append(best.filter("final"))
        if size >= WHOLE_EARTH_DEG:
            break
        verdict = best.filter("place = 1").select("route_id", "worst", "final")
        waiting = materialize(
            waiting.join(verdict, "route_id", "left").filter(~F.coalesce("final", F.lit(False)))
            .withColumn("bound", F.least("bound", "worst")).drop("worst", "final"), "waiting")
        left = waiting.agg(F.count("*"), F.count_if(bound.isNull()),
                           F.min(_reach_deg(bound, lat0, bearing))).first()
        if left[0] == 0:
            break
        size, sides = 2 * size, FINE
        while left[1] == 0 and size < min(left[2] / EARLY, WHOLE_EARTH_DEG):
            size *= 2
    return (reduce(DataFrame.unionByName, finished).filter("place > 1")
            .select("route_id", "stop_id", "score", F.col("place").alias("rank_position")))
