"""Great-circle geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_KM = 6371.0
CITY_CENTER = (12.9716, 77.5946)
CORE_RADIUS_KM = 5.0
SUBURBAN_RADIUS_KM = 10.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.sin(F.radians(lat2 - lat1) / 2.0)
    half_dlon = F.sin(F.radians(lon2 - lon1) / 2.0)
    chord = (half_dlat * half_dlat
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_dlon * half_dlon)
    return 2.0 * EARTH_RADIUS_KM * F.atan2(F.sqrt(chord), F.sqrt(1.0 - chord))


def destination(lat: Column, lon: Column, distance_km: Column, bearing_deg: Column
                ) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point along a bearing."""
    phi, arc, theta = F.radians(lat), distance_km / EARTH_RADIUS_KM, F.radians(bearing_deg)
    phi2 = F.asin(F.sin(phi) * F.cos(arc) + F.cos(phi) * F.sin(arc) * F.cos(theta))
    dlon = F.atan2(F.sin(theta) * F.sin(arc) * F.cos(phi),
                   F.cos(arc) - F.sin(phi) * F.sin(phi2))
    return F.degrees(phi2), lon + F.degrees(dlon)


def bearing_deviation(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                      bearing_deg: Column) -> Column:
    """Degrees between the flat direction of two points and a bearing.

    The remainder keeps the sign of its left side, so directions more than
    180 degrees below the bearing give values above 180.
    """
    direction = F.degrees(F.atan2(lon2 - lon1, lat2 - lat1))
    return F.abs((direction - bearing_deg + 180.0) % 360.0 - 180.0)


def distance_class(distance_km: Column) -> Column:
    return (F.when(distance_km < CORE_RADIUS_KM, "city-core")
            .when(distance_km < SUBURBAN_RADIUS_KM, "suburban")
            .otherwise("outer"))
