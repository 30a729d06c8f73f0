"""Labels, name classes and the route hash as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leakscope.functions.numeric import as_col

# Fixed values.
HIGH_TRAFFIC_WORDS = [
    "Majestic", "Bus Station", "Market", "MG Road", "Silk Board", "Tech Park", "ITPL",
    "Electronic City", "Whitefield", "Hebbal", "Marathahalli", "Koramangala", "Indiranagar"]
MEDIUM_TRAFFIC_WORDS = [
    "Layout", "Nagar", "Road", "Circle", "Junction", "Gate", "Cross", "Main", "Colony"]
LONG_NAME_SEPARATOR = " → "
NUM_STREAM_PARTITIONS = 8


def _names_any(name: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(name, w))


def traffic_class(stop_name: Column | str) -> Column:
    name = as_col(stop_name)
    return (F.when(_names_any(name, HIGH_TRAFFIC_WORDS), "high")
            .when(_names_any(name, MEDIUM_TRAFFIC_WORDS), "medium")
            .otherwise("low"))


def window_label(start: Column, end: Column) -> Column:
    return F.concat(start.cast("string"), F.lit(":00-"), end.cast("string"), F.lit(":00"))


def clock(minutes: Column) -> Column:
    """HH:MM:00 for minutes after midnight; the hour stops at 23."""
    whole = F.floor(minutes).cast("int")
    hour = F.least(F.floor(whole / 60).cast("int"), F.lit(23))
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad((whole % 60).cast("string"), 2, "0"), F.lit(":00"))


def iso_timestamp(day: Column, hour: Column, minute: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"),
                    F.lpad(hour.cast("string"), 2, "0"), F.lit(":"),
                    F.lpad(minute.cast("string"), 2, "0"), F.lit(":00"))


def headsign(long_name: Column | str, short_name: Column | str) -> Column:
    """Terminal named after the separator, else the short name."""
    last = F.split_part(as_col(long_name), F.lit(LONG_NAME_SEPARATOR), F.lit(2))
    return F.when(last == "", as_col(short_name)).otherwise(last)


def currency_label(amount: Column | str) -> Column:
    x = as_col(amount)
    return (F.when(F.abs(x) >= 100000, F.format_string("%.1fL", x / 100000.0))
            .when(F.abs(x) >= 1000, F.format_string("%.1fK", x / 1000.0))
            .otherwise(F.format_string("%.0f", x)))


def stream_partition(route_id: Column | str, num_partitions: int = NUM_STREAM_PARTITIONS) -> Column:
    """Stable partition of a route: 31-based hash of its characters on 32 bits."""
    text = as_col(route_id)
    modulus = F.lit(1 << 32)
    unsigned = F.aggregate(
        F.sequence(F.lit(1), F.length(text)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.pmod(acc * 31 + F.ascii(F.substr(text, i, F.lit(1))), modulus))
    signed = F.when(unsigned >= (1 << 31), unsigned - modulus).otherwise(unsigned)
    return (F.when(F.length(text) == 0, F.lit(0).cast("bigint"))
            .otherwise(F.abs(signed) % num_partitions)).cast("int")
