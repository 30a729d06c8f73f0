"""Checks on incoming events, and the split into good events and dead letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscope import schemas


def event_time(stamp: Column) -> Column:
    """Point in time of an ISO text in the session's zone (UTC), zone offsets applied;
    NULL for anything else, times without a date included."""
    dated = F.regexp_like(stamp, F.lit(r"^\s*[0-9]{4,}-[0-9]{2}-[0-9]{2}"))
    return F.when(dated, F.try_to_timestamp(stamp)).cast("timestamp_ntz")


def _checks(df: DataFrame) -> list[tuple[Column, Column]]:
    """Condition of each fault with its message, in the order they are reported."""
    mode, stamp = F.col("payment_mode"), F.col("event_timestamp")
    checks = [(F.col(f).isNull(), F.lit(f"Missing required field: {f}"))
              for f in schemas.REQUIRED_EVENT_FIELDS]
    for field in ("boarding_count", "ticket_count"):
        # a count is what the stored column can hold: whole, in range, and a number at all
        number = F.col(field).try_cast("double")
        stored = number.try_cast("int")
        bad = F.col(field).isNotNull() & (stored.isNull() | (stored.cast("double") != number) | (stored < 0))
        checks.append((bad, F.lit(f"{field} must be a non-negative number")))
    checks.append(((mode != "") & ~mode.isin(schemas.PAYMENT_MODES),
                   F.concat(F.lit("Invalid payment_mode: "), mode)))
    if isinstance(df.schema["event_timestamp"].dataType, T.StringType):
        checks.append((stamp.isNotNull() & event_time(stamp).isNull(), F.lit("Invalid event_timestamp format")))
    return checks


def validate(df: DataFrame) -> DataFrame:
    """Adds errors ARRAY<STRING>, empty for a valid event, and valid BOOLEAN.

    ``valid`` is built from the plain conditions, so counting and splitting
    never build the messages.
    """
    checks = _checks(df)
    messages = F.array_compact(F.array(*[F.when(fault, text) for fault, text in checks]))
    faulty = reduce(lambda a, b: a | b, [F.coalesce(fault, F.lit(False)) for fault, _ in checks])
    return df.withColumn("errors", messages).withColumn("valid", ~faulty)


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("valid").drop("errors", "valid")


def dead_letters(validated: DataFrame) -> DataFrame:
    """Faulty events with what was sent: the text itself where it is at hand."""
    payload = [c for c in validated.columns if c not in ("errors", "valid")]
    sent = F.col("original_event") if "original_event" in payload else F.to_json(F.struct(*payload))
    return validated.filter("NOT valid").select(
        "event_id",
        sent.alias("original_event"),
        F.array_join("errors", "; ").alias("error_message"),
        F.lit("validation_error").alias("error_type"))


def ingest_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("valid").alias("succeeded"),
                         F.count_if(~F.col("valid")).alias("failed"))


def typed_events(events: DataFrame) -> DataFrame:
    """Raw events under the stored schema.  A value that does not fit becomes NULL; the
    checks above let none through in the fields they cover.  An event without a date
    gets the day of its timestamp."""
    def typed(field: T.StructField) -> Column:
        value, text = F.col(field.name), isinstance(events.schema[field.name].dataType, T.StringType)
        if field.name == "event_timestamp":
            return event_time(value) if text else value
        if text and isinstance(field.dataType, T.IntegerType):
            return value.try_cast("double").try_cast("int")
        return value.try_cast(field.dataType) if text else value.cast(field.dataType)

    columns = {f.name: typed(f) for f in schemas.TICKETING_EVENTS.fields}
    columns["sim_date"] = F.coalesce(columns["sim_date"], columns["event_timestamp"].cast("date"))
    return events.select(*[c.alias(name) for name, c in columns.items()])
