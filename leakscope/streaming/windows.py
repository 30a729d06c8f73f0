"""Event-time windows over ticketing events, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from leakscope.functions.numeric import from_cents, sum_cents
from leakscope.session import path_exists

HOUR = "1 hour"


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("event_time", F.col("event_timestamp").cast("timestamp"))


def _hour_sums(timed: DataFrame) -> DataFrame:
    """Exact sums in cents per route and clock hour; they add up across batches."""
    return timed.groupBy("route_id", F.window("event_time", HOUR).alias("_w")).agg(
        sum_cents("expected_revenue").alias("_e"), sum_cents("reported_revenue").alias("_r"),
        F.count("*").alias("events"))


def _leakage(sums: DataFrame, start: Column) -> DataFrame:
    return sums.select(
        "route_id", start.alias("window_start"),
        from_cents("_e").alias("expected_revenue"), from_cents("_r").alias("reported_revenue"),
        from_cents(F.col("_e") - F.col("_r")).alias("leakage"), "events")


def hourly_leakage(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """Leakage per route and clock hour.  A stream names how late events may be;
    rows older than that are dropped and closed hours leave the state.  ``ClosingHours``
    keeps them."""
    timed = _timed(events)
    if watermark is not None:
        timed = timed.withWatermark("event_time", watermark)
    return _leakage(_hour_sums(timed), F.col("_w.start"))


class ClosingHours:
    """Hourly windows of a stream that close, with the rows that come too late set aside.

    An hour is closed once an event of an earlier micro-batch is ``delay`` past its end.  Rows
    of open hours are summed, one small table per micro-batch; rows of closed hours, and rows
    without a time, go to the late table as they are.  Nothing is lost: ``hours`` and ``late``
    together hold every row, and ``reconciled`` corrects closed hours by what came late.

    No state grows with the stream: a batch reads one number, the newest event time up to the
    batch before, and a batch that is run again after a failure replaces what it wrote.
    """

    SUMS = "route_id string, window_start timestamp, _e bigint, _r bigint, events bigint"

    def __init__(self, root: str, delay: str = HOUR):
        self.root = root
        self.delay = delay

    def _folder(self, kind: str, batch_id: int) -> str:
        return f"{self.root}/{kind}/batch={batch_id}"

    def _newest_before(self, spark: SparkSession, batch_id: int):
        path = self._folder("newest", batch_id - 1)
        return spark.read.schema("event_time timestamp").parquet(path).first()[0] if path_exists(spark, path) else None

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = F.lit(self._newest_before(spark, batch_id)).cast("timestamp")
        closed_until = newest - F.expr(f"INTERVAL {self.delay}")
        hour_end = F.date_trunc("hour", "event_time") + F.expr(f"INTERVAL {HOUR}")
        late = F.col("event_time").isNull() | F.coalesce(hour_end <= closed_until, F.lit(False))
        rows = _timed(batch).withColumn("_late", late).persist()
        try:
            sums = _hour_sums(rows.filter("NOT _late")).select(
                "route_id", F.col("_w.start").alias("window_start"), "_e", "_r", "events")
            sums.write.mode("overwrite").parquet(self._folder("hours", batch_id))
            (rows.filter("_late").drop("_late", "event_time")
             .write.mode("overwrite").parquet(self._folder("late", batch_id)))
            (rows.agg(F.greatest(F.max("event_time"), newest).alias("event_time"))
             .write.mode("overwrite").parquet(self._folder("newest", batch_id)))
        finally:
            rows.unpersist()

    def start(self, events: DataFrame, checkpoint: str, once: bool = False,
              interval: str = "5 seconds") -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()

    def _stored(self, spark: SparkSession, kind: str, schema: T.StructType | str) -> DataFrame:
        path = f"{self.root}/{kind}"
        if not path_exists(spark, path):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(path).drop("batch")

    def hours(self, spark: SparkSession) -> DataFrame:
        """Leakage per route and hour from the rows that came in time."""
        return self._totals(self._stored(spark, "hours", self.SUMS))

    def late(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Rows that came after their hour had closed, with the columns they were sent with."""
        return self._stored(spark, "late", schema)

    def reconciled(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        """Leakage per route and hour from all rows, late ones included."""
        late = _hour_sums(_timed(self.late(spark, schema))).select(
            "route_id", F.col("_w.start").alias("window_start"), "_e", "_r", "events")
        return self._totals(self._stored(spark, "hours", self.SUMS).unionByName(late))

    @staticmethod
    def _totals(parts: DataFrame) -> DataFrame:
        sums = parts.groupBy("route_id", "window_start").agg(
            *[F.sum(c).alias(c) for c in ("_e", "_r", "events")])
        return _leakage(sums, F.col("window_start"))
