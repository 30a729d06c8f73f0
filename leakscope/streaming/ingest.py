"""Streaming ingest: validate, set malformed events aside, deliver the rest.

Each micro-batch writes good events with an upsert on their id and bad ones to
the dead-letter table.  Offsets live in the checkpoint, so a restart replays
at most the last batch, and replayed events overwrite themselves.
"""

from __future__ import annotations

import json
import time
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from leakscope import schemas
from leakscope.functions.text import NUM_STREAM_PARTITIONS, stream_partition
from leakscope.operators import validation
from leakscope.session import delete_path, folder_names, scratch_path
from leakscope.sources import tables

FLUSH_INTERVAL = "5 seconds"
EWMA_DECAY = 0.9
KEPT_ERRORS = 100
ARRIVAL_ROWS = 1 << 20

Handler = Callable[[DataFrame, int], None]


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events as sent: the text of every field next to the whole line, so that a letter can
    quote it and a value of the wrong type is seen as what it is."""
    parsed = lines.select(F.col(value).cast("string").alias("original_event")).withColumn(
        "_e", F.from_json("original_event", schemas.SENT_EVENTS))
    return parsed.select("_e.*", "original_event")


def read_events(spark: SparkSession, path: str, fmt: str = "json",
                files_per_batch: int | None = None) -> DataFrame:
    """Raw events from a folder of files: lines of JSON, or a format with types."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "json":
        return parse_events(reader.text(path))
    return reader.schema(schemas.RAW_EVENTS).format(fmt).load(path)


def read_broker(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Raw events from a message broker keyed by route; needs the Kafka package on the class path."""
    lines = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
             .option("subscribe", topic).load())
    return parse_events(lines)


def by_route(events: DataFrame, num_partitions: int = NUM_STREAM_PARTITIONS) -> DataFrame:
    """Events with the number of their stream partition, a column to store or order by.

    Consecutive offsets inside a partition come from ``ordered.index_in_groups``;
    tasks are not tied to partitions, so one busy route does not fill one task.
    """
    return events.withColumn("partition", stream_partition("route_id", num_partitions))


def table_handler(root: str) -> Handler:
    """Stores events; a replayed id overwrites its row.  Rewrites the dates a batch
    touches, so it suits moderate rates or long intervals."""
    def store(batch: DataFrame, batch_id: int) -> None:
        typed = validation.typed_events(batch)
        tables.upsert_table(batch.sparkSession, root, "ticketing_events", typed,
                            F.struct("event_timestamp", "reported_revenue", "ticket_count"))

    return store


def landing_handler(root: str) -> Handler:
    """Adds events to the landing area, one folder per batch; a replayed batch replaces
    its own folder.  The cost of a batch does not grow with the table, which suits high
    rates; ``compact`` merges the folders later."""
    def store(batch: DataFrame, batch_id: int) -> None:
        (validation.typed_events(batch).write.mode("overwrite")
         .parquet(f"{root}/landing/ticketing_events/batch={batch_id}"))

    return store


def compact(spark: SparkSession, root: str, first_batch: int, last_batch: int) -> None:
    """Merges landed batches into the table; of several rows per id the latest batch counts."""
    schema = T.StructType([*schemas.TICKETING_EVENTS.fields, T.StructField("batch", T.LongType())])
    landed = spark.read.schema(schema).parquet(f"{root}/landing/ticketing_events").filter(
        F.col("batch").between(first_batch, last_batch))
    order = F.struct("batch", "event_timestamp", "reported_revenue", "ticket_count")
    latest = tables.latest_per_key(landed, schemas.PRIMARY_KEYS["ticketing_events"], order)
    tables.upsert_table(spark, root, "ticketing_events", latest.drop("batch"))


def archive_handler(root: str) -> Handler:
    """Keeps the payload of every good event as JSON text, by batch and date."""
    def store(batch: DataFrame, batch_id: int) -> None:
        sent = F.col("original_event") if "original_event" in batch.columns else F.to_json(F.struct(*batch.columns))
        (batch.select(sent.alias("value"), F.coalesce(
            F.col("sim_date").try_cast("date"), validation.event_time(F.col("event_timestamp")).cast("date")).alias("sim_date"))
         .write.mode("overwrite").partitionBy("sim_date").text(f"{root}/raw-data/batch={batch_id}"))

    return store


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything that has arrived, into files, and reads them back."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    (stream.writeStream.format("parquet").option("path", path)
     .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(path)


def shuffled_arrivals(events: DataFrame, key: str, batches: int = 4, file_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """The same events as a stream that brings them in an order of its own, by the hash of a
    key.  A micro-batch is as many files of about ``file_rows`` events as make that many batches,
    so more events mean more files, not larger tasks."""
    spark = events.sparkSession
    path = scratch_path(spark, "arrivals")
    files = max(1, -(-events.count() // (batches * file_rows)))
    events.repartition(batches * files, F.xxhash64(key, F.lit("arrival"))).write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(path)


def drain_latest(stream: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Runs an aggregating stream over everything that has arrived, and returns the last state
    of every key.  Each micro-batch stores the keys it changed in a folder of its own, which a
    batch that is run again replaces."""
    spark = stream.sparkSession
    path = scratch_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/batch=-1")

    def keep(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    (stream.writeStream.outputMode("update").foreachBatch(keep)
     .option("checkpointLocation", f"{path}-progress").trigger(availableNow=True)
     .start().awaitTermination())
    schema = T.StructType([*stream.schema, T.StructField("batch", T.LongType())])
    states = spark.read.schema(schema).parquet(path)
    return tables.latest_per_key(states, keys, F.col("batch")).drop("batch").select(*stream.columns)


class Ingest:
    """A micro-batch pipeline with any number of handlers and running figures."""

    def __init__(self, root: str):
        self.root = root
        self.handlers: list[Handler] = []
        self.totals = {"ingestion_total": 0, "processing_total": 0, "dead_letter_total": 0,
                       "failed_total": 0, "pending_events": 0}
        self.avg_processing_time = 0.0
        self.errors: deque[str] = deque(maxlen=KEPT_ERRORS)

    def subscribe(self, handler: Handler) -> None:
        self.handlers.append(handler)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: every handler sees every good event.  A handler that
        fails does not keep the others from running; what it missed is stored and
        given to it again, in order, before the next batch."""
        started = time.time()
        checked = validation.validate(batch).persist()
        try:
            good = validation.accepted(checked)
            counts = validation.ingest_counts(checked).first()
            (tables.conform(validation.dead_letters(checked).drop("event_id"), "dead_letter_events")
             .write.mode("overwrite")
             .parquet(f"{tables.table_path(self.root, 'dead_letter_events')}/batch={batch_id}"))
            for number, handler in enumerate(self.handlers):
                if not (self._replay(batch.sparkSession, number, handler)
                        and self._deliver(handler, good, batch_id)):
                    good.write.mode("overwrite").parquet(f"{self._missed(number)}/batch={batch_id}")
                    self.totals["failed_total"] += counts["succeeded"]
            self.totals["ingestion_total"] += counts["succeeded"]
            self.totals["processing_total"] += counts["succeeded"]
            self.totals["dead_letter_total"] += counts["failed"]
        finally:
            checked.unpersist()
        took = (time.time() - started) * 1000.0
        self.avg_processing_time = EWMA_DECAY * self.avg_processing_time + (1 - EWMA_DECAY) * took
        self.record_metrics(batch.sparkSession)

    def _missed(self, number: int) -> str:
        """Folder of the batches that a handler, by its place, has yet to take."""
        return f"{self.root}/retry/handler={number}"

    def _deliver(self, handler: Handler, batch: DataFrame, batch_id: int) -> bool:
        try:
            handler(batch, batch_id)
            return True
        except Exception as failure:
            self.errors.append(f"batch {batch_id}: {failure}")
            return False

    def _replay(self, spark: SparkSession, number: int, handler: Handler) -> bool:
        """Gives a handler what it missed, oldest first; stops where it fails again."""
        missed = sorted(int(name.split("=")[1]) for name in folder_names(spark, self._missed(number)))
        for batch_id in missed:
            path = f"{self._missed(number)}/batch={batch_id}"
            if not self._deliver(handler, spark.read.parquet(path), batch_id):
                return False
            delete_path(spark, path)
        return True

    def metrics(self) -> dict[str, float]:
        """Running figures.  A batch takes all it read, so nothing is pending between
        batches; what waits in the source is in the query's own progress."""
        return {**self.totals, "avg_processing_time": self.avg_processing_time}

    def record_metrics(self, spark: SparkSession) -> None:
        """Five rows per batch in pipeline_metrics."""
        figures = self.metrics()
        figures.pop("failed_total")
        rows = [(name, float(value), "ms" if name == "avg_processing_time" else "count", "ingestion")
                for name, value in figures.items()]
        frame = spark.createDataFrame(
            rows, "metric_name string, metric_value double, metric_unit string, service string")
        tables.append(frame.withColumn("recorded_at", F.current_timestamp()).coalesce(1),
                      self.root, "pipeline_metrics")

    def start(self, events: DataFrame, checkpoint: str, once: bool = False,
              interval: str = FLUSH_INTERVAL) -> StreamingQuery:
        """Runs every few seconds, or once over all that is there."""
        writer = (events.writeStream.foreachBatch(self.process)
                  .option("checkpointLocation", checkpoint).queryName("ticketing_ingest"))
        writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)
        return writer.start()


def stop_after_flush(query: StreamingQuery) -> None:
    """Lets the batch at hand and all arrived data finish, then stops."""
    query.processAllAvailable()
    query.stop()


class ProgressLog(StreamingQueryListener):
    """Input rows, rates and durations of each micro-batch."""

    def __init__(self):
        self.progress: list[dict] = []

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        self.progress.append(json.loads(event.progress.json))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def recent_dead_letters(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """Dead letters of the newest batches first."""
    schema = T.StructType([*schemas.DEAD_LETTER_EVENTS.fields, T.StructField("batch", T.LongType())])
    letters = spark.read.schema(schema).parquet(tables.table_path(root, "dead_letter_events"))
    return letters.orderBy(F.desc("batch"), "original_event").limit(n).drop("batch")
