import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakscope import schemas
from leakscope.operators import detect, network, validation
from leakscope.sources import tables
from leakscope.streaming import ingest, onboard, scoring, windows

EVENTS = schemas.TICKETING_EVENTS


def run(frame, path, mode="append"):
    """Drains a stream into a memory table and returns its rows."""
    name = f"t{abs(hash(str(path))) % 10**9}"
    query = (frame.writeStream.format("memory").queryName(name).outputMode(mode)
             .option("checkpointLocation", str(path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination()
    return frame.sparkSession.table(name).collect()


def write_in_order(df, path, parts=3, fmt="json"):
    """Files in time order, one write each."""
    rows = df.orderBy("event_timestamp", "event_id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        (df.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
         .write.mode("append").format(fmt).save(str(path)))


@pytest.fixture(scope="module")
def raw(small):
    return small.raw_events.filter("route_id in ('R000000001', 'R000000002')").persist()


def test_ingest_equals_batch(spark, raw, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    write_in_order(raw, source)
    pipe, seen = ingest.Ingest(root), []
    pipe.subscribe(ingest.table_handler(root))
    pipe.subscribe(lambda batch, n: (_ for _ in ()).throw(RuntimeError("broken")))
    pipe.subscribe(lambda batch, n: seen.append(batch.count()))
    pipe.subscribe(ingest.archive_handler(root))
    log = ingest.ProgressLog()
    spark.streams.addListener(log)
    pipe.start(ingest.read_events(spark, str(source), files_per_batch=1), str(tmp_path / "cp"),
               once=True).awaitTermination()
    spark.streams.removeListener(log)
    checked = validation.validate(raw)
    counts = validation.ingest_counts(checked).first()
    stored = tables.scan(spark, root, "ticketing_events")
    assert stored.count() == checked.filter("valid").select("event_id").distinct().count()
    letters = spark.read.parquet(f"{root}/dead_letter_events")
    assert letters.count() == counts.failed > 0
    assert letters.filter("error_message = 'Invalid payment_mode: voucher'").count() > 0
    assert letters.filter("original_event NOT LIKE '{%}'").isEmpty()
    assert sum(seen) == counts.succeeded  # the broken handler stopped nobody
    assert spark.read.text(f"{root}/raw-data").count() == counts.succeeded
    assert len(list((tmp_path / "out" / "retry" / "handler=1").glob("batch=*"))) == 3
    totals = pipe.metrics()
    assert totals["ingestion_total"] == counts.succeeded and totals["dead_letter_total"] == counts.failed
    assert totals["failed_total"] == counts.succeeded and len(pipe.errors) == 3
    assert totals["avg_processing_time"] > 0
    assert tables.scan(spark, root, "pipeline_metrics").count() == 3 * 5
    assert ingest.recent_dead_letters(spark, root).count() == min(10, counts.failed)
    # a restart from the same checkpoint finds nothing new
    again = ingest.Ingest(root)
    again.start(ingest.read_events(spark, str(source), files_per_batch=1), str(tmp_path / "cp"),
                once=True).awaitTermination()
    assert again.totals["ingestion_total"] == 0


def test_a_batch_with_bad_lines_keeps_its_good_ones(spark, tmp_path):
    good = {"event_id": "g1", "trip_id": "T", "route_id": "R", "stop_id": "S", "event_timestamp": "2030-05-06T07:30:00+02:00",
            "boarding_count": 3, "ticket_count": 2, "expected_revenue": 10.5, "reported_revenue": 7.0}
    import json
    sent = [json.dumps(good), json.dumps({**good, "event_id": "g2", "event_timestamp": "2030-05-06T23:30:00-02:00"}),
            json.dumps({**good, "event_id": "b1", "event_timestamp": ""}),
            json.dumps({**good, "event_id": "b2", "event_timestamp": "10:00"}),
            json.dumps({**good, "event_id": "b3", "boarding_count": "many"}), "{broken", "null"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(sent))
    root = str(tmp_path / "out")
    pipe = ingest.Ingest(root)
    pipe.subscribe(ingest.table_handler(root))
    pipe.start(ingest.read_events(spark, str(tmp_path / "in")), str(tmp_path / "cp"), once=True).awaitTermination()
    stored = {r.event_id: (str(r.event_timestamp), str(r.sim_date), r.boarding_count, r.expected_revenue)
              for r in tables.scan(spark, root, "ticketing_events").collect()}
    assert stored == {"g1": ("2030-05-06 05:30:00", "2030-05-06", 3, 10.5), "g2": ("2030-05-07 01:30:00", "2030-05-07", 3, 10.5)}
    letters = {r.original_event: r.error_message for r in spark.read.parquet(f"{root}/dead_letter_events").collect()}
    assert set(letters) == set(sent[2:])
    assert letters[sent[4]] == "boarding_count must be a non-negative number"
    assert letters[sent[2]] == letters[sent[3]] == "Invalid event_timestamp format"


def test_a_failed_handler_gets_its_batches_again(spark, raw, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    write_in_order(raw, source)
    seen, calls = [], []

    def shaky(batch, batch_id):
        calls.append(batch_id)
        if len(calls) == 1:
            raise RuntimeError("busy")
        seen.append((batch_id, batch.count()))

    pipe = ingest.Ingest(root)
    pipe.subscribe(shaky)
    pipe.start(ingest.read_events(spark, str(source), files_per_batch=1), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [n for n, _ in seen] == [0, 1, 2]
    assert sum(n for _, n in seen) == pipe.metrics()["ingestion_total"]
    assert not list((tmp_path / "out" / "retry" / "handler=0").glob("batch=*"))


def test_landing_and_compaction_equal_the_direct_upsert(spark, raw, tmp_path):
    checked = validation.accepted(validation.validate(raw)).persist()
    changed = checked.filter("ticket_count > 10").withColumn("reported_revenue", F.lit(1.0))
    direct, landed = str(tmp_path / "direct"), str(tmp_path / "landed")
    for n, batch in enumerate([checked, changed]):
        for _ in range(2):  # the second write is a replay
            ingest.landing_handler(landed)(batch, n)
        typed = validation.typed_events(batch)
        tables.upsert_table(spark, direct, "ticketing_events", typed, F.struct("event_timestamp"))
    ingest.compact(spark, landed, 0, 1)
    a, b = (tables.scan(spark, root, "ticketing_events") for root in (direct, landed))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() > 0
    assert b.filter("reported_revenue = 1.0").count() == changed.select("event_id").distinct().count()


def test_graceful_stop_finishes_what_arrived(spark, raw, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    write_in_order(raw.limit(50), source, 1)
    pipe = ingest.Ingest(root)
    query = pipe.start(ingest.read_events(spark, str(source)), str(tmp_path / "cp"), interval="1 second")
    ingest.stop_after_flush(query)
    assert not query.isActive and pipe.totals["ingestion_total"] + pipe.totals["dead_letter_total"] == 50


def stream_of(spark, path, schema, fmt="parquet"):
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).format(fmt).load(str(path)))


def event(i, stamp, **more):
    base = dict(event_id=f"e{i}", trip_id="T", route_id="R", stop_id="S", stop_sequence=1,
                event_timestamp=stamp, sim_date=stamp.date(), sim_hour=stamp.hour, day_of_week=1,
                boarding_count=3, alighting_count=1, ticket_count=3, payment_mode="cash",
                expected_revenue=10.0, reported_revenue=8.0, is_anomalous=0, anomaly_id=None)
    return tuple({**base, **more}[f.name] for f in EVENTS.fields)


def at(hour, minute=0):
    return dt.datetime(2024, 1, 1, hour, minute)


def write_batches(spark, path, batches):
    """One file per batch, with rising times so that the stream reads them in order."""
    import os
    for n, batch in enumerate(batches):
        part = path / f"b{n}"
        spark.createDataFrame(batch, EVENTS).coalesce(1).write.parquet(str(part))
        for f in part.glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 10,) * 2)
    return str(path / "*")


def test_windows_close_and_drop_late_rows(spark, tmp_path):
    batches = [[event(1, at(8)), event(2, at(8, 30))], [event(3, at(12))], [event(5, at(12, 5))],
               [event(4, at(8, 45))], [event(6, at(20))], [event(7, at(23))]]
    source = write_batches(spark, tmp_path / "in", batches)
    rows = run(windows.hourly_leakage(stream_of(spark, source, EVENTS), "1 hour"), tmp_path)
    got = {str(r.window_start): (r.events, r.expected_revenue, r.leakage) for r in rows}
    # e4 came after its hour had closed; the last hour is still open
    assert got["2024-01-01 08:00:00"] == (2, 20.0, 4.0)
    assert got["2024-01-01 12:00:00"] == (2, 20.0, 4.0)
    assert "2024-01-01 23:00:00" not in got


def test_duplicates_within_the_watermark(spark, tmp_path):
    batches = [[event(1, at(8)), event(2, at(8))], [event(1, at(8)), event(3, at(8, 10))]]
    source = write_batches(spark, tmp_path / "in", batches)
    rows = run(scoring.once_per_event(stream_of(spark, source, EVENTS)), tmp_path)
    assert sorted(r.event_id for r in rows) == ["e1", "e2", "e3"]


def test_scoring_a_stream_equals_the_batch(spark, small, tmp_path):
    arrived = validation.accepted(validation.validate(small.raw_events))
    events = validation.typed_events(arrived).filter("route_id = 'R000000003'").persist()
    write_in_order(events, tmp_path / "in", 2, "parquet")
    stops = small.stops.select("stop_id", "boarding_density")
    learned = small.learned.persist()
    stream = scoring.score_stream(stream_of(spark, tmp_path / "in", EVENTS), small.routes, stops, learned)
    got = {r.event_id: r.anomaly_score for r in run(stream, tmp_path)}
    want = {r.event_id: r.anomaly_score for r in small.detected.filter("route_id = 'R000000003'").collect()}
    assert got == {k: want[k] for k in got} and len(got) > 0.7 * len(want)
    assert detect.flagged(small.detected).count() > 0


def test_onboard_state_equals_the_window(spark, tmp_path):
    plan = [(1, at(8, 0), 5, 0), (2, at(8, 10), 4, 1), (3, at(8, 20), 2, 3), (4, at(8, 30), 0, 4)]
    rows = [event(i, t, stop_sequence=i, boarding_count=b, alighting_count=a) for i, t, b, a in plan]
    last = event(99, at(23), trip_id="END")
    source = write_batches(spark, tmp_path / "in", [rows[:2], rows[2:], [last], [event(100, at(23, 59), trip_id="END2")]])
    got = {r.stop_sequence: r.on_board for r in run(onboard.onboard_stream(
        stream_of(spark, source, EVENTS), "1 minute"), tmp_path) if r.trip_id == "T"}
    want = {r.stop_sequence: r.on_board for r in network.onboard_load(
        spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == want


def test_onboard_corrects_stops_that_come_late(spark, tmp_path):
    """Stops against their order, one stop twice, missing counts, and a trip's rows in one batch each."""
    plan = [(3, 2, 3), (1, 5, 0), (4, 0, None), (2, 4, 1), (1, 2, 0), (None, 9, 9)]
    rows = [event(n, at(8, n), stop_sequence=s, boarding_count=b, alighting_count=a) for n, (s, b, a) in enumerate(plan)]
    other = [event(50, at(9), trip_id=None, stop_sequence=2), event(51, at(9), trip_id="U", stop_sequence=7)]
    source = write_batches(spark, tmp_path / "in", [rows[:1], [rows[1], *other], rows[2:4], rows[4:]])
    given = run(onboard.onboard_stream(stream_of(spark, source, EVENTS), None), tmp_path)
    trip = [(r.stop_sequence, r.on_board, r.corrected) for r in given if r.trip_id == "T"]
    assert sorted(trip[:1]) == [(3, -1, False)]
    assert sorted(trip[1:3]) == [(1, 5, False), (3, 4, True)]
    assert sorted(trip[3:6]) == [(2, 8, False), (3, 7, True), (4, 7, False)]
    assert sorted(trip[6:]) == [(1, 7, True), (2, 10, True), (3, 9, True), (4, 9, True)]
    assert {(r.trip_id, r.stop_sequence, r.on_board) for r in given if r.trip_id != "T"} == {(None, 2, 2), ("U", 7, 2)}


def test_rows_of_closed_hours_are_set_aside(spark, tmp_path):
    batches = [[event(1, at(8)), event(2, at(8, 30))], [event(3, at(12))],
               [event(4, at(8, 45)), event(5, at(12, 5)), event(6, at(11, 59))],
               [event(7, at(10, 59), route_id="Q"), event(8, at(11)), event(9, at(13))]]
    source = write_batches(spark, tmp_path / "in", batches)
    hours = windows.ClosingHours(str(tmp_path / "out"))
    assert hours.hours(spark).count() == hours.late(spark, EVENTS).count() == 0
    stream = stream_of(spark, source, EVENTS)
    hours.start(stream, str(tmp_path / "cp"), once=True).awaitTermination()
    assert sorted(r.event_id for r in hours.late(spark, EVENTS).collect()) == ["e4", "e7"]
    counted = {(r.route_id, r.window_start.hour): r.events for r in hours.hours(spark).collect()}
    assert counted == {("R", 8): 2, ("R", 11): 2, ("R", 12): 2, ("R", 13): 1}
    everything = spark.createDataFrame([e for b in batches for e in b], EVENTS)

    def same():
        return rows_of(hours.reconciled(spark, EVENTS)) == rows_of(windows.hourly_leakage(everything))

    assert same()
    # a batch that is run again, after a failure, replaces what it wrote
    hours.process(spark.createDataFrame(batches[2], EVENTS), 2)
    assert same() and hours.late(spark, EVENTS).count() == 2


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_partition_column(spark, raw):
    numbers = {r.partition for r in ingest.by_route(raw).select("partition").distinct().collect()}
    assert numbers and all(0 <= n < 8 for n in numbers)


def test_last_state_of_every_key_over_several_batches(spark, tmp_path):
    """A key that several micro-batches change, in any order of arrival, and a table without rows."""
    source = f"{tmp_path}/arrivals"
    for part in ("1, 10", "2, 5), (1, 7", "1, 1"):
        spark.sql(f"select * from values ({part}) as v(k, x)").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k int, x int").option("maxFilesPerTrigger", 1).parquet(source)
    sums = stream.groupBy("k").agg(F.sum("x").alias("total"), F.count("*").alias("n"))
    assert {tuple(r) for r in ingest.drain_latest(sums, ["k"], "sums").collect()} == {(1, 18, 3), (2, 5, 1)}
    none = f"{tmp_path}/none"
    spark.sql("select 1 as k, 2 as x where false").write.parquet(none)
    empty = spark.readStream.schema("k int, x int").parquet(none).groupBy("k").agg(F.count("*").alias("n"))
    assert ingest.drain_latest(empty, ["k"], "none").count() == 0


def test_arrivals_bring_more_files_not_larger_ones(spark):
    events = spark.range(1000).withColumnRenamed("id", "event_id")
    stream = ingest.shuffled_arrivals(events, "event_id", 4, file_rows=50)
    sizes = []
    stream.writeStream.foreachBatch(lambda batch, _: sizes.append(sorted(
        r["n"] for r in batch.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()))).trigger(
        availableNow=True).start().awaitTermination()
    assert len(sizes) == 4 and sum(map(sum, sizes)) == 1000
    assert all(len(files) == 5 and max(files) < 100 for files in sizes)
