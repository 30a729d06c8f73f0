import datetime as dt

import pytest
from pyspark.sql import functions as F

from leakscope.sources import tables
from leakscope.sources.testdata import SOURCE_SCHEMAS


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_upsert_keeps_unsupplied_columns_and_takes_supplied_nulls(spark):
    target = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, n int, s string")
    updates = spark.createDataFrame([("b", None), ("c", 3)], "k string, n int")
    assert rows(tables.upsert(target, updates, ["k"]), "k") == [
        ("a", 1, "x"), ("b", None, "y"), ("c", 3, None)]
    with pytest.raises(ValueError):
        tables.upsert(target, updates.withColumn("z", F.lit(1)), ["k"])


def test_upsert_takes_the_last_of_repeated_keys(spark):
    target = spark.createDataFrame([("a", 1)], "k string, n int")
    updates = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("a", 6, 0)], "k string, n int, at int")
    merged = tables.upsert(target, tables.latest_per_key(updates, ["k"], F.col("at")).drop("at"), ["k"])
    assert rows(merged, "k") == [("a", 7)]


def test_update_and_delete_treat_unknown_as_no_match(spark):
    df = spark.createDataFrame([(1, "new"), (None, "new")], "x int, s string")
    assert rows(tables.update_where(df, F.col("x") == 1, {"s": F.lit("done")}), "x") == [
        (None, "new"), (1, "done")]
    assert rows(tables.delete_where(df, F.col("x") == 1), "x") == [(None, "new")]


def test_select_rows(spark):
    df = spark.range(10)
    assert [r.id for r in tables.select_rows(df, F.col("id") > 2, [F.desc("id")], 2, 1).collect()] == [8, 7]
    assert tables.select_rows(df, limit=0).count() == 0


def test_ids_are_consecutive_under_a_hot_leading_key(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("g"), F.col("id").alias("k"))
    got = rows(tables.assign_ids(df, ["g", "k"], start_after=10), "g", "k")
    assert [r[0] for r in got] == list(range(11, 5011))


def _event(event_id, day, amount, **more):
    return {"event_id": event_id, "sim_date": day, "reported_revenue": amount, **more}


EVENT_COLS = "event_id string, sim_date date, reported_revenue double"


def test_upsert_table_rewrites_only_its_dates(spark, tmp_path):
    root = str(tmp_path)
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    first = spark.createDataFrame([_event("a", d1, 1.0), _event("b", d2, 2.0)], EVENT_COLS)
    tables.upsert_table(spark, root, "ticketing_events", first)
    untouched = sorted(p.name for p in (tmp_path / "ticketing_events" / "sim_date=2024-01-02").iterdir())
    second = spark.createDataFrame([_event("a", d1, 9.0), _event("c", d1, 3.0)], EVENT_COLS)
    tables.upsert_table(spark, root, "ticketing_events", second)
    tables.upsert_table(spark, root, "ticketing_events", second)  # a replay changes nothing
    got = tables.scan(spark, root, "ticketing_events").select("event_id", "reported_revenue")
    assert rows(got, "event_id") == [("a", 9.0), ("b", 2.0), ("c", 3.0)]
    assert untouched == sorted(p.name for p in (tmp_path / "ticketing_events" / "sim_date=2024-01-02").iterdir())


def stored(spark, root):
    return rows(tables.scan(spark, root, "ticketing_events").select("event_id", "sim_date", "reported_revenue"), "event_id", "sim_date")


def test_upsert_table_moves_a_row_whose_date_changes(spark, tmp_path):
    root = str(tmp_path)
    d1, d2 = dt.date(2024, 1, 1), dt.date(2024, 1, 2)
    tables.upsert_table(spark, root, "ticketing_events", spark.createDataFrame(
        [_event("a", d1, 1.0), _event("b", d2, 2.0)], EVENT_COLS))
    tables.upsert_table(spark, root, "ticketing_events", spark.createDataFrame([_event("a", d2, 5.0)], EVENT_COLS))
    assert stored(spark, root) == [("a", d2, 5.0), ("b", d2, 2.0)]
    assert not (tmp_path / "ticketing_events" / "sim_date=2024-01-01").exists()


def test_upsert_table_keeps_rows_without_a_date(spark, tmp_path):
    root, d1 = str(tmp_path), dt.date(2024, 1, 1)
    for row in (_event("a", None, 1.0), _event("b", None, 2.0), _event("c", d1, 3.0)):
        tables.upsert_table(spark, root, "ticketing_events", spark.createDataFrame([row], EVENT_COLS))
    assert stored(spark, root) == [("a", None, 1.0), ("b", None, 2.0), ("c", d1, 3.0)]
    tables.upsert_table(spark, root, "ticketing_events", spark.createDataFrame([_event("a", d1, 4.0)], EVENT_COLS))
    assert stored(spark, root) == [("a", d1, 4.0), ("b", None, 2.0), ("c", d1, 3.0)]


@pytest.mark.parametrize("dies_in", ["_declare", "rename_path", "apply_change", "_write_dates", "delete_path"])
def test_an_upsert_that_dies_changes_all_or_nothing(spark, tmp_path, monkeypatch, dies_in):
    """Rows move to another date, a date gets its first row, one loses its last; the job dies on the way."""
    root = str(tmp_path)
    d1, d2, d3 = (dt.date(2024, 1, d) for d in (1, 2, 3))
    tables.upsert_table(spark, root, "ticketing_events", spark.createDataFrame(
        [_event("a", d1, 1.0), _event("b", d2, 2.0), _event("n", None, 3.0)], EVENT_COLS))
    old = stored(spark, root)
    moves = spark.createDataFrame([_event("a", d2, 5.0), _event("n", d3, 6.0)], EVENT_COLS)
    new = [("a", d2, 5.0), ("b", d2, 2.0), ("n", d3, 6.0)]
    real = getattr(tables, dies_in)

    def dies(first, *rest):
        # what a job does before it declares its change is not the point where it dies
        if dies_in in ("apply_change", "delete_path") and not (tmp_path / "_changes/ticketing_events/declared").exists():
            return real(first, *rest)
        raise RuntimeError("executor lost")

    with monkeypatch.context() as broken:
        broken.setattr(tables, dies_in, dies)
        with pytest.raises(RuntimeError):
            tables.upsert_table(spark, root, "ticketing_events", moves)
        declared = dies_in not in ("_declare", "rename_path")
        assert stored(spark, root) == (new if declared else old)
        assert tables.scan(spark, root, "ticketing_events").filter(F.col("sim_date") == d2).count() == (2 if declared else 1)
    assert stored(spark, root) == (new if declared else old)
    more = spark.createDataFrame([_event("c", d1, 7.0)], EVENT_COLS)
    tables.upsert_table(spark, root, "ticketing_events", more)
    assert stored(spark, root) == sorted([*(new if declared else old), ("c", d1, 7.0)])
    tables.upsert_table(spark, root, "ticketing_events", moves)
    assert stored(spark, root) == [*new[:2], ("c", d1, 7.0), new[2]]
    assert not (tmp_path / "_changes/ticketing_events/declared").exists()


@pytest.mark.parametrize("dies_in", ["rename_path", "_write_dates"])
def test_a_table_without_dates_survives_its_overwrite(spark, tmp_path, monkeypatch, dies_in):
    root, cols = str(tmp_path), "route_id string, num_stops int"
    tables.upsert_table(spark, root, "routes", spark.createDataFrame([("r1", 5), ("r2", 6)], cols))
    with monkeypatch.context() as broken:
        broken.setattr(tables, dies_in, lambda *_: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            tables.upsert_table(spark, root, "routes", spark.createDataFrame([("r2", 7), ("r3", 8)], cols))
    found = rows(tables.scan(spark, root, "routes").select("route_id", "num_stops"), "route_id")
    assert found == ([("r1", 5), ("r2", 6)] if dies_in == "rename_path" else [("r1", 5), ("r2", 7), ("r3", 8)])
    # updates made from the table itself, whose rows the pending change still holds
    again = tables.scan(spark, root, "routes").select("route_id", (F.col("num_stops") + 1).alias("num_stops"))
    tables.upsert_table(spark, root, "routes", again)
    assert rows(tables.scan(spark, root, "routes").select("route_id", "num_stops"), "route_id") == [
        (r, n + 1) for r, n in found]


def test_an_unreadable_table_is_not_overwritten(spark, tmp_path):
    (tmp_path / "ticketing_events").mkdir()
    (tmp_path / "ticketing_events" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        tables.upsert_table(spark, str(tmp_path), "ticketing_events", spark.createDataFrame(
            [_event("a", dt.date(2024, 1, 1), 1.0)], EVENT_COLS))
    assert (tmp_path / "ticketing_events" / "part-0.parquet").read_text() == "not parquet"


def test_jobs_leave_no_scratch_behind(spark, tmp_path):
    from leakscope import session
    def left():
        return set(session.folder_names(spark, session._application_folder(spark)))
    session.scratch_path(spark, "x")
    before = left()
    for day in (1, 2):
        tables.upsert_table(spark, str(tmp_path), "ticketing_events", spark.createDataFrame(
            [_event("a", dt.date(2024, 1, day), 1.0)], EVENT_COLS))
    assert left() == before


def test_scan_prunes_dates_and_columns(spark, tmp_path):
    root = str(tmp_path)
    first = spark.createDataFrame([_event("a", dt.date(2024, 1, d), 1.0) for d in (1, 2, 3)], EVENT_COLS)
    tables.overwrite(first, root, "ticketing_events")
    df = tables.scan(spark, root, "ticketing_events").filter("sim_date = '2024-01-02'").select("event_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(sim_date" in plan and "ReadSchema: struct<event_id:string>" in plan
    assert df.count() == 1


def test_append_rejects_unknown_columns(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.append(spark.createDataFrame([(1,)], "surprise int"), str(tmp_path), "pipeline_metrics")


def test_objects(spark, tmp_path):
    root = str(tmp_path)
    report = spark.createDataFrame([(0.5, "x")], "score double, name string")
    tables.put_object(report, root, "exports", "2024/report")
    assert tables.get_object(spark, root, "exports", "2024/report").first().asDict() == {
        "score": 0.5, "name": "x"}
    assert tables.get_object(spark, root, "exports", "none") is None
    listed = tables.list_objects(spark, f"{root}/exports").filter(F.col("key").contains("part-")).collect()
    assert listed and all(r["size"] > 0 and r.last_modified for r in listed)


def test_sql_over_registered_tables(spark, small):
    tables.register_views({"routes": small.routes, "stops": small.stops})
    got = spark.sql("select count(*) as n from routes join stops using (route_id)").first().n
    assert got == small.stops.count()


def test_declared_source_schemas(spark, small):
    for name, schema in SOURCE_SCHEMAS.items():
        found = spark.read.parquet(f"{small.dir}/{name}.parquet").schema
        declared = small.table(name).schema
        assert [(f.name, f.dataType) for f in found] == [(f.name, f.dataType) for f in declared], name
